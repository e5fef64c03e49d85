import pytest
from pyspark.sql import types as T

LONG = "alpha beta gamma delta. " * 40_000  # one text of about a million characters

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a", 10),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "b", None),
    (3, None, "en", "a", 0),
    (4, "", None, None, 0),
    (5, " \t\n\x0b ", "de", None, 5),
    (6, LONG, "en", "a", len(LONG)),
    (7, "1234 %%% 5678 !!!", "de", "b", 17),
    (None, "Der schnelle braune Fuchs springt über den faulen Hund am alten Fluss heute früh.", "de", "b", 80),
    (None, None, None, None, None),
    (8, "Der schnelle braune Fuchs springt über den faulen Hund am alten Fluss heute früh.", "de", "é", 80),
    (9, "ÜBER ß İstanbul 𝒜𝒷𝒸 \x00 nul", "de", "𐀀", 20),
    (8, "another text under the same number", None, "b", 33),
]
CLASHING = ["fp", "size", "score", "shard", "slot", "copies", "key", "draw", "units", "removed", "class", "h", "label", "value"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in ROWS], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (3, None, None), (4, 0, 0), (None, 1, 1), (6, 1, 1), (6, 0, 0), (99, 1, 1), (7, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_items(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog near the old river bank"), (None, None), (2, ""), (3, "short"),
            (4, "the quick brown fox jumps over the lazy dog near the old river bank"), (5, "no such passage is anywhere in these documents at all")]
    return spark.createDataFrame(rows, "item_id long, text string")


def same_rows(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.fixture(scope="session")
def plain_docs(spark):
    """Makes a table of documents from texts."""

    def make(texts, langs=None, sources=None):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                               T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
        rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, schema)

    return make
