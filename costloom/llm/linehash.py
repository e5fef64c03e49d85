"""Substring deduplication by hashing the lines and sentences of all documents.

A unit is a sentence of a line, or, where a sentence runs on for more than
``LONG`` words, a piece of it cut after words that a hash picks, so that a passage
is cut alike wherever it stands.  Units are compared in lower case, with single
spaces and without marks at the end, by a 96-bit digest.

Of a digest's occurrences the earliest ranked is kept: the one in the document with
the smallest doc_id, there the first.  Others are repeats.  Runs of repeats that
follow each other in a document are removed if they have at least ``least_words``
words in all; a short phrase that happens to recur stays.  What is removed is
reported by its offsets in the original text.

Occurrences within a text are told apart while it is read, so each document brings
a digest once.  Digests are added up map-side into the smallest doc_id and the
number of documents; only digests of two or more documents come back.  Both sides
of that join are tables, so Spark splits a digest that a third of all documents
share over many tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import map_texts, spread, staged, table
from costloom.llm.registry import query

LEAST_WORDS = 16    # a passage is more than a short sentence that happens to recur
LONG = 16
CUT_ONE_IN = 8      # words that end a piece of a long sentence
LAST = (1 << 63) - 1
UNIT = re.compile(r"[^\n\r.!?]*+(?:[.!?]++(?=\S)[^\n\r.!?]*+)*+[.!?]*+")
WORD = re.compile(r"\S+")


def units(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, words, normal form) of the units of a text that have a word."""
    for m in UNIT.finditer(text):
        words = m[0].lower().split()
        if not words:
            continue
        if len(words) <= LONG:
            yield m.start(), m.end(), len(words), " ".join(words).rstrip(".!?")
            continue
        first, spans = 0, [w.span() for w in WORD.finditer(m[0])]
        for i, word in enumerate(words):
            if i + 1 == len(words) or zlib.crc32(word.encode()) % CUT_ONE_IN == 0:
                yield m.start() + spans[first][0], m.start() + spans[i][1], i + 1 - first, " ".join(words[first:i + 1]).rstrip(".!?")
                first = i + 1


def _doc(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST))


def unit_rows(docs: DataFrame) -> DataFrame:
    """One row per unit: ``doc``, ``text_hash``, ``no``, digest ``h`` and ``g``, ``again``.

    ``again``: the same text has it before.  Where a unit lies is found again in the
    text when it is needed, so it isn't sent along.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc", "text_hash", "no", "h", "g", "again"], [pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            rows, digests, again = [], [], []
            for doc, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
                seen = set()
                for no, (_, _, _, norm) in enumerate(units(text)):
                    digest = xxhash.xxh3_128_digest(norm.encode())
                    again.append(digest in seen)
                    seen.add(digest)
                    digests.append(digest)
                    rows.append((doc, text_hash, no))
            both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(both[:, 0]), pa.array(both[:, 1].astype(np.int32)), pa.array(again, pa.bool_())], names=names)

    return map_texts(docs, run, "doc long, text_hash long, no int, h long, g int, again boolean")


def repeats(docs: DataFrame) -> DataFrame:
    """Units that occur earlier: ``doc``, ``text_hash``, ``no`` and ``first_doc``."""
    text = F.col("text").cast("string")
    plain = spread(docs.select(_doc(F.col("doc_id")).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text")).filter("text IS NOT NULL"))
    found = staged(unit_rows(plain))
    # Texts without a doc_id are documents of their own, which rank by text_hash after all others.
    nameless = F.when(F.col("doc") == LAST, F.col("text_hash"))
    shared = found.filter(~F.col("again")).groupBy("h", "g").agg(
        F.min("doc").alias("first_doc"), F.max("doc").alias("_last"), F.min(nameless).alias("first_text"), F.max(nameless).alias("_last_text"))
    several = (F.col("first_doc") < F.col("_last")) | ((F.col("first_doc") == LAST) & (F.col("first_text") < F.col("_last_text")))
    shared = staged(shared.filter(several).drop("_last", "_last_text"))
    columns = ["doc", "text_hash", "no"]
    later = (F.col("doc") != F.col("first_doc")) | ((F.col("first_doc") == LAST) & (F.col("text_hash") != F.col("first_text")))
    others = found.join(shared, ["h", "g"]).filter(later | F.col("again")).select(*columns, "first_doc")
    # What recurs in one document alone has no shared digest.
    own = found.filter("again").join(shared, ["h", "g"], "left_anti").select(*columns, F.col("doc").alias("first_doc"))
    return others.unionByName(own)


REMOVED = "array<struct<start:int,end:int,words:int,first_docs:array<bigint>>>"


def remove_repeats(docs: DataFrame, least_words: int = 8) -> DataFrame:
    """Documents that lose something: ``doc_id``, ``removed`` spans, ``words_removed`` and the ``text`` left.

    ``removed`` has, in order, code-point offsets of the original text (end
    exclusive), the words removed and the documents that keep them.  A document
    that isn't listed stays as it is.  Rows that share a doc_id are one document and
    rank alike: what they share is no repeat.  Rows without a doc_id rank last; they
    are one document only if their texts are equal.  Equal rows lose the same.  Null
    and empty texts have no units.  Other columns aren't read.
    """
    # A set, put together map-side: equal rows bring the same units.
    hits = repeats(docs).groupBy("doc", "text_hash").agg(F.collect_set(F.struct("no", "first_doc")).alias("units"))
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _doc(F.col("doc_id")).alias("doc"), F.xxhash64(text).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("first_docs", pa.list_(pa.int64()))]))
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                removed = [r for r in runs(text, found) if r["words"] >= least_words]
                if removed:
                    rows.append((doc_id, removed, sum(r["words"] for r in removed), without(text, removed)))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), kind, pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "removed", "words_removed", "text"])

    joined = texts.join(hits, ["doc", "text_hash"]).select("doc_id", "text", "units")
    return map_texts(joined, run, f"doc_id long, removed {REMOVED}, words_removed long, text string")


def runs(text: str, found: list[dict]) -> list[dict]:
    """Units of a text that follow each other, joined."""
    out, last, places = [], None, list(units(text))
    for unit in sorted(found, key=lambda u: u["no"]):
        start, end, words, _ = places[unit["no"]]
        first = None if unit["first_doc"] == LAST else unit["first_doc"]
        if last is not None and unit["no"] == last + 1:
            out[-1]["end"] = end
            out[-1]["words"] += words
            if first not in out[-1]["first_docs"]:
                out[-1]["first_docs"].append(first)
        else:
            out.append({"start": start, "end": end, "words": words, "first_docs": [first]})
        last = unit["no"]
    return out


def without(text: str, removed: list[dict]) -> str:
    parts, done = [], 0
    for span in removed:
        parts.append(text[done:span["start"]])
        done = span["end"]
    return "".join([*parts, text[done:]])


@query("op1_substring_dedup")
def op1_substring_dedup(spark, sf_dir):
    """Documents with passages that an earlier document has, and their texts without them."""
    found = remove_repeats(table(spark, sf_dir, "documents"), LEAST_WORDS)
    return found.select("doc_id", "words_removed", "removed", "text")
