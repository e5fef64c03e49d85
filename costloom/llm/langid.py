"""Language identification by rank-order n-gram profiles.

A profile is a language's most frequent letter n-grams (one to three letters, a
word's ends marked), most frequent first.  A document's own most frequent n-grams
are compared with each profile by the out-of-place distance: the sum of the
differences in rank, with the profile's length for an n-gram it lacks.

Learning counts every n-gram of every learnable text: tasks count what their texts
have, and Spark adds the counts up, so what is shuffled is one row per language,
n-gram and task.  Only the finished profiles (languages times ``size`` n-grams)
reach the driver and the tasks.  N-grams are numbers while they are counted, so a
text costs a few sorts and no work per word in Python.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.llm.common import learnable, map_texts, spread, strings, table
from costloom.llm.registry import query

PROFILE = 300
# Mean ranks out of place by which a language must be nearer to be e times as likely.
SHARPNESS = 12.0
UNDETERMINED = "und"
HELD = 500_000    # different n-grams a task counts before it lets them go
PIECE = 1 << 20   # letters counted at a time
BITS = 21         # of a code point
PAIR = 1 << 62    # marks the number of a pair; letters' code points stay below 2 ** 20


# Letters and n-grams as numbers

class Letters:
    """Code points of a text's words in lower case, one 0 before, between and after them."""

    def __init__(self):
        self.kind = np.zeros(0x110000, dtype=np.uint8)  # 1 letter, 2 other word character, 3 none, 0 not yet known

    def of(self, text: str) -> tuple[np.ndarray, bool]:
        """The sequence, and whether the text has a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kind = self.kind[points]
        if (kind == 0).any():
            for x in np.unique(points[kind == 0]).tolist():
                c = chr(x)
                self.kind[x] = 1 if c.isalpha() else 2 if c.isalnum() and not c.isdecimal() else 3
            kind = self.kind[points]
        marked = np.zeros(len(points) + 2, dtype=np.int64)
        marked[1:-1] = np.where((kind < 3) & (points < 1 << 20), points, 0)
        keep = np.r_[True, (marked[1:] != 0) | (marked[:-1] != 0)]
        return marked[keep], bool((kind == 1).any())


def counted(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the different n-grams of a sequence, rising, and how often each occurs.

    A letter is its code point, a pair and a triple are their code points side by
    side; a triple across the end of a word is none.
    """
    codes, counts = [], []
    for at in range(0, len(letters), PIECE):
        a = letters[at:at + PIECE]
        b, c = letters[at + 1:at + PIECE + 1], letters[at + 2:at + PIECE + 2]
        pairs = PAIR | a[:len(b)] << BITS | b
        triples = (a[:len(c)] << 2 * BITS | b[:len(c)] << BITS | c)[b[:len(c)] != 0]
        found = np.concatenate([a[a != 0], pairs[(a[:len(b)] | b) != 0], triples])
        found.sort()
        first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, dtype=np.int64)
        codes.append(found[first])
        counts.append(np.diff(np.r_[first, len(found)]))
    if len(codes) == 1:
        return codes[0], counts[0]
    if not codes:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    codes, back = np.unique(np.concatenate(codes), return_inverse=True)
    return codes, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def spell(code: int) -> str:
    """An n-gram's text, with ``_`` for a word's end."""
    if code & PAIR:
        points = [code >> BITS & (1 << BITS) - 1, code & (1 << BITS) - 1]
    elif code < 1 << BITS:
        points = [code]
    else:
        points = [code >> 2 * BITS, code >> BITS & (1 << BITS) - 1, code & (1 << BITS) - 1]
    return "".join(chr(x) if x else "_" for x in points)


def number(gram: str) -> int:
    points = [0 if c == "_" else ord(c) for c in gram]
    if len(points) == 1:
        return points[0]
    return PAIR | points[0] << BITS | points[1] if len(points) == 2 else points[0] << 2 * BITS | points[1] << BITS | points[2]


# Profiles

def learn_profiles(docs: DataFrame, wanted: Column, size: int = PROFILE) -> dict[str, list[str]]:
    """Language to its ``size`` most frequent n-grams, over all rows of ``docs`` where ``wanted``.

    Rows without language or text teach nothing.  Equal counts rank by the n-gram's number.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(), {}

        def out() -> pa.RecordBatch:
            rows = [(lang, code, n) for lang, own in sums.items() for code, n in own.items()]
            sums.clear()
            columns = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["lang", "code", "n"])

        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(strings(batch.column(0)), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(letters.of(text)[0])
            for lang, parts in by_lang.items():
                codes, n = counted(np.concatenate(parts))
                own = sums.setdefault(lang, Counter())
                for code, times in zip(codes.tolist(), n.tolist()):
                    own[code] += times
            if sum(map(len, sums.values())) > HELD:
                yield out()
        yield out()

    texts = docs.filter(wanted & F.col("lang").isNotNull() & F.col("text").isNotNull())
    texts = texts.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = map_texts(spread(texts), count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = sums.withColumn("place", rank).filter(F.col("place") <= size)
    profiles: dict[str, list[str]] = {}
    for row in sorted(top.collect(), key=lambda r: (r.lang, r.place)):
        profiles.setdefault(row.lang, []).append(spell(row.code))
    return profiles


class Ranker:
    """Compares texts with profiles."""

    def __init__(self, profiles: dict[str, list[str]], size: int = PROFILE):
        self.langs, self.size, self.letters = sorted(profiles), size, Letters()
        self.known = np.array(sorted({number(g) for p in profiles.values() for g in p}), dtype=np.int64)
        self.rank = np.full((len(self.known), len(self.langs)), size, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.known, [number(g) for g in profiles[lang]]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str) -> tuple[str, float]:
        letters, has_letter = self.letters.of(text)
        if not self.langs or not has_letter:
            return UNDETERMINED, 0.0
        codes, counts = counted(letters)
        top = codes[np.argsort(-counts, kind="stable")[:self.size]]
        at = np.minimum(np.searchsorted(self.known, top), len(self.known) - 1)
        rank = np.where((self.known[at] == top)[:, None], self.rank[at], self.size)
        apart = np.where(rank == self.size, self.size, np.abs(rank - np.arange(len(top))[:, None]))
        far = apart.sum(axis=0) / len(top)
        best = int(far.argmin())
        return self.langs[best], float(1 / np.exp((far[best] - far) / SHARPNESS).sum())


def identify(docs: DataFrame, profiles: dict[str, list[str]]) -> DataFrame:
    """``doc_id``, ``text``'s ``lang_pred`` and ``score`` for every row of ``docs``.

    ``score`` (0 to 1) is the share of the nearest language among all, each weighed
    by e to the power of minus its distance.  A null text, one without a letter, or
    no profile at all gives ``und`` and 0.  Languages at the same distance: the
    first by name.  Only ``doc_id`` and ``text`` are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles)
        for batch in batches:
            found = [ranker.predict(t) for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(spread(plain), run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: dict[str, list[str]], least: float = 0.0) -> DataFrame:
    """Rows of ``docs``, all columns, but those that are ``und`` or score under ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles)
        for batch in batches:
            found = (ranker.predict(t) for t in strings(batch.column(at).cast(pa.string())))
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))

    at = docs.columns.index("text")
    return map_texts(spread(docs), run, docs.schema)


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    """Predicted language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs, learnable(F.col("doc_id"), 4, 2))
    held_out = ~learnable(F.col("doc_id"), 4, 2)
    return identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
