"""Phrase collocations by SETM: set-oriented mining of relations of occurrences.

The relation R1 holds every word occurrence: which piece, which place, which word.
It is persisted in chunks, each a run of whole texts, as arrays in the order of
(piece, place); words and phrases are numbers within their chunk.  One round per length:

* group-count: every chunk sends its different phrases of the length with their
  counts, as arrays, to the tasks that the phrases' hashes name; these add up;
* semi-join: each chunk gets back, as one bit per phrase, which of them are frequent
  in the whole corpus, and keeps only their occurrences;
* merge-join: R(k+1) has an occurrence wherever R(k) has one at a place and another
  at the next place of the same piece.  Both lie in order, so one pass aligns them.

A chunk names a phrase once however often it holds it, so common phrases send no
more than rare ones, and nothing of unbounded size meets in a task or the driver.
Words are exact: their 64-bit codes are checked for collisions where they are counted;
frequent ones get numbers of their own there, and phrases are compared by all numbers.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costloom.llm.common import map_texts, spread, staged, table, utf8
from costloom.llm.registry import query

LEAST = 10            # occurrences of a candidate
LENGTHS = 3           # words of the longest candidate
INSIDE = 50           # percent of its occurrences inside a longer candidate by which a phrase is dropped
TOP = 2000            # phrases of a language's report
CHUNK = 1 << 20       # words in a chunk
KEYS = 1 << 21        # different phrases, counted once a chunk, that one task adds up
UND = "und"
BREAKS = re.compile(rb"[.,;:!?\x0A-\x0D]+")
SALTS = 8


def mixed(codes: np.ndarray) -> np.ndarray:
    """One pseudo-random number per row of codes; it only deals and orders."""
    x = np.full(len(codes), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for i in range(codes.shape[1]):
        x = (x ^ codes[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in an order that brings equal rows together, and where groups start."""
    order = np.argsort(mixed(codes), kind="stable")
    rows = codes[order]
    starts = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)][:len(rows)]
    found = rows[starts]
    if len(np.unique(mixed(found))) != len(found):  # two phrases share a number: order by the codes themselves
        order = np.lexsort(codes.T[::-1])
        rows = codes[order]
        starts = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)][:len(rows)]
    return order, starts


def packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpacked(data: bytes, kind, count: int) -> np.ndarray:
    size = count * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), dtype=kind) if count else np.empty(0, dtype=kind)


def packed_codes(codes: np.ndarray) -> bytes:
    """Rows of codes, column by column, in four bytes each where they all fit."""
    kind = np.uint32 if not codes.size or codes.max() < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + packed(codes.T.astype(kind).ravel())


def unpacked_codes(data: bytes, count: int, width: int) -> np.ndarray:
    kind = np.uint32 if data[0] == 4 else np.uint64
    return unpacked(data[1:], kind, count * width).reshape(width, count).T.astype(np.uint64)


# What chunks and tasks exchange: a chunk's phrases for one task (task not null), or its relation.
SENT = [("task", pa.int32()), ("chunk", pa.int64()), ("start", pa.int64()), ("n_codes", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary()),
        ("words", pa.binary()), ("langs", pa.binary()), ("names", pa.list_(pa.string()))]
RELATION = [("n_at", pa.int64()), ("steps", pa.binary()), ("phrase", pa.binary()), ("n_phrases", pa.int64())]
MADE = pa.schema(SENT + RELATION)
MADE_DDL = ("task int, chunk long, start long, n_codes long, codes binary, counts binary, words binary, langs binary, names array<string>, "
            "n_at long, steps binary, phrase binary, n_phrases long")
BACK_DDL = "chunk long, start long, n_codes long, bits binary, kept binary, codes binary, f binary, words binary, langs binary, names array<string>, totals binary, clash boolean"
BACK = pa.schema([("chunk", pa.int64()), ("start", pa.int64()), ("n_codes", pa.int64()), ("bits", pa.binary()), ("kept", pa.binary()), ("codes", pa.binary()), ("f", pa.binary()),
                  ("words", pa.binary()), ("langs", pa.binary()), ("names", pa.list_(pa.string())), ("totals", pa.binary()), ("clash", pa.bool_())])


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)


def _order(codes: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by the task that adds them up, and that task of each."""
    to = (mixed(codes) % np.uint64(tasks)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return order, to[order]


def _parts(to: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Task, first row and end of every run of ``to``."""
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][:len(to)])
    yield from zip(to[cuts].tolist(), cuts.tolist(), np.r_[cuts[1:], len(to)].tolist())


def _relation(chunk: int, at: np.ndarray, phrase: np.ndarray, phrases: int) -> dict:
    return {"chunk": chunk, "n_at": len(at), "steps": packed(np.diff(at, prepend=np.int32(0)).astype(np.int32)), "phrase": packed(phrase.astype(np.int32)), "n_phrases": phrases}


# R1

class Words(dict):
    """Number of each word of a language in this chunk, given at its first occurrence."""

    def __init__(self, found: list):
        self.found = found

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.found)
        self.found.append(word)
        return number


class Chunk:
    """Word numbers of whole texts in order, -1 after every piece."""

    def __init__(self):
        self.places, self.found, self.by_lang = array("i"), [], {}

    def add(self, lang: str, text: bytes) -> None:
        words = self.by_lang.get(lang)
        if words is None:
            words = self.by_lang[lang] = Words(self.found)
        number, places = words.__getitem__, self.places
        for piece in BREAKS.split(text.lower()):
            own = piece.split()  # of bytes without breaks: only space and tab are left to split at
            if own:
                places.extend(map(number, own))
                places.append(-1)

    def rows(self, chunk: int, salt: int, tasks: int) -> pa.RecordBatch:
        """The relation, and the words with their counts for the tasks that add them up."""
        places = np.frombuffer(self.places, dtype=np.int32)
        at = np.flatnonzero(places >= 0)
        words, names = np.array([*self.found, b""], dtype=object)[:-1], sorted(self.by_lang)
        langs = np.empty(len(words), dtype=np.uint32)
        for number, lang in enumerate(names):
            langs[list(self.by_lang[lang].values())] = number
        seeds = [xxhash.xxh64_intdigest(n, salt) for n in names]
        codes = np.array([xxhash.xxh64_intdigest(w, seeds[l]) for l, w in zip(langs.tolist(), words)], dtype=np.uint64)[:, None]
        order, to = _order(codes, tasks)
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        counts = np.bincount(places[at], minlength=len(words))[order]
        codes, words, langs = codes[order], words[order], langs[order]
        sent = [{"task": t, "chunk": chunk, "start": a, "n_codes": b - a, "codes": packed_codes(codes[a:b]), "counts": packed(counts[a:b].astype(np.int64)),
                 "words": _joined(words[a:b]), "langs": packed(langs[a:b]), "names": names} for t, a, b in _parts(to)]
        return _rows(MADE, [*sent, _relation(chunk, at, place[places[at]], len(words))])


def _joined(words: np.ndarray) -> bytes:
    """Words in one text; none of them holds a space."""
    text = b" ".join(words)
    return len(text).to_bytes(8, "little") + packed(np.frombuffer(text, dtype=np.uint8))


def _split(data: bytes) -> list[bytes]:
    size = int.from_bytes(data[:8], "little")
    return unpacked(data[8:], np.uint8, size).tobytes().split(b" ")


def occurrences(docs: DataFrame, salt: int, tasks: int) -> DataFrame:
    """R1 of ``docs``, a relation per chunk, and what the chunks send."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, chunk = TaskContext.get().partitionId(), 0, Chunk()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                chunk.add(lang, text)
                if len(chunk.places) >= CHUNK:
                    yield chunk.rows(task << 24 | number, salt, tasks)
                    number, chunk = number + 1, Chunk()
        if len(chunk.places):
            yield chunk.rows(task << 24 | number, salt, tasks)

    return map_texts(docs, run, MADE_DDL)


# Rounds

def _added(length: int, least: int, tasks: int):
    """Adds up the counts of one task's phrases.

    Gives a row with the frequent ones (``chunk`` null) and, for every chunk, the bits of
    those it sent and the numbers of those it keeps.  Words (``length`` 1) get a number
    here: their place among the task's frequent ones, times the tasks, plus the task.
    """
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("chunk", "ascending"), ("start", "ascending")])
        sizes = rows["n_codes"].to_pylist()
        codes = np.concatenate([np.empty((0, length), dtype=np.uint64), *(unpacked_codes(x, n, length) for x, n in zip(rows["codes"].to_pylist(), sizes))])
        counts = np.concatenate([np.empty(0, dtype=np.int64), *(unpacked(x, np.int64, n) for x, n in zip(rows["counts"].to_pylist(), sizes))])
        order, starts = grouped(codes)
        first = np.flatnonzero(starts)
        sums = np.add.reduceat(counts[order], first) if len(first) else np.empty(0, dtype=np.int64)
        often, group = sums >= least, np.empty(len(codes), dtype=np.int64)
        group[order] = np.cumsum(starts) - 1
        frequent, whole = codes[order][starts][often], {}
        if length == 1:
            numbers = np.cumsum(often) - 1
            frequent = (np.arange(int(often.sum()), dtype=np.uint64) * np.uint64(tasks) + np.uint64(rows["task"][0].as_py()))[:, None]
            whole = _words_of(rows, sizes, order, starts, group, sums, often)
            kept_codes = lambda keep, groups: frequent[numbers[groups[keep]]]
        out = [{"codes": packed_codes(frequent), "f": packed(sums[often]), "n_codes": len(frequent), **whole}]
        at = 0
        for chunk, start, n in zip(rows["chunk"].to_pylist(), rows["start"].to_pylist(), sizes):
            groups = group[at:at + n]
            keep = often[groups]
            kept = kept_codes(keep, groups) if length == 1 else codes[at:at + n][keep]
            out.append({"chunk": chunk, "start": start, "n_codes": n, "bits": np.packbits(keep).tobytes(), "kept": packed_codes(kept)})
            at += n
        return pa.Table.from_batches([_rows(BACK, out)])

    return run


def _words_of(rows: pa.Table, sizes: list[int], order: np.ndarray, starts: np.ndarray, group: np.ndarray, sums: np.ndarray, often: np.ndarray) -> dict:
    """Texts and languages of the frequent words, all words' occurrences by language, and
    whether one code stands for two words."""
    names = sorted({n for own in rows["names"].to_pylist() for n in own})
    words = [w for x in rows["words"].to_pylist() for w in _split(x)]
    at = {n: i for i, n in enumerate(names)}
    langs = np.concatenate([np.array([at[n] for n in own], dtype=np.int64)[unpacked(x, np.uint32, size)] for own, x, size in zip(rows["names"].to_pylist(), rows["langs"].to_pylist(), sizes)])
    first = order[starts]
    texts = np.array([*words, b""], dtype=object)[:-1]
    clash = bool((texts[first][group] != texts).any() or (langs[first][group] != langs).any())
    totals = np.zeros(len(names), dtype=np.int64)
    np.add.at(totals, langs[first], sums)
    return {"words": _joined(texts[first][often]), "langs": packed(langs[first][often].astype(np.uint32)), "names": names, "totals": packed(totals.astype(np.int64)), "clash": clash}


def group_count(sent: DataFrame, length: int, least: int, tasks: int) -> DataFrame:
    """What the tasks found of the chunks' phrases (``BACK``)."""
    return staged(sent.filter("task IS NOT NULL").groupBy("task").applyInArrow(_added(length, least, tasks), BACK_DDL), "uncompressed")


def _frequent(back: DataFrame, length: int) -> DataFrame:
    """``c1`` .. and ``f`` of the frequent phrases; words have ``lang`` and ``word`` too."""
    names = [f"c{i + 1}" for i in range(length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_codes"]
                codes, f = unpacked_codes(row["codes"], n, length).astype(np.int64), unpacked(row["f"], np.int64, n)
                columns = [*(pa.array(np.ascontiguousarray(codes[:, i])) for i in range(length)), pa.array(f)]
                if length == 1:
                    langs = unpacked(row["langs"], np.uint32, n).tolist()
                    columns += [pa.array([row["names"][x] for x in langs], pa.string()),
                                pa.array([w.decode("utf-8", "surrogatepass") for w in _split(row["words"])] if n else [], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "f", *(["lang", "word"] if length == 1 else [])])

    ddl = ", ".join(f"{c} long" for c in [*names, "f"]) + (", lang string, word string" if length == 1 else "")
    used = ["n_codes", "codes", "f", *(["langs", "names", "words"] if length == 1 else [])]
    return back.filter("chunk IS NULL").select(*used).mapInArrow(run, ddl)


def _totals(back: DataFrame) -> DataFrame:
    """``lang`` and ``n``, the number of its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, totals in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(unpacked(totals, np.int64, len(names)))], names=["lang", "n"])

    return back.filter("chunk IS NULL").select("names", "totals").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def extend(made: DataFrame, back: DataFrame, length: int, tasks: int, more: bool) -> DataFrame:
    """Semi-joins R(length) with its frequent phrases and merge-joins it with itself.

    Gives the phrases of R(length + 1) to count and, if ``more`` rounds follow, that relation.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                keep, codes = _kept(row["bits"] or [], row["n_phrases"], length)
                at = np.cumsum(unpacked(row["steps"], np.int32, row["n_at"]), dtype=np.int32)
                phrase = unpacked(row["phrase"], np.int32, row["n_at"])
                stay = keep[phrase]
                at, phrase, codes, counts, to = _extended(at[stay], (np.cumsum(keep) - 1)[phrase[stay]], codes, tasks)
                rows = [{"task": t, "chunk": row["chunk"], "start": a, "n_codes": b - a, "codes": packed_codes(codes[a:b]), "counts": packed(counts[a:b])} for t, a, b in _parts(to)]
                yield _rows(MADE, rows + ([_relation(row["chunk"], at, phrase, len(codes))] if more else []))

    relation = made.filter("task IS NULL").select("chunk", *[n for n, _ in RELATION])
    bits = back.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("start", "n_codes", "bits", "kept"))).alias("bits"))
    return relation.join(bits, "chunk", "left").select("chunk", *[n for n, _ in RELATION], "bits").mapInArrow(run, MADE_DDL)


def _kept(parts: list, total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the chunk's phrases are frequent, and the codes of these."""
    keep, codes = np.zeros(total, dtype=bool), [np.empty((0, length), dtype=np.uint64)]
    for x in parts:
        own = np.unpackbits(np.frombuffer(x["bits"], dtype=np.uint8), count=x["n_codes"]).astype(bool)
        keep[x["start"]:x["start"] + x["n_codes"]] = own
        codes.append(unpacked_codes(x["kept"], int(own.sum()), length))
    return keep, np.concatenate(codes)


def _extended(at: np.ndarray, phrase: np.ndarray, codes: np.ndarray, tasks: int):
    """R(k+1) from R(k): places, phrase numbers, all codes and counts of the phrases, in the order they are sent.

    ``at`` and ``phrase``: R(k) in order.  ``codes``: of its phrases.  Places of different
    pieces are never next to each other.
    """
    next_to = np.flatnonzero(at[1:] == at[:-1] + 1)
    pairs = phrase[next_to].astype(np.int64) << 32 | phrase[next_to + 1]
    different, number, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    longer = np.concatenate([codes[different >> 32], codes[different & 0xFFFFFFFF][:, -1:]], axis=1)
    order, to = _order(longer, tasks)
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return at[next_to], place[number], longer[order], counts[order].astype(np.int64), to


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LENGTHS) -> tuple[DataFrame, dict[int, DataFrame]]:
    """``lang`` and ``n`` of the corpus, and by length the phrases (from words on) with ``least`` occurrences."""
    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"), F.col("text").cast("string").alias("text"))
    plain = spread(plain)
    spark = docs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, plain.rdd.getNumPartitions())
    for salt in range(SALTS):
        made = staged(occurrences(plain, salt, tasks), "uncompressed")
        back = group_count(made, 1, least, tasks)
        if not back.filter("clash").limit(1).count():
            break
    else:
        raise RuntimeError("codes of words collide for every salt")
    n = staged(_totals(back))
    found = {1: staged(_frequent(back, 1))}
    places = made.agg(F.coalesce(F.sum("n_at"), F.lit(0))).first()[0]
    tasks = max(tasks, -(-places // KEYS))
    for length in range(1, longest):
        made = staged(extend(made, back, length, tasks, length + 1 < longest), "uncompressed")
        back = group_count(made, length + 1, least, tasks)
        found[length + 1] = staged(_frequent(back, length + 1))
    return n, found


# Report

def _scored(phrases: DataFrame, length: int, shorter: dict[int, DataFrame]) -> DataFrame:
    """``phrases`` with ``a``, ``l``, ``r`` of the lowest-scoring cut, and its ``score``."""
    out = phrases.withColumnRenamed("f", "a")
    cuts = []
    for k in range(1, length):
        for side, first, n in (("l", 1, k), ("r", k + 1, length - k)):
            part = shorter[n].select(*[F.col(f"c{i + 1}").alias(f"c{first + i}") for i in range(n)], F.col("f").alias(f"{side}{k}"))
            out = out.join(part, [f"c{first + i}" for i in range(n)])
        wide = {c: F.col(c).cast("decimal(16,0)") for c in ("a", f"l{k}", f"r{k}")}
        score = F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (wide["a"] * wide["a"]), wide[f"l{k}"] * wide[f"r{k}"])
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    least = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return out.withColumn("cut", least).select(*[f"c{i + 1}" for i in range(length)], "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LENGTHS, inside: int = INSIDE) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's best phrases.

    Texts are lower-cased (A-Z), cut into pieces and words as the query's contract
    says; ``n`` is the number of the language's words, the rest as there.  A null lang
    is ``und``, a null text is empty, a text of a million words is as any other, and
    repeated rows count as often as they come.  Equal scores go by ``a``, then by the
    phrase's bytes.  Other columns are not read.  No rows, or texts without a phrase
    of ``least`` occurrences, give no rows.
    """
    totals, counts = frequent_phrases(docs, least, longest)
    words = counts[1]
    rows = None
    for length in range(2, longest + 1):
        names = [f"c{i + 1}" for i in range(length)]
        kept = counts[length]
        for longer in range(length + 1, longest + 1):  # words inside a longer candidate that takes most of them
            ends = [counts[longer].select(*[F.col(f"c{s + i + 1}").alias(names[i]) for i in range(length)], "f") for s in range(longer - length + 1)]
            around = ends[0]
            for more in ends[1:]:
                around = around.unionByName(more)
            most = around.groupBy(*names).agg(F.max("f").alias("most"))
            kept = kept.join(most, names, "left").filter(F.coalesce(F.col("most") * 100 < F.col("f") * inside, F.lit(True))).drop("most")
        scored = _scored(kept, length, counts)
        for i in range(length):
            scored = scored.join(words.select(F.col("c1").alias(f"c{i + 1}"), F.col("word").alias(f"w{i + 1}"), *([F.col("lang")] if i == 0 else [])), f"c{i + 1}")
        scored = scored.select("lang", F.concat_ws(" ", *[f"w{i + 1}" for i in range(length)]).alias("phrase"), "a", "l", "r", "score")
        rows = scored if rows is None else rows.unionByName(scored)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query("op12_collocations", r"""
WITH pieces AS (
    SELECT lang, doc, generate_subscripts(p, 1) AS piece, unnest(p) AS text FROM (
        SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
               string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
words AS (
    SELECT lang, doc, piece, generate_subscripts(w, 1) AS pos, unnest(w) AS w FROM (
        SELECT lang, doc, piece, list_filter(string_split_regex(text, '[ \t]+'), lambda x: x <> '') AS w FROM pieces)),
n AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f1 AS (SELECT lang, w, count(*) AS f FROM words GROUP BY lang, w),
runs AS (
    SELECT lang, w AS a, lead(w, 1) OVER piece AS b, lead(w, 2) OVER piece AS c FROM words
    WINDOW piece AS (PARTITION BY lang, doc, piece ORDER BY pos)),
f2 AS (SELECT lang, a, b, count(*) AS f FROM runs WHERE b IS NOT NULL GROUP BY lang, a, b),
f3 AS (SELECT lang, a, b, c, count(*) AS f FROM runs WHERE c IS NOT NULL GROUP BY lang, a, b, c HAVING count(*) >= 10),
around AS (
    SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY lang, a, b),
two AS (
    SELECT g.lang, g.a || ' ' || g.b AS phrase, g.f AS a, x.f AS l, y.f AS r,
           CAST((CAST(1000000 AS HUGEINT) * g.f * g.f) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM f2 g JOIN f1 x ON x.lang = g.lang AND x.w = g.a JOIN f1 y ON y.lang = g.lang AND y.w = g.b
    LEFT JOIN around t ON t.lang = g.lang AND t.a = g.a AND t.b = g.b
    WHERE g.f >= 10 AND (t.f IS NULL OR 100 * t.f < 50 * g.f)),
cuts AS (
    SELECT g.lang, g.a || ' ' || g.b || ' ' || g.c AS phrase, g.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
           CAST((CAST(1000000 AS HUGEINT) * g.f * g.f) // (CAST(x.f AS HUGEINT) * yz.f) AS BIGINT) AS s1,
           CAST((CAST(1000000 AS HUGEINT) * g.f * g.f) // (CAST(xy.f AS HUGEINT) * z.f) AS BIGINT) AS s2
    FROM f3 g JOIN f1 x ON x.lang = g.lang AND x.w = g.a JOIN f1 z ON z.lang = g.lang AND z.w = g.c
    JOIN f2 xy ON xy.lang = g.lang AND xy.a = g.a AND xy.b = g.b JOIN f2 yz ON yz.lang = g.lang AND yz.a = g.b AND yz.b = g.c),
scored AS (
    SELECT * FROM two UNION ALL
    SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""")
def op12_collocations(spark, sf_dir):
    """The collocations of every language."""
    return collocations(table(spark, sf_dir, "documents"))
