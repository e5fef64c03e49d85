"""Document quality by a factorisation machine.

Features of a text: its words hashed into ``BUCKETS`` (log counts, scaled to length
one), structure statistics, and the table's character count.  The machine adds to a
linear score all pairwise interactions, each weighed by the inner product of two
low-rank vectors.  The sum over all pairs costs linear time by the sum-of-squares
identity: half of (sum of v x) squared minus the sum of (v x) squared, per factor.

Learning takes at most ``SAMPLE`` labelled documents, chosen by hash of doc_id; their
sparse features go to the driver, which fits the machine by Adagrad in NumPy.  The
scoring of all texts needs the fitted machine only (a few MB) and no shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import learnable, map_texts, spread, strings, table
from costloom.llm.registry import query
from costloom.llm.toxicity import labelled

SAMPLE = 6_000       # labelled documents to learn from, at most
BUCKETS = 1 << 15
FACTORS = 8
EPOCHS = 12
BATCH = 64
RATE = 0.1
RIDGE = 1e-4
DIGIT = re.compile(r"[0-9]")
MARK = re.compile(r"[^\w\s]")
STOP = re.compile(r"[.!?]")

STATISTICS = ("words", "characters", "word_length", "unlike_words", "commonest_word", "upper_words", "first_upper", "digits",
              "marks", "odd_marks", "marked_words", "bars", "sentence", "line_words", "repeated_lines", "repeated_pairs")


def statistics(text: str, words: list[str], counted: Counter, n_chars: float) -> list[float]:
    """Structure of a text in numbers of about one."""
    n = len(words) or 1
    size = len(text) or 1
    lines = [x for x in text.split("\n") if x]
    marks = Counter(MARK.findall(text))
    odd = sum(marks.values()) - sum(marks[c] for c in ".,;:!?'\"-()")
    pairs = len(set(zip(words, words[1:])))
    return [
        math.log1p(len(words)), math.log1p(max(n_chars, 0.0)), sum(map(len, words)) / n / 5, len(counted) / n,
        max(counted.values(), default=0) / n, sum(map(str.isupper, words)) / n,
        sum(w[:1].isupper() for w in words) / n, len(DIGIT.findall(text)) * 10 / size, sum(marks.values()) * 10 / size, odd * 10 / size,
        sum(not w[-1].isalnum() for w in words) / n, marks["|"] * 50 / size, len(words) / (len(STOP.findall(text)) + 1) / 10,
        math.log1p(len(words) / (len(lines) or 1)), 1 - len(set(lines)) / (len(lines) or 1), 1 - pairs / max(1, len(words) - 1),
    ]


def features(text: str, n_chars: float | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Different buckets, their values, and the statistics of a text."""
    words = text.split()
    counted = Counter(words)
    dense = statistics(text, words, counted, float(len(text) if n_chars is None else n_chars))
    sums: dict[int, int] = {}
    for word, n in Counter(text.lower().split()).items():
        bucket = zlib.crc32(word.encode()) % BUCKETS
        sums[bucket] = sums.get(bucket, 0) + n
    at = np.fromiter(sums, dtype=np.int32, count=len(sums))
    value = np.log1p(np.fromiter(sums.values(), dtype=np.float32, count=len(sums)))
    return at, value / (np.sqrt((value ** 2).sum()) or 1), dense


@dataclass
class Machine:
    """Weights of a factorisation machine over hashed words, then statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def join(self, at: np.ndarray, value: np.ndarray, dense) -> tuple[np.ndarray, np.ndarray]:
        scaled = np.clip((np.asarray(dense, dtype=np.float64) - self.mean) / self.spread, -4, 4) / 4
        return np.r_[at, BUCKETS + np.arange(len(scaled))], np.r_[value, scaled.astype(np.float32)]

    def margin(self, at: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[at] * value[:, None]
        pairs = 0.5 * ((v.sum(axis=0) ** 2) - (v ** 2).sum(axis=0)).sum()
        return float(self.bias + self.linear[at] @ value + pairs)

    def score(self, text: str, n_chars: float | None) -> float:
        margin = self.margin(*self.join(*features(text, n_chars)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, list[float], int]], factors: int = FACTORS, epochs: int = EPOCHS,
        rate: float = RATE, ridge: float = RIDGE, seed: int = 5) -> Machine:
    """Adagrad on log loss; both classes weigh the same.  Rows come in a fixed order."""
    width = BUCKETS + len(STATISTICS)
    random = np.random.default_rng(seed)
    dense = np.array([r[2] for r in rows], dtype=np.float64).reshape(len(rows), len(STATISTICS))
    y = np.array([r[3] for r in rows], dtype=np.float64)
    mean = dense.mean(axis=0) if len(rows) else np.zeros(len(STATISTICS))
    std = dense.std(axis=0) if len(rows) else np.ones(len(STATISTICS))
    machine = Machine(0.0, np.zeros(width), random.normal(0, 0.05, (width, factors)), mean, np.where(std > 1e-9, std, 1.0))
    if not len(rows) or y.min() == y.max():
        machine.bias = 0.0 if not len(rows) else (4.0 if y[0] else -4.0)
        machine.factors[:] = 0
        return machine
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    joined = [machine.join(*r[:3]) for r in rows]
    sum_linear, sum_factors, sum_bias = np.full(width, 1e-6), np.full((width, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            part = order[start:start + BATCH]
            at = np.concatenate([joined[i][0] for i in part])
            x = np.concatenate([joined[i][1] for i in part])
            sizes = [len(joined[i][0]) for i in part]
            row = np.repeat(np.arange(len(part)), sizes)
            first = np.r_[0, np.cumsum(sizes)[:-1]]
            v = machine.factors[at] * x[:, None]
            total = np.add.reduceat(v, first, axis=0)
            pairs = 0.5 * ((total ** 2).sum(axis=1) - np.add.reduceat((v ** 2).sum(axis=1), first))
            margin = machine.bias + np.add.reduceat(machine.linear[at] * x, first) + pairs
            slope = weight[part] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]) / len(part)
            used, back = np.unique(at, return_inverse=True)
            pull = slope[row] * x
            grad = np.bincount(back, weights=pull, minlength=len(used)) + ridge * machine.linear[used]
            sum_linear[used] += grad ** 2
            machine.linear[used] -= rate * grad / np.sqrt(sum_linear[used])
            each = pull[:, None] * (total[row] - v)
            grad_v = np.stack([np.bincount(back, weights=each[:, f], minlength=len(used)) for f in range(factors)], axis=1)
            grad_v += ridge * machine.factors[used]
            sum_factors[used] += grad_v ** 2
            machine.factors[used] -= 0.5 * rate * grad_v / np.sqrt(sum_factors[used])
            sum_bias += slope.sum() ** 2
            machine.bias -= rate * slope.sum() / math.sqrt(sum_bias)
    return machine


def _inputs(docs: DataFrame) -> list[Column]:
    """Text and character count; a table without that column, or a null, counts the text's own."""
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return [F.col("text").cast("string").alias("text"), chars.alias("n_chars")]


def learn(docs: DataFrame, labels: DataFrame, label: str, wanted: Column, sample_rows: int = SAMPLE) -> Machine:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, c) for t, c in zip(strings(batch.column(0)), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.float32())),
                 pa.array([x[2] for x in found], pa.list_(pa.float64()))], names=["label", "at", "value", "dense"])

    texts = spread(docs.select(F.col("doc_id"), *_inputs(docs)))
    sample = labelled(texts, labels, label, wanted, sample_rows).select("text", "n_chars", F.col("_label").cast("int").alias("label"))
    found = map_texts(sample, run, "label int, at array<int>, value array<float>, dense array<double>").toArrow()
    rows = [(np.asarray(a.values, dtype=np.int32), np.asarray(v.values, dtype=np.float32), d, y) for a, v, d, y in
            zip(found["at"], found["value"], found["dense"].to_pylist(), found["label"].to_pylist())]
    # A fixed order of rows makes reruns agree.
    rows.sort(key=lambda r: (r[3], r[2], r[0].tobytes()))
    return fit(rows)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row of ``docs``.

    A null text counts as empty; an empty text is scored by its statistics alone.
    Repeated rows score alike.  Only ``doc_id``, ``text`` and ``n_chars`` are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [machine.score(t, c) for t, c in zip(strings(batch.column(1)), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.float64())], names=["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(docs))
    return map_texts(spread(plain), run, "doc_id long, score double")


@query("op8_quality")
def op8_quality(spark, sf_dir):
    """Probability of good quality of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = learn(docs, labels, "quality", learnable(F.col("doc_id"), 3, 1))
    return score(docs, machine).select("doc_id", (~learnable(F.col("doc_id"), 3, 1)).alias("held_out"), "score",
                                       (F.col("score") >= 0.5).cast("int").alias("predicted"))
