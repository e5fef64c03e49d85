"""Toxic passages by maximal scoring segments of token log-odds.

Model.  Counts of the toxic and other labelled documents that use a token give each token a
log-odds with an informative Dirichlet prior (the prior's shape is the token's
share of all counts), and a z-score from its variance.  The beginnings of longer
tokens are counted like tokens, so that a stem speaks for endings not yet seen.
Tokens that pass ``LEAST_Z`` score their log-odds less ``SHIFT`` (a passage must be more
than the language or topic that toxic texts lean to), others what their longest
beginning that passes does; every other token costs ``REST``.  The n-th time a stretch
uses a toxic token it scores an n-th, so that no text is toxic by repetition.  A new
stretch begins where the sum of scores has fallen back to where the stretch began:
repeats alone gain nothing by that, and a passage scores the same however much text
comes before it.

Passages.  One linear scan (Ruzzo and Tompa) finds all maximal scoring segments of
a document's token scores.

Calibration.  Scores of the best segments of random text follow an extreme-value
law: in n tokens, K n exp(-lambda S) segments of score S or more are expected.
lambda solves sum p exp(lambda s) = 1 over the scores of tokens of other documents,
K is fitted to the best segments of these documents.  A segment with an expected
number (E-value) below ``SIGNIFICANT`` is a toxic passage.  A document's evidence,
the sum of -ln E over its significant passages or that of its best segment if there
is none, becomes a probability by logistic regression on the labelled sample.

Learning takes at most ``SAMPLE`` labelled documents, chosen by hash of doc_id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import learnable, map_texts, spread, staged, strings, table
from costloom.llm.registry import query

SAMPLE = 20_000       # labelled documents to learn from, at most
PRIOR = 20_000.0      # weight of the Dirichlet prior, in tokens
SHIFT = 1.5
LEAST_Z = 3.0
REST = -0.3           # score of a token that tells nothing
SIGNIFICANT = 0.05
HELD = 200_000        # counts a task holds before it lets them go
STEMS = (5, 4)        # lengths of beginnings, longest first
TOKEN = re.compile(r"[^\W\d_]+")


def labelled(docs: DataFrame, labels: DataFrame, label: str, wanted: Column, most: int) -> DataFrame:
    """``text``, ``label`` (0 or 1) and the other columns asked for of at most ``most`` labelled documents.

    Which ones is decided by a hash of doc_id.  Null labels teach nothing; a doc_id
    with several labels counts as 1 if one of them is.  The chosen labels are bounded
    by ``most``, so they are sent to the texts and no text is shuffled.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(wanted)
    known = known.groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    chosen = known.orderBy(F.xxhash64("_labelled"), "_labelled").limit(most)
    return docs.join(F.broadcast(chosen), docs["doc_id"].cast("long") == F.col("_labelled")).drop("_labelled")


class Lookup(dict):
    """Scores of tokens, looked up by stem the first time."""

    def __init__(self, known: dict[str, float]):
        super().__init__(known)
        self.known = dict(known)

    def __missing__(self, token: str) -> float | None:
        found = next((self.known[s] for s in stems(token) if s in self.known), None)
        self[token] = found
        return found


def stems(token: str) -> list[str]:
    """A token's beginnings, longest first; the star tells them from tokens."""
    return [token[:n] + "*" for n in STEMS if len(token) > n]


@dataclass
class Model:
    scores: dict[str, float]
    rest: float
    decay: float = 1.0      # lambda
    scale: float = 1.0      # K
    weights: tuple[float, float] = (0.0, 1.0)

    def token_scores(self, tokens: list[str]) -> tuple[list[int], list[float]]:
        """Positions and scores of the tokens that the model knows, by themselves or by stem."""
        if not isinstance(self.scores, Lookup) or len(self.scores) > len(self.scores.known) + HELD:
            self.scores = Lookup(getattr(self.scores, "known", self.scores))
        scores = self.scores
        found = [scores[t] for t in tokens]
        at = [i for i, s in enumerate(found) if s is not None]
        uses: dict[str, int] = {}
        out, last, total = [], -1, 0.0
        for i in at:
            score = found[i]
            total += self.rest * (i - last - 1) + min(score, 0.0)
            last = i
            if score > 0:
                if total <= 0:
                    uses, total = {}, 0.0
                uses[tokens[i]] = n = uses.get(tokens[i], 0) + 1
                score /= n
                total += score
            out.append(score)
        return at, out

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and (first token, one past the last, score) of every maximal segment."""
        tokens = TOKEN.findall(text.lower())
        at, scores = self.token_scores(tokens)
        return len(tokens), maximal_segments(at, scores, self.rest)

    def minus_log_e(self, score: float, n: int) -> float:
        return self.decay * score - math.log(self.scale * max(n, 1))

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        if not segments:
            return -math.log(self.scale * max(n, 1)) if n else 0.0
        values = [self.minus_log_e(s, n) for _, _, s in segments]
        sure = [v for v in values if v > -math.log(SIGNIFICANT)]
        return sum(sure) if sure else max(values)

    def probability(self, evidence: float) -> float:
        a, b = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * squeeze(evidence)))))


def squeeze(evidence: float) -> float:
    """Sign-keeping square root, which keeps a very toxic text from swamping the fit."""
    return math.copysign(math.sqrt(abs(evidence)), evidence)


def maximal_segments(at: list[int], scores: list[float], rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, one past the last, score), in linear time.

    ``at`` are positions with a score of their own; every position between costs
    ``rest``.  Each candidate keeps the sums before it and through it; a new one
    joins all candidates back to the nearest whose sum before is lower, unless that
    one's sum through is already at least the new one's.
    """
    found: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum through
    lower: list[int] = []  # per candidate the nearest earlier one with a lower sum before, or -1
    total, last = 0.0, -1
    for position, score in zip(at, scores):
        total += rest * (position - last - 1)
        last = position
        if score <= 0:
            total += score
            continue
        first, before = position, total
        total += score
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = lower[j]
            if j < 0 or found[j][3] >= total:
                break
            first, before = found[j][0], found[j][2]
            del found[j:], lower[j:]
            j -= 1
        found.append((first, position + 1, before, total))
        lower.append(j)
    return [(a, b, through - before) for a, b, before, through in found]


# Learning

def count_tokens(sample: DataFrame) -> DataFrame:
    """``token``, ``toxic`` and ``other``: texts of each class that use it.

    A text counts once, so a word that one text repeats a hundred times proves no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out():
            for c in counts:
                for token, n in list(c.items()):
                    for stem in stems(token):
                        c[stem] += n
            tokens = list({**counts[0], **counts[1]})
            columns = [pa.array(tokens, pa.string()), pa.array([counts[1][t] for t in tokens], pa.int64()), pa.array([counts[0][t] for t in tokens], pa.int64())]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["token", "toxic", "other"])

        for batch in batches:
            for text, label in zip(strings(batch.column(0)), batch.column(1).to_pylist()):
                counts[1 if label else 0].update(set(TOKEN.findall(text.lower())))
            if len(counts[0]) + len(counts[1]) > HELD:
                yield out()
        yield out()

    found = map_texts(sample.select("text", "_label"), run, "token string, toxic long, other long")
    return found.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn(docs: DataFrame, labels: DataFrame, label: str, wanted: Column, sample_rows: int = SAMPLE,
          prior: float = PRIOR, least_z: float = LEAST_Z, shift: float = SHIFT,
          rest: float = REST) -> Model:
    texts = spread(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")))
    sample = staged(labelled(texts, labels, label, wanted, sample_rows).select("text", "_label"))
    counts = staged(count_tokens(sample))
    toxic, other = counts.filter(~F.col("token").endswith("*")).agg(F.sum("toxic"), F.sum("other")).first()
    toxic, other = float(toxic or 0), float(other or 0)
    if not toxic or not other:
        return Model({}, rest, weights=(-5.0, 0.0))
    alpha = prior * (F.col("toxic") + F.col("other")) / (toxic + other)
    log_odds = (F.log((F.col("toxic") + alpha) / (toxic + prior - F.col("toxic") - alpha))
                - F.log((F.col("other") + alpha) / (other + prior - F.col("other") - alpha)))
    spread_ = F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("other") + alpha))
    telling = counts.withColumn("log_odds", log_odds).withColumn("z", F.col("log_odds") / spread_).filter(F.abs("z") >= least_z)
    kept = telling.orderBy(F.desc(F.abs("z")), "token").collect()  # tokens of the sample, so its size bounds them
    model = Model({r.token: r.log_odds - shift for r in kept}, rest)
    shares = counts.filter(~F.col("token").endswith("*") & (F.col("other") > 0))
    model.decay = decay_of(score_shares(shares, model, other), rest)
    rows = evidence_of(sample, model)
    # K from the best segments of documents that aren't toxic, lambda being known.
    calm = rows[rows[:, 0] == 0]
    model.scale = max(1e-6, len(calm) / max(1e-9, float((calm[:, 1] * np.exp(-model.decay * calm[:, 2])).sum())))
    rows = evidence_of(sample, model)
    model.weights = logistic(np.array([squeeze(x) for x in rows[:, 3]]), rows[:, 0])
    return model


def score_shares(counts: DataFrame, model: Model, total: float) -> list[tuple[float, float]]:
    """Scores of the model and their shares of the tokens of documents that aren't toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            tokens, other = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, scores = model.token_scores(tokens)
            for i, s in zip(at, scores):
                sums[s] += other[i]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.float64()), pa.array(list(sums.values()), pa.int64())], names=["score", "n"])

    found = map_texts(counts.select("token", "other"), run, "score double, n long").groupBy("score").agg(F.sum("n").alias("n"))
    return [(r.score, r.n / total) for r in found.orderBy("score").collect()]


def decay_of(scores: list[tuple[float, float]], rest: float) -> float:
    """The positive lambda with sum p exp(lambda s) = 1, by halving; p sums to 1 with ``rest``."""
    share = 1 - sum(p for _, p in scores)

    def excess(x):
        return share * math.exp(x * rest) + sum(p * math.exp(min(700.0, x * s)) for s, p in scores) - 1

    low, high = 1e-6, 1e-6
    while excess(high) <= 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) <= 0 else (low, middle)
    return max(low, 1e-3)


def evidence_of(sample: DataFrame, model: Model) -> np.ndarray:
    """Label, tokens, best score and evidence of every sampled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in strings(batch.column(0)):
                n, segments = model.segments(text)
                rows.append((float(n), max((s for _, _, s in segments), default=0.0), model.evidence(n, segments)))
            n, best, evidence = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.float64()), *(pa.array(x, pa.float64()) for x in (n, best, evidence))],
                                             names=["label", "n", "best", "evidence"])

    found = map_texts(sample.select("text", "_label"), run, "label double, n double, best double, evidence double")
    return np.array([tuple(r) for r in found.collect()], dtype=np.float64).reshape(-1, 4)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope by Newton's method, lightly held to small values."""
    design = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + ridge * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


# Applying

PASSAGES = "array<struct<start:int,end:int,score:double,e_value:double>>"


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and toxic ``passages`` of every row of ``docs``.

    Passages are code-point offsets, end exclusive, with segment score and E-value.
    A null text counts as empty; a text without a token gets the score of no
    evidence.  Repeated rows score alike.  Only ``doc_id`` and ``text`` are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for batch in batches:
            scores, found = [], []
            for text in strings(batch.column(1)):
                n, segments = model.segments(text)
                scores.append(model.probability(model.evidence(n, segments)))
                sure = [(a, b, s, model.minus_log_e(s, n)) for a, b, s in segments]
                sure = [x for x in sure if x[3] > -math.log(SIGNIFICANT)]
                spans = token_spans(text) if sure else []
                found.append([{"start": spans[a][0], "end": spans[b - 1][1], "score": s, "e_value": math.exp(-min(e, 700.0))} for a, b, s, e in sure])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(found, kind)],
                                             names=["doc_id", "score", "passages"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(spread(plain), run, f"doc_id long, score double, passages {PASSAGES}")


def token_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every token in ``text`` itself, whose lower case may be longer."""
    lower = text.lower()
    spans = [m.span() for m in TOKEN.finditer(lower)]
    if len(lower) == len(text):
        return spans
    origin = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    return [(origin[a], origin[b - 1] + 1) for a, b in spans]


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    """Probability of toxicity of every document, and how many toxic passages it has."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels, "toxic", learnable(F.col("doc_id"), 4, 2))
    scored = passages(docs, model)
    return scored.select("doc_id", (~learnable(F.col("doc_id"), 4, 2)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"), "passages")
