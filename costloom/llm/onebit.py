"""Nearest neighbours through randomly rotated one-bit codes.

Every vector o is taken to length one and turned by a random matrix with
orthonormal columns into ``BITS`` numbers, whose signs are its code: the corner
b / sqrt(BITS), b in {-1, 1}, nearest to it.  Two scalars go with the code: the
length of o, and the inner product s of the turned vector with its corner.  A
query q, turned alike and rounded at random to ``PLANES`` bits a number, meets a
code as a few AND and bit counts, which give <corner, q>; <corner, q> / s
estimates <o, q> without bias, and the error is below
EPSILON * sqrt((1 - s^2) / s^2 / (BITS - 1)) but for a few in a million.

Search.  Queries and rows are dealt into blocks by a hash, and every block of
queries meets every block of rows in a task of its own.  There, the best rows by
estimate are scored on the original vectors; the score of the last of them bounds
the rest: every row whose estimate plus error reaches it is scored too.  Scores
are sums in double precision, in the order of the components.

Equal vectors are one row before the search, with the smallest of their ids, as
many as an answer can name, so that copies cost nothing however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costloom.llm.common import staged, table
from costloom.llm.registry import query

BITS = 256            # of a code; more than the vector has components, for a small error
PLANES = 4            # bits of a query's number
EPSILON = 4.0         # deviations of the estimate that the bound allows for
ROWS = 1 << 16        # vectors in a block of rows
QUERIES = 1 << 15     # vectors in a block of queries
SEED = 42
FIRST = 4             # times the answer's rows that are scored first, to bound the rest
CLOSE = 1e-12         # of the lengths' product, by which sums in another order may differ


# Codes

def rotation(dim: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """A ``bits`` x ``dim`` matrix with orthonormal columns."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((max(bits, dim), dim)))[0]


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths, safe against overflow and underflow of the squares."""
    largest = np.abs(vectors).max(axis=1)
    return largest * np.sqrt(((vectors / largest[:, None]) ** 2).sum(axis=1))


class Codes:
    """Codes and correction scalars of the rows of ``vectors`` (not zero, finite)."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        self.length = lengths(vectors)
        turned = (vectors / self.length[:, None]) @ turn.T
        self.width = width = turned.shape[1]
        bits = turned >= 0
        fit = np.abs(turned).sum(axis=1) / np.sqrt(width)
        # One array per 64 bits of the code, so that every step runs along all rows.
        self.words = np.ascontiguousarray(_packed(bits).T)
        self.ones = bits.sum(axis=1).astype(np.float64)
        # <o, q> is estimated with, and its error bounded by, one factor per row.
        self.scale = self.length / (fit * np.sqrt(width))
        self.error = (EPSILON * self.length / fit) ** 2 * np.maximum(1 - fit ** 2, 0) / max(width - 1, 1)
        self.rounding = (EPSILON * self.length / fit) ** 2

    def inside(self, planes: np.ndarray) -> np.ndarray:
        """Per row the sum of the query's numbers at the code's one bits."""
        out = np.zeros(self.words.shape[1], dtype=np.uint32)
        both, count = np.empty_like(self.words[0]), np.empty(len(out), dtype=np.uint8)
        for plane in planes[::-1]:
            out <<= 1
            for word, mask in zip(self.words, plane):
                np.bitwise_count(np.bitwise_and(word, mask, out=both), out=count)
                out += count
        return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1, bitorder="little").view("<u8")


class Query:
    """One query, turned and rounded, ready to meet codes."""

    def __init__(self, vector: np.ndarray, turn: np.ndarray, chance: np.ndarray):
        self.length = lengths(vector[None, :])[0]
        turned = turn @ (vector / self.length)
        self.width, self.least = len(turned), turned.min()
        self.step = max((turned.max() - self.least) / ((1 << PLANES) - 1), 1e-300)
        levels = np.floor((turned - self.least) / self.step + chance).clip(0, (1 << PLANES) - 1).astype(np.int64)
        self.total = levels.sum()
        self.planes = _packed((levels[None, :] >> np.arange(PLANES)[:, None] & 1).astype(bool))

    def estimates(self, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products with all rows of ``codes``, and their error bounds."""
        corner = 2 * self.step * codes.inside(self.planes) + 2 * self.least * codes.ones - (self.step * self.total + self.least * self.width)
        # Rounding adds a random error of its own, of at most half a step's worth on the average.
        return corner * (codes.scale * self.length), self.length * np.sqrt(codes.error + (self.step / 2) ** 2 * codes.rounding)


def inner(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products, summed component by component from the first to the last."""
    out = np.zeros(len(rows))
    for i in range(rows.shape[1]):
        out += rows[:, i] * vector[i]
    return out


def nearest(codes: Codes, vectors: np.ndarray, vector: np.ndarray, ids: np.ndarray, asked: Query, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the ``k`` nearest, best first, ties to smaller ``ids``."""
    hit = np.arange(len(vectors))
    if len(vectors) > FIRST * k:
        found, error = asked.estimates(codes)
        first = np.argpartition(-found, FIRST * k - 1)[:FIRST * k]
        least = np.partition(vectors[first] @ vector, -k)[-k]
        near = found + error >= least
        near[first] = True
        hit = np.flatnonzero(near)
    if len(hit) > k:  # the sums' order matters only among those that are near enough
        rough, error = vectors[hit] @ vector, CLOSE * asked.length * codes.length[hit]
        hit = hit[rough >= np.partition(rough, -k)[-k] - 2 * error.max()]
    scores = inner(vectors[hit], vector)
    best = np.lexsort((ids[hit], -scores))[:k]
    return hit[best], scores[best]


# Blocks

def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``embedding`` (doubles) of the rows that take part."""
    x = F.col("embedding")
    plain = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding).cast("array<double>"), lambda v: v + F.lit(0.0)).alias("embedding"))  # -0.0 becomes 0.0
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return plain.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(x, lambda v: v != 0))


def once(rows: DataFrame, most: int) -> DataFrame:
    """One row per different vector: ``first`` (smallest id), ``code`` (hash) and its ``most`` smallest ``ids``.

    The limit on the rank cuts every task's rows before they are shuffled, so that
    copies, however many, send ``most`` rows a task.
    """
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.distinct().withColumn("place", F.row_number().over(by_vector)).filter(F.col("place") <= most)
    found = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return found.select("embedding", F.col("ids")[0].alias("first"), F.xxhash64("embedding").alias("code"), "ids")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _search(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"first": [], "code": [], "score": [], "ids": []}
        if queries.num_rows and rows.num_rows:
            vectors, asked = _matrix(rows["embedding"]), _matrix(queries["embedding"])
            turn = rotation(vectors.shape[1])
            codes = Codes(vectors, turn)
            chance = np.random.default_rng(SEED + 1).random(len(turn))
            smallest, names = rows["first"].to_numpy(), rows["ids"].to_pylist()
            for first, code, vector in zip(queries["first"].to_pylist(), queries["code"].to_pylist(), asked):
                at, scores = nearest(codes, vectors, vector, smallest, Query(vector, turn, chance), k)
                for i, score in zip(at.tolist(), scores.tolist()):
                    out["first"].append(first)
                    out["code"].append(code)
                    out["score"].append(score)
                    out["ids"].append(names[i])
        return pa.table(out, schema=pa.schema([("first", pa.int64()), ("code", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))]))

    return run


def nearest_neighbours(vectors: DataFrame, asked: DataFrame, k: int = 20) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the ``k`` rows of ``vectors`` nearest to each row of ``asked``.

    Both have ``vec_id`` and ``embedding`` (any numbers); nearness is the largest
    inner product, ties go to the smaller ``vec_id``, and a query never finds its own
    ``vec_id``.  All rows found are given if there are fewer than ``k``.  Rows without
    a vec_id take no part, nor do vectors that are null, empty, zero or hold a null or
    a non-finite number.  Only vectors of a query's number of components are its
    candidates.  Rows equal in both columns are one row; one vec_id with several
    vectors is as many queries and candidates.  Other columns are not read.  Empty
    tables give no rows.
    """
    spark = vectors.sparkSession
    candidates = staged(once(usable(vectors), k + 1))
    wanted = staged(usable(asked).distinct().withColumn("code", F.xxhash64("embedding")))
    different = staged(wanted.groupBy("embedding", "code").agg(F.min("vec_id").alias("first")))
    row_blocks = max(spark.sparkContext.defaultParallelism, -(-candidates.count() // ROWS))
    query_blocks = max(1, -(-different.count() // QUERIES))

    def dealt(df, own, blocks, others):
        """Each row once for every block of the other side."""
        block = F.pmod(F.xxhash64("code", "first"), F.lit(blocks)).cast("int").alias(own)
        other = "query_block" if own == "row_block" else "row_block"
        copies = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        return df.withColumn("dim", F.size("embedding")).select("*", block).select("*", copies)

    left = dealt(different, "query_block", query_blocks, row_blocks).groupBy("dim", "query_block", "row_block")
    right = dealt(candidates, "row_block", row_blocks, query_blocks).groupBy("dim", "query_block", "row_block")
    found = staged(left.cogroup(right).applyInArrow(_search(k + 1), "first long, code long, score double, ids array<long>"))
    # The nearest ids of every different query vector, its own among them.
    by_query = Window.partitionBy("first", "code").orderBy(F.desc("score"), "vec_id")
    named = found.select("first", "code", "score", F.explode("ids").alias("vec_id"))
    best = named.withColumn("place", F.row_number().over(by_query)).filter(F.col("place") <= k + 1)
    lists = staged(best.groupBy("first", "code").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near")))
    owners = different.select("embedding", "first", "code").withColumnRenamed("code", "same")
    queries = wanted.join(owners, [wanted["embedding"].eqNullSafe(owners["embedding"]), wanted["code"] == owners["same"]])
    own = queries.select(F.col("vec_id").alias("query_id"), "first", "code").join(lists, ["first", "code"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = own.select("query_id", F.posexplode(others).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


@query("op13_nearest_neighbours", """
WITH rows AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
              WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
                AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
     pairs AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.x, r.x) AS score
               FROM rows q JOIN rows r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id AND len(q.x) = len(r.x)),
     ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""")
def op13_nearest_neighbours(spark, sf_dir):
    """The 20 nearest vectors of every twentieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
