"""Prefix trie of conversations in minimal-perfect-hash node tables.

A prefix of d turns has a digest: the sums of four 32-bit numbers hashed from every
turn and its place.  Sums run along a conversation like any running total, so even
one conversation with most of the turns is cut among tasks.  A node is a digest.

Shards.  The turns are dealt by conversation (long ones in segments) and every
shard of bounded size enumerates its different digests, gives each a slot by a
minimal perfect hash, checks that the slot holds that digest, scatters its counts
into flat arrays and adds them up from the deepest turns to the first ones through
the array of parent slots.  What the shards find for a node is added up by digest.

Two passes.  The first gives every node its members: their number, the smallest
conv_id (the node's owner) and the longest length, by which leaves are known.  The
second scatters what nodes hold themselves, once each, at the turns of their
owners: an owner is a member of all nodes above, so the sums over the members of a
node are those of its subtree.  A segment's last turn takes what the later
segments of its conversation have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.llm.common import staged, table
from costloom.llm.registry import query
from costloom.operators.keyed import join_on_key
from costloom.operators.ordered import OrderedGroups, RunningSum

LANES = 4
SEGMENT = 1 << 12     # turns of a conversation that stay together
SHARD = 1 << 17       # turns whose nodes share one table
LISTED = 1 << 14      # conv_ids in one row on the way to a node's hash
HEADS = 5             # most turns taken over from another conversation
ROOT = [0, 0]
SALTS = 8


# Minimal perfect hash

def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """One pseudo-random 64-bit number per row of two."""
    x = keys[:, 0] ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    for word in (keys[:, 1], np.uint64(seed)):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) + word
    return x ^ (x >> np.uint64(31))


class NodeTable:
    """A slot from 0 to n - 1 for each of n different digests (rows of two 64-bit words).

    Level by level, digests that meet no other in a bit array take its bits, the
    rest goes on to the next one; a slot is the number of bits set before.
    """

    def __init__(self, digests: np.ndarray):
        self.levels, rest, taken = [], np.unique(digests, axis=0), 0
        self.digests = np.zeros_like(rest)
        while len(rest):
            size = max(64, 2 * len(rest))
            at = (_mixed(rest, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, taken + np.cumsum(alone) - alone))
            here = alone[at]
            self.digests[self.levels[-1][1][at[here]]] = rest[here]
            taken += int(here.sum())
            rest = rest[~here]

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest; every one is compared with what its slot holds."""
        out, left = np.full(len(digests), -1, dtype=np.int64), np.arange(len(digests))
        for seed, (alone, before) in enumerate(self.levels):
            at = (_mixed(digests[left], seed) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        if len(left) or (self.digests[out] != digests).any():
            raise ValueError("a digest is not in the node table")
        return out


def accumulate(nodes: NodeTable, slot: np.ndarray, parent: np.ndarray, depth: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Each array of ``values`` (one number per slot) summed over the subtrees.

    ``slot``, ``parent`` (slot) and ``depth`` describe turns; depths are taken from the
    deepest to the first.  Nothing goes up from a segment's first depth to the segment
    above: what is below it is handed over at the last turn of that one.
    """
    parents, depths = np.full(len(nodes.digests), -1, dtype=np.int64), np.zeros(len(nodes.digests), dtype=np.int64)
    parents[slot], depths[slot] = np.where((depth > 1) & ((depth - 1) % SEGMENT == 0), -1, parent), depth
    order = np.argsort(-depths, kind="stable")
    cuts = np.flatnonzero(np.diff(depths[order])) + 1
    for level in np.split(order, cuts):
        level = level[parents[level] >= 0]
        for v in values:
            np.add.at(v, parents[level], v[level])
    return values


# Rebuilt conversations

def positions(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``turn_hash`` and ``n`` (code points) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), F.length(text).cast("long").alias("n"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_hash")).filter("conv_id IS NOT NULL")
    in_order = OrderedGroups(turns, ["conv_id"], ["_turn", "turn_hash"])
    return in_order.with_columns(pos=RunningSum(F.lit(1).cast("long"))).drop("_turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, and ``conv_id``, ``length`` of each of these."""
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (HEADS + 1)).cast("int")
    convs = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    first = turns.filter((F.col("conv_id") % 100 == 0) & (F.col("pos") <= HEADS))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_hash", "n"))).alias("head"))
    taken = F.when(F.col("h") > 0, F.slice("head", 1, F.greatest("h", F.lit(1))))
    convs = convs.join(heads, "base", "left").withColumn("head", F.coalesce(taken, F.expr("array()").cast("array<struct<pos:long,turn_hash:string,n:long>>")))
    convs = staged(convs.withColumn("taken", F.size("head").cast("long")))
    length = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = convs.withColumn("length", length)
    own = turns.join(convs.select("conv_id", "h", "taken", "length"), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "turn_hash", "n", "length")
    head = convs.select("conv_id", "length", F.explode("head").alias("x")).select("conv_id", F.col("x.pos").alias("depth"), "x.turn_hash", "x.n", "length")
    return own.unionByName(head), convs.select("conv_id", "length")


def digests(turns: DataFrame, salt: int) -> DataFrame:
    """``turns`` with ``key`` and ``parent``: digests of the prefix with and without the turn."""
    hashed = F.md5(F.concat_ws("|", "turn_hash", F.col("depth").cast("string"), F.lit(str(salt))))
    lanes = {f"x{i}": F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(LANES)}
    along = OrderedGroups(turns.withColumns(lanes), ["conv_id"], ["depth"])
    sums = along.with_columns(**{f"s{i}": RunningSum(F.col(f"x{i}")) for i in range(LANES)})

    def packed(lane):
        words = [lane(i).bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(LANES)]
        return F.array(*[F.shiftleft(words[i], 32).bitwiseOR(words[i + 1]) for i in range(0, LANES, 2)])

    return sums.select("conv_id", "depth", "turn_hash", "n", "length", packed(lambda i: F.col(f"s{i}")).alias("key"),
                       packed(lambda i: F.col(f"s{i}") - F.col(f"x{i}")).alias("parent"))


# Shards

def _words(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 2)


def _pairs(words: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, 2 * len(words) + 1, 2, dtype=np.int32), pa.array(np.ascontiguousarray(words).view(np.int64).ravel()))


def _by_shard(work):
    """Hands ``work`` whole segments, about ``SHARD`` turns at a time; rows come sorted by segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while len(batch):
                if rows < SHARD:
                    part, batch = batch.slice(0, SHARD - rows), batch.slice(SHARD - rows)
                else:  # the shard is full: it ends where a segment does
                    last = [held[-1].column(name)[-1].as_py() for name in ("conv_id", "segment")]
                    same = (batch.column("conv_id").to_numpy() == last[0]) & (batch.column("segment").to_numpy() == last[1])
                    n = len(batch) if same.all() else int(np.argmin(same))
                    part, batch = batch.slice(0, n), batch.slice(n)
                    if len(batch):
                        yield work(pa.Table.from_batches([*held, part]).combine_chunks())
                        held, rows, part = [], 0, None
                if part is not None and len(part):
                    held.append(part)
                    rows += len(part)
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def _table_of(rows: pa.Table):
    """The shard's node table with slots, parents' slots and depths of its turns, and where a segment's last turn is."""
    key, parent, depth = (_words(rows["key"].chunk(0)), _words(rows["parent"].chunk(0)), rows["depth"].to_numpy())
    conv, segment = rows["conv_id"].to_numpy(), rows["segment"].to_numpy()
    follows = np.r_[False, (conv[1:] == conv[:-1]) & (segment[1:] == segment[:-1])]
    nodes = NodeTable(np.concatenate([key, parent[~follows]]))
    slot = nodes.slots(key)
    last = np.r_[~follows[1:], True]
    return nodes, slot, nodes.slots(parent), depth, last


def members_of_shard(rows: pa.Table) -> pa.RecordBatch:
    """Per node of the shard: members, smallest member, longest length, and what tells digests apart."""
    nodes, slot, above, depth, last = _table_of(rows)
    n = len(nodes.digests)
    count = np.zeros(n, dtype=np.int64)
    np.add.at(count, slot[last], 1)
    accumulate(nodes, slot, above, depth, [count])
    owner, longest = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
    np.minimum.at(owner, slot, rows["conv_id"].to_numpy())
    np.maximum.at(longest, slot, rows["length"].to_numpy())
    at = np.zeros(n, dtype=np.int64)
    at[slot] = np.arange(len(slot))
    real = np.unique(slot)
    of = at[real]
    return pa.RecordBatch.from_arrays(
        [_pairs(nodes.digests[real]), *(pa.array(x[real]) for x in (count, owner, longest)), *(rows[c].combine_chunks().take(pa.array(of)) for c in ("depth", "n", "turn_hash", "parent"))],
        names=["key", "n_convs", "conv_id", "longest", "depth", "n", "turn_hash", "parent"])


def sums_of_shard(rows: pa.Table) -> pa.RecordBatch:
    """Per node of the shard: leaves and saved code points below it, and its children."""
    nodes, slot, above, depth, last = _table_of(rows)
    leaves, saved, children = (np.zeros(len(nodes.digests), dtype=np.int64) for _ in range(3))
    np.add.at(leaves, slot, rows["leaf"].to_numpy())
    np.add.at(saved, slot, rows["saved"].to_numpy())
    np.add.at(children, above, rows["owned"].to_numpy())
    np.add.at(leaves, slot[last], rows["later_leaves"].to_numpy()[last])
    np.add.at(saved, slot[last], rows["later_saved"].to_numpy()[last])
    accumulate(nodes, slot, above, depth, [leaves, saved])
    return pa.RecordBatch.from_arrays([_pairs(nodes.digests), *map(pa.array, (leaves, saved, children))], names=["key", "n_leaves", "saved_tokens", "n_children"])


def _dealt(turns: DataFrame, shards: int) -> DataFrame:
    segment = turns.withColumn("segment", F.floor((F.col("depth") - 1) / SEGMENT).cast("long"))
    return segment.repartition(shards, "conv_id", "segment").sortWithinPartitions("conv_id", "segment", "depth")


# Hash of the members that end at a node

def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conv_ids of a node, up to ``LISTED`` in a row as text."""
    key, ids = None, []

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.list_(pa.int64())), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "first", "listed"])

    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (k != key or len(ids) == LISTED):
                yield row()
                ids = []
            key = k
            ids.append(i)
    if ids:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a node's lists in order; they stream through, one at a time."""
    key, sha = None, None

    def out(keys, hashes):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int64())), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])

    for batch in batches:
        keys, hashes = [], []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                if sha is not None:
                    keys.append(key)
                    hashes.append(sha.hexdigest())
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.encode())
        if keys:
            yield out(keys, hashes)
    if sha is not None:
        yield out([key], [sha.hexdigest()])


def ends(last: DataFrame) -> DataFrame:
    """``key`` and ``ends_sha256`` from ``key``, ``conv_id`` of every conversation's last node.

    Ranges of (node, conv_id) cut even a node with most of the conversations into
    lists made by many tasks; one task per node only reads the finished lists.
    """
    tasks = max(last.sparkSession.sparkContext.defaultParallelism, -(-last.count() // (1 << 20)))
    in_order = last.select("key", "conv_id").repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    lists = in_order.mapInArrow(_listed, "key array<long>, first long, listed string")
    return lists.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key array<long>, ends_sha256 string")


# Trie

def _members(turns: DataFrame, salt: int) -> tuple[DataFrame, DataFrame, bool]:
    """Digested turns, nodes with their members, and whether two prefixes share a digest."""
    keyed = staged(digests(turns, salt))
    shards = max(keyed.sparkSession.sparkContext.defaultParallelism, -(-keyed.count() // SHARD))
    schema = "key array<long>, n_convs long, conv_id long, longest long, depth long, n long, turn_hash string, parent array<long>"
    found = _dealt(keyed, shards).mapInArrow(_by_shard(members_of_shard), schema)
    same = F.struct("depth", "turn_hash", "parent")
    nodes = staged(found.groupBy("key").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("longest").alias("longest"), F.min("n").alias("n"),
        F.min(same).alias("is"), F.max(same).alias("was")).select("key", "n_convs", "conv_id", "longest", "n", "is.depth", "is.parent", F.expr("is != was").alias("clash")))
    root = F.array(*[F.lit(x).cast("long") for x in ROOT])
    return keyed, nodes.drop("clash"), bool(nodes.filter((F.col("key") == root) | F.col("clash")).limit(1).count())


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of rebuilt ``conversations`` (conv_id, turn, role, text).

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``; the module's head
    and the query's contract say what they are.  Turns go by ``turn``, null first,
    those with the same number by a hash of role and text; repeated rows are repeated
    turns.  A null role or text is empty.  Rows without a conv_id belong to no
    conversation and are left out.  A table without conversations has no node, not
    even a root.  Other columns are not read.
    """
    turns, convs = rebuilt(staged(positions(conversations)))
    turns, convs = staged(turns), staged(convs)
    for salt in range(SALTS):
        keyed, nodes, clash = _members(turns, salt)
        if not clash:
            break
    else:
        raise RuntimeError("digests of prefixes collide for every salt")
    root_key = F.array(*[F.lit(x).cast("long") for x in ROOT])
    # What a node holds itself stands at its owner's turn.
    held = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("n")).alias("saved"),
                        (F.col("longest") == F.col("depth")).cast("long").alias("leaf"), F.lit(1).cast("long").alias("owned"))
    placed = keyed.select("conv_id", "depth", "key", "parent").join(held, ["conv_id", "depth"], "left")
    placed = placed.fillna(0, ["saved", "leaf", "owned"]).withColumn("segment", F.floor((F.col("depth") - 1) / SEGMENT).cast("long"))
    placed = staged(placed)
    after = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(1, Window.unboundedFollowing)
    long = placed.join(convs.filter(F.col("length") > SEGMENT).select("conv_id"), "conv_id", "left_semi")
    carried = long.groupBy("conv_id", "segment").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).select(
        "conv_id", "segment", F.sum("leaf").over(after).alias("later_leaves"), F.sum("saved").over(after).alias("later_saved"))
    placed = placed.join(staged(carried), ["conv_id", "segment"], "left").fillna(0, ["later_leaves", "later_saved"])
    shards = max(keyed.sparkSession.sparkContext.defaultParallelism, -(-keyed.count() // SHARD))
    below = _dealt(placed, shards).mapInArrow(_by_shard(sums_of_shard), "key array<long>, n_leaves long, saved_tokens long, n_children long")
    below = staged(below.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "n_children")]))

    at_end = keyed.filter("depth = length").select("key", "conv_id").unionByName(convs.filter("length = 0").select(root_key.alias("key"), "conv_id"))
    hashes = staged(ends(at_end))
    all_convs = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = all_convs.select(root_key.alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(None).cast("array<long>").alias("parent"))
    every = staged(nodes.select("key", "conv_id", "depth", "n_convs", "parent").unionByName(root))
    owners = every.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = join_on_key(every, owners, ["parent"], measure=every.select("parent"))
    whole = whole.join(below, "key", "left").join(hashes, "key", "left")
    no_child = (F.col("depth") == 0) & (F.coalesce("n_children", F.lit(0)) == 0)  # a root without turns is a leaf
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(no_child, F.lit(1)).otherwise(F.coalesce("n_leaves", F.lit(0))).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


@query("op11_prefix_trie", """
WITH RECURSIVE
crc(i, k, v) AS (
    SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
    UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS l FROM crc WHERE k = 8),
turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base,
           xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
                           lambda a, b: xor(a >> 8, l[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
pieces AS (
    SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
whole AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM pieces),
prefixes AS (
    SELECT conv_id, depth, length(text) AS n,
           list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM whole
    UNION ALL SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]) FROM convs),
lengths AS (SELECT conv_id, max(depth) AS length FROM prefixes GROUP BY conv_id),
nodes AS (
    SELECT key, max(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS n,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
    FROM prefixes JOIN lengths USING (conv_id) GROUP BY key),
children AS (SELECT list_slice(key, 1, depth - 1) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
marked AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (key)),
owned AS (
    SELECT p.conv_id, p.depth, p.key, coalesce(m.n * (m.n_convs - 1), 0) AS saved, CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END AS leaf
    FROM prefixes p LEFT JOIN marked m ON m.conv_id = p.conv_id AND m.depth = p.depth),
below AS (
    SELECT key, sum(saved) OVER w AS saved, sum(leaf) OVER w AS leaf FROM owned
    WINDOW w AS (PARTITION BY conv_id ORDER BY depth DESC)),
sums AS (SELECT key, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(leaf) AS BIGINT) AS n_leaves FROM below GROUP BY key)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM marked m JOIN sums USING (key) LEFT JOIN marked p ON m.depth > 0 AND p.key = list_slice(m.key, 1, m.depth - 1)""")
def op11_prefix_trie(spark, sf_dir):
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
