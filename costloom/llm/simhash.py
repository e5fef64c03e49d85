"""SimHash near-duplicates found through Golay-code keys.

Every text gets a 64-bit fingerprint: a bit is 1 if more than half of the XXH64
hashes of its word shingles have it.  Fingerprints that differ in at most three
bits are linked, and linked documents form classes.

Candidates.  A fingerprint is cut into segments of 22, 21 and 21 bits.  With three
errors in all, at least two segments have at most one error each (two segments
with two or more would need four).  The perfect binary Golay code of length 23
maps a segment to the index of its one codeword within distance 3.  A segment
with an even number of ones gives the indices of itself and of all segments one
bit away (at most six different ones), one with an odd number only its own: two
segments one bit apart differ in parity, so the even one's indices hold the odd
one's.  Every pair of segments therefore gives keys of two indices, and linked
fingerprints share one.  Members of a key are verified by counting bits.

Groups.  Equal fingerprints are one row before any key is made.  Of the members of
a key, only a spanning forest of the true links is kept, never all pairs.  Keys with
more than ``BLOCK`` fingerprints are looked for beforehand; their rows are dealt to
blocks, and every two blocks meet in a task of their own, so no task holds an
unbounded group.  The forest's components come from alternating star contraction.

The pipeline's stage also joins texts whose sets of five-word shingles are similar;
``_similar_classes`` says how.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costloom.llm.common import map_texts, spread, staged, table, utf8
from costloom.llm.registry import query
from costloom.operators.keyed import hot_list

MAX_BITS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code
BLOCK = 4096
PAIRWISE = 12
MEMBERS = 1024      # texts of a group that meet in a task, with as many of another block
SHARED = 65_536     # different texts by which a shingle counts as hot
LOOSE = 80          # of 256 bits 38 differ on the average at a similarity of 0.8; this is over five deviations more
SENT = 1_000_000    # texts whose places are sent to the scan; more are joined by shuffling
POSTINGS = 1 << 22  # places of shingles that are looked up at a time
SAMPLE = 4096       # texts in which common shingles are looked for
OFTEN = 8
COMMON = 200_000
LAST = (1 << 63) - 1


# Fingerprints

def shingles(words: list[bytes], n: int) -> list[bytes]:
    """Runs of ``n`` words, repeats included; fewer words are one run, none is none."""
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)))))


def majority(digests: np.ndarray) -> np.ndarray:
    """Bits set in over half of the digests (one per row, as bytes), as unsigned 64-bit words."""
    ones = np.zeros(digests.shape[1] * 8, dtype=np.int64)
    for at in range(0, len(digests), 32768):
        ones += np.unpackbits(digests[at:at + 32768], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(digests), bitorder="little").view("<u8")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z and ASCII white space only


def fingerprint(text: bytes, words_in_shingle: int = 3) -> int:
    """SimHash of a text given in UTF-8; zero if it has no word."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles(words_of(text), words_in_shingle)], dtype="<u8")
    return int(majority(hashes.view(np.uint8).reshape(-1, 8))[0])


def five_word_set(text: bytes) -> np.ndarray:
    """Digests of the different five-word shingles, a row of 32 bytes each."""
    digest = xxhash.xxh3_128_digest
    parts = b"".join(digest(f, seed) for f in set(shingles(words_of(text), 5)) for seed in (0, 1))
    return np.frombuffer(parts, dtype=np.uint8).reshape(-1, 32)


def hashes_of(digests: np.ndarray) -> np.ndarray:
    """The set as sorted 64-bit numbers."""
    return np.unique(np.ascontiguousarray(digests[:, :8]).view("<i8").ravel())


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all shingles: two sets of that similarity share one.

    At least ``similarity`` of a set is in the other one, so not all of the rest and
    one more can be missing.  Any order will do that is the same for all sets; here
    ``common`` ones come last, those with the largest ``counts`` at the end.
    """
    wanted = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    if not len(common):
        return hashes[:wanted]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    rank = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.argsort(rank, kind="stable")[:wanted]]


MARKS = ["s0", "s1", "s2", "s3"]


def _plain(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))


def fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp`` (the 64 bits as a signed long) of every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words_in_shingle) for t in utf8(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return map_texts(spread(_plain(docs)), run, "doc_id long, text_hash long, fp long")


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Five-word shingles that ``OFTEN`` texts of a sample have, by number, and their counts.

    They only order ``prefix``, so what a sample misses costs time, no link.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes_of(five_word_set(t)) for t in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["h"])

    one_in = max(1, docs.count() // SAMPLE)
    texts = _plain(docs).filter(F.pmod("text_hash", F.lit(one_in)) == 0).dropDuplicates(["text_hash"])
    often = map_texts(texts.select("text"), run, "h long").groupBy("h").count().filter(F.col("count") >= OFTEN)
    rows = sorted((r.h, r["count"]) for r in often.orderBy(F.desc("count"), "h").limit(COMMON).collect())
    return np.array([h for h, _ in rows], dtype=np.int64), np.array([n for _, n in rows], dtype=np.int64)


def similar_prints(docs: DataFrame, similarity: float) -> DataFrame:
    """``fingerprints`` with ``set_id`` (the set of five-word shingles), its ``size``, its ``MARKS``
    (256 bits whose differing ones tell the similarity) and its ``prefix``."""
    common, counts = common_shingles(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, set_ids, sizes, marks, prefixes = [], [], [], [], []
            for text in utf8(batch.column(1)):
                digests = five_word_set(text)
                hashes = hashes_of(digests)
                fps.append(fingerprint(text))
                set_ids.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
                sizes.append(len(hashes))
                marks.append(majority(digests) if len(digests) else np.zeros(4, dtype="<u8"))
                prefixes.append(prefix(hashes, similarity, common, counts))
            fps, set_ids = (np.array(x, dtype=np.uint64).view(np.int64) for x in (fps, set_ids))
            marks = np.array(marks, dtype=np.uint64).reshape(-1, 4)
            columns = [batch.column(0), batch.column(2), pa.array(fps), pa.array(set_ids), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(marks[:, i]).view(np.int64)) for i in range(4))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "fp", "set_id", "size", *MARKS, "prefix"])

    schema = "doc_id long, text_hash long, fp long, set_id long, size long" + "".join(f", {c} long" for c in MARKS) + ", prefix array<long>"
    return map_texts(spread(_plain(docs)), run, schema)


# Golay code

def _remainder(x: int) -> int:
    for bit in range(22, 10, -1):
        if x >> bit & 1:
            x ^= GENERATOR << (bit - 11)
    return x


class Golay:
    """Decodes arrays of 23-bit words to the 12-bit index of the nearest codeword."""

    def __init__(self):
        by_byte = np.zeros((3, 256), dtype=np.uint16)
        for byte in range(3):
            for value in range(256 if byte < 2 else 128):
                by_byte[byte, value] = _remainder(value << (8 * byte))
        self.by_byte = by_byte
        self.error = np.zeros(2048, dtype=np.uint32)
        for weight in (1, 2, 3):
            for at in combinations(range(23), weight):
                e = sum(1 << i for i in at)
                self.error[_remainder(e)] = e

    def index(self, words: np.ndarray) -> np.ndarray:
        b = self.by_byte
        syndrome = b[0, words & 255] ^ b[1, words >> 8 & 255] ^ b[2, words >> 16]
        return ((words ^ self.error[syndrome]) >> 11).astype(np.int64)

    def near(self, words: np.ndarray, bits: int) -> np.ndarray:
        """Per word the different indices its segment gives, -1 where there are fewer."""
        flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
        out = self.index(words[:, None] ^ flips[None, :])
        odd = np.bitwise_count(words) % 2 == 1
        out[odd, 1:] = out[odd, :1]
        out.sort(axis=1)
        out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
        out = -np.sort(-out, axis=1)
        width = int((out >= 0).sum(axis=1).max(initial=1))
        return out[:, :width]


def keys_of(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Row number and key for every key of every fingerprint."""
    near = [golay.near((fps >> np.uint64(start) & np.uint64((1 << bits) - 1)).astype(np.uint32), bits)
            for start, bits in SEGMENTS]
    rows, keys = [], []
    for pair, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        a, b = near[i][:, :, None], near[j][:, None, :]
        key = (pair << 24) | (a << 12) | b
        at = np.nonzero((a >= 0) & (b >= 0))
        rows.append(at[0])
        keys.append(key[at])
    return np.concatenate(rows), np.concatenate(keys)


def golay_keys(nodes: DataFrame, prints: list[str], carried: list[str]) -> DataFrame:
    """``key``, ``id`` and ``carried``: about 30 rows per node for each of its fingerprints ``prints``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        golay = Golay()
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at:at + 2048]
                for number, name in enumerate(prints):
                    rows, keys = keys_of(part[name].to_numpy().view(np.uint64), golay)
                    yield pd.DataFrame({"key": keys | (number << 26), **{c: part[c].to_numpy()[rows] for c in ["id", *carried]}})

    columns = list(dict.fromkeys(["id", *prints, *carried]))
    schema = ", ".join(f"{c} long" for c in ["key", "id", *carried])
    return nodes.select(*columns).mapInPandas(run, schema)


# Links inside a key

def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signatures, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def forest(ids: np.ndarray, marks: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among signatures ``marks`` (one row each)."""
    out, rest = [], np.arange(len(ids))
    while len(rest):
        open_, rest = [rest[0]], rest[1:]
        while open_ and len(rest):
            x = open_.pop()
            hit = apart(marks[rest], marks[x]) <= limit
            if hit.any():
                new = rest[hit]
                out.append((np.full(len(new), ids[x]), ids[new]))
                open_.extend(new)
                rest = rest[~hit]
    return out


def _pairwise(keys: np.ndarray, ids: np.ndarray, marks: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for step in range(1, min(PAIRWISE, len(keys))):
        hit = keys[step:] == keys[:-step]
        if hit.any():
            at = np.flatnonzero(hit)
            at = at[apart(marks[at + step], marks[at]) <= limit]
            out.append((ids[at], ids[at + step]))
    return out


def _linked(keys: np.ndarray, ids: np.ndarray, marks: np.ndarray, limit: int) -> Iterator[pd.DataFrame]:
    """Links of whole keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    of = np.repeat(sizes, sizes)
    few = (of > 1) & (of <= PAIRWISE)
    found = _pairwise(keys[few], ids[few], marks[few], limit)
    for start, size in zip(starts[sizes > PAIRWISE].tolist(), sizes[sizes > PAIRWISE].tolist()):
        found += forest(ids[start:start + size], marks[start:start + size], limit)
    if found:
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        once = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pd.DataFrame({"a": once[:, 0], "b": once[:, 1]})


def _links_of_sorted(limit: int, carried: list[str]):
    """Reads (key, id, carried) sorted by key; a key may go on in the next batch.

    Without ``carried`` the id itself is the signature.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []

        def whole(parts):
            return _linked(*(np.concatenate(x) for x in zip(*parts)), limit)

        for batch in batches:
            if not len(batch):
                continue
            keys, ids = batch["key"].to_numpy(), batch["id"].to_numpy()
            marks = batch[carried or ["id"]].to_numpy(dtype=np.int64).view(np.uint64)
            if held and keys[-1] == held[0][0][0]:
                held.append((keys, ids, marks))
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from whole([*held, (keys[:cut], ids[:cut], marks[:cut])])
            held = [(keys[cut:], ids[cut:], marks[cut:])]
        if held:
            yield from whole(held)

    return run


def links(nodes: DataFrame, prints: list[str], carried: list[str], limit: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``: links that connect every two nodes a path of links connects.

    Nodes (``id``) meet if they share a key of a fingerprint in ``prints``; they are
    linked if their signatures differ in at most ``limit`` bits.
    """
    return links_by_key(golay_keys(nodes, prints, carried), carried, limit, block)


def links_by_key(keyed: DataFrame, carried: list[str], limit: int, block: int) -> DataFrame:
    """``a``, ``b``: the links among the rows (``key``, ``id``, ``carried``) of every key."""
    by_task = in_blocks(keyed, "key", hot_list(keyed.select("key"), block), block)
    by_task = by_task.select(F.xxhash64("key", "low", "high").alias("key"), "id", *carried)
    found = by_task.repartition("key").sortWithinPartitions("key", "id").mapInPandas(_links_of_sorted(limit, carried), "a long, b long")
    return staged(found.filter("a != b").distinct())


def in_blocks(rows: DataFrame, group: str, large: DataFrame | None, block: int) -> DataFrame:
    """``rows`` with ``low`` and ``high``: the two blocks of the task in which they are compared.

    ``large`` lists the groups of over ``block`` rows, with ``rows``.  Each of their rows
    belongs to one block, by ``id``, and goes to the tasks of all pairs with that block.
    """
    whole = {"low": F.lit(0), "high": F.lit(0)}
    if large is None:
        return rows.withColumns(whole)
    cut = rows.join(large.select(group, F.ceil(F.col("rows") / block).cast("int").alias("_blocks")), group)
    own = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    dealt = cut.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("_own", "_other"), "high": F.greatest("_own", "_other")})
    return rows.join(large, group, "left_anti").withColumns(whole).unionByName(dealt.drop("_blocks", "_own", "_other"))


# Similar sets

def shared_groups(prints: DataFrame, limit: int = SHARED) -> DataFrame:
    """``grp`` and ``id``: texts that meet, because their prefixes share a shingle.

    The texts of a shingle meet in the group of the smallest of them, so that the many
    shingles of one family make one group.  A shingle that ``limit`` texts have in their
    prefixes is a group itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of one task: copies bring their keys once
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1)
            new = []
            for i in ids.tolist():
                new.append(i not in seen)
                seen.add(i)
            keys, ids = keys.filter(pa.array(new)), ids[np.array(new, dtype=bool)]
            sizes = np.diff(keys.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([keys.flatten(), pa.array(np.repeat(ids, sizes))], names=["key", "id"])

    keyed = map_texts(prints.select("id", "prefix"), run, "key long, id long")
    hot = hot_list(keyed.select("key"), limit)
    rest = keyed if hot is None else keyed.join(hot, "key", "left_anti")
    by_key = Window.partitionBy("key")
    met = rest.select("id", F.min("id").over(by_key).alias("grp"), F.max("id").over(by_key).alias("_last")).filter("grp != _last")
    groups = met.select("grp", "id")
    if hot is not None:
        groups = groups.unionByName(keyed.join(hot.select("key"), "key").select(F.col("key").alias("grp"), "id"))
    return groups.distinct()


def _by_group(work, names: list[str], schema: pa.Schema):
    """Hands ``work`` the rows of one group after the other; rows come sorted by ``names``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(rows: pa.Table):
            keys = np.stack([rows[n].to_numpy() for n in names], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
                yield from work(keys[a].tolist(), rows.slice(a, b - a))

        def out(rows: pa.Table):
            return pa.RecordBatch.from_pylist(list(groups(rows)), schema=schema)

        for batch in batches:
            if not len(batch):
                continue
            last = [batch.column(n)[-1].as_py() for n in names]
            same = np.logical_and.reduce([batch.column(n).to_numpy() == x for n, x in zip(names, last)])
            cut = int(np.argmax(same)) if same.all() else len(same) - int(np.argmin(same[::-1]))
            if cut or held and [held[0].column(n)[0].as_py() for n in names] != last:
                done = [*held, batch.slice(0, cut)]
                yield out(pa.Table.from_batches([x for x in done if len(x)]).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield out(pa.Table.from_batches(held).combine_chunks())

    return run


TASK = ["grp", "low", "high"]


def candidates(groups: DataFrame, nodes: DataFrame, similarity: float, members: int = MEMBERS) -> DataFrame:
    """``grp``, ``low``, ``high``, ``part`` and ``id``: texts of a task that may be similar to others there.

    Two may be if their ``MARKS`` differ in at most ``LOOSE`` bits and their sets are
    about as large; a ``part`` is what such pairs connect.  Others stay away.
    """
    def work(key: list[int], rows: pa.Table) -> Iterator[dict]:
        ids, sizes = rows["id"].to_numpy(), rows["size"].to_numpy()
        marks = np.stack([rows[m].to_numpy() for m in MARKS], axis=1).view(np.uint64)
        rest, alone = np.arange(len(ids)), len(ids) < 2
        while len(rest) > 1 and not alone:
            part, open_, rest = [rest[0]], [rest[0]], rest[1:]
            while open_ and len(rest):
                x = open_.pop()
                near = (apart(marks[rest], marks[x]) <= LOOSE) & (np.minimum(sizes[rest], sizes[x]) >= similarity * np.maximum(sizes[rest], sizes[x]) - 1e-9)
                part += rest[near].tolist()
                open_ += rest[near].tolist()
                rest = rest[~near]
            if len(part) > 1:
                yield from ({**dict(zip(TASK, key)), "part": int(ids[part[0]]), "id": int(ids[i])} for i in part)

    large = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > members)
    dealt = in_blocks(groups, "grp", staged(large), members).join(nodes.select("id", "size", *MARKS), "id")
    in_order = dealt.repartition(*TASK).sortWithinPartitions(*TASK, "id")
    schema = pa.schema([(n, pa.int64() if n == "grp" else pa.int32()) for n in TASK] + [("part", pa.int64()), ("id", pa.int64())])
    return in_order.mapInArrow(_by_group(work, TASK, schema), "grp long, low int, high int, part long, id long")


def assigned(parts: DataFrame, members: int = MEMBERS) -> DataFrame:
    """``grp``, ``low``, ``high``, ``part`` and ``id``: where the sets of texts are compared.

    Parts of several groups that share texts are one family, where a text is once; only
    families of over ``members`` texts stay in the parts of their groups.
    """
    linked = parts.filter("part != id").select(F.col("part").alias("a"), F.col("id").alias("b")).distinct()
    roots = staged(components(linked))
    family = parts.select("id").distinct().join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("family"))
    family = staged(family)
    large = staged(family.groupBy("family").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > members).select("family"))
    small = family.join(large, "family", "left_anti").select(F.col("family").alias("grp"), F.lit(0).alias("low"), F.lit(0).alias("high"), F.col("family").alias("part"), "id")
    return small.unionByName(parts.join(family.join(large, "family", "left_semi"), "id", "left_semi"))


def similar_forest(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with a Jaccard similarity of at least ``similarity``.

    A set is compared with all that no tree has yet by looking its members up in an
    inverted list, so a family around one text costs little more than its tree.
    """
    sizes = np.array([len(x) for x in sets])
    if len(ids) < 2:
        return []
    if len(ids) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(ids[0], ids[1])] if both >= similarity * (sizes.sum() - both) - 1e-9 else []
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(inverse, kind="stable")]
    count = np.bincount(inverse)
    start, offset = np.cumsum(count) - count, np.r_[0, np.cumsum(sizes)]
    left, out = np.ones(len(sets), dtype=bool), []
    for root in range(len(sets)):
        open_ = [root] if left[root] else []
        left[root] = False
        while open_ and left.any():
            x = open_.pop()
            own = inverse[offset[x]:offset[x + 1]]
            both = np.zeros(len(sets), dtype=np.int64)
            steps = np.cumsum(count[own])
            for a in np.searchsorted(steps, np.arange(0, steps[-1] if len(steps) else 0, POSTINGS)).tolist():
                b = int(np.searchsorted(steps, (steps[a - 1] if a else 0) + POSTINGS, side="right"))
                some = own[a:max(b, a + 1)]
                n = count[some]
                at = np.repeat(start[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both += np.bincount(owner[at], minlength=len(sets))
            hit = np.flatnonzero(left & (both >= similarity * (sizes + sizes[x] - both) - 1e-9))
            out += [(ids[x], y) for y in ids[hit].tolist()]
            left[hit] = False
            open_ += hit.tolist()
    return out


def similar_links(docs: DataFrame, prints: DataFrame, tasks: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: links that connect all pairs of a task whose sets are similar enough.

    The sets are read again from one text of each; a text goes from its scan to the tasks
    as its set, and nothing else of it is shuffled while the list of ``SENT`` texts or
    fewer can be sent to the scan.
    """
    doc, names = F.coalesce("doc_id", F.lit(LAST)), [*TASK, "part"]
    place = prints.join(tasks.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min(F.struct(doc.alias("doc"), F.col("text_hash"))).alias("at"))
    wanted = staged(place.join(tasks, "id").select("at.*", *names, "id"))
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
    texts = _plain(docs).select(doc.alias("doc"), "text_hash", "text").join(wanted, ["doc", "text_hash"]).select(*names, "id", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes_of(five_word_set(t)) for t in utf8(batch.column(5))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found, pa.list_(pa.int64()))], names=[*names, "id", "shingles"])

    def work(key: list[int], rows: pa.Table) -> Iterator[dict]:
        ids, once = np.unique(rows["id"].to_numpy(), return_index=True)  # equal rows bring a text again
        shingles = rows["shingles"].combine_chunks()
        own = np.split(shingles.flatten().to_numpy(), np.cumsum(np.diff(shingles.offsets.to_numpy()))[:-1])
        yield from ({"a": int(a), "b": int(b)} for a, b in similar_forest(ids, [own[i] for i in once], similarity))

    sets = map_texts(texts, read, "grp long, low int, high int, part long, id long, shingles array<long>")
    in_order = sets.repartition(*names).sortWithinPartitions(*names, "id")
    return map_texts(in_order, _by_group(work, names, pa.schema([("a", pa.int64()), ("b", pa.int64())])), "a long, b long").distinct()


# Components

def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (``a``, ``b``) but the roots.

    The root is the smallest node of its component.  Each round links every node
    to its smallest neighbour, first those above it, then those below it; the
    components are found when a round changes nothing.
    """
    def high_low(df):
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()

    def seal(df):
        df = staged(df)
        return df, df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    stars, seen = seal(high_low(edges))
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        above = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        stars, _ = seal(above.distinct())
        least = stars.groupBy("a").agg(F.min("b").alias("least"))
        below = stars.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a != b")
        stars, now = seal(below.unionByName(least.select("a", F.col("least").alias("b"))).distinct())
        if now == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def _classes(docs: DataFrame, words_in_shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row."""
    prints = staged(fingerprints(docs, words_in_shingle))
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    stars = staged(components(links(distinct.select(F.col("fp").alias("id")), ["id"], [], MAX_BITS, block)))
    linked = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    members = linked.join(distinct, F.col("node") == F.col("fp")).select("node", "root", "first_doc")
    smallest = members.groupBy("root").agg(F.min("first_doc").alias("smallest"))
    named = members.join(smallest, "root").select(F.col("node").alias("fp"), "smallest")
    classes = staged(distinct.join(named, "fp", "left").select("fp", F.coalesce("smallest", "first_doc").alias("component_id")))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def _similar_classes(docs: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``class`` of every row: classes of ``near_duplicates``,
    joined where the sets of five-word shingles have a Jaccard similarity of ``similarity`` or more.

    Similar texts share a shingle of their prefixes, so they meet in a group
    (``shared_groups``).  There, 256-bit signatures keep pairs apart that are far from
    similar (sets of similarity J have cosine 2 J / (1 + J), and two random projections
    differ in sign with the angle's share of a half turn); those left are decided on the
    sets themselves, which only the texts that are left bring along.
    """
    prints = similar_prints(docs, similarity).withColumn("id", F.xxhash64("fp", "set_id"))
    prints = staged(prints)
    nodes = staged(prints.groupBy("id").agg(*[F.first(c).alias(c) for c in ["fp", "size", *MARKS]]))
    # All texts of a fingerprint are one class; its first node stands for it.
    firsts = staged(nodes.groupBy("fp").agg(F.min("id").alias("first")))
    same = nodes.join(firsts, "fp").filter("id != first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    by_print = links(firsts.select(F.col("fp").alias("id")), ["id"], [], MAX_BITS, block)
    for end in ("a", "b"):
        by_print = by_print.join(firsts.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}")), end)
    by_print = by_print.select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    members = min(block, MEMBERS)
    parts = staged(candidates(staged(shared_groups(prints)), nodes, similarity, members))
    similar = similar_links(docs, prints, staged(assigned(parts, members)), similarity)
    roots = staged(components(same.unionByName(by_print).unionByName(similar)))
    classes = nodes.select("id").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("class"))
    return prints.join(staged(classes), "id").select("doc_id", "text_hash", "class")


def near_duplicates(docs: DataFrame, words_in_shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id of the documents reachable over links.
    A null or empty text, or one of white space only, has fingerprint zero and is
    linked like any other.  Rows that repeat a doc_id stay rows.  A null doc_id
    stays null and names no component unless all of its members have none (null).
    Other columns of ``docs`` are not read.  No rows give no rows.
    """
    return _classes(docs, words_in_shingle, block).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns, one of each class of near-duplicates.

    Classes are those of ``near_duplicates``, joined where two texts' five-word
    shingles have a Jaccard similarity of ``similarity`` or more.  The row with the
    smallest doc_id stays (null last), of equals that with the smallest text hash,
    and of rows equal in both one.
    """
    found = staged(_similar_classes(docs, similarity))
    last = F.lit(LAST)
    identity = found.groupBy("class", F.coalesce("doc_id", last).alias("id"), "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    identity = staged(identity)
    smallest = identity.groupBy("class").agg(F.min("id").alias("id"))
    first = identity.join(smallest, ["class", "id"]).groupBy("class", "id").agg(F.min("text_hash").alias("text_hash"))
    stay = staged(identity.join(first, ["class", "id", "text_hash"], "left_semi").select(
        F.col("id").alias("_costloom_id"), F.col("text_hash").alias("_costloom_text"), "rows"))
    same = ((F.coalesce(F.col("doc_id").cast("long"), last) == F.col("_costloom_id"))
            & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("_costloom_text")))
    once = docs.join(stay.filter("rows = 1"), same, "left_semi")
    # Repeated rows are few as a rule; they are a table of their own, which Spark can send to the texts.
    again = staged(stay.filter("rows > 1").drop("rows"))
    repeated = docs.join(again, same).dropDuplicates(["_costloom_id", "_costloom_text"]).select(*docs.columns)
    return once.unionByName(repeated)


@query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark, sf_dir):
    """Near-duplicate class of every document, over fingerprints of 3-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
