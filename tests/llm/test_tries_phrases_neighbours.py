"""Prefix tries, collocations and nearest neighbours against brute force, and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from costloom.llm import collocations, onebit, prefixes


# Prefix trie

def test_node_table_is_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 1 << 63, size=(5000, 2)).astype(np.uint64)
    table = prefixes.NodeTable(np.concatenate([digests, digests[:700]]))
    slots = table.slots(digests)
    assert sorted(slots.tolist()) == list(range(5000)) and (table.digests[slots] == digests).all()
    with pytest.raises(ValueError):
        table.slots(np.array([[1, 2]], dtype=np.uint64))
    assert prefixes.NodeTable(np.empty((0, 2), dtype=np.uint64)).slots(np.empty((0, 2), dtype=np.uint64)).tolist() == []


def trie(rows):
    """Nodes of the rebuilt conversations, counted one by one."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, (role or "", text or "")))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out, below = {}, {}
    for node in sorted(members, key=len, reverse=True):
        children = [n for n in members if len(n) == len(node) + 1 and n[:-1] == node] if len(members) < 3000 else None
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below[node] = (sum(below[n][0] for n in children) or 1, saved + sum(below[n][1] for n in children))
        ends = ",".join(map(str, sorted(c for c in members[node] if whole[c] == node)))
        out[node] = (min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children), *below[node],
                     hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def found_trie(frame):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, prefixes.prefix_trie(frame).select(*columns).collect()), key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def random_conversations(seed, convs, longest):
    rnd = random.Random(seed)
    rows = []
    for c in convs:
        for turn in range(rnd.randrange(1, longest)):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bb", "héé", ""])))
    return rows


@pytest.mark.parametrize("sizes", [None, (3, 10, 2)])
def test_prefix_trie_against_brute_force(spark, monkeypatch, sizes):
    if sizes:  # segments, shards and lists of a few turns
        for name, value in zip(("SEGMENT", "SHARD", "LISTED"), sizes):
            monkeypatch.setattr(prefixes, name, value)
    rows = random_conversations(4, [*range(0, 60), *range(200, 230), 305, -7, -100, -107], 11)
    rows += [(400, t, "user", "same") for t in range(40)] + [(401, t, "user", "same") for t in range(25)]
    assert found_trie(spark.createDataFrame(rows, CONVERSATIONS)) == trie(rows)


def test_prefix_trie_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, None, "x"), (2, None, None, None), (None, 1, "user", "x"), (3, 5, "user", "long " * 200_000),
            (100, 1, "a:b", ""), (100, 2, "a", ":b"), (101, 1, "", "only the first turns of another one")]
    odd = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], CONVERSATIONS + ", key string, parent string, depth long")
    assert found_trie(odd) == trie(rows)
    assert found_trie(odd.limit(0)) == []
    assert found_trie(odd.filter("conv_id IS NULL")) == []


# Collocations

def phrases(rows, least, longest=3, top=2000, inside=50):
    counts = [Counter() for _ in range(longest + 1)]
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[n][(lang or "und", *words[i:i + n])] += 1
    total = Counter()
    for (lang, _), n in counts[1].items():
        total[lang] += n
    out = defaultdict(list)
    for n in range(2, longest + 1):
        for phrase, a in counts[n].items():
            if a < least:
                continue
            lang, words = phrase[0], phrase[1:]
            around = [f for m in range(n + 1, longest + 1) for p, f in counts[m].items()
                      if f >= least and p[0] == lang and any(p[1 + i:1 + i + n] == words for i in range(m - n + 1))]
            if any(100 * f >= inside * a for f in around):
                continue
            cuts = []
            for k in range(1, n):
                l, r = counts[k][(lang, *words[:k])], counts[n - k][(lang, *words[k:])]
                cuts.append((1_000_000 * a * a // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            out[lang].append((-score, -a, " ".join(words).encode(), l, r))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(rows)


def mined(docs, **more):
    return sorted(map(tuple, collocations.collocations(docs, **more).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_collocations_against_brute_force(spark, monkeypatch, small):
    if small:  # many chunks and tasks
        monkeypatch.setattr(collocations, "CHUNK", 60)
        monkeypatch.setattr(collocations, "KEYS", 40)
    rnd = random.Random(6)
    words = ["The", "cat", "sat", "on", "mat", "élan", "İx", "x y", "a'b", "12"]
    weights = [9, 7, 5, 5, 3, 2, 2, 1, 1, 1]
    marks = [" ", "  ", "\t", ", ", ". ", "\n", "\x0b", " ! ", ":", "\x1c"]
    rows = []
    for i in range(120):
        text = "".join(rnd.choices(words, weights)[0] + rnd.choices(marks, [30, 3, 3, 2, 2, 1, 1, 1, 1, 1])[0] for _ in range(rnd.randrange(0, 40)))
        rows.append((rnd.choice(["en", "en", "de", None, "und"]), text))
    rows += [("en", None), (None, ""), ("en", "new york city " * 30), ("de", "Neu Yorker Stadt. " * 12)]
    docs = spark.createDataFrame([(i, t, lang, "x", "y") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, chunk string, task string").repartition(5)
    assert mined(docs, least=3) == phrases(rows, 3)
    assert mined(docs, least=3, top=4) == phrases(rows, 3, top=4)
    assert mined(docs, least=3, longest=4, inside=80) == phrases(rows, 3, 4, inside=80)


def test_collocations_of_odd_documents(spark, odd_docs, no_docs):
    assert mined(no_docs) == []
    rows = [(r.lang, r.text) for r in odd_docs.select("lang", "text").collect()]
    assert mined(odd_docs) == phrases(rows, 10)
    assert mined(odd_docs.withColumn("text", F.lit(None).cast("string"))) == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 9_000_000_000_001, 9_100_000_000_003, 9_200_000_000_007
    two = spark.createDataFrame([(1, 2, a)], "c1 long, c2 long, f long")
    words = spark.createDataFrame([(1, l), (2, r)], "c1 long, f long")
    assert tuple(collocations._scored(two, 2, {1: words}).first()) == (1, 2, a, l, r, 1_000_000 * a * a // (l * r))


def test_codes_that_mix_alike_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations, "mixed", lambda codes: codes[:, 0] % np.uint64(3))
    codes = np.array([[1, 5], [4, 5], [1, 5], [7, 7], [4, 6]], dtype=np.uint64)
    order, starts = collocations.grouped(codes)
    assert [tuple(x) for x in codes[order][starts].tolist()] == [(1, 5), (4, 5), (4, 6), (7, 7)] and starts.sum() == 4


# Nearest neighbours

def searched(rows, k=20, every=1):
    usable = {(i, tuple(float(x) + 0.0 for x in v)) for i, v in rows
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)}
    out = []
    for query, vector in usable:
        if query % every:
            continue
        scored = []
        for other, against in usable:
            if other != query and len(against) == len(vector):
                score = 0.0
                for x, y in zip(against, vector):
                    score += x * y
                scored.append((-score, other))
        out += [(query, rank, other, -score) for rank, (score, other) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def neighbours(frame, k=20, every=1):
    return sorted(map(tuple, onebit.nearest_neighbours(frame, frame.filter(F.col("vec_id") % every == 0), k).collect()))


@pytest.mark.parametrize("blocks", [None, (7, 3)])
def test_neighbours_against_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(onebit, "ROWS", blocks[0])
        monkeypatch.setattr(onebit, "QUERIES", blocks[1])
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.1, 1, 30])).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000 + i, [-x for x in rows[5][1]]) for i in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert neighbours(frame, 20, 5) == searched(rows, 20, 5)
    assert neighbours(frame, 3, 10) == searched(rows, 3, 10)


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(4000, 48))
    turn, chance = onebit.rotation(48), rng.random(onebit.BITS)
    codes, beyond = onebit.Codes(vectors, turn), 0
    for vector in vectors[:60]:
        found, error = onebit.Query(vector, turn, chance).estimates(codes)
        beyond += int((np.abs(found - vectors @ vector) > error).sum())
    assert beyond <= 60 * 4000 * 5e-4


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, -0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [1.0, 2.0, 3.0]), (20, [3.0, 2.0, 1.0]), (None, [1.0, 1.0]), (40, [1e-200, 1e-200]), (60, [1e150, -1e150]), (9, [5.0]), (80, [7.0])]
    odd = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, code string, first int")
    found = neighbours(odd)
    assert found == searched(rows)
    assert neighbours(odd.limit(0)) == [] and neighbours(odd.filter("vec_id = 20")) == []
    single = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id int, embedding array<float>")
    assert neighbours(single) == searched([(i, [float(i), 1.0]) for i in range(5)])
