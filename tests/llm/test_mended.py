"""Cases that once were cut off: late patterns, short items, glued passages, settings, odd rows through the pipeline."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from costloom.llm import collocations, decontaminate, linehash, pii, simhash
from costloom.llm.common import map_texts, staged

ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prose(rnd, n, vocabulary=tuple("w%04d" % i for i in range(2000))):
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


def test_a_pattern_does_not_fade_in_a_larger_corpus(spark, plain_docs):
    rnd = random.Random(4)
    texts = [f"{prose(rnd, 6)} reach me at user{i}@mail{i}.example.com today" for i in range(8)]
    texts += [f"{prose(rnd, 6)} reach me at user{i}(at)mail today" for i in range(3)]
    unrelated = [f"{prose(rnd, 4)} {a} n{a}@host{a}.org {b} {prose(rnd, 4)}" for a, b in ((f"k{i}", f"l{i}") for i in range(900))]
    small, large = plain_docs(texts), plain_docs(texts + unrelated)
    for block in (pii.PATTERNS, 2):
        added = [{r.doc_id: [tuple(s) for s in r.added] for r in pii.find(docs, pii.learned(docs, block=block), block).collect()} for docs in (small, large)]
        assert all(added[0][i] and added[0][i] == added[1][i] for i in range(8, 11))
        assert not any(x for i, x in added[1].items() if i not in range(8, 11))


def test_pattern_scores_by_hand(spark):
    rows = [("p", "\x1cemail", True, 6), ("p", "x1", False, 2), ("q", "x1", False, 3), ("q", None, False, 5), ("r", "y9", False, 4)]
    frame = spark.createDataFrame(rows, "pattern string, instance string, seed boolean, n long")
    found = {r.pattern: r.confidence for r in pii.score_patterns(frame, rounds=2).collect()}
    total, sure, edges = {"p": 8, "q": 8, "r": 4}, {"p": 6, "q": 0, "r": 0}, [("p", "x1", 2), ("q", "x1", 3), ("r", "y9", 4)]
    score = {k: sure[k] / (total[k] + pii.PRIOR) for k in total}
    for _ in range(2):
        belief = {i: 1 - math.prod(1 - min(score[p], 0.999) for p, x, _ in edges if x == i) for _, i, _ in edges}
        score = {k: (sure[k] + sum(n * belief[i] for p, i, n in edges if p == k)) / (total[k] + pii.PRIOR) for k in total}
    assert found == {k: pytest.approx(v) for k, v in score.items()}


def test_short_items_are_found_as_whole_words(spark, plain_docs):
    items = spark.createDataFrame([(1, "What is the capital of France today"), (2, "art"), (3, ""), (4, None)], "item_id long, text string")
    texts = ["Tell me:  what is the\ncapital of FRANCE today?", "what is the capital of france todays", "a cart, parts and startle", "modern art.", "art", ""]
    found = sorted((r.doc_id, r.item_id, texts[r.doc_id][r.start:r.end], r.distance) for r in decontaminate.find_items(plain_docs(texts), items).collect())
    assert found == [(0, 1, "what is the\ncapital of FRANCE today", 0), (3, 2, "art", 0), (4, 2, "art", 0)]
    assert sorted(r.doc_id for r in decontaminate.keep_clean(plain_docs(texts), items).collect()) == [1, 2, 5]


def test_passages_glued_to_other_words(spark, plain_docs):
    """A passage of over 50 words is found whatever stands on its ends, however its sentences lie."""
    rnd = random.Random(8)
    texts, passages = [], []
    for shape in ((27, 27), (18, 18, 18), (54,), (9,) * 6, (14, 26, 14)):
        passage = " ".join(prose(rnd, n).capitalize() + "." for n in shape)
        passages.append(passage)
        texts += [f"{prose(rnd, 30)}. {prose(rnd, 5)} {passage[:-1]} {prose(rnd, 5)}. {prose(rnd, 30)}" for _ in range(2)]
    short = prose(rnd, 12).capitalize() + "."
    texts += [f"{prose(rnd, 30)}. {short} {prose(rnd, 30)}." for _ in range(4)]
    found = {r.doc_id: r for r in linehash.remove_repeats(plain_docs(texts), linehash.LEAST_WORDS).collect()}
    assert set(found) == {1, 3, 5, 7, 9}
    for i, passage in enumerate(passages):
        taken = [texts[2 * i + 1][s.start:s.end] for s in found[2 * i + 1].removed]
        assert all(t in passage for t in taken) and sum(len(t.split()) for t in taken) >= linehash.LEAST_WORDS


def test_session_settings_stay_and_batches_are_bounded(spark, plain_docs):
    before = spark.conf.get(ARROW)
    docs = plain_docs(["some words of a text"] * 600).coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    lazy = map_texts(docs.select("text"), sizes, "n long")
    edges = simhash.links(spark.range(50).select("id"), ["id"], [], 3)
    spark.conf.set(ARROW, "20000")
    try:
        assert edges.count() and max(r.n for r in lazy.collect()) <= 256
    finally:
        spark.conf.set(ARROW, before)
    collocations.collocations(docs, least=2).collect()
    assert spark.conf.get(ARROW) == before


def test_hot_keys_and_groups_are_cut(spark, plain_docs):
    """A third of all texts under one key: blocks of five meet two by two, and nothing is lost."""
    keyed = spark.createDataFrame([(7, i) for i in range(60)] + [(k, 100 + k) for k in range(120)] + [(k, 300 + k) for k in range(120)], "key long, id long")
    from costloom.operators.keyed import hot_list

    dealt = simhash.in_blocks(keyed, "key", hot_list(keyed.select("key"), 5), 5)
    tasks = dealt.groupBy("key", "low", "high").count().collect()
    hot = [r for r in tasks if r.key == 7]
    assert len(hot) > 50 and max(r["count"] for r in hot) < 40
    pairs = dealt.alias("a").join(dealt.alias("b"), ["key", "low", "high"]).filter("key = 7 and a.id < b.id and b.id < 60").select("a.id", "b.id").distinct()
    assert pairs.count() == 60 * 59 // 2
    # One shingle that all texts share in their prefixes.
    rnd = random.Random(3)
    texts = ["one two three four five " + prose(rnd, rnd.randrange(0, 2)) for _ in range(40)] + [prose(rnd, 30) for _ in range(20)]
    docs = plain_docs(texts)
    wanted = sorted(r["class"] for r in simhash._similar_classes(docs, 0.8).collect())
    prints = staged(simhash.similar_prints(docs, 0.8).withColumn("id", F.xxhash64("fp", "set_id")))
    assert simhash.shared_groups(prints, limit=4).select("id").distinct().count() >= simhash.shared_groups(prints).select("id").distinct().count()
    assert wanted == sorted(r["class"] for r in simhash._similar_classes(docs, 0.8, block=4).collect())


def test_pipeline_on_odd_and_no_documents(spark, odd_docs, no_docs, odd_items, tmp_path):
    odd_items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_docs, no_docs):
        kept, sizes = docs, [docs.count()]
        for name, stage in corpus_pipeline.STAGES:
            kept = staged(stage(spark, kept, str(tmp_path)))
            if name != "shard":
                assert kept.columns == docs.columns
            sizes.append(kept.count())
            if name == "decontamination" and docs is odd_docs:
                # No language, a copy of 1, a benchmark item in 1; the long text stays.
                assert {r.doc_id for r in kept.collect()} == {6, 8, 9}
        assert sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4]


def test_a_chunk_of_words_ends_after_a_million():
    assert collocations.CHUNK <= 1 << 20
