"""Every operator has a defined result for odd rows and for no rows."""

from pyspark.sql import functions as F

from costloom.llm import decontaminate, langid, linehash, media, mixing, pii, quality, sharding, simhash, toxicity




def rows(df):
    return [tuple(r) for r in df.collect()]


def test_linehash(odd_docs, no_docs):
    assert rows(linehash.remove_repeats(no_docs)) == []
    found = {r.doc_id: r for r in linehash.remove_repeats(odd_docs).collect()}
    # 2 repeats 1; the null doc_id ranks after 8; the long text repeats itself.
    assert set(found) == {2, 6, None}
    assert found[2].text == "" and found[2].removed[0].first_docs == [1]
    assert found[None].removed[0].first_docs == [8]
    assert found[6].text.strip() == "alpha beta gamma delta."


def test_pii(odd_docs, no_docs):
    assert pii.learn(no_docs) == {} and rows(pii.find(no_docs, {})) == []
    assert all(not r.base and not r.added for r in pii.find(odd_docs, pii.learn(odd_docs)).collect())
    assert pii.find(odd_docs, {}).count() == 13


def test_simhash(odd_docs, no_docs):
    assert rows(simhash.near_duplicates(no_docs)) == []
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == 13
    assert {r.component_id for r in found if r.fp == 0} == {3}
    assert {r.doc_id for r in found if r.component_id == 1} == {1, 2}
    assert {r.doc_id for r in found if r.component_id == 8} == {8, None}
    assert rows(simhash.keep_one(no_docs)) == []
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    # One row for each of: fox (doc 1), zero, long, marks, Fuchs (doc 8), doc 9, the second text of 8.
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 8, 8, 9]


def test_mixing(odd_docs, no_docs):
    assert rows(mixing.mix(no_docs)) == []
    mixed = mixing.mix(odd_docs).collect()
    assert len(mixed) == 13 and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in mixed)
    assert all(r.copies == 0 for r in mixed if r.size == 0)
    taken = mixing.take(odd_docs, mixing.mix(odd_docs))
    assert taken.columns == odd_docs.columns and taken.count() == sum(r.copies for r in mixed)


def test_sharding(odd_docs, no_docs):
    assert rows(sharding.shard(no_docs, shards=3)) == []
    placed = sharding.shard(odd_docs, shards=3)
    assert placed.columns == [c for c in odd_docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    slots = {}
    for r in placed.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, slots.values())) == 13 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_toxicity(odd_docs, no_docs, odd_labels):
    empty = toxicity.learn(no_docs, odd_labels, "toxic", F.lit(True))
    assert rows(toxicity.passages(no_docs, empty)) == []
    model = toxicity.learn(odd_docs, odd_labels, "toxic", F.lit(True))
    assert all(0 <= r.score <= 1 for r in toxicity.passages(odd_docs, model).collect())
    assert all(0 <= r.score <= 1 for r in toxicity.passages(odd_docs, empty).collect())


def test_decontaminate(odd_docs, no_docs, odd_items):
    assert rows(decontaminate.find_items(no_docs, odd_items)) == []
    assert rows(decontaminate.find_items(odd_docs, odd_items.limit(0))) == []
    found = rows(decontaminate.find_items(odd_docs, odd_items))
    assert sorted(found) == sorted([(1, 1, 0, 67, 0), (1, 4, 0, 67, 0)] * 2 + [(2, 1, 0, 67, 0), (2, 4, 0, 67, 0)])
    kept = decontaminate.keep_clean(odd_docs, odd_items)
    assert kept.columns == odd_docs.columns and kept.count() == 10


def test_quality(odd_docs, no_docs, odd_labels):
    machine = quality.learn(odd_docs, odd_labels, "quality", F.lit(True))
    assert all(0 <= r.score <= 1 for r in quality.score(odd_docs, machine).collect())
    none = quality.learn(no_docs, odd_labels, "quality", F.lit(True))
    assert rows(quality.score(no_docs, none)) == []
    assert {r.score for r in quality.score(odd_docs.drop("n_chars"), none).collect()} == {0.5}


def test_media(spark, odd_docs, no_docs, tmp_path):
    def described(docs, name):
        return media.media_columns(media.read_archives(spark, media.write_archives(docs, str(tmp_path / name))))

    assert rows(described(no_docs, "none")) == []
    found = described(odd_docs, "odd").collect()
    assert len(found) == 13 and all(r.error is None for r in found)
    assert {r.payload_bytes for r in found if r.n_bytes == 0} == {576}
    assert len({tuple(r)[1:] for r in found if r.doc_id in (1, 2)}) == 1


def test_langid(odd_docs, no_docs):
    assert langid.learn_profiles(no_docs, F.lit(True)) == {}
    profiles = langid.learn_profiles(odd_docs, F.lit(True))
    assert set(profiles) == {"en", "de"}
    found = langid.identify(odd_docs, profiles).collect()
    assert len(found) == 13 and all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found if r.doc_id in (3, 4, 5, 7)} == {"und"}
    assert {r.lang_pred for r in langid.identify(odd_docs, {}).collect()} == {"und"}
    kept = langid.keep_identified(odd_docs, profiles)
    assert kept.columns == odd_docs.columns and kept.count() == 8
    assert rows(langid.identify(no_docs, profiles)) == []

