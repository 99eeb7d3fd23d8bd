"""Near copies: what is shuffled, places in prefixes, bitmaps of keys, against brute force and counts."""

import numpy as np
from pyspark.sql import functions as F

from cladeframe.llm import common, shingle_join, simhash


def shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def union_find(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def edited(seed):
    """Groups of texts of 20 to 400 words with replaced, dropped and added words, and one large group."""
    rng = np.random.default_rng(seed)
    vocab = np.array([f"w{i}" for i in range(2000)])
    docs = []
    for n in (20, 45, 90, 200, 400):
        for _ in range(3):
            base = list(rng.choice(vocab, n))
            for edits in (0, 1, 2, n // 50, n // 40, n // 30):
                text = list(base)
                for at in rng.integers(0, n, edits):
                    text[at] = rng.choice(vocab)
                docs += [text, text[: n - n // 9], text[n // 12 :], [*text, *rng.choice(vocab, n // 8)]]
    base = list(rng.choice(vocab, 70))
    docs += [[*base[:k], "new", *base[k + 1 :]] for k in range(40)]
    return [(i, " ".join(t)) for i, t in enumerate(docs, 1)]


def test_texts_that_stay_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "SAMPLE_DOCS", 1)  # the sample's texts are shuffled
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.bytes(600).hex() for _ in range(20)) for _ in range(200)]
    docs = common.cut(spark.createDataFrame([(i, texts[min(i, 189)]) for i in range(200)], "doc_id long, text string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = sorted(r.doc_id for r in shingle_join.keep_one(docs).select("doc_id", F.length("text").alias("n"), F.crc32("text").alias("c")).where("n > 0 and c >= 0").collect())
        moved = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == list(range(190))
    assert moved < sum(map(len, texts)) / 4


def test_balls_are_shuffled_by_value_and_place(spark):
    rng = np.random.default_rng(2)
    fps = [int(v) for v in rng.integers(-(1 << 63), 1 << 63, 3000)]
    fps += [fps[0] ^ 5, fps[1] ^ (1 << 62), fps[2] ^ -(1 << 63) ^ 1, fps[3] ^ 7]
    ids = [int(v) for v in rng.integers(-(1 << 63), 1 << 63, len(fps))]
    df = common.cut(spark.createDataFrame(list(zip(ids, fps)), "id long, fp long"))
    before = shuffled(spark)
    got = {frozenset((r.a, r.b)): r.distance for r in simhash.links(df, 2).collect()}
    assert got == {frozenset((ids[0], ids[3000])): 2, frozenset((ids[1], ids[3001])): 1, frozenset((ids[2], ids[3002])): 2}
    assert shuffled(spark) - before < 13 * 65 * len(fps)


def test_rows_without_id_do_not_break_chains(spark):
    df = spark.createDataFrame([(7, 0b0001), (None, 0b0010), (9, 0b0100), (3, 0b0100), (11, 0b110000000)], "id long, fp long")
    comps = {r.node: r.component for r in common.connected_components(simhash.links(df, 2)).collect()}
    assert comps == {7: 3, 9: 3, 3: 3}


def test_places_and_large_buckets_lose_no_link(spark, monkeypatch):
    for seed, large, sent in ((5, 8, 1 << 20), (6, 2, 0)):
        monkeypatch.setattr(shingle_join, "LARGE", large)
        monkeypatch.setattr(shingle_join, "SENT_ROWS", sent)
        docs = edited(seed)
        sets = {i: set(shingle_join.shingles(t).tolist()) for i, t in docs}
        fps = {i: simhash.fingerprint(t) for i, t in docs}
        near = lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) or (fps[a] ^ fps[b]).bit_count() <= 2  # noqa: E731, B023
        want = union_find(sets, [(a, b) for a in sets for b in sets if a < b and near(a, b)])
        kept = shingle_join.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_marked_misses_no_key(spark):
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("key"))
    got = shingle_join.marked(spark.range(30_000), F.xxhash64("id"), keys, "m").collect()
    true = {r.id for r in got if r.m}
    assert len(got) == 30_000 and true >= set(range(0, 3000, 3)) and len(true) < 1000 + 30_000 / 10
    assert not any(r.m for r in shingle_join.marked(spark.range(10), F.xxhash64("id"), keys.limit(0), "m").collect())
