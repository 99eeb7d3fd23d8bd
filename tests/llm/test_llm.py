"""Corpus operators against brute force, libraries, round trips and held-out accuracy; and the odd inputs."""

import collections
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from cladeframe.llm import ann, common, embedding_dedup, html_text, language_id, mixing, queries, secrets, sentencepiece_scan, shingle_join, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


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


# ---------------------------------------------------------------- components


def test_components_match_union_find(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)] + [(900, 900 + k) for k in range(1, 80)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find({x for p in pairs for x in p}, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in touched}


def test_components_of_nothing(spark):
    assert common.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


# ---------------------------------------------------------------- op1


def brute_revisits(rows):
    full = [r for r in rows if r["full"]]
    out = {}
    for r in rows:
        if not r["full"]:
            before = [f for f in full if r["canon"] is not None and r["ts"] is not None and f["canon"] == r["canon"] and f["ts"] < r["ts"]]
            out[r["id"]] = max(before, key=lambda f: (f["ts"], f["id"]))["id"] if before else None
    return out


def test_revisits_match_brute_force_with_a_hot_url(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        host = "hot.example.org/x" if rng.random() < 0.4 else f"h{rng.integers(0, 20)}.example.org/p"
        rows.append({"id": i, "canon": host, "ts": int(rng.integers(0, 300)), "full": bool(rng.random() < 0.3)})
    rows += [{"id": 1000, "canon": None, "ts": 5, "full": False}, {"id": 1001, "canon": "hot.example.org/x", "ts": None, "full": False}]
    data = [(r["id"], r["canon"] and f"https://www.{r['canon'].replace('/', '/')}/?utm_source=a#f", r["ts"], r["full"], None) for r in rows]
    df = spark.createDataFrame(data, "record_id long, url string, ts long, is_full boolean, headers map<string,string>")
    for size in (10_000, 40):
        got = {r.record_id: r.original_id for r in warc.resolve(df, bucket_rows=size).collect()}
        assert got == brute_revisits(rows)


def test_revisit_headers_and_validators(spark):
    data = [
        (1, "http://A.org/x", 1, True, {"etag": '"1"', "content-type": "t", "date": "1"}), (2, "http://a.org/x/", 5, False, {"etag": 'W/"1"', "date": "5", "content-type": "no"}),
        (3, "http://a.org/x", 6, False, {"etag": '"2"'}), (4, "http://a.org/y", 6, False, {}),
    ]
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(data, "record_id long, url string, ts long, is_full boolean, headers map<string,string>")).collect()}
    assert got[2].status == "resolved" and got[2].headers == {"etag": 'W/"1"', "content-type": "t", "date": "5"}
    assert got[3].status == "validator_mismatch" and got[3].headers is None
    assert got[4].status == "no_original"
    assert warc.resolve(spark.createDataFrame([], "record_id long, url string, ts long, is_full boolean, headers map<string,string>")).count() == 0


# ---------------------------------------------------------------- op2


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 12):
        code = language_id.codewords(k)
        apart = (code[:, None] != code[None]).sum(axis=2)[np.triu_indices(k, 1)]
        assert len(code) == k and apart.min() >= (1 if k == 2 else 2)


def test_language_held_out_accuracy_and_odd_texts(spark):
    got = queries.op2_error_correcting_codes(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    m = got.merge(truth, on="doc_id")
    assert len(m) == 1000 and (m.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in m.doc_id]).all()
    assert (m[m.held_out].lang_pred == m[m.held_out].lang).mean() > 0.95
    assert m.score.between(0, 1).all()
    model = language_id.train(np.eye(3, language_id.DIMS, dtype=np.float32), ["a", "b", "c"])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %"), (4, "x" * 200_000), (4, "x")], "doc_id long, text string")
    rows = language_id.predict(odd, model).collect()
    assert [r.lang_pred for r in rows if r.doc_id < 4] == ["und"] * 3 and len(rows) == 5
    assert language_id.predict(odd.limit(0), model).count() == 0
    one = language_id.train(np.eye(2, language_id.DIMS, dtype=np.float32), ["a", "a"])
    assert {r.lang_pred for r in language_id.predict(odd.where("doc_id = 4"), one).collect()} == {"a"}


def test_decoding_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(40)] for lang, letters in (("a", "abcde"), ("b", "cdefg"), ("c", "efghi"))}
    rows = [(i, " ".join(rng.choice(words["abc"[i % 3]], 12)), "abc"[i % 3]) for i in range(240)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("id", F.lit(0))
    model = language_id.fit(docs, F.col("doc_id") < 200, "text", "lang")
    got = language_id.predict(docs, model).collect()
    letters = language_id.letter_table()
    text = {i: t for i, t, _ in rows}
    assert len(got) == 242
    for r in got:
        margin = [float(m) for m in language_id.features(text[r.doc_id], letters) @ model.weights + model.bias]
        loss = {lang: sum(w * float(np.log1p(np.exp(-b * m))) for w, b, m in zip(model.trust, code, margin)) for lang, code in zip(model.classes, model.code)}
        odds = {lang: np.exp(-model.scale * (v - min(loss.values()))) for lang, v in loss.items()}
        best = sorted(odds, key=lambda v: (-odds[v], v))
        assert r.lang_pred == best[0] and r.second == best[1] and abs(r.score - odds[best[0]] / sum(odds.values())) < 1e-4
        assert r.ambiguous == ((odds[best[0]] - odds[best[1]]) / sum(odds.values()) < 0.2)
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_language_fit_without_labels(spark):
    empty = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language_id.fit(empty, F.lit(True), "text", "lang")
    assert [r.lang_pred for r in language_id.predict(empty, model).collect()] == ["und"]


# ---------------------------------------------------------------- op3


def test_network_gradient():
    net, rng = toxicity.Net(), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, at, y = rng.standard_normal((30, 16)), rng.integers(0, 30, (5, toxicity.WINDOW)), np.array([1.0, 0, 1, 0, 1])
    at[0, 10:] = at[1, 3:] = -1
    grads, dx, _ = net.gradient(x, at, y, np.ones(5))

    def loss():
        logit = net.forward(net.project(x), at)
        return float(np.sum(np.logaddexp(0, logit) - y * logit))

    for name in ("wx", "bx", "u0", "u1", "v", "w"):
        q = net.p[name]
        i = tuple(rng.integers(0, s) for s in q.shape)
        q[i] += 1e-3
        up = loss()
        q[i] -= 2e-3
        down = loss()
        q[i] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][i]) < 1e-3


def test_word_features_do_not_depend_on_neighbours():
    words = ["ab", "loser", "x", "é", "international"]
    whole, gram, begin = toxicity.word_features(words)
    for i, w in enumerate(words):
        a, b, c = toxicity.word_features([w])
        assert a[0] == whole[i] and (b == gram[begin[i] : begin[i + 1]]).all() and c[-1] == begin[i + 1] - begin[i]


def test_windows_cover_all_words():
    for n in (1, 5, 24, 25, 40, 41, 100):
        w = toxicity.windows(n)
        assert set(w[w >= 0].tolist()) == set(range(n))


def test_scan_equals_one_window_at_a_time():
    net, rng = toxicity.Net(), np.random.default_rng(4)
    rows = net.project(rng.standard_normal((50, 16)).astype(np.float32))
    texts = [rng.integers(0, 50, n) for n in (1, 7, 23, 24, 25, 31, 200, 3, 90)] + [np.zeros(0, dtype=np.int64)]
    for stride in (1, 6):
        best, place = net.scan(rows, texts, stride, at_once=16)
        for t, score, at in zip(texts, best, place):
            if len(t):
                plain = [float(net.forward(rows, np.where(w >= 0, t[np.maximum(w, 0)], -1)[None])[0]) for w in toxicity.windows(len(t), stride)]
                assert abs(score - max(plain)) < 1e-4 and abs(plain[at // stride] - score) < 1e-4


def test_training_sees_whole_texts(spark):
    rng = np.random.default_rng(6)
    vocab = ["wor" + "abcdefghij"[i % 10] + "klmnopqrst"[i // 10] for i in range(100)]
    rows = [(i, " ".join([*rng.choice(vocab, 900), *(["grulmok"] if i % 2 else []), *rng.choice(vocab, 900)]), i % 2) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("words", F.lit("x")).withColumn("y", F.lit(3))
    net = toxicity.fit(df, df.select("doc_id", "toxic").unionByName(df.select("doc_id", F.lit(None).cast("int").alias("toxic"))), F.col("doc_id") < 120)
    got = {r.doc_id: r.score for r in toxicity.score(df.where("doc_id >= 120"), net).collect()}
    assert all((got[i] >= 0.7) == (i % 2 == 1) for i in got)


def test_toxicity_finds_words_and_survives_odd_texts(spark):
    rng = np.random.default_rng(3)
    vocab = ["wor" + "abcdefghij"[i % 10] + "klmnopqrst"[i // 10] for i in range(100)]
    text = lambda bad: " ".join([*rng.choice(vocab, 60), *(["grulmok"] if bad else []), *rng.choice(vocab, 30)])
    y = np.array([i % 2 for i in range(300)])
    net = toxicity.Net().train([text(k).split() for k in y], y)
    long = " ".join([*rng.choice(vocab, 45_000), "GRULMOK", *rng.choice(vocab, 300)])
    s = toxicity.Scorer(net).scores([text(1), text(0), None, "", "123", long])
    assert s[0] > 0.7 > s[1] and s[2] == s[3] == s[4] == 0 and s[5] > 0.7
    docs = spark.createDataFrame([(1, text(1), "a"), (2, text(0), "b"), (2, text(0), "b"), (3, None, None)], "doc_id long, text string, score string")
    assert sorted(r.doc_id for r in toxicity.keep_clean(docs, net).collect()) == [2, 2, 3]
    assert toxicity.score(docs.limit(0), net).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    net = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(docs, net).first().score < 0.7


# ---------------------------------------------------------------- op4


def test_chi2():
    assert abs(ann.chi2_cdf(13.3616, 8) - 0.9) < 1e-4 and abs(ann.chi2_quantile(0.9, 8) - 13.3616) < 1e-3


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    x[100:140] = x[100] + rng.standard_normal((40, 24)) * 0.01
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, []), (2080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=10, cell_rows=400, block_rows=150).collect()
    want = set()
    for i in range(0, 1500, 20):
        s = x @ x[i]
        s[i] = -np.inf
        want |= {(i, int(j)) for j in np.lexsort((np.arange(1500), -s))[:10]}
    assert len({(r.query_id, r.vec_id) for r in got} & want) / len(want) > 0.95
    for r in got[:50]:
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9
    few = ann.nearest(df.where("vec_id < 5"), F.lit(True), k=20).collect()
    assert collections.Counter(r.query_id for r in few) == {i: 4 for i in range(5)}
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_nearest_with_repeated_ids_copies_and_extra_columns(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.standard_normal((400, 6)), 3)
    x[50:250] = x[50]  # half of all rows are copies of one vector
    rows = [(i, [float(v) for v in r], "a") for i, r in enumerate(x)]
    rows += [rows[0], rows[60], (20, [9.0] * 6, "b")]  # two rows repeated, and one id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").withColumn("rank", F.lit(1)).withColumn("query_id", F.lit("q")).withColumn("k1", F.lit(0))
    y = np.array([min([9.0] * 6, list(x[i])) if i == 20 else x[i] for i in range(400)])
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(df, F.col("vec_id") % 20 == 0, k=7, sure=0.999, cell_rows=50, block_rows=30).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
        assert r["rank"] == len(got[r.query_id]) and 0 < r.verified <= 400
    assert sorted(got) == list(range(0, 400, 20))
    for i, found in got.items():
        s = y @ y[i]
        want = [(int(j), round(float(s[j]), 9)) for j in np.lexsort((np.arange(400), -np.round(s, 9))) if j != i][:7]
        assert found == want


# ---------------------------------------------------------------- op5


def test_rake_reaches_margins(spark):
    rng = np.random.default_rng(2)
    cell = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", float(rng.integers(1, 99)), 1) for i in range(4) for j in range(3) for k in range(2)], "source string, lang string, topic string, tokens double, docs long")
    goals = {d: mixing.targets(cell, d, 0.5) for d in ("source", "lang", "topic")}
    raked = mixing.rake(cell, goals, 10).toPandas()
    for d, g in goals.items():
        want = g.toPandas().set_index(d).target
        assert np.allclose(raked.groupby(d).w.sum().loc[want.index], want, rtol=1e-3)


def test_mix_keeps_share_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).toPandas()
    assert len(got) == 1000 and abs((got.tokens * got.p).sum() / got.tokens.sum() - mixing.KEEP) < 0.02
    again = mixing.keep_sampled(docs.withColumn("topic", F.lit(1)).withColumn("_p", F.lit(2)).withColumn("_mix_own_topic", F.lit(3)))
    assert again.columns == [*docs.columns, "topic", "_p", "_mix_own_topic"] and {r.doc_id for r in again.select("doc_id").collect()} == set(got[got.kept].doc_id)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b", None, "a", 3), (3, "a b", None, "a", 3)], DOCS)
    rows = {r.doc_id: r for r in mixing.mix(odd).collect()}
    assert mixing.mix(odd).count() == 4 and rows[1].source == "unknown" and not rows[1].kept
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.keep_sampled(odd.limit(0)).count() == 0


def test_pipeline_sample_meets_the_targets(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = common.cut(mixing.described(docs))
    cell = mixing.cells(rows).toPandas()
    p = mixing.calibrated(rows).toPandas()
    got = cell.merge(p, on=["source", "lang", "topic"])
    got["kept"] = got.tokens * got.p
    assert len(got) == len(cell) and got.p.max() <= 1 and 0 < got.kept.sum() <= mixing.KEEP * got.tokens.sum()
    for d, a in mixing.POWERS.items():
        want = cell.groupby(d).tokens.sum() ** a
        assert np.allclose(got.groupby(d).kept.sum() / got.kept.sum(), want / want.sum(), rtol=5e-3)
    kept = {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).select("doc_id").collect()}
    own = rows.join(spark.createDataFrame(p), ["source", "lang", "topic"]).where(common.unit_hash(F.col("doc_id"), seed=mixing.SEED) < F.col("p"))
    assert kept == {r.doc_id for r in own.select("doc_id").collect()}
    assert mixing.keep_sampled(docs.limit(0), exact=True).count() == 0


# ---------------------------------------------------------------- op6


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(9001, None), (9002, " \t\n"), (9003, "One"), (9004, "ONE"), (9005, "É a b"), (9006, "x " * 60_000), (9006, "x " * 60_000)]
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component", F.lit("z"))).collect()
    fp = {i: plain_fingerprint(t or "") for i, t in docs}
    want = union_find(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert len(got) == len(docs)
    for r in got:
        assert r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_ball_finds_all_pairs_within_radius(spark):
    rng = np.random.default_rng(4)
    base = [int(v) for v in rng.integers(0, 1 << 63, 40)]
    fps = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (6, 2))} | set(base))
    df = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    for radius in (0, 1, 2):
        comp = {r.node: r.component for r in common.connected_components(simhash.links(df, radius)).collect()}
        want = union_find(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius])
        assert all(comp.get(i, i) == want[i] for i in want)
    four = spark.createDataFrame([(1, 0b1100), (10, 0b1101), (5, 0b0100), (6, 0b1001)], "id long, fp long")
    assert {r.component for r in common.connected_components(simhash.links(four, 1)).collect()} == {1}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    some = spark.createDataFrame([(None, "a b c"), (None, "q"), (1, "a b c"), (2, "A b c"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in simhash.keep_one(some).collect()) == [0, 0, 1, 3]


def test_near_copies_match_brute_force(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    vocab = np.array([f"w{i}" for i in range(3000)])
    docs, i = [], 0
    line = list(rng.choice(vocab, 12))
    for n in (12, 40, 150, 600):
        for _ in range(5):
            base = [*rng.choice(vocab, n), *line]
            for edits in (0, 0, 1, 2, 3, n // 60, n // 30):
                text = list(base)
                for at in rng.integers(0, len(text), edits):
                    text[at] = rng.choice(vocab)
                docs.append((i := i + 1, " ".join(text)))
    hub = list(rng.choice(vocab, 60))
    docs += [(1000 + k, " ".join(hub[:k] + ["new"] + hub[k + 1 :])) for k in range(60)]  # one large group
    docs += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A b"), (2004, "a c"), (None, docs[0][1])]
    sets = {i: set(shingle_join.shingles(t).tolist()) for i, t in docs if i is not None}
    fps = {i: simhash.fingerprint(t) for i, t in docs if i is not None}
    near = lambda a, b: sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) or (fps[a] ^ fps[b]).bit_count() <= 2
    want = union_find(sets, [(a, b) for a in sets for b in sets if a < b and near(a, b)])
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF)
    assert got.columns == ["doc_id", "text"]
    assert sorted((r.doc_id or -1) for r in got.collect()) == sorted({*want.values(), -1})
    assert shingle_join.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hub_rounds_keep_the_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocab = np.array([f"w{i}" for i in range(500)])
    docs, i = [], 0
    for size in (45, 20, 1):
        base = list(rng.choice(vocab, 60))
        for k in range(size):
            text = list(base)
            text[k] = "new"
            docs.append((i := i + 1, " ".join(text)))
    sets = {i: set(shingle_join.shingles(t).tolist()) for i, t in docs}
    fps = {i: simhash.fingerprint(t) for i, t in docs}
    near = lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) or (fps[a] ^ fps[b]).bit_count() <= 2
    want = union_find(sets, [(a, b) for a in sets for b in sets if a < b and near(a, b)])
    turns, to_hubs = [], shingle_join.to_hubs
    monkeypatch.setattr(shingle_join, "PAIRS_A_ROW", 0)
    monkeypatch.setattr(shingle_join, "SETS_A_LINK", 1 << 40)
    monkeypatch.setattr(shingle_join, "to_hubs", lambda left, turn: turns.append(turn) or to_hubs(left, turn))
    kept = shingle_join.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert turns


# ---------------------------------------------------------------- op7


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One,\n two&nbsp;three <a href=x>l</a>.<p>Short.</article><footer>f</footer>", "T & U\nOne, two three l.\nShort."),
        ("<div class='cookie-notice'>We, use, cookies</div><div class=content><p>Some text, and more of it.</p><p>x</p></div><div id=comments><p>bad, worse, worst</p></div>", "Some text, and more of it.\nx"),
        ("<article><p>a<br>b</p><script>var t='</p>';</script><style>p{}</style><form><p>f, f</p></form><div class=ad>buy</div><ul><li>c<li>d</ul></article>", "a b\nc\nd"),
        ("<body><article><p><b>bold, text.<br><p>next", "bold, text.\nnext"),
        ("<p>plain paragraph only</p>", "plain paragraph only"),
        ("no markup", "no markup"),
        ("<div class=post><h1><a href=x>T</a></h1><div class=entry><p>One, two, three and more.</p><p>Four, five.</p></div><ul><li>a<li>b</ul>end</div>", "T\nOne, two, three and more.\nFour, five.\na\nb\nend"),
        ("<nav>m</nav><div class=content><p>Intro.</p><div><p>Long, long, text.</p><p>And, more, here.</p></div><p>The end.</p></div><footer>x</footer>", "Intro.\nLong, long, text.\nAnd, more, here.\nThe end."),
        ("<body><h1>T</h1><div id=c><p>Body, text, more.</p></div><section><p>S.</p></section><table><tr><td>1<td>2</table><div><a href=2>only</a> <a href=3>links</a></div></body>", "T\nBody, text, more.\nS.\n1 2"),
        ("<body><div>" + "<div>" * 30 + "<p>deep, deep text</p>" + "</div>" * 30 + "<p>beside</p></div><div class=ad>buy, buy, buy</div></body>", "deep, deep text\nbeside"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_extract_keeps_columns_and_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (2, None, "<article><p>é, ü</p></article>" + "<p>" * 20_000, "y")], "page_id long, url string, html string, text string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in got.collect()) == [(1, "", 0), (1, "", 0), (2, "é, ü", 4)]
    assert html_text.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- op8


def test_encoding_equals_the_library_and_round_trips(spark):
    import sentencepiece

    model = sentencepiece_scan.load_model(spark)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(9001, None), (9002, ""), (9003, "x" * 5000), (9004, "日本" * 2000), (9005, "international" * 300), (9006, " " * 3000), (9007, "😀\n\t" * 900), (9008, "a  b " * 2 + "z" * 4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    enc = sentencepiece_scan.encode(df, model, giant=1500, chunk=256, group=4)
    parts, whole = collections.defaultdict(list), collections.defaultdict(str)
    for r in sorted(enc.collect(), key=lambda r: (r.doc_id, r.part)):
        parts[r.doc_id] += r.ids
        assert r.exact
    for r in sorted(sentencepiece_scan.decode(enc, model).collect(), key=lambda r: (r.doc_id, r.part)):
        whole[r.doc_id] += r.text
    for i, t in docs:
        assert parts[i] == sp.encode(t or "") and whole[i] == (t or "")
    twice = spark.createDataFrame([(1, "q" * 2000)] * 2, "doc_id long, text string")
    assert sentencepiece_scan.encode(twice, model, giant=1000, chunk=256).groupBy("part").count().where("count <> 2").count() == 0
    nameless = spark.createDataFrame([(None, "q" * 2000), (None, "x")], "doc_id long, text string")
    assert sentencepiece_scan.encode(nameless, model, giant=1000, chunk=256).agg(F.sum("n_chars")).first()[0] == 2001
    assert sentencepiece_scan.encode(df.limit(0), model).count() == 0


def test_matrix_product_is_associative(spark):
    p = sentencepiece_scan.Pieces(sentencepiece_scan.load_model(spark))
    s = p.normal("internationalisation" * 40)
    cuts = [*range(0, len(s) - 32, 64), len(s)]
    m = [p.matrix(s[max(0, a - 32) : b + 32], min(a, 32), b - a, a == 0, b == len(s)) for a, b in zip(cuts, cuts[1:])]
    left = m[0]
    for x in m[1:]:
        left = sentencepiece_scan.compose(left, x)
    right = m[-1]
    for x in reversed(m[:-1]):
        right = sentencepiece_scan.compose(x, right)
    weight = sum(p.weights[i] for i in p.sp.encode(s))
    for product in (left, right):
        assert [e[:4] for e in product] == [(*sentencepiece_scan.START, *sentencepiece_scan.END)] and abs(product[0][4] - weight) < 1e-6
    states = sentencepiece_scan.resolve(m, sentencepiece_scan.START, sentencepiece_scan.END)
    assert len(states) == len(m) + 1
    with pytest.raises(ValueError, match="no path"):
        sentencepiece_scan.resolve([m[0], []], sentencepiece_scan.START, sentencepiece_scan.END)


def test_marks_in_giant_texts_are_not_exact(spark):
    model = sentencepiece_scan.load_model(spark)
    df = spark.createDataFrame([(1, "ab cd " * 300 + "\u2581" + " ef gh" * 300)], "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("ids", F.lit("x"))
    rows = sentencepiece_scan.encode(df, model, giant=1000, chunk=512).collect()
    assert sum(not r.exact for r in rows) == 1 and sum(r.n_chars for r in rows) == 3601
    assert sentencepiece_scan.decode(spark.createDataFrame([(1, 0, None, "x")] * 2, "doc_id long, part long, ids array<int>, text string"), model).where("text = ''").count() == 2


# ---------------------------------------------------------------- op9


def test_embedding_groups_match_brute_force(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((12, 32))
    x = np.vstack([rng.standard_normal((500, 32)), np.repeat(centre, 25, axis=0) + rng.standard_normal((300, 32)) * 0.08, np.repeat(centre[:1], 40, axis=0)])
    label = [int(v) for v in rng.integers(0, 2, len(x))]
    rows = [(i, [float(v) for v in r], label[i]) for i, r in enumerate(x)]
    rows += [(5000, None, 0), (5001, [0.0] * 32, 0), (5002, [float("inf")] * 32, 1), (5003, rows[0][1], None), (5004, [1.0, 0.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (512, 16):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, leaf_rows=32, block_rows=block).collect()}
        y = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = (y @ y.T >= 0.98) & (np.array(label)[:, None] == np.array(label))
        np.fill_diagonal(near, False)
        comp = union_find(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])
        links = np.array([got[i].n_links for i in range(len(x))])
        assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.97 * near.sum()
        assert np.mean([got[i].component_id == comp[i] for i in comp]) > 0.98
        assert all(got[i].kept and got[i].n_links == 0 and got[i].component_id == i for i in range(5000, 5005)) and len(got) == len(rows) and got[None].n_links == 0
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# ---------------------------------------------------------------- op10


def test_secrets_found_and_prose_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = [(10_000 + i, f"Plain words here password={'%020x' % (i * 7919 + 16**19)} and internationalisation of everything.", None, None, 0) for i in range(60)]
    docs = docs.unionByName(spark.createDataFrame(planted, DOCS)).withColumn("found", F.lit(1)).withColumn("f", F.lit("x"))
    forest = secrets.fit(docs)
    found = secrets.scan(docs, forest).select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*").toPandas()
    assert found[(found.doc_id >= 10_000) & found.value.str.match("^[0-9a-f]{20}$")].secret.all()
    assert not found[found.value.str.match("^[a-z]+$")].secret.any() and not found[found.value.str.match("^[0-9]{16}$")].secret.any()
    clean = secrets.redact(docs, forest)
    assert clean.columns == docs.columns
    rows = {r.doc_id: r for r in clean.collect()}
    assert rows[10_000].found == 1 and rows[10_000].f == "x"
    assert "[SECRET]" in rows[10_000].text and rows[10_000].n_chars == len(rows[10_000].text)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, 0), (3, "AKIA" + "Q1" * 8 + " " + "z" * 100_000, None, None, 1), (3, "k", None, None, 1)], DOCS)
    assert secrets.redact(odd, forest).count() == 4 and secrets.redact(odd.limit(0), forest).count() == 0
    empty = secrets.fit(odd.limit(0))
    assert secrets.scan(odd, empty).where(F.exists("found", lambda c: c["secret"])).count() == 0


def test_forest_on_left_out_findings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    forest = secrets.fit(docs.where(~fold))
    precision, recall = secrets.quality(secrets.made_findings(docs.where(fold), "doc_id", secrets.MADE), forest)
    assert precision > 0.95 and recall > 0.95
    precision, recall = secrets.quality(secrets.made_findings(docs.where(fold), "doc_id", secrets.LEFT_OUT), forest)
    assert precision > 0.8 and recall > 0.8
    texts = ["password=hunter2!x and", 'my pwd: "Tr0ub4dor&3" ok', "commit 0a1b2c3d4e5f60718293a4b5c6d7e8f901234567 fixed", "secret = ", None]
    found = secrets.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), forest).orderBy("doc_id").collect()
    assert [[c.value for c in r.found] for r in found] == [["hunter2!x"], ["Tr0ub4dor&3"], ["0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"], [], []]
    assert not found[2].found[0].secret


def test_forest_equals_a_plain_one(spark):
    rng = np.random.default_rng(12)
    rows = [(i, *(float(v) for v in rng.integers(0, 60, len(secrets.FEATURES)))) for i in range(300)]
    names = ", ".join(f"{f} double" for f in secrets.FEATURES)
    df = spark.createDataFrame([(i, tuple(v), int(v[0] + v[1] > 50)) for i, *v in rows], f"id long, f struct<{names.replace(' double', ':double')}>, y int")
    forest = secrets.grow(df, trees=3, depth=3)
    got = {r.id: r.s for r in df.select("id", secrets.forest_score(forest, F.col("f")).alias("s")).collect()}
    for i, *v in rows:
        f, total = dict(zip(secrets.FEATURES, v)), 0.0
        for splits, probs in forest:
            node = 1
            while node in splits:
                name, at = splits[node]
                node = 2 * node + (f[name] >= at)
            total += round(probs[node], 6)
        assert abs(got[i] - total / 3) < 1e-5
    assert np.mean([(got[i] >= 0.5) == (v[0] + v[1] > 50) for i, *v in rows]) > 0.8


def test_forest_from_labelled_findings(spark):
    rows = [("0123456789abcdef" if i % 2 else "internationalisations", "x password=" if i % 2 else "some ", " end", i % 2) for i in range(200)]
    forest = secrets.fit(None, findings=spark.createDataFrame(rows, "value string, lead string, trail string, y int"))
    assert any(splits for splits, _ in forest)


def test_no_python_in_native_plans(spark):
    for q in (queries.op5_proportional_fitting, queries.op10_random_forest):
        plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.cut(stage(spark, docs, SF))
        assert docs.columns == before.columns, name
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(last.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()} and last.exact.all()


def test_oracles_agree_with_queries(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.SQL.items():
        df = getattr(queries, name)(spark, SF)
        want = con.sql(sql).df()[sorted(df.columns)]
        got = df.toPandas()[sorted(df.columns)]
        key = want.columns[list(want.columns).index("record_id" if "record_id" in want else "doc_id")]
        pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True).astype(str), want.sort_values(key, ignore_index=True).astype(got.dtypes.to_dict(), errors="ignore").astype(str))
