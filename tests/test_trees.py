"""Tree operators without closures: against brute force on random trees, and in closed form on very deep and wide ones."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cladeframe.functions import ordinals
from cladeframe.functions.lineage import materialise
from cladeframe.operators import decompose, resolutions, splits, trees
from cladeframe.sources import newick


def parse(spark, *texts):
    return materialise(newick.parse(spark.createDataFrame(list(enumerate(texts)), "tree_id int, newick string")))


def nested(rng, names):
    """A random tree of names as nested lists, with polytomies and a few unary nodes."""
    parts = list(names)
    while len(parts) > 1:
        k = min(len(parts), rng.choice([2, 2, 3, 4]))
        picked = [parts.pop(rng.randrange(len(parts))) for _ in range(k)]
        parts.append([picked] if rng.random() < 0.1 else picked)
    return parts[0]


def text(t, rng):
    body = "(" + ",".join(text(c, rng) for c in t) + ")" if isinstance(t, list) else t
    return f"{body}:{rng.randint(0, 9)}"


def leaf_sets(nodes):
    """{node_id: set of leaf names} and the parents of one tree's rows."""
    up = {r.node_id: r.parent_id for r in nodes}
    out = {n: set() for n in up}
    for r in nodes:
        if r.is_leaf:
            at = r.node_id
            while at is not None:
                out[at].add(r.name)
                at = up[at]
    return out, up


def random_trees(spark, rng, sizes, names=lambda n: [f"t{i}" for i in range(n)]):
    texts = [text(nested(rng, names(n)), rng).rsplit(":", 1)[0] + ";" for n in sizes]
    return parse(spark, *texts)


def test_node_tables_match_a_plain_walk(spark):
    rng = random.Random(5)
    t = random_trees(spark, rng, (1, 2, 7, 15, 24))
    again = materialise(trees.from_parents(t.select("tree_id", (F.col("node_id") * 7 + 3).alias("node"), (F.col("parent_id") * 7 + 3).alias("parent"), "child_ord", "name", "length")))
    cols = ["tree_id", "node_id", "parent_id", "child_ord", "name", "is_leaf", "leaf_lo", "leaf_hi"]
    assert sorted(map(str, again.select(*cols).collect())) == sorted(map(str, t.select(*cols).collect()))
    depth = {(r.tree_id, r.node_id): (r.depth, r.height) for r in trees.shape(t).collect()}
    for tid in range(5):
        rows = t.where(F.col("tree_id") == tid).collect()
        sets, up = leaf_sets(rows)
        down = lambda n: 0 if up[n] is None else 1 + down(up[n])
        leaf = {r.node_id for r in rows if r.is_leaf}
        for r in rows:
            assert r.leaf_hi - r.leaf_lo + 1 == len(sets[r.node_id])
            below = [down(x.node_id) for x in rows if x.node_id in leaf and x.name in sets[r.node_id]]
            assert depth[tid, r.node_id] == (down(r.node_id), max(below) - down(r.node_id))


def test_ancestors_of_pairs_and_sets(spark):
    rng = random.Random(6)
    t = random_trees(spark, rng, (2, 9, 20))
    rows = {tid: t.where(F.col("tree_id") == tid).collect() for tid in range(3)}
    pairs, sets, want, want_set = [], [], {}, {}

    def lowest(tid, members):
        up = {r.node_id: r.parent_id for r in rows[tid]}
        path = lambda n: [n, *(path(up[n]) if up[n] is not None else [])]
        return min(set.intersection(*[set(path(m)) for m in members]))

    for tid in rows:
        ids = [r.node_id for r in rows[tid]]
        for _ in range(40):
            a, b = rng.choice(ids), rng.choice(ids)
            pairs.append((tid, a, b))
            want[tid, a, b] = lowest(tid, [a, b])
        for k in range(15):
            own = [rng.choice(ids) for _ in range(rng.choice([1, 2, 3, 6]))]
            sets += [(tid, k, n) for n in own]
            want_set[tid, k] = lowest(tid, own)
    got = trees.lca_pairs(t, spark.createDataFrame([*pairs, (0, 999, 0)], "tree_id int, a int, b int")).collect()
    assert {(r.tree_id, r.a, r.b): r.lca for r in got} == want
    got = trees.lca_set(t, spark.createDataFrame([*sets, (0, 77, 999)], "tree_id int, set_id int, node_id int")).collect()
    assert {(r.tree_id, r.set_id): r.lca for r in got} == want_set


def caterpillar(spark, n):
    """Leaves 0 to n - 1; inner node n + k joins all up to leaf k; edges of length 1."""
    leaf = spark.range(n).select(F.lit("deep").alias("tree_id"), F.col("id").alias("node"), (n + F.greatest("id", F.lit(1))).alias("parent"), (F.col("id") > 0).cast("int").alias("child_ord"), F.col("id").cast("string").alias("name"))
    inner = spark.range(1, n).select(F.lit("deep").alias("tree_id"), (n + F.col("id")).alias("node"), F.when(F.col("id") < n - 1, n + F.col("id") + 1).alias("parent"), F.lit(0).alias("child_ord"), F.lit(None).cast("string").alias("name"))
    star = spark.range(n).select(F.lit("wide").alias("tree_id"), F.col("id").alias("node"), F.lit(n).cast("long").alias("parent"), F.col("id").cast("int").alias("child_ord"), F.col("id").cast("string").alias("name"))
    root = spark.range(1).select(F.lit("wide").alias("tree_id"), F.lit(n).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("child_ord"), F.lit(None).cast("string").alias("name"))
    return materialise(trees.from_parents(leaf.unionByName(inner).unionByName(star).unionByName(root).withColumn("length", F.when(F.col("parent").isNotNull(), 1.0))))


def test_very_deep_and_very_wide_trees(spark):
    n = 1500
    t = caterpillar(spark, n)
    at = {(r.tree_id, r.node): r for r in t.collect()}
    assert all(at["deep", k].leaf_lo == k and at["deep", n + k].leaf_hi == k and at["deep", n + k].leaf_lo == 0 for k in range(1, n))
    assert {r.tree_id: r.diameter for r in trees.diameter(t).collect()} == {"deep": n, "wide": 2.0}
    pairs = [(name, at[name, i].node_id, at[name, j].node_id) for name in ("deep", "wide") for i, j in ((0, 1), (0, n - 1), (5, 700), (700, 701), (n - 2, n - 1))]
    got = {(r.tree_id, r.a, r.b): r.lca for r in trees.lca_pairs(t, spark.createDataFrame(pairs, "tree_id string, a int, b int")).collect()}
    back = {(r.tree_id, r.node_id): r.node for r in at.values()}
    by_id = {(name, r.node_id): r.node for (name, _), r in at.items()}
    assert all(by_id[name, got[name, a, b]] == (n + max(back[name, a], back[name, b]) if name == "deep" else n) for name, a, b in pairs)
    mid = {r.tree_id: r for r in trees.midpoint_edge(t).collect()}
    assert by_id["deep", mid["deep"].node_id] in (n + n // 2 - 1, n + n // 2)
    groups = spark.createDataFrame([("0", "x"), ("1", "x"), ("3", "x"), ("9", "y")], "name string, group string")
    gsi = {(r.tree_id, r.group): r.gsi for r in trees.genealogical_index(t, groups).collect()}
    low = 2 / (n - 2)  # of n - 1 inner nodes all but the root have a degree of 3
    assert gsi["deep", "x"] == pytest.approx((2 / 3 - low) / (1 - low)) and gsi["deep", "y"] == -1


def conflicts(a, b, clades_of):
    bad = 0
    for node, (s, inner) in a.items():
        if inner and any(i and s & c and not s <= c and not c <= s for c, i in b.values()):
            bad += 1
    return bad


def test_conflicts_match_brute_force(spark):
    rng = random.Random(8)
    for missing in (0, 2):
        sizes = (4, 9, 9, 16, 16, 25)
        names = lambda n: [f"t{i}" for i in range(n)]
        other = lambda n: [f"t{i}" for i in range(missing, n)] + [f"u{i}" for i in range(missing)]
        x, y = random_trees(spark, rng, sizes, names), random_trees(spark, rng, sizes, other)
        got = {r.tree_id: r.incompatible for r in splits.incompatible_clusters(x, y).collect()}
        for tid in range(len(sizes)):
            sets = []
            for t in (x, y):
                rows = t.where(F.col("tree_id") == tid).collect()
                s, up = leaf_sets(rows)
                sets.append({r.node_id: (s[r.node_id], not r.is_leaf and r.parent_id is not None) for r in rows})
            assert got[tid] == conflicts(*sets, None), (tid, missing)


def test_tree_of_clusters_and_its_errors(spark):
    rng = random.Random(9)
    t = random_trees(spark, rng, (12,))
    s, up = leaf_sets(t.collect())
    kept = {frozenset(v): k for k, v in s.items() if len(v) > 1}
    rows = [(0, k, n) for v, k in kept.items() for n in v] + [(0, 1000 + k, n) for v, k in list(kept.items())[:2] for n in v]
    mk = lambda rows: spark.createDataFrame(rows, "set_id int, cluster_id int, name string")
    got = {r.cluster_id: (r.n, r.parent_id) for r in splits.tree_of_clusters(mk(rows)).collect()}
    for v, k in kept.items():
        larger = [w for w in kept if v < w]
        want = (len(v), kept[min(larger, key=len)] if larger else None)
        assert got[k] == want and got.get(1000 + k, want) == want
    for bad in ([(0, 1, "a"), (0, 1, "b"), (0, 2, "b"), (0, 2, "c")], [(0, 1, "a"), (0, 1, "b"), (0, 1, "d"), (0, 2, "b"), (0, 2, "c")]):
        with pytest.raises(Exception, match="incompatible clusters"):
            splits.tree_of_clusters(mk(bad)).collect()


def test_decomposition_rules(spark):
    rng = random.Random(10)
    t = random_trees(spark, rng, (30, 11))
    with pytest.raises(ValueError, match="midpoint and centroid"):
        decompose.decompose(t, 5, "longest", widest=1.0)
    got = decompose.decompose(t, 100, "midpoint", least=1, widest=12.0).collect()
    far = {(r.tree_id, frozenset((r.a, r.b))): r.d for r in trees.leaf_distances(t).collect()}
    ids = {(r.tree_id, r.name): r.node_id for r in t.where("is_leaf").collect()}
    for tid in (0, 1):
        by = {}
        for r in got:
            if r.tree_id == tid:
                by.setdefault(r.subset, []).append(ids[tid, r.name])
        assert all(far[tid, frozenset(p)] <= 12.0 for own in by.values() for p in itertools.combinations(own, 2))
    d = spark.createDataFrame([(k, a, b, 1.0 if (int(a[1:]) < 5) != (int(b[1:]) < 5) else 0.0) for k, n in ((0, 30), (1, 11)) for a, b in itertools.combinations([f"t{i}" for i in range(n)], 2)], "tree_id int, a string, b string, d double")
    parts = decompose.decompose(t, 100, farthest=0.0, distances=d).collect()
    sides = {}
    for r in parts:
        sides.setdefault((r.tree_id, r.subset), set()).add(int(r.name[1:]) < 5)
    assert all(len(v) == 1 for v in sides.values())


def test_ordinals_within_hot_keys(spark):
    rows = spark.range(5000).select((F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50)).alias("k"), (F.col("id") * 7919 % 5003).alias("o"), (F.col("id") % 5).alias("v"))
    for keys in (["k"], []):
        got = ordinals.running(ordinals.ordinal(rows, keys, ["o"], "i"), keys, ["o"], F.col("v"), "s").collect()
        by = {}
        for r in sorted(got, key=lambda r: r.o):
            n, s = by.get(r.k if keys else 0, (0, 0))
            assert (r.i, r.s) == (n, s)
            by[r.k if keys else 0] = (n + 1, s + r.v)
    assert ordinals.ordinal(rows.limit(0), [], ["o"], "i").count() == 0


def test_all_binary_trees_are_different_and_whole(spark):
    sets = spark.createDataFrame([(n, f"t{i}") for n in range(1, 8) for i in range(n)] + [(2, None), (3, "t0")], "set_id int, name string")
    got = {}
    for r in resolutions.all_trees(sets).collect():
        got.setdefault(r.set_id, []).append(frozenset(r.clades))
    for n in range(1, 8):
        assert len(got[n]) == len(set(got[n])) == resolutions.count_of_trees(n)
        for t in got[n]:
            assert len(t) == 2 * n - 1 and all(not a & b or a & b in (a, b) for a in t for b in t)
    assert resolutions.count_of_trees(8) == 135135
    with pytest.raises(Exception, match="too many"):
        resolutions.all_trees(spark.createDataFrame([(0, f"t{i}") for i in range(13)], "set_id int, name string")).collect()


def test_resolutions_and_unions_of_polytomies(spark):
    t = parse(spark, "((a,b,c),(d,e),f,g);", "((a,b),c);")
    got = {}
    for r in resolutions.all_resolutions(t).collect():
        got.setdefault((r.tree_id, r.number), set()).add((r.node_id, r.children))
    assert len(got) == 3 * 15 and len({frozenset(v) for v in got.values()}) == 45 and all(k[0] == 0 for k in got)
    assert all(len(v) == 1 + 2 for v in got.values())
    u = resolutions.unions(t).collect()
    k = {r.node_id: r for r in splits.keyed(t.where("tree_id = 0")).collect()}
    assert len(u) == 3 + 10 and {r.tree_id for r in u} == {0}
    for r in u:
        kids = sorted((x for x in k.values() if x.parent_id == r.node_id), key=lambda x: x.child_ord)
        own = [x for i, x in enumerate(kids) if r.children >> i & 1]
        x, y = 0, 0
        for c in own:
            x, y = x ^ c.clade.x, y ^ c.clade.y
        assert (r.clade.x, r.clade.y, r.leaves) == (x, y, sum(c.leaves for c in own))


def test_rootings_match_rerooted_trees(spark):
    rng = random.Random(12)
    t = random_trees(spark, rng, (9,))
    far = {(r.a, r.b): r.d for r in trees.leaf_distances(t).collect()}
    rows = {r.node_id: r for r in t.collect()}
    s, up = leaf_sets(rows.values())
    ids = {r.name: n for n, r in rows.items() if r.is_leaf}
    for r in resolutions.directed(t).orderBy("node_id").collect()[::5]:
        rooted = materialise(trees.from_parents(trees.reroot(t, spark.createDataFrame([(0, r.node_id)], "tree_id int, node_id int"))))
        deep = {x.name: x.dist for x in trees.root_distance(rooted).where("is_leaf").collect()}
        below, above = [deep[n] for n in s[r.node_id]], [deep[n] for n in ids if n not in s[r.node_id]]
        assert (r.below_leaves, r.above_leaves) == (len(below), len(above))
        assert r.below_far == pytest.approx(max(below)) and r.above_far == (pytest.approx(max(above)) if above else None)


def test_files_of_a_placement_run(spark, tmp_path):
    from cladeframe.plans import outputs, pipelines

    merged = spark.createDataFrame([("b", 0, "A"), ("b", 1, "c"), ("a", 2, "G"), ("c", 1, "t")], "name string, pos int, ch string")
    cols = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 2)], "anchor int, ord int, pos int")
    p = spark.createDataFrame([("d", "a", 3, -1.0, 1.0, 0.5, 0.25)], "doc_id string, fragment string, edge_num int, likelihood double, lwr double, distal_length double, pendant_length double")
    labels = spark.createDataFrame([("x y", "nodeN000001x_y")], "name string, safe string")
    outputs.write(outputs.placement_files(merged, cols, p, labels), str(tmp_path))
    outputs.write(outputs.alignment_files(merged, cols).where("file = 'insertion_columns.txt'"), str(tmp_path))
    text = lambda name: "".join(q.read_text() for q in sorted((tmp_path / name).glob("part-*")))
    assert text("alignment.fasta") == ">a\n--G\n>b\nAc-\n>c\n-t-\n" and text("alignment_masked.fasta") == ">a\n-G\n>b\nA-\n>c\n--\n"
    assert text("insertion_columns.txt") == "1-1\n" and text("rename.tsv") == "nodeN000001x_y\tx y\n" and '"n":["a"]' in text("placement.json")
    with pytest.raises(ValueError, match="midpoint and centroid"):
        pipelines.Options(strategy="longest", widest=0.1).check()
    assert pipelines.Options(strategy="midpoint", widest=0.1).check().strategy == "midpoint"
