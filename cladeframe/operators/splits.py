"""Splits of trees: every edge divides the leaves in two.

A set of leaves is known by the exclusive-or of its names' 64-bit hashes, two independent ones (128 bits). A clade's
value is the difference of two running values over leaf ranks, and the other side's that of all leaves, so no leaf
sets are ever listed. The canonical key of a split is the smaller side: trees need no common root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.lineage import materialise


def keyed(nodes: DataFrame) -> DataFrame:
    """JT19, JT22: nodes with clade (rooted key) and split (unrooted key), and leaves and total counts."""
    leaf = nodes.where("is_leaf").select("tree_id", F.col("leaf_lo").alias("r"), F.xxhash64("name").alias("h1"), F.xxhash64(F.lit(7), "name").alias("h2"))
    w = Window.partitionBy("tree_id").orderBy("r")
    run = leaf.select("tree_id", "r", F.expr("bit_xor(h1)").over(w).alias("x1"), F.expr("bit_xor(h2)").over(w).alias("x2"))
    every = run.groupBy("tree_id").agg(F.max_by("x1", "r").alias("a1"), F.max_by("x2", "r").alias("a2"), (F.max("r") + 1).alias("total"))
    hi = run.withColumnsRenamed({"r": "leaf_hi", "x1": "hi1", "x2": "hi2"})
    lo = run.select("tree_id", (F.col("r") + 1).alias("leaf_lo"), F.col("x1").alias("lo1"), F.col("x2").alias("lo2"))
    n = nodes.join(hi, ["tree_id", "leaf_hi"]).join(lo, ["tree_id", "leaf_lo"], "left").join(every, "tree_id")
    side = lambda k: F.col(f"hi{k}").bitwiseXOR(F.coalesce(f"lo{k}", F.lit(0)))
    mine = F.struct(side(1).alias("x"), side(2).alias("y"))
    rest = F.struct(side(1).bitwiseXOR(F.col("a1")).alias("x"), side(2).bitwiseXOR(F.col("a2")).alias("y"))
    n = n.withColumn("clade", mine).withColumn("split", F.least(mine, rest)).withColumn("leaves", F.col("leaf_hi") - F.col("leaf_lo") + 1)
    return n.drop("hi1", "hi2", "lo1", "lo2", "a1", "a2")


def splits(nodes: DataFrame, inner_only: bool = True) -> DataFrame:
    """JT19: distinct splits (tree_id, split); inner_only: at least two leaves on either side."""
    k = keyed(nodes).where("parent_id is not null")
    return (k.where("leaves > 1 and total - leaves > 1") if inner_only else k).select("tree_id", "split").distinct()


def same_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """JT7, ST5: (tree_id, same) for trees of both tables."""
    roots = lambda t, n: keyed(t).where("parent_id is null").select("tree_id", F.struct("clade", "total").alias(n))
    return roots(a, "x").join(roots(b, "y"), "tree_id").select("tree_id", (F.col("x") == F.col("y")).alias("same"))


def same_topology(a: DataFrame, b: DataFrame) -> DataFrame:
    """JT18: (tree_id, same): the rooted clades are the same sets."""
    clades = lambda t: keyed(t).select("tree_id", "clade").distinct()
    x, y = clades(a).withColumn("in_a", F.lit(1)), clades(b).withColumn("in_b", F.lit(1))
    both = x.join(y, ["tree_id", "clade"], "full")
    return both.groupBy("tree_id").agg((F.sum((F.col("in_a").isNull() | F.col("in_b").isNull()).cast("int")) == 0).alias("same"))


def shared_splits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Splits of both trees of one id, and of each alone: (tree_id, shared, only_a, only_b)."""
    x, y = splits(a).withColumn("in_a", F.lit(1)), splits(b).withColumn("in_b", F.lit(1))
    both = x.join(y, ["tree_id", "split"], "full")
    n = lambda c: F.sum(c.cast("long"))
    return both.groupBy("tree_id").agg(n(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("shared"), n(F.col("in_b").isNull()).alias("only_a"), n(F.col("in_a").isNull()).alias("only_b"))


def edge_support(reference: DataFrame, trees: DataFrame) -> DataFrame:
    """AG10, JT9: inner edges of reference trees with support: the share of `trees` that have the split.

    reference and trees share `family`: (family, …node table).
    """
    fam = lambda t: keyed(t.withColumn("tree_id", F.struct("family", "tree_id"))).withColumn("family", F.col("tree_id.family"))
    ref = fam(reference).where("parent_id is not null and leaves > 1 and total - leaves > 1")
    all_trees = trees.select("family", "tree_id").distinct().groupBy("family").agg(F.count("*").alias("trees"))
    held = fam(trees).where("parent_id is not null").select("family", "tree_id", "split").distinct().groupBy("family", "split").agg(F.count("*").alias("held"))
    out = ref.join(held, ["family", "split"], "left").join(all_trees, "family", "left")
    return out.select("family", F.col("tree_id.tree_id").alias("tree_id"), "node_id", (F.coalesce("held", F.lit(0)) / F.col("trees")).alias("support"))


def relabel_edges(source: DataFrame, target: DataFrame, key: str = "split") -> DataFrame:
    """JN6, JN7: (tree_id, edge_num, to_edge): edges of source trees and the edge with the same split in target.

    source: node table with edge_num; target: node table of one tree with edge_num. An edge without a partner gives
    null; the merger reports it. At a binary root both edges are one split: the smaller number counts.
    """
    to = keyed(target).where("edge_num is not null").groupBy(key).agg(F.min("edge_num").alias("to_edge"))
    return keyed(source).where("edge_num is not null").select("tree_id", "edge_num", key).join(to, key, "left").select("tree_id", "edge_num", "to_edge")


def transfer_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN10: new trees with the inner names of old ones where the split exists; `missed` marks old names without one."""
    named = keyed(old).where("not is_leaf and name is not null and parent_id is not null").groupBy("tree_id", "split").agg(F.min("name").alias("old_name"))
    k = keyed(new)
    return k.join(named, ["tree_id", "split"], "left").withColumn("name", F.when(F.col("is_leaf"), F.col("name")).otherwise(F.coalesce("old_name", "name"))).drop("old_name")


def missed_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN10: old inner names whose split the new tree lacks."""
    named = keyed(old).where("not is_leaf and name is not null and parent_id is not null").select("tree_id", "split", "name")
    return named.join(keyed(new).where("parent_id is not null").select("tree_id", "split"), ["tree_id", "split"], "left_anti").select("tree_id", "name")


def incompatible_clusters(a: DataFrame, b: DataFrame) -> DataFrame:
    """AG11, JT13: (tree_id, incompatible): inner clades of a that overlap one of b without either holding the other.

    Ranks of leaves in a turn every clade of b into a range of ranks, which the clade of a where its ends meet is the
    smallest to hold. The clades of b inside one of a are therefore sums over a's clades, and so are the parents of the
    largest of them: each clade adds its parent once and takes back its own number for each of its children. A clade of a
    has no conflict iff all largest clades of b inside it have one parent, which is so iff count times sum of squares is
    the square of the sum. Leaves of a that b lacks make a clade of a only compatible if that parent is b's root; a clade
    of b with leaves that a lacks is inside none.
    """
    from cladeframe.operators import ranges, trees

    x, y = materialise(a.select("tree_id", "node_id", "parent_id", "name", "is_leaf", "leaf_lo", "leaf_hi")), materialise(b.select("tree_id", "node_id", "parent_id", "name", "is_leaf", "leaf_lo", "leaf_hi"))
    rank = x.where("is_leaf").select("tree_id", "name", F.col("leaf_lo").alias("v"))
    leaf = y.where("is_leaf").join(rank, ["tree_id", "name"], "left").join(x.select("tree_id").distinct(), "tree_id", "left_semi").select("tree_id", F.col("leaf_lo").alias("r"), F.coalesce("v", F.lit(1 << 30)).alias("v"))
    tall, low = ranges.sparse(leaf), ranges.sparse(leaf.withColumn("v", -F.col("v")))
    hull = ranges.largest(low, ranges.largest(tall, y, "leaf_lo", "leaf_hi", "mx"), "leaf_lo", "leaf_hi", "mn").withColumn("mn", -F.col("mn"))
    kids = y.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("k"))
    held = hull.where(F.col("mx") < (1 << 30)).join(kids, ["tree_id", "node_id"], "left")
    met = trees.meetings(x.withColumn("dist", F.lit(0.0)))
    wide = ranges.largest(met, held.where("mn < mx").withColumn("to", F.col("mx") - 1), "mn", "to", "v").withColumn("at", F.col("v.node_id")).drop("v", "to")
    tips = held.where("mn = mx").join(x.where("is_leaf").select("tree_id", F.col("leaf_lo").alias("mn"), F.col("node_id").alias("at")), ["tree_id", "mn"])
    big = lambda c: F.col(c).cast("decimal(38,0)")
    p, own, k = big("parent_id"), big("node_id"), F.coalesce("k", F.lit(0)).cast("decimal(9,0)")
    add = lambda v, mine: (F.coalesce(v, F.lit(0)) - k * mine).cast("decimal(38,0)")
    one = F.when(F.col("parent_id").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("decimal(38,0)")
    sums = [(one - k).cast("decimal(38,0)").alias("c"), add(p, own).alias("s"), add((p * p).cast("decimal(38,0)"), (own * own).cast("decimal(19,0)")).alias("q")]
    put = wide.unionByName(tips.select(*wide.columns)).select("tree_id", F.col("at").alias("node_id"), *sums).groupBy("tree_id", "node_id").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    zero = F.lit(0).cast("decimal(38,0)")
    mass = x.join(put, ["tree_id", "node_id"], "left").select("tree_id", "node_id", "parent_id", *[F.coalesce(F.col(n).cast("decimal(38,0)"), zero).alias(n) for n in ("c", "s", "q")])
    known = F.when(F.col("is_leaf"), F.lit(1)).otherwise(F.lit(0))
    have = x.join(y.where("is_leaf").select("tree_id", "name", F.lit(True).alias("_there")), ["tree_id", "name"], "left").select("tree_id", "node_id", known.alias("all_"), F.when(F.col("_there"), known).otherwise(F.lit(0)).alias("there"))
    total = ranges.clade_sums(mass.join(have, ["tree_id", "node_id"]), "node_id", "parent_id", ["c", "s", "q", "all_", "there"])
    root = y.where("parent_id is null").select("tree_id", F.col("node_id").cast("decimal(38,0)").alias("root"))
    inner = x.where("not is_leaf and parent_id is not null").select("tree_id", "node_id").join(total, ["tree_id", "node_id"]).join(root, "tree_id")
    spread = F.col("c").cast("decimal(12,0)") * F.col("q").cast("decimal(26,0)") != F.col("s").cast("decimal(19,0)") * F.col("s").cast("decimal(19,0)")
    alien = (F.col("there") < F.col("all_")) & (F.col("s") != F.col("c").cast("decimal(12,0)") * F.col("root").cast("decimal(12,0)"))
    bad = inner.where((F.col("there") > 0) & (spread | alien)).groupBy("tree_id").agg(F.count("*").alias("incompatible"))
    return x.select("tree_id").distinct().join(bad, "tree_id", "left").select("tree_id", F.coalesce("incompatible", F.lit(0)).alias("incompatible"))


def tree_of_clusters(clusters: DataFrame) -> DataFrame:
    """JT12: parent of each cluster (set_id, cluster_id, name): the smallest strict superset; null at the top.

    In the list of a leaf's clusters by size the next larger one is the parent, if the clusters make a tree: then all
    leaves of a cluster name the same. Where they do not, or two different clusters of one size share a leaf, the set is
    incompatible, which is an error. Clusters of equal leaves are one; each gets a row. Rows are as many as memberships.
    """
    member = clusters.select("set_id", "cluster_id", "name").distinct()
    mark = lambda seed: F.expr(f"bit_xor(xxhash64({seed}, name))")
    size = materialise(member.groupBy("set_id", "cluster_id").agg(F.count("*").alias("n"), F.struct(mark(1), mark(2)).alias("leaves")))
    first = size.groupBy("set_id", "n", "leaves").agg(F.min("cluster_id").alias("cluster_id"))
    w = Window.partitionBy("set_id", "name").orderBy(F.desc("n"), "cluster_id")
    at = member.join(first, ["set_id", "cluster_id"]).withColumn("up", F.lag(F.struct("cluster_id", "n")).over(w))
    named = at.groupBy("set_id", "cluster_id").agg(F.min("up.cluster_id").alias("lo"), F.max("up.cluster_id").alias("hi"), F.count("up.cluster_id").alias("c"), F.count("*").alias("m"), F.max((F.col("up.n") == F.col("n")).cast("int")).alias("even"))
    odd = (F.col("c") > 0) & ((F.col("lo") != F.col("hi")) | (F.col("c") < F.col("m"))) | (F.coalesce("even", F.lit(0)) > 0)
    kind = clusters.schema["cluster_id"].dataType
    parent = F.when(odd, F.raise_error(F.lit("incompatible clusters")).cast(kind)).otherwise(F.col("lo"))
    up = first.join(named.select("set_id", "cluster_id", parent.alias("parent_id")), ["set_id", "cluster_id"]).select("set_id", "n", "leaves", "parent_id")
    return size.join(up, ["set_id", "n", "leaves"]).select("set_id", "cluster_id", "n", "parent_id")


def shared_clades(a: DataFrame, b: DataFrame) -> DataFrame:
    """JT33: (tree_id, node_id, leaves): the largest clades of a that have the very same subtree in b.

    A subtree is the same iff the clades of all its nodes are clades of the other tree. One pass over the closure
    finds the nodes without a foreign clade below; the topmost of them are collapsed.
    """
    from cladeframe.operators.trees import ancestors

    k = materialise(keyed(a))
    other = keyed(b).select("tree_id", "clade", F.lit(True).alias("known")).distinct()
    at = k.join(other, ["tree_id", "clade"], "left")
    up = materialise(ancestors(a).drop("via"))
    bad = up.join(at.where("known is null").select("tree_id", "node_id"), ["tree_id", "node_id"]).select("tree_id", F.col("anc").alias("node_id")).distinct()
    fine = materialise(k.join(bad, ["tree_id", "node_id"], "left_anti").select("tree_id", "node_id", "parent_id", "leaves"))
    top = fine.join(fine.select("tree_id", F.col("node_id").alias("parent_id")), ["tree_id", "parent_id"], "left_anti")
    return top.where("leaves > 1").select("tree_id", "node_id", "leaves")


def collapse(nodes: DataFrame, clades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JT33: nodes with each of clades (tree_id, node_id) as one leaf named "__" and its sorted leaf names joined by
    "_", and the table (tree_id, name, leaf) that undoes it."""
    from cladeframe.operators.trees import ancestors, renumber

    inside = ancestors(nodes).drop("via").join(clades.select("tree_id", F.col("node_id").alias("anc")), ["tree_id", "anc"])
    leaf = inside.join(nodes.where("is_leaf").select("tree_id", "node_id", F.col("name").alias("leaf")), ["tree_id", "node_id"])
    named = leaf.groupBy("tree_id", F.col("anc").alias("node_id")).agg(F.concat(F.lit("__"), F.array_join(F.array_sort(F.collect_list("leaf")), "_")).alias("new"))
    undo = leaf.select("tree_id", F.col("anc").alias("node_id"), "leaf").join(named, ["tree_id", "node_id"]).select("tree_id", F.col("new").alias("name"), "leaf")
    gone = inside.where("node_id <> anc").select("tree_id", "node_id").distinct()
    left = nodes.join(gone, ["tree_id", "node_id"], "left_anti").join(named, ["tree_id", "node_id"], "left")
    w = Window.partitionBy("tree_id").orderBy("leaf_lo")
    tips = left.where(F.col("new").isNotNull() | F.col("is_leaf")).select("tree_id", "node_id", (F.row_number().over(w) - 1).cast("int").alias("r"))
    span = tips.join(ancestors(nodes).drop("via"), ["tree_id", "node_id"]).groupBy("tree_id", F.col("anc").alias("node_id")).agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    out = left.join(span, ["tree_id", "node_id"]).select("tree_id", F.coalesce("new", "name").alias("name"), "length", F.col("lo").alias("leaf_lo"), F.col("hi").alias("leaf_hi"))
    return renumber(out), undo


def all_clusters(taxa: DataFrame) -> DataFrame:
    """JT14: (set_id, cluster_id, name): every subset of 2 to n - 1 of the names of a set, for small sets (n <= 16).

    cluster_id is the bit mask of the names in order.
    """
    w, every = Window.partitionBy("set_id").orderBy("name"), Window.partitionBy("set_id")
    t = taxa.withColumn("bit", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(every))
    small = F.when(F.col("n") > 16, F.raise_error(F.lit("too many taxa for all clusters")).cast("int")).otherwise(F.col("n"))
    mask = t.withColumn("cluster_id", F.explode(F.expr("sequence(1, cast(power(2, least(n, 16)) as int) - 1)"))).withColumn("n", small)
    inside = mask.where((F.bit_count("cluster_id") > 1) & (F.bit_count("cluster_id") < F.col("n")) & (F.expr("getbit(cluster_id, bit)") == 1))
    return inside.select("set_id", "cluster_id", "name")
