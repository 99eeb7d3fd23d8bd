"""Tree operators on node tables: (tree_id, node_id, parent_id, child_ord, name, length, is_leaf, leaf_lo, leaf_hi).

Node ids are in postorder and leaf_lo..leaf_hi, ranks of leaves in that order, are the clade of a node. Hence a node
is above another iff its interval holds the other's, and sums over paths are running sums over interval ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.lineage import materialise
from cladeframe.operators import ranges


def from_parents(nodes: DataFrame) -> DataFrame:
    """Node table with postorder ids and leaf ranks from (tree_id, node, parent, child_ord, name, length).

    Leaves and nodes of every clade are summed upwards; what older siblings hold, summed downwards, tells where a clade
    begins. Both take one equi-join of all nodes a round, and as many rounds as the logarithm of the depth.
    """
    inner = nodes.where("parent is not null").select("tree_id", F.col("parent").alias("node"), F.lit(False).alias("_l")).distinct()
    at = materialise(nodes.join(inner, ["tree_id", "node"], "left").withColumn("is_leaf", F.coalesce("_l", F.lit(True))).drop("_l"))
    held = ranges.clade_sums(at.withColumn("leaves", F.col("is_leaf").cast("int")).withColumn("size", F.lit(1)), "node", "parent", ["leaves", "size"])
    w = Window.partitionBy("tree_id", "parent").orderBy("child_ord", "node").rowsBetween(Window.unboundedPreceding, -1)
    older = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("int").alias(f"{c}_before")
    both = at.join(held, ["tree_id", "node"]).where("parent is not null").select("tree_id", "node", "parent", older("leaves"), older("size"))
    tops = at.where("parent is null").select("tree_id", "node", "parent", F.lit(0).alias("leaves_before"), F.lit(0).alias("size_before"))
    begin = ranges.path_sums(both.unionByName(tops), "node", "parent", ["leaves_before", "size_before"])
    out = at.join(held, ["tree_id", "node"]).join(begin, ["tree_id", "node"]).withColumn("node_id", (F.col("size_before") + F.col("size") - 1).cast("int"))
    out = materialise(out.withColumn("leaf_lo", F.col("leaves_before").cast("int")).withColumn("leaf_hi", (F.col("leaves_before") + F.col("leaves") - 1).cast("int")))
    ids = out.select("tree_id", F.col("node").alias("parent"), F.col("node_id").alias("parent_id"))
    out = out.join(ids, ["tree_id", "parent"], "left")
    return out.select("tree_id", "node_id", "parent_id", F.when(F.col("parent_id").isNotNull(), F.col("child_ord")).alias("child_ord"), "name", "length", "is_leaf", "leaf_lo", "leaf_hi", "node")


def leaf_counts(nodes: DataFrame) -> DataFrame:
    """AG7, TR15, JT3: nodes with leaves (below, itself included) and total (of its tree)."""
    w = Window.partitionBy("tree_id")
    return nodes.withColumn("leaves", F.col("leaf_hi") - F.col("leaf_lo") + 1).withColumn("total", F.max(F.col("leaf_hi") + 1).over(w))


def root_distance(nodes: DataFrame) -> DataFrame:
    """nodes with dist (sum of lengths from the root; none counts 0) and depth (edges), by running sums."""
    x = F.coalesce("length", F.lit(0.0))
    # Lengths open before a clade's first leaf and close after its last; a node's own distance is read where it opens.
    size = (F.col("leaf_hi") - F.col("leaf_lo")).alias("size")
    start = F.struct(F.col("leaf_lo").alias("at"), F.lit(1).alias("side"), (-F.col("node_id")).alias("o"), x.alias("d"), F.lit(1).alias("e"), F.col("node_id").alias("own"))
    stop = F.struct(F.col("leaf_hi").alias("at"), F.lit(2).alias("side"), F.col("node_id").alias("o"), (-x).alias("d"), F.lit(-1).alias("e"), F.lit(None).cast("int").alias("own"))
    ev = nodes.select("tree_id", size, F.explode(F.array(start, stop)).alias("v")).select("tree_id", "v.*")
    w = Window.partitionBy("tree_id").orderBy("at", "side", "o").rowsBetween(Window.unboundedPreceding, 0)
    got = ev.withColumn("dist", F.sum("d").over(w)).withColumn("depth", (F.sum("e").over(w) - 1).cast("int")).where("own is not null")
    return nodes.join(got.select("tree_id", F.col("own").alias("node_id"), "dist", "depth"), ["tree_id", "node_id"])


def breaking_edge(nodes: DataFrame, strategy: str = "centroid", least: int = 1) -> DataFrame:
    """TR1-TR4: the edge (node_id of its lower end) that divides each tree; trees without one give no row.

    centroid: both sides nearest to half of the leaves; longest: the longest edge; both only edges with at least
    `least` leaves on either side, the first in postorder wins. clade: the first child edge of a binary root.
    """
    n = leaf_counts(nodes).where("parent_id is not null")
    if strategy == "clade":
        roots = nodes.where("parent_id is null").select("tree_id", F.col("node_id").alias("root"))
        kids = n.join(roots, (n["tree_id"] == roots["tree_id"]) & (n["parent_id"] == roots["root"])).select(n["tree_id"], "node_id", "child_ord", "leaves", "total")
        return kids.groupBy("tree_id").agg(F.count("*").alias("k"), F.min_by(F.struct("node_id", "leaves", "total"), "child_ord").alias("b")).where("k = 2").select("tree_id", "b.*")
    fits = n.where((F.col("leaves") >= least) & (F.col("total") - F.col("leaves") >= least) & (F.col("total") > least))
    if strategy == "centroid":
        key = F.struct(F.abs(F.col("total") / 2 - F.col("leaves")).alias("off"), F.col("node_id").alias("o"))
    elif strategy == "longest":
        key = F.struct((-F.coalesce("length", F.lit(0.0))).alias("off"), F.col("node_id").alias("o"))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return fits.groupBy("tree_id").agg(F.min_by(F.struct("node_id", "leaves", "total"), key).alias("b")).select("tree_id", "b.*")


def adjacent_edges(nodes: DataFrame) -> DataFrame:
    """TR17: pairs of edges (by their lower ends) that share an end."""
    e = nodes.where("parent_id is not null").select("tree_id", F.col("node_id").alias("edge"), F.explode(F.array("node_id", "parent_id")).alias("at"))
    return e.join(e.withColumnRenamed("edge", "other"), ["tree_id", "at"]).where("edge <> other").select("tree_id", "edge", "other").distinct()


def ancestors(nodes: DataFrame, strict: bool = False) -> DataFrame:
    """Closure (tree_id, node_id, anc, via): every node above (and, unless strict, itself); via is the child of anc
    on the way. By doubling: round k joins what reaches exactly 2^k edges with all known, so the rounds are the
    logarithm of the depth and every join is an equi-join."""
    base = nodes.where("parent_id is not null").select("tree_id", "node_id", F.col("parent_id").alias("anc"), F.col("node_id").alias("via"), F.lit(1).alias("hops"))
    up, reach = materialise(base), 1
    while True:
        far = up.where(F.col("hops") == reach).select("tree_id", F.col("node_id").alias("low"), F.col("anc").alias("node_id"))
        more = far.join(up, ["tree_id", "node_id"]).select("tree_id", F.col("low").alias("node_id"), "anc", "via", (F.col("hops") + reach).alias("hops"))
        grown = materialise(up.unionByName(more))
        reach *= 2
        up, done = grown, not grown.where(F.col("hops") == reach).limit(1).count()
        if done:
            break
    up = up.drop("hops")
    own = nodes.select("tree_id", "node_id", F.col("node_id").alias("anc"), F.col("node_id").alias("via"))
    return up if strict else up.unionByName(own)


def meetings(at: DataFrame) -> DataFrame:
    """Sparse table of the nodes (node_id, dist) in which neighbouring leaves meet; at: nodes with dist.

    Of a node's children every one but the last ends at the leaf whose meeting with the next leaf that node is. Of any two
    leaves the lowest common ancestor is the largest, in postorder, of the meetings between them.
    """
    up = at.select("tree_id", F.col("node_id").alias("parent_id"), F.col("leaf_hi").alias("_hi"), F.struct("node_id", "dist").alias("v"))
    return ranges.sparse(at.join(up, ["tree_id", "parent_id"]).where("leaf_hi < _hi").select("tree_id", F.col("leaf_hi").alias("r"), "v"))


def lca_pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """JT32: lowest common ancestor of (tree_id, a, b), in four equi-joins whatever the depth.

    Either node may be the other's ancestor: its clade then holds the other's. Pairs with unknown nodes give no row.
    """
    at = nodes.select("tree_id", "node_id", "leaf_lo", "leaf_hi")
    x = at.toDF("tree_id", "a", "alo", "ahi")
    y = at.toDF("tree_id", "b", "blo", "bhi")
    both = materialise(pairs.select("tree_id", "a", "b").distinct().join(x, ["tree_id", "a"]).join(y, ["tree_id", "b"]))
    within = F.greatest("alo", "blo") <= F.least("ahi", "bhi")
    far = both.where(~within).select("tree_id", "a", "b", F.least("ahi", "bhi").alias("lo"), (F.greatest("alo", "blo") - 1).alias("hi"))
    met = ranges.largest(meetings(nodes.withColumn("dist", F.lit(0.0))), far, "lo", "hi", "v").select("tree_id", "a", "b", F.col("v.node_id").alias("lca"))
    return met.unionByName(both.where(within).select("tree_id", "a", "b", F.greatest("a", "b").alias("lca")))


def lca_set(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """JT32: lowest common ancestor of sets (tree_id, set_id, node_id): that of their first and last leaf, unless a member
    is above all others. Unknown members are ignored."""
    held = sets.join(nodes.select("tree_id", "node_id", "leaf_lo", "leaf_hi"), ["tree_id", "node_id"])
    top = F.max(F.struct("node_id", "leaf_lo", "leaf_hi"))  # in postorder, the only one that can be above all
    span = materialise(held.groupBy("tree_id", "set_id").agg(F.min("leaf_lo").alias("lo"), F.max("leaf_hi").alias("hi"), top.alias("t")))
    above = (F.col("t.leaf_lo") == F.col("lo")) & (F.col("t.leaf_hi") == F.col("hi"))
    far = span.where(~above).select("tree_id", "set_id", "lo", (F.col("hi") - 1).alias("hi"))
    met = ranges.largest(meetings(nodes.withColumn("dist", F.lit(0.0))), far, "lo", "hi", "v").select("tree_id", "set_id", F.col("v.node_id").alias("lca"))
    return met.unionByName(span.where(above).select("tree_id", "set_id", F.col("t.node_id").alias("lca")))


def leaf_distances(nodes: DataFrame) -> DataFrame:
    """JT1: (tree_id, a, b, d) of all leaf pairs a < b: both distances from the root less twice their meeting point's."""
    at = materialise(root_distance(nodes))
    leaves = at.where("is_leaf").select("tree_id", F.col("node_id").alias("n"), F.col("leaf_lo").alias("r"), "dist")
    a, b = leaves.withColumnsRenamed({"n": "a", "r": "lo", "dist": "da"}), leaves.withColumnsRenamed({"n": "b", "r": "hi", "dist": "db"})
    pairs = a.join(b, "tree_id").where("lo < hi").withColumn("hi", F.col("hi") - 1)
    return ranges.largest(meetings(at), pairs, "lo", "hi", "v").select("tree_id", "a", "b", (F.col("da") + F.col("db") - 2 * F.col("v.dist")).alias("d"))


def widest_nodes(at: DataFrame) -> DataFrame:
    """Of each tree the node (tree_id, node_id) on which the longest leaf-to-leaf path bends, that path's diameter, and its
    deeper end: anchor and its distance deep.

    at: nodes with dist. The deepest leaf of a clade is the largest of a range of leaves; no pairs of leaves are made, and
    of the children of a node only the two deepest meet. Of equals the first in postorder counts. Trees without two
    leaves give no row.
    """
    leaf = at.where("is_leaf").select("tree_id", F.col("leaf_lo").alias("r"), F.struct("dist", (-F.col("leaf_lo")).alias("o"), F.col("node_id").alias("leaf")).alias("v"))
    deep = ranges.largest(ranges.sparse(leaf), at.where("parent_id is not null").select("tree_id", "node_id", "parent_id", "leaf_lo", "leaf_hi"), "leaf_lo", "leaf_hi", "v")
    two = ranges.two_largest(deep.select("tree_id", "parent_id", "node_id", "v"), ["tree_id", "parent_id"], "v")
    both = two.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("c"), F.sum("v.dist").alias("s"), F.max("v").alias("v")).where("c = 2")
    bent = both.join(at.select("tree_id", "node_id", "dist"), ["tree_id", "node_id"]).withColumn("diameter", F.col("s") - 2 * F.col("dist"))
    best = F.max_by(F.struct("node_id", "diameter", F.col("v.leaf").alias("anchor"), F.col("v.dist").alias("deep")), F.struct("diameter", (-F.col("node_id")).alias("o")))
    return bent.groupBy("tree_id").agg(best.alias("b")).select("tree_id", "b.*")


def diameter(nodes: DataFrame) -> DataFrame:
    """JT10, TR11: longest leaf-to-leaf path of each tree; 0 for a single leaf."""
    some = widest_nodes(materialise(root_distance(nodes))).select("tree_id", "diameter")
    return nodes.select("tree_id").distinct().join(some, "tree_id", "left").select("tree_id", F.coalesce("diameter", F.lit(0.0)).alias("diameter"))


def nearest_taxa(nodes: DataFrame, k: int, d: DataFrame | None = None) -> DataFrame:
    """WN7: (tree_id, a, rank, b, d): the k nearest leaves of every leaf, ties by node id."""
    d = leaf_distances(nodes) if d is None else d
    both = d.unionByName(d.select("tree_id", F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    w = Window.partitionBy("tree_id", "a").orderBy("d", "b")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def long_branches(nodes: DataFrame, factor: float) -> DataFrame:
    """FLT6: leaves whose length exceeds factor times the upper median of their tree's leaf lengths; kept for all trees."""
    leaf = nodes.where("is_leaf and length is not null")
    w, every = Window.partitionBy("tree_id").orderBy("length", "node_id"), Window.partitionBy("tree_id")
    ranked = leaf.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(every))
    middle = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2), F.col("length"))).over(every)
    return ranked.withColumn("median", middle).where(F.col("length") > factor * F.col("median")).drop("_r", "_n")


def prune(nodes: DataFrame, leaves: DataFrame, keep: bool = True) -> DataFrame:
    """TR16, JT2, JT11, JT27: trees with only (or, keep=False, without) the leaves (tree_id, name); unary nodes go.

    What is left of a clade is known from its surviving leaves. Of nodes with the same surviving leaves only the
    lowest stays, with the lengths of those above it added, so no contraction loop is needed.
    """
    named = leaves.select("tree_id", "name", F.lit(1).alias("_in")).distinct()
    w = Window.partitionBy("tree_id").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    some = nodes.where("is_leaf").join(named, ["tree_id", "name"], "left").select("tree_id", F.col("leaf_lo").alias("r"), (F.coalesce("_in", F.lit(0)) if keep else 1 - F.coalesce("_in", F.lit(0))).alias("in_"))
    upto = materialise(some.withColumn("upto", F.sum("in_").over(w).cast("int")))
    # A clade's surviving leaves are those counted up to its last leaf and not before its first.
    lo = upto.select("tree_id", F.col("r").alias("leaf_lo"), (F.col("upto") - F.col("in_")).alias("lo"))
    hi = upto.select("tree_id", F.col("r").alias("leaf_hi"), (F.col("upto") - 1).alias("hi"))
    left = nodes.join(lo, ["tree_id", "leaf_lo"]).join(hi, ["tree_id", "leaf_hi"]).where("lo <= hi").select("tree_id", "node_id", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))
    at = nodes.join(left, ["tree_id", "node_id"]).withColumn("length", F.col("length"))
    same = at.groupBy("tree_id", "lo", "hi").agg(F.min_by(F.struct("node_id", "name", "is_leaf", "child_ord"), "node_id").alias("b"), F.sum("length").alias("length"), F.max("node_id").alias("top"))
    return renumber(same.select("tree_id", F.col("b.node_id").alias("old"), F.col("b.name").alias("name"), "length", F.col("lo").alias("leaf_lo"), F.col("hi").alias("leaf_hi")))


def renumber(clades: DataFrame) -> DataFrame:
    """Node table from distinct nested clades (tree_id, leaf_lo, leaf_hi, name, length); further columns are carried.

    In postorder a clade comes after all that end before it or lie inside it. Depths are running sums, and a clade's
    parent is the next later one whose depth is less by one: two windows, and no clades are compared in pairs.
    """
    w = Window.partitionBy("tree_id").orderBy("leaf_hi", F.desc("leaf_lo"))
    n = materialise(clades.withColumn("node_id", (F.row_number().over(w) - 1).cast("int")))
    depth = root_distance(n.select("tree_id", "node_id", "leaf_lo", "leaf_hi", F.lit(0.0).alias("length"))).select("tree_id", "node_id", "depth")
    roles = F.array(F.struct((F.col("depth") - 1).alias("l"), F.lit(False).alias("is_parent")), F.struct(F.col("depth").alias("l"), F.lit(True).alias("is_parent")))
    at = depth.select("tree_id", "node_id", F.explode(roles).alias("x")).select("tree_id", "node_id", "x.*")
    later = Window.partitionBy("tree_id", "l").orderBy("node_id", "is_parent").rowsBetween(1, Window.unboundedFollowing)
    up = at.withColumn("parent_id", F.min(F.when(F.col("is_parent"), F.col("node_id"))).over(later)).where("not is_parent and l >= 0").select("tree_id", "node_id", "parent_id")
    kids = Window.partitionBy("tree_id", "parent_id").orderBy("node_id")
    out = n.join(up, ["tree_id", "node_id"], "left").withColumn("child_ord", F.when(F.col("parent_id").isNotNull(), F.row_number().over(kids) - 1).cast("int"))
    return out.withColumn("is_leaf", F.col("leaf_lo") == F.col("leaf_hi")).withColumn("length", F.when(F.col("parent_id").isNotNull(), F.col("length")))


def bipartition(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """TR5-TR7: leaves (tree_id, name, below) by the side of their tree's edge (tree_id, node_id)."""
    e = nodes.join(edges.select("tree_id", "node_id"), ["tree_id", "node_id"]).select("tree_id", F.col("leaf_lo").alias("lo"), F.col("leaf_hi").alias("hi"))
    leaf = nodes.where("is_leaf").join(e, "tree_id")
    return leaf.select("tree_id", "name", F.col("leaf_lo").between(F.col("lo"), F.col("hi")).alias("below"))


def is_binary(nodes: DataFrame) -> DataFrame:
    """JT6"""
    kids = nodes.where("parent_id is not null").groupBy("tree_id", "parent_id").count().groupBy("tree_id").agg((F.max("count") <= 2).alias("binary"))
    return nodes.select("tree_id").distinct().join(kids, "tree_id", "left").select("tree_id", F.coalesce("binary", F.lit(True)).alias("binary"))


def scale(nodes: DataFrame, factor: float) -> DataFrame:
    """JT4"""
    return nodes.withColumn("length", F.col("length") * factor)


def auto_label(nodes: DataFrame, prefix: str = "I") -> DataFrame:
    """JT5: nodes without a name get prefix and a number that make no taken name."""
    w = Window.partitionBy("tree_id", F.col("name").isNull()).orderBy("node_id")
    fresh = nodes.withColumn("_k", F.row_number().over(w) - 1)
    most = nodes.where(F.col("name").rlike(f"^{prefix}\\d+$")).groupBy("tree_id").agg((F.max(F.regexp_extract("name", r"(\d+)$", 1).cast("long")) + 1).alias("_base"))
    out = fresh.join(most, "tree_id", "left")
    return out.withColumn("name", F.coalesce("name", F.concat(F.lit(prefix), (F.col("_k") + F.coalesce("_base", F.lit(0))).cast("string")))).drop("_k", "_base")


def collapse_low_support(nodes: DataFrame, least: float) -> DataFrame:
    """JT17: inner edges of less support go, and their lengths are added to the children's; a missing support is an error."""
    inner = ~F.col("is_leaf") & F.col("parent_id").isNotNull()
    weak = F.when(inner & F.col("support").isNull(), F.raise_error(F.lit("an inner edge has no support")).cast("boolean")).otherwise(inner & (F.col("support") < least))
    n = materialise(nodes.withColumn("_weak", weak))
    up = ancestors(n, strict=True).join(n.select("tree_id", F.col("node_id").alias("anc"), "_weak", F.col("length").alias("al")), ["tree_id", "anc"])
    firm = up.groupBy("tree_id", "node_id").agg(F.min(F.when(~F.col("_weak"), F.col("anc"))).alias("stop"))
    added = up.join(firm, ["tree_id", "node_id"]).where(F.col("_weak") & (F.col("anc") < F.col("stop"))).groupBy("tree_id", "node_id").agg(F.sum("al").alias("more"))
    kept = n.where(~F.col("_weak")).join(added, ["tree_id", "node_id"], "left").withColumn("length", F.col("length") + F.coalesce("more", F.lit(0.0)))
    return renumber(kept.select("tree_id", F.col("node_id").alias("old"), "name", "length", "support", "leaf_lo", "leaf_hi"))


def midpoint_edge(nodes: DataFrame) -> DataFrame:
    """TR12: the edge that holds the middle of the longest leaf-to-leaf path: (tree_id, node_id, diameter).

    From its deeper end (the first leaf, if both are as deep) the path is climbed until half of it is passed: jumps over
    powers of two edges, so the joins are the logarithm of the depth. Trees without two leaves give no row.
    """
    at = materialise(root_distance(nodes))
    start = widest_nodes(at).select("tree_id", F.col("anchor").alias("node_id"), (F.col("deep") - F.col("diameter") / 2).alias("above"), "diameter")
    return ranges.climbed(*ranges.ladder(at), materialise(start)).select("tree_id", "node_id", "diameter")


def heaviest_path_edge(nodes: DataFrame) -> DataFrame:
    """TR13: descend into the heaviest child while its leaves times those outside grow: the edge of largest product.

    The product rises along the heaviest path up to half of the leaves and falls after it, so it is the largest
    product on that path; ties go to the upper edge.
    """
    n = leaf_counts(nodes)
    w = Window.partitionBy("tree_id", "parent_id").orderBy(F.desc("leaves"), "node_id")
    light = n.withColumn("light", F.when(F.col("parent_id").isNotNull(), (F.row_number().over(w) > 1).cast("int")).otherwise(F.lit(0)))
    off = ranges.path_sums(materialise(light), "node_id", "parent_id", ["light"])
    path = n.where("parent_id is not null").join(off.where("light = 0"), ["tree_id", "node_id"], "left_semi")
    key = F.struct((-F.col("leaves").cast("long") * (F.col("total") - F.col("leaves"))).alias("p"), (-F.col("node_id")).alias("o"))
    return path.groupBy("tree_id").agg(F.min_by(F.struct("node_id", "leaves", "total"), key).alias("b")).select("tree_id", "b.*")


def reroot(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """JT28, TR18: trees rooted on the edge above (tree_id, node_id), cut in its middle: (tree_id, node, parent, child_ord, name, length).

    Edges on the path to the old root turn round; the new root is node -1. Feed the result to from_parents.
    """
    path = ancestors(nodes).join(at.select("tree_id", "node_id"), ["tree_id", "node_id"]).select("tree_id", F.col("anc").alias("node_id"), F.col("node_id").alias("low"))
    n = nodes.join(path, ["tree_id", "node_id"], "left")
    turned = n.where("low is not null and parent_id is not null and node_id <> low").select("tree_id", F.col("parent_id").alias("node"), F.col("node_id").alias("parent"), "length")
    cut_ = n.where("node_id = low and parent_id is not null")
    halves = cut_.select("tree_id", F.explode(F.array("node_id", "parent_id")).alias("node"), F.lit(-1).alias("parent"), (F.col("length") / 2).alias("length"))
    rest = n.where("low is null").select("tree_id", F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), "length")
    edges = rest.unionByName(turned).unionByName(halves)
    names = nodes.select("tree_id", F.col("node_id").alias("node"), "name")
    kids = Window.partitionBy("tree_id", "parent").orderBy("node")
    out = edges.join(names, ["tree_id", "node"], "left").withColumn("child_ord", (F.row_number().over(kids) - 1).cast("int"))
    root = cut_.select("tree_id", F.lit(-1).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit(None).cast("double").alias("length"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("child_ord"))
    return out.select("tree_id", "node", "parent", "length", "name", "child_ord").unionByName(root)


def resolve_polytomies(nodes: DataFrame) -> DataFrame:
    """TR18: node with k > 2 children: a chain of k - 2 new nodes of length 0, the first children lowest.

    Clades stay intervals: the new ones join the first 2, 3, … k - 1 children.
    """
    w = Window.partitionBy("tree_id", "parent_id")
    kids = nodes.where("parent_id is not null").withColumn("k", F.count("*").over(w)).withColumn("lo", F.min("leaf_lo").over(w))
    extra = kids.where("k > 2 and child_ord between 1 and k - 2").select("tree_id", F.lit(None).cast("int").alias("old"), F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("length"), F.col("lo").alias("leaf_lo"), "leaf_hi")
    return renumber(nodes.select("tree_id", F.col("node_id").alias("old"), "name", "length", "leaf_lo", "leaf_hi").unionByName(extra))


def genealogical_index(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """AG12, JT26: (tree_id, group, gsi) for leaf groups (group, name): (obs - min) / (1 - min), -1 below two leaves.

    obs is (n - 1) over the degrees less 2 summed over the nodes that join the group; min the same over all inner
    nodes. A node's degree counts its parent, too; a node joins the group if two of its branches hold members.
    """
    kids = nodes.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("k"))
    inner = nodes.join(kids, ["tree_id", "node_id"], "left").withColumn("extra", F.when(F.col("k").isNotNull(), F.col("k") + F.col("parent_id").isNotNull().cast("int") - 2).otherwise(F.lit(0)))
    every = inner.groupBy("tree_id").agg(F.sum("extra").alias("all_extra"))
    # dist is the extra of all nodes from the root down to a node, both included.
    at = materialise(root_distance(inner.withColumn("length", F.col("extra").cast("double"))))
    leaf = at.where("is_leaf").join(groups.distinct(), "name").select("tree_id", "group", F.col("leaf_lo").alias("r"), "dist")
    w = Window.partitionBy("tree_id", "group").orderBy("r")
    near = leaf.withColumn("lo", F.lag("r").over(w)).withColumn("hi", F.col("r") - 1)
    # Paths of the members to the root, one after the other, each without what it shares with the one before.
    met = ranges.largest(meetings(at), near.where("lo is not null").select("tree_id", "group", "lo", "hi"), "lo", "hi", "v")
    shared = met.groupBy("tree_id", "group").agg(F.sum("v.dist").alias("shared"), F.max("v").alias("top"))
    size = leaf.groupBy("tree_id", "group").agg(F.count("*").alias("n"), F.sum("dist").alias("paths"))
    tops = at.select("tree_id", F.col("node_id").alias("t"), F.col("extra").alias("top_extra"), "dist")
    used = size.join(shared, ["tree_id", "group"]).withColumn("t", F.col("top.node_id")).join(tops, ["tree_id", "t"])
    used = used.select("tree_id", "group", (F.col("paths") - F.col("shared") - F.col("dist") + F.col("top_extra")).alias("extra"))
    size = size.drop("paths")
    out = size.join(used, ["tree_id", "group"], "left").join(every, "tree_id", "left")
    obs, low = (F.col("n") - 1) / F.col("extra"), (F.col("n") - 1) / F.col("all_extra")
    return out.select("tree_id", "group", F.when((F.col("n") < 2) | F.col("extra").isNull(), F.lit(-1.0)).when(low == 1, F.lit(1.0)).otherwise((obs - low) / (1 - low)).alias("gsi"))


def sane(nodes: DataFrame) -> DataFrame:
    """FLT13: (tree_id, fault): trees without exactly one root, unrooted ones whose root has two children, unary nodes."""
    kids = nodes.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("k"))
    at = nodes.join(kids, ["tree_id", "node_id"], "left").select("tree_id", "parent_id", "k", F.col("rooted") if "rooted" in nodes.columns else F.lit(True).alias("rooted"))
    roots = at.groupBy("tree_id").agg(F.sum(F.col("parent_id").isNull().cast("int")).alias("n")).where("n <> 1").select("tree_id", F.lit("not one root").alias("fault"))
    two = at.where("not rooted and parent_id is null and k = 2").select("tree_id", F.lit("unrooted tree with two root children").alias("fault"))
    return roots.unionByName(two).unionByName(at.where("k = 1").select("tree_id", F.lit("unary node").alias("fault")).distinct())


def unary(nodes: DataFrame) -> DataFrame:
    """JT2: nodes with a single child."""
    kids = nodes.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("k")).where("k = 1")
    return nodes.join(kids.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_semi")


def shape(nodes: DataFrame) -> DataFrame:
    """JT29: nodes with children, degree (the parent counts), siblings, depth and height (edges to the deepest leaf)."""
    kids = nodes.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    depth = materialise(root_distance(nodes).select("tree_id", "node_id", "depth", "is_leaf", "leaf_lo", "leaf_hi"))
    lowest = ranges.sparse(depth.where("is_leaf").select("tree_id", F.col("leaf_lo").alias("r"), F.col("depth").alias("v")))
    deep = ranges.largest(lowest, depth, "leaf_lo", "leaf_hi", "deepest").select("tree_id", "node_id", "deepest")
    depth = depth.drop("leaf_lo", "leaf_hi")
    up = kids.select("tree_id", F.col("node_id").alias("parent_id"), F.col("children").alias("peers"))
    n = nodes.join(kids, ["tree_id", "node_id"], "left").join(up, ["tree_id", "parent_id"], "left").join(depth.drop("is_leaf"), ["tree_id", "node_id"]).join(deep, ["tree_id", "node_id"])
    children = F.coalesce("children", F.lit(0))
    return n.withColumn("children", children).withColumn("degree", children + F.col("parent_id").isNotNull().cast("long")).withColumn("siblings", F.coalesce(F.col("peers") - 1, F.lit(0))).withColumn("height", F.col("deepest") - F.col("depth")).drop("peers", "deepest")


def leaf_positions(nodes: DataFrame) -> DataFrame:
    """JT20: (tree_id, name, position): leaves by name, numbered from 0."""
    w = Window.partitionBy("tree_id").orderBy("name")
    return nodes.where("is_leaf").select("tree_id", "name", (F.row_number().over(w) - 1).cast("int").alias("position"))


def unmapped_leaf(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """JT16: the first leaf, in postorder, of each tree that mapping (name, …) lacks."""
    left = nodes.where("is_leaf").join(mapping.select("name"), "name", "left_anti")
    return left.groupBy("tree_id").agg(F.min_by("name", "node_id").alias("name"))


def random_node(nodes: DataFrame, seed: int, leaves: bool = True, root: bool = True) -> DataFrame:
    """JT30: one node of each tree, picked by a hash; leaves or the root can be left out."""
    some = nodes if leaves else nodes.where("not is_leaf")
    some = some if root else some.where("parent_id is not null")
    return some.groupBy("tree_id").agg(F.min_by("node_id", F.xxhash64(F.lit(seed), "tree_id", "node_id")).alias("node_id"))
