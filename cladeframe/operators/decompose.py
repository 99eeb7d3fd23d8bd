"""Divide-and-conquer decomposition of trees into subsets of leaves.

All subsets of all trees are split together, round by round, until every one is small enough: the rounds are the
logarithm of the largest tree's leaves over the wanted size. A subset is a node table of its own: cutting an edge moves
leaf ranks by a subtraction, so no ancestors are ever listed and a round shuffles as many rows as there are nodes left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.lineage import materialise, materialise_and_count
from cladeframe.operators import ranges, trees

STRATEGIES = ("centroid", "longest", "midpoint")


def edges_of(now: DataFrame, size: DataFrame, least: int) -> DataFrame:
    """(tree_id, n, m, node_id, len, lo, hi) of the edges of pieces (size: tree_id, n) with at least `least` leaves on either
    side. Nodes with the same leaves are one edge, named by the lowest and as long as all of theirs together."""
    m = F.col("leaf_hi") - F.col("leaf_lo") + 1
    some = now.join(size, "tree_id").withColumn("m", m).where((F.col("m") >= least) & (F.col("n") - F.col("m") >= least) & (F.col("m") < F.col("n")))
    return some.groupBy("tree_id", "n", "m", F.col("leaf_lo").alias("lo"), F.col("leaf_hi").alias("hi")).agg(F.min("node_id").alias("node_id"), F.sum(F.coalesce("length", F.lit(0.0))).alias("len"))


def cut_pieces(now: DataFrame, cuts: DataFrame) -> DataFrame:
    """The pieces that cuts (tree_id, node_id, lo, hi) divide: below the edge "0" is added to the path, else "1"."""
    c = cuts.select("tree_id", F.col("node_id").alias("_c"), F.col("lo").alias("_x"), F.col("hi").alias("_y"))
    both = now.join(c, "tree_id")
    below = (F.col("leaf_lo") >= F.col("_x")) & (F.col("leaf_hi") <= F.col("_y")) & (F.col("node_id") <= F.col("_c"))
    gone = F.col("_y") - F.col("_x") + 1
    lo = F.when(below, F.col("leaf_lo") - F.col("_x")).when(F.col("leaf_lo") > F.col("_y"), F.col("leaf_lo") - gone).otherwise(F.col("leaf_lo"))
    hi = F.when(below, F.col("leaf_hi") - F.col("_x")).when(F.col("leaf_hi") >= F.col("_y"), F.col("leaf_hi") - gone).otherwise(F.col("leaf_hi"))
    path = F.struct(F.col("tree_id.t").alias("t"), F.concat(F.col("tree_id.s"), F.when(below, "0").otherwise("1")).alias("s"))
    parent = F.when(F.col("node_id") != F.col("_c"), F.col("parent_id"))
    new = both.withColumns({"_lo": lo.cast("int"), "_hi": hi.cast("int"), "_path": path, "_up": parent})
    rest = [c for c in now.columns if c not in ("tree_id", "parent_id", "leaf_lo", "leaf_hi")]
    return new.where("_lo <= _hi").select(F.col("_path").alias("tree_id"), F.col("_up").alias("parent_id"), F.col("_lo").alias("leaf_lo"), F.col("_hi").alias("leaf_hi"), *rest)


def decompose(nodes: DataFrame, most: int, strategy: str = "centroid", least: int = 1, widest: float | None = None, nested: bool = False, farthest: float | None = None, distances: DataFrame | None = None) -> DataFrame:
    """TR8-TR10: (tree_id, subset, name): leaves by subset; subset is the path of its splits, "0" below an edge, "1" else.

    Split while a subset has more than `most` leaves, or a longer diameter than `widest`, or a larger mean of the
    distances (tree_id, a, b, d) between its names than `farthest`, where these are given. centroid: sides as even as
    possible; longest: the longest edge; midpoint: the edge that holds the middle of the longest path, or the centroid edge
    if a side of that would be too small. Both sides keep at least `least` leaves, and ties go to the first edge in
    postorder; what cannot be split stays whole. nested: subsets that were split are rows, too. A limit of the diameter is
    an error with other strategies than midpoint and centroid.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if widest is not None and strategy not in ("midpoint", "centroid"):
        raise ValueError("a largest diameter can be given with the strategies midpoint and centroid only")
    if (farthest is None) != (distances is None):
        raise ValueError("a largest mean distance and the distances belong together")
    at = materialise(trees.root_distance(nodes).select(F.struct(F.col("tree_id").alias("t"), F.lit("").alias("s")).alias("tree_id"), "node_id", "parent_id", "leaf_lo", "leaf_hi", "length", "dist", "is_leaf", "name"))
    rungs, levels = ranges.ladder(at.withColumn("tree_id", F.col("tree_id.t"))) if strategy == "midpoint" else (None, 0)
    leaves = lambda t: t.where("is_leaf").select(F.col("tree_id.t").alias("tree_id"), F.col("tree_id.s").alias("subset"), "name")
    now, ended, outer, left = at, None, None, distances
    while True:
        size = now.groupBy("tree_id").agg((F.max("leaf_hi") + 1).alias("n")).where("n > 1")
        big = size.where(F.col("n") > most)
        wide = materialise(trees.widest_nodes(now)) if widest is not None or strategy == "midpoint" else None
        if widest is not None:
            big = big.unionByName(size.join(wide.where(F.col("diameter") > widest).select("tree_id"), "tree_id"))
        if farthest is not None:
            left, mean = apart(now, left)
            big = big.unionByName(size.join(mean.where(F.col("d") > farthest).select("tree_id"), "tree_id"))
        big = materialise(big.distinct()) if strategy == "midpoint" else big.distinct()
        off = -F.col("len") if strategy == "longest" else F.abs(F.col("n") / 2 - F.col("m"))
        cuts = edges_of(now, big, least).groupBy("tree_id").agg(F.min_by(F.struct("node_id", "lo", "hi"), F.struct(off.alias("off"), "node_id")).alias("e")).select("tree_id", "e.*")
        if strategy == "midpoint":
            middle = materialise(middles(now, wide.join(big, "tree_id"), rungs, levels, least))
            cuts = middle.unionByName(cuts.join(middle, "tree_id", "left_anti").select(*middle.columns))
        cuts, n = materialise_and_count(cuts, F.lit(True))
        whole = leaves(now.join(cuts, "tree_id", "left_anti") if n else now)
        ended = whole if ended is None else ended.unionByName(whole)
        if not n:
            return materialise(ended if outer is None else ended.unionByName(outer))
        if nested:
            split = leaves(now.join(cuts, "tree_id", "left_semi"))
            outer = split if outer is None else outer.unionByName(split)
        now = materialise(cut_pieces(now, cuts))


def middles(now: DataFrame, wide: DataFrame, rungs: DataFrame, levels: int, least: int) -> DataFrame:
    """(tree_id, node_id, lo, hi): the middle edges of pieces wide (tree_id, n, anchor, deep, diameter), if both sides have
    `least` leaves. The climb stays inside the piece, as half of the path lies below its bend."""
    start = wide.select(F.col("tree_id.t").alias("tree_id"), F.col("tree_id").alias("piece"), "n", F.col("anchor").alias("node_id"), (F.col("deep") - F.col("diameter") / 2).alias("above"))
    top = ranges.climbed(rungs, levels, materialise(start)).select(F.col("piece").alias("tree_id"), "node_id", "n")
    m = F.col("leaf_hi") - F.col("leaf_lo") + 1
    fits = top.join(now.select("tree_id", "node_id", "leaf_lo", "leaf_hi"), ["tree_id", "node_id"]).where((m >= least) & (F.col("n") - m >= least) & (m < F.col("n")))
    return fits.select("tree_id", "node_id", F.col("leaf_lo").alias("lo"), F.col("leaf_hi").alias("hi"))


def apart(now: DataFrame, distances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those of distances (tree_id, a, b, d) whose names are still in one piece, and (tree_id, d): the pieces' means."""
    leaf = now.where("is_leaf").select(F.col("tree_id.t").alias("tree_id"), F.col("tree_id").alias("piece"), "name")
    x, y = leaf.withColumnsRenamed({"name": "a"}), leaf.withColumnsRenamed({"name": "b", "piece": "other"})
    both = distances.select("tree_id", "a", "b", "d").join(x, ["tree_id", "a"]).join(y, ["tree_id", "b"]).where("piece = other")
    both = materialise(both.select("tree_id", "a", "b", "d", "piece"))
    return both.drop("piece"), both.groupBy(F.col("piece").alias("tree_id")).agg(F.avg("d").alias("d"))


def hierarchy(nodes: DataFrame, placement: int, alignment: int, strategy: str = "centroid", factor: int = 4) -> DataFrame:
    """TR19, TR20: (tree_id, name, p_id, a_id): placement subsets, and alignment subsets inside each."""
    p = materialise(decompose(nodes, placement, strategy, max(1, placement // factor)).withColumnRenamed("subset", "p_id"))
    own = nodes.withColumnRenamed("tree_id", "_t").join(p.select(F.col("tree_id").alias("_t"), "p_id").distinct(), "_t")
    copies = own.select(F.struct(F.col("_t").alias("t"), "p_id").alias("tree_id"), *[c for c in nodes.columns if c != "tree_id"])
    inside = trees.prune(copies, p.select(F.struct(F.col("tree_id").alias("t"), "p_id").alias("tree_id"), "name"))
    a = decompose(inside, alignment, strategy)
    return a.select(F.col("tree_id.t").alias("tree_id"), "name", F.col("tree_id.p_id").alias("p_id"), F.col("subset").alias("a_id"))


def numbered_subsets(subsets: DataFrame) -> DataFrame:
    """Subsets with their ordinal in depth-first order, the part below an edge first."""
    w = Window.partitionBy("tree_id").orderBy("subset")
    order = subsets.select("tree_id", "subset").distinct().withColumn("ordinal", F.row_number().over(w) - 1)
    return subsets.join(order, ["tree_id", "subset"])
