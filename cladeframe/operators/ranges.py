"""Climbing and ranges in trees without listing ancestors: jump pointers, and sparse tables over ranks.

Sums over paths and clades take one equi-join a round, and rounds are the logarithm of the depth. A sparse table has the
maxima of all windows of 2, 4, 8, … neighbouring ranks, so the maximum of any range is that of two windows: two
equi-joins, however long the range. No step needs a tree, or the children of a node, in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.lineage import materialise, materialise_and_count

LEVELS = 4


def path_sums(nodes: DataFrame, node: str, parent: str, columns: list[str]) -> DataFrame:
    """(tree_id, node, …): the sums of columns over the path from every node up to the root, the root's own left out.

    Every round a node takes what its pointer has summed and points where that points, so the distance doubles.
    """
    own = [F.when(F.col(parent).isNotNull(), F.col(c)).otherwise(F.lit(0)).alias(c) for c in columns]
    now, left = materialise_and_count(nodes.select("tree_id", F.col(node).alias("node"), F.col(parent).alias("at"), *own), F.col("at").isNotNull())
    while left:
        far = now.select("tree_id", F.col("node").alias("at"), F.col("at").alias("to"), *[F.col(c).alias(f"_{c}") for c in columns])
        both = now.join(far, ["tree_id", "at"], "left")
        now, left = materialise_and_count(both.select("tree_id", "node", F.col("to").alias("at"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns]), F.col("at").isNotNull())
    return now.select("tree_id", F.col("node").alias(node), *columns)


def path_largest(nodes: DataFrame, column: str) -> DataFrame:
    """(tree_id, node_id, column): the largest value of the column over the path from every node up to the root's child."""
    now, left = materialise_and_count(nodes.select("tree_id", "node_id", F.col("parent_id").alias("at"), column), F.col("at").isNotNull())
    while left:
        far = now.select("tree_id", F.col("node_id").alias("at"), F.col("at").alias("to"), F.col(column).alias("_v"))
        both = now.join(far, ["tree_id", "at"], "left").select("tree_id", "node_id", F.col("to").alias("at"), F.greatest(column, "_v").alias(column))
        now, left = materialise_and_count(both, F.col("at").isNotNull())
    return now.select("tree_id", "node_id", column)


def clade_sums(nodes: DataFrame, node: str, parent: str, columns: list[str]) -> DataFrame:
    """(tree_id, node, …): the sums of columns over every node and all below it.

    After k rounds a node has summed all that are less than 2^k edges below it. Those that point at it then bring what
    they have summed; partial sums meet before they are shuffled, so a node may have any number of children.
    """
    now, left = materialise_and_count(nodes.select("tree_id", F.col(node).alias("node"), F.col(parent).alias("at"), *columns), F.col("at").isNotNull())
    while left:
        brought = now.where("at is not null").groupBy("tree_id", F.col("at").alias("node")).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
        far = now.select("tree_id", F.col("node").alias("at"), F.col("at").alias("to"))
        both = now.join(far, ["tree_id", "at"], "left").join(brought, ["tree_id", "node"], "left")
        now, left = materialise_and_count(both.select("tree_id", "node", F.col("to").alias("at"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns]), F.col("at").isNotNull())
    return now.select("tree_id", F.col("node").alias(node), *columns)


def sparse(values: DataFrame) -> DataFrame:
    """Sparse table (tree_id, k, r, v) of values (tree_id, r, v): the largest v at the ranks r to r + 2^k - 1.

    r counts from 0 without gaps. A window of the next levels is made of 2, 4, … of this one; LEVELS are made at once.
    """
    level = materialise(values.select("tree_id", F.lit(0).alias("k"), F.col("r").cast("int").alias("r"), "v"))
    longest = level.agg(F.max("r") + 1).first()[0] or 0
    out, k, top = level, 0, longest.bit_length() - 1
    while k < top:
        steps = min(LEVELS, top - k)
        places = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(i << k).alias("i")) for s in range(1, steps + 1) for i in range(1 << s)])
        moved = level.where(F.col("k") == k).select("tree_id", "r", "v", F.explode(places).alias("p")).where("r >= p.i")
        grown = moved.groupBy("tree_id", (F.lit(k) + F.col("p.s")).alias("k"), (F.col("r") - F.col("p.i")).alias("r")).agg(F.max("v").alias("v"), F.count("*").alias("c"))
        level = materialise(grown.where(F.col("c") == F.expr(f"shiftleft(1, k - {k})")).drop("c"))
        out, k = out.unionByName(level), k + steps
    return out


def largest(table: DataFrame, queries: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
    """queries (tree_id, …) with `name`: the largest value at the ranks lo to hi of their tree; lo must not exceed hi."""
    k = F.length(F.bin(F.greatest(F.col(hi) - F.col(lo) + 1, F.lit(1)))) - 1  # rows that a filter drops may come by here before it
    q = queries.withColumn("_k", k).withColumn("_l", F.col(lo).cast("int")).withColumn("_h", (F.col(hi) + 1 - F.expr("shiftleft(1, _k)")).cast("int"))
    at = lambda r, v: table.select("tree_id", F.col("k").alias("_k"), F.col("r").alias(r), F.col("v").alias(v))
    both = q.join(at("_l", "_x"), ["tree_id", "_k", "_l"]).join(at("_h", "_y"), ["tree_id", "_k", "_h"])
    return both.select(*[F.col(c) for c in queries.columns], F.greatest("_x", "_y").alias(name))


def ladder(nodes: DataFrame) -> tuple[DataFrame, int]:
    """Binary lifting: (tree_id, k, node_id, up, dist), up the node 2^k edges above and dist its own distance; and the
    number of levels. nodes: (tree_id, node_id, parent_id, dist)."""
    dist = nodes.select("tree_id", F.col("node_id").alias("up"), "dist")
    step = nodes.where("parent_id is not null").select("tree_id", "node_id", F.col("parent_id").alias("up")).join(dist, ["tree_id", "up"])
    level, left = materialise_and_count(step.select("tree_id", F.lit(0).alias("k"), "node_id", "up", "dist"), F.lit(True))
    out, k = level, 0
    while left:
        k += 1
        on = level.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("to"), F.col("dist").alias("to_dist"))
        level, left = materialise_and_count(level.join(on, ["tree_id", "up"]).select("tree_id", F.lit(k).alias("k"), "node_id", F.col("to").alias("up"), F.col("to_dist").alias("dist")), F.lit(True))
        out = out.unionByName(level)
    return out, k


def climbed(rungs: DataFrame, levels: int, start: DataFrame) -> DataFrame:
    """start (tree_id, …, node_id, above) with node_id moved up to the highest node whose distance from the root exceeds
    `above`; where that of the start does not, it stays. Lengths must not be negative."""
    for k in range(levels - 1, -1, -1):
        step = rungs.where(F.col("k") == k).select("tree_id", "node_id", "up", F.col("dist").alias("_d"))
        moved = start.join(step, ["tree_id", "node_id"], "left")
        start = moved.withColumn("node_id", F.when(F.col("_d") > F.col("above"), F.col("up")).otherwise(F.col("node_id"))).select(*start.columns)
    return start


def two_largest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of every key the rows of its two largest values; only two a key and task are shuffled."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), "node_id")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r <= 2").drop("_r")
