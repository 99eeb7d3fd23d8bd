"""All binary trees, all resolutions of polytomies, unions of children, and all rootings of trees.

A binary tree of n taxa is a number: its digits in the mixed radix 1, 3, 5, … say on which edge each further taxon is put.
Numbers are rows, so trees are made apart from each other, in any range of numbers and any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.lineage import materialise
from cladeframe.operators import ranges
from cladeframe.operators.splits import keyed
from cladeframe.operators.trees import root_distance

MOST = 12


def count_of_trees(n: int) -> int:
    """Rooted binary trees of n taxa: 1 * 3 * 5 * … * (2n - 3)."""
    out = 1
    for k in range(3, 2 * n - 2, 2):
        out *= k
    return out


def binary_tree(number: Column, n: Column) -> Column:
    """Clades, as bit masks of taxa, of the binary tree of n taxa with this number: single taxa and the whole set included.

    Taxon i is put on one of the 2i - 1 edges there are: all clades that hold the one below that edge gain it, as does a
    copy of that one.
    """
    first = F.struct(number.cast("long").alias("left"), F.array(F.lit(1).cast("long")).alias("clades"))

    def put(state, i):
        edges = (2 * i - 1).cast("long")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
        at = F.get(state["clades"], F.pmod(state["left"], edges).cast("int"))
        grown = F.transform(state["clades"], lambda c: F.when((c.bitwiseAND(at) == at) & (c != at), c.bitwiseOR(bit)).otherwise(c))
        new = F.concat(grown, F.array(at.bitwiseOR(bit), bit))
        return F.struct(F.floor(state["left"] / edges).cast("long").alias("left"), new.alias("clades"))

    steps = F.when(n > 1, F.sequence(F.lit(1), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, first, put, lambda s: s["clades"])


def all_trees(taxa: DataFrame) -> DataFrame:
    """JT15: (set_id, number, clades) of all rooted binary trees over the names of every set of at most MOST names; clades:
    bit masks of names in order. A null name is none; repeated ones count once; more names are an error."""
    n = taxa.where("name is not null").select("set_id", "name").distinct().groupBy("set_id").agg(F.count("*").cast("int").alias("n"))
    return numbered_trees(n).select("set_id", "number", "clades")


def numbered_trees(sets: DataFrame) -> DataFrame:
    """sets (…, n) with number and clades: a row for every binary tree of n taxa. Numbers are dealt to all tasks first."""
    counts = F.create_map(*[F.lit(v) for k in range(1, MOST + 1) for v in (k, count_of_trees(k))])
    total = F.when(F.col("n") > MOST, F.raise_error(F.lit("too many taxa for all trees")).cast("long")).otherwise(F.element_at(counts, F.col("n")).cast("long"))
    rows = sets.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), total - 1))).repartition("number")
    return rows.withColumn("clades", binary_tree(F.col("number"), F.col("n")))


def polytomies(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, n) of nodes with more than two children."""
    return nodes.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").cast("int").alias("n")).where("n > 2")


def all_resolutions(nodes: DataFrame) -> DataFrame:
    """JT15: (tree_id, number, node_id, children) of the new inner nodes of every binary resolution of every tree.

    children: bit mask of the polytomy's children, by child_ord, that a new node joins. A resolution's number has one
    digit for each polytomy, in postorder, whose radix is the number of binary trees of its children. Binary trees have the
    one resolution without new nodes, which gives no row.
    """
    p = materialise(polytomies(nodes))
    trees_of = materialise(numbered_trees(p.select("n").distinct())).select("n", F.col("number").alias("digit"), "clades")
    counts = F.create_map(*[F.lit(v) for k in range(1, MOST + 1) for v in (k, count_of_trees(k))])
    w = Window.partitionBy("tree_id").orderBy("node_id")
    radix = p.withColumn("c", F.element_at(counts, F.col("n")).cast("long")).withColumn("all_", F.collect_list("c").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    radix = radix.withColumn("below", F.aggregate("all_", F.lit(1).cast("long"), lambda a, c: a * c)).drop("all_")
    total = radix.groupBy("tree_id").agg(F.max_by(F.col("below") * F.col("c"), "node_id").alias("total"))
    numbers = total.select("tree_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("number"))
    digits = numbers.join(radix, "tree_id").withColumn("digit", F.pmod(F.floor(F.col("number") / F.col("below")), F.col("c")).cast("long"))
    each = digits.join(trees_of, ["n", "digit"]).select("tree_id", "number", "node_id", "n", F.explode("clades").alias("children"))
    return each.where((F.bit_count("children") > 1) & (F.bit_count("children") < F.col("n"))).select("tree_id", "number", "node_id", "children")


def unions(nodes: DataFrame) -> DataFrame:
    """JT22: (tree_id, node_id, children, clade, leaves): at every node with k > 2 children all unions of 2 to k - 1 of them.

    children: bit mask by child_ord; clade: the union's key, as splits.keyed has them; k is at most 16.
    """
    k = keyed(nodes)
    child = k.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id"), "child_ord", "clade", "leaves")
    w = Window.partitionBy("tree_id", "node_id").orderBy("child_ord")
    at = child.join(polytomies(nodes), ["tree_id", "node_id"]).withColumn("bit", F.row_number().over(w) - 1)
    small = F.when(F.col("n") > 16, F.raise_error(F.lit("too many children for all unions")).cast("int")).otherwise(F.col("n"))
    mask = at.withColumn("children", F.explode(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), small) - 1))).where((F.bit_count("children") > 1) & (F.bit_count("children") < F.col("n")) & (F.expr("getbit(children, bit)") == 1))
    both = mask.groupBy("tree_id", "node_id", "children").agg(F.expr("bit_xor(clade.x)").alias("x"), F.expr("bit_xor(clade.y)").alias("y"), F.sum("leaves").alias("leaves"))
    return both.select("tree_id", "node_id", "children", F.struct("x", "y").alias("clade"), "leaves")


def directed(nodes: DataFrame) -> DataFrame:
    """JT28: every edge seen from both of its ends, from which all rootings follow: (tree_id, node_id, below, above, below_leaves,
    above_leaves, below_far, above_far).

    below and above are the keys of the leaves on either side, below_far and above_far the distances from the edge's middle
    to the farthest leaf there. The tree rooted on an edge has the clades `below` of all edges, but `above` of those over
    which the way to the old root leads. Farthest leaves come from one pass upwards (ranges of leaves) and one downwards:
    above an edge the farthest leaf bends off at some node of that way, into another child.
    """
    k = materialise(root_distance(keyed(nodes).drop("name")))
    whole = k.where("parent_id is null").select("tree_id", F.col("clade").alias("_w"))
    leaf = k.where("is_leaf").select("tree_id", F.col("leaf_lo").alias("r"), F.col("dist").alias("v"))
    deep = materialise(ranges.largest(ranges.sparse(leaf), k, "leaf_lo", "leaf_hi", "deep").select("tree_id", "node_id", "parent_id", "dist", "deep"))
    two = ranges.two_largest(deep.where("parent_id is not null"), ["tree_id", "parent_id"], "deep")
    best = two.groupBy("tree_id", "parent_id").agg(F.max("deep").alias("one"), F.min("deep").alias("two"), F.min_by("node_id", F.struct((-F.col("deep")).alias("d"), "node_id")).alias("of"), F.count("*").alias("c"))
    up = deep.select("tree_id", F.col("node_id").alias("parent_id"), F.col("dist").alias("pd"))
    side = deep.join(best, ["tree_id", "parent_id"]).join(up, ["tree_id", "parent_id"])
    other = F.when(F.col("node_id") != F.col("of"), F.col("one")).when(F.col("c") > 1, F.col("two"))
    bend = side.withColumn("bend", other - 2 * F.col("pd")).select("tree_id", "node_id", "parent_id", "bend")
    tops = deep.where("parent_id is null").select("tree_id", "node_id", "parent_id", F.lit(None).cast("double").alias("bend"))
    far = ranges.path_largest(bend.unionByName(tops), "bend")
    out = k.where("parent_id is not null").join(whole, "tree_id").join(deep.select("tree_id", "node_id", "deep"), ["tree_id", "node_id"]).join(far, ["tree_id", "node_id"])
    rest = F.struct(F.col("clade.x").bitwiseXOR(F.col("_w.x")).alias("x"), F.col("clade.y").bitwiseXOR(F.col("_w.y")).alias("y"))
    half = F.coalesce("length", F.lit(0.0)) / 2
    return out.select("tree_id", "node_id", F.col("clade").alias("below"), rest.alias("above"), F.col("leaves").alias("below_leaves"), (F.col("total") - F.col("leaves")).alias("above_leaves"), (F.col("deep") - F.col("dist") + half).alias("below_far"), (F.col("dist") + F.col("bend") - half).alias("above_far"))
