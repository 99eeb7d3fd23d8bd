"""Placements of fragments on tree edges: merging, normalising, thresholds, taxonomic roll-up.

placements: (fragment, edge_num, likelihood, lwr, distal_length, pendant_length), one row per candidate edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.lineage import materialise
from cladeframe.operators.splits import relabel_edges
from cladeframe.operators.trees import ancestors


def clip(placements: DataFrame, edges: DataFrame, share: float = 0.99) -> DataFrame:
    """FLT12, JN8: a distal length beyond the edge's (edge_num, length) becomes `share` of it."""
    at = placements.join(edges.select("edge_num", F.col("length").alias("_len")), "edge_num", "left")
    long = F.col("distal_length") > F.col("_len")
    return at.withColumn("distal_length", F.when(long, F.col("_len") * share).otherwise(F.col("distal_length"))).drop("_len")


def merge_documents(placements: DataFrame, trees: DataFrame, main: DataFrame) -> DataFrame:
    """JT34: placements (doc_id, …) of documents with own trees (node tables, tree_id = doc_id) on the main tree's edges.

    Edges are matched by split; one without a partner is an error. Distal lengths are clipped. Documents are
    concatenated; fragments of the same name stay apart, as their rows do.
    """
    to = relabel_edges(trees, main).withColumnRenamed("tree_id", "doc_id")
    moved = placements.join(to, ["doc_id", "edge_num"], "left")
    edge = F.when(F.col("to_edge").isNull(), F.raise_error(F.lit("an edge has no partner in the main tree")).cast("int")).otherwise(F.col("to_edge"))
    return clip(moved.withColumn("edge_num", edge).drop("to_edge"), main.where("edge_num is not null").select("edge_num", "length"))


def weighted(placements: DataFrame) -> DataFrame:
    """AG3: (fragment, edge_num, w): like weight ratios times their prior, summed over repeated fragments' rows."""
    return placements.groupBy("fragment", "edge_num").agg(F.sum(F.col("lwr") * F.coalesce("prior", F.lit(1.0))).alias("w"))


def normalised(w: DataFrame, keys: list[str] = ("fragment",)) -> DataFrame:
    """AG4: w with p = w over its fragment's sum; a fragment whose sum is 0 gets nulls."""
    total = w.groupBy(*keys).agg(F.sum("w").alias("_all"))
    return w.join(total, list(keys)).withColumn("p", F.col("w") / F.nullif(F.col("_all"), F.lit(0.0))).drop("_all")


def threshold(p: DataFrame, total: float = 0.95, cutoff: float = 0.0, order: list[str] = ("edge_num",)) -> DataFrame:
    """WN5: rows by falling p while the sum before a row is below `total`; none from the first at or under `cutoff`."""
    w = Window.partitionBy("fragment").orderBy(F.desc("p"), *order)
    before = F.coalesce(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    stop = F.max((F.col("p") <= cutoff).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return p.withColumn("before", before).withColumn("_stop", stop).where((F.col("before") < total) & (F.col("_stop") == 0)).drop("_stop")


def distribution(kept: DataFrame) -> DataFrame:
    """AG4, distribution mode: p over its fragment's kept sum, the divisor times the number of rows kept."""
    total = kept.groupBy("fragment").agg(F.sum("p").alias("_s"), F.count("*").alias("_n"))
    return kept.join(total, "fragment").withColumn("share", F.col("p") / (F.col("_s") * F.col("_n"))).drop("_s", "_n")


def best(placements: DataFrame) -> DataFrame:
    """X10: the placement of the largest ratio of each fragment, ties to the smaller edge."""
    rest = [c for c in placements.columns if c != "fragment"]
    return placements.groupBy("fragment").agg(F.min_by(F.struct(*rest), F.struct((-F.col("lwr")).alias("s"), "edge_num")).alias("b")).select("fragment", "b.*")


def insertion_tree(main: DataFrame, placements: DataFrame) -> DataFrame:
    """X10: (tree_id, node, parent, child_ord, name, length): the main tree with a leaf for every fragment's best place.

    Fragments on one edge divide it at their distal lengths, the nearest to the lower end first (then by name); the
    new nodes form a chain. Feed the result to trees.from_parents.
    """
    b = best(placements).select("fragment", "edge_num", "distal_length", "pendant_length")
    w = Window.partitionBy("edge_num").orderBy("distal_length", "fragment")
    b = b.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("edge_num")))
    edge = main.where("edge_num is not null").select("tree_id", "edge_num", F.col("node_id").alias("low"), F.col("parent_id").alias("high"), F.col("length").alias("len"))
    at = b.join(edge, "edge_num").withColumn("cut", F.least("distal_length", F.coalesce("len", F.lit(0.0))))
    prev = F.coalesce(F.lag("cut").over(w), F.lit(0.0))
    # Ids of new nodes are text, as the old ones are here: the edge and the place on it.
    here, above = F.concat_ws(":", F.lit("e"), "edge_num", "k"), F.concat_ws(":", F.lit("e"), "edge_num", F.col("k") + 1)
    own = at.withColumn("from_", prev).withColumn("here", here).withColumn("above", F.when(F.col("k") == F.col("n"), F.col("high").cast("string")).otherwise(above))
    joint = own.select("tree_id", F.col("here").alias("node"), F.col("above").alias("parent"), F.lit(None).cast("string").alias("name"), F.when(F.col("k") == F.col("n"), F.coalesce("len", F.lit(0.0)) - F.col("cut")).otherwise(F.lead("cut").over(w) - F.col("cut")).alias("length"))
    leaf = own.select("tree_id", F.concat(F.lit("f:"), "fragment").alias("node"), F.col("here").alias("parent"), F.col("fragment").alias("name"), F.col("pendant_length").alias("length"))
    first = own.where("k = 1").select("tree_id", F.col("low").alias("node_id"), F.col("here").alias("_p"), F.col("cut").alias("_len"))
    old = main.join(first, ["tree_id", "node_id"], "left").select("tree_id", F.col("node_id").cast("string").alias("node"), F.coalesce("_p", F.col("parent_id").cast("string")).alias("parent"), "name", F.coalesce("_len", "length").alias("length"))
    every = old.unionByName(joint).unionByName(leaf)
    kids = Window.partitionBy("tree_id", "parent").orderBy("node")
    return every.withColumn("child_ord", (F.row_number().over(kids) - 1).cast("int"))


def added(p: Column) -> Column:
    """The sum of shares, alike in any order: whole steps of 2^-36 and what is left add up without loss, then one rounding."""
    p, step = p.cast("double"), 2.0**36
    high = F.floor(p * step) / step
    return F.sum(high) + F.sum(p - high)


def rollup(shares: DataFrame, closure: DataFrame, least: float | None = 0.95) -> DataFrame:
    """AG5: (fragment, tax_id, p): shares (fragment, tax_id, p) added to the taxon and all above it.

    closure: (tax_id, anc), each taxon itself included. least None keeps all. Sums don't depend on the order of rows, so
    a fragment at the bound is not kept in one run and dropped in the next.
    """
    up = shares.join(closure, "tax_id").groupBy("fragment", F.col("anc").alias("tax_id")).agg(added(F.col("p")).alias("p"))
    return up if least is None else up.where(F.col("p") >= least)


def taxonomy_closure(taxa: DataFrame) -> DataFrame:
    """SRC14: (tax_id, anc, up): ancestors of (tax_id, parent_id), each itself included, by doubling; a parent that is
    the taxon itself, empty or missing ends a line. Without any root: an error."""
    own = taxa.select("tax_id", F.col("tax_id").alias("anc"), F.lit(0).alias("up"))
    real = taxa.where("parent_id is not null and parent_id <> tax_id").join(taxa.select(F.col("tax_id").alias("parent_id")), "parent_id", "left_semi")
    if not taxa.limit(1).count():
        return own
    if not taxa.join(real.select("tax_id"), "tax_id", "left_anti").limit(1).count():
        raise ValueError("the taxonomy has no root")
    up, reach = materialise(real.select("tax_id", F.col("parent_id").alias("anc"), F.lit(1).alias("up"))), 1
    while True:
        far = up.where(F.col("up") == reach).select(F.col("tax_id").alias("low"), F.col("anc").alias("tax_id"))
        more = far.join(up, "tax_id").select(F.col("low").alias("tax_id"), "anc", (F.col("up") + reach).alias("up"))
        up, reach = materialise(up.unionByName(more)), reach * 2
        if not up.where(F.col("up") == reach).limit(1).count():
            return own.unionByName(up)


def edge_taxa(main: DataFrame, mapping: DataFrame, closure: DataFrame, push_up: bool = False) -> DataFrame:
    """JN11, JN12: (edge_num, tax_id): the lowest common ancestor of the taxa below each edge; push_up: below its parent.

    mapping: (name, tax_id) of leaves; closure: (tax_id, anc, up), up the number of steps.
    """
    leaf = main.where("is_leaf").join(mapping, "name").select("tree_id", "node_id", "tax_id")
    held = leaf.join(ancestors(main).drop("via"), ["tree_id", "node_id"]).select("tree_id", F.col("anc").alias("node_id"), "tax_id").distinct()
    size = held.groupBy("tree_id", "node_id").agg(F.count("*").alias("n"))
    depth = closure.groupBy("tax_id").agg(F.max("up").alias("depth")).withColumnRenamed("tax_id", "anc")
    above = held.join(closure.select("tax_id", "anc"), "tax_id").groupBy("tree_id", "node_id", "anc").agg(F.count("*").alias("m")).join(size, ["tree_id", "node_id"]).where("m = n").join(depth, "anc")
    lca = above.groupBy("tree_id", "node_id").agg(F.max_by("anc", F.struct("depth", "anc")).alias("tax_id"))
    edge = main.where("edge_num is not null").select("tree_id", "edge_num", (F.coalesce("parent_id", "node_id") if push_up else F.col("node_id")).alias("node_id"))
    return edge.join(lca, ["tree_id", "node_id"]).select("edge_num", "tax_id")


def classification_lines(rolled: DataFrame, taxa: DataFrame) -> DataFrame:
    """SNK10: fragment, id, name, rank, prob (4 decimals, as text)."""
    t = taxa.select("tax_id", "tax_name", "rank")
    return rolled.join(t, "tax_id", "left").select("fragment", F.col("tax_id").alias("id"), F.col("tax_name").alias("name"), "rank", F.format_string("%.4f", "p").alias("prob"))


def classify(placements: DataFrame, main: DataFrame, taxa: DataFrame, mapping: DataFrame, total: float = 0.95, cutoff: float = 0.0, least: float | None = 0.95, push_up: bool = False) -> DataFrame:
    """JT35: weigh, normalise and cut each fragment's placements, and add them up over the taxonomy."""
    closure = materialise(taxonomy_closure(taxa))
    p = normalised(weighted(placements))
    kept = threshold(p, total, cutoff).drop("before")
    shares = kept.join(edge_taxa(main, mapping, closure, push_up), "edge_num").groupBy("fragment", "tax_id").agg(F.sum("p").alias("p"))
    return classification_lines(rollup(shares, closure, least), taxa)


