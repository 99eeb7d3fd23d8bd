"""Newick trees as node tables, parsed with window functions.

A tree's tokens are numbered; the depth after each token is a running sum of brackets. A node ends at its name: a leaf
at its own token, an inner node at its closing bracket. Nodes in order of their ends are in postorder. The parent of a
node of depth d is the next closing bracket to depth d - 1. Leaf ranks make every clade an interval, so leaf counts,
clade membership and path sums need no recursion later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Quoted names may hold any sign; a comment or edge number stands in brackets; the rest runs to the next sign.
TOKEN = r"\(|\)|,|;|(?:'(?:[^']|'')*'|\[[^\]]*\]|\{[^}]*\}|[^(),;'\[{])+"
LABEL = r"^\s*('(?:[^']|'')*'|[^:\[{]*)"


def parse(trees: DataFrame, newick: str = "newick", tree_id: str = "tree_id") -> DataFrame:
    """SRC5-SRC9: nodes of every tree: tree_id, node_id (postorder, from 0), parent_id, child_ord, name, length,
    support, edge_num, is_leaf, rooted, leaf_lo, leaf_hi.

    name of an inner node is its label; support that label as a number, or what follows the length after a second
    colon; edge_num the number in [n] or {n}. Leaf ranks leaf_lo..leaf_hi are the clade of a node. See `faults` for what is
    wrong with a text. Quotes are taken off and underscores kept.
    """
    t = trees.select(F.col(tree_id).alias("tree_id"), F.regexp_replace(F.trim(newick), r"^[^=('\[]*=", "").alias("s"))
    t = t.withColumn("rooted", ~F.upper("s").startswith("[&U]")).withColumn("s", F.regexp_replace("s", r"^\s*\[&[^\]]*\]", ""))
    tok = t.select("tree_id", "rooted", F.posexplode(F.regexp_extract_all("s", F.lit(TOKEN), F.lit(0))).alias("at", "tok"))
    tok = tok.withColumn("tok", F.trim("tok")).where("tok <> ''")
    w = Window.partitionBy("tree_id").orderBy("at")
    tok = tok.withColumn("step", F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0))
    tok = tok.withColumn("depth", F.sum("step").over(w)).withColumn("prev", F.coalesce(F.lag("tok").over(w), F.lit("("))).withColumn("next", F.lead("tok").over(w))
    plain = ~F.col("tok").isin("(", ")", ",", ";")
    leaf, inner = plain & (F.col("prev") != ")"), F.col("tok") == ")"
    ends = tok.where(leaf | inner | (F.col("tok") == "("))
    label = F.when(leaf, F.col("tok")).when(inner & ~F.coalesce("next", F.lit(";")).isin("(", ")", ",", ";"), F.col("next"))
    ends = ends.withColumn("label", label).withColumn("is_leaf", leaf).withColumn("is_open", F.col("tok") == "(")
    # An opening bracket before depth d pairs with the next closing one to the same depth.
    level = F.when(F.col("is_open"), F.col("depth") - 1).otherwise(F.col("depth"))
    ends = ends.withColumn("level", level)
    by_level = Window.partitionBy("tree_id", "level").orderBy("at")
    ends = ends.withColumn("leaves_upto", F.sum(F.col("is_leaf").cast("int")).over(w))
    opened = F.last(F.when(F.col("is_open"), F.col("leaves_upto")), ignorenulls=True).over(by_level)
    nodes = ends.withColumn("opened", opened).where(~F.col("is_open"))
    nodes = nodes.withColumn("node_id", (F.row_number().over(w) - 1).cast("int"))
    nodes = nodes.withColumn("leaf_lo", F.when(F.col("is_leaf"), F.col("leaves_upto") - 1).otherwise(F.col("opened"))).withColumn("leaf_hi", F.col("leaves_upto") - 1)
    # Parents: nodes look for the first later closing bracket one level up; both are put on that level.
    up = nodes.select("tree_id", "node_id", "at", F.explode(F.array(F.struct((F.col("level") - 1).alias("l"), F.lit(False).alias("closes")), F.when(~F.col("is_leaf"), F.struct(F.col("level").alias("l"), F.lit(True).alias("closes"))))).alias("x")).where("x is not null").select("tree_id", "node_id", "at", "x.*")
    later = Window.partitionBy("tree_id", "l").orderBy("at", "node_id").rowsBetween(1, Window.unboundedFollowing)
    up = up.withColumn("parent_id", F.min(F.when(F.col("closes"), F.col("node_id"))).over(later)).where("not closes and l >= 0")
    nodes = nodes.join(up.select("tree_id", "node_id", "parent_id"), ["tree_id", "node_id"], "left")
    kids = Window.partitionBy("tree_id", "parent_id").orderBy("node_id")
    text = F.coalesce("label", F.lit(""))
    name = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(text, LABEL, 1)), "^'|'$", ""), "''", "'")
    after = F.substr(text, F.length(F.regexp_extract(text, LABEL, 1)) + 1)
    value = lambda p, kind: F.nullif(F.regexp_extract(after, p, 1), F.lit("")).cast(kind)
    out = nodes.withColumn("name", F.nullif(name, F.lit(""))).withColumn("length", value(r"^:\s*([-+0-9.eE]+)", "double")).withColumn("boot", value(r"^:[-+0-9.eE\s]*:\s*([-+0-9.eE]+)", "double"))
    out = out.withColumn("edge_num", value(r"[\[{](\d+)[\]}]", "int")).withColumn("as_number", F.when(F.col("name").rlike(r"^[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?$"), F.col("name")).cast("double"))
    support = F.coalesce("boot", F.when(~F.col("is_leaf"), F.col("as_number")))
    return out.select("tree_id", "node_id", "parent_id", F.when(F.col("parent_id").isNotNull(), F.row_number().over(kids) - 1).cast("int").alias("child_ord"), "name", "length", support.alias("support"), "edge_num", "is_leaf", "rooted", F.col("leaf_lo").cast("int").alias("leaf_lo"), F.col("leaf_hi").cast("int").alias("leaf_hi"))


def write(nodes: DataFrame, labels: bool = False, edge: str | None = None) -> DataFrame:
    """SNK6, SNK7: (tree_id, newick) from nodes; labels: inner names too; edge: column to add as [n].

    The text of a tree is its nodes' texts in postorder: a leaf is written after a comma, if it is the first of a
    clade that is not a first child, and as many opening brackets as clades start with it; an inner node is a closing
    bracket. No recursion: counts per first leaf, and one aggregation per tree.
    """
    quoted = F.when(F.col("name").rlike(r"[\s():,;'\[\]{}]"), F.concat(F.lit("'"), F.replace("name", F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(F.coalesce("name", F.lit("")))
    shown = quoted if labels else F.when(F.col("is_leaf"), quoted).otherwise("")
    length = F.when(F.col("length").isNotNull(), F.concat(F.lit(":"), F.col("length").cast("string"))).otherwise("")
    number = F.when(F.col(edge).isNotNull(), F.concat(F.lit("["), F.col(edge).cast("string"), F.lit("]"))).otherwise("") if edge else F.lit("")
    own = nodes.select("tree_id", "node_id", "is_leaf", F.col("leaf_lo").alias("at"), F.concat(shown, length, number).alias("end"))
    starts = nodes.groupBy("tree_id", F.col("leaf_lo").alias("at")).agg(F.sum((~F.col("is_leaf")).cast("int")).alias("opens"), F.max((F.col("child_ord") > 0).cast("int")).alias("comma"))
    leaf = own.where("is_leaf").join(starts, ["tree_id", "at"])
    front = F.concat(F.when(F.col("comma") == 1, ",").otherwise(""), F.repeat(F.lit("("), F.col("opens").cast("int")))
    tokens = leaf.select("tree_id", "node_id", F.concat(front, "end").alias("t")).unionByName(own.where("not is_leaf").select("tree_id", "node_id", F.concat(F.lit(")"), "end").alias("t")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "t"))), lambda s: s["t"]), "")
    return tokens.groupBy("tree_id").agg(F.concat(text, F.lit(";")).alias("newick"))


def faults(trees: DataFrame, newick: str = "newick", tree_id: str = "tree_id") -> DataFrame:
    """(tree_id, fault): texts whose brackets do not match, and leaf names that a tree has twice."""
    plain = F.regexp_replace(newick, r"'(?:[^']|'')*'|\[[^\]]*\]", "")
    uneven = trees.where(F.regexp_count(plain, F.lit(r"\(")) != F.regexp_count(plain, F.lit(r"\)"))).select(F.col(tree_id).alias("tree_id"), F.lit("unbalanced brackets").alias("fault"))
    twice = parse(trees, newick, tree_id).where("is_leaf").groupBy("tree_id", "name").count().where("count > 1").select("tree_id", F.concat(F.lit("duplicate name "), "name").alias("fault"))
    return uneven.unionByName(twice)
