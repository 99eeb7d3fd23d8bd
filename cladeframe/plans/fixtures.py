"""Sequences, alignments, trees and placements derived from the driver's tables, by expressions that SQL shares.

Alignments: embeddings, one row per vector, one site per component. Their keys are (label, block), blocks of 640 ids,
so alignments and trees stay small and their number grows with the data. Trees: binary heaps over the vectors of a
block: m leaves, inner nodes 1 to m - 1, the leaf of rank k is node m + k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions.lineage import materialise
from cladeframe.operators import trees

KEYS = ["label", "block"]
BLOCK = 640


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, block, name, pos, x) of all components."""
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    return e.select("label", F.floor(F.col("vec_id") / BLOCK).cast("long").alias("block"), F.col("vec_id").alias("name"), F.posexplode("embedding").alias("pos", "v")).withColumn("x", F.col("v").cast("double")).drop("v")


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return values(spark, sf_dir).withColumn("ch", F.when(x >= 0.25, "A").when(x <= -0.25, "C").otherwise("-")).drop("x")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return values(spark, sf_dir).withColumn("ch", F.when(x >= 0.1, "A").when(x >= 0, "C").when(x >= -0.1, "G").when(x >= -0.2, "T").otherwise("-")).drop("x")


def parents(spark: SparkSession, sf_dir: str, order: str = "vec_id") -> DataFrame:
    """(tree_id, node, parent, child_ord, name, length) of the heap of every (label, block), leaves ranked by `order`."""
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    e = e.select("label", F.floor(F.col("vec_id") / BLOCK).cast("long").alias("block"), "vec_id", F.col("embedding")[0].cast("double").alias("x0"), F.col("embedding")[1].cast("double").alias("x1"))
    w = Window.partitionBy(*KEYS).orderBy(*([order] if order == "vec_id" else [order, "vec_id"]))
    r = e.withColumn("k", F.row_number().over(w) - 1).withColumn("m", F.count("*").over(Window.partitionBy(*KEYS)))
    tree = F.struct("label", "block")
    leaf = r.select(tree.alias("tree_id"), (F.col("m") + F.col("k")).cast("int").alias("node"), F.col("vec_id").cast("string").alias("name"), F.abs("x0").alias("length"))
    inner = r.where("k >= 1").select(tree.alias("tree_id"), F.col("k").cast("int").alias("node"), F.lit(None).cast("string").alias("name"), F.when(F.col("k") > 1, F.abs("x1")).alias("length"))
    both = leaf.unionByName(inner)
    top = F.col("node") > 1
    return both.select("tree_id", "node", F.when(top, F.floor(F.col("node") / 2)).cast("int").alias("parent"), (F.col("node") % 2).cast("int").alias("child_ord"), "name", F.when(top, F.col("length")).alias("length"))


def forest(spark: SparkSession, sf_dir: str, order: str = "vec_id") -> DataFrame:
    return materialise(trees.from_parents(parents(spark, sf_dir, order)))


def forests(spark: SparkSession, sf_dir: str, *orders: str) -> list[DataFrame]:
    """The forests of several orders, whose node tables are made together."""
    all_ = None
    for o in orders:
        p = parents(spark, sf_dir, o).withColumn("tree_id", F.struct("tree_id.label", "tree_id.block", F.lit(o).alias("o")))
        all_ = p if all_ is None else all_.unionByName(p)
    made = materialise(trees.from_parents(all_))
    return [made.where(F.col("tree_id.o") == o).withColumn("tree_id", F.struct("tree_id.label", "tree_id.block")) for o in orders]


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fragment, subset, bitscore, evalue): users against event types."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    return e.groupBy(F.col("user_id").alias("fragment"), F.col("event_type").alias("subset")).agg(F.max("value").alias("bitscore"), F.min("value").alias("evalue"))


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fragment, edge_num, lwr, prior, distal_length): line items of orders."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("fragment"), F.col("l_suppkey").alias("edge_num"), F.col("l_extendedprice").alias("lwr"), (1 - F.col("l_discount")).alias("prior"), F.col("l_quantity").alias("distal_length"))


# SQL of the same fixtures.
SQL_VALUES = """
emb AS (SELECT label, vec_id // 640 AS block, vec_id AS name, embedding FROM embeddings WHERE label IS NOT NULL),
vals AS (SELECT label, block, name, i - 1 AS pos, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM emb))"""
SQL_GAPPY = SQL_VALUES + ", sites AS (SELECT label, block, name, pos, CASE WHEN x >= 0.25 THEN 'A' WHEN x <= -0.25 THEN 'C' ELSE '-' END AS ch FROM vals)"
SQL_DENSE = SQL_VALUES + ", sites AS (SELECT label, block, name, pos, CASE WHEN x >= 0.1 THEN 'A' WHEN x >= 0 THEN 'C' WHEN x >= -0.1 THEN 'G' WHEN x >= -0.2 THEN 'T' ELSE '-' END AS ch FROM vals)"


def sql_tree(p: str = "", order: str = "vec_id") -> str:
    """CTEs {p}nodes (label, block, node, parent, name, length, key) and {p}up (label, block, node, anc)."""
    by = "vec_id" if order == "vec_id" else f"{order}, vec_id"
    return f"""
{p}ranked AS (SELECT label, vec_id // 640 AS block, vec_id, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1,
  row_number() OVER (PARTITION BY label, vec_id // 640 ORDER BY {by}) - 1 AS k, count(*) OVER (PARTITION BY label, vec_id // 640) AS m
  FROM (SELECT *, embedding[1]::DOUBLE AS x0 FROM embeddings WHERE label IS NOT NULL)),
{p}every_node AS (SELECT label, block, (m + k)::INT AS node, vec_id::VARCHAR AS name, abs(x0) AS length FROM {p}ranked
  UNION ALL SELECT label, block, k::INT, NULL, abs(x1) FROM {p}ranked WHERE k >= 1),
{p}nodes AS (SELECT label, block, node, CASE WHEN node > 1 THEN node // 2 END AS parent, name, CASE WHEN node > 1 THEN length END AS length, substr(bin(node), 2) || '2' AS key FROM {p}every_node),
{p}up AS (SELECT label, block, node, node >> s AS anc FROM {p}nodes, (SELECT unnest(range(0, 31)) AS s) WHERE node >> s >= 1)"""


SQL_LEAVES = """
cnt AS (SELECT u.label, u.block, u.anc AS node, count(*) AS leaves FROM up u JOIN nodes n USING (label, block, node) WHERE n.name IS NOT NULL GROUP BY ALL),
tot AS (SELECT label, block, max(leaves) AS total FROM cnt GROUP BY ALL),
lv AS (SELECT n.*, c.leaves, t.total FROM nodes n JOIN cnt c USING (label, block, node) JOIN tot t USING (label, block))"""
SQL_DIST = "dist AS (SELECT u.label, u.block, u.node, sum(coalesce(a.length, 0)) AS d FROM up u JOIN nodes a ON a.label = u.label AND a.block = u.block AND a.node = u.anc GROUP BY ALL)"
