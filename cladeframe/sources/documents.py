"""Placement documents (JSON) as rows, and rows as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "tree string, placements array<struct<p: array<array<double>>, n: array<string>, nm: array<array<string>>>>, fields array<string>, metadata map<string, string>, version int"
FIELDS = ["edge_num", "likelihood", "like_weight_ratio", "distal_length", "pendant_length"]


def read(spark: SparkSession, path: str, pattern: str = "*.{json,jplace}") -> DataFrame:
    """SRC11, SRC12: (doc_id, json) of whole files whose name does not hold `merged`."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("doc_id"), F.col("value").alias("json")).where(~F.contains("doc_id", F.lit("merged")))


def from_jplace(docs: DataFrame) -> DataFrame:
    """SRC11: (doc_id, json) to (doc_id, fragment, edge_num, likelihood, lwr, distal_length, pendant_length, copies).

    Columns of p are found by their names in `fields`. Malformed documents give no rows: `faults` tells of them. A fragment's multiplicity
    (nm) is `copies`, 1 where there is none.
    """
    x = docs.select("doc_id", F.from_json("json", SCHEMA).alias("d")).where("d.placements is not null and d.fields is not null")
    x = x.select("doc_id", F.col("d.fields").alias("fields"), F.explode("d.placements").alias("pl"))
    names = F.when(F.size("pl.nm") > 0, F.transform("pl.nm", lambda m: F.struct(F.element_at(m, 1).alias("n"), F.element_at(m, 2).cast("double").alias("k"))))
    x = x.withColumn("name", F.explode(F.coalesce(names, F.transform("pl.n", lambda n: F.struct(n.alias("n"), F.lit(1.0).alias("k"))))))
    x = x.select("doc_id", "fields", "name", F.explode("pl.p").alias("p"))
    at = lambda f: F.when(F.array_position("fields", f) > 0, F.try_element_at("p", F.array_position("fields", f).cast("int")))
    return x.select("doc_id", F.col("name.n").alias("fragment"), at("edge_num").cast("int").alias("edge_num"), at("likelihood").alias("likelihood"), at("like_weight_ratio").alias("lwr"), at("distal_length").alias("distal_length"), at("pendant_length").alias("pendant_length"), F.col("name.k").alias("copies"))


def faults(docs: DataFrame) -> DataFrame:
    """(doc_id, fault) of documents (doc_id, json) that from_jplace cannot read: no text, malformed, no placements, no fields."""
    d = docs.select("doc_id", "json", F.from_json("json", SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("d"))
    fault = F.when(F.col("json").isNull(), "no text").when(F.col("d").isNull() | F.col("d._bad").isNotNull(), "malformed").when(F.col("d.placements").isNull(), "no placements").when(F.col("d.fields").isNull(), "no fields")
    return d.select("doc_id", fault.alias("fault")).where("fault is not null")


def to_jplace(placements: DataFrame, trees: DataFrame | None = None, keys: str = "doc_id") -> DataFrame:
    """SNK8: (doc_id, json) from placements, with the documents' trees (doc_id, newick) if given; fragments by name.

    Rows with a column `record` that differs are records of their own, even if their fragments have one name; without that
    column all rows of a name are one record.
    """
    row = F.array(F.col("edge_num").cast("double"), "likelihood", "lwr", "distal_length", "pendant_length")
    own = ["record"] if "record" in placements.columns else []
    per = placements.groupBy(keys, "fragment", *own).agg(F.array_sort(F.collect_list(row)).alias("p"))
    docs = per.groupBy(keys).agg(F.array_sort(F.collect_list(F.struct("fragment", "p"))).alias("all"))
    docs = docs.join(trees, keys, "left") if trees is not None else docs.withColumn("newick", F.lit(None).cast("string"))
    body = F.struct(
        F.col("newick").alias("tree"), F.transform("all", lambda a: F.struct(a["p"].alias("p"), F.array(a["fragment"]).alias("n"))).alias("placements"), F.create_map(F.lit("invocation"), F.lit("merge")).alias("metadata"),
        F.lit(1).alias("version"), F.array(*map(F.lit, FIELDS)).alias("fields"),
    )
    return docs.select(keys, F.to_json(body).alias("json"))
