"""Helpers that several corpus operators share: table access, lineage cuts, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(spark, "_cladeframe_dir", None)
        if not found:
            found = spark._cladeframe_dir = tempfile.mkdtemp(prefix="spark-")
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    Later steps start from the written rows, so a lost executor costs no recomputation of what came before, and
    iterative plans stay short.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it: one that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """Uniform double in [0, 1) that depends on the values only. Expressible in SQL as well: 52 bits of MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def crc_mod(col: str, k: int) -> Column:
    """crc32 of the value's text, modulo k: fixed folds of ids."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(k)


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 17) -> DataFrame:
    """At most `rows` rows of df, the same at every run: those whose hash of `key` is smallest."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(rows)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Component of every node that an edge touches: (node, component = smallest node reachable).

    Alternates the large-star and small-star steps until the edges are stars: every node has one edge to a smaller one or
    edges from larger ones only. A node's neighbours never meet in
    one task: minima are partial aggregates, and the joins that carry them back are plain equi-joins of two
    exchanged sides, which adaptive execution splits when a node has very many edges. Self loops and nulls are
    ignored; no edges give no rows.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = cut(large)
        low = cut(e.groupBy("u").agg(F.min("v").alias("m")))
        small = e.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
        ends = ends.groupBy("n").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v"))
        if not ends.where((F.col("as_u") > 1) | ((F.col("as_u") > 0) & (F.col("as_v") > 0))).limit(1).count():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
