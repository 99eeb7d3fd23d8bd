"""Cutting the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to spark.checkpoint.dir (a local folder only where that is unset) and read it back."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark._scratch = tempfile.mkdtemp(prefix="spark-")
    path = f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_and_count(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """df as materialise returns it, and how many of its rows meet the condition, counted while they are written."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count_if(condition).alias("n")))
    return out, seen.get["n"]
