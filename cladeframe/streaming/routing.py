"""Incremental routing of hits that arrive as a stream (an extra: the batch operators need no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_hits(stream: DataFrame, order: str = "subset", fragment: str = "fragment", score: str = "bitscore") -> DataFrame:
    """The best hit of each fragment so far; the state is one row per fragment."""
    key = F.struct((-F.col(score)).alias("s"), order)
    return stream.where(F.col(score).isNotNull()).groupBy(fragment).agg(F.min_by(F.struct(order, score), key).alias("b")).select(fragment, "b.*")


def windowed_best(stream: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 day", fragment: str = "fragment", order: str = "subset", score: str = "bitscore") -> DataFrame:
    """The best hit of each fragment in each window of event time; what is later than `late` is dropped with its state."""
    key = F.struct((-F.col(score)).alias("s"), order)
    got = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), fragment).agg(F.min_by(F.struct(order, score), key).alias("b"))
    return got.select(F.col("w.start").alias("start"), fragment, "b.*")
