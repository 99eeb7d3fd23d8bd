"""Ordinals and running sums of tables of any size, also within hot keys: no window over all rows, or all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.lineage import materialise


def running(rows: DataFrame, keys: list[str], order: list, value: Column | int, name: str) -> DataFrame:
    """rows with `name`: the sum of value over the rows of the same keys that come before, 0 for the first.

    Rows are dealt in ranges of keys and order, which are as even as the rows, whatever the keys. Each range is summed on its
    own; the ranges' totals, of which a key has one for every range it touches, give the offsets. order must be total.
    """
    part, before, total = (f"_{name}_{c}" for c in ("part", "before", "total"))
    v = F.lit(value) if isinstance(value, int) else value
    dealt = materialise(rows.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()).withColumn(total, v.cast("long")))
    w = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn(before, F.coalesce(F.sum(total).over(w), F.lit(0)))
    sums = dealt.groupBy(*keys, part).agg(F.sum(total).alias(total))
    if keys:
        u = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        offset = sums.select(*keys, part, F.coalesce(F.sum(total).over(u), F.lit(0)).alias(name))
        out = inside.drop(total).join(offset, [*keys, part])
    else:
        got, known = 0, []
        for r in sorted(sums.collect(), key=lambda r: r[part]):  # one number a range
            known += [F.lit(r[part]), F.lit(got)]
            got += r[total]
        at = F.element_at(F.create_map(*known), F.col(part)) if known else F.lit(0)
        out = inside.drop(total).withColumn(name, at.cast("long"))
    return out.withColumn(name, F.col(name) + F.col(before)).select(*[F.col(f"`{c}`") for c in rows.columns], name)


def ordinal(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """rows with `name`: 0, 1, … in order within keys."""
    return running(rows, keys, order, 1, name)
