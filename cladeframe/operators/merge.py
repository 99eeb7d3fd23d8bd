"""Merging extended alignments.

A column's coordinate is (anchor, ord): an original column is (label, 0), the k-th column of an insertion run (a, k)
where a is the nearest original column to its left (-1 if none). The columns of a merge of any number of inputs are
the union of their coordinates in order, so the merge is one aggregation over coordinates, associative and without
any pairwise step. Rows stay as sparse residues; per row only its own characters are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.ordinals import ordinal
from cladeframe.functions.sequences import GAP


def coordinates(cols: DataFrame, keys: list[str]) -> DataFrame:
    """EXT1: cols (…keys, pos, label; label < 0 an insertion) with anchor and ord."""
    w = Window.partitionBy(*keys).orderBy("pos")
    at = cols.withColumn("anchor", F.coalesce(F.max(F.when(F.col("label") >= 0, F.col("label"))).over(w), F.lit(-1)))
    v = Window.partitionBy(*keys, "anchor").orderBy("pos")
    return at.withColumn("ord", F.sum((F.col("label") < 0).cast("int")).over(v).cast("int"))


def merged_columns(coords: DataFrame, keys: list[str] = ()) -> DataFrame:
    """EXT2: (…keys, anchor, ord, pos) of the merge: the widest run counts for every anchor."""
    wide = coords.groupBy(*keys, "anchor").agg(F.max("ord").alias("width"), F.max((F.col("ord") == 0).cast("int")).alias("there"))
    cols = wide.select(*keys, "anchor", F.explode(F.when(F.col("there") == 1, F.sequence(F.lit(0), "width")).otherwise(F.sequence(F.lit(1), "width"))).alias("ord"))
    return ordinal(cols, list(keys), ["anchor", "ord"], "pos").withColumn("pos", F.col("pos").cast("int"))


def mixed_columns(coords: DataFrame, source: str, keys: list[str] = ()) -> DataFrame:
    """Number of insertion coordinates that several inputs share."""
    shared = coords.where("ord > 0").groupBy(*keys, "anchor", "ord").agg(F.count_distinct(source).alias("n"))
    return shared.groupBy(*keys).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("mixed"))


def merge(sites: DataFrame, source: str, keys: list[str] = ()) -> DataFrame:
    """EXT2-EXT5, JN5: (…keys, name, pos, ch) of the merge of all inputs; residues only, gaps are implied.

    sites: (…keys, source, name, pos, ch, anchor, ord). A name in several inputs keeps the rows of the first source.
    """
    first = sites.groupBy(*keys, "name").agg(F.min(source).alias(source))
    own = sites.join(first, [*keys, "name", source], "left_semi")
    cols = merged_columns(sites.select(*keys, "anchor", "ord").distinct(), keys)
    return own.where(F.col("ch") != GAP).select(*keys, "name", "anchor", "ord", "ch").join(cols, [*keys, "anchor", "ord"])


def render(merged: DataFrame, cols: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(…keys, name, seq) of equal lengths: each row's residues with the gaps between them filled in by arithmetic."""
    size = cols.groupBy(*keys).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "name").orderBy("pos")
    padded = merged.withColumn("before", F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(-1)) - 1)
    piece = F.concat(F.repeat(F.lit(GAP), F.col("before")), F.col("ch"))
    rows = padded.withColumn("piece", piece).groupBy(*keys, "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda s: s["piece"]), "").alias("seq"))
    if keys:
        return rows.join(size, list(keys)).select(*keys, "name", F.rpad("seq", F.col("n").cast("int"), GAP).alias("seq"))
    return rows.select("name", F.rpad("seq", F.lit(size.first()["n"]).cast("int"), F.lit(GAP)).alias("seq"))
