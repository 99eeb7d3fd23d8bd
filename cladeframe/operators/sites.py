"""Site operators on alignments in long form: (…keys, name, pos, ch), pos from 0, "-" the gap.

`keys` are the columns that tell alignments apart (none: one alignment). Only `columns` looks at all rows of a site,
and it is one partial aggregation; nothing gathers a whole alignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.ordinals import ordinal
from cladeframe.functions.sequences import GAP, letters


def to_sites(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Long form of (…, name, seq)."""
    return rows.select(*[c for c in rows.columns if c != seq], F.posexplode(letters(seq)).alias("pos", "ch"))


def to_rows(sites: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(…keys, name, seq) with characters in order of pos; only one row's characters meet."""
    chars = F.array_sort(F.collect_list(F.struct("pos", "ch")))
    return sites.groupBy(*keys, "name").agg(F.array_join(F.transform(chars, lambda s: s["ch"]), "").alias("seq"))


def columns(sites: DataFrame, keys: list[str] = ()) -> DataFrame:
    """COL1, COL2: (…keys, pos, all_gap, residues)."""
    solid = (F.col("ch") != GAP).cast("long")
    return sites.groupBy(*keys, "pos").agg((F.max(solid) == 0).alias("all_gap"), F.sum(solid).alias("residues"))


def is_all_gap(sites: DataFrame, pos: int, keys: list[str] = ()) -> DataFrame:
    """COL3"""
    return columns(sites.where(F.col("pos") == pos), keys).select(*keys, "all_gap")


def renumbered(cols: DataFrame, keys: list[str] = ()) -> DataFrame:
    """cols with new_pos: 0, 1, … in order of pos."""
    return ordinal(cols, list(keys), ["pos"], "new_pos").withColumn("new_pos", F.col("new_pos").cast("int"))


def delete_all_gap(sites: DataFrame, keys: list[str] = ()) -> DataFrame:
    """COL4, COL12: sites of the columns that hold a residue, renumbered; `label` remembers the old position."""
    kept = renumbered(columns(sites, keys).where(~F.col("all_gap")).select(*keys, "pos"), keys)
    return sites.join(kept, [*keys, "pos"]).select(*keys, "name", F.col("new_pos").alias("pos"), "ch", F.col("pos").alias("label"))


def keep_columns(sites: DataFrame, cols: DataFrame, keys: list[str] = ()) -> DataFrame:
    """COL5: sites whose position is in cols, renumbered."""
    kept = renumbered(cols.select(*keys, "pos").distinct(), keys)
    return sites.join(kept, [*keys, "pos"]).withColumn("pos", F.col("new_pos")).drop("new_pos")


def remove_columns(sites: DataFrame, cols: DataFrame, keys: list[str] = ()) -> DataFrame:
    """COL5: sites whose position is not in cols, renumbered."""
    left = sites.select(*keys, "pos").distinct().join(cols.select(*keys, "pos"), [*keys, "pos"], "left_anti")
    return keep_columns(sites, left, keys)


def add_column(rows: DataFrame, pos: int, char: str = GAP, lookup: DataFrame | None = None) -> DataFrame:
    """COL6: rows (name, seq) with a character before position pos: a constant, or lookup's (name, ch), else a gap."""
    r = rows.join(lookup.select("name", "ch"), "name", "left") if lookup is not None else rows.withColumn("ch", F.lit(char))
    seq = F.concat(F.substring("seq", 1, pos), F.coalesce("ch", F.lit(GAP)), F.substr("seq", F.lit(pos + 1)))
    return r.withColumn("seq", seq).drop("ch")


def remove_column(rows: DataFrame, pos: int) -> DataFrame:
    """COL7"""
    return rows.withColumn("seq", F.concat(F.substring("seq", 1, pos), F.substr("seq", F.lit(pos + 2))))


def mask_insertions(sites: DataFrame, cols: DataFrame, keys: list[str] = ()) -> DataFrame:
    """COL8: only columns of cols (…keys, pos, label) that are not insertions (label of 0 or more)."""
    return keep_columns(sites, cols.where("label >= 0"), keys)


def inspect(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """COL9: taxa, least and largest length, whether aligned."""
    n = F.length("seq")
    return rows.groupBy(*keys).agg(F.count("*").alias("taxa"), F.min(n).alias("shortest"), F.max(n).alias("longest"), (F.min(n) == F.max(n)).alias("aligned"))


def relabel(cols: DataFrame, labels: DataFrame, keys: list[str] = ()) -> DataFrame:
    """COL10, COL13: the k-th original column (label >= 0) gets the k-th of labels (…keys, nth, label); insertions keep theirs.

    Different numbers of columns and labels are an error.
    """
    w = Window.partitionBy(*keys, F.col("label") >= 0).orderBy("pos")
    numbered = cols.withColumn("nth", F.when(F.col("label") >= 0, F.row_number().over(w) - 1))
    both = numbered.where("nth is not null").join(labels.select(*keys, "nth", F.col("label").alias("to"), F.lit(True).alias("there")), [*keys, "nth"], "full")
    checked = F.when(F.col("pos").isNull() | F.col("there").isNull(), F.raise_error(F.lit("numbers of columns and labels differ")).cast("int")).otherwise(F.col("to").cast("int"))
    done = both.select(*keys, "pos", checked.alias("label"))
    return done.unionByName(numbered.where("nth is null").select(*keys, "pos", F.col("label").cast("int").alias("label")))


def reset_labels(cols: DataFrame, keys: list[str] = ()) -> DataFrame:
    """COL11"""
    return renumbered(cols.drop("label"), keys).withColumnRenamed("new_pos", "label")


def islands(cols: DataFrame, keys: list[str] = ()) -> DataFrame:
    """GI1: runs of neighbouring positions as inclusive ranges (…keys, first, last)."""
    run = F.col("pos") - F.col("_k")
    return ordinal(cols, list(keys), ["pos"], "_k").withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("_run")


def ranges_text(ranges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """SNK4: the ranges of an alignment as a-b,c-d."""
    text = F.transform(F.array_sort(F.collect_list(F.struct("first", "last"))), lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string")))
    return ranges.groupBy(*keys).agg(F.array_join(text, ",").alias("ranges"))


def residue(x: Column, cuts: list[tuple[float, str]], other: str = GAP) -> Column:
    """Character of a number by descending lower bounds."""
    out = F.lit(other)
    for bound, ch in reversed(cuts):
        out = F.when(x >= bound, ch).otherwise(out)
    return out
