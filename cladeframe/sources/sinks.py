"""Writers. All of them give one text column, so Spark writes the parts; order is a range sort, never one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.sequences import degap


def fasta(rows: DataFrame, by_name: bool = True) -> DataFrame:
    """SNK1: lines of FASTA records, sorted by name."""
    r = rows.orderBy("name") if by_name else rows
    return r.select(F.concat(F.lit(">"), F.col("name").cast("string"), F.lit("\n"), F.col("seq")).alias("value"))


def unaligned(rows: DataFrame, order: str = "file_pos") -> DataFrame:
    """SNK2: degapped records in order of input."""
    return fasta((rows.orderBy(order) if order in rows.columns else rows).withColumn("seq", degap("seq")), by_name=False)


def rendered(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """SNK3: each alignment as one text, sorted, without a newline at its end."""
    one = F.concat(F.lit(">"), F.col("name").cast("string"), F.lit("\n"), F.col("seq"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("name", one.alias("t")))), lambda s: s["t"])
    return rows.groupBy(*keys).agg(F.array_join(text, "\n").alias("value"))


def masked(sites: DataFrame, cols: DataFrame) -> DataFrame:
    """SNK5: FASTA records without insertion columns."""
    from cladeframe.operators.sites import mask_insertions, to_rows

    return fasta(to_rows(mask_insertions(sites, cols)))


def scores(hits: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK9: lines of the score table, and the names without any hit."""
    from cladeframe.operators.routing import score_lines, unscored

    head = hits.sparkSession.createDataFrame([("seq,bitscore,evalue",)], "value string")
    lines = score_lines(hits).select(F.concat_ws(",", "seq", "bitscore", "evalue").alias("value"))
    return head.unionByName(lines), unscored(fragments, hits).select(F.col("fragment").cast("string").alias("value"))


def split_by_length(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """SNK15: records of at most `most` characters, and the others."""
    n = F.length("seq")
    return fasta(rows.where(n <= most)), fasta(rows.where(n > most))


def name_map(nodes: DataFrame) -> DataFrame:
    """SNK13, FN9: (tree_id, safe, name) of inner names: the table that brings original labels back."""
    from cladeframe.functions.sequences import safe_label

    return nodes.where("not is_leaf and name is not null").select("tree_id", safe_label("name", "node_id").alias("safe"), "name")


def write(values: DataFrame, path: str, overwrite: bool = False) -> None:
    """FLT10: write a text column; results that are there already are an error unless asked to go."""
    values.write.mode("overwrite" if overwrite else "errorifexists").text(path)
