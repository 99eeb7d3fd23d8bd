"""Files that the applications write, as one table of records: Spark writes a folder of parts for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.operators import merge, sites
from cladeframe.sources import documents, sinks


def alignment_files(merged: DataFrame, cols: DataFrame) -> DataFrame:
    """SNK12: (file, name, value) of a merged alignment (name, pos, ch) with columns (anchor, ord, pos).

    `alignment.fasta` has all columns, `alignment_masked.fasta` those that are no insertions; value is a name's row of equal
    length. `insertion_columns.txt` is one record without a name: the insertions' positions as ranges, `` if there are none.
    """
    own = merge.render(merged, cols).select(F.lit("alignment.fasta").alias("file"), F.col("name").cast("string").alias("name"), F.col("seq").alias("value"))
    kept = sites.renumbered(cols.where("ord = 0").select("pos"))
    firm = merged.join(kept, "pos").select("name", F.col("new_pos").alias("pos"), "ch")
    rows = merged.select("name").distinct()
    masked = rows.join(merge.render(firm, kept), "name", "left").select(F.lit("alignment_masked.fasta").alias("file"), F.col("name").cast("string").alias("name"), F.coalesce("seq", F.repeat(F.lit("-"), F.lit(kept.count()))).alias("value"))
    ranges = sites.ranges_text(sites.islands(cols.where("ord > 0").select("pos")))
    note = ranges.select(F.lit("insertion_columns.txt").alias("file"), F.lit(None).cast("string").alias("name"), F.coalesce("ranges", F.lit("")).alias("value"))
    return own.unionByName(masked).unionByName(note)


def placement_files(merged: DataFrame, cols: DataFrame, placements: DataFrame, labels: DataFrame) -> DataFrame:
    """SNK11: alignment files, and `placement.json` (a document for each doc_id of placements) and `rename.tsv`, a record for
    each label (name, safe) that was made safe."""
    docs = documents.to_jplace(placements).select(F.lit("placement.json").alias("file"), F.col("doc_id").cast("string").alias("name"), F.col("json").alias("value"))
    names = labels.select(F.lit("rename.tsv").alias("file"), F.col("safe").alias("name"), F.col("name").cast("string").alias("value"))
    return alignment_files(merged, cols).where("file <> 'insertion_columns.txt'").unionByName(docs).unionByName(names)


def write(files: DataFrame, path: str) -> None:
    """Every file of (file, name, value) to a folder of its name under path, sorted by name; an existing one is an error."""
    for name in [r[0] for r in files.select("file").distinct().collect()]:  # as many as the applications have files
        own = files.where(F.col("file") == name)
        lines = sinks.fasta(own.select("name", F.col("value").alias("seq"))) if name.endswith(".fasta") else own.orderBy("name").select(F.concat_ws("\t", F.col("name") if name.endswith(".tsv") else F.lit(None).cast("string"), "value").alias("value"))
        sinks.write(lines, f"{path.rstrip('/')}/{name}")
