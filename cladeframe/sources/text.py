"""Scans of text formats. Lines are numbered inside their file, so that order-dependent formats need no driver pass."""

from __future__ import annotations

import configparser
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions.lineage import materialise
from cladeframe.functions.ordinals import running
from cladeframe.functions.sequences import normalise

STRETCH = 1 << 14


def lines(spark: SparkSession, path: str, files: str | None = None) -> DataFrame:
    """(file, ln, line) of text files, ln from 0. Files of any size are divided among tasks.

    The reader tells of every line in which block of its file it begins, and reads a block in order. Lines are counted by
    block; a line's number is its place in its block after all lines of the blocks before.
    """
    r = spark.read
    t = (r.option("pathGlobFilter", files) if files else r).text(path)
    t = materialise(t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")))
    blocks = t.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offset = blocks.select("file", "start", "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return t.join(offset, ["file", "start"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("ln"), "line")


def numbered(texts: DataFrame) -> DataFrame:
    """(file, ln, line) of (file, text)."""
    return texts.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("ln", "line"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: (name, seq, file_pos) of FASTA files, split at record starts by the reader itself.

    Files of any size are divided among tasks: a record ends where a line begins with ">". file_pos, of file, block and
    place, orders records of one read. Text before the first header, or an empty header, is an error; an empty file has no rows.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("value").alias("r"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")).alias("file_pos"))
    return fasta_records(raw)


def fasta_records(raw: DataFrame) -> DataFrame:
    """(name, seq, file_pos) of (r, file_pos): records without the leading ">", but for the first of a file."""
    body = raw.where(F.trim("r") != "")
    name = F.trim(F.regexp_replace(F.regexp_extract("r", r"^([^\r\n]*)", 1), "^>", ""))
    seq = normalise(F.regexp_replace(F.regexp_extract("r", r"(?s)^[^\r\n]*(.*)$", 1), "", ""))
    bad = F.raise_error(F.lit("a record has no name, or text stands before the first header")).cast("string")
    return body.select(F.when(name == "", bad).otherwise(name).alias("name"), seq.alias("seq"), "file_pos")


def alignment(spark: SparkSession, path: str, kind: str = "FASTA") -> DataFrame:
    """SRC2: (name, seq, file_pos); of records with one name the last value counts, at the first's place."""
    from cladeframe.operators.routing import last_wins

    if kind.upper() != "FASTA":
        raise NotImplementedError(kind)
    return last_wins(fasta(spark, path), "file_pos")


def stockholm(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC3, SRC4: sequences (file, name, seq) and columns (file, pos, label) of numbered lines (file, ln, line).

    Blocks are runs of "key text" lines between blank or # lines; reading ends at //. "." becomes "-". A column is an
    insertion (label -1) where the first row of its block has a lower-case letter, "*" or "."; the others are
    numbered from 0. Lines of one file are divided among tasks; rows of a name and columns of a block meet in one.
    """
    end = rows.where(F.trim("line") == "//").groupBy("file").agg(F.min("ln").alias("end"))
    x = rows.join(end, "file", "left").where("end is null or ln < end").select("file", F.col("ln").cast("long").alias("ln"), "line", (~F.col("line").rlike(r"^\s*(#|$)")).alias("data"))
    x = materialise(x.withColumn("stretch", F.floor(F.col("ln") / STRETCH).cast("long")))
    # A block starts at a data line after another kind of line. What stands before a stretch of lines comes by a join.
    before = x.where((F.col("ln") + 1) % STRETCH == 0).select("file", (F.col("stretch") + 1).alias("stretch"), F.col("data").alias("edge"))
    w = Window.partitionBy("file", "stretch").orderBy("ln")
    lagged = x.withColumn("prev", F.lag("data").over(w)).join(before, ["file", "stretch"], "left")
    starts = lagged.withColumn("starts", (F.col("data") & ~F.coalesce("prev", F.when(F.col("ln") % STRETCH == 0, F.col("edge")), F.lit(False))).cast("int"))
    x = running(starts.where("data"), ["file"], ["ln"], F.col("starts"), "block").withColumn("block", F.col("block") + F.col("starts"))
    x = materialise(x.select("file", "ln", "block", F.regexp_extract("line", r"^\s*(\S+)\s+(\S+)", 1).alias("name"), F.regexp_extract("line", r"^\s*(\S+)\s+(\S+)", 2).alias("part")))
    chunks = F.array_sort(F.collect_list(F.struct("ln", "part")))
    seqs = x.groupBy("file", "name").agg(F.replace(F.array_join(F.transform(chunks, lambda c: c["part"]), ""), F.lit("."), F.lit("-")).alias("seq"))
    first = x.groupBy("file", "block").agg(F.min_by("part", "ln").alias("part"))
    # Columns before a block, and how many of them are no insertions, are running sums over blocks.
    size = running(first, ["file"], ["block"], F.length("part"), "before")
    size = running(size, ["file"], ["block"], F.regexp_count("part", F.lit("[^a-z*.]")), "own_before")
    cols = size.select("file", "block", "before", "own_before", F.posexplode(F.filter(F.split("part", ""), lambda c: c != "")).alias("k", "c")).withColumn("own", ~F.col("c").rlike("[a-z*.]"))
    v = Window.partitionBy("file", "block").orderBy("k")
    label = F.when(F.col("own"), F.col("own_before") + F.sum(F.col("own").cast("int")).over(v) - 1).otherwise(-1)
    return seqs, cols.select("file", (F.col("before") + F.col("k")).cast("int").alias("pos"), label.cast("int").alias("label"))


def search_hits(rows: DataFrame) -> DataFrame:
    """SRC16: (file, name, evalue, bitscore) of search reports: the table from its E-value heading to the next blank line.

    Rule and threshold lines (dashes only) are skipped; a name may hold dashes. The table's ends are minima of line
    numbers, which need only rise within a file, so the lines of one file are divided among tasks.
    """
    head, blank = F.col("line").rlike(r"^\s*E-value\b"), F.trim("line") == ""
    x = rows.join(rows.where(head).groupBy("file").agg(F.min("ln").alias("first")), "file").where("ln > first")
    ends = x.where(head | blank).groupBy("file").agg(F.min("ln").alias("end"))
    x = x.join(ends, "file", "left").where("end is null or ln < end")
    f = F.split(F.trim("line"), r"\s+")
    x = x.select("file", f.alias("f")).where((F.size("f") >= 9) & ~F.forall("f", lambda v: v.rlike("^-+$")) & ~F.get("f", F.lit(0)).rlike("^-"))
    return x.select("file", F.get("f", F.lit(8)).alias("name"), F.get("f", F.lit(0)).cast("double").alias("evalue"), F.get("f", F.lit(1)).cast("double").alias("bitscore"))


def paired_manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC13: main tree (file, newick) and pairs (file, nth, newick, path) of manifests: a tree, then tree and path by turns."""
    w = Window.partitionBy("file").orderBy("ln")
    x = rows.withColumn("blank", F.max((F.trim("line") == "").cast("int")).over(w)).where("blank = 0").withColumn("next", F.lead("line").over(w))
    pairs = x.where("ln % 2 = 1 and next is not null").select("file", ((F.col("ln") + 1) / 2).cast("int").alias("nth"), F.col("line").alias("newick"), F.col("next").alias("path"))
    return x.where("ln = 0").select("file", F.col("line").alias("newick")), pairs


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: (tax_id, parent_id, rank, tax_name): the first four columns of quoted CSV files with a heading."""
    t = spark.read.csv(path, header=True, quote='"', escape='"')
    names = ["tax_id", "parent_id", "rank", "tax_name"]
    return t.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(t.columns, names)])


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: (name, tax_id), the last of a name's rows."""
    t = spark.read.csv(path, header=True)
    m = t.select(F.col(f"`{t.columns[0]}`").alias("name"), F.col(f"`{t.columns[1]}`").alias("tax_id"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    return m.groupBy("name").agg(F.max_by("tax_id", "at").alias("tax_id"))


def edge_lengths(trees: DataFrame, newick: str = "newick") -> DataFrame:
    """SRC10: (edge_num, length) of all `:length[n]` in trees, quotes taken off first."""
    t = F.replace(newick, F.lit("'"), F.lit(""))
    part = lambda k: F.regexp_extract_all(t, F.lit(r":([^\[{(),]*)[\[{](\d+)[\]}]"), F.lit(k))
    x = trees.select(F.explode(F.arrays_zip(part(1).alias("l"), part(2).alias("e"))).alias("x"))
    return x.select(F.col("x.e").cast("int").alias("edge_num"), F.col("x.l").cast("double").alias("length"))


RATES = ["A <-> C", "A <-> G", "A <-> T", "C <-> G", "C <-> T", "G <-> T"]


def model_info(rows: DataFrame) -> DataFrame:
    """SRC18: one row per file: alpha, six rates, four base frequencies, final likelihood and time of a tree-fit report."""
    number = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"

    def last(pattern: str, group: int = 1) -> Column:
        hit = F.regexp_extract("line", pattern, group)
        return F.max_by(F.when(hit != "", hit), F.when(hit != "", F.col("ln"))).cast("double")

    rates = [last(rf"(?i)rate\s+{r.replace(' ', r'\s*')}\s*:\s*{number}").alias("rate_" + r.replace(" <-> ", "").lower()) for r in RATES]
    freqs = [last(rf"(?i)freq\s+pi\({b}\)\s*:\s*{number}").alias(f"freq_{b.lower()}") for b in "ACGT"]
    return rows.groupBy("file").agg(last(rf"(?i)alpha\s*:\s*{number}").alias("alpha"), *rates, *freqs, last(rf"(?i)final .*likelihood\s*:\s*{number}").alias("final_likelihood"), last(rf"(?i)(?:overall|total) .*time[^:]*:?\s*{number}").alias("time_s"))


def logged_paths(rows: DataFrame) -> DataFrame:
    """SRC19: (file, alignment, tree): the last paths that a job's log names."""
    at = lambda p: F.max_by(F.when(F.regexp_extract("line", p, 1) != "", F.regexp_extract("line", p, 1)), F.when(F.regexp_extract("line", p, 1) != "", F.col("ln")))
    return rows.groupBy("file").agg(at(r"Writing resulting alignment to (.*)").alias("alignment"), at(r"Writing resulting tree to (.*)").alias("tree"))


def config(path: str, expand: bool = False) -> tuple[list[str], dict[str, dict[str, str]]]:
    """SRC20: command-line words of [commandline], and the other sections of an INI file."""
    c = configparser.ConfigParser()
    c.optionxform = str
    with open(path, encoding="utf-8") as f:
        c.read_file(f)
    full = lambda v: os.path.abspath(os.path.expanduser(v)) if expand and os.sep in v else v
    words = [w for k, v in (c.items("commandline") if c.has_section("commandline") else []) for w in (f"--{k}", full(v)) if w]
    return words, {s: {k: full(v) for k, v in c.items(s)} for s in c.sections() if s != "commandline"}
