"""Routing of fragments to models: best hits, unscored fragments, chunks, names, lengths and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.ordinals import ordinal, running
from cladeframe.functions.sequences import degap, lcm


def best_hit(hits: DataFrame, order: list[str], fragment: str = "fragment", score: str = "bitscore") -> DataFrame:
    """WN3: the row of the highest score of each fragment; ties go to the first by the columns `order`.

    An aggregate with map-side combination (no sort, no window), so fragments with very many hits are no problem.
    """
    carried = [c for c in hits.columns if c != fragment]
    # The least struct wins; scores descend.
    key = F.struct((-F.col(score)).alias("_s"), *order)
    best = hits.where(F.col(score).isNotNull()).groupBy(fragment).agg(F.min_by(F.struct(*carried), key).alias("b"))
    return best.select(fragment, "b.*")


def unscored(fragments: DataFrame, hits: DataFrame, fragment: str = "fragment") -> DataFrame:
    """AG9"""
    return fragments.select(fragment).distinct().join(hits.where(F.col("bitscore").isNotNull()), fragment, "left_anti")


def all_scores(fragments: DataFrame, hits: DataFrame, fragment: str = "fragment") -> DataFrame:
    """AG8: (fragment, scores: array of (bitscore, evalue), best first); empty for unmatched fragments."""
    pair = F.when(F.col("bitscore").isNotNull(), F.struct("bitscore", "evalue"))
    got = fragments.select(fragment).distinct().join(hits.select(fragment, "bitscore", "evalue"), fragment, "left")
    return got.groupBy(fragment).agg(F.sort_array(F.collect_list(pair), asc=False).alias("scores"))


def score_lines(hits: DataFrame, fragment: str = "fragment") -> DataFrame:
    """SNK9: seq, bitscore (4 decimals) and evalue (scientific) of every hit as text."""
    return hits.select(F.col(fragment).alias("seq"), F.format_string("%.4f", "bitscore").alias("bitscore"), F.format_string("%.3e", "evalue").alias("evalue"))


def chunk_count(n: int, chunks: int, most: int | None = None) -> int:
    """WN1"""
    return n // most + 1 if most and n / chunks > most else chunks


def chunks_per_subset(subsets: int, cpus: int) -> int:
    """WN2"""
    return lcm(subsets, cpus) // subsets


def round_robin(rows: DataFrame, chunks: int | Column, order: list[str], keys: list[str] = ()) -> DataFrame:
    """WN1, WN4: rows with chunk = place in order, modulo chunks, within each of keys."""
    n = F.lit(chunks) if isinstance(chunks, int) else chunks
    return ordinal(rows, list(keys), order, "chunk").withColumn("chunk", (F.col("chunk") % n).cast("int"))


def split_by_length(rows: DataFrame, most: int, seq: str = "seq") -> DataFrame:
    """FLT1, SNK15: rows with is_fragment: at most `most` characters."""
    return rows.withColumn("is_fragment", F.length(seq) <= most)


def length_quantile(rows: DataFrame, q: float = -1, seq: str = "seq", keys: list[str] = ()) -> DataFrame:
    """AG6: the length at quantile q of the degapped rows (-1: 0.5; 1 or more: q itself).

    With n lengths in order and i = floor(n q): the i-th from 0 if n is odd or i the last, else the mean of it and
    the next. For even n that is not the usual median. Counts per length are aggregated first, so the order statistic
    costs running sums over different lengths only.
    """
    n = F.length(degap(seq))
    if q >= 1:
        return rows.groupBy(*keys).agg(F.lit(float(q)).alias("length"))
    q = 0.5 if q == -1 else q
    counts = rows.groupBy(*keys, n.alias("len")).agg(F.count("*").alias("c"))
    total = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    upto = running(counts, list(keys), ["len"], F.col("c"), "upto").withColumn("upto", F.col("upto") + F.col("c"))
    ranked = (upto.join(total, list(keys)) if keys else upto.withColumn("n", F.lit(total.first()["n"]))).withColumn("i", F.floor(F.col("n") * q))
    has = lambda i: F.max(F.when((F.col("upto") > i) & (F.col("upto") - F.col("c") <= i), F.col("len")))
    out = ranked.groupBy(*keys).agg(has(F.col("i")).alias("a"), has(F.col("i") + 1).alias("b"), F.first("n").alias("n"), F.first("i").alias("i"))
    single = (F.col("n") % 2 == 1) | (F.col("i") == F.col("n") - 1)
    return out.select(*keys, F.when(single, F.col("a").cast("double")).otherwise((F.col("a") + F.col("b")) / 2.0).alias("length"))


def length_band(rows: DataFrame, middle: DataFrame, tolerance: float = 0.25, seq: str = "seq") -> DataFrame:
    """FLT2: rows with full: the degapped length lies in int(M (1 - t)) … int(M (1 + t))."""
    m = middle.first()["length"]
    return rows.withColumn("full", F.length(degap(seq)).between(int(m * (1 - tolerance)), int(m * (1 + tolerance))) if m is not None else F.lit(None).cast("boolean"))


def collisions(queries: DataFrame, reference: DataFrame, name: str = "name") -> DataFrame:
    """FLT3, JN4, ST3: names in both."""
    return queries.select(name).distinct().join(reference.select(name), name, "left_semi")


def without_collisions(queries: DataFrame, reference: DataFrame, name: str = "name", ignore: bool = False) -> DataFrame:
    """FLT3: queries without those named like a reference row; unless `ignore`, such a name is an error."""
    if not ignore and (bad := collisions(queries, reference, name).limit(3).collect()):
        raise ValueError(f"query names that are reference names: {[r[0] for r in bad]}")
    return queries.join(reference.select(name), name, "left_anti")


def whitespace_names(rows: DataFrame, name: str = "name") -> DataFrame:
    """FLT4: rows whose name holds a space or tab."""
    return rows.where(F.col(name).rlike("[ \\t]"))


def with_extra(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """FLT5: queries and further rows, degapped."""
    return queries.select("name", "seq").unionByName(rows.select("name", degap("seq").alias("seq")))


def last_wins(rows: DataFrame, order: str, name: str = "name") -> DataFrame:
    """SRC2, ST6: of rows with one name the last value stays, at the place of the first."""
    carried = [c for c in rows.columns if c not in (name, order)]
    got = rows.groupBy(name).agg(F.max_by(F.struct(*carried), F.col(order)).alias("v"), F.min(order).alias(order))
    return got.select(name, order, "v.*")


def sample_names(rows: DataFrame, k: int, seed: int = 297834, name: str = "name") -> DataFrame:
    """WN11: k rows (all, if fewer) picked by a hash of name and seed; the same at every run."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(name).cast("string")))
    return rows.withColumn("_h", key).orderBy("_h", name).limit(k).drop("_h")


def size_rule(n: int, alignment: int | None = None, placement: int | None = None) -> tuple[int, int]:
    """FLT11: alignment and placement subset sizes from n leaves and what is given; neither exceeds n, nor the first the second."""
    tenth = int(0.10 * n)
    if alignment is None:
        alignment = tenth if placement is None else placement
    if placement is None:
        placement = max(tenth, alignment)
    return min(alignment, placement, n), min(placement, n)


def size_columns(n: Column, alignment: Column, placement: Column) -> tuple[Column, Column]:
    """FLT11 for many trees at once: size_rule on columns, of which the last two may be null."""
    tenth = F.floor(n / 10).cast("long")
    a = F.coalesce(alignment.cast("long"), placement.cast("long"), tenth)
    p = F.coalesce(placement.cast("long"), F.greatest(tenth, a))
    return F.least(a, p, n.cast("long")), F.least(p, n.cast("long"))
