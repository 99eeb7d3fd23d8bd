"""Distances between rows of alignments: rows are packed to bit planes, so a pair of rows is one row and 64 sites one word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.sequences import GAP


def packed(sites: DataFrame, keys: list[str], gap_is_state: bool = False) -> DataFrame:
    """(…keys, name, words) of the rows of alignments: for every 64 sites the set of those with a character, and of their
    characters' numbers one set a bit. Gaps are no characters unless gap_is_state. All rows of an alignment have as many
    words; at a site a row holds one character, the largest if several are given."""
    bits = (sites.agg(F.max(F.ascii("ch"))).first()[0] or 1).bit_length()
    live = sites if gap_is_state else sites.where(F.col("ch") != GAP)
    one = live.groupBy(*keys, "name", "pos").agg(F.max(F.ascii("ch")).alias("c"))
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    sets = [F.bit_or(bit).alias("p"), *[F.bit_or(F.when(F.expr(f"getbit(c, {k})") == 1, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(bits)]]
    names = ["p", *[f"b{k}" for k in range(bits)]]
    word = one.groupBy(*keys, "name", F.floor(F.col("pos") / 64).cast("int").alias("w")).agg(*sets)
    held = word.groupBy(*keys, "name").agg(F.map_from_entries(F.collect_list(F.struct("w", F.struct(*names)))).alias("held"))
    every = sites.groupBy(*keys, "name").agg(F.lit(1).alias("_n"))
    size = sites.groupBy(*keys).agg(F.floor(F.max("pos") / 64).cast("int").alias("last"))
    none = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])
    out = every.join(size, keys).join(held, [*keys, "name"], "left")
    filled = F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.element_at("held", w), none))
    return out.select(*keys, "name", filled.alias("words"))


def pairs(sites: DataFrame, keys: list[str], gap_is_state: bool = False) -> DataFrame:
    """JN1, FN3: (…keys, a, b, shared, d) for every two names a < b of an alignment.

    d is the share of differing sites among those where neither row has a gap, 0 if there is none. gap_is_state: gaps
    count as a character of their own (the variant that averages over all sites). One row a pair, from two packed rows.
    """
    rows = packed(sites, keys, gap_is_state)
    x, y = rows.withColumnsRenamed({"name": "a", "words": "x"}), rows.withColumnsRenamed({"name": "b", "words": "y"})
    planes = [f.name for f in rows.schema["words"].dataType.elementType.fields if f.name != "p"]

    def counted(s, t):
        both, unlike = s["p"].bitwiseAND(t["p"]), F.lit(0).cast("long")
        for n in planes:
            unlike = unlike.bitwiseOR(s[n].bitwiseXOR(t[n]))
        return F.struct(F.bit_count(both).cast("long").alias("shared"), F.bit_count(unlike.bitwiseAND(both)).cast("long").alias("unlike"))

    zero = F.struct(F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("unlike"))
    total = F.aggregate(F.zip_with("x", "y", counted), zero, lambda t, w: F.struct((t["shared"] + w["shared"]).alias("shared"), (t["unlike"] + w["unlike"]).alias("unlike")))
    met = x.join(y, keys).where("a < b").select(*keys, "a", "b", total.alias("t"))
    return met.select(*keys, "a", "b", F.col("t.shared").alias("shared"), F.coalesce(F.col("t.unlike") / F.nullif(F.col("t.shared"), F.lit(0).cast("long")), F.lit(0.0)).alias("d"))


def both_ways(d: DataFrame, keys: list[str] = ()) -> DataFrame:
    """JN1: every pair in both orders."""
    return d.unionByName(d.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in d.columns if c not in (*keys, "a", "b")]))


def summary(d: DataFrame, keys: list[str]) -> DataFrame:
    """AG1, AG2: (…keys, pairs, mean, largest)."""
    return d.groupBy(*keys).agg(F.count("*").alias("pairs"), F.avg("d").alias("mean"), F.max("d").alias("largest"))


def within(d: DataFrame, leaves: DataFrame, stat: str = "mean") -> DataFrame:
    """AG2: mean or largest distance between the names of a subset."""
    own = d.join(leaves.select(F.col("name").alias("a")), "a", "left_semi").join(leaves.select(F.col("name").alias("b")), "b", "left_semi")
    return own.agg((F.avg("d") if stat == "mean" else F.max("d")).alias("d"))
