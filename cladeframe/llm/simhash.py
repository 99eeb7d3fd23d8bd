"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Each distinct 64-bit fingerprint emits every value within half the radius. Two fingerprints within the radius share
at least one such value, so one shuffle on the values finds all links. Conversely, two fingerprints that share a
value are within twice half the radius of each other, so a bucket is a clique and holds no more fingerprints than a
ball has values (65 at half radius 1): buckets are bounded by construction, whatever the data.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, cut

BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of the whole text: a bit is 1 if it is set in over half of the shingles' XXH64."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = list(accumulate((len(p) + 1 for p in parts)))
    starts = [0, *ends[:-1]]
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    n, ones = len(parts) - k + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : min(at + BLOCK, n)], ends[at + k - 1 : at + k - 1 + BLOCK])
        part = np.array([digest(joined[s : e - 1], seed) for s, e in spans], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp long): fingerprints of whole texts. Null or wordless text has fingerprint 0."""

    def run(batches):
        for pdf in batches:
            fps = np.array([fingerprint(t, words) for t in pdf["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": pdf["id"], "fp": fps.view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, fp long")


def ball(fp: str, half: int):
    """Array of all values within `half` (0 or 1) bits of column fp."""
    own = F.array(F.col(fp))
    if half == 0:
        return own
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col(fp).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.concat(own, flips)


def unflipped(place: str):
    """The fingerprint whose ball has column variant at this place of it."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(place) - 1)
    return F.when(F.col(place) == 0, F.col("variant")).otherwise(F.col("variant").bitwiseXOR(one))


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b, distance) that connect all of (id, fp) within `radius` bits.

    In each bucket neighbours in order are linked; since a bucket is a clique, these chains connect exactly what all
    pairs would, and no fingerprint gets more than two links from a bucket. A value is shuffled with its place in the
    ball only, which tells the fingerprint; ids follow for the links. At radius 1 a bucket is no clique: its members are
    linked to the fingerprint that the bucket is named by, if there is one.
    """
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2")
    half = (radius + 1) // 2
    if radius == 1:
        spread = distinct.select("id", "fp", F.explode(ball("fp", half)).alias("variant"))
        centre = distinct.select(F.col("id").alias("a"), F.col("fp").alias("variant"))
        return spread.where("variant <> fp").join(centre, "variant").select("a", F.col("id").alias("b"), F.lit(1).alias("distance"))
    named = distinct.where(F.col("id").isNotNull())
    first = named.groupBy("fp").agg(F.min("id").alias("id"))
    same = named.join(first.toDF("fp", "a"), "fp").where("a <> id").select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    met = first.select(F.posexplode(ball("fp", half)).alias("flip", "variant"))
    met = met.withColumn("before", F.lag("flip").over(Window.partitionBy("variant").orderBy("flip"))).where(F.col("before").isNotNull())
    pairs = met.select(unflipped("before").alias("fa"), unflipped("flip").alias("fb")).distinct()
    pairs = pairs.withColumn("distance", F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))).where(F.col("distance") <= radius)
    pairs = pairs.join(first.toDF("fa", "a"), "fa").join(first.toDF("fb", "b"), "fb")
    return pairs.select("a", "b", "distance").unionByName(same)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """One row per document: id_col, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Null and empty texts have fingerprint 0 and link like any other. Repeated ids are repeated in the result. Exact
    copies are reduced to one fingerprint before anything is compared, so a large group of copies costs one row.
    An empty table gives an empty result; other columns of docs, whatever their names, are ignored.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("id")))
    comps = connected_components(links(distinct, radius))
    classes = distinct.join(comps, distinct["id"] == comps["node"], "left")
    classes = cut(classes.select("fp", F.coalesce("component", "id").alias("component_id")))
    out = fps.join(classes, "fp")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """Rows of docs whose id is the smallest of its component, columns unchanged.

    Rows without an id stay, as nothing can name them; so do all rows that share a kept id.
    """
    found = near_duplicates(docs, id_col, text_col, radius, words)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
