"""Near copies by similarity of word shingles: an exact set-similarity join by prefixes.

A text is the set of its five-word shingles' hashes. Sets are put into one order, shingles that a sample finds common
last. If two sets have a Jaccard similarity of at least 4/5, each holds at least 4/5 of the other's size in common
shingles, so their first n - ceil(4n/5) + 1 shingles share one: texts meet in a shuffle on these and no pair is missed,
whatever the order. The sample decides on speed only. Where they meet first, enough of both must follow for the
similarity, so places in the sets rule most other pairs out. All pairs of a small bucket come from its one shuffle.
Common prefixes of many near copies do not make all their pairs: of these pairs every text verifies its nearest, and in
large buckets all meet the same few hubs; then come only pairs that the links found so far leave apart. Before sets are
compared, parities of theirs must be close: a lower bound of their true difference.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, cut, free_name

SAMPLE_DOCS = 8192
COMMON = 65_536
SENT_ROWS = 1_000_000
ROWS_AT_ONCE = 512
HUBS = 4
LARGE = 8
PLACES = 16
SLOTS = 16
PAIRS_A_ROW = 64
SETS_A_LINK = 256


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct signed XXH64 of the shingles of the whole text; a shorter text is one shingle, a wordless none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.array([], dtype=np.int64)
    joined = b" ".join(parts)
    ends = list(accumulate((len(p) + 1 for p in parts)))
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[s : e - 1], seed) for s, e in zip([0, *ends], ends[k - 1 :]))
    return np.unique(np.fromiter(hashes, dtype=np.uint64, count=len(parts) - k + 1).view(np.int64))


def signature(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.astype("<i8").tobytes(), 7)).view(np.int64))


def common_shingles(docs: DataFrame, text_col: str = "text", words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of at most COMMON shingles that about SAMPLE_DOCS different texts hold most often."""
    rate = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    own = docs.select(F.col(text_col).alias("text"))
    own = own.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20)) + 1)).distinct()

    def run(batches):
        for pdf in batches:
            sets = [shingles(t, words) for t in pdf["text"]]
            yield pd.DataFrame({"h": np.concatenate(sets) if sets else np.array([], dtype=np.int64)})

    found = own.mapInPandas(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON)
    got = sorted((r.h, r.n) for r in found.collect())
    return np.array([h for h, _ in got], dtype=np.int64), np.array([n for _, n in got], dtype=np.int64)


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which a set at similarity 4/5 or more shares at least one with this one's."""
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        s = s[np.lexsort((s, np.where(common[at] == s, counts[at], 0)))]
    return s[: len(s) - (4 * len(s) + 4) // 5 + 1]


def parities(s: np.ndarray) -> np.ndarray:
    """At least 256 and n bits, as longs: the parity of the set's shingles by their lower bits.

    Two sets differ in no fewer shingles than bits. The number of bits is a power of two, so the two halves of the
    longs, one laid over the other by exclusive or, are the parities of half as many bits.
    """
    bits = 256
    while bits < len(s):
        bits *= 2
    odd = np.bincount((s.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def pieces(batches):
    """Batches in pieces of ROWS_AT_ONCE rows, which bounds the Python objects that live at once."""
    for pdf in batches:
        for at in range(0, max(1, len(pdf)), ROWS_AT_ONCE):
            yield pdf.iloc[at : at + ROWS_AT_ONCE]


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int = 5) -> DataFrame:
    """(id, t, fp, sig, n, prefix, bits) of all rows: hash of the text, SimHash of three-word shingles, hash and size of
    the set; prefix and parities only where a task meets a set for the first time."""
    common, counts = common_shingles(docs, text_col, words)

    def run(batches):
        met = set()
        for pdf in pieces(batches):
            out = []
            for key, t, text in zip(pdf["id"], pdf["t"], pdf["text"]):
                s = shingles(text, words)
                sig, fp = signature(s), int(np.uint64(simhash.fingerprint(text)).view(np.int64))
                if sig in met:
                    out.append((key, t, fp, sig, len(s), [], None))
                else:
                    met.add(sig)
                    out.append((key, t, fp, sig, len(s), prefix(s, common, counts), parities(s)))
            yield pd.DataFrame(out, columns=["id", "t", "fp", "sig", "n", "prefix", "bits"]).astype({"id": pdf["id"].dtype})

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, f"id {kind}, t long, fp long, sig long, n int, prefix array<long>, bits array<long>")


def one_each(rows: DataFrame) -> DataFrame:
    """(sig, id, rep, n, bits) of every set: the smallest id of its rows, and (id, t) of one of them."""
    bits = F.first("bits", ignorenulls=True).alias("bits")
    return rows.groupBy("sig").agg(F.min("id").alias("id"), F.min(F.struct("id", "t")).alias("rep"), F.any_value("n").alias("n"), bits)


def differing(x, y):
    """Number of bits in which two arrays of longs differ; the longer one is folded to half its length."""
    k = F.least(F.size(x), F.size(y))
    fold = lambda v: F.when(F.size(v) > k, F.zip_with(F.slice(v, F.lit(1), k), F.slice(v, k + 1, k), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(v))
    return F.aggregate(F.zip_with(fold(x), fold(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, p: n + p)


def short(bits: str, longs: int = 16):
    """Parities folded to 1024 bits, if they are more."""
    fold = F.transform(F.sequence(F.lit(0), F.lit(longs - 1)), lambda k: F.aggregate(F.filter(bits, lambda x, i: i % longs == k), F.lit(0).cast("long"), lambda n, x: n.bitwiseXOR(x)))
    return F.when(F.size(bits) <= longs, F.col(bits)).otherwise(fold)


def enough(n, r, m, s):
    """Sets of n and m shingles that meet first where r and s of them are left can have a similarity of 4/5."""
    return 9 * F.least(r, s) >= 4 * (n + m)


def close(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of sets whose parities do not rule a similarity of 4/5 out.

    Such sets differ in at most a ninth of their sizes' sum.
    """
    bits = own.select("sig", "n", "bits")
    both = pairs.join(bits.toDF("a", "na", "ba"), "a").join(bits.toDF("b", "nb", "bb"), "b")
    return both.where(9 * differing("ba", "bb") <= F.col("na") + F.col("nb")).select("a", "b")


def marked(docs: DataFrame, key, keys: DataFrame, name: str) -> DataFrame:
    """docs with a boolean column `name`: false only where column key (long) is not in column key of keys.

    Keys are bits of a bitmap of SLOTS bits a key, which is broadcast in pieces of 4 KB; about one row in SLOTS is true
    without being in keys. Joins on the key then need to shuffle the rows that are true, and no others.
    """
    slots = SLOTS * max(1, keys.count())
    slot, piece, bits = (free_name(docs, f"{name}_{c}") for c in ("slot", "piece", "bits"))
    own = keys.select((F.pmod("key", F.lit(slots)) + 1).alias(slot))
    maps = own.groupBy(F.bitmap_bucket_number(slot).alias(piece)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias(bits))
    found = docs.withColumn(slot, F.pmod(key, F.lit(slots)) + 1).withColumn(piece, F.bitmap_bucket_number(slot)).join(F.broadcast(maps), piece, "left")
    byte = F.conv(F.hex(F.expr(f"substring(`{bits}`, cast(bitmap_bit_position(`{slot}`) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = F.call_function("getbit", byte, (F.bitmap_bit_position(slot) % 8).cast("int"))
    return found.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(slot, piece, bits)


def verified(pairs: DataFrame, own: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int = 5) -> DataFrame:
    """Those of pairs (a, b) whose sets have a similarity of at least 4/5, by the sets themselves."""
    pairs = cut(pairs.select("a", "b"))
    ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    need = cut(own.join(ends, "sig", "left_semi").select("rep.id", "rep.t"))
    texts = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_t"), F.col(text_col).alias("text"))
    if need.count() <= SENT_ROWS:  # 16 bytes a row; beyond that the texts that may be needed are shuffled
        need = F.broadcast(need)
    else:
        texts = marked(texts, F.xxhash64("own_id", "own_t"), need.select(F.xxhash64("id", "t").alias("key")), "mark").where("mark")

    def run(batches):
        met = set()
        for pdf in pieces(batches):
            sets = [shingles(t, words) for t in pdf["text"]]
            fresh = [(sig, s) for s in sets if not ((sig := signature(s)) in met or met.add(sig))]
            yield pd.DataFrame(fresh, columns=["sig", "u"]).astype({"sig": "int64"})

    texts = texts.join(need, (F.col("own_t") == F.col("t")) & F.col("own_id").eqNullSafe(F.col("id")), "left_semi")
    sets = cut(texts.select("text").mapInPandas(run, "sig long, u array<long>").dropDuplicates(["sig"]))
    both = pairs.join(sets.toDF("a", "ua"), "a").join(sets.toDF("b", "ub"), "b")
    shared = F.size(F.array_intersect("ua", "ub"))
    return cut(both.where(9 * shared >= 4 * (F.size("ua") + F.size("ub"))).select("a", "b"))


def may_link():
    n, r, m, s = map(F.col, ("n", "r", "m", "s"))
    return enough(n, r, m, s) & (9 * differing("sa", "sb") <= n + m)


def buckets(rows: DataFrame) -> DataFrame:
    """(h, sig, n, r, o) of the sets that meet others in bucket h: sizes, the most shingles left from h on, and others.

    o: all sets before this one in a bucket of at most LARGE sets, only the last in a larger one, if they may be similar.
    h is null in the small buckets, whose pairs are complete. A place in the prefix is shuffled as one of PLACES parts
    of it, in one number with the size, so r is at most a part too large.
    """
    spread = rows.select("sig", "n", F.size("prefix").alias("k"), F.posexplode("prefix").alias("p", "h"))
    spread = spread.select("h", "sig", F.expr(f"n * {PLACES}L + ({PLACES}L * p) div k").alias("at")).repartition("h").dropDuplicates(["h", "sig", "at"])
    met = spread.withColumn("c", F.count("*").over(Window.partitionBy("h"))).where("c > 1").withColumn("n", F.expr(f"at div {PLACES}"))
    met = met.withColumn("r", F.expr(f"n - ((at % {PLACES}) * (n - (4 * n + 4) div 5 + 1) + {PLACES - 1}) div {PLACES}"))
    w = Window.partitionBy("h").orderBy("n", "sig").rowsBetween(1 - LARGE, -1)
    met = met.withColumn("o", F.collect_list(F.struct("sig", "n", "r")).over(w))
    met = met.withColumn("o", F.when(F.col("c") <= LARGE, F.col("o")).otherwise(F.slice("o", -1, 1)))
    others = F.transform(F.filter("o", lambda x: enough(F.col("n"), F.col("r"), x["n"], x["r"])), lambda x: x["sig"])
    met = met.select(F.when(F.col("c") > LARGE, F.col("h")).alias("h"), "sig", "n", "r", others.alias("o"))
    return met.where(F.col("h").isNotNull() | (F.size("o") > 0))


def mixed(met: DataFrame) -> DataFrame:
    """Rows (h, component, ...) of the buckets h that hold several components."""
    several = met.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h")
    return met.join(several, "h", "left_semi")


def crossing(left: DataFrame) -> int:
    """Number of pairs of different components in the buckets of left, by counts only."""
    n = left.groupBy("h", "component").count().groupBy("h").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("own"))
    return n.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()[0] or 0


def first_hubs(large: DataFrame) -> DataFrame:
    """Pairs (a, b) of every set in a large bucket with HUBS sets of it, if they may be similar. Hubs are drawn by hash,
    so a group that meets in many buckets has the same hubs in all of them, and few different pairs."""
    drawn = [F.min_by(F.struct("sig", "n", "r"), F.xxhash64(F.lit(-1 - i), "sig")) for i in range(HUBS)]
    hubs = large.groupBy("h").agg(F.array_distinct(F.array(*drawn)).alias("hubs"))
    pairs = large.select("h", F.col("sig").alias("a"), "n", "r").join(hubs, "h").withColumn("o", F.explode("hubs"))
    pairs = pairs.where((F.col("a") != F.col("o.sig")) & enough(F.col("n"), F.col("r"), F.col("o.n"), F.col("o.r"))).select("a", F.col("o.sig").alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def to_hubs(left: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of every set with HUBS sets of its bucket, drawn anew each turn, if it is in another component."""
    drawn = [F.min_by(F.struct("sig", "n", "r", "component", "short"), F.xxhash64(F.lit(turn * HUBS + i), "sig")) for i in range(HUBS)]
    hubs = left.groupBy("h").agg(F.array_distinct(F.array(*drawn)).alias("hubs"))
    met = left.toDF("h", "a", "n", "r", "ca", "sa").join(hubs, "h").withColumn("o", F.explode("hubs"))
    met = met.select("a", "n", "r", "ca", "sa", F.col("o.sig").alias("b"), F.col("o.n").alias("m"), F.col("o.r").alias("s"), F.col("o.component").alias("cb"), F.col("o.short").alias("sb"))
    met = met.where((F.col("ca") != F.col("cb")) & may_link())
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def joined(left: DataFrame, found: DataFrame) -> DataFrame:
    """left after the links found (a, b) have joined components: the buckets that still hold several."""
    own = left.select("sig", "component").distinct()
    ends = found.join(own.toDF("a", "u"), "a").join(own.toDF("b", "v"), "b").select("u", "v")
    moved = connected_components(ends, "u", "v").toDF("component", "to")
    moved = left.join(moved, "component", "left").select("h", "sig", "n", "r", F.coalesce("to", "component").alias("component"), "short")
    return cut(mixed(cut(moved)))


def links(rows: DataFrame, own: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """Verified links (a, b) that connect all sets of own with a similarity of at least 4/5.

    Of the pairs that meet in small buckets, and of neighbours in large ones, every set verifies that which meets in most
    buckets, and those with the hubs of its large buckets, which joins most of a large group at a linear cost. While that
    finds many links, and the large buckets would still make many pairs of different components, all their sets are
    compared with further hubs. Then all pairs in one bucket that are in different components are compared, so no two
    linked sets stay apart.
    """
    met = cut(buckets(rows))
    near = met.select("sig", F.explode("o").alias("o")).select(F.least("sig", "o").alias("a"), F.greatest("sig", "o").alias("b"))
    near = cut(near.groupBy("a", "b").agg(F.count("*").alias("c")))
    ends = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    best = ends.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    large = met.where(F.col("h").isNotNull()).select("h", "sig", "n", "r")
    tried = cut(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(first_hubs(large)).distinct())
    first = verified(close(tried, own), own, docs, id_col, text_col, words)
    comps = cut(connected_components(first).withColumnRenamed("node", "sig"))
    left = cut(mixed(cut(large.join(comps, "sig", "left").withColumn("component", F.coalesce("component", "sig")))))
    shorts = own.join(left.select("sig").distinct(), "sig", "left_semi").select("sig", short("bits").alias("short"))
    left = cut(left.join(shorts, "sig").select("h", "sig", "n", "r", "component", "short"))
    found, known, turn, few = first, first, 0, left.select("sig").distinct().count() / SETS_A_LINK
    while found.count() > few and crossing(left) > PAIRS_A_ROW * left.count():
        pairs = close(to_hubs(left, turn).join(known, ["a", "b"], "left_anti"), own)
        found = verified(pairs, own, docs, id_col, text_col, words)
        known, left, turn = known.unionByName(found), joined(left, found), turn + 1
    if turn:
        comps = cut(connected_components(known).withColumnRenamed("node", "sig"))
    small = near.select("a", "b").join(comps.toDF("a", "ca"), "a", "left").join(comps.toDF("b", "cb"), "b", "left")
    small = small.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    x, y = left.toDF("h", "a", "n", "r", "ca", "sa"), left.toDF("h", "b", "m", "s", "cb", "sb")
    apart = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & may_link()
    rest = x.join(y, "h").where(apart).select("a", "b").unionByName(small).distinct()
    rest = cut(rest.join(tried.unionByName(known), ["a", "b"], "left_anti"))
    return known.unionByName(verified(close(rest, own), own, docs, id_col, text_col, words))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """Rows of docs whose id is the smallest of its group of near copies, columns unchanged.

    Near copies are texts whose shingle sets have a similarity of at least 4/5, or whose SimHashes are within 2 bits
    (the links of op6). Rows without an id stay, as nothing can name them; so do all rows that share a kept id.
    """
    rows = cut(sketches(docs, id_col, text_col, words))
    own = cut(one_each(rows))
    fps = cut(rows.groupBy("fp").agg(F.min("sig").alias("id")))
    same = rows.select("fp", F.col("sig").alias("a")).distinct().join(fps, "fp").select("a", F.col("id").alias("b")).where("a <> b")
    edges = same.unionByName(simhash.links(fps, 2).select("a", "b")).unionByName(links(rows, own, docs, id_col, text_col, words))
    comps = connected_components(edges).withColumnRenamed("node", "sig")
    own = cut(own.select("sig", "id").join(comps, "sig", "left").withColumn("component", F.coalesce("component", "sig")))
    kept = own.groupBy("component").agg(F.min("id").alias("kept"))
    gone = rows.join(own.select("sig", "component").join(kept, "component"), "sig").where("id <> kept")
    text, mark = free_name(docs, "_text"), free_name(docs, "_mark")
    gone = cut(gone.select(F.col("id").alias(id_col), F.col("t").alias(text)).distinct())
    hashed = docs.withColumn(text, F.xxhash64(text_col))
    hashed = marked(hashed, F.xxhash64(id_col, text), gone.select(F.xxhash64(id_col, text).alias("key")), mark)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    unsure = hashed.where(F.col(mark)).join(gone, [id_col, text], "left_anti").select(*columns)
    return hashed.where(~F.col(mark)).select(*columns).unionByName(unsure)
