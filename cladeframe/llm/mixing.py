"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted to cells of (source, language, topic). The tokens of the cells are raked to target marginals of
each dimension in turn. A cell's documents are then sampled with a probability in proportion to its raked over its
own tokens, scaled so that a given share of all tokens is kept; no document is repeated. Everything is DataFrame
operations: cells are partial aggregates, and documents meet their cell in an equi-join, so a source with a third
of all rows costs no task more than another. Margins are windows over the cells, not joins with them: a join in each of
the many steps broadcasts a table, and those fill the driver's memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, unit_hash

ROUNDS = 10
KEEP = 0.8
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.8}
SCALES = 400
SEED = 29
BOUNDS = 40
STEP = 0.96
TOLERANCE = 1e-3


def topic_of(text: str = "text") -> Column:
    """Topic by what marks a text: tables, symbol noise, licence lines, credentials; else its length."""
    t = F.coalesce(F.col(text), F.lit(""))
    has = lambda s: F.contains(t, F.lit(s))
    return (
        F.when(has(" | "), "table").when(has("$$$") | has("%%%"), "symbols").when(has("rights reserved") | has("icense"), "legal")
        .when(has("password=") | has("token = ") | has("AKIA"), "credentials").when(F.length(t) < 600, "brief").when(F.length(t) > 6000, "long").otherwise("prose")
    )


def tokens_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def cells(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens, docs) of a table of (source, lang, topic, tokens)."""
    return docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").cast("double").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0")


def targets(cell: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, target): every category's share of the tokens to a power, scaled to the sum of all tokens."""
    share = cell.groupBy(dim).agg(F.sum("tokens").alias("n")).withColumn("p", F.pow("n", F.lit(power)))
    total = share.agg(F.sum("n").alias("n"), F.sum("p").alias("p")).first()
    return share.select(dim, (F.col("p") / F.lit(total["p"]) * F.lit(total["n"])).alias("target"))


def aimed(cell: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """cell with the target of each of its categories beside it (null without one), so that raking needs no joins."""
    for dim, goal in goals.items():
        cell = cell.join(goal.select(dim, F.col("target").alias(f"target_{dim}")), dim, "left")
    return cut(cell)


def rake(cell: DataFrame, goals: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """cell with w: tokens fitted to the goals of each dimension, one after the other, `rounds` times.

    goals[dim] is (dim, target). A category without a goal keeps its weight.
    """
    at = aimed(cell.withColumn("w", F.col("tokens")), goals)
    for _ in range(rounds):
        for dim in goals:
            factor = F.col(f"target_{dim}") / F.sum("w").over(Window.partitionBy(dim))
            at = at.withColumn("w", F.col("w") * F.coalesce(factor, F.lit(1.0)))
        at = cut(at)
    return at.drop(*[f"target_{d}" for d in goals])


def probabilities(raked: DataFrame, keep: float = KEEP, scales: int = SCALES) -> DataFrame:
    """raked with p: least(1, c * w / tokens), c the largest of `scales` values, evenly spaced in logarithm between
    those that keep everything and nothing, that keeps at most the share `keep` of all tokens."""
    r = raked.withColumn("ratio", F.col("w") / F.col("tokens"))
    ends = r.agg(F.min("ratio").alias("low"), F.max("ratio").alias("high"), F.sum("tokens").alias("all")).first()
    if ends["all"] is None:
        return r.withColumn("p", F.lit(0.0)).drop("ratio")
    low, high = ends["low"], ends["high"]
    c = F.lit(keep / high) * F.pow(F.lit(high / low / keep), F.col("k") / scales)
    tried = r.select("tokens", "ratio", F.explode(F.sequence(F.lit(0), F.lit(scales))).alias("k")).withColumn("c", c)
    kept = tried.groupBy("k", "c").agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("c") * F.col("ratio"))).alias("kept"))
    best = kept.where(F.col("kept") <= ends["all"] * keep + 1e-6).agg(F.max("c")).first()[0]
    return r.withColumn("p", F.round(F.least(F.lit(1.0), F.lit(1.0 if best is None else best) * F.col("ratio")), 6)).drop("ratio")


def bounded_rake(cell: DataFrame, goals: dict[str, DataFrame], shares: list[float], rounds: int = ROUNDS) -> DataFrame:
    """cell with share and w for each of shares: tokens fitted to the goals, where no cell gets more than tokens / share.

    In every step the cells at their bound are held and the others of their category take what is missing.
    """
    at = cell.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("cap", F.col("tokens") / F.col("share"))
    at = aimed(at.withColumn("w", F.least("tokens", "cap")), goals)
    full = F.col("w") >= F.col("cap") * (1 - 1e-12)
    for _ in range(rounds):
        for dim in goals:
            own, target = Window.partitionBy("share", dim), F.col(f"target_{dim}")
            held, free = F.sum(F.when(full, F.col("w"))).over(own), F.sum(F.when(~full, F.col("w"))).over(own)
            at = at.withColumns({"held": F.coalesce(held, F.lit(0.0)), "free": F.coalesce(free, F.lit(0.0))})
            up = target > F.col("held") + F.col("free")
            more = F.coalesce((target - F.col("held")) / F.nullif("free", F.lit(0.0)), F.lit(1.0))
            f = F.when(up, more).otherwise(target / (F.col("held") + F.col("free")))
            at = at.withColumn("w", F.when(up & full, F.col("w")).otherwise(F.least("cap", F.col("w") * F.coalesce(f, F.lit(1.0))))).drop("held", "free")
        at = cut(at)
    return at.drop(*[f"target_{d}" for d in goals])


def calibrated(rows: DataFrame, powers: dict[str, float] = POWERS, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, weight, p) of all cells of described rows, so that the sample itself meets the targets.

    The share of tokens kept is the largest of BOUNDS values, at most `keep`, at which probabilities of at most 1 bring
    every margin of the sample within TOLERANCE of its target. If none does, raked weights are scaled until no p is over 1.
    """
    cell = cut(cells(rows))
    goals = {d: cut(targets(cell, d, a)) for d, a in powers.items()} if cell.head(1) else {}
    if not goals:
        return cell.select("source", "lang", "topic", F.lit(0.0).alias("weight"), F.lit(0.0).alias("p"))
    most = [cell.groupBy(d).agg(F.sum("tokens").alias("n")).join(g, d).agg(F.min(F.col("n") / F.col("target"))).first()[0] for d, g in goals.items()]
    top = min(keep, *most)
    fitted = bounded_rake(cell, goals, [top * STEP**k for k in range(BOUNDS)], rounds)
    off = [fitted.groupBy("share", d).agg(F.sum("w").alias("now")).join(g, d).select("share", F.abs(F.col("now") / F.col("target") - 1).alias("off")) for d, g in goals.items()]
    worst = reduce(DataFrame.unionByName, off).groupBy("share").agg(F.max("off").alias("off"))
    share = worst.where(F.col("off") <= TOLERANCE).agg(F.max("share")).first()[0]
    if share is None:
        fitted = rake(cell, goals, rounds)
        share = min(keep, 1 / fitted.agg(F.max(F.col("w") / F.col("tokens"))).first()[0])
    else:
        fitted = fitted.where(F.col("share") == F.lit(share))
    weight = F.col("w") / F.col("tokens")
    return cut(fitted.select("source", "lang", "topic", weight.alias("weight"), F.least(F.lit(1.0), weight * F.lit(share)).alias("p")))


def cell_of(docs: DataFrame) -> dict[str, Column]:
    """Columns that tell a document's cell: null source and lang are `unknown`."""
    return {"source": F.coalesce(docs["source"], F.lit("unknown")), "lang": F.coalesce(docs["lang"], F.lit("unknown")), "topic": topic_of()}


def described(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[c.alias(n) for n, c in cell_of(docs).items()], tokens_of().alias("tokens"))


def plan(rows: DataFrame, powers: dict[str, float] = POWERS, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, weight, p) of all cells of described rows."""
    cell = cut(cells(rows))
    raked = rake(cell, {d: targets(cell, d, a) for d, a in powers.items()}, rounds)
    return cut(probabilities(raked, keep).select("source", "lang", "topic", F.round(F.col("w") / F.col("tokens"), 6).alias("weight"), "p"))


def mix(docs: DataFrame, powers: dict[str, float] = POWERS, keep: float = KEEP, rounds: int = ROUNDS, seed: int = SEED, exact: bool = False) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, weight, p, kept.

    With `exact` the probabilities are calibrated under their bound of 1, so that the sample meets the targets and keeps as
    much as that allows; else raked weights are scaled to keep `keep` of all tokens and cut off at 1. weight is the cell's raked share of tokens over its share in the corpus; kept is decided by a hash of doc_id, so
    copies of an id share one fate and every run gives the same sample. Null source or lang counts as `unknown`, a
    null text has no tokens. Documents without tokens whose cell has none are not kept (weight and p 0). An empty
    table gives an empty result; other columns are ignored.
    """
    rows = cut(described(docs))
    cell = calibrated(rows, powers, keep, rounds).withColumns({c: F.round(c, 6) for c in ("weight", "p")}) if exact else plan(rows, powers, keep, rounds)
    out = rows.join(cell, ["source", "lang", "topic"], "left").fillna({"weight": 0.0, "p": 0.0})
    out = out.withColumn("kept", unit_hash(F.col("doc_id"), seed=seed) < F.col("p"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", "weight", "p", "kept")


def keep_sampled(docs: DataFrame, powers: dict[str, float] = POWERS, keep: float = KEEP, rounds: int = ROUNDS, seed: int = SEED, exact: bool = False) -> DataFrame:
    """Rows of docs that the mixture keeps, columns unchanged. Texts are not shuffled while the cells are few.

    With `exact` the probabilities are calibrated, so that what is kept meets the targets; else they are those of mix.
    Null source and lang count as `unknown`; rows without tokens are kept as their cell is, and not if it has none. Rows
    of one id share one fate; an empty table gives an empty result. Columns of docs may have any names.
    """
    mark = "_mix"
    while any(c.startswith(mark) for c in docs.columns):
        mark = "_" + mark
    parts = ("source", "lang", "topic")
    p = (calibrated if exact else plan)(described(docs), powers, keep, rounds).select(*[F.col(c).alias(f"{mark}_{c}") for c in (*parts, "p")])
    tagged = docs.select("*", *[c.alias(f"{mark}_own_{n}") for n, c in cell_of(docs).items()])
    same = [F.col(f"{mark}_own_{c}") == F.col(f"{mark}_{c}") for c in parts]
    return tagged.join(p, same).where(unit_hash(F.col("doc_id"), seed=seed) < F.col(f"{mark}_p")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_proportional_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), exact=True)


def op5_sql() -> str:
    def margin(k: int, dim: str, before: str) -> str:
        return (
            f"c{k} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.w * (g.target / n.now) AS w FROM {before} c "
            f"JOIN (SELECT {dim}, sum(w) AS now FROM {before} GROUP BY {dim}) n USING ({dim}) JOIN goal_{dim} g USING ({dim}))"
        )

    full = "w >= cap * (1 - 1e-12)"

    def bounded(k: int, dim: str, before: str) -> str:
        return (
            f"b{k} AS MATERIALIZED (SELECT b.k, b.share, b.source, b.lang, b.topic, b.tokens, b.cap, CASE WHEN target > held + free AND {full} THEN w ELSE "
            f"least(cap, w * CASE WHEN target > held + free THEN coalesce((target - held) / nullif(free, 0), 1) ELSE target / (held + free) END) END AS w FROM {before} b "
            f"JOIN (SELECT k, {dim}, sum(CASE WHEN {full} THEN w ELSE 0 END) AS held, sum(CASE WHEN {full} THEN 0 ELSE w END) AS free FROM {before} GROUP BY k, {dim}) n USING (k, {dim}) JOIN goal_{dim} g USING ({dim}))"
        )

    steps, before, k, most = [], "c0", 0, []
    for _ in range(ROUNDS):
        for dim in POWERS:
            k += 1
            steps += [margin(k, dim, before), bounded(k, dim, f"b{k - 1}")]
            before = f"c{k}"
    most = ", ".join(f"(SELECT min(n / target) FROM share_{d} JOIN goal_{d} USING ({d}))" for d in POWERS)
    off = " UNION ALL ".join(f"SELECT k, max(abs(now / target - 1)) AS off FROM (SELECT k, {d}, sum(w) AS now FROM b{k} GROUP BY k, {d}) JOIN goal_{d} USING ({d}) GROUP BY k" for d in POWERS)
    goals = ", ".join(
        f"share_{d} AS (SELECT {d}, sum(tokens) AS n, pow(sum(tokens), {a}) AS p FROM c0 GROUP BY {d}), "
        f"goal_{d} AS MATERIALIZED (SELECT {d}, p / (SELECT sum(p) FROM share_{d}) * (SELECT sum(n) FROM share_{d}) AS target FROM share_{d})"
        for d, a in POWERS.items()
    )
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(text, '') AS t,
         coalesce(len(regexp_extract_all(text, '\S+')), 0)::BIGINT AS tokens FROM documents),
rows_ AS MATERIALIZED (
  SELECT doc_id, source, lang, tokens, CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '$$$') OR contains(t, '%%%') THEN 'symbols'
    WHEN contains(t, 'rights reserved') OR contains(t, 'icense') THEN 'legal' WHEN contains(t, 'password=') OR contains(t, 'token = ') OR contains(t, 'AKIA') THEN 'credentials'
    WHEN length(t) < 600 THEN 'brief' WHEN length(t) > 6000 THEN 'long' ELSE 'prose' END AS topic FROM d),
c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE AS w FROM rows_ GROUP BY ALL HAVING sum(tokens) > 0),
{goals},
b0 AS MATERIALIZED (SELECT k, share, source, lang, topic, tokens, tokens / share AS cap, least(tokens, tokens / share) AS w
  FROM c0, (SELECT k, least({KEEP}, {most}) * pow({STEP}, k) AS share FROM (SELECT unnest(range({BOUNDS})) AS k))),
{", ".join(steps)},
best AS (SELECT min(k) AS k FROM (SELECT k, max(off) AS off FROM ({off}) GROUP BY k) WHERE off <= {TOLERANCE}),
fitted AS (SELECT source, lang, topic, w / tokens AS weight, share FROM b{k} JOIN best USING (k)
  UNION ALL SELECT source, lang, topic, w / tokens, least({KEEP}, 1 / (SELECT max(w / tokens) FROM {before})) FROM {before} WHERE (SELECT k FROM best) IS NULL),
p AS (SELECT source, lang, topic, round(weight, 6) AS weight, round(least(1.0, weight * share), 6) AS p FROM fitted)
SELECT doc_id, source, lang, topic, tokens, coalesce(weight, 0.0) AS weight, coalesce(p, 0.0) AS p,
       ('0x' || substr(md5('{SEED}|' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < coalesce(p, 0.0) AS kept
FROM rows_ LEFT JOIN p USING (source, lang, topic)
"""
