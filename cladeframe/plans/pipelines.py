"""The three applications: placement, alignment and family scoring, as compositions of operators.

Models are native profiles (X1, X2), alignments their Viterbi paths (X3), and placements a softmax over distances to
the leaves' rows (X4): approximations of the external programs, whose own outputs can be read instead and passed on.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.lineage import materialise
from cladeframe.functions.sequences import degap, normalise
from cladeframe.operators import decompose, profile, routing, sites


@dataclass(frozen=True)
class Options:
    """OR8, OR9: options and their defaults."""

    alignment_size: int | None = None
    placement_size: int | None = None
    strategy: str = "centroid"
    least_subset: int = 2
    placement_factor: int = 4
    widest: float | None = None
    nested: bool = False
    chunk_size: int = 20_000
    molecule: str = "dna"
    seed: int = 297834
    ignore_overlap: bool = False
    long_branch: float | None = None

    def check(self) -> Options:
        """FLT10, FLT14"""
        if self.molecule not in ("dna", "rna", "amino"):
            raise ValueError(f"unknown molecule {self.molecule}")
        if self.strategy not in decompose.STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")
        if self.widest is not None and self.strategy not in ("midpoint", "centroid"):
            raise ValueError("a largest diameter can be given with the strategies midpoint and centroid only")
        for k in ("alignment_size", "placement_size", "least_subset", "chunk_size"):
            v = getattr(self, k)
            if v is not None and v < 1:
                raise ValueError(f"{k} must be positive")
        return self

    def with_(self, *layers: dict) -> Options:
        """OR7: later layers win; unknown names are an error."""
        out = self
        for layer in layers:
            out = dataclasses.replace(out, **layer)
        return out.check()


PRESET_LARGE_REFERENCE = Options(placement_size=5000, alignment_size=1000)  # OR10
LETTERS = {"dna": "ACGT", "rna": "ACGU", "amino": "ACDEFGHIKLMNPQRSTVWY"}


def checked_queries(queries: DataFrame, backbone: DataFrame, o: Options) -> DataFrame:
    """FLT3-FLT5: queries (name, seq) upper-case and degapped; names with blanks or of the backbone are errors."""
    q = queries.select("name", degap(normalise("seq")).alias("seq"))
    if bad := routing.whitespace_names(queries).limit(3).collect():
        raise ValueError(f"names with white space: {[r['name'] for r in bad]}")
    return routing.without_collisions(q, backbone, ignore=o.ignore_overlap)


def subsets(tree: DataFrame, o: Options) -> DataFrame:
    """TR8, TR9, FLT11: (subset, name) of the backbone tree's leaves."""
    n = tree.where("is_leaf").count()
    a, _ = routing.size_rule(n, o.alignment_size, o.placement_size)
    return decompose.decompose(tree, max(1, a), o.strategy, min(o.least_subset, max(1, a)), o.widest, o.nested).select("subset", "name")


def models(backbone: DataFrame, member: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """COL12, X1: profiles (subset, pos, ch, w) of compacted subsets, and their sites' original columns (subset, pos, label)."""
    s = sites.to_sites(backbone.join(member, "name"))
    c = materialise(sites.delete_all_gap(s, ["subset"]))
    return profile.build(c, ["subset"], LETTERS[o.molecule]), c.select("subset", "pos", "label").distinct()


def hits(queries: DataFrame, model: DataFrame, o: Options) -> DataFrame:
    """JN2, X2: (fragment, subset, bitscore, evalue) of every query against every model: ungapped at its best offset.

    Residues meet model sites by letter; sums per (fragment, subset, offset) are partial aggregates.
    """
    r = sites.to_sites(queries).select("name", F.col("pos").alias("at"), "ch")
    met = r.join(model, "ch").withColumn("shift", F.col("pos") - F.col("at"))
    by = met.groupBy("name", "subset", "shift").agg(F.sum("w").alias("score"))
    best = by.groupBy("name", "subset").agg(F.max("score").alias("bitscore"))
    return best.select(F.col("name").alias("fragment"), "subset", "bitscore", F.pow(F.lit(2.0), -F.col("bitscore")).alias("evalue"))


def score_families(queries: DataFrame, backbone: DataFrame, tree: DataFrame, o: Options = Options()) -> DataFrame:
    """§3.3: (fragment, scores) of every query against every model of the ensemble."""
    q = checked_queries(queries, backbone, o.check())
    model, _ = models(backbone, subsets(tree, o), o)
    return routing.all_scores(q.select(F.col("name").alias("fragment")), hits(q, model, o))


def align_queries(queries: DataFrame, backbone: DataFrame, tree: DataFrame, o: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """§3.2: the merged alignment: residues (name, anchor, ord, ch) and columns (anchor, ord, pos).

    Queries are routed to their best model and aligned to it; residues on sites get the site's original column,
    those between sites are insertions after the column before them. All rows then share the columns of §2.8.
    """
    from pyspark.sql import Window

    from cladeframe.operators.merge import merged_columns

    q = materialise(checked_queries(queries, backbone, o.check()))
    model, labels = models(backbone, subsets(tree, o), o)
    model, labels = materialise(model), materialise(labels)
    best = routing.best_hit(hits(q, model, o), ["subset"])
    frag = q.join(best.select(F.col("fragment").alias("name"), "subset"), "name")
    path = profile.align(frag, model, "subset", LETTERS[o.molecule])
    chars = sites.to_sites(q).select("name", "pos", "ch")
    p = path.join(labels.withColumnRenamed("pos", "site"), ["subset", "site"], "left").join(chars, ["name", "pos"])
    w = Window.partitionBy("name").orderBy("pos")
    p = p.withColumn("anchor", F.coalesce(F.last("label", ignorenulls=True).over(w), F.lit(-1)))
    v = Window.partitionBy("name", "anchor").orderBy("pos")
    p = p.withColumn("ord", F.sum((F.col("site") < 0).cast("int")).over(v).cast("int"))
    base = sites.to_sites(backbone.select("name", "seq")).where("ch <> '-'").select("name", F.col("pos").alias("anchor"), F.lit(0).alias("ord"), "ch")
    rows = base.unionByName(p.select("name", "anchor", "ord", "ch"))
    width = sites.to_sites(backbone.select("name", "seq")).select(F.col("pos").alias("anchor"), F.lit(0).alias("ord")).distinct()
    return rows, merged_columns(rows.select("anchor", "ord").unionByName(width).distinct())


def place_queries(queries: DataFrame, backbone: DataFrame, tree: DataFrame, o: Options = Options(), keep: int = 7, sharpness: float = 20.0) -> DataFrame:
    """§3.1: (fragment, edge_num, lwr, distal_length, pendant_length) of every routed query.

    X4's substitute: leaf edges weighted by a softmax over the p-distances between the aligned query and the backbone
    rows on original columns; the `keep` best stay, normalised.
    """
    from pyspark.sql import Window

    from cladeframe.operators.placement import normalised

    rows, _ = align_queries(queries, backbone, tree, o)
    s = materialise(rows.where("ord = 0").select("name", F.col("anchor").alias("pos"), "ch"))
    own = s.join(queries.select("name"), "name", "left_semi").withColumnsRenamed({"name": "fragment", "ch": "x"})
    ref = s.join(backbone.select("name"), "name", "left_semi").withColumnRenamed("ch", "y")
    d = own.join(ref, "pos").groupBy("fragment", "name").agg(F.avg((F.col("x") != F.col("y")).cast("double")).alias("d"))
    leaf = tree.where("is_leaf").select("name", F.coalesce("edge_num", "node_id").alias("edge_num"), F.coalesce("length", F.lit(0.0)).alias("length"))
    w = Window.partitionBy("fragment").orderBy("d", "edge_num")
    near = d.join(leaf, "name").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    p = normalised(near.withColumn("w", F.exp(-F.col("d") * sharpness)))
    return p.select("fragment", "edge_num", F.col("p").alias("lwr"), (F.col("length") / 2).alias("distal_length"), F.col("d").alias("pendant_length"))


def external(groups: DataFrame, key: str, command: list[str], parse, schema: str) -> DataFrame:
    """UD3: run a program for each group of (key, value) rows, its input lines on stdin; parse(key, stdout) gives rows.

    A failing program is an error with its messages; Spark repeats the task elsewhere if an executor is lost.
    """
    import subprocess

    import pandas as pd

    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(pdf):
        got = subprocess.run(command, input="\n".join(pdf["value"]) + "\n", capture_output=True, text=True)
        if got.returncode:
            raise RuntimeError(f"{command[0]} failed: {got.stderr[-2000:]}")
        return pd.DataFrame(parse(pdf[key].iloc[0], got.stdout), columns=names)

    return groups.groupBy(key).applyInPandas(run, schema)
