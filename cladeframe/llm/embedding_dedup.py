"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

Trees: at every depth of every tree there is one random direction. A node splits at the median of the projections
of a bounded sample of rows that reached it, or, where too few did, at the median over the whole sample. Rows within
`spill` of the threshold go to both sides. Every row is routed through every tree, not only the sample. Rows of the
same leaf are compared; a leaf larger than `block` is cut into blocks, and every pair of its blocks is a task of its
own, so no task holds more than two blocks whatever the leaf's size. A pair that meets in several leaves counts in
the first one only, which both rows can tell from the leaf codes they carry: pairs are never shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, connected_components, cut
from .vectors import matrix, usable

SAMPLE_ROWS = 20_000
LEAF_ROWS = 256
BLOCK_ROWS = 512
TREES = 6
SPILL = 0.01


class Forest:
    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, spill: float = SPILL, least: int = 32, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.depth, self.spill = depth, spill
        dims = sample.shape[1] if sample.size else 1
        self.directions = rng.standard_normal((trees, depth, dims))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.thresholds: list[list[np.ndarray]] = []
        for t in range(trees):
            proj, node, levels = sample @ self.directions[t].T, np.ones(len(sample), dtype=np.int64), []
            for k in range(depth):
                shared = float(np.median(proj[:, k])) if len(proj) else 0.0
                if (1 << k) > max(1, len(sample) // least):
                    levels.append(np.array([shared]))  # too deep for the sample: one threshold for the whole level
                else:
                    at = np.full(1 << k, shared)
                    order = np.argsort(node, kind="stable")
                    ids, first = np.unique(node[order], return_index=True)
                    for i, own in zip(ids, np.split(order, first[1:])):
                        if len(own) >= least:
                            at[i - (1 << k)] = np.median(proj[own, k])
                    levels.append(at)
                node = 2 * node + (proj[:, k] > self._at(levels[k], node, k))
            self.thresholds.append(levels)

    @staticmethod
    def _at(level: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
        return level[0] if len(level) == 1 else level[node - (1 << k)]

    def leaves(self, x: np.ndarray) -> list[list[list[int]]]:
        """For each row, for each tree, the codes of the leaves that hold it."""
        out = [[[] for _ in self.thresholds] for _ in range(len(x))]
        for t, levels in enumerate(self.thresholds):
            proj, row, node = x @ self.directions[t].T, np.arange(len(x)), np.ones(len(x), dtype=np.int64)
            for k in range(self.depth):
                gap = proj[row, k] - self._at(levels[k], node, k)
                left, right = gap <= self.spill, gap > -self.spill
                row = np.concatenate([row[left], row[right]])
                node = np.concatenate([2 * node[left], 2 * node[right] + 1])
            for r, leaf in zip(row.tolist(), node.tolist()):
                out[r][t].append(leaf)
        return out


def _padded(codes) -> list[np.ndarray]:
    """One array (rows, most leaves) per tree, filled with -1."""
    found = []
    for per_tree in zip(*codes):
        wide = np.full((len(per_tree), max(map(len, per_tree))), -1, dtype=np.int64)
        for i, c in enumerate(per_tree):
            wide[i, : len(c)] = c
        found.append(wide)
    return found


def compare_cell(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links inside one pair of blocks: weighted counts per row, and edges from each linked row to its group's first."""
    tree, leaf, i, j = int(pdf["tree"].iloc[0]), int(pdf["leaf"].iloc[0]), int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
    pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
    x = matrix(pdf["vec"])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    block = pdf["block"].to_numpy()
    if i != j:
        near &= block[:, None] != block[None, :]
    ids, copies = pdf["id"].to_numpy(), pdf["copies"].to_numpy()
    r, c = np.nonzero(near)
    if not len(r):
        return pd.DataFrame({"id": [], "links": [], "other": []}).astype("int64")
    label, group = None, np.arange(len(ids))
    while label is None or (label != group).any():
        label = group
        group = np.minimum(label, np.where(near, label[None, :], len(ids)).min(axis=1))
    codes, first = _padded(pdf["leaves"]), np.ones(len(r), dtype=bool)
    for t in range(tree + 1):
        for a in range(codes[t].shape[1]):
            mine = codes[t][r, a]
            met = (mine[:, None] == codes[t][c]).any(axis=1) & (mine >= 0)
            first &= ~(met & (mine < leaf)) if t == tree else ~met
    links = np.bincount(r[first], weights=copies[c[first]], minlength=len(ids)).astype(np.int64)
    seen = near.any(axis=1)
    return pd.DataFrame({"id": ids[seen], "links": links[seen], "other": ids[label[seen]]})


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | None = "label",
    cosine: float = 0.98,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    block_rows: int = BLOCK_ROWS,
    spill: float = SPILL,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    Only rows with equal labels that are not null are compared (label_col None: all rows), in double precision on
    the original vectors. Null, empty, zero and non-finite vectors and rows without an id link with nothing: no links,
    a component of their own, kept. Exact copies are one row with a count while comparing and each get n_links for all others. Vectors of
    different lengths never link. Rows that repeat an id are rows of their own and link like any others; what is said of
    them stands once for each. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    spec = [F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), (F.col(label_col) if label_col else F.lit(0)).alias("label")]
    rows = vectors.select(*spec)
    fit = usable("vec") & F.col("label").isNotNull() & F.col("id").isNotNull()
    live = rows.where(fit).withColumn("label", F.col("label").cast("string"))
    live = live.withColumn("label", F.concat_ws(":", F.size("vec"), "label"))
    live = live.withColumn("k1", F.xxhash64("label", "vec")).withColumn("k2", F.xxhash64("vec", F.lit(1), "label"))
    reps = cut(live.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vec").alias("vec"), F.first("label").alias("label")))
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, most / leaf_rows))))
    trees = trees if depth else 1  # without a split all trees are one leaf
    taken = bounded_sample(reps.select("id", "vec"), "id", sample_rows).collect()
    width = max((len(v.vec) for v in taken), default=1)
    sample = np.array([v.vec for v in taken if len(v.vec) == width], dtype=np.float64).reshape(-1, width)
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    forest = Forest(sample, depth, trees, spill)

    def route(batches):
        for pdf in batches:
            out = []
            for _, own in pdf.groupby(pdf["vec"].map(len), sort=False):
                x = matrix(own["vec"])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                fits = x.shape[1] == width
                out.append(own.assign(leaves=forest.leaves(x) if fits else [[[1]] * trees for _ in range(len(own))]))
            yield pd.concat(out) if out else pdf.assign(leaves=[])

    kind = reps.schema["vec"].dataType.simpleString()
    routed = cut(reps.select("id", "copies", "vec", "label").mapInPandas(route, f"id long, copies long, vec {kind}, label string, leaves array<array<bigint>>"))
    at = routed.select("*", F.posexplode("leaves").alias("tree", "own")).select("*", F.explode("own").alias("leaf")).drop("own")
    sizes = cut(at.groupBy("label", "tree", "leaf").count().where(F.col("count") > block_rows))
    at = at.join(sizes, ["label", "tree", "leaf"], "left")
    at = at.withColumn("blocks", F.coalesce(F.ceil(F.col("count") / block_rows), F.lit(1)).cast("int"))
    at = at.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    at = at.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.withColumn("bi", F.least("block", "with")).withColumn("bj", F.greatest("block", "with"))
    cells = at.select("label", "tree", "leaf", "bi", "bj", "block", "id", "copies", "vec", "leaves")
    found = cells.groupBy("label", "tree", "leaf", "bi", "bj").applyInPandas(lambda pdf: compare_cell(pdf, cosine), "id long, links long, other long")
    found = cut(found)
    comps = connected_components(found.select("id", "other"), "id", "other").withColumnRenamed("node", "id")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = reps.select("k1", "k2", "id", "copies").join(counts, "id", "left").join(comps, "id", "left")
    known = cut(known.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    told = live.select("id", "k1", "k2").join(known, ["k1", "k2"]).select("id", "n_links", "component_id")
    dead = rows.where(~fit).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    return told.unionByName(dead).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
