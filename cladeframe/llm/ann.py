"""Approximate nearest neighbours by low-dimensional stable projections, a kd-tree and a chi-square stopping test.

Largest inner product becomes smallest distance by one more component: with M the largest norm, candidates get
sqrt(M^2 - |x|^2) and queries 0. A Gaussian (2-stable) matrix maps these vectors to `proj` dimensions, where the
squared distance over the true one follows a chi-square law. A kd-tree of the projections deals the candidates to cells
(large cells to blocks by hash); each block has its own kd-tree down to small leaves. A query first searches its own
cell. The score of its k-th best there bounds, through the chi-square test, how far a better one can be projected with
probability `sure`: the query is sent on only to cells, enters only leaves and verifies only candidates, nearest
projection first, that are nearer than that, and the bound tightens with every better candidate. Verification is the
inner product of the original vectors in double precision. Every candidate is indexed; only the planes between cells
come from a sample.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, cut
from .vectors import matrix, usable

PROJ = 24
SURE = 0.85
LEAF = 64
CELL_ROWS = 8192
BLOCK_ROWS = 65_536
SAMPLE_ROWS = 20_000
AT_ONCE = 64


def chi2_cdf(x: float, m: int) -> float:
    """Chi-square distribution function for even m."""
    if x <= 0:
        return 0.0
    if x > 700:
        return 1.0
    term, total = 1.0, 1.0
    for j in range(1, m // 2):
        term *= x / 2 / j
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi2_quantile(p: float, m: int) -> float:
    low, high = 0.0, 700.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, m) < p else (low, mid)
    return high


def halves(p: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray]:
    """The axis along which points spread most, and their order that has the lower half in front."""
    own = p[rows]
    axis = int(np.argmax(np.ptp(own, axis=0)))
    return axis, rows[np.argpartition(own[:, axis], len(rows) // 2)]


class Cells:
    """A complete kd-tree whose planes are medians of a sample of projections; its leaves are the cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.axis, self.at = depth, np.zeros(1 << depth, dtype=int), np.zeros(1 << depth)
        rows = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            own = rows.pop(node)
            self.axis[node], order = halves(sample, own)
            self.at[node] = sample[order[len(own) // 2], self.axis[node]]
            low = sample[own, self.axis[node]] < self.at[node]
            rows[2 * node], rows[2 * node + 1] = own[low], own[~low]
            if not low.any() or low.all():  # equal points: the plane tells nothing apart
                rows[2 * node] = rows[2 * node + 1] = own

    def route(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] >= self.at[node])
        return node - (1 << self.depth)


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point of q to every box."""
    gap = np.maximum(low[None] - q[:, None], 0) + np.maximum(q[:, None] - high[None], 0)
    return (gap * gap).sum(axis=2)


class Block:
    """Candidates of one block in the order of a kd-tree of their projections, with the boxes of its leaves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm: float, planes: np.ndarray, leaf: int = LEAF):
        p = project(x, norm, planes)
        order, bounds, stack = np.arange(len(p)), [], [(0, len(p))]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                bounds.append((a, b))
            else:
                order[a:b] = halves(p, order[a:b])[1]
                stack += [(a, a + (b - a) // 2), (a + (b - a) // 2, b)]
        bounds.sort()
        self.ids, self.x, self.p = ids[order], np.ascontiguousarray(x[order]), p[order]
        self.leaf = np.repeat(np.arange(len(bounds)), [b - a for a, b in bounds])
        self.low = np.array([self.p[a:b].min(axis=0) for a, b in bounds])
        self.high = np.array([self.p[a:b].max(axis=0) for a, b in bounds])
        self.size = (self.p * self.p).sum(axis=1)

    def search(self, y: np.ndarray, floor: np.ndarray, k: int, norm: float, planes: np.ndarray, stop: float):
        """For each row of y: ids and scores of its k best here that are better than floor, and how many were verified."""
        for s in range(0, len(y), AT_ONCE):
            q, known = y[s : s + AT_ONCE], floor[s : s + AT_ONCE]
            at, base = q @ planes[:-1], norm * norm + (q * q).sum(axis=1)
            reach = stop * np.maximum(base - 2 * known, 0)
            entered = (box_distance(at, self.low, self.high) <= reach[:, None]).any(axis=0)
            rows = np.flatnonzero(entered[self.leaf])
            apart = np.maximum(self.size[rows] + (at * at).sum(axis=1)[:, None] - 2 * at @ self.p[rows].T, 0)
            for one, d, most, size, kth in zip(q, apart, reach, base, known):
                live, step, best, ids, seen = np.flatnonzero(d <= most), 2 * k, np.zeros(0), np.zeros(0, dtype=self.ids.dtype), 0
                while len(live):
                    near = live
                    if len(live) > step:
                        part = np.argpartition(d[live], step)
                        near, live = live[part[:step]], live[part[step:]]
                    else:
                        live = live[:0]
                    seen, step = seen + len(near), step + step // 2
                    best, ids = np.concatenate([best, self.x[rows[near]] @ one]), np.concatenate([ids, self.ids[rows[near]]])
                    top = np.lexsort((ids, -best))[:k]
                    best, ids = best[top], ids[top]
                    if len(best) == k:
                        kth = max(kth, best[-1])
                        live = live[d[live] <= stop * max(size - 2 * kth, 0)]
                keep = best >= kth if math.isfinite(kth) else slice(None)
                yield ids[keep].tolist(), best[keep].tolist(), seen


def project(x: np.ndarray, norm: float, planes: np.ndarray) -> np.ndarray:
    return x @ planes[:-1] + np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))[:, None] * planes[-1]


FOUND = "k1 long, k2 long, ids array<long>, scores array<double>, verified long"


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    proj: int = PROJ,
    sure: float = SURE,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 5,
) -> DataFrame:
    """The k nearest found of every query: query_id, rank from 1, id_col, score = inner product, verified.

    All usable rows are candidates except the query's own id; fewer than k candidates give all of them. Ties go to the
    smaller id. An id stands once: of rows that repeat it the one with the smallest vector takes part, and is a query if
    any of them is. Vectors that are null, empty, zero or not finite take no part, nor do rows without an id and those
    whose length is not the commonest. An empty table gives an empty result; other columns are ignored.
    verified counts the candidates whose inner product with the query's vector was taken.

    Of equal vectors only the k + 1 with the smallest ids can be among anybody's k nearest, so only these are indexed,
    and queries with equal vectors are searched once.
    """
    live = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable("vec") & F.col("id").isNotNull())
    lengths = live.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = lengths["n"] if lengths else 1
    live = live.where(F.size("vec") == dims)
    if live.groupBy("id").count().where("count > 1").head(1):
        live = live.groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks"))
    live = live.withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64("vec", F.lit(1)))
    size = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    norm = math.sqrt(live.agg(F.max(size)).first()[0] or 0.0)
    planes, stop = np.random.default_rng(seed).standard_normal((dims + 1, proj)), chi2_quantile(sure, proj)

    taken = matrix(pd.Series([r.vec for r in bounded_sample(live.select("id", "vec"), "id", sample_rows).collect()]))
    taken = taken.reshape(-1, dims)
    depth = max(0, min(math.ceil(math.log2(max(1, live.count() / cell_rows))), int(math.log2(max(1, len(taken) / LEAF)))))
    cells = Cells(project(taken, norm, planes), depth)

    def into_cells(batches):
        for pdf in batches:
            yield pdf.assign(cell=cells.route(project(matrix(pdf["vec"]).reshape(-1, dims), norm, planes)))

    kind = live.schema["vec"].dataType.simpleString()
    copies = Window.partitionBy("k1", "k2").orderBy("id")
    index = live.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "vec")
    index = cut(index.mapInPandas(into_cells, f"id long, vec {kind}, cell long"))

    def boxes_of(batches):
        for pdf in batches:
            p = project(matrix(pdf["vec"]).reshape(-1, dims), norm, planes)
            own = pdf.groupby("cell").indices
            yield pd.DataFrame({"cell": list(own), "n": [len(i) for i in own.values()], "low": [p[i].min(axis=0) for i in own.values()], "high": [p[i].max(axis=0) for i in own.values()]})

    ends = index.mapInPandas(boxes_of, "cell long, n long, low array<double>, high array<double>").select("cell", "n", F.posexplode(F.arrays_zip("low", "high")).alias("i", "x"))
    ends = ends.groupBy("cell", "i").agg(F.sum("n").alias("n"), F.min("x.low").alias("low"), F.max("x.high").alias("high")).orderBy("cell", "i").collect()  # a row per cell and axis
    names = np.array([r.cell for r in ends[::proj]], dtype=np.int64)
    low, high = (np.array([r[c] for r in ends]).reshape(-1, proj) for c in ("low", "high"))
    blocks = np.array([-(-r.n // block_rows) for r in ends[::proj]], dtype=np.int64)
    many = F.element_at(F.create_map(*[F.lit(int(v)) for pair in zip(names, blocks) for v in pair]), F.col("cell")) if len(names) else F.lit(1)
    index = index.withColumn("block", F.pmod(F.xxhash64("id"), many).cast("long"))

    def first_cell(batches):
        for pdf in batches:
            if len(pdf) and len(names):
                at = box_distance(matrix(pdf["vec"]).reshape(-1, dims) @ planes[:-1], low, high).argmin(axis=1)
                yield pdf.assign(cell=names[at], block=pdf["k1"].to_numpy() % blocks[at], floor=-math.inf)

    def more_cells(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            y, floor = matrix(pdf["vec"]).reshape(-1, dims), pdf["floor"].to_numpy()
            reach = stop * np.maximum(norm * norm + (y * y).sum(axis=1) - 2 * floor, 0)
            q, c = np.nonzero(box_distance(y @ planes[:-1], low, high) <= reach[:, None])
            q, c = np.repeat(q, blocks[c]), np.repeat(c, blocks[c])
            block = np.concatenate([np.arange(blocks[i]) for i in c[np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])]]]) if len(c) else c
            home = (names[c] == pdf["cell"].to_numpy()[q]) & (block == pdf["block"].to_numpy()[q])
            yield pdf.iloc[q[~home]].assign(cell=names[c[~home]], block=block[~home])

    def visit(_, queries, candidates):
        if not len(queries) or not len(candidates):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("k1", "k2", "ids", "scores", "verified")})
        block = Block(candidates["id"].to_numpy(), matrix(candidates["vec"]), norm, planes)
        found = list(block.search(matrix(queries["vec"]), queries["floor"].to_numpy(), k + 1, norm, planes, stop))
        return queries[["k1", "k2"]].assign(**{c: pd.Series(v, index=queries.index, dtype=object) for c, v in zip(("ids", "scores", "verified"), zip(*found))})

    def search(queries):
        return queries.groupBy("cell", "block").cogroup(index.groupBy("cell", "block")).applyInPandas(visit, FOUND)

    sent = f"k1 long, k2 long, vec {kind}, cell long, block long, floor double"
    asks = live.where("asks").groupBy("k1", "k2").agg(F.first("vec").alias("vec")).mapInPandas(first_cell, sent)
    asks = cut(asks)
    home = cut(search(asks))
    floor = F.when(F.size("scores") > k, F.element_at("scores", -1)).otherwise(F.lit(-math.inf))
    onward = asks.drop("floor").join(home.select("k1", "k2", floor.alias("floor")), ["k1", "k2"]).select("k1", "k2", "vec", "cell", "block", "floor")
    found = home.unionByName(cut(search(onward.mapInPandas(more_cells, sent))))  # read twice below, searched once
    each = found.select("k1", "k2", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("k1", "k2", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    order = (F.desc("score"), F.asc("id"))
    each = each.withColumn("place", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(*order))).where(F.col("place") <= k + 1)
    lists = each.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("best"))  # at most k + 1 each
    lists = lists.join(found.groupBy("k1", "k2").agg(F.sum("verified").alias("verified")), ["k1", "k2"])
    out = live.where("asks").select(F.col("id").alias("query_id"), "k1", "k2").join(lists, ["k1", "k2"])
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", "verified", F.posexplode(others).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias(id_col), F.col("b.score").alias("score"), "verified")
