"""Text quality by naive Bayes support vectors.

Indicators of hashed n-grams are scaled by the log ratio of their counts in the two classes, and a linear model with
hinge loss is fitted to the scaled rows by dual coordinate descent. N-grams are runs of one and two tokens (words, and
other characters without spaces between) and of one to three token shapes (letter case, kind of character, and whether
a token repeats the one before), so ways of writing count as well as words. Margins are turned into scores by a
logistic curve fitted on training rows that its model did not see.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut

DIMS = 1 << 16
TRAIN_ROWS = {0: 3000, 1: 3000}
FOLDS = 5
ROWS_AT_ONCE = 512
CACHE_TOKENS = 200_000
TOKENS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
WORD, UPPER, CAPITAL, DIGITS = 1, 2, 3, 4  # shapes; that of other characters is a number of their own from 8 on


def shape(token: str) -> int:
    if token[0].isalpha():
        return WORD if token.islower() or len(token) == 1 else UPPER if token.isupper() else CAPITAL if token[1:].islower() else WORD
    return DIGITS if token[0].isdigit() else 8 + zlib.crc32(token.encode("utf-8", "surrogatepass")) % 1021


class Features:
    """Rows of hashed n-gram indicators; keeps the hashes of tokens it has met, and forgets them when there are too many."""

    def __init__(self, dims: int = DIMS):
        self.dims, self.known = dims, {}

    def codes(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_TOKENS:
            self.known = {}
        for t in (t for t in set(tokens) if t not in self.known):  # no set difference, which would read all of the cache
            self.known[t] = zlib.crc32(t.lower().encode("utf-8", "surrogatepass")) << 11 | shape(t)
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens)).view(np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct rows of the whole text's n-grams; none where it has no token."""
        tokens = TOKENS.findall(text) if text else ()
        if not len(tokens):
            return np.zeros(0, dtype=np.int64)
        code = self.codes(tokens)
        word, form = code >> np.uint64(11), code & np.uint64(2047)
        form = form * np.uint64(2)
        form[1:] += word[1:] == word[:-1]
        m = np.uint64(0x9E3779B97F4A7C15)
        grams = [word * m, (word[:-1] * m + np.uint64(1) ^ word[1:]) * m, (form + np.uint64(3)) * m]
        two = (form[:-1] * m + np.uint64(5)) ^ form[1:]
        grams += [two * m, (two[:-1] * m + np.uint64(7) ^ form[2:]) * m]
        h = np.concatenate(grams)
        return np.unique((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.dims.bit_length() + 1)).astype(np.int64)


def packed(rows: np.ndarray, dims: int) -> bytes:
    """An indicator row as bits: dims / 8 bytes whatever the length of the text."""
    flags = np.zeros(dims, dtype=np.uint8)
    flags[rows] = 1
    return np.packbits(flags).tobytes()


def unpacked(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))).astype(np.int32)


def log_ratios(counts: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the n-grams' shares of all indicators of class 1 over those of class 0; 0 if neither has it. counts: (2, dims)."""
    p = counts + alpha
    p = p / p.sum(axis=1, keepdims=True)
    return np.where(counts.any(axis=0), np.log(p[1] / p[0]), 0.0)


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, dims: int, epochs: int = 30, seed: int = 5, least: float = 1e-3) -> np.ndarray:
    """Weights, the bias last, of the linear model of least hinge loss: dual coordinate descent, one row at a time.

    A row's dual variable moves to the minimum along its axis, between 0 and the row's cost. Ends when no gradient of an
    epoch is far from the best, or after `epochs`.
    """
    rng, w, dual = np.random.default_rng(seed), np.zeros(dims + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            own, v = rows[i], values[i]
            slope = y[i] * (w[own] @ v + w[-1]) - 1
            reach = min(slope, 0.0) if dual[i] <= 0 else max(slope, 0.0) if dual[i] >= cost[i] else slope
            if reach:
                worst = max(worst, abs(reach))
                now = min(max(dual[i] - slope / square[i], 0.0), cost[i])
                move = (now - dual[i]) * y[i]
                w[own] += move * v
                w[-1] += move
                dual[i] = now
        if worst < least:
            break
    return w


def curve(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least loss over margins, with both labels drawn slightly inwards."""
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = np.array([((p - target) * margin).sum(), (p - target).sum()]), p * (1 - p) + 1e-9
        hess = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


@dataclass
class Model:
    ratio: np.ndarray  # log count ratios
    weight: np.ndarray  # of scaled indicators, the bias last
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, rows: np.ndarray) -> float:
        r = self.ratio[rows]
        return float((self.weight[rows] @ r) / (np.sqrt(r @ r) or 1.0) + self.weight[-1])

    def score(self, rows: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(rows) + self.shift, -30, 30))))


def train(rows: list[np.ndarray], y: np.ndarray, counts: np.ndarray, cost: float = 1.0, blend: float = 0.25) -> Model:
    """The model of all rows; its curve comes from margins that models without a fold of the rows give that fold.

    Classes cost the same in all. blend: the share of the weights themselves, the rest being their mean size, by which
    the naive Bayes part counts. Rows of one class give the constant score of that class, no rows 0.5.
    """
    dims = counts.shape[1]
    ratio = log_ratios(counts)
    if len(set(y.tolist())) < 2:
        side = 0.0 if not len(y) else 8.0 if y[0] else -8.0
        return Model(ratio, np.append(np.zeros(dims), side))
    values = [(r := ratio[x]) / (np.sqrt(r @ r) or 1.0) for x in rows]
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.bincount(y, minlength=2) / len(y)
    costs = cost / (2 * share[y])

    def fitted(own):
        w = descend([rows[i] for i in own], [values[i] for i in own], sign[own], costs[own], dims)
        size = np.abs(w[:-1])[w[:-1] != 0]
        w[:-1] = blend * w[:-1] + (1 - blend) * (size.mean() if len(size) else 0.0)
        return w

    fold, margin = np.arange(len(y)) % FOLDS, np.zeros(len(y))
    for k in range(FOLDS) if len(y) >= 2 * FOLDS else ():
        own = np.flatnonzero(fold != k)
        if len(set(y[own].tolist())) == 2:
            part = Model(ratio, fitted(own))
            for i in np.flatnonzero(fold == k):
                margin[i] = part.margin(rows[i])
    made = Model(ratio, fitted(np.arange(len(y))))
    if len(y) < 2 * FOLDS:
        margin = np.array([made.margin(x) for x in rows])
    made.slope, made.shift = curve(margin, y)
    return made


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_label: dict = TRAIN_ROWS, dims: int = DIMS) -> Model:
    """Class counts of n-grams over all labelled rows where `usable` holds; the linear model from a part of them.

    Counts are summed on the executors, 2 * dims numbers come to the driver. The model learns from at most
    rows_per_label[label] rows of each label, picked by hash of the id, as bits (dims / 8 bytes a row, 49 MB at the
    bounds). Labels other than 0 and 1 are ignored; of several labels of an id the highest counts, of several texts the
    first in order. An empty text is a row without n-grams.
    """
    known = labels.where(usable & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    picked = [bounded_sample(known.where(F.col("y") == k).join(docs.select(id_col), id_col, "left_semi"), id_col, rows_per_label[k]).withColumn("_own", F.lit(True)) for k in (0, 1)]
    known = known.join(picked[0].unionByName(picked[1]).select(id_col, "_own"), id_col, "left")
    texts = docs.select(id_col, F.col(text_col).alias("text")).join(known, id_col).groupBy(F.col(id_col).alias("id"), "y", "_own").agg(F.min("text").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        made, counts = Features(dims), np.zeros((2, dims), dtype=np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), ROWS_AT_ONCE):
                part, out = pdf.iloc[at : at + ROWS_AT_ONCE], []
                for key, y, own, text in zip(part["id"], part["y"], part["_own"], part["text"]):
                    rows = made(text)
                    counts[int(y), rows] += 1
                    if own is True or own == 1:
                        out.append((key, int(y), packed(rows, dims)))
                yield pd.DataFrame({"id": pd.Series([o[0] for o in out], dtype=pdf["id"].dtype), "y": pd.Series([o[1] for o in out], dtype="int32"), "x": pd.Series([o[2] for o in out], dtype=object), "place": None, "n": None})
        y, place = np.nonzero(counts)
        yield pd.DataFrame({"id": None, "y": y.astype("int32"), "x": None, "place": place.astype("int32"), "n": counts[y, place]})

    found = cut(texts.mapInPandas(run, f"id {kind}, y int, x binary, place int, n long"))
    counts = np.zeros((2, dims))
    for r in found.where("place is not null").groupBy("y", "place").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.y, r.place] = r.n
    rows, y = [], []
    for r in found.where("x is not null").orderBy(F.xxhash64(F.lit(29), "id"), "id").toLocalIterator():
        rows.append(unpacked(r.x))
        y.append(r.y)
    return train(rows, np.array(y, dtype=np.int64), counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row's whole text, between 0 and 1.

    Null, empty and blank texts have no n-grams and score what the model's bias says. Rows are scored one by one, so
    repeated rows repeat; equal texts score the same. An empty table gives an empty result; other columns, whatever
    their names, are ignored.
    """
    dims = len(model.ratio)

    def run(batches):
        made = Features(dims)
        for pdf in batches:
            for at in range(0, len(pdf), ROWS_AT_ONCE):
                part = pdf.iloc[at : at + ROWS_AT_ONCE]
                yield pd.DataFrame({"id": part["id"], "score": [model.score(made(t)) for t in part["text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
