"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword of +1/-1 bits. One binary logistic classifier per bit, all on the same hashed 1- to
3-grams of letters, predicts the bits of a text; the language is the codeword of least weighted logistic loss, where
a bit weighs the more, the better its classifier told the training rows apart. Texts whose two best codewords are
close are flagged.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unit_hash

DIMS = 4096
TRAIN_ROWS_PER_LANGUAGE = 600
TRAIN_ROWS = 6000
CHUNK = 256


def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str, letters: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Hashed ids of all 1-, 2- and 3-grams of the lower-cased text; a run of other characters is one word end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(letters[c], c, np.uint32(0))
    c = np.concatenate([np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    a, b, d = c[:-2] * np.uint32(2654435761), c[1:-1] * np.uint32(2246822519), c[2:] * np.uint32(3266489917)
    found = [b, a ^ (b + np.uint32(374761393)), a ^ (b * np.uint32(31)) ^ (d + np.uint32(668265263))]
    h = np.concatenate(found)
    return ((h ^ (h >> np.uint32(15)) ^ (h >> np.uint32(7))) & np.uint32(dims - 1)).astype(np.int64)


def features(text: str | None, letters: np.ndarray, dims: int = DIMS) -> np.ndarray | None:
    """Unit vector of square roots of n-gram counts; None if the text is null or has no letter."""
    ids = grams(text, letters, dims) if text else ()
    if not len(ids):
        return None
    x = np.sqrt(np.bincount(ids, minlength=dims).astype(np.float32))
    return x / np.linalg.norm(x)


def codewords(k: int, bits: int = 24, seed: int = 3) -> np.ndarray:
    """k rows of +1/-1: the exhaustive code up to 5 classes, beyond it the best of many random codes."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 5:
        tails = itertools.product((1, -1), repeat=k - 1)
        return np.array([(1, *t) for t in tails if -1 in t], dtype=np.float64).T
    rng, best = np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), size=(k, bits))
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)[np.triu_indices(k, 1)].min()
        if apart > best[0] and (np.abs(code.sum(axis=0)) < k).all():
            best = (apart, code)
    return best[1]


@dataclass
class Model:
    classes: list
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    scale: float = 1.0

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """Softmax over languages of the negative weighted loss of each codeword."""
        margin = x @ self.weights + self.bias
        loss = np.stack([np.logaddexp(0, -margin * c) @ self.trust for c in self.code], axis=1)
        e = np.exp(-self.scale * (loss - loss.min(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: list, steps: int = 80, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """One logistic classifier per bit by gradient descent with momentum; classes weigh the same."""
    classes = sorted(set(y))
    code = codewords(len(classes))
    at = np.array([classes.index(v) for v in y], dtype=int)
    bits = code[at].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    share = np.bincount(at, minlength=len(classes)).astype(np.float32)
    row = (1 / share[at] / max(1, len(classes)))[:, None].astype(np.float32) if len(y) else np.zeros((0, 1), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps if code.shape[1] else 0):
        g = -bits * row / (1 + np.exp(np.clip(bits * (x @ w + b), -30, 30)))
        vw, vb = 0.9 * vw - rate * 10 * (x.T @ g + decay * w), 0.9 * vb - rate * g.sum(axis=0)
        w, b = w + vw, b + vb
    wrong = (row * (bits * (x @ w + b) <= 0)).sum(axis=0) if len(y) else np.zeros(code.shape[1])
    odds = np.log((1 - np.minimum(wrong, 0.49) + 1e-3) / (np.minimum(wrong, 0.49) + 1e-3))
    return Model(classes, code, w, b, odds / odds.sum() if len(odds) else odds, scale=8.0)


def fit(docs: DataFrame, usable: Column, text_col: str, lang_col: str, rows_per_language: int = TRAIN_ROWS_PER_LANGUAGE, dims: int = DIMS, key: str = "doc_id") -> Model:
    """Train on about rows_per_language rows of every language, and on at most TRAIN_ROWS in all, picked by hash of key.

    Feature vectors are made on the executors; only they come to the driver (2 * dims bytes a row, 49 MB at the bound).
    Rows without a language or a letter are not learned from. Repeated rows count as often as they stand.
    """
    known = docs.where(usable & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    each = min(float(rows_per_language), TRAIN_ROWS / max(1, len(counts)) / 1.5)
    rates = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, each / n)]) if counts else F.lit(None).cast("map<string,double>")
    rate = F.coalesce(F.element_at(rates, F.col(lang_col)), F.lit(0.0))
    picked = known.where(unit_hash(F.col(key), seed=23) < rate).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches):
        letters = letter_table()
        for pdf in batches:
            made = [(v, lang) for t, lang in zip(pdf["text"], pdf["lang"]) if (v := features(t, letters, dims)) is not None]
            yield pd.DataFrame([(v.astype(np.float16).tobytes(), lang) for v, lang in made], columns=["x", "lang"])

    rows = picked.mapInPandas(run, "x binary, lang string").limit(TRAIN_ROWS).collect()
    x = np.array([np.frombuffer(r.x, np.float16) for r in rows], dtype=np.float32).reshape(-1, dims)
    return train(x, [r.lang for r in rows])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", close: float = 0.2, dims: int = DIMS) -> DataFrame:
    """(id_col, lang_pred, score, second, ambiguous) for whole texts.

    `und` with score 0 where the text is null or has no letter, or where no language was learned. score is the
    posterior of the best codeword; ambiguous means that the second is less than `close` below it. Of codewords of equal
    loss the language first in order counts. Rows are told one by one, repeated ones too; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """

    def run(batches):
        letters = letter_table()
        for pdf in batches:
            out = []
            for s in range(0, len(pdf), CHUNK):
                part = pdf.iloc[s : s + CHUNK]
                vs = [features(t, letters, dims) for t in part["text"]]
                ok = [i for i, v in enumerate(vs) if v is not None] if model.classes else []
                lang, score, second, near = ["und"] * len(part), [0.0] * len(part), [None] * len(part), [False] * len(part)
                if ok:
                    p = model.posterior(np.array([vs[i] for i in ok]))
                    order = np.argsort(-p, axis=1, kind="stable")
                    for row, i in enumerate(ok):
                        first, then = order[row, 0], order[row, 1] if p.shape[1] > 1 else None
                        lang[i], score[i] = model.classes[first], float(p[row, first])
                        if then is not None:
                            second[i], near[i] = model.classes[then], bool(p[row, first] - p[row, then] < close)
                out.append(pd.DataFrame({"id": part["id"], "lang_pred": lang, "score": score, "second": second, "ambiguous": near}))
            if out:
                yield pd.concat(out)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, lang_pred string, score double, second string, ambiguous boolean").withColumnRenamed("id", id_col)
