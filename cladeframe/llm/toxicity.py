"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs per word: an embedding of the word's hash and the mean of the embeddings of its hashed character 4- and
5-grams (with word ends marked). Two gated recurrent networks read each window of words in both directions; attention
weights pool their states to one vector and one logit. All overlapping windows of a text are scored, and the text
gets its highest window score. Training knows labels of texts only: in every epoch all windows of the whole training
texts are scored, and a text's highest window takes the gradient. The first coordinate of both embeddings starts as a
smoothed log-odds of the training texts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut

WINDOW, STRIDE = 24, 1
EMBED, HIDDEN = 8, 8
WORD_ROWS, GRAM_ROWS = 4096, 16384
TRAIN_ROWS = {0: 2700, 1: 900}
TRAIN_WORDS = 12_000_000
TRAIN_STRIDE = 6
LEAST_STEPS = 120
CACHE_WORDS = 150_000
ROWS_AT_ONCE = 512
WORDS = re.compile(r"[^\W\d_]+")
G = 3 * HIDDEN


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(3266489917)
    return h ^ (h >> np.uint32(16))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word row of each word, character-gram rows of all words in a row, and where each word's grams begin."""
    joined = "".join(f"<{w}>" for w in words)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    place = np.arange(len(c)) - np.repeat(first, size)
    power = (np.uint32(2654435761) ** (place % 64).astype(np.uint32)).astype(np.uint32)
    whole = mix(np.add.reduceat(c * power, first, dtype=np.uint32)) % np.uint32(WORD_ROWS)
    pad = np.concatenate([c, np.zeros(5, np.uint32)])
    h4 = pad[: len(c)] * np.uint32(2654435761)
    for k in (1, 2, 3):
        inside = pad[k : k + len(c)] if k < 3 else np.where(np.repeat(size, size) < 4, np.uint32(0), pad[3 : 3 + len(c)])
        h4 = (h4 ^ inside) * np.uint32(2654435761)
    h5 = (h4 ^ pad[4 : 4 + len(c)]) * np.uint32(2246822519)
    left = np.repeat(size, size) - place
    n4, n5 = np.maximum(size - 3, 1), np.maximum(size - 4, 0)
    begin = np.concatenate([[0], np.cumsum(n4 + n5)])
    out = np.zeros(begin[-1], dtype=np.int64)
    ok4 = (left >= 4) | ((place == 0) & (np.repeat(size, size) < 4))
    ok5 = left >= 5
    base = np.repeat(begin[:-1], size)
    out[(base + place)[ok4]] = mix(h4[ok4]) % np.uint32(GRAM_ROWS)
    out[(base + np.repeat(n4, size) + place)[ok5]] = mix(h5[ok5]) % np.uint32(GRAM_ROWS)
    return whole.astype(np.int64), out, begin


def features_of(words: list[str], at_once: int = 16_384) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_features of a vocabulary, made in parts: what it needs besides its result does not grow with the vocabulary."""
    parts, begin = [], [np.zeros(1, dtype=np.int64)]
    for s in range(0, len(words), at_once):
        whole, gram, own = word_features(words[s : s + at_once])
        parts.append((whole.astype(np.int32), gram.astype(np.int32)))
        begin.append(own[1:] + begin[-1][-1])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(begin)


def grams_of(gram: np.ndarray, begin: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram rows of the words `own` in a row, and where each word's begin."""
    n = begin[own + 1] - begin[own]
    spot = np.concatenate([[0], np.cumsum(n)])
    return gram[np.repeat(begin[own] - spot[:-1], n) + np.arange(spot[-1])], spot


def codes_of(vocab: dict[str, int], words: list[str]) -> np.ndarray:
    """Numbers of words in vocab, to which new ones are added."""
    return np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words))


def n_windows(n: int, stride: int) -> int:
    """Windows that start every `stride` words of a text of n words, the last at or beyond its end."""
    return 1 + max(0, -(-(n - WINDOW) // stride))


def window(start: int, n: int) -> np.ndarray:
    """Word positions of a window of a text of n words; -1 beyond its end."""
    at = start + np.arange(WINDOW)
    return np.where(at < n, at, -1)


def windows(n: int, stride: int = STRIDE) -> np.ndarray:
    """Word positions of all windows of a text of n words."""
    return np.stack([window(k * stride, n) for k in range(n_windows(n, stride))])


def sigmoid(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Net:
    """Parameters by name; forward over windows of word rows, and the gradient of the logistic loss."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype(np.float32)
        self.p = {
            "word": n(WORD_ROWS, EMBED, by=0.05), "gram": n(GRAM_ROWS, EMBED, by=0.05), "wx": n(2 * EMBED, 2 * G, by=0.3), "bx": np.zeros(2 * G, np.float32),
            "u0": n(HIDDEN, G, by=0.3), "u1": n(HIDDEN, G, by=0.3), "v": n(2 * HIDDEN, by=0.3), "w": n(2 * HIDDEN, by=0.3), "b": np.zeros(1, np.float32),
        }

    def inputs(self, whole, gram, begin):
        n = np.diff(begin).astype(np.float32)
        chars = np.add.reduceat(self.p["gram"][gram], begin[:-1], axis=0) / n[:, None]
        return np.hstack([self.p["word"][whole], chars])

    def project(self, x):
        return x @ self.p["wx"] + self.p["bx"]

    def _direction(self, rows, at, d, keep):
        u, live = self.p[f"u{d}"], at >= 0
        h, states, saved = np.zeros((len(at), HIDDEN), np.float32), np.zeros((WINDOW, len(at), HIDDEN), np.float32), []
        for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
            g, m = rows[at[:, t], d * G : (d + 1) * G], live[:, t, None]
            s = h @ u
            zr = sigmoid(g[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
            z, r, sn = zr[:, :HIDDEN], zr[:, HIDDEN:], s[:, 2 * HIDDEN :]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * sn)
            if keep:
                saved.append((t, h, z, r, n, sn, m))
            h = np.where(m, n + z * (h - n), h)
            states[t] = h
        return states, saved

    def forward(self, rows, at, keep=False):
        """Logits of windows; rows: projected inputs of words, at: (windows, WINDOW) indices into them or -1."""
        (fwd, s0), (bwd, s1) = self._direction(rows, at, 0, keep), self._direction(rows, at, 1, keep)
        h = np.concatenate([fwd, bwd], axis=2)
        e = np.where(at.T >= 0, h @ self.p["v"], np.float32(-1e9))
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        ctx = (a[:, :, None] * h).sum(axis=0)
        logit = ctx @ self.p["w"] + self.p["b"][0]
        return (logit, (h, a, ctx, s0, s1)) if keep else logit

    def scan(self, rows, texts, stride: int = STRIDE, at_once: int = 4096):
        """For each text, as row numbers of its words: the highest logit of its windows, and where that one starts.

        Texts are laid end to end, each padded to the end of its last window, so that step t of all windows is one
        strided view; windows over a seam are computed and ignored. Texts go by length, so few runs have padding.
        """
        by_size = np.argsort([len(t) for t in texts], kind="stable")
        texts = [texts[i] for i in by_size]
        best, place = np.full(len(texts), -np.inf), np.zeros(len(texts), dtype=np.int64)
        many = [n_windows(len(t), stride) for t in texts]
        i = 0
        while i < len(texts):
            j, seen = i, 0
            while j < len(texts) and (j == i or seen + many[j] + WINDOW // stride <= at_once):
                seen, j = seen + many[j] + WINDOW // stride - 1, j + 1
            size = [(k - 1) * stride + WINDOW for k in many[i:j]]
            first = np.concatenate([[0], np.cumsum(size)])
            code, live = np.zeros(first[-1], dtype=np.int64), np.zeros(first[-1], dtype=bool)
            for t, a in zip(texts[i:j], first):
                code[a : a + len(t)], live[a : a + len(t)] = t, True
            logit = self._strided(rows[code], live, stride, at_once)
            for k in range(i, j):
                a = first[k - i] // stride
                own = logit[a : a + many[k]]
                place[k] = stride * int(np.argmax(own))
                best[k] = own[place[k] // stride]
            i = j
        back = np.argsort(by_size)
        return best[back], place[back]

    def _strided(self, inputs, live, stride, at_once):
        """Logits of the windows that start every `stride` words of a run of projected words."""
        p, half, gates = self.p, np.float32(0.5), np.ascontiguousarray(inputs.T)
        for d in (0, 1):
            gates[d * G : d * G + 2 * HIDDEN] *= half  # sigmoid(x) is (tanh(x / 2) + 1) / 2: halves are taken here and in u once
        n = (len(live) - WINDOW) // stride + 1
        out, most = np.zeros(n), min(at_once, n)
        # Everything that a step makes goes to arrays that are made once: fresh ones cost more than the arithmetic.
        x, state, step = np.empty((G + 2, most), np.float32), np.empty((HIDDEN, most), np.float32), np.empty((HIDDEN, most), np.float32)
        seen = np.empty((2, WINDOW, most), np.float32)  # of every state its part of the attention and of the logit
        # One product of a state gives what its next step needs and what is read from it.
        both = [np.concatenate([p[f"u{d}"].T * half, [p[k][d * HIDDEN : (d + 1) * HIDDEN] for k in ("v", "w")]]).astype(np.float32) for d in (0, 1)]
        for s in range(0, n, at_once):
            c = min(at_once, n - s)
            view = lambda t: slice(s * stride + t, s * stride + t + (c - 1) * stride + 1, stride)
            full = live[s * stride : s * stride + (c - 1) * stride + WINDOW].all()
            if c < most:
                x, state, step, seen, most = x[:, :c].copy(), state[:, :c].copy(), step[:, :c].copy(), seen[:, :, :c].copy(), c
            zr, new, z, r, part = x[: 2 * HIDDEN], x[2 * HIDDEN : G], x[:HIDDEN], x[HIDDEN : 2 * HIDDEN], x[G:]
            for d in (0, 1):
                state[:], x[:] = 0, 0
                for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                    g = gates[d * G : (d + 1) * G, view(t)]
                    zr += g[: 2 * HIDDEN]
                    np.tanh(zr, out=zr)
                    r *= new  # new is half of what the reset gate lets through, and r that gate as tanh
                    new += r
                    new += g[2 * HIDDEN :]
                    np.tanh(new, out=new)
                    np.subtract(state, new, out=step)
                    step *= z
                    step += state
                    step += new
                    step *= half
                    if full:
                        state, step = step, state
                    else:
                        np.copyto(state, step, where=live[view(t)])
                    np.matmul(both[d], state, out=x)
                    if d == 0:
                        seen[:, t] = part
                    else:
                        seen[:, t] += part
            if not full:
                for t in range(WINDOW):
                    seen[0, t, ~live[view(t)]] = -1e9
            e = seen[0]
            e -= e.max(axis=0)
            np.exp(e, out=e)
            seen[1] *= e
            out[s : s + c] = seen[1].sum(axis=0) / e.sum(axis=0) + p["b"][0]
        return out

    def gradient(self, x, at, y, weight):
        """Gradients of all dense parameters, and of x (inputs of words)."""
        p, rows = self.p, self.project(x)
        logit, (h, a, ctx, s0, s1) = self.forward(rows, at, True)
        dl = ((sigmoid(logit) - y) * weight).astype(np.float32)
        g = {"w": ctx.T @ dl, "b": np.array([dl.sum()], np.float32)}
        dctx = dl[:, None] * p["w"]
        da = (h * dctx).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0))
        dh_all = a[:, :, None] * dctx + de[:, :, None] * p["v"]
        g["v"] = (de[:, :, None] * h).sum(axis=(0, 1))
        drows = np.zeros_like(rows)
        for d, saved in ((0, s0), (1, s1)):
            u, du = p[f"u{d}"], np.zeros_like(p[f"u{d}"])
            carry = np.zeros((len(at), HIDDEN), np.float32)
            for t, before, z, r, n, sn, m in reversed(saved):
                dh = dh_all[t][:, d * HIDDEN : (d + 1) * HIDDEN] + carry
                dn_, carry = np.where(m, dh, 0), np.where(m, 0, dh)
                dan = dn_ * (1 - z) * (1 - n * n)
                daz = dn_ * (before - n) * z * (1 - z)
                dar = dan * sn * r * (1 - r)
                ds = np.hstack([daz, dar, dan * r])
                du += before.T @ ds
                carry = carry + dn_ * z + ds @ u.T
                np.add.at(drows[:, d * G : (d + 1) * G], at[:, t], np.hstack([daz, dar, dan]))
            g[f"u{d}"] = du
        g["wx"], g["bx"] = x.T @ drows, drows.sum(axis=0)
        return g, drows @ p["wx"].T, logit

    def start_from_odds(self, whole, gram, begin, coded, y):
        """Set the first coordinate of both embeddings to the clipped log-odds of their rows' presence in texts."""
        n_word, n_gram = np.ones((2, WORD_ROWS)), np.ones((2, GRAM_ROWS))
        for code, label in zip(coded, y.astype(int)):
            own = np.unique(code)
            n_word[label, np.unique(whole[own])] += 1
            n_gram[label, np.unique(grams_of(gram, begin, own)[0])] += 1
        for name, n in (("word", n_word), ("gram", n_gram)):
            share = n / (np.bincount(y.astype(int), minlength=2)[:, None] + 2)
            self.p[name][:, 0] = np.clip(np.log(share[1] / share[0]), -3, 3) * 0.5

    def projected(self, whole, gram, begin, at_once: int = 8192):
        """Projected inputs of all words of a vocabulary."""
        out = np.zeros((len(whole), 2 * G), np.float32)
        for s in range(0, len(whole), at_once):
            own = np.arange(s, min(s + at_once, len(whole)))
            out[own] = self.project(self.inputs(whole[own], *grams_of(gram, begin, own)))
        return out

    def train(self, docs: list[list[str]], y: np.ndarray, **how) -> Net:
        """docs: all words of each training text."""
        vocab: dict[str, int] = {}
        return self.train_coded(vocab, [codes_of(vocab, d) for d in docs], y, **how)

    def train_coded(self, vocab: dict[str, int], coded: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 2) -> Net:
        """coded: all words of each training text, as their numbers in vocab. Few texts get more epochs: LEAST_STEPS in all."""
        rng = np.random.default_rng(seed)
        if len(set(y.tolist())) < 2:
            self.p["b"][0] = 8.0 if len(y) and y[0] else -8.0
            self.p["w"][:] = 0
            return self
        if not vocab:
            return self
        whole, gram, begin = features_of(list(vocab))
        self.start_from_odds(whole, gram, begin, coded, y)
        m, v, k = {n: np.zeros_like(q) for n, q in self.p.items()}, {n: np.zeros_like(q) for n, q in self.p.items()}, 0
        epochs = max(epochs, -(-LEAST_STEPS // max(1, -(-len(coded) // batch))))
        for _ in range(epochs):
            _, place = self.scan(self.projected(whole, gram, begin), coded, TRAIN_STRIDE)
            order = rng.permutation(len(coded))
            for s in range(0, len(order), batch):
                own = order[s : s + batch]
                at = np.stack([window(int(place[i]), len(coded[i])) for i in own])
                at = np.stack([np.where(w >= 0, coded[i][np.maximum(w, 0)], -1) if len(coded[i]) else w for i, w in zip(own, at)])
                used, back = np.unique(at[at >= 0], return_inverse=True)
                if not len(used):
                    continue
                local = np.full(at.shape, -1)
                local[at >= 0] = back
                g_rows, spot = grams_of(gram, begin, used)
                n = np.diff(spot)
                x = self.inputs(whole[used], g_rows, spot)
                grads, dx, _ = self.gradient(x, local, y[own].astype(np.float32), 1 / len(own))
                grads["word"], grads["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
                np.add.at(grads["word"], whole[used], dx[:, :EMBED])
                np.add.at(grads["gram"], g_rows, np.repeat(dx[:, EMBED:] / n[:, None].astype(np.float32), n, axis=0))
                k += 1
                for name, q in self.p.items():
                    d = grads[name]
                    m[name] = 0.9 * m[name] + 0.1 * d
                    v[name] = 0.99 * v[name] + 0.01 * d * d
                    q -= np.float32(rate) * (m[name] / np.float32(1 - 0.9**k)) / (np.sqrt(v[name] / np.float32(1 - 0.99**k)) + np.float32(1e-7))
        return self


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_label: dict = TRAIN_ROWS) -> Net:
    """Train on the whole texts of at most rows_per_label[label] labelled rows of each label where `usable` holds.

    They are picked by hash of the id, and only their words come to the driver (4 bytes a word): a text with which a label
    would have more than half of TRAIN_WORDS is left out. Labels other than 0 and 1 are ignored; of
    several labels of an id the highest counts, of several texts the first in order. Without labelled rows of both kinds
    every text scores next to 0, or next to 1 where all labels are 1.
    """
    known = labels.where(usable & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    known = known.join(docs.select(id_col), id_col, "left_semi")
    picked = [bounded_sample(known.where(F.col("y") == k), id_col, rows_per_label[k]).collect() for k in (0, 1)]
    rows = [(r[0], int(r["y"])) for part in picked for r in part]
    if not rows:
        return Net().train([], np.zeros(0, dtype=int))
    kind = docs.schema[id_col].dataType.simpleString()
    ids = F.broadcast(docs.sparkSession.createDataFrame(rows, f"{id_col} {kind}, y int"))  # bounded by rows_per_label

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "words": [" ".join(words_of(t)) for t in pdf["text"]]})

    texts = docs.select(id_col, F.col(text_col).alias("text")).join(ids, id_col).select(F.col(id_col).alias("id"), "y", "text")
    texts = texts.mapInPandas(run, f"id {kind}, y int, words string").groupBy("id", "y").agg(F.min("words").alias("words"))
    texts = cut(texts.withColumn("n", F.when(F.col("words") == "", 0).otherwise(F.size(F.split("words", " ")))))
    left, fits = {0: TRAIN_WORDS // 2, 1: TRAIN_WORDS // 2}, set()
    for r in texts.select("id", "y", "n").orderBy(F.xxhash64(F.lit(19), "id"), "id").collect():  # at most as many as rows_per_label
        if r.n <= left[r.y]:
            left[r.y] -= r.n
            fits.add(r.id)
    vocab: dict[str, int] = {}
    got = []
    for r in texts.orderBy("id").toLocalIterator():
        if r.id in fits:
            got.append((r.y, codes_of(vocab, r.words.split())))
    return Net().train_coded(vocab, [c for _, c in got], np.array([y for y, _ in got], dtype=int))


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


class Scorer:
    """Scores texts; keeps projected inputs of words it has met, and forgets them all when there are too many."""

    def __init__(self, net: Net):
        self.net = net
        self.known, self.rows = {}, np.zeros((0, 2 * G), np.float32)

    def codes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known, self.rows = {}, np.zeros((0, 2 * G), np.float32)
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if fresh:
            n = len(self.known)
            self.known.update(zip(fresh, range(n, n + len(fresh))))
            made = self.net.project(self.net.inputs(*word_features(fresh)))
            if n + len(fresh) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), n + len(fresh), 4096), 2 * G), np.float32)
                grown[:n] = self.rows[:n]
                self.rows = grown
            self.rows[n : n + len(fresh)] = made
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def scores(self, texts, words_at_once: int = 30_000) -> np.ndarray:
        out, runs, of, held = np.zeros(len(texts)), [], [], 0

        def flush():
            nonlocal runs, of, held
            if runs:
                code = self.codes([w for r in runs for w in r])
                parts = np.split(code, np.cumsum([len(r) for r in runs])[:-1])
                logit, _ = self.net.scan(self.rows, parts)
                np.maximum.at(out, np.array(of), sigmoid(logit.astype(np.float32)).astype(np.float64))
            runs, of, held = [], [], 0

        for i, text in enumerate(texts):
            own = words_of(text)
            for s in range(0, len(own), words_at_once):  # very long texts in runs that overlap by a window
                runs.append(own[max(0, s - WINDOW + 1) : s + words_at_once])
                of.append(i)
                held += len(runs[-1])
                if held >= words_at_once:
                    flush()
        flush()
        return out


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row's whole text: the highest score of its windows; 0 where there is no word.

    Null and empty texts score 0. Rows are scored one by one, so repeated rows and ids repeat in the result; equal texts
    score the same. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """

    def run(batches):
        scorer = Scorer(net)
        for pdf in batches:
            for at in range(0, len(pdf), ROWS_AT_ONCE):
                part = pdf.iloc[at : at + ROWS_AT_ONCE]
                yield pd.DataFrame({"id": part["id"], "score": scorer.scores(part["text"].tolist())})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, net: Net, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """Rows of docs whose score is below `least`, columns and values unchanged.

    Texts that are null or without words stay. Repeated rows share one fate and are kept as often as they stand; an empty
    table gives an empty result. No column is added, so names cannot clash.
    """

    def run(batches):
        scorer = Scorer(net)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield part.filter(pa.array(scorer.scores(part.column(text_col).to_pylist()) < least))

    return docs.mapInArrow(run, docs.schema)
