"""Native profile models: a stand-in for external programs that build and search profile HMMs.

X1, X2, X3: a model is, per site, the log-odds of each residue over a uniform background, with pseudocounts. Scores
are sums over matching sites. These are approximations, not the numbers of those programs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.lineage import materialise
from cladeframe.functions.sequences import GAP

DNA = "ACGT"


def build(sites: DataFrame, keys: list[str], alphabet: str = DNA, pseudo: float = 1.0) -> DataFrame:
    """X1: (…keys, pos, ch, w): log2 odds of every letter at every site that has a residue."""
    counts = sites.where(F.col("ch") != GAP).groupBy(*keys, "pos", "ch").agg(F.count("*").alias("n"))
    per = counts.groupBy(*keys, "pos").agg(F.sum("n").alias("tot"), F.map_from_entries(F.collect_list(F.struct("ch", "n"))).alias("by"))
    each = per.select(*keys, "pos", "tot", "by", F.explode(F.array(*map(F.lit, alphabet))).alias("ch"))
    k = len(alphabet)
    odds = (F.coalesce(F.element_at("by", F.col("ch")), F.lit(0)) + pseudo / k) / (F.col("tot") + pseudo) / (1.0 / k)
    return each.select(*keys, "pos", "ch", F.log2(odds).alias("w"))


def _parts(packed: DataFrame, keys: list[str], most: int, cells: int, name: str) -> DataFrame:
    """(…keys, name): into how many parts a group's rows go, so that a part has about `most` rows and `cells` sites at most."""
    n = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum(F.size("at")) / cells), F.lit(1))
    return packed.groupBy(*keys).agg(n.alias(name))


def score(sites: DataFrame, model: DataFrame, shared: list[str], model_keys: list[str], within: float | None = None) -> DataFrame:
    """X2, JN2: (…shared, …model_keys, name, score): every row against every model of the same `shared` keys.

    A row and a model without a common (pos, ch) give no score. Rows and models are packed (a list each) and dealt into
    parts; every part of rows meets every part of models in a task of its own, so sites of pairs are never shuffled and
    memory is bounded by a pair of parts. The scores are quadratic by nature; within: only those that are less than this
    below a row's best in its pair of parts, for those who want best models.
    """
    keys = shared or ["_all"]
    sites, model = (d if shared else d.withColumn("_all", F.lit(0)) for d in (sites.where(F.col("ch") != GAP), model))
    sites, model = sites.dropna(subset=keys), model.dropna(subset=keys)
    # Characters are code points of less than 21 bits.
    code = F.shiftleft(F.col("pos").cast("long"), 21) + F.ascii("ch")
    rows = materialise(sites.groupBy(*keys, "name").agg(F.sort_array(F.collect_list(code)).alias("at")))
    cells = F.sort_array(F.collect_list(F.when(code.isNotNull(), F.struct(code.alias("c"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w")))))
    models = model.groupBy(*keys, *model_keys).agg(cells.alias("m"))
    models = materialise(models.select(*keys, *model_keys, F.transform("m", lambda c: c["c"]).alias("at"), F.transform("m", lambda c: c["w"]).alias("w")))
    # A task returns what a pair of parts gives at once: fewer rows meet where all scores stay.
    parts = materialise(_parts(rows, keys, 2048 if within is None else 4096, 1 << 19, "_nr").join(_parts(models, keys, 512, 1 << 17, "_nm"), keys))

    def dealt(packed: DataFrame, by: list[str], own: str, other: str) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{other}") - 1))
        at = packed.join(parts, keys).withColumn(f"_{own}", F.pmod(F.xxhash64(*by), f"_n{own}")).withColumn(f"_{other}", each)
        return at.drop("_nr", "_nm").groupBy(*keys, "_r", "_m")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        (rn, rc), (mn, mc), (_, mw) = _flat(left["at"]), _flat(right["at"]), _flat(right["w"])
        i, j, x = tile_scores(rn, rc, mn, mc, mw, within)
        i, j = pa.array(i), pa.array(j)
        return pa.table({**{k: left[k].take(i) for k in shared}, **{k: right[k].take(j) for k in model_keys}, "name": left["name"].take(i), "score": pa.array(x)})

    kind = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    schema = ", ".join([*[kind(rows, k) for k in shared], *[kind(models, k) for k in model_keys], kind(rows, "name"), "score double"])
    return dealt(rows, ["name"], "r", "m").cogroup(dealt(models, model_keys, "m", "r")).applyInArrow(tile, schema)


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists of numbers, and their values one after another."""
    c = lists.combine_chunks()
    return c.value_lengths().to_numpy(), c.flatten().to_numpy()


def tile_scores(rn: np.ndarray, rc: np.ndarray, mn: np.ndarray, mc: np.ndarray, mw: np.ndarray, within: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, model, score) of rows (lengths, codes) and models (lengths, codes, weights) with a common code.

    A row's weights are added in the order of its codes, whichever rows and models it meets.
    """
    known, col = np.unique(mc, return_inverse=True)
    at = np.searchsorted(known, rc)
    real = np.isin(rc, known)
    at, n = at[real], np.bincount(np.repeat(np.arange(len(rn)), rn)[real], minlength=len(rn))
    start, of = np.cumsum(n) - n, np.repeat(np.arange(len(mn)), mn)
    order = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
    out = [(np.zeros(0, "int32"), np.zeros(0, "int32"), np.zeros(0))]
    width = max(1, (1 << 22) // max(1, len(known)))
    for low in range(0, len(mn), width):
        wide, own = min(width, len(mn) - low), (of >= low) & (of < low + width)
        w, there = np.zeros((len(known), wide)), np.zeros((len(known), wide), bool)
        np.add.at(w, (col[own], of[own] - low), mw[own])
        there[col[own], of[own] - low] = True
        step = max(1, (1 << 17) // wide)
        for r in (order[a : a + step] for a in range(0, len(order), step)):
            s, met, all_met = np.zeros((len(r), wide)), np.zeros((len(r), wide), bool), False
            for k in range(n[r[0]]):
                live = np.count_nonzero(n[r] > k)
                here = at[start[r[:live]] + k]
                s[:live] += w[here]
                if not all_met:
                    met[:live] |= there[here]
                    all_met = met.all()
            if within is not None:
                met &= ~(s < np.where(met, s, -np.inf).max(axis=1, keepdims=True) - within)
            i, j = np.nonzero(met)
            out.append((r[i].astype("int32"), (j + low).astype("int32"), s[i, j]))
    return tuple(np.concatenate(c) for c in zip(*out))


def viterbi(seq: str, weights: np.ndarray, alphabet: str, open_: float = 4.0, extend: float = 1.0) -> tuple[float, list[int]]:
    """Best global alignment of a sequence to a profile (sites x letters) with affine gaps.

    Returns the score and for each letter its site, or -1 for an insertion. Ties prefer match, then deletion.
    """
    scores, paths = viterbi_of_all([seq], weights, alphabet, open_, extend)
    return float(scores[0]), paths[0].tolist()


def viterbi_of_all(seqs: list[str], weights: np.ndarray, alphabet: str, open_: float = 4.0, extend: float = 1.0) -> tuple[np.ndarray, list[np.ndarray]]:
    """viterbi of many sequences and one profile: sequences of like length go together, a byte for each of their cells."""
    n, m = np.array([len(s) for s in seqs], int), len(weights)
    order, scores, paths = np.argsort(n, kind="stable"), np.zeros(len(seqs)), [None] * len(seqs)
    while len(order):
        # So many of the longest that their cells, and what a step holds of them, fit in 16 MB; one, if it alone does not.
        few = order[-max(1, (1 << 24) // ((n[order[-1]] + 128) * (m + 1))) :]
        order = order[: -len(few)]
        scores[few], found = _viterbi_batch([seqs[k] for k in few], n[few], weights, alphabet, open_, extend)
        for k, path in zip(few, found):
            paths[k] = path
    return scores, paths


def _viterbi_batch(seqs: list[str], n: np.ndarray, weights: np.ndarray, alphabet: str, open_: float, extend: float) -> tuple[np.ndarray, list[np.ndarray]]:
    size, most, m, low = len(seqs), int(n.max()), len(weights), -1e30
    letters, first = np.unique(np.array([ord(c) for c in alphabet], "uint32"), return_index=True)
    codes = np.frombuffer("".join(seqs).encode("utf-32-le"), "<u4")
    place = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
    at = np.full((size, most), len(alphabet))
    at[np.arange(most) < n[:, None]] = np.where(letters[place] == codes, first[place], len(alphabet))
    of = np.vstack([weights.T, np.zeros(m)])  # letters beside the alphabet weigh nothing

    def first_best(a, b, c):
        return np.where((a >= b) & (a >= c), 0, np.where(b >= c, 1, 2)).astype("uint8")

    match, ins, dele = (np.full((size, m + 1), low) for _ in range(3))
    match[:, 0] = 0
    dele[:, 1:] = -open_ - extend * np.arange(m)
    run = extend * np.arange(1, m + 1)
    # Where a match, insertion or deletion at a cell comes from (0 match, 1 deletion, 2 insertion): two bits each.
    back = np.zeros((most + 1, size, m + 1), "uint8")
    back[0] = 1 << 4
    scores, state = np.zeros(size), np.zeros(size, "uint8")
    for i in range(most + 1):
        if i:
            w, top = of[at[:, i - 1]], np.maximum(match, dele)
            best = np.maximum(top, ins)
            back[i, :, 1:] = first_best(match, dele, ins)[:, :-1]
            back[i] |= first_best(match - open_, dele - open_, ins - extend) << 2
            now, ins = np.full((size, m + 1), low), np.maximum(top - open_, ins - extend)
            ins[:, 0] = -open_ - extend * (i - 1)
            now[:, 1:] = best[:, :-1] + w
            match, dele = now, np.full((size, m + 1), low)
            # A deletion run ending at j starts at some k < j: a running maximum of what it leaves, with the extension undone.
            dele[:, 1:] = np.maximum.accumulate(np.maximum(match, ins)[:, :-1] - open_ + run, axis=1) - run
            back[i, :, 1:] |= first_best(match - open_, dele - extend, ins - open_)[:, :-1] << 4
        done = np.flatnonzero(n == i)
        last = [t[done, m] for t in (match, dele, ins)]
        state[done] = first_best(*last)
        scores[done] = np.choose(state[done], last)
    sites, i, j = np.full((size, most), -1), n.copy(), np.full(size, m)
    while len(k := np.flatnonzero((i > 0) | (j > 0))):
        now, cell = state[k], back[i[k], k, j[k]]
        on = now == 0
        sites[k[on], i[k[on]] - 1] = j[k[on]] - 1
        state[k] = (cell >> np.array([0, 4, 2], "uint8")[now]) & 3
        i[k] -= now != 1
        j[k] -= now != 2
    return scores, [sites[k, : n[k]] for k in range(size)]


def align(fragments: DataFrame, model: DataFrame, model_key: str, alphabet: str = DNA) -> DataFrame:
    """X3: (model_key, name, score, pos, site): residues of fragments (model_key, name, seq) on their model's sites.

    The fragments of a model are dealt into parts of bounded size, so those of a popular model spread over tasks; a part
    meets its model, which is one list, once.
    """
    rows = materialise(fragments.select(model_key, "name", "seq").dropna(subset=[model_key]))
    cell = F.sort_array(F.collect_list(F.struct("pos", "ch", "w")))
    packed = model.groupBy(model_key).agg(cell.alias("m"))
    packed = packed.select(model_key, "m.pos", "m.ch", "m.w")
    parts = F.greatest(F.ceil(F.count("*") / 2048), F.ceil(F.sum(F.length("seq")) / (1 << 18)), F.lit(1))
    parts = materialise(rows.groupBy(model_key).agg(parts.alias("_n")))
    dealt = rows.join(parts, model_key).withColumn("_part", F.pmod(F.xxhash64("name", "seq"), "_n")).drop("_n")
    models = packed.join(parts, model_key).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        seqs = [s or "" for s in left["seq"].to_pylist()] if right.num_rows else []
        here, score, pos, site = ([np.zeros(0, kind)] for kind in ("int64", "float64", "int32", "int32"))
        if seqs:
            sites, at = np.unique(_flat(right["pos"])[1], return_inverse=True)
            w = np.zeros((len(sites), len(alphabet)))
            w[at, [alphabet.index(c) for c in right["ch"][0].as_py()]] = _flat(right["w"])[1]
            scores, paths = viterbi_of_all(seqs, w, alphabet)
            n = [len(p) for p in paths]
            here, score, pos = [np.repeat(np.arange(len(seqs)), n)], [np.repeat(scores, n)], [np.arange(k, dtype="int32") for k in n]
            path = np.concatenate(paths)
            site = [np.where(path >= 0, sites[path], -1).astype("int32")]
        here = pa.array(np.concatenate(here))
        return pa.table({model_key: left[model_key].take(here), "name": left["name"].take(here), "score": np.concatenate(score), "pos": np.concatenate(pos), "site": np.concatenate(site)})

    kind = lambda c: f"`{c}` {rows.schema[c].dataType.simpleString()}"
    keys = [model_key, "_part"]
    return dealt.groupBy(*keys).cogroup(models.groupBy(*keys)).applyInArrow(run, f"{kind(model_key)}, {kind('name')}, score double, pos int, site int")
