"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The vocabulary file is of the BPE kind. Its encoding of a text is the one segmentation whose neighbouring pieces all
"hold": encoding the two together gives the same two pieces again. (No merge ever crosses a final boundary, so both
sides of a boundary evolve independently; the first merge that crossed a boundary of another segmentation would show
in that pair alone.) In the max-plus semiring a step to a piece weighs the piece's score (its merge rank) if the pair
holds and minus infinity otherwise, and the encoding is the only path of finite weight.

A giant document is cut at fixed places. The state at a cut is the piece that covers or ends at it, so there are few.
Each chunk yields its transfer matrix, of the pairs of an incoming and an outgoing state with their path's weight (the
rest is minus infinity and not stored), and a table of the pieces on these paths: those up to the first place that no
piece can cross, by incoming state, those from the last such place on, by outgoing state, and the words between, which
all paths share. Matrices are combined associatively: first inside groups of chunks, then the groups of a document;
going back down, every cut gets the state that the whole document's path has there, and each chunk reads its pieces
from its own table. Other documents are encoded as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT_CHARS = 32_768
CHUNK_CHARS = 16_384
GROUP_CHUNKS = 256
CACHE_WORDS = 300_000
MARK = "▁"
START, END = (0, 0), (-1, -1)


def load_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """Bytes of a model file, read by the driver or, where the path has a scheme, by Spark."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first().content)
    with open(path, "rb") as f:
        return f.read()


class Pieces:
    """A BPE model without its dummy prefix: pieces of raw strings in which spaces are marks already."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or proto.normalizer_spec.name != "identity":
            raise ValueError("a BPE model without normalisation is expected")
        self.prefix = MARK if proto.normalizer_spec.add_dummy_prefix else ""
        proto.normalizer_spec.add_dummy_prefix = False
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        if any(p.type == p.USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported: they are taken before any merge")
        plain = [i for i, p in enumerate(proto.pieces) if p.type == p.NORMAL]
        self.scores = {proto.pieces[i].piece: proto.pieces[i].score for i in plain}
        self.ids = {proto.pieces[i].piece: i for i in plain}
        self.unknown = min(self.scores.values(), default=0.0) - 10
        self.longest = max(map(len, self.scores), default=1)
        self.by_words = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.scores)
        self.table = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.encode() if p.type == p.NORMAL else b"" for p in proto.pieces]
        self.weights = np.array([p.score if p.type == p.NORMAL else 0.0 for p in proto.pieces])
        self.marked = np.array([p.piece.startswith(MARK) for p in proto.pieces])
        self.known: dict[str, bytes] = {}
        self.split = lru_cache(maxsize=200_000)(self._split)

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", MARK) if text else ""

    def encode(self, raw: str) -> np.ndarray:
        """Ids of a raw string. Words are encoded once and kept as bytes; all are forgotten when there are too many.

        New words are encoded in one go: as no piece holds an inner mark, the pieces that begin with one tell the
        words apart again. Strings with runs of marks go to the library whole.
        """
        head, *words = raw.split(MARK)
        if not self.by_words or "" in words:
            return np.array(self.sp.encode(raw), dtype=np.int32)
        fresh = list(set(words).difference(self.known))
        if fresh:
            if len(self.known) + len(fresh) > CACHE_WORDS:
                self.known.clear()
                fresh = list(set(words))
            ids = np.array(self.sp.encode(MARK + MARK.join(fresh)), dtype=np.int32)
            coded, at = ids.tobytes(), [*(4 * np.flatnonzero(self.marked[ids])).tolist(), 4 * len(ids)]
            self.known.update(zip(fresh, [coded[i:j] for i, j in zip(at, at[1:])], strict=True))
        coded = b"".join(map(self.known.__getitem__, words))
        if head:
            coded = np.array(self.sp.encode(head), dtype=np.int32).tobytes() + coded
        return np.frombuffer(coded, dtype=np.int32)

    def decode(self, ids, first: bool = True) -> str:
        """Text of ids; a document's first ids lose the dummy prefix."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        text = text[1:] if first and self.prefix and text[:1] == MARK else text
        return text.replace(MARK, " ")

    def _split(self, s: str) -> tuple[str, ...]:
        """Pieces of a short string: merge the best-scored neighbours, the leftmost of equals, until none merge."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                v = self.scores.get(parts[i] + parts[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if at < 0:
                return tuple(parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def holds(self, left: str, right: str) -> bool:
        return not left or self.split(left + right) == (left, right)

    def forced(self, s: str, at: int) -> bool:
        """No piece can cross this place of s."""
        return self.by_words and 0 < at < len(s) and s[at] == MARK and s[at - 1] != MARK

    def paths(self, s: str, begin: int, before: str, upto: int, reach: int):
        """Pieces that end paths of weight 0 from `begin` (after the piece `before`).

        Returns the ends of those paths up to `upto` as {end: start of last piece}, and the last pieces (start, end)
        of paths that cross or end at `upto` and end by `reach`.
        """
        last, out = {begin: begin - len(before)}, []
        for end in range(begin + 1, reach + 1):
            for start in range(max(begin, end - self.longest), min(end, upto)):
                if start in last and (end - start == 1 or s[start:end] in self.scores):
                    own = s[start:end]
                    if self.split(own) == (own,) and self.holds(before if start == begin else s[last[start] : start], own):
                        if end <= upto:
                            last[end] = start
                        if end >= upto:
                            out.append((start, end))
                        break
        return last, out

    def states(self, s: str, at: int) -> list[tuple[int, int]]:
        """All pieces (start, end), relative to `at`, that cover or end at place `at` of s."""
        found = []
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(len(s), start + self.longest) + 1):
                own = s[start:end]
                if end - start == 1 or own in self.scores and self.split(own) == (own,):
                    found.append((start - at, end - at))
        return found

    def weighed(self, s: str, spans: list[tuple[int, int]]) -> tuple[list[int], float]:
        """Ids and summed scores of pieces; a character without a piece of its own is encoded by its bytes."""
        ids, weight = [], 0.0
        for i, j in spans:
            own = s[i:j]
            ids += [self.ids[own]] if own in self.ids else self.sp.encode(own)
            weight += self.scores.get(own, self.unknown)
        return ids, weight

    def chunk_table(self, s: str, lead: int, size: int, first: bool, last: bool) -> tuple[list, list, list, list]:
        """Matrix and pieces of a chunk; the chunk is s[lead:lead+size], the rest its surroundings.

        Entries of the matrix are (in start, in end, out start, out end, weight), states relative to the chunk's two
        cuts. Pieces are parts (state..., first place, end place, ids): heads by incoming state, tails by outgoing
        state, with the words between as one part without a state; or, where pieces may cross every place, whole paths
        by both states.
        """
        a, b = lead, lead + size
        ins = [START] if first else self.states(s, a)
        cuts = [i for i in range(a + self.longest, min(b, a + 20 * self.longest)) if self.forced(s, i)][:1]
        tails = [i for i in range(b - self.longest, max(a, b - 20 * self.longest), -1) if self.forced(s, i)][:1]

        def traced(back, begin, end):
            spans = []
            while end > begin:
                spans.append((back[end], end))
                end = back[end]
            return spans[::-1]

        def onward(begin, before):
            """(state, pieces) of all paths from begin over the chunk's end."""
            back, out = self.paths(s, begin, before, b, b if last else min(len(s), b + self.longest - 1))
            if last:
                return [(END, traced(back, begin, b))] if b in back else []
            return [((i - b, j - b), [*traced(back, begin, i), (i, j)]) for i, j in out]

        if cuts and tails and cuts[0] <= tails[0]:
            heads, ends = [], []
            for i in ins:
                begin = a + i[1]
                back = self.paths(s, begin, s[a + i[0] : begin], cuts[0], cuts[0])[0]
                if cuts[0] in back:
                    heads.append((i, begin, *self.weighed(s, traced(back, begin, cuts[0]))))
            for o, spans in onward(tails[0], ""):
                ends.append((o, spans[-1][1] if spans else b, *self.weighed(s, spans)))
            between = self.encode(s[cuts[0] : tails[0]]) if cuts[0] < tails[0] else np.zeros(0, dtype=np.int32)
            inner = float(self.weights[between].sum())
            found = [(*i, *o, w + inner + v) for i, _, _, w in heads for o, _, _, v in ends]
            return found, [(*i, begin, cuts[0], ids) for i, begin, ids, _ in heads], [(cuts[0], tails[0], between)], [(*o, tails[0], end, ids) for o, end, ids, _ in ends]
        found, whole = [], []
        for i in ins:
            begin, before = a + i[1], s[a + i[0] : a + i[1]]
            if begin >= b:  # one piece covers the whole chunk, and an earlier chunk has it
                outs = [(END, [])] if last and begin == b else [((a + i[0] - b, begin - b), [])] if not last else []
            else:
                outs = onward(begin, before)
            for o, spans in outs:
                ids, w = self.weighed(s, spans)
                found.append((*i, *o, w))
                whole.append((*i, *o, begin, spans[-1][1] if spans else begin, ids))
        return found, [], whole, []

    def matrix(self, s: str, lead: int, size: int, first: bool, last: bool) -> list[tuple[int, int, int, int, float]]:
        return self.chunk_table(s, lead, size, first, last)[0]


def compose(x, y):
    """Max-plus product of two transfer matrices given by their finite entries."""
    right: dict[tuple, list] = {}
    for a, b, c, d, w in y:
        right.setdefault((a, b), []).append((c, d, w))
    best: dict[tuple, float] = {}
    for a, b, c, d, w in x:
        for e, f, v in right.get((c, d), ()):
            best[a, b, e, f] = max(best.get((a, b, e, f), -np.inf), w + v)
    return sorted((*k, w) for k, w in best.items())


def resolve(matrices: list, into: tuple, out: tuple) -> list[tuple]:
    """States at all cuts of a run of chunks whose first and last states are given: the path of greatest weight."""
    alive = [{into: 0.0}]
    for m in matrices:
        now: dict[tuple, float] = {}
        for a, b, c, d, w in m:
            if (a, b) in alive[-1]:
                now[c, d] = max(now.get((c, d), -np.inf), alive[-1][a, b] + w)
        alive.append(now)
    if out not in alive[-1]:
        raise ValueError(f"no path of finite weight leads from state {into} to {out}: the chunks do not fit the model")
    state, states = out, [out]
    for m, before in zip(reversed(matrices), reversed(alive[:-1])):
        state = max(((before[a, b] + w, (a, b)) for a, b, c, d, w in m if (c, d) == state and (a, b) in before))[1]
        states.append(state)
    return states[::-1]


def slices(batches, rows: int = 256):
    """Batches in pieces of few rows, so that no more than those are held as Python objects at once."""
    for pdf in batches:
        for at in range(0, max(1, len(pdf)), rows):
            yield pdf.iloc[at : at + rows]


def as_tuples(m) -> list[tuple]:
    return [(*(int(v) for v in e[:4]), float(e[4])) for e in m]


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT_CHARS, chunk: int = CHUNK_CHARS, group: int = GROUP_CHUNKS) -> DataFrame:
    """(id_col, part, ids array<int>, n_chars, exact): ids of every whole text; exact: they decode to its very characters.

    Texts of at most `giant` characters have one part 0; longer ones one for each chunk of `chunk` characters, whose
    ids concatenated in order are the ids of the whole. A null or empty text gives one part without ids. Ids of rows
    need not be distinct: rows with one id and text are encoded once and repeated. U+2581 in a text is encoded as a space,
    so only then is `exact` false. An empty table gives an empty result. Other columns, whatever their names, are ignored.
    """
    if chunk < 2 * Pieces(model).longest:
        raise ValueError("chunk is too short for the model's pieces")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))

    def whole(batches):
        p = Pieces(model)
        for pdf in slices(batches):
            ids, chars, exact = [], [], []
            for t in pdf["text"]:
                own = p.encode(p.normal(t or ""))
                text = p.decode(own)
                ids.append(own)
                chars.append(len(text))
                exact.append(text == (t or ""))
            yield pd.DataFrame({"id": pdf["id"], "part": 0, "ids": ids, "n_chars": chars, "exact": exact})

    out = f"id {kind}, part long, ids array<int>, n_chars long, exact boolean"
    plain = rows.where(size <= giant).mapInPandas(whole, out)

    def pieces(batches):
        p = Pieces(model)
        for pdf in batches:
            for one, (key, t) in enumerate(zip(pdf["id"], pdf["text"])):
                s, n = p.normal(t), len(p.normal(t))
                cuts = [*range(0, n - chunk // 2, chunk), n]
                for at in range(0, len(cuts) - 1, 64):
                    spans = list(zip(cuts, cuts[1:]))[at : at + 64]
                    lead = [min(a, 2 * p.longest) for a, _ in spans]
                    yield pd.DataFrame({"id": key, "row": pdf["row"].iloc[one], "k": range(at, at + len(spans)), "lead": lead, "size": [b - a for a, b in spans], "last": [b == n for _, b in spans], "odd": [MARK in t[max(0, a - len(p.prefix)) : b - len(p.prefix)] for a, b in spans], "s": [s[a - x : b + 2 * p.longest] for x, (a, b) in zip(lead, spans)]})

    giants = rows.where(size > giant).withColumn("row", F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "text")))
    # Copies of a document under one id are told apart by nothing but their count; they are encoded once and repeated.
    giants = giants.groupBy("id", "row").agg(F.first("text").alias("text"), F.count("*").alias("times")).select("id", "row", "text", "times")
    giants = cut(giants)
    times = giants.select("row", "times")
    parts = giants.select("id", "row", "text").mapInPandas(pieces, f"id {kind}, row string, k long, lead int, size int, last boolean, odd boolean, s string")
    parts = cut(parts.repartition("row", "k"))
    entry = "array<array<double>>"
    part = "array<struct<state:array<int>,ids:array<int>,n_chars:int,exact:boolean>>"

    def transfer(batches):
        p = Pieces(model)

        def told(s, parts, k):
            out = []
            for *state, at, end, ids in parts:
                ids = np.asarray(ids, dtype=np.int32)
                text, raw = p.decode(ids, k == 0 and at == 0), s[at:end].replace(MARK, " ")
                out.append((state, ids, len(text), text == (raw[len(p.prefix) :] if k == 0 and at == 0 else raw)))
            return out

        for pdf in slices(batches, 64):
            made = [p.chunk_table(s, lead, n, k == 0, last) for s, lead, n, k, last in zip(pdf["s"], pdf["lead"], pdf["size"], pdf["k"], pdf["last"])]
            yield pd.DataFrame({
                "id": pdf["id"], "row": pdf["row"], "k": pdf["k"], "odd": pdf["odd"], "m": [[list(e) for e in t[0]] for t in made],
                "heads": [told(s, t[1], k) for s, k, t in zip(pdf["s"], pdf["k"], made)],
                "between": [told(s, t[2], k) for s, k, t in zip(pdf["s"], pdf["k"], made)],
                "tails": [told(s, t[3], k) for s, k, t in zip(pdf["s"], pdf["k"], made)],
            })

    tables = parts.mapInPandas(transfer, f"id {kind}, row string, k long, odd boolean, m {entry}, heads {part}, between {part}, tails {part}")
    tables = cut(tables.withColumn("g", F.floor(F.col("k") / group).cast("long")))
    matrices = tables.select("row", "k", "g", "m")

    def product(pdf):
        pdf = pdf.sort_values("k")
        total = as_tuples(pdf["m"].iloc[0])
        for m in pdf["m"].iloc[1:]:
            total = compose(total, as_tuples(m))
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "g": pdf["g"].iloc[:1], "m": [[list(e) for e in total]]})

    grouped = matrices.groupBy("row", "g").applyInPandas(product, f"row string, g long, m {entry}")

    def bounds(pdf):
        pdf = pdf.sort_values("g")
        states = resolve([as_tuples(m) for m in pdf["m"]], START, END)
        return pd.DataFrame({"row": pdf["row"], "g": pdf["g"], "into": [list(s) for s in states[:-1]], "out": [list(s) for s in states[1:]]})

    tops = cut(grouped.groupBy("row").applyInPandas(bounds, "row string, g long, into array<int>, out array<int>"))

    def inner(pdf):
        pdf = pdf.sort_values("k")
        states = resolve([as_tuples(m) for m in pdf["m"]], tuple(int(v) for v in pdf["into"].iloc[0]), tuple(int(v) for v in pdf["out"].iloc[0]))
        return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "into": [list(s) for s in states[:-1]], "out": [list(s) for s in states[1:]]})

    solved = matrices.join(tops, ["row", "g"]).groupBy("row", "g").applyInPandas(inner, "row string, k long, into array<int>, out array<int>")

    # Backtrace: of its own table every chunk takes the parts that belong to its two states.
    head = F.filter("heads", lambda x: x["state"] == F.col("into"))
    tail = F.filter("tails", lambda x: x["state"] == F.col("out"))
    middle = F.filter("between", lambda x: (F.size(x["state"]) == 0) | (x["state"] == F.concat("into", "out")))
    mine = F.concat(head, middle, tail)
    done = tables.join(solved, ["row", "k"]).withColumn("mine", mine)
    chars = F.aggregate("mine", F.lit(0).cast("long"), lambda n, x: n + x["n_chars"])
    done = done.select("id", "row", F.col("k").alias("part"), F.flatten(F.transform("mine", lambda x: x["ids"])).alias("ids"), chars.alias("n_chars"), (~F.col("odd") & F.forall("mine", lambda x: x["exact"])).alias("exact"))
    done = done.join(times, "row")
    done = done.select("id", "part", "ids", "n_chars", "exact", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_")).drop("_")
    return plain.unionByName(done).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id") -> DataFrame:
    """(id_col, part, text) from (id_col, part, ids), row by row: the exact inverse of encode.

    Null ids give the empty text, repeated rows repeated texts, an empty table an empty result; ids that are no ids of the
    model fail. Bytes that are no UTF-8 become U+FFFD. Other columns, whatever their names, are ignored.
    """
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        p = Pieces(model)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "part": pdf["part"], "text": [p.decode(i if i is not None else [], k == 0) for i, k in zip(pdf["ids"], pdf["part"])]})

    return encoded.select(F.col(id_col).alias("id"), "part", "ids").mapInPandas(run, f"id {kind}, part long, text string").withColumnRenamed("id", id_col)
