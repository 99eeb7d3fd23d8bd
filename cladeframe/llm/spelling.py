"""Spelling variants: words that differ by one inserted, deleted or replaced character, found in bit-sliced indexes.

An index holds, for every position and letter, the set of its words that have this letter there, as bits of 64-bit
numbers, so one operation treats 64 words. A query is read letter by letter while four sets of words are kept at once:
those equal so far, and those with one error so far, whose positions from there on are the query's own, one before or
one after it.

Words that differ by one error agree in all but one part of their letters. Words are dealt by the parts that must
agree: halves at first, and where more than GROUP words agree in one half, its other half is divided again, until no
group is large. Whatever the number of words, an index holds some thousand, and no pair is missed or found twice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
SLIP = 31
GROUP = 4096
QUERIES = 512
HELD_WORDS = 200_000
ROWS_AT_ONCE = 512
RUNS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")  # UTF-8 of A-Z, a-z and U+00C0 to U+00FF


def slipped(run: bytes, key: bytes) -> bytes:
    """The run without one character if the hash of id and run is divisible by SLIP, else the run itself."""
    h = zlib.crc32(run, zlib.crc32(key))
    if h % SLIP:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters of whole texts, lower-cased in A-Z only and some of them slipped, with their counts.

    Words are counted within texts and tasks before they are shuffled. Null and empty texts have none, repeated rows count
    as often as they stand, a null id hashes as the empty id. An empty table gives an empty result.
    """

    def run(batches):
        held: Counter[bytes] = Counter()

        def frame():
            out = pd.DataFrame({"word": pd.Series([w.decode() for w in held], dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})
            held.clear()
            return out

        for pdf in batches:
            for at in range(0, len(pdf), ROWS_AT_ONCE):
                part = pdf.iloc[at : at + ROWS_AT_ONCE]
                for key, text in zip(part["id"], part["text"]):
                    if not text:
                        continue
                    prefix = f"{key or ''}:".encode()
                    for word, n in Counter(RUNS.findall(text.encode("utf-8", "surrogatepass").lower())).items():
                        if len(word) >= least_length:  # no fewer bytes than characters
                            word = slipped(word, prefix)
                            if len(word) - word.count(b"\xc3") >= least_length:
                                held[word] += n
                    if len(held) >= HELD_WORDS:
                        yield frame()
        yield frame()

    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def dealt(words: DataFrame, parts: int) -> DataFrame:
    """words (word, n, shorter, part) with key: what a word shares with all that differ from it in its part only.

    shorter is the length of the shorter word of a pair, whose letters are divided in `parts`: those before the part count
    from the front, those after it from the end. Parts without a letter have no rows.
    """
    upto = lambda k: F.floor(F.col("shorter") * k / parts).cast("int")
    tail = F.col("shorter") - F.col("end")
    w = words.withColumn("first", upto(F.col("part"))).withColumn("end", upto(F.col("part") + 1)).where("first < end")
    shared = F.substring("word", F.lit(1), F.col("first")), F.substring("word", F.length("word") - tail + 1, tail)
    key = F.concat_ws("\n", F.concat_ws(":", "shorter", "first", "end"), *shared)
    return w.select("word", "n", "shorter", "part", "first", "end", key.alias("key"))


def groups(vocab: DataFrame, largest: int = GROUP) -> DataFrame:
    """(word, n, shorter, part, first, end, key): every word in its groups, of which none is larger than `largest` unless
    its words differ in a single letter, so that there are no more of them than letters."""
    w = vocab.withColumn("shorter", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    left, parts, out = dealt(w.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1)))), 2), 2, None
    while True:
        left = cut(left)
        sized = left.groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("end") - F.col("first")).alias("letters"))
        large = cut(sized.where((F.col("c") > largest) & (F.col("letters") > 1)).select("key"))
        if not large.limit(1).count():
            return left if out is None else out.unionByName(left)
        done = left.join(large, "key", "left_anti").select(*left.columns)
        out = done if out is None else out.unionByName(done)
        again = left.join(large, "key", "left_semi").select("word", "n", "shorter", F.explode(F.array(F.col("part") * 2, F.col("part") * 2 + 1)).alias("part"))
        parts *= 2
        left = dealt(again, parts)


class Index:
    """Bit sets of words by position and letter, and by length. Only letters that stand at a position have a set there."""

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words])
        longest = int(self.length.max())
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(words)), self.length)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.codes = np.full((len(words), longest + 2), -1, dtype=np.int64)  # beyond its end a word has no letter
        self.codes[row, place] = flat
        sets, own = np.unique(place << 32 | flat, return_inverse=True)
        self.size = -(-len(words) // 64)
        self.bits, self.sets = np.zeros((len(sets) + 1, self.size), dtype=np.uint64), sets  # the last is empty
        np.bitwise_or.at(self.bits, (own, row >> 6), np.uint64(1) << (row & 63).astype(np.uint64))
        at = np.arange(len(words))
        self.sized = np.zeros((longest + 3, self.size), dtype=np.uint64)
        np.bitwise_or.at(self.sized, (self.length, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))

    def having(self, place: int, letters: np.ndarray) -> np.ndarray:
        """For each of letters the set of words that have it at this place."""
        want = np.int64(place) << 32 | letters
        k = np.minimum(np.searchsorted(self.sets, want), len(self.sets) - 1)
        return self.bits[np.where(self.sets[k] == want, k, len(self.sets))]

    def near(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word), both as numbers of words: all words exactly one error away from the queries `own`.

        exact: equal so far; level, behind, ahead: one error so far, and the word goes on at the query's position
        (a letter replaced), one before it (the query has one more) or one after it (the word has one more).
        """
        out_q, out_w = [], []
        for m in np.unique(self.length[own]):  # queries of one length go together
            q = own[self.length[own] == m]
            code, none = self.codes[q], np.uint64(0)
            exact = np.full((len(q), self.size), ~none)
            level, behind, ahead = np.zeros_like(exact), np.zeros_like(exact), np.zeros_like(exact)
            for i in range(m):
                c = code[:, i]
                here, after = self.having(i, c), self.having(i + 1, c)
                level = (level & here) | (exact & ~here)
                behind = ((behind & self.having(i - 1, c)) | exact) if i else exact.copy()
                ahead = (ahead | exact) & after
                exact = exact & here
            found = (level & self.sized[m]) | (behind & self.sized[m - 1]) | ((ahead | exact) & self.sized[m + 1])
            i, k = np.nonzero(found)
            bit = np.unpackbits(found[i, k].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, b = np.nonzero(bit)
            out_q.append(q[i[r]])
            out_w.append(k[r] * 64 + b)
        return np.concatenate(out_q), np.concatenate(out_w)


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows of codes."""
    return np.argmin(np.hstack([a == b, np.zeros((len(a), 1), dtype=bool)]), axis=1)


def searched(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, c, form, form_n) from groups (word, n, first, end, key) of one `shorter`: for words with near ones in a group
    of theirs how many there are, and the best. A pair counts in one group only: that in whose part stands the first
    letter that differs."""
    short = int(rows["shorter"].iloc[0])
    words = sorted(set(rows["word"]))
    at = rows["word"].map({w: i for i, w in enumerate(words)}).to_numpy()
    n = np.zeros(len(words), dtype=np.int64)
    n[at] = rows["n"].to_numpy()
    by_word = np.argsort(at, kind="stable")
    first, end = rows["first"].to_numpy()[by_word], rows["end"].to_numpy()[by_word]
    starts = np.searchsorted(at[by_word], np.arange(len(words) + 1))
    index = Index(words)
    count, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), -1)
    for s in range(0, len(words), QUERIES):
        q, w = index.near(np.arange(s, min(s + QUERIES, len(words))))
        fits = np.minimum(index.length[q], index.length[w]) == short
        q, w = q[fits], w[fits]
        place = np.minimum(agree(index.codes[q], index.codes[w]), short - 1)
        each = starts[q + 1] - starts[q]
        pair = np.repeat(np.arange(len(q)), each)
        row = np.repeat(starts[q] - np.cumsum(each) + each, each) + np.arange(len(pair))
        pair = pair[(first[row] <= place[pair]) & (place[pair] < end[row])]
        q, w = q[pair], w[pair]
        order = np.lexsort((w, -n[w], q))
        q, w = q[order], w[order]
        lead = np.append(True, q[1:] != q[:-1])[: len(q)]
        np.add.at(count, q, 1)
        best[q[lead]] = w[lead]
    own = np.flatnonzero(count)
    text = lambda at: pd.Series([words[i] for i in at], dtype=object)
    return pd.DataFrame({"word": text(own), "c": count[own], "form": text(best[own]), "form_n": n[best[own]]})


def neighbours(vocab: DataFrame, largest: int = GROUP) -> DataFrame:
    """(word, n_near, form, form_n): the number of words one error away, and the one of them with the largest n (ties:
    smallest in code-point order); words without any give no row.

    vocab: (word, n) with distinct words; a null word is left out, a null n counts as 0.
    """
    rows = cut(groups(vocab.where("word is not null").select("word", F.coalesce("n", F.lit(0)).cast("long").alias("n")), largest))
    packs = max(int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // largest))

    def run(pdf):
        return pd.concat([searched(part) for _, part in pdf.groupby("shorter")])

    found = rows.withColumn("pack", F.pmod(F.xxhash64("key"), F.lit(packs))).groupBy("pack").applyInPandas(run, "word string, c long, form string, form_n long")
    top = F.min_by(F.struct("form", "form_n"), F.struct((-F.col("form_n")).alias("s"), "form")).alias("b")
    return found.groupBy("word").agg(F.sum("c").alias("n_near"), top).select("word", "n_near", "b.form", "b.form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the chain of forms from every word (word, form) of the table.

    Counts grow tenfold from word to form, so chains are short and have no cycles; every round doubles the steps made.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.toDF("root", "next")
        step = cut(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return at


def variants(vocab: DataFrame, factor: int = FACTOR, largest: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of vocab (word, n).

    A word's form is its near word of largest n, if that is at least `factor` times its own, else null; root is the word
    at the end of the chain of forms, the word itself if it has no form. An empty vocabulary gives an empty result.
    """
    vocab = cut(vocab)
    near = cut(neighbours(vocab, largest))
    all_ = vocab.select("word", "n").join(near, "word", "left")
    much = F.col("form_n") >= factor * F.col("n")
    all_ = cut(all_.select("word", F.when(much, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(much, F.col("form_n")).alias("form_n")))
    last = roots(all_.where("form is not null"))
    return all_.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
