"""Fill-in-the-middle rearrangement by a learned rank index of unit boundaries.

A text of n units (runs of Latin letters, or single other characters) has n + 1 boundaries. Cuts are drawn as ranks
among them and must be turned into code point offsets. The index of a text is piecewise linear: every segment predicts
the offset of a rank by a line that errs by at most `error` code points on all boundaries it covers, and one small
residual is stored for every boundary, so that prediction plus residual is the exact offset.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = 64
FIRST_REACH = 256
ROWS_AT_ONCE = 512
MARKS = ("<P>", "<S>", "<M>")


def boundaries(text: str) -> np.ndarray:
    """Code point offsets of all unit boundaries of a text, its end included."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = c | np.uint32(32)
    letter = (low >= 97) & (low <= 122)
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[:1] = False
    return np.append(np.flatnonzero(~inside), len(c)) if len(c) else np.zeros(1, dtype=np.int64)


class RankIndex:
    """Piecewise-linear map from ranks to offsets: segments (first rank, offset there, slope) and a residual a rank."""

    __slots__ = ("first", "base", "slope", "residual")

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        first, base, slope, n, s = [], [], [], len(offsets), 0
        while s < n:
            end, low, high, reach = s + 1, -np.inf, np.inf, FIRST_REACH
            while end < n:
                stop = min(n, end + reach)
                steps, rise = np.arange(end - s, stop - s), offsets[end:stop] - offsets[s]
                lows = np.maximum(np.maximum.accumulate((rise - error) / steps), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / steps), high)
                fits = lows <= highs
                k = len(fits) if fits.all() else int(np.argmin(fits))
                if k:
                    low, high = lows[k - 1], highs[k - 1]
                end += k
                if k < len(fits):
                    break
                reach *= 2
            first.append(s)
            base.append(offsets[s])
            slope.append((low + high) / 2 if end > s + 1 else 0.0)
            s = end
        self.first, self.base, self.slope = np.array(first), np.array(base), np.array(slope)
        away = offsets - self.predicted(np.arange(n))
        self.residual = away.astype(np.int8 if not n or np.abs(away).max() < 128 else np.int32)

    def predicted(self, ranks):
        at = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[at] + np.rint(self.slope[at] * (ranks - self.first[at])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets of ranks: what their segments predict, corrected by the stored residuals."""
        return self.predicted(ranks) + self.residual[ranks]


def drawn(key, n: int, seed: str) -> tuple[int, int, int, int]:
    """Ranks of both cuts among the n + 1 boundaries, and the two numbers from 0 to 99 that decide on the form."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return min(a, b), max(a, b), h[2] % 100, h[3] % 100


def rearranged(key, text: str, plain: int = 90, spm: int = 20, seed: str = "1") -> tuple:
    """(n, form, prefix characters, middle characters, output) of one text; no character counts where it stays plain."""
    offsets = boundaries(text)
    n = len(offsets) - 1
    a, b, whether, which = drawn(key, n, seed)
    if not text or whether >= plain or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    x, y = (int(v) for v in RankIndex(offsets).offsets(np.array([a, b])))
    head, middle, tail = text[:x], text[x:y], text[y:]
    if which < spm:
        return n, "spm", x, y - x, f"<S>{tail}<P>{head}<M>{middle}"
    return n, "psm", x, y - x, f"<P>{head}<S>{tail}<M>{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain: int = 90, spm: int = 20, seed: str = "1") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) of every row's whole text.

    Texts without units, with one of the marks, or with a draw of `plain` or more stay plain; of the others those with a
    draw under `spm` begin with the suffix. Draws depend on seed and id only, so repeated rows come out alike, and every
    row counts for itself. A null text is the empty text, a null id draws as the empty id. Equal cuts give an empty
    middle. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                made = [rearranged(k, t or "", plain, spm, seed) for k, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist())]
                columns = [pa.array([m[i] for m in made], f.type) for i, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", *fields.names])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of this form was made from: in no part of it a mark can stand."""
    part = F.split(F.col(output), "<[PSM]>", -1)
    at = lambda *k: F.concat(*[F.get(part, i) for i in k])
    return F.when(F.col(form) == "psm", at(1, 3, 2)).when(F.col(form) == "spm", at(2, 3, 1)).otherwise(F.col(output))


# The same rows by lists of units.
OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS b,
  ('0x' || substr(h, 17, 8))::BIGINT % 100 AS whether, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS which FROM d),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR whether >= 90 THEN 'plain' WHEN which < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(units[greatest(a, b) + 1:], '') AS s FROM k),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END AS output FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o"""
