"""Vector columns: which rows take part, and matrices from array columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: str) -> Column:
    """True for arrays that are not null or empty, hold only finite numbers and are not all zero."""
    ok = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok & F.exists(col, lambda x: x != 0), F.lit(False))


def matrix(series) -> np.ndarray:
    """Rows of an array column as doubles; all arrays have one length."""
    return np.array(series.tolist(), dtype=np.float64) if len(series) else np.zeros((0, 0))


def n_blocks(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))
