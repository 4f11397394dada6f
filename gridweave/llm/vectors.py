"""What the operators on vectors share: which rows are kept, and their components as integers in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components beyond this are no integers that sums of squares could follow; their rows count as not finite.
REACH = float(1 << 60)


def usable(vector: Column, scale: float) -> Column:
    """Whether a vector has entries and all are finite numbers within REACH after scaling."""
    entry = lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double") * F.lit(scale)) < F.lit(REACH)), F.lit(False))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, entry), F.lit(False))


def kept(rows: DataFrame, vector: str, scale: float) -> tuple[DataFrame, int]:
    """The usable rows of the commonest length (of equally common ones the longer), and that length; 0 if there are none."""
    rows = rows.where(usable(F.col(vector), scale))
    found = rows.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = found["width"] if found else 0
    return rows.where(F.size(vector) == width), width


def integers(column: pa.ListArray, width: int, scale: float, plus: int = 0) -> np.ndarray:
    """floor(scale * component) + plus, a row per vector of `width` components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), width) + plus


def exact(x: np.ndarray, below: int) -> np.ndarray:
    """x itself if all entries are within `below`, else as Python integers, which don't overflow."""
    return x if not x.size or max(abs(int(x.max())), abs(int(x.min()))) < below else x.astype(object)


def longs(values: np.ndarray) -> pa.Array:
    """As 64-bit integers; null where one doesn't fit."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if abs(int(v)) < 1 << 63 else None for v in values], pa.int64())
