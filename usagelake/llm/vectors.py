"""Integer vectors: floors of scaled components, and exact sums of them over a whole table.

Shared by the operators that work on vectors in exact integer arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components that one vectorised step handles.
STEP = 1 << 19


def finite(vector: Column) -> Column:
    """Whether a vector is there and each of its components is a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def floored(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as array<int>.

    A component is held within +-sqrt(2**61 / length), so that every squared distance fits in a long.
    """
    most = F.floor(F.sqrt(F.lit(2.0**61) / F.greatest(F.size(vector), F.lit(1)))).cast("double")
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, most), -most)).cast("int"))


def matrices(batch: pa.RecordBatch, name: str, length: int):
    """(first row, int64 matrix) of the rows of an array<int> column, all `length` long, some at a time."""
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    rows, some = batch.num_rows, max(1, STEP // max(length, 1))
    for first in range(0, rows, some):
        n = min(some, rows - first)
        yield first, flat[first * length : (first + n) * length].astype(np.int64).reshape(n, length)


def mean_floor(total: np.ndarray, count: int) -> np.ndarray:
    """floor(total / count), exactly."""
    return total // count


def as_long(total: Column) -> Column:
    """A decimal sum as a long; the largest long if it is beyond that."""
    return F.least(total, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")


def summed(column: str) -> Column:
    """The sum of longs, which never overflows: see as_long()."""
    return F.sum(F.col(column).cast("decimal(19,0)")).cast("decimal(38,0)")


def first_rows(rows: DataFrame, n: int, *order: Column) -> np.ndarray:
    """The vectors `v` of the first n rows, n being a parameter and small."""
    found = [r["v"] for r in rows.orderBy(*order, "v").limit(n).select("v").collect()]
    return np.array(found, np.int64)
