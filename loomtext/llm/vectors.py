"""What the operators on vectors share: which rows take part, and Arrow columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sound_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """((id long, v array<double>) of the rows whose vector takes part, their dimension).

    A vector that is null, empty, or holds a null, NaN or infinite entry takes no part. Of vectors of several lengths
    those of the most frequent length do (of equally frequent ones the longest); the dimension is 0 if there is none.
    Ids may be null or repeated; other columns are left behind.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(
        (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    )
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = lengths["d"] if lengths else 0
    return rows.filter(F.size("v") == dim), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists of ``dim`` doubles as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of lists."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))
