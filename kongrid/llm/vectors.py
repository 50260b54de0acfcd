"""Vector columns for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column | str) -> Column:
    """True for a vector that is neither null nor empty and has no null, NaN or infinite component; never null."""
    v = F.col(vector) if isinstance(vector, str) else vector
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & whole, F.lit(False))


def width_of(rows: DataFrame, id_col: str, vector: str) -> int:
    """Components of the row with the smallest id; 0 for an empty table. That width is the table's: other rows take no part."""
    first = rows.agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.size(vector).alias("width"))).alias("m")).first()["m"]
    return 0 if first is None else int(first["width"])


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of equal, whole vectors as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as an Arrow list column."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))
