"""What the operators on embeddings share: whole vectors, integer components, matrices of lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embeddings(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def whole(column: str = "embedding") -> Column:
    """Whether a vector is there, without null or non-finite components."""
    return F.expr(f"`{column}` is not null and forall(`{column}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def integers(column: str = "embedding") -> Column:
    """floor(256 * x) of each component; one of 2^31 or more is an error."""
    return F.expr(f"transform(`{column}`, x -> cast(floor(256 * cast(x as double)) as int))")


def matrix(column, width: int, dtype) -> np.ndarray:
    """An Arrow column of lists as the rows of a matrix; shorter lists end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype)
    out[np.arange(width)[None] < lengths[:, None]] = flat
    return out
