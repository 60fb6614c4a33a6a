"""Vector functions over ARRAY<FLOAT>, all built-in column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors that are empty, of other lengths, or all zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    alike = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(alike & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def l2_normalised(a: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats to an array; an incomplete last one is left out."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], dtype="<f4").tolist())


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """An array to little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())
