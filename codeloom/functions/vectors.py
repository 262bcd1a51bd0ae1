"""Vectors as arrays, with arithmetic in double precision, and their packed form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or one vector is zero."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / size)


@F.pandas_udf(BinaryType())
def to_bytes(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_bytes(packed: pd.Series) -> pd.Series:
    return packed.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))
