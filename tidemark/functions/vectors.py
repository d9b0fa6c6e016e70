"""Vector arithmetic: Catalyst expressions for single pairs, Arrow batches for one-against-many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_GUARD = 1e-9


def as_matrix(values: pa.Array, dtype=np.float64) -> np.ndarray:
    """A non-null Arrow list column as a dense (rows, dim) matrix."""
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1).astype(dtype, copy=False) if len(values) else np.zeros((0, 0), dtype)


def as_lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel(), kind))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit length, with tiny norms guarded."""
    length = F.greatest(norm(a), F.lit(NORM_GUARD))
    return F.transform(a, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(NORM_GUARD))


def mean_vector(vec: Column) -> Column:
    """Aggregate: element-wise mean, combined on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(vec)))


def similarities(vec: Column, anchors: np.ndarray) -> Column:
    """``array<double>`` of dot products with each anchor row; the anchors travel with the function."""
    transposed = np.asarray(anchors, dtype=np.float64).T.copy()

    @F.arrow_udf("array<double>")
    def against(values: pa.Array) -> pa.Array:
        return as_lists(as_matrix(values) @ transposed, pa.float64())

    return against(vec)
