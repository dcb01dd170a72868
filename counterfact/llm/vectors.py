"""Vectors in Arrow batches: checks, matrices, and matrices as columns of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from counterfact.llm.batches import quoted


def vector_column(df: DataFrame, name: str) -> tuple[Column, type]:
    """The column as an array of floats or doubles, and the type of its components."""
    kind = df.schema[name].dataType
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType):
        return F.col(quoted(name)), np.float32
    return F.col(quoted(name)).cast(ArrayType(DoubleType())), np.float64


def finite_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components in one row, the bounds of each vector, and which vectors are whole.

    A vector is whole if it is not null and has neither null nor non-finite components.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bounds = np.zeros(len(vectors) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    broken = np.zeros(len(values) + 1, np.int64)
    np.cumsum(~np.isfinite(values), out=broken[1:])
    whole = vectors.is_valid().to_numpy(zero_copy_only=False) & (broken[bounds[1:]] == broken[bounds[:-1]])
    return values, bounds, whole


def same_length(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The given vectors as matrices: pairs (rows, matrix), one for each length of vector."""
    sizes = np.diff(bounds)[rows]
    out = []
    for size in np.unique(sizes):
        own = rows[sizes == size]
        out.append((own, values[bounds[own][:, None] + np.arange(size)]))
    return out


def bytes_column(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of bytes."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    bounds = np.arange(len(matrix) + 1, dtype=np.int64) * width
    whole = pa.Array.from_buffers(pa.large_binary(), len(matrix), [None, pa.py_buffer(bounds), pa.py_buffer(matrix.data)])
    return whole.cast(pa.binary())


def matrix_of(column: pa.Array, kind: type) -> np.ndarray:
    """The matrix of a column of bytes that have one length."""
    width = len(column[0].as_py()) // np.dtype(kind).itemsize if len(column) else 0
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; rows of zeros stay."""
    x = matrix.astype(np.float64)
    if not x.size:
        return x
    # A first division keeps the squares of very large and very small components in range.
    most = np.abs(x).max(axis=1, keepdims=True)
    x /= np.where(most > 0, most, 1.0)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x / np.where(length > 0, length, 1.0)
