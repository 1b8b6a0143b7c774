"""Vectors as array columns; sums are taken in DOUBLE."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product; NULL if either is NULL or holds NULL, or if their lengths differ."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, divisor: Column) -> Column:
    """a / divisor. The divisor is bound by an outer lambda: inside the inner one it would be computed for each element."""
    return F.element_at(F.transform(F.array(divisor), lambda d: F.transform(a, lambda x: x.cast("double") / d)), 1)


def unit_padded(a: Column, eps: float = 1e-8) -> Column:
    """a / (|a| + eps), as an index stores it: a zero vector stays zero."""
    return scaled(a, norm(a) + eps)


def unit_floored(a: Column, floor: float = 1e-9) -> Column:
    """a / |a|, dividing by ``floor`` where the length is zero."""
    return scaled(a, F.when(norm(a) == 0, F.lit(floor)).otherwise(norm(a)))


def unit_if_long(a: Column, least: float = 1e-6) -> Column:
    """a / |a| where the length is over ``least``, else ``a`` itself."""
    return F.when(norm(a) > least, scaled(a, norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; NULL for zero vectors."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - the inner product of unit vectors, which is kept between -1 and 1."""
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def is_zero(a: Column) -> Column:
    return ~F.exists(a, lambda x: x != 0)


def is_vector(a: Column, dims: int | None = None) -> Column:
    """Whether ``a`` has no NULL, NaN or infinite elements and isn't all zero."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = a.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(~is_zero(a), F.lit(False))
    return fine if dims is None else fine & (F.size(a) == dims)


def inner_with(a: Column, vector: list[float], eps: float | None = None) -> Column:
    """The inner product with one vector, by Arrow batches; with ``eps``, divided by |a| + eps.

    NULL where ``a`` is NULL, has another length or holds NULL.
    """
    target = np.asarray(vector, "float64")

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(length == len(target))
        flat = column.take(pa.array(rows)).flatten()
        holes = np.asarray(flat.is_null()).reshape(len(rows), len(target)).any(axis=1) if flat.null_count else np.zeros(len(rows), bool)
        matrix = np.asarray(flat.to_numpy(zero_copy_only=False), "float64").reshape(len(rows), len(target))
        value = matrix @ target
        if eps is not None:
            value /= np.sqrt((matrix * matrix).sum(axis=1)) + eps
        out, gone = np.zeros(len(column)), np.ones(len(column), bool)
        out[rows], gone[rows] = value, holes
        return pa.array(out, pa.float64(), mask=gone)

    return of(a)
