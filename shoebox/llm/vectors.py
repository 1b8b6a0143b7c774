"""Batches of vectors as matrices, and exact comparison of listed pairs."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): which lists are vectors, and those scaled to length one.

    A vector has ``dims`` elements, all of them finite and not all zero.
    """
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == dims)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    matrix = np.asarray(flat, dtype="float64").reshape(-1, dims)
    with np.errstate(all="ignore"):
        largest = np.abs(matrix).max(axis=1, initial=0)
        fine = np.isfinite(largest) & (largest > 0)
        matrix = matrix[fine] / largest[fine, None]
        matrix /= np.sqrt((matrix * matrix).sum(axis=1))[:, None]
    return rows[fine], matrix.astype("float32")


def slices(batches, rows: int = 2048):
    """Batches in pieces, so that matrices made of them stay small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


@functools.lru_cache(maxsize=16)
def directions(dims: int, n: int, seed: int) -> np.ndarray:
    """``n`` random orthonormal points of the sphere, as columns; the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, n)))
    return (q * np.sign(np.diag(r))).astype("float32")


def packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype="int64") * width
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets.astype("int32").tobytes()), pa.py_buffer(data.tobytes())])
    return pa.array([r.tobytes() for r in data], pa.binary())


def unpacked(column, kind: str) -> np.ndarray:
    """A binary column of equal widths as a matrix."""
    values = list(column)
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1) if values else np.zeros((0, 1), kind)


#: Bits of the filter that decides which vectors are shuffled: 2 MB, or eight for each listed one up to 16 MB.
FILTER_BITS, MOST_FILTER_BITS, BLOCK_BITS = 2**24, 2**27, 32768


def only_listed(df: DataFrame, listed: DataFrame, *key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``listed``, and a few others: by a broadcast bitmap of bounded size."""
    size = min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (8 * listed.count()).bit_length()))
    hashed = F.pmod(F.xxhash64(*key), F.lit(size))
    bits = listed.select(hashed.alias("h")).groupBy((F.col("h") / BLOCK_BITS).cast("int").alias("block"))
    bits = bits.agg(F.bitmap_construct_agg(F.col("h") % BLOCK_BITS).alias("bits"))
    place = F.col("h") % BLOCK_BITS
    byte = F.conv(F.hex(F.substring(F.col("bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    kept = df.withColumn("h", hashed).withColumn("block", (F.col("h") / BLOCK_BITS).cast("int")).join(F.broadcast(bits), "block")
    return kept.where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("h", "block", "bits")


def cosine(a: str, b: str) -> Column:
    """The cosine of two binary columns of float32."""

    @F.pandas_udf("double")
    def of(x, y):
        import pandas as pd

        p, q = unpacked(x, "float32").astype("float64"), unpacked(y, "float32").astype("float64")
        return pd.Series((p * q).sum(axis=1))

    return of(F.col(a), F.col(b))


#: Sums are kept as whole numbers of steps of 1 / STEPS, four bytes each where that is enough; a first number says if not.
STEPS = 1 << 16


def _narrow(rows: np.ndarray) -> pa.Array:
    fits = np.abs(rows).max(axis=1, initial=0) < 2**31
    if fits.all():
        return packed(np.concatenate([np.zeros((len(rows), 1), "int32"), rows.astype("int32")], axis=1))
    heads = np.int32(0).tobytes(), np.int32(1).tobytes()
    return pa.array([heads[0] + r.astype("int32").tobytes() if f else heads[1] + r.tobytes() for r, f in zip(rows, fits)], pa.binary())


def _wide(column) -> np.ndarray:
    values = list(column)
    if not values:
        return np.zeros((0, 1), "int64")
    if len({len(v) for v in values}) == 1:
        raw = np.frombuffer(b"".join(values), "int32").reshape(len(values), -1)
        if not raw[:, 0].any():
            return raw[:, 1:].astype("int64")
    return np.stack([np.frombuffer(v, "int64" if v[0] else "int32", offset=4).astype("int64") for v in values])


def totals(column) -> np.ndarray:
    """The sums of ``sums_by`` as numbers."""
    return (_wide(column) / float(STEPS)).astype("float32")


def sums_by(df: DataFrame, key: str, size: str, vector: str, restore) -> DataFrame:
    """(key, n, sum): of each key the sum of ``size`` and of ``size`` times the vector, as bytes for ``totals``.

    Sums are taken in whole steps, so that they don't depend on their order. Each batch is summed before the shuffle, so that a key that a third of all rows have is moved as a few rows.
    """

    def reduced(keys: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, sizes, rows = keys[order], sizes[order], rows[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(sizes, first), np.add.reduceat(rows, first)

    def batch_of(keys: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sizes), _narrow(rows)], names=[key, "n", "sum"])

    def early(batches):
        for batch in batches:
            if batch.num_rows:
                sizes = batch.column(size).to_numpy(zero_copy_only=False).astype("int64")
                rows = np.rint(restore(batch.column(vector).to_pylist()).astype("float64") * sizes[:, None] * STEPS).astype("int64")
                yield batch_of(*reduced(batch.column(key).to_numpy(zero_copy_only=False), sizes, rows))

    def late(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in (key, "n"))
            rows = _wide(batch.column("sum").to_pylist())
            if kept is not None:
                keys, sizes, rows = np.append(kept[0], keys), np.append(kept[1], sizes), np.concatenate([kept[2], rows])
            keys, sizes, rows = reduced(keys, sizes, rows)
            if len(keys) > 1:
                yield batch_of(keys[:-1], sizes[:-1], rows[:-1])
            kept = keys[-1:], sizes[-1:], rows[-1:]
        if kept is not None:
            yield batch_of(*kept)

    out = f"{key} bigint, n bigint, sum binary"
    parts = df.select(key, size, vector).mapInArrow(early, out)
    return parts.repartition(key).sortWithinPartitions(key).mapInArrow(late, out)
