"""Perceptual hashes: 256 bits as four numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def limbs(hash_: Column) -> Column:
    """A 32-byte big-endian hash as four BIGINTs, the first bits first; NULL for other lengths."""
    parts = F.array(*[F.conv(F.hex(F.substring(hash_, 8 * i + 1, F.lit(8))), 16, -10).cast("bigint") for i in range(4)])
    return F.when(F.octet_length(hash_) == 32, parts)


def from_limbs(parts: Column) -> Column:
    """The 32 bytes of four BIGINTs."""
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def hamming(a: Column, b: Column) -> Column:
    """In how many bits two arrays of numbers differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def median_bits(values: Column) -> Column:
    """Which of an odd number of values lie above their median, as 0 and 1."""
    middle = F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)
    return F.transform(values, lambda x: F.when(x > middle, 1).otherwise(0))


def bits_to_number(bits: Column) -> Column:
    """Up to 63 bits, the first the highest, as a BIGINT."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: s * 2 + x.cast("bigint"))


def hash_matrix(n: int = 16) -> np.ndarray:
    """The transform behind the hash in closed form: 2 cos(pi k (2m + 1) / 2n), each row k times 2 cos^2(pi k / 2n)."""
    k, m = np.arange(n)[:, None], np.arange(n)[None, :]
    return 2 * np.cos(np.pi * k / (2 * n)) ** 2 * 2 * np.cos(np.pi * k * (2 * m + 1) / (2 * n))


def hash_of_grays(grays: np.ndarray) -> bytes:
    """The hash of a 16 x 16 gray image: 255 bits after the constant term, each set if its coefficient is over the median."""
    a = hash_matrix(16)
    rest = (a @ grays.astype("float64") @ a.T).ravel()[1:]
    number = int("".join("1" if b else "0" for b in rest > np.median(rest)), 2)
    return number.to_bytes(32, "big")


def image_hash(grays: Column) -> Column:
    """``hash_of_grays`` of arrays of 256 gray values, row by row; NULL for other lengths."""

    @F.pandas_udf("binary")
    def of(rows):
        return rows.map(lambda g: hash_of_grays(np.asarray(g).reshape(16, 16)) if g is not None and len(g) == 256 else None)

    return of(grays)


def resampling(old: int, new: int, lobes: int = 3) -> np.ndarray:
    """The (new, old) weights that bring ``old`` values to ``new`` ones by a windowed sinc, widened when there are fewer."""
    ratio = old / new
    wide = max(ratio, 1.0)
    away = (np.arange(old)[None, :] + 0.5 - (np.arange(new)[:, None] + 0.5) * ratio) / wide
    weights = np.where(np.abs(away) < lobes, np.sinc(away) * np.sinc(away / lobes), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def grays_of_picture(rgb: np.ndarray, side: int = 16) -> np.ndarray:
    """The gray values of a picture brought to ``side`` x ``side``; each of the steps gives whole numbers up to 255."""
    whole = lambda x: np.clip(np.rint(x), 0, 255)
    gray = (rgb.astype("int64") @ np.array([19595, 38470, 7471]) + 32768) >> 16
    across = whole(gray @ resampling(gray.shape[1], side).T)
    return whole(resampling(gray.shape[0], side) @ across)


def picture_hash(pixels: Column, width: Column, height: Column) -> Column:
    """The hash of pictures given as bytes of RGB rows; NULL where the bytes don't fit the size."""

    @F.pandas_udf("binary")
    def of(raw, w, h):
        import pandas as pd

        fits = lambda d, x, y: d is not None and x > 0 and y > 0 and len(d) == int(x) * int(y) * 3
        made = lambda d, x, y: hash_of_grays(grays_of_picture(np.frombuffer(d, "uint8").reshape(int(y), int(x), 3)))
        return pd.Series([made(d, x, y) if fits(d, x, y) else None for d, x, y in zip(raw, w, h)], dtype=object)

    return of(pixels, width, height)
