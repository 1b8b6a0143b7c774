"""Pairs of near perceptual hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.session import cut


def hash_limbs(column: str) -> list:
    """Columns h0-h3 of a 32-byte hash: its bits as four numbers."""
    return [F.conv(F.hex(F.substring(column, 8 * i + 1, 8)), 16, -10).cast("bigint").alias(f"h{i}") for i in range(4)]


def _runs(most_bits: int) -> list[tuple[int, int]]:
    cuts = [i * 64 // (most_bits + 1) for i in range(most_bits + 2)]
    return list(zip(cuts, cuts[1:]))


def _bands(column: str, most_bits: int) -> F.Column:
    """The 64 hex digits of a hash as most_bits + 1 runs, of which two hashes that near must share one."""
    digits = F.hex(column)
    return F.array(*[F.struct(F.lit(i).alias("band"), F.substring(digits, lo + 1, hi - lo).alias("key")) for i, (lo, hi) in enumerate(_runs(most_bits))])


def _links_of_blocks(most_bits: int):
    """Within a pair of blocks: of the links between near hashes the nearest that connect what all links connect."""

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["id"].to_numpy("int64")
        bits = frame[["h0", "h1", "h2", "h3"]].to_numpy("int64").view("uint64")
        near = []
        for i in range(len(ids) - 1):
            apart = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1)
            j = np.flatnonzero(apart <= most_bits)
            near.append(np.stack([apart[j].astype("int64"), np.full(len(j), i, "int64"), j + i + 1], axis=1))
        near = np.concatenate(near) if near else np.zeros((0, 3), "int64")
        root, out = np.arange(len(ids)), []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for d, i, j in near[np.argsort(near[:, 0], kind="stable")]:
            x, y = top(i), top(j)
            if x != y:
                root[y] = x
                out.append((ids[i], ids[j], d))
        return pd.DataFrame(out, columns=["a", "b", "bits"]).astype({"a": "int64", "b": "int64", "bits": "int32"})

    return links


def _pairs_of_blocks(most_bits: int):
    """Within a pair of blocks: all pairs of near hashes, one of either block, that share no run before this one."""
    ones = [((1 << 4 * (hi - lo)) - 1) << 4 * (64 - hi) for lo, hi in _runs(most_bits)]
    masks = np.array([[m >> 64 * (3 - i) & (2**64 - 1) for i in range(4)] for m in ones], "uint64")

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["own", "id"])
        ids, band = frame["id"].to_numpy("int64"), int(frame["band"].iloc[0])
        bits = frame[["h0", "h1", "h2", "h3"]].to_numpy("int64").view("uint64")
        across = frame["i"].iloc[0] != frame["j"].iloc[0]
        first = int((frame["own"] == frame["i"].iloc[0]).sum()) if across else len(ids)
        a, b, bits_apart = [], [], []
        for i in range(first):
            start = first if across else i + 1
            apart = bits[start:] ^ bits[i]
            n = np.bitwise_count(apart).sum(axis=1)
            j = np.flatnonzero(n <= most_bits)
            j = j[(apart[j, None, :] & masks[:band]).any(axis=2).all(axis=1)]
            a.append(np.full(len(j), ids[i], "int64"))
            b.append(ids[start + j])
            bits_apart.append(n[j])
        a, b, bits_apart = (np.concatenate(x) if x else np.zeros(0, "int64") for x in (a, b, bits_apart))
        return pd.DataFrame({"a": a, "b": b, "bits": bits_apart.astype("int32")})

    return pairs


def near_hash_pairs(hashes: DataFrame, most_bits: int = 10, small: int = 64, block: int = 1024, forest: bool = False) -> DataFrame:
    """(a, b, bits): all pairs of ids of distinct 32-byte hashes (id, hash) that differ in at most ``most_bits`` bits.

    Hashes that near share one of most_bits + 1 runs of digits (pigeonhole), on which they are joined. A run's bucket
    of up to ``small`` ids is joined at once; a larger one in pairs of blocks of about ``block`` ids, so that a bucket is
    never one task's. With ``forest`` a pair of blocks gives its nearest links only as far as they connect its ids, which
    is enough for components, and a large bucket never comes out as all its pairs.
    """
    if not 0 <= most_bits < 63:
        raise ValueError("most_bits must be from 0 to 62")
    narrow = hashes.select("id", F.explode(_bands("hash", most_bits)).alias("x"), *hash_limbs("hash")).select("id", "x.*", "h0", "h1", "h2", "h3")
    size = narrow.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    kept = cut(narrow.join(size, ["band", "key"]))
    few = kept.where(F.col("size") <= small).drop("size")
    l, r = few.alias("l"), few.alias("r")
    apart = sum((F.bit_count(F.col(f"l.h{i}").bitwiseXOR(F.col(f"r.h{i}"))) for i in range(4)), F.lit(0))
    same = (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.id") < F.col("r.id"))
    pairs = l.join(r, same & (apart <= most_bits)).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), apart.cast("int").alias("bits"))
    many = kept.where(F.col("size") > small).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    many = many.withColumn("own", own).withColumn("other", other)
    many = many.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    within = _links_of_blocks(most_bits) if forest else _pairs_of_blocks(most_bits)
    blocks = many.groupBy("band", "key", "i", "j").applyInPandas(within, "a bigint, b bigint, bits int")
    return pairs.unionByName(blocks.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits")).distinct()
