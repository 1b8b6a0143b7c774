"""References to records that do not exist.

Keys are range-partitioned; within a range the parents stand as one sorted array, which batches of references probe by
binary search. A range that holds more references than ``chunk`` is split by reference, each piece with its own copy of
the range's parents (at most ``per_range`` keys), so that a key that a third of all rows refer to is no task's alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.session import cut

MISSING, REMOVED, LATER = "missing", "removed", "later"
OUT = "ref_field string, ref_id bigint, t bigint, reason string"


def number_key(df: DataFrame, key: str) -> DataFrame:
    """Columns k and s of a BIGINT key."""
    return df.withColumns({"k": F.col(key).cast("bigint"), "s": F.lit(None).cast("string")})


def text_key(df: DataFrame, key: str) -> DataFrame:
    """Columns k and s of a text key: its hash gives the range and the order, the text itself decides."""
    return df.withColumns({"k": F.xxhash64(key), "s": F.col(key).cast("string")})


def _bounds(parents: DataFrame, per_range: int) -> dict[int, np.ndarray]:
    """By target, the first keys of all ranges but the lowest: one number for ``per_range`` parents."""
    counts = {r["target"]: r["n"] for r in parents.groupBy("target").agg(F.count("*").alias("n")).collect()}
    bounds = {}
    for target, n in counts.items():
        parts = n // per_range + 1
        shares = [i / parts for i in range(1, parts)]
        cuts = parents.where(F.col("target") == target).approxQuantile("k_real", shares, 0.2 / parts) if shares else []
        bounds[target] = np.unique(np.array(cuts, dtype="float64"))
    return bounds


def _ranged(df: DataFrame, bounds: dict[int, np.ndarray]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def place(target: pd.Series, key: pd.Series) -> pd.Series:
        out = np.zeros(len(key), dtype="int32")
        for t, cuts in shared.value.items():
            at = target.to_numpy() == t
            out[at] = np.searchsorted(cuts, key.to_numpy()[at], side="right")
        return pd.Series(out)

    if not any(len(cuts) for cuts in bounds.values()):
        return df.withColumn("range", F.lit(0))
    return df.withColumn("range", place("target", "k_real"))


def _probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by piece, parents before references, parents by key."""
    now, parts, ready = None, [], None
    for frame in frames:
        piece = list(zip(frame["target"], frame["range"], frame["chunk"]))
        cuts = [0, *[i for i in range(1, len(piece)) if piece[i] != piece[i - 1]], len(piece)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if piece[start] != now:
                now, parts, ready = piece[start], [], None
            rows = frame.iloc[start:end]
            first = int((rows["tag"].to_numpy() == 0).sum())
            if first:
                parts.append(rows.iloc[:first][["k", "s", "t"]])
                ready = None
            refs = rows.iloc[first:]
            if refs.empty:
                continue
            if ready is None:
                held = pd.concat(parts) if parts else rows.iloc[:0][["k", "s", "t"]]
                ready = held["k"].to_numpy("int64"), held["s"].to_numpy(object), held["t"].to_numpy("int64")
            keys, texts, times = ready
            k, s = refs["k"].to_numpy("int64"), refs["s"].to_numpy(object)
            at = np.searchsorted(keys, k, side="left")
            found, open_ = np.full(len(k), -1), np.arange(len(k))
            while len(open_):  # more than once only where hashes of texts collide
                open_ = open_[at[open_] < len(keys)]
                open_ = open_[keys[at[open_]] == k[open_]]
                asked = s[open_]
                same = pd.isna(asked) | (asked == texts[at[open_]]).astype(bool)
                found[open_[same]] = at[open_[same]]
                open_ = open_[~same]
                at[open_] += 1
            missing = found < 0
            when = np.where(missing, NEVER, times[found] if len(times) else NEVER)
            gone = when == GONE
            bad = missing | gone | (when > refs["t"].to_numpy("int64"))
            if bad.any():
                out = refs[bad]
                yield pd.DataFrame({
                    "ref_field": out["field"].to_numpy(),
                    "ref_id": out["ref_id"].to_numpy(),
                    "t": out["t"].to_numpy(),
                    "reason": np.select([missing[bad], gone[bad]], [MISSING, REMOVED], LATER).astype(object),
                })


#: Microseconds that stand for a time that isn't known: never before anything as a referrer, before all as a parent.
FOREVER, NEVER = 2**62, -(2**62)
#: Stands for the time of a parent that was taken out.
GONE = 2**61


def find_orphans(references: DataFrame, parents: DataFrame, removals: DataFrame | None = None, per_range: int = 32_768, chunk: int = 65_536) -> DataFrame:
    """References without a parent, or whose parent came later: (ref_field, ref_id, ref_time, reason).

    reason is ``missing``, ``removed`` where ``removals`` (target, k, s) has the key of a parent that isn't there any
    more, or ``later``. A task holds pieces of at most ``chunk`` references and about ``per_range`` parents.

    references: ref_field, target INT, k, s, ref_id, ref_time (TIMESTAMP_NTZ); parents: target INT, k, s, first_loaded;
    k and s by ``number_key`` or ``text_key``. Other columns are ignored. Rows with a NULL k, or with a text key whose s
    is NULL, refer to nothing and are no orphans. Of repeated parents the earliest counts; repeated references come out
    as often as they stand. A referrer without a time is an orphan only if its parent is missing; a parent without a
    time was always there. Empty tables give the expected result: no parents make every reference an orphan.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    real = F.col("k").cast("double").alias("k_real")
    parents = parents.select("target", "k", "s", F.coalesce(micros("first_loaded"), F.lit(NEVER)).alias("t"))
    if removals is not None:
        # a key that is there again is there: its time is the lesser
        parents = parents.unionByName(removals.select("target", "k", "s", F.lit(GONE).alias("t")))
    parents = parents.where(F.col("k").isNotNull()).groupBy("target", "k", "s").agg(F.min("t").alias("t")).select("target", "k", "s", "t", real)
    references = references.where(F.col("k").isNotNull()).select(
        F.col("ref_field").alias("field"), "target", "k", "s", "ref_id", F.coalesce(micros("ref_time"), F.lit(FOREVER)).alias("t"), real
    )
    parents = cut(parents)
    bounds = _bounds(parents, per_range)
    # written, as references are both counted and placed
    parents, references = _ranged(parents, bounds), cut(_ranged(references, bounds))
    # one row per range that needs more than one piece; ranges are as many as parents / per_range
    pieces = references.groupBy("target", "range").agg(F.ceil(F.count("*") / chunk).cast("int").alias("pieces")).where("pieces > 1")
    references = references.join(pieces, ["target", "range"], "left").withColumn(
        "chunk", F.pmod(F.xxhash64("ref_id", "field"), F.coalesce("pieces", F.lit(1))).cast("int")
    )
    parents = parents.join(pieces, ["target", "range"], "left").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))
    )
    columns = "target", "range", "chunk", "tag", "field", "ref_id", "k", "s", "t"
    none = lambda kind: F.lit(None).cast(kind)
    both = parents.withColumns({"tag": F.lit(0), "field": none("string"), "ref_id": none("bigint")}).select(*columns)
    both = both.unionByName(references.withColumn("tag", F.lit(1)).select(*columns))
    placed = both.repartition("target", "range", "chunk").sortWithinPartitions("target", "range", "chunk", "tag", "k")
    time = F.when(F.col("t") < FOREVER, F.timestamp_micros("t").cast("timestamp_ntz"))
    return placed.mapInPandas(_probe, OUT).select("ref_field", "ref_id", time.alias("ref_time"), "reason")


def orphans_by_period(orphans: DataFrame, references: DataFrame, period: str = "month") -> DataFrame:
    """(ref_field, period, refs, orphans, missing, removed, later) of each field and period in which references arrived."""
    when = lambda c: F.date_format(F.date_trunc(period, F.col(c)), "yyyy-MM-dd").alias("period")
    all_ = references.where(F.col("k").isNotNull()).groupBy("ref_field", when("ref_time")).agg(F.count("*").alias("refs"))
    bad = orphans.groupBy("ref_field", when("ref_time")).agg(
        F.count("*").alias("orphans"),
        F.count_if(F.col("reason") == MISSING).alias("missing"),
        F.count_if(F.col("reason") == REMOVED).alias("removed"),
        F.count_if(F.col("reason") == LATER).alias("later"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("orphans", "missing", "removed", "later")}
    a, b = all_.alias("a"), bad.alias("b")
    same = (F.col("a.ref_field") == F.col("b.ref_field")) & F.col("a.period").eqNullSafe(F.col("b.period"))
    return a.join(b, same, "left").select("a.ref_field", "a.period", "refs", *[zero[c].alias(c) for c in zero])
