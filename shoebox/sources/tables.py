"""Parquet tables of a library, and the current row of each id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.session import cut

#: So many repeated keys are sent to all executors (some 64 MB).
SENT = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current(df: DataFrame, *columns: str, key: str = "id", version: str = "loaded_at") -> DataFrame:
    """One row per ``key``: ``columns`` of its latest version, and ``first_loaded``, its earliest version.

    Only ``columns`` are read and shuffled. A row without key names no record and is left out; a NULL version counts
    as the oldest. Among versions of one time, the largest value (as Spark orders structs) wins, so that ties
    don't depend on the order of rows.
    """
    seen = F.col(version).isNotNull().alias("has"), F.col(version).alias("at")
    newest = F.max(F.struct(*seen, *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)]))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(newest.alias("newest"), F.min(version).alias("first_loaded"))
        .select(key, *[F.col(f"newest.v{i}").alias(c) for i, c in enumerate(columns)], "first_loaded")
    )


def current_wide(df: DataFrame, *columns: str, key: str = "id", version: str = "loaded_at") -> DataFrame:
    """(key, columns) as ``current`` has them, for columns that are wide: only rows of repeated keys are shuffled.

    Keys are counted first. If more than ``SENT`` come more than once, all rows are shuffled.
    """
    repeated = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    if repeated.count() > SENT:
        return current(df, *columns, key=key, version=version).drop("first_loaded")
    once = df.where(F.col(key).isNotNull()).join(F.broadcast(repeated), key, "left_anti").select(key, *columns)
    again = df.join(F.broadcast(repeated), key, "left_semi")
    return once.unionByName(current(again, *columns, key=key, version=version).drop("first_loaded"))
