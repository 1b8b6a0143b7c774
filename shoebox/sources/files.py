"""Listings of picture files, snapshots of tables, the stored vector index, and the caches of queries."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions.text import cache_key
from shoebox.functions.vec import unit_padded

#: What counts as a picture.
EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp"]


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime, size) of all pictures below a folder; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = files.select("path", F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"))
    return rows.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(EXTENSIONS))


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): for UDFs that decode them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(EXTENSIONS)).select("path", "content")


def save_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write a table's next state beside the ones before it; what is being read is never overwritten."""
    path = f"{root}/v={version:08d}"
    df.write.mode("error").parquet(path)
    return path


def batches(photos: DataFrame, size: int = 1000) -> Iterator[list]:
    """Rows in lists of ``size``, fetched partition by partition."""
    held: list = []
    for row in photos.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


class VectorIndex:
    """Vectors of length one with their ids, as a table that grows by appending."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def rows(photos: DataFrame) -> DataFrame:
        return photos.where(F.col("embedding").isNotNull()).select("id", unit_padded(F.col("embedding")).cast("array<float>").alias("vector"))

    def build(self, photos: DataFrame) -> None:
        self.rows(photos).write.mode("overwrite").parquet(self.path)

    def add(self, photos: DataFrame) -> None:
        """Append photos that the index hasn't got."""
        self.rows(photos).join(self.load().select("id"), "id", "left_anti").write.mode("append").parquet(self.path)

    def load(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def size(self) -> int:
        return self.load().count()

    def load_or_build(self, photos: DataFrame) -> DataFrame:
        """The stored index, or a new one if there is none or its size isn't that of the photos with vectors."""
        from pyspark.errors import AnalysisException

        try:
            if self.size() == photos.where(F.col("embedding").isNotNull()).count():
                return self.load()
        except AnalysisException:
            pass
        self.build(photos)
        return self.load()


def with_cached_vectors(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """``queries`` (query) with the vectors of ``cache`` (query_key, embedding); NULL where it has none."""
    return queries.withColumn("query_key", cache_key(F.col("query"))).join(cache.select("query_key", "embedding"), "query_key", "left")


def cache_rows(queries: DataFrame) -> DataFrame:
    """(query_key, embedding) to append to the cache, once for each key."""
    keyed = queries.select(cache_key(F.col("query")).alias("query_key"), F.col("embedding").cast("array<float>"))
    return keyed.groupBy("query_key").agg(F.max("embedding").alias("embedding"))


class ResultCache:
    """Results of recent queries on the driver: the least recently used go first, and all after some time."""

    def __init__(self, most: int = 100, ttl: float = 3600.0, clock=time.time):
        self.most, self.ttl, self.clock = most, ttl, clock
        self._kept: OrderedDict[str, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(query: str) -> str:
        return hashlib.md5(query.strip().lower().encode()).hexdigest()

    def get(self, query: str) -> Any | None:
        key = self.key(query)
        found = self._kept.get(key)
        if found is not None and self.clock() - found[0] > self.ttl:
            del self._kept[key]
            found = None
        if found is None:
            self.misses += 1
            return None
        self.hits += 1
        self._kept.move_to_end(key)
        return found[1]

    def set(self, query: str, results: Any) -> None:
        key = self.key(query)
        self._kept[key] = (self.clock(), results)
        self._kept.move_to_end(key)
        while len(self._kept) > self.most:
            self._kept.popitem(last=False)

    def clear(self) -> None:
        self._kept.clear()

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"entries": len(self._kept), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}
