"""Duplicate photos: by hash, by vector, and the record to keep of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.config import SearchConfig
from shoebox.operators.blocks import store, without
from shoebox.operators.graph import components
from shoebox.operators.hamming import near_hash_pairs
from shoebox.operators.similarity import approximate_pairs, cosine_pairs, near_pairs, nearest
from shoebox.session import cut


def _of_two(found: DataFrame) -> DataFrame:
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return found.join(sizes, "component").select("component", F.col("node").alias("id"))


def hash_links(photos: DataFrame, most_bits: int | None = None, forest: bool = False) -> DataFrame:
    """(a, b, bits): links between photos (id, phash) whose hashes differ in few bits.

    With ``forest`` of many alike only links that connect what all links connect.

    Hashes that aren't 32 bytes link nothing. Photos of one hash are linked to the smallest id, which stands in for them.
    """
    most_bits = SearchConfig().phash_bits if most_bits is None else most_bits
    hashed = photos.where(F.octet_length("phash") == 32).select("id", F.col("phash").alias("hash"))
    alike = hashed.groupBy("hash").agg(F.min("id").alias("rep"))
    copies = hashed.join(alike, "hash").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("bits")).where("a <> b")
    return copies.unionByName(near_hash_pairs(alike.select(F.col("rep").alias("id"), "hash"), most_bits, forest=forest))


def hash_groups(photos: DataFrame, most_bits: int | None = None) -> DataFrame:
    """(component, id): groups of two or more photos (id, phash) linked directly or indirectly by near hashes."""
    return _of_two(components(hash_links(photos, most_bits, forest=True)))


def vector_groups(photos: DataFrame, least: float | None = None, neighbours: int | None = None, recall: float | None = None) -> DataFrame:
    """(component, id): groups of two or more photos (id, embedding) linked by a cosine of at least ``least``.

    All links count; with ``neighbours`` only those to a photo's nearest, itself among them. With ``recall`` links are
    searched approximately, each found at least with that probability: for more photos than all pairs allow. Vectors of
    different lengths aren't compared; NULL, zero and broken vectors link nothing.
    """
    least = SearchConfig().embedding_similarity if least is None else least
    vectors = photos.select("id", F.col("embedding").alias("vector"))
    if neighbours is not None:
        pairs = nearest(vectors, neighbours - 1, least).select(F.col("id").alias("a"), F.col("other").alias("b"))
    elif recall is not None:
        pairs = approximate_pairs(vectors, least, recall, forest=True)
    else:
        pairs = cosine_pairs(vectors, least, forest=True)
    return _of_two(components(pairs))


def least_distance(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(component, distance): the smallest number of bits in which two of each group differ; 0 for groups without ``links``."""
    least = links.join(groups.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.min("bits").alias("distance"))
    return groups.select("component").distinct().join(least, "component", "left").select("component", F.coalesce("distance", F.lit(0)).alias("distance"))


def representatives(groups: DataFrame, photos: DataFrame) -> DataFrame:
    """(component, keep, remove, size): the largest file of each group, of equal ones the last path; and the others."""
    rows = groups.join(photos.select("id", "path", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes")), "id")
    best = rows.groupBy("component").agg(F.max(F.struct("size_bytes", "path")).alias("x"), F.count("*").alias("size"))
    return best.select("component", F.col("x.path").alias("keep"), (F.col("size") - 1).alias("remove"), "size")


def marks(groups: DataFrame, photos: DataFrame) -> DataFrame:
    """(path, duplicate_of): a row for each photo to be flagged, with the path that is kept."""
    keep = representatives(groups, photos).select("component", "keep")
    rows = groups.join(photos.select("id", "path"), "id").join(keep, "component")
    return rows.where("path <> keep").select("path", F.col("keep").alias("duplicate_of"))


def find_duplicates(photos: DataFrame, config: SearchConfig = SearchConfig(), use_embedding: bool = True, recall: float | None = None) -> DataFrame:
    """(type, component, id): groups by hash first, then groups by vector among the photos in none of these.

    A group by hash is ``exact`` if two of its members have the same hash, else ``near_exact``; the others are
    ``semantic``; with ``recall`` these are searched approximately (``vector_groups``).
    """
    photos = photos.where("embedding is not null")
    stored = None
    if use_embedding and recall is None:
        # rows that take a shuffle to make are made once, and vectors aren't moved again
        stored = store(photos.select("id", "phash", F.col("embedding").alias("vector")), 4096, None, "phash")
        photos = stored.rows
    by_hash = cut(hash_groups(photos, config.phash_bits))
    hashes = by_hash.join(photos.select("id", "phash"), "id").groupBy("component", "phash").agg(F.count("*").alias("n"))
    kind = hashes.groupBy("component").agg(F.when(F.max("n") > 1, "exact").otherwise("near_exact").alias("type"))
    found = by_hash.join(kind, "component").select("type", "component", "id")
    if not use_embedding:
        return found
    if stored is None:
        rest = photos.join(by_hash.select("id"), "id", "left_anti")
        alike = vector_groups(rest, config.embedding_similarity, recall=recall)
    else:
        alike = _of_two(components(near_pairs(without(stored, by_hash), config.embedding_similarity, forest=True)))
    return found.unionByName(alike.select(F.lit("semantic").alias("type"), "component", "id"))


def manifest(groups: DataFrame, photos: DataFrame, status: Column | None = None) -> DataFrame:
    """(path, keep, status): what a deletion would remove; files themselves are never touched."""
    out = marks(groups, photos).withColumnRenamed("duplicate_of", "keep")
    return out.withColumn("status", F.lit("planned") if status is None else status)


def summary(groups: DataFrame) -> DataFrame:
    """(groups, removable): how many groups there are, and how many photos beside those kept."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removable"))
