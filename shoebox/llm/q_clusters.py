"""Queries of problem 6: the sets of mutually similar faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm.clusters import similarity_clusters, typical_members
from shoebox.llm.q_neighbours import vectors_of


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return similarity_clusters(vectors_of(spark, d, "faces")).select("cluster_id", F.col("id").alias("face_id"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each set's size and its three most typical faces."""
    faces = vectors_of(spark, d, "faces")
    return typical_members(faces, similarity_clusters(faces))


QUERIES = {"p6_found": p6_found, "p6_clusters": p6_clusters}
SQL: dict[str, str] = {}
