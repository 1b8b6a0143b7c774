"""Connected components by alternating star contractions (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the smallest vertex around."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): every end of an edge, with the smallest id it is linked to directly or indirectly.

    Ids are BIGINT. Edges with a NULL end are left out; edges from a node to itself make a component of one. The only
    thing the driver sees of a round is its number of edges and a checksum.
    """
    given = cut(edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a is not null and b is not null").distinct())
    now, before = cut(given.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
        now = cut(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    nodes = given.select(F.col("a").alias("node")).union(given.select(F.col("b").alias("node"))).distinct()
    root = now.groupBy("a").agg(F.min("b").alias("b"))
    return nodes.join(root, nodes["node"] == root["a"], "left").select("node", F.coalesce("b", "node").alias("component"))


def groups(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component, label): members of components of two or more; labels count from 0 in the order of the smallest member."""
    found = components(edges, a, b)
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    kept = found.join(sizes, "component")
    # numbers for components without gathering them in one task: counts by range, then within it
    return kept.join(numbered(sizes.select("component"), "component", "label"), "component").select("node", "component", "label")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Distinct rows of one column with consecutive numbers from 0 in its order."""
    from pyspark.sql import Window

    parts = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + own).drop("_part", "_n", "_before")
