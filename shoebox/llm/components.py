"""Consolidating pairwise matches into groups by low-diameter decomposition.

Every vertex draws an exponential head start; clusters grow from all vertices at once along the edges, each vertex
joining the cluster that reaches it first. Clusters contract to super-vertices, edges between clusters become the edges
of the next level, and the assignments of all levels compose to one group for each vertex. Each level is written to the
shared checkpoint folder, so that neither plans nor lost executors pile up work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.operators.hamming import near_hash_pairs
from shoebox.session import cut


def _grow(edges: DataFrame, beta: float, steps: int, seed: int) -> DataFrame:
    """(v, c): for each vertex of the edges the centre of its cluster after ``steps`` steps of growth."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    uniform = (F.shiftrightunsigned(F.xxhash64("v", F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
    reach = both.groupBy("v").agg(F.count("*").alias("links")).select("v", F.struct((F.log(uniform) / beta).alias("at"), F.col("v").alias("c")).alias("r"))
    for _ in range(steps):
        # a vertex's own cluster is an arrival too; min() combines arrivals before the shuffle
        near = both.join(reach.withColumnRenamed("v", "u"), "u").select("v", F.struct((F.col("r.at") + 1).alias("at"), F.col("r.c").alias("c")).alias("r"))
        reach = near.unionByName(reach).groupBy("v").agg(F.min("r").alias("r"))
    return reach.select("v", F.col("r.c").alias("c"))


def group_pairs(pairs: DataFrame, a: str = "a", b: str = "b", beta: float = 0.02, steps: int = 4, seed: int = 17, most_levels: int = 200) -> DataFrame:
    """(node, group_id): every id named by a pair, with the smallest id of its group.

    Pairs with a NULL end name nothing and are left out; a pair of equal ends makes its id a group of one; repeated and
    reversed pairs count once; other columns are ignored. No pairs give no rows. ``beta`` is the rate of the head starts
    (smaller: wider clusters), ``steps`` the growth per level: a cluster cut short is still connected through its
    centre's group, so any number gives right groups.
    """
    given = pairs.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a is not null and b is not null")
    given = cut(given.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    edges = given.where("a <> b")
    nodes = given.select(F.col("a").alias("node")).union(given.select(F.col("b").alias("node"))).distinct()
    maps = []
    while not edges.isEmpty():
        if len(maps) == most_levels:
            raise RuntimeError(f"edges are left after {most_levels} levels")
        centre = cut(_grow(edges, beta, steps, seed + len(maps)))
        maps.append(centre)
        of = lambda end: centre.select(F.col("v").alias(end), F.col("c").alias(f"c{end}"))
        inner = edges.join(of("a"), "a").join(of("b"), "b").where("ca <> cb")
        edges = cut(inner.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    # compose from the top: the last level's map is small, and each level below is some times as large
    whole = None
    for level in reversed(maps):
        whole = level if whole is None else level.join(whole.select(F.col("v").alias("c"), F.col("c").alias("top")), "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    if whole is None:
        return nodes.select("node", F.col("node").alias("group_id"))
    found = nodes.join(whole.withColumnRenamed("v", "node"), "node", "left").select("node", F.coalesce("c", "node").alias("c"))
    least = found.groupBy("c").agg(F.min("node").alias("group_id"))
    return found.join(least, "c").select("node", "group_id")


def match_groups(items: DataFrame, most_bits: int = 10) -> DataFrame:
    """(group_id, id): all members of groups of two or more of ``items`` (id, path key, hash, link key).

    Items match when their hashes differ in at most ``most_bits`` bits or when the ``link`` of one is the ``file`` of
    the other. NULL, misshapen and all-zero hashes match nothing, nor do NULL and blank links, links to no item, or
    links to oneself. Items of one hash stand in for each other by the smallest id, and rejoin their group at the end.
    Repeated rows count once; an empty table gives no rows.
    """
    items = items.select("id", "file", "hash", "link").where("id is not null")
    real = (F.octet_length("hash") == 32) & (F.hex("hash") != "0" * 64)
    hashed = items.where(F.col("hash").isNotNull() & real).select("id", "hash")
    alike = hashed.groupBy("hash").agg(F.min("id").alias("rep"))
    copies = hashed.join(alike, "hash").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    near = near_hash_pairs(alike.select(F.col("rep").alias("id"), "hash"), most_bits, forest=True)
    pairs = near.select("a", "b").unionByName(copies).unionByName(link_pairs(items))
    return group_pairs(pairs).select("group_id", F.col("node").alias("id"))


def link_pairs(items: DataFrame) -> DataFrame:
    """(a, b): items (id, file, link) of which a's link is b's file; links to oneself, to nothing and blank ones give none."""
    files = items.where("file is not null and file <> ''").select(F.col("file").alias("link"), F.col("id").alias("b"))
    links = items.where("link is not null and link <> ''").select(F.col("id").alias("a"), "link")
    return links.join(files, "link").where("a <> b").select("a", "b")
