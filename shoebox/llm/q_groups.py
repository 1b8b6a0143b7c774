"""Queries of problem 4: one group for all photos that match directly or indirectly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions.paths import canonical_path
from shoebox.llm.components import match_groups
from shoebox.sources.tables import current, table


def linked_photos(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current photos with ``file`` and ``link``: path and duplicate_of as keys."""
    photos = current(table(spark, d, "photos"), "path", "duplicate_of", *columns)
    return photos.withColumns({"file": canonical_path(F.col("path")), "link": canonical_path(F.col("duplicate_of"))})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    photos = linked_photos(spark, d, "phash").withColumnRenamed("phash", "hash")
    return match_groups(photos).select("group_id", F.col("id").alias("photo_id"))


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups have how many members."""
    sizes = p4_found(spark, d).groupBy("group_id").agg(F.count("*").alias("members"))
    return sizes.groupBy("members").agg(F.count("*").alias("n_groups"))


QUERIES = {"p4_found": p4_found, "p4_sizes": p4_sizes}
_FILE = r"""regexp_replace(regexp_replace(replace(url_decode(replace(regexp_replace({0}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g'), '+', '%2B')), chr(92), '/'), '/(\./|/)*', '/', 'g'), '^(\./)+|/\.$', '', 'g')"""
_BITS = " + ".join(f"cast(bit_count(xor(a.h{i}, b.h{i})) as int)" for i in range(4))
_GROUPS = f"""
with recursive p as (select id, arg_max(path, loaded_at) path, arg_max_null(duplicate_of, loaded_at) link, arg_max_null(phash, loaded_at) phash from photos group by id),
h as (select id, hex(phash) x from p where octet_length(phash) = 32 and hex(phash) <> repeat('0', 64)),
n as (select id, cast('0x' || x[1:16] as ubigint) h0, cast('0x' || x[17:32] as ubigint) h1, cast('0x' || x[33:48] as ubigint) h2, cast('0x' || x[49:64] as ubigint) h3 from h),
e as (select a.id a, b.id b from n a, n b where a.id < b.id and {_BITS} <= 10
  union select a.id, b.id from p a join p b on {_FILE.format("a.link")} = {_FILE.format("b.path")} where a.id <> b.id),
e2 as (select a, b from e union select b, a from e),
cc as (select a v, a g from e2 union select e2.b, cc.g from cc join e2 on e2.a = cc.v),
g as (select min(g) group_id, v photo_id from cc group by v)
"""
SQL = {
    "p4_found": _GROUPS + "select group_id, photo_id from g",
    "p4_sizes": _GROUPS + "select members, count(*) n_groups from (select count(*) members from g group by group_id) group by 1",
}
