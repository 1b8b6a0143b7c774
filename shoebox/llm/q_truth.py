"""Queries of problem 3: the surviving record of each group of linked photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm.components import group_pairs, link_pairs
from shoebox.llm.q_groups import _FILE, linked_photos
from shoebox.llm.truth import claims_of, said_date, said_number, said_text, survivors

LARGEST = ("size_bytes",)


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    photos = linked_photos(spark, d, "size_bytes", "modified_time", "metadata")
    groups = group_pairs(link_pairs(photos)).select(F.col("node").alias("id"), "group_id")
    json = F.try_parse_json("metadata")
    says = lambda key: F.try_variant_get(json, f"$.{key}", "string")
    fields = {
        "date_taken": said_date(says("date_taken")),
        "device": said_text(says("device")),
        "location_name": said_text(says("location_name")),
        "gps_latitude": said_number(says("gps_latitude")),
        "iso": said_number(says("iso")),
        "size_bytes": F.when(F.col("size_bytes") > 0, F.col("size_bytes")),
    }
    # a source is the store a photo lies in: the first step of its path
    members = photos.join(groups, "id").withColumns({"source": F.regexp_extract("file", "^/?([^/]*)", 1), "recency": F.col("modified_time")})
    return survivors(claims_of(members, fields), largest=LARGEST)


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving value of each field of each group, with the photo that gives it."""
    return _survivors(spark, d).select("group_id", "field", "value", F.col("id").alias("photo_id"), "claimants", "agreeing")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields of which exactly one member says something, and sizes of which one is the largest."""
    one = F.when(F.col("field").isin(*LARGEST), F.col("agreeing")).otherwise(F.col("claimants")) == 1
    return _survivors(spark, d).where(one).select("group_id", "field", F.col("id").alias("photo_id"))


QUERIES = {"p3_found": p3_found, "p3_survivors": p3_survivors}
_TEXT = "case when lower(trim({0}, e' \\t\\r\\n')) not in ('', '-', '--', '?', 'n/a', 'na', 'nil', 'none', 'null', 'undefined', 'unknown', 'unspecified') then {0} end"
_JSON = "json_extract_string(case when json_valid(m) then m end, '$.{0}')"
SQL = {
    "p3_found": f"""
with recursive p as (select id, arg_max(path, loaded_at) path, arg_max_null(duplicate_of, loaded_at) link, arg_max_null(metadata, loaded_at) m, arg_max_null(size_bytes, loaded_at) z from photos group by id),
e as (select a.id a, b.id b from p a join p b on {_FILE.format("a.link")} = {_FILE.format("b.path")} where a.id <> b.id),
e2 as (select a, b from e union select b, a from e),
cc as (select a v, a g from e2 union select e2.b, cc.g from cc join e2 on e2.a = cc.v),
g as (select v id, min(g) g from cc group by v),
c as (select g, id, 'date_taken' field, cast(try_strptime({_JSON.format("date_taken")}, '%Y:%m:%d %H:%M:%S') as varchar) x from g join p using (id)
  union all select g, id, 'device', {_TEXT.format(_JSON.format("device"))} from g join p using (id)
  union all select g, id, 'location_name', {_TEXT.format(_JSON.format("location_name"))} from g join p using (id)
  union all select g, id, 'gps_latitude', cast(nullif(try_cast({_JSON.format("gps_latitude")} as double), 0) as varchar) from g join p using (id)
  union all select g, id, 'iso', cast(nullif(try_cast({_JSON.format("iso")} as double), 0) as varchar) from g join p using (id)),
s as (select g, id, z, max(z) over (partition by g) most, count(*) over (partition by g, z) n from g join p using (id) where z > 0)
select g group_id, field, any_value(id) photo_id from c where x is not null group by g, field having count(*) = 1
union all select g, 'size_bytes', id from s where z = most and n = 1""",
}
