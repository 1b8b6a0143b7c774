"""Queries of problem 1: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions.paths import canonical_path, strip
from shoebox.operators.orphans import find_orphans, number_key, orphans_by_period, text_key
from shoebox.sources.tables import current, table

PHOTOS, PERSONS, PATHS = 0, 1, 2


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    photos = current(table(spark, d, "photos"), "path")
    persons = current(table(spark, d, "persons"))
    parents = [
        number_key(photos, "id").withColumn("target", F.lit(PHOTOS)),
        number_key(persons, "id").withColumn("target", F.lit(PERSONS)),
        text_key(photos.withColumn("file", canonical_path(F.col("path"))).where("file is not null"), "file").withColumn("target", F.lit(PATHS)),
    ]
    faces = current(table(spark, d, "faces"), "photo_id", "person_id")
    feedback = current(table(spark, d, "search_feedback"), "result_path", version="timestamp")
    feedback = feedback.where(strip(F.col("result_path")) != "").withColumn("file", canonical_path(F.col("result_path")))
    refs = [
        number_key(faces, "photo_id").withColumns({"ref_field": F.lit("faces.photo_id"), "target": F.lit(PHOTOS)}),
        number_key(faces, "person_id").withColumns({"ref_field": F.lit("faces.person_id"), "target": F.lit(PERSONS)}),
        text_key(feedback, "file").withColumns({"ref_field": F.lit("search_feedback.result_path"), "target": F.lit(PATHS)}),
    ]
    union = lambda parts, *names: parts[0].select(*names).unionByName(parts[1].select(*names)).unionByName(parts[2].select(*names))
    renamed = [r.withColumnsRenamed({"id": "ref_id", "first_loaded": "ref_time"}) for r in refs]
    taken_out = table(spark, d, "photo_removals")
    removals = number_key(taken_out, "photo_id").select(F.lit(PHOTOS).alias("target"), "k", "s")
    paths = text_key(taken_out.withColumn("file", canonical_path(F.col("path"))).where("file is not null"), "file")
    removals = removals.unionByName(paths.select(F.lit(PATHS).alias("target"), "k", "s"))
    return union(renamed, "ref_field", "target", "k", "s", "ref_id", "ref_time"), union(parents, "target", "k", "s", "first_loaded"), removals


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference whose target isn't there, or came after the referring record."""
    return find_orphans(*_sides(spark, d)).select("ref_field", "ref_id")


def p1_by_month(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans per field and month of arrival."""
    references, parents, removals = _sides(spark, d)
    return orphans_by_period(find_orphans(references, parents, removals), references)


#: The plain part of canonical_path in SQL; the rows of the tables have no '..' steps.
_FILE = r"""regexp_replace(regexp_replace(replace(url_decode(replace(regexp_replace({0}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g'), '+', '%2B')), chr(92), '/'), '/(\./|/)*', '/', 'g'), '^(\./)+|/\.$', '', 'g')"""

_ORPHANS = f"""
with p as (select id, arg_max(path, loaded_at) path, min(loaded_at) first_loaded from photos group by id),
pp as (select {_FILE.format("path")} path, min(first_loaded) first_loaded from p group by 1),
q as (select id, min(loaded_at) first_loaded from persons group by id),
f as (select id, arg_max_null(photo_id, loaded_at) photo_id, arg_max_null(person_id, loaded_at) person_id, min(loaded_at) t from faces group by id),
s as (select id, {_FILE.format("any_value(result_path)")} path, min("timestamp") t from search_feedback group by id),
r as (
  select 'faces.photo_id' ref_field, f.id ref_id, t, first_loaded, photo_id in (select photo_id from photo_removals where photo_id is not null) gone from f left join p on p.id = photo_id where photo_id is not null
  union all select 'faces.person_id', f.id, t, first_loaded, false from f left join q on q.id = person_id where person_id is not null
  union all select 'search_feedback.result_path', s.id, t, first_loaded, s.path in (select {_FILE.format("path")} from photo_removals where path is not null) from s left join pp on pp.path = s.path where s.path is not null and trim(s.path) <> '')
"""

QUERIES = {"p1_found": p1_found, "p1_by_month": p1_by_month}
SQL = {
    "p1_found": _ORPHANS + "select ref_field, ref_id from r where first_loaded is null or first_loaded > t",
    "p1_by_month": _ORPHANS
    + """select ref_field, strftime(date_trunc('month', t), '%Y-%m-%d') period, count(*) refs,
    count(*) filter (first_loaded is null or first_loaded > t) orphans, count(*) filter (first_loaded is null and not gone) missing, count(*) filter (first_loaded is null and gone) removed,
    count(*) filter (first_loaded > t) later from r group by 1, 2""",
}
