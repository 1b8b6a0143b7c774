"""Queries of what is read from files: camera data, places, hashes of pictures; and of entries appended to the log."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.engine import Library
from shoebox.functions import metadata as meta
from shoebox.operators import library
from shoebox.operators.places import nearest_places
from shoebox.plans.tables import FEEDBACK_SQL, faces, feedback, persons, photos, sql_current
from shoebox.sources.exif import file_metadata, jpeg_with, raw_metadata, tag_block
from shoebox.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


P = lambda *c: sql_current("photos", *c)
_M = f"(select id, case when metadata is not null and json_valid(metadata) and coalesce(len(json_keys(metadata)), 0) > 0 then metadata end j from {P('metadata')})"
_J = lambda key, kind="varchar": f"try_cast(json_extract_string(j, '$.{key}') as {kind})"


def _written(m: Column) -> Column:
    """The heads of JPEG files that say what is known of photos: the other way round than they are read."""

    @F.pandas_udf("binary")
    def of(rows: pd.DataFrame) -> pd.Series:
        out = []
        for k, r in enumerate(rows.itertuples(index=False)):
            text = {n: v for n in ("device_make", "device_model", "date_taken") if isinstance(v := getattr(r, n), str) and v.strip()}
            value: dict[str, object] = dict(text)
            if isinstance(r.flash, str):
                value["flash"] = 17 if r.flash == "Yes" else 16
            if not pd.isna(r.gps_latitude) and not pd.isna(r.gps_longitude):
                for name, number, signs in (("lat", r.gps_latitude, "NS"), ("lon", r.gps_longitude, "EW")):
                    minutes = abs(number) % 1 * 60
                    value[name], value[f"{name}_ref"] = [float(int(abs(number))), float(int(minutes)), minutes % 1 * 60], signs[int(number < 0)]
            out.append(jpeg_with(tag_block(value, "<>"[k % 2]), 640, 480))
        return pd.Series(out, dtype=object)

    return of(F.struct(*[m[n].alias(n) for n in ("device_make", "device_model", "date_taken", "flash", "gps_latitude", "gps_longitude")]))


_SET = lambda key: f"nullif(trim({_J(key)}), '')"


@query(f"""select id, 640 width, 480 height, 'JPEG' format, 'RGB' mode, {_SET('device_make')} device_make, {_SET('device_model')} device_model, {_SET('date_taken')} date_taken,
case when {_J('flash')} is not null then case when {_J('flash')} = 'Yes' then 'Yes' else 'No' end end flash,
case when lat is not null and lon is not null then round(lat, 6) end gps_latitude, case when lat is not null and lon is not null then round(lon, 6) end gps_longitude
from (select *, {_J('gps_latitude', 'double')} lat, {_J('gps_longitude', 'double')} lon from {_M})""")
def exif_facts(spark: SparkSession, d: str) -> DataFrame:
    """SRC14, FN14, FN16: camera data of photos written into files, and read from their bytes again."""
    rows = photos(spark, d, "metadata").withColumn("m", F.when(~meta.is_empty(F.col("metadata")), meta.parsed(F.col("metadata"))))
    files = rows.select("id", _written(F.col("m")).alias("content")).select("id", file_metadata(raw_metadata(F.col("content"))).alias("f"))
    plain = ("width", "height", "format", "mode", "device_make", "device_model", "date_taken", "flash")
    return files.select("id", *[F.col(f"f.{n}").alias(n) for n in plain], *[F.round(f"f.{n}", 6).alias(n) for n in ("gps_latitude", "gps_longitude")])


_AT = "cos(radians({0}.lat)) * cos(radians({0}.lon)) {1}x, cos(radians({0}.lat)) * sin(radians({0}.lon)) {1}y, sin(radians({0}.lat)) {1}z"


@query(f"""with p as (select id, lat, lon from (select id, {_J('gps_latitude', 'double')} lat, {_J('gps_longitude', 'double')} lon from {_M}) where lat between -90 and 90 and lon between -180 and 180),
a as (select *, {_AT.format('p', '')} from p), s as (select s_suppkey k, (s_suppkey * 7919) % 1800 / 10.0::double - 90 lat, (s_suppkey * 104729) % 3600 / 10.0::double - 180 lon from supplier),
b as (select *, {_AT.format('s', 'p')} from s),
n as (select id, arg_min(k, (round((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2, 15), k)) place_id, min((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2) d from a, b group by id)
select id, place_id, round(2 * 6371 * asin(least(1, sqrt(d) / 2)), 3) km from n""")
def photo_places(spark: SparkSession, d: str) -> DataFrame:
    """FN15: the place nearest to where each photo was taken; suppliers, spread over the globe, stand for a gazetteer."""
    rows = photos(spark, d, "metadata").withColumn("m", F.when(~meta.is_empty(F.col("metadata")), meta.parsed(F.col("metadata"))))
    taken = rows.select("id", F.col("m.gps_latitude").alias("lat"), F.col("m.gps_longitude").alias("lon"))
    degrees = lambda step, size: F.pmod(F.col("s_suppkey") * step, F.lit(size)) / 10.0 - size / 20
    places = table(spark, d, "supplier").select(F.col("s_suppkey").alias("place_id"), degrees(7919, 1800).alias("lat"), degrees(104729, 3600).alias("lon"))
    return taken.join(nearest_places(taken, places), ["lat", "lon"]).select("id", "place_id", F.round("km", 3).alias("km"))


@query(f"select id, phash is not null had, phash is not null or id % 3 > 0 has, case when phash is not null then hex(phash) end hash from {P('path', 'phash')}")
def backfilled_hashes(spark: SparkSession, d: str) -> DataFrame:
    """OP11, FN6, UD6: missing hashes made from pictures, here of 20 x 12 stripes; of each third photo the picture is cut."""
    rows = photos(spark, d, "path", "phash")
    stripe = F.repeat(F.sha2(F.col("path"), 256), 12).cast("binary")  # 768 bytes
    size = F.when(F.col("id") % 3 > 0, 720).otherwise(700)
    pictures = rows.select("path", F.substring(stripe, F.lit(1), size).alias("pixels"), F.lit(20).alias("width"), F.lit(12).alias("height"))
    filled = library.backfill_hashes(rows, pictures).select("id", F.col("phash").alias("now"))
    kept = F.when(F.col("phash").isNotNull(), F.hex("now"))
    return rows.join(filled, "id").select("id", F.col("phash").isNotNull().alias("had"), F.col("now").isNotNull().alias("has"), kept.alias("hash"))


@query(f"""select id, query, result_path, weights_used, feedback_type from {FEEDBACK_SQL} union all
select (select max(id) from search_feedback) + row_number() over (order by n_nationkey desc), n_name, '/n/' || n_nationkey, '{{"visual":0.5,"ocr":0.3,"metadata":0.2}}', 'CLICKED' from nation""")
def recorded_feedback(spark: SparkSession, d: str) -> DataFrame:
    """SNK14: the log with new entries, here one for each nation, appended in the order of their times."""
    at = F.date_sub(F.to_date(F.lit("2024-06-01")), F.col("n_nationkey").cast("int")).cast("timestamp_ntz")
    fixed = {"visual": 0.5, "ocr": 0.3, "metadata": 0.2, "v": 0.1, "o": 0.0, "m": 0.0, "final": 0.05}
    new = table(spark, d, "nation").select(
        F.col("n_name").alias("query"), F.lit("TEXT").alias("query_intent"), F.concat(F.lit("/n/"), F.col("n_nationkey")).alias("result_path"), F.lit(1).alias("result_rank"),
        F.lit("CLICKED").alias("feedback_type"), at.alias("timestamp"), *[F.lit(v).alias(k) for k, v in fixed.items()],
    )
    lib = Library(photos(spark, d, "path"), faces(spark, d), persons(spark, d), feedback(spark, d))
    return lib.record(new).log.select("id", "query", "result_path", "weights_used", "feedback_type")


QUERIES = Q
