"""Queries of problem 2: the pages of scans, repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions.paths import canonical_path
from shoebox.llm.scans import repair_pages
from shoebox.sources.tables import current, table


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    photos = current(table(spark, d, "photos"), "path", "ocr_text").withColumn("file", canonical_path(F.col("path")))
    scan = F.regexp_extract("file", r"^/scans/(.+)/[^/]+$", 1)
    place = F.regexp_extract("file", r"(\d+)\D*$", 1).try_cast("int")
    pages = photos.withColumns({"scan": scan, "place": place, "text": F.col("ocr_text")}).where("scan <> ''")
    return repair_pages(pages.where("trim(text) <> ''"), photos.select(F.col("ocr_text").alias("text")))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Each scanned page as continuous paragraphs, with its number and running title."""
    return _repaired(spark, d).select(F.col("id").alias("photo_id"), "text", "page_number", "title")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select(F.col("id").alias("photo_id"), F.explode("kinds").alias("kind"))


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
SQL: dict[str, str] = {}
