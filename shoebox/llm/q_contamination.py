"""Queries of problem 7: evaluation items in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoebox.llm.contamination import find_leaks
from shoebox.sources.tables import table


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """The longest leaked run of each item in each document, exact (replaced = 0) or near."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks}
SQL: dict[str, str] = {}
