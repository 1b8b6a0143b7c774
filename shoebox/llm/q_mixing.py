"""Queries of problem 8: the mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoebox.llm.mixing import mix, weighed
from shoebox.sources.tables import table


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    return mix(weighed(table(spark, d, "documents"), targets), targets)


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their copies."""
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of all chosen tokens that each source was to have, and has."""
    return _mix(spark, d)[1]


QUERIES = {"p8_selection": p8_selection, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
