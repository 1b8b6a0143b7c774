"""The current rows of a library's tables, as the queries read them, in Spark and in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from shoebox.sources.tables import current, current_wide, table

#: The time from which queries count days; a parameter of the operators.
NOW = dt.datetime(2024, 6, 1)


def photos(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current(table(spark, d, "photos"), *columns).drop("first_loaded")


def faces(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current(table(spark, d, "faces"), *columns).drop("first_loaded")


def face_vectors(spark: SparkSession, d: str) -> DataFrame:
    return current_wide(table(spark, d, "faces"), "embedding")


def persons(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current(table(spark, d, "persons"), *columns).drop("first_loaded")


def feedback(spark: SparkSession, d: str) -> DataFrame:
    columns = [c for c in table(spark, d, "search_feedback").columns if c != "id"]
    return current(table(spark, d, "search_feedback"), *columns, version="timestamp").drop("first_loaded")


def sql_current(name: str, *columns: str, version: str = "loaded_at") -> str:
    """A SQL subquery with the current rows of a table."""
    picked = ", ".join(f'arg_max_null("{c}", "{version}") "{c}"' for c in columns)
    return f"(select id{', ' * bool(columns)}{picked} from {name} group by id)"


FEEDBACK_SQL = "(select distinct * from search_feedback)"
