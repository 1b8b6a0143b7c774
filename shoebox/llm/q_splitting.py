"""Queries of problem 9: documents over the size limit, in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoebox.llm.splitting import split_texts
from shoebox.sources.tables import table


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all documents, at most 1,000 tokens each, with an overlap of 50."""
    return split_texts(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_texts(table(spark, d, "documents"), keep_small=False, with_text=False)
    return pieces.where("piece = 0 and pieces > 1").select("doc_id")


QUERIES = {"p9_found": p9_found, "p9_pieces": p9_pieces}
SQL: dict[str, str] = {}
