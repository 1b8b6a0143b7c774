"""Queries of problem 5: the most similar photos and faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm.neighbours import similar_pairs
from shoebox.sources.tables import table


def vectors_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    at = F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("version")
    return table(spark, d, name).select("id", at, F.col("embedding").alias("vector"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs of photos and of faces, with their cosine."""
    parts = [similar_pairs(vectors_of(spark, d, t)).select(F.lit(t).alias("tab"), "id_a", "id_b", "cosine") for t in ("photos", "faces")]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).select("tab", "id_a", "id_b")


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs}
SQL = {
    "p5_found": " union all ".join(
        f"""select '{t}' tab, a.id id_a, b.id id_b from {t}_v a, {t}_v b where a.id < b.id and list_cosine_similarity(a.e, b.e) >= 0.9""" for t in ("photos", "faces")
    )
}
_VECTOR = """{0}_v as (select id, e::double[] e from (select id, arg_max_null(embedding, loaded_at) e from {0} group by id)
where len(e) = 512 and len(list_filter(e, lambda x: x is null or isnan(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0)"""
SQL["p5_found"] = "with " + ", ".join(_VECTOR.format(t) for t in ("photos", "faces")) + " " + SQL["p5_found"]
