"""Ranked search: similar vectors, matched text, metadata rules and past feedback, cut where the scores fall."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.config import SearchConfig
from shoebox.functions import metadata as meta
from shoebox.functions import text as words
from shoebox.functions.vec import inner_with, is_zero
from shoebox.operators.feedback import multipliers


def _unit(vector: list[float]) -> list[float]:
    length = math.sqrt(sum(float(x) ** 2 for x in vector))
    return [float(x) / (length + 1e-8) for x in vector]


def candidates(photos: DataFrame, query_vector: list[float], config: SearchConfig = SearchConfig(), version: str | None = None) -> DataFrame:
    """The photos (id, path, embedding, ocr_text, metadata) most similar to a vector, with ``v_score``.

    Only ids and scores are moved and sorted; the other columns are read for the candidates alone. With ``version``, a
    TIMESTAMP, photos are all versions of the records, of which the latest of each id counts (NULL is the oldest):
    vectors are scored where they are read, and the versions of an id meet as scores.
    """
    score = inner_with(F.col("embedding"), _unit(query_vector), 1e-8).alias("v_score")
    if version is None:
        scored = photos.where(F.col("embedding").isNotNull()).select("id", score)
    else:
        at = F.coalesce(F.unix_micros(F.col(version).cast("timestamp")), F.lit(-(2**62)))
        named = photos.where(F.col("id").isNotNull()).select("id", at.alias("_at"), score)
        scored = named.groupBy("id").agg(F.max_by("v_score", "_at").alias("v_score"), F.max("_at").alias("_at"))
    best = scored.where(F.col("v_score").isNotNull() & ~F.isnan("v_score")).orderBy(F.desc("v_score"), "id").limit(config.candidates)
    if version is None:
        return photos.drop("embedding").join(F.broadcast(best), "id")  # at most ``candidates`` rows
    names = [c for c in photos.columns if c not in ("id", "embedding", version)]
    rows = photos.drop("embedding").withColumn("_at", at).join(F.broadcast(best), ["id", "_at"])
    one = rows.groupBy("id", "v_score").agg(F.max(F.struct(*names)).alias("x"))  # repeated rows of one time
    return one.select("id", "x.*", "v_score")


def query_plan(query: str | Column, presets: dict | None = None) -> dict[str, Column]:
    """intent and weights of a query, and the words to match in texts."""
    column = F.lit(query) if isinstance(query, str) else query
    n = words.class_counts(column)
    return words.intent_and_weights(n["m"], n["v"], n["t"], presets) | {"words": words.meaningful_tokens(column)}


def scored(found: DataFrame, query: str, now: dt.datetime, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``found`` with o_score, m_score, m_reasons and score."""
    plan, q = query_plan(query, config.presets), F.lit(query)
    m = meta.parsed(F.col("metadata"))
    points, why = meta.score_and_reasons(query, m, now, meta.is_empty(F.col("metadata")))
    parts = found.withColumns({"o_score": words.text_score(q, plan["words"], F.col("ocr_text"), config), "m_score": points, "m_reasons": why})
    total = F.col("v_score") * plan["visual"] + F.col("o_score") * plan["ocr"] + F.col("m_score") * plan["metadata"]
    return parts.withColumn("score", total)


def with_feedback(results: DataFrame, log: DataFrame, query: str) -> DataFrame:
    """Scores multiplied by what the log says of each result for this very query."""
    known = multipliers(log.where(F.col("query") == query), "result_path").withColumnRenamed("result_path", "path")
    joined = results.join(known, "path", "left").withColumn("penalty", F.coalesce("multiplier", F.lit(1.0))).drop("multiplier")
    return joined.withColumn("raw_score", F.col("score")).withColumn("score", F.col("score") * F.col("penalty"))


def kept(results: DataFrame, config: SearchConfig = SearchConfig(), by: list | None = None, key: list[str] | None = None) -> DataFrame:
    """Results (id, score) that pass the adaptive threshold, with their rank; per ``key``, if several queries are ranked.

    The threshold is a share of the best score, or, if higher, lies just under the first large drop among the first
    rows; the first result stays whatever its score. The window holds the candidates of a query, which are bounded.
    """
    key = key or []
    order = by or [F.desc("score"), "id"]
    w = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(1))
    ranked = results.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    last, top = F.lag("score").over(w.orderBy("rank")), F.max(F.when(F.col("rank") == 1, F.col("score"))).over(w)
    falls = (F.col("rank") <= config.gap_rows) & (last - F.col("score") >= F.lit(config.gap_drop) * top)
    gap = F.when(falls, F.struct("rank", (last - F.lit(config.gap_margin) * (last - F.col("score"))).alias("cut")))
    ranked = ranked.withColumns({"top": top, "gap": gap})
    first = F.min("gap").over(w)["cut"]
    share = F.greatest(F.col("top") * F.lit(1 - config.relative_threshold), F.col("top") * F.lit(config.floor_ratio))
    ranked = ranked.withColumn("threshold", F.greatest(F.coalesce(first, share), share)).drop("gap", "top")
    passed = ranked.withColumn("passes", F.col("score") >= F.col("threshold"))
    some = F.max("passes").over(w)
    return passed.withColumn("some", some).where("passes or (rank = 1 and not some)").where(F.col("rank") <= config.max_results).drop("passes", "some")


def match_type(v: Column, o: Column, m: Column) -> Column:
    kinds = F.array_compact(F.array(F.when(v > 0.2, "Visual"), F.when(o > 0, "OCR Text"), F.when(m > 0, "Metadata")))
    return F.when(F.size(kinds) > 0, F.array_join(kinds, " + ")).otherwise("Visual")


def feedback_note(penalty: Column) -> Column:
    up, down = ((penalty - 1.0) * 100).cast("int"), ((1 - penalty) * 100).cast("int")
    boosted = F.concat(F.lit("Boosted "), up.cast("string"), F.lit("%"))
    return F.when(penalty > 1.0, boosted).when(penalty < 1.0, F.concat(F.lit("Downranked "), down.cast("string"), F.lit("%"))).otherwise("")


def search(photos: DataFrame, log: DataFrame, query: str, query_vector: list[float], now: dt.datetime, config: SearchConfig = SearchConfig(), version: str | None = None) -> DataFrame:
    """(rank, id, path, score, v_score, o_score, m_score, m_reasons, penalty): the results of a query.

    photos: id, path, embedding, ocr_text, metadata, and with ``version`` that column (``candidates``). The pipeline is
    one plan: candidates by vector, their scores, feedback, threshold. Ties keep the order before feedback, then that of the vectors, then ids.
    """
    found = with_feedback(scored(candidates(photos, query_vector, config, version), query, now, config), log, query)
    order = [F.desc("score"), F.desc("raw_score"), F.desc("v_score"), "id"]
    return kept(found, config, order).select("rank", "id", "path", "score", "v_score", "o_score", "m_score", "m_reasons", "penalty", "threshold")


def report_lines(results: DataFrame) -> DataFrame:
    """(rank, line): results as lines of a text report."""
    number = lambda fmt, c: F.format_string(fmt, c)
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Score: "), number("%.4f", F.col("score")), F.lit(" ("), match_type(F.col("v_score"), F.col("o_score"), F.col("m_score")), F.lit(")"))
    note = feedback_note(F.col("penalty"))
    parts = F.concat(F.lit("Visual="), number("%.3f", F.col("v_score")), F.lit(", OCR="), number("%.1f", F.col("o_score")), F.lit(", Metadata="), number("%.2f", F.col("m_score")))
    line = F.concat_ws(" | ", head, F.when(note != "", note), F.col("path"), parts, F.when(F.size("m_reasons") > 0, F.array_join("m_reasons", ", ")))
    return results.select("rank", line.alias("line"))


def document_gate(photos: DataFrame, archetype: list[float], least: float | None = None) -> DataFrame:
    """Photos that look like documents: only these are worth reading their text."""
    limit = SearchConfig().document_gate if least is None else least
    return photos.where(F.col("embedding").isNotNull() & ~is_zero(F.col("embedding"))).where(inner_with(F.col("embedding"), _unit(archetype), 1e-8) > limit)
