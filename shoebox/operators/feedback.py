"""The log of search feedback: statistics, penalties, and learning of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.config import SearchConfig
from shoebox.schemas import WEIGHTS

#: Kinds of feedback, and the preset that each intent learns.
KINDS = ["POSITIVE", "NEGATIVE", "CLICKED", "IGNORED"]
LEARNS = {"VISUAL": "visual_dominant", "METADATA": "metadata_dominant", "TEXT": "text_dominant", "HYBRID": "hybrid_balanced"}


def stats(log: DataFrame) -> DataFrame:
    """(by, value, n): the number of entries, and that by intent and by kind, in one pass."""
    intent, kind = F.col("query_intent"), F.col("feedback_type")
    grouped = log.groupingSets([[], [intent], [kind]], intent, kind).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    by = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "intent").when(F.col("g") == 2, "kind")
    value = F.when(F.col("g") == 1, F.col("query_intent")).when(F.col("g") == 2, F.col("feedback_type"))
    return grouped.select(by.alias("by"), value.alias("value"), "n")


def counts(log: DataFrame, *keys: str) -> DataFrame:
    """Entries of each kind per ``keys``: (keys, positive, negative, clicked, ignored)."""
    return log.groupBy(*keys).agg(*[F.count_if(F.col("feedback_type") == k).alias(k.lower()) for k in KINDS])


def multiplier(positive: Column, negative: Column) -> Column:
    """What a result's score is multiplied by; ``positive`` counts good marks and clicks."""
    pos, neg = F.coalesce(positive, F.lit(0)), F.coalesce(negative, F.lit(0))
    return (
        F.when((neg > 0) & (pos == 0), F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.12) * neg))
        .when((neg > 0) & (pos > 0), F.greatest(F.lit(0.3), F.lit(1.0) - F.lit(0.7) * (neg / (pos + neg))))
        .when(pos > 0, F.least(F.lit(1.3), F.lit(1.0) + F.lit(0.06) * pos))
        .otherwise(F.lit(1.0))
    )


def multipliers(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, multiplier) of all results that the log names; keys are compared as they stand."""
    counted = counts(log, *keys)
    return counted.select(*keys, multiplier(F.col("positive") + F.col("clicked"), F.col("negative")).alias("multiplier"))


def learning_data(log: DataFrame, least: int | None = None) -> DataFrame:
    """(intent, samples, successes, success_rate, visual, ocr, metadata): what good results had for weights.

    Intents with fewer than ``least`` entries or without success are left out. Weights that can't be read are no part
    of the means.
    """
    least = SearchConfig().min_feedback if least is None else least
    w, good = F.from_json("weights_used", WEIGHTS), F.col("feedback_type").isin("POSITIVE", "CLICKED")
    of = lambda part: F.avg(F.when(good, w[part])).alias(part)
    grouped = log.groupBy(F.col("query_intent").alias("intent")).agg(
        F.count("*").alias("samples"), F.count_if(good).alias("successes"), of("visual"), of("ocr"), of("metadata")
    )
    rate = (F.col("successes") / F.col("samples")).alias("success_rate")
    return grouped.where((F.col("samples") >= least) & (F.col("successes") > 0)).select("intent", "samples", "successes", rate, "visual", "ocr", "metadata")


def learned_weights(log: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """(preset, visual, ocr, metadata, learned): the presets after learning.

    Each weight moves by ``learning_rate`` towards what good results had, by at most ``max_adjustment``, and not below
    0. Presets whose intent has too little or too little good feedback, and the fallback, stay.
    """
    rows = [(name, next((i for i, p in LEARNS.items() if p == name), None), w["visual"], w["ocr"], w["metadata"]) for name, w in config.presets.items()]
    base = log.sparkSession.createDataFrame(rows, "preset string, intent string, visual double, ocr double, metadata double")
    seen = learning_data(log, config.min_feedback).where(F.col("success_rate") >= config.min_success)
    seen = seen.select("intent", *[F.col(c).alias(f"seen_{c}") for c in ("visual", "ocr", "metadata")])
    most = config.max_adjustment

    def moved(part: str) -> Column:
        was, goal = F.col(part), F.col(f"seen_{part}")
        step = (was * (1 - config.learning_rate) + goal * config.learning_rate) - was
        return F.coalesce(F.greatest(F.lit(0.0), was + F.greatest(F.lit(-most), F.least(F.lit(most), step))), was).alias(part)

    return base.join(F.broadcast(seen), "intent", "left").select("preset", *[moved(p) for p in ("visual", "ocr", "metadata")], F.col("seen_visual").isNotNull().alias("learned"))


def recent_queries(log: DataFrame, n: int = 10) -> DataFrame:
    """The latest distinct (query, query_intent, timestamp)."""
    return log.select("query", "query_intent", "timestamp").distinct().orderBy(F.desc("timestamp"), "query", "query_intent").limit(n)


def should_update(log: DataFrame, least: int | None = None) -> DataFrame:
    """(samples, should_update): whether there is feedback enough to learn from."""
    least = SearchConfig().min_feedback if least is None else least
    return log.agg(F.count("*").alias("samples")).withColumn("should_update", F.col("samples") >= least)


def entries(rows: DataFrame) -> DataFrame:
    """Rows to append to the log: columns visual, ocr, metadata, v, o, m, final and the others of the log."""
    weights = F.to_json(F.struct("visual", "ocr", "metadata")).alias("weights_used")
    scores = F.to_json(F.struct(F.col("v").alias("visual"), F.col("o").alias("ocr"), F.col("m").alias("metadata"), "final")).alias("result_scores")
    return rows.select("query", "query_intent", weights, "result_path", "result_rank", scores, "feedback_type", "timestamp")
