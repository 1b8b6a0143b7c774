"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight. A source that must give more tokens than it has
gives whole epochs first; the rest is taken in the order of keys up to the token budget. The running sums behind that
are taken over buckets of keys first, then over ever smaller buckets of the one that crosses the budget, until few
documents are left, so that no task ever holds a source.

The quality weight of a document tells how usual its tokens are in its source: the cross-entropy of the document under
the counts of all tokens of the source, smoothed with those of all sources, is compared with that of the source's other
documents. What is far from them, be it noise or the same words over and over, weighs less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.tokens import RANKS, codes_of, encoder, ship, token_codes
from shoebox.session import cut


def source_key(name: Column) -> Column:
    """Names of sources as they are meant: case, blanks around them, and hyphens or blanks for underscores don't matter."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"^[\s ]+|[\s ]+$", "")), r"[\s_-]+", "_")


def weighed(documents: DataFrame, targets: DataFrame, path: str = RANKS, smoothing: float = 1000.0) -> DataFrame:
    """(doc_id, source, tokens, entropy, weight): sizes and quality weights of all documents of the targets' sources.

    documents: doc_id, text, source; other columns are ignored. Texts are cut into tokens once and kept as numbers.
    ``entropy`` is in nats a token; weight is exp(-z * z / 2), but at least 0.05, z being by how many standard deviations
    of its source it is off the mean. Documents without text or without a target have no row; those of a source of one
    document, or of equal ones, weigh 1. What is sent to all executors has a number for each token of the vocabulary and
    each source of the targets.
    """
    spark = documents.sparkSession
    ship(spark, path)
    wanted = targets.where("source is not null").select(source_key(F.col("source")).alias("source")).distinct()
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    coded = cut(rows.join(wanted, "source", "left_semi").select("doc_id", "source", token_codes(F.col("text"), path).alias("codes")))
    size = encoder(path).n_vocab

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for frame in frames:
            for source, group in frame.groupby("source"):
                n = np.bincount(codes_of(b"".join(group["codes"])), minlength=size)
                held[source] = held[source] + n if source in held else n
        yield pd.DataFrame({"source": list(held), "n": [n.astype("int64").tobytes() for n in held.values()]}, dtype=object)

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        n = np.sum([np.frombuffer(x, "int64") for x in frame["n"]], axis=0)
        return pd.DataFrame({"source": [frame["source"].iloc[0]], "n": [n.tobytes()]}, dtype=object)

    schema = "source string, n binary"
    found = coded.select("source", "codes").mapInPandas(count, schema).groupBy("source").applyInPandas(add, schema).collect()  # a row per source
    counts = {r["source"]: np.frombuffer(r["n"], "int64").astype("float64") for r in found}
    all_ = sum(counts.values(), np.ones(size))
    usual = all_ / all_.sum()
    cost = spark.sparkContext.broadcast({s: -np.log((n + smoothing * usual) / (n.sum() + smoothing)).astype("float32") for s, n in counts.items()})

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tokens, entropy = [], []
            for s, c in zip(frame["source"], frame["codes"]):
                c = codes_of(c)
                tokens.append(len(c))
                entropy.append(round(float(cost.value[s][c].mean(dtype="float64")), 9) if len(c) else None)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "source": frame["source"].astype(object), "tokens": tokens, "entropy": pd.array(entropy, "Float64")})

    kind = coded.schema["doc_id"].dataType.simpleString()
    measured = cut(coded.mapInPandas(measure, f"doc_id {kind}, source string, tokens bigint, entropy double"))
    usual_of = measured.groupBy("source").agg(F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("spread"))
    z = F.when(F.col("spread") > 1e-9, (F.col("entropy") - F.col("mean")) / F.col("spread")).otherwise(0.0)
    weight = F.when(F.col("entropy").isNotNull(), F.greatest(F.exp(-z * z / 2), F.lit(0.05))).otherwise(0.05)
    return measured.join(usual_of, "source").select("doc_id", "source", "tokens", "entropy", weight.alias("weight"))


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, wanted, epochs, rest): what each source of the targets must give.

    Without ``total_tokens`` the total is the largest at which every source that has documents reaches its share; the
    shares of sources without any are spread over the others in proportion. With it, sources give what they can.
    """
    goals = targets.where("source is not null").groupBy(source_key(F.col("source")).alias("source")).agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    has = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    goals = goals.join(F.broadcast(has.join(goals, "source", "left_semi")), "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    everything = Window.partitionBy(F.lit(1))  # one row per target
    share = F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(everything))
    most = F.col("available") * F.col("max_repeats")
    goals = goals.withColumn("share", share).withColumn("total", F.min(most / F.col("share")).over(everything))
    wanted = F.least(most.cast("double"), F.col("share") * (F.lit(float(total_tokens)) if total_tokens is not None else F.col("total")))
    goals = goals.withColumn("wanted", F.coalesce(F.round(wanted).cast("bigint"), F.lit(0)))
    epochs = F.when(F.col("available") > 0, F.floor(F.col("wanted") / F.col("available"))).otherwise(0).cast("int")
    return goals.withColumn("epochs", epochs).select(
        "source", "target_share", "max_repeats", "available", "wanted", "epochs", (F.col("wanted") - F.col("epochs") * F.col("available")).alias("rest")
    )


def _crossing(rows: DataFrame, low: Column, width: Column, before: Column | None = None) -> DataFrame:
    """(source, low, high, before, documents): of each source the bucket in which its budget ends.

    rows: source, bucket, tokens, rest; bucket b goes from ``low`` and b widths on; ``before`` are the tokens before all of them.
    """
    earlier = F.lit(0) if before is None else before
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("in"), F.count("*").alias("documents"), F.max("rest").alias("rest"), F.max(low).alias("from"), F.max(earlier).alias("earlier"))
    running = F.col("earlier") + F.sum("in").over(Window.partitionBy("source").orderBy("bucket"))  # a row per bucket
    found = sums.withColumn("to", running).where((F.col("to") > F.col("rest")) & (F.col("to") - F.col("in") <= F.col("rest")) & (F.col("rest") > 0))
    start = F.col("from") + F.col("bucket") * width
    return cut(found.select("source", start.alias("low"), (start + width).alias("high"), (F.col("to") - F.col("in")).alias("before"), "documents"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, edge_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, tokens, copies) and the report of shares.

    documents: doc_id, source, tokens, weight; targets: source, target_share, max_repeats; other columns are ignored.
    A repeated doc_id counts once (its largest row), rows without doc_id, source or tokens can't be chosen, and a
    weight that is NULL, NaN or not above 0 puts its document after all others. Sources without target give nothing.
    No document has more copies than its source's max_repeats. Empty tables give an empty selection. Buckets of keys are
    refined until at most ``edge_rows`` documents of a source are left to be put in order.
    """
    rows = documents.where("doc_id is not null and source is not null and tokens > 0")
    weight = F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight")).otherwise(F.lit(0.0)).cast("double")
    rows = rows.select("doc_id", source_key(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens"), weight.alias("weight"))
    rows = rows.groupBy("doc_id").agg(F.max(F.struct("source", "tokens", "weight")).alias("x")).select("doc_id", "x.*")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
    late = F.lit(1e300)
    keyed = cut(rows.withColumn("key", F.when(F.col("weight") > 0, -F.log(uniform) / F.col("weight")).otherwise(late * (1 + uniform))).drop("weight"))
    goals = cut(budgets(keyed, targets, total_tokens))
    chosen = keyed.join(F.broadcast(goals.select("source", "epochs", "rest")), "source").withColumn("place", F.log2("key"))
    # the range of keys of each source in which its budget ends, first among 256 buckets for each doubling of the key
    ends = _crossing(chosen.withColumn("bucket", F.floor(F.col("place") * 256)), F.lit(0.0), F.lit(1 / 256))
    width = 1 / 256
    for _ in range(4):
        if (ends.agg(F.max("documents")).first()[0] or 0) <= edge_rows:
            break
        width /= 1024
        inside = chosen.join(F.broadcast(ends), "source").where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
        part = F.least(F.floor((F.col("place") - F.col("low")) / F.lit(width)), F.lit(1023))
        ends = _crossing(inside.withColumn("bucket", part), F.col("low"), F.lit(width), F.col("before"))
    chosen = chosen.join(F.broadcast(ends), "source", "left")  # a row per source whose budget ends amid its documents
    amid = (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
    sure = chosen.where(F.col("low").isNotNull() & (F.col("place") < F.col("low"))).withColumn("taken", F.lit(1))
    never = chosen.where(F.col("low").isNull() | (F.col("place") >= F.col("high"))).withColumn("taken", F.lit(0))
    edge = chosen.where(amid)
    up_to = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "doc_id"))
    # the document that crosses the budget is taken if that comes nearer to it
    nearer = (up_to - F.col("rest") < F.col("rest") - (up_to - F.col("tokens"))).cast("int")
    edge = edge.withColumn("taken", F.when(up_to <= F.col("rest"), 1).otherwise(nearer))
    names = "doc_id", "source", "tokens", (F.col("epochs") + F.col("taken")).alias("copies")
    selection = cut(sure.select(*names).unionByName(edge.select(*names)).unionByName(never.select(*names)).where("copies > 0"))
    got = selection.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("selected_tokens"), F.max("copies").alias("most_copies")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("documents", "selected_tokens", "most_copies")}
    report = goals.join(got, "source", "left").withColumns(zero)
    total = F.sum("selected_tokens").over(Window.partitionBy(F.lit(1)))
    report = report.withColumn("actual_share", F.when(total > 0, F.col("selected_tokens") / total).otherwise(0.0))
    return selection, report.select("source", "target_share", "actual_share", "available", "wanted", "selected_tokens", "documents", "max_repeats", "most_copies")
