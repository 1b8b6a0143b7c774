"""Feedback as a stream: counters of results, and a log without repeated entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.operators.feedback import KINDS, counts, multiplier
from shoebox.schemas import FEEDBACK


def read(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """The log as a stream of files."""
    return spark.readStream.schema(FEEDBACK).option("pathGlobFilter", pattern).parquet(folder)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The log as a stream of the table ``name`` in ``folder``, be it one file or a folder of part files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    return read(spark, f"{folder}/{name}.parquet") if status.isDirectory() else read(spark, folder, f"{name}.parquet")


def distinct_entries(log: DataFrame, late: str = "30 days") -> DataFrame:
    """Entries once each; the state of ids is dropped when the watermark has passed them."""
    timed = log.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    return timed.dropDuplicatesWithinWatermark(["id"])


def windowed_counts(log: DataFrame, size: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, feedback_type, n) per window of time; in append mode a window comes out when it can't change any more."""
    timed = log.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    return timed.groupBy(F.window("timestamp", size), "feedback_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "feedback_type", "n")


def multiplier_table(log: DataFrame, folder: str) -> DataFrame:
    """(result_path, query, multiplier) over all entries of a stream that have arrived, each id once.

    Entries whose id was seen before are dropped by the stream's state, however late they come. Each batch writes its
    counts to a directory of its own below ``folder``, so that a batch that is run again overwrites what it wrote; the
    counts are summed when the table is read. Calling again takes up what has arrived since.
    """

    def keep(batch: DataFrame, number: int) -> None:
        counts(batch, "result_path", "query").write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    once = log.where("id is not null").dropDuplicates(["id"])
    query = once.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    names = [k.lower() for k in KINDS]
    schema = f"result_path string, query string, {', '.join(f'{n} bigint' for n in names)}"
    summed = log.sparkSession.read.schema(schema).parquet(f"{folder}/counts").groupBy("result_path", "query").agg(*[F.sum(n).alias(n) for n in names])
    return summed.select("result_path", "query", multiplier(F.col("positive") + F.col("clicked"), F.col("negative")).alias("multiplier"))


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """What an append-mode stream gives for all that is there now, written to a table below ``folder``."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
