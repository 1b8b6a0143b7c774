from pyspark.sql import functions as F

from shoebox.streaming import feedback as stream
from tests.test_operators import log_of, rows


def test_stream(spark, tmp_path):
    log = log_of(spark, ["POSITIVE", "NEGATIVE", "CLICKED"])
    log.unionByName(log.limit(1)).coalesce(1).write.parquet(str(tmp_path / "in"))
    once = stream.distinct_entries(stream.read(spark, str(tmp_path / "in")))
    got = stream.run_once(once.select("id", "feedback_type"), str(tmp_path / "c1"))
    assert rows(got, "id") == [(0,), (1,), (2,)]
    days = stream.windowed_counts(stream.read(spark, str(tmp_path / "in")), late="1 hour")
    assert stream.run_once(days, str(tmp_path / "c3")).agg(F.sum("n")).first()[0] >= 2


def test_each_entry_counts_once_over_batches(spark, tmp_path):
    log, folder = log_of(spark, ["POSITIVE", "NEGATIVE", "CLICKED"]), str(tmp_path / "c")
    log.unionByName(log).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = stream.multiplier_table(stream.read(spark, str(tmp_path / "in")), folder).first()
    assert round(found["multiplier"], 6) == round(1 - 0.7 * 1 / 3, 6)
    log.unionByName(log.withColumn("id", F.col("id") + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = stream.multiplier_table(stream.read(spark, str(tmp_path / "in")), folder).collect()
    assert len(found) == 1 and round(found[0]["multiplier"], 6) == round(1 - 0.7 * 1 / 4, 6)  # one more CLICKED


def test_table_of_part_files_counts_as_one_file(spark, tmp_path):
    from shoebox.plans.records import feedback_stream

    log = log_of(spark, ["POSITIVE", "NEGATIVE", "CLICKED", "NEGATIVE"])
    log.repartition(3).write.parquet(str(tmp_path / "parts" / "search_feedback.parquet"))
    log.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "file" / "search_feedback.parquet")
    parts, file = (rows(feedback_stream(spark, str(tmp_path / d)), "result_path") for d in ("parts", "file"))
    assert parts == file and len(file) == 1
