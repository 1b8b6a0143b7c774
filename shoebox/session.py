"""Session helpers: local sessions for tests and benches, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "shoebox", **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster the caller brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the folder of ``spark.checkpoint.dir``; a temporary folder only where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shoebox-"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to all cores by ``keys``, for rows that are small but take long: by bytes they would come to few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the tables of ``cut``, for files that tasks write and read; deleted with these."""
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    place, files = _place(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    _WRITTEN.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written to the shared checkpoint folder as a table, and read from there.

    Lost executors cost nothing, later plans are small, and the optimizer knows the table's size; the estimates that
    checkpoint() carries along multiply from one round of an iteration to the next. ``release`` deletes the table, or the
    JVM when it ends.
    """
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that ``cut`` wrote and folders of ``shared_folder`` that nothing has deleted.
_WRITTEN: list[str] = []


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> int:
    """Delete all tables that ``cut`` has written so far, and say how many.

    For long sessions, once results are stored: DataFrames that were made before and are still to be read lose their input.
    """
    n = len(_WRITTEN)
    while _WRITTEN:
        place, files = _place(spark, _WRITTEN.pop())
        files.delete(place, True)
    return n
