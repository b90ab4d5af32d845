"""Append-only logs as streams: latest rows by key, event-time windows, resumable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gauntlet import last_write_wins
from ..sources.files import shared_folder


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream, its schema taken from the files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    parent, _, name = path.rstrip("/").rpartition("/")
    # A single file is found by its name in its folder, a folder by the files in it.
    return reader.option("pathGlobFilter", name).parquet(parent) if is_file(spark, path) else reader.parquet(path)


def json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON lines as a stream; torn lines are left out."""
    read = spark.readStream.schema(f"{schema}, _corrupt_line string").option("columnNameOfCorruptRecord", "_corrupt_line").json(path)
    return read.where("_corrupt_line is null").drop("_corrupt_line")


def is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def append_deduplicated(stream: DataFrame, out: str, keys: list[str], seq: str, checkpoint: str) -> None:
    """Append the latest row of each key of every batch to a Parquet log; the checkpoint makes a stopped run go on where it was.

    A batch that is tried again overwrites its own folder, so no row comes twice."""

    def write(batch: DataFrame, number: int) -> None:
        last_write_wins(batch, keys, seq).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_json(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append a stream to a log of JSON lines: the file sink commits a batch whole, and a stopped run goes on behind it."""
    stream.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_from_stream(spark: SparkSession, path: str, keys: list[str], seq: str, rest: list[str]) -> DataFrame:
    """The latest row of each key after all that is there has streamed into a log."""
    base = shared_folder(spark, "log")
    append_deduplicated(stream_of(spark, path).select(*keys, seq, *rest), f"{base}/log", keys, seq, f"{base}/checkpoint")
    return last_write_wins(spark.read.parquet(f"{base}/log").select(*keys, seq, *rest), keys, seq)


def daily_from_stream(spark: SparkSession, path: str) -> DataFrame:
    """Counts and sums by day and kind, kept whole in the state and written anew with each batch."""
    base = shared_folder(spark, "windows")
    windows = stream_of(spark, path).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("day"), "event_type", "n", "total").write.mode("overwrite").parquet(f"{base}/out")

    windows.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")
