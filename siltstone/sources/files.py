"""Files in and out: text shards, JSON lines, evaluation blobs, ledgers, CSV, small reports.

Readers take a file, a folder or a pattern and give DataFrames with the schemas of `schemas`. Nothing is collected
but by markdown(), which writes tables of a report's size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schemas
from ..operators.gauntlet import without_sibling

CORRUPT = "_corrupt_line"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, in spark.checkpoint.dir.

    Where that is unset, a session on one machine gets one in the machine's temporary folder; any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        base = "file:///tmp/siltstone-shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/siltstone-{name}-{uuid.uuid4().hex}"


def shard_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), text of every non-empty line of text files.

    Splits of a file are counted first and numbered within, so a large file is no burden to one task."""
    lines = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    counts = lines.groupBy("file", "split").agg(F.count("*").alias("c"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # Within a split, rows have consecutive places.
    at = lines.join(counts.withColumn("before", before).drop("c"), ["file", "split"])
    return at.select("file", (F.col("place") - F.col("first") + F.col("before")).alias("line_no"), "text").where("text <> ''")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of JSON lines; blank lines are no rows. Torn lines are left out, or stop the job where `strict`."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    read = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return read.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def torn_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that json_lines() leaves out, as they are."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select("value", parsed[CORRUPT].isNotNull().alias("torn")).where("torn").select("value")


def version_of(file: Column) -> tuple[Column, Column]:
    """Version and whether it is judged, from <version>[.judged].json, a file or a folder of parts (also a partition's, name=<version>.json)."""
    name = F.regexp_extract(file, r"(?:^|[/=])([^/=]+?)\.json(?:/[^/]*)?$", 1)
    return F.regexp_replace(name, r"\.judged$", ""), name.endswith(".judged")


def eval_blobs(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """version, judged and the fields of every item of evaluation blobs.

    A version's plain blob is left out where it has a judged one. `whole`: a blob spreads over lines."""
    blobs = spark.read.schema(f"per_item array<struct<{schemas.as_struct(schemas.EVAL_ITEM)}>>").option("multiLine", str(whole).lower()).json(path)
    version, judged = version_of(F.col("_metadata.file_path"))
    named = blobs.select(version.alias("version"), judged.alias("judged"), "per_item").where("version <> ''")
    kept = without_sibling(named, "version", F.col("judged"))
    return kept.select("version", "judged", F.explode("per_item").alias("item")).select("version", "judged", *[f"item.{c}" for c in ("cond", "pair_id", "source", "answerable", "system", "user", "ref", "resp", "scores", "judge")])


def judged_items(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Items of every blob that a judge graded."""
    return eval_blobs(spark, path, whole).where(F.col("judge").isNotNull())


def ledgers(spark: SparkSession, path: str) -> DataFrame:
    """workspace, app, usd of ledger documents, one JSON document a line."""
    return spark.read.schema(schemas.LEDGER).json(path).select("workspace", F.explode("apps").alias("a")).select("workspace", "a.app", "a.usd")


def csv_rows(spark: SparkSession, path: str, schema: str, filled: tuple[str, ...] = ()) -> DataFrame:
    """Rows of CSV files with a header; those whose `filled` columns are blank are left out."""
    rows = spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    for c in filled:
        rows = rows.where(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    return rows


def to_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def to_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in the order given, with a header in each part."""
    df.select(*columns).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def markdown(df: DataFrame, title: str, most: int = 1_000) -> str:
    """A report's table as text; a table of more than `most` rows is no report and is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows")
    said = lambda v: "n/a" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"### {title}", "", f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *(f"| {' | '.join(map(said, r))} |" for r in rows)]
    return "\n".join(lines) + "\n"
