"""What the operators of this subpackage share: the tables, the shared folder, components of a link graph."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import forget_powers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset, a session on one machine gets a folder of that machine; any other is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = "file:///tmp/siltstone-shared"
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siltstone-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Stash:
    """Tables written to the shared folder, which cut lineage and outlive executors; drop() deletes those no longer wanted.

    What a result still reads stays in the shared folder, as checkpoints do."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, new_folder(spark, name), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._stash_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_stash_path", None):
                remove(self.spark, path)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapper that gives the memory it used back to the system when its task ends, as workers wait beside the JVM for the next one."""

    @functools.wraps(run)
    def lean_run(batches: Iterator) -> Iterator:
        yield from run(batches)
        forget_powers()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return lean_run


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from the columns of df, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, stash: Stash) -> DataFrame:
    """Connected components of (a, b) long edges, any size, without gathering them: (node, root), root the least node.

    Alternates large-star and small-star rounds (each node hands its neighbours to its least one) until the
    edges stop changing; every round is a grouped aggregate and a join on the node, which the shuffle spreads.
    Repeated edges, loops and nulls are ignored. An empty input gives an empty result."""
    e = stash(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not is_star_forest(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        before, e = e, stash(small)
        stash.drop(before)
    roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def is_star_forest(edges: DataFrame) -> bool:
    """Whether no node of the distinct (a, b) edges has two parents b, or both a child and a parent."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def merged(roots: DataFrame | None, links: DataFrame, stash: Stash) -> DataFrame:
    """(node, root) with more (a, b) links: only components of the old roots are sought, so old links are never walked again."""
    if roots is None:
        return stash(components(links, stash))
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}"))
    lifted = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    up = stash(components(lifted.select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b")), stash))
    moved = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    out = stash(moved.unionByName(up.join(roots.select("node"), "node", "left_anti")))
    stash.drop(up)
    return out
