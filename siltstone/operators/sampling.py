"""Seeded choices in a portable hash order, schedules, holdouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import hash_order


def carve_holdout(df: DataFrame, seed: int, n: int, chunk: str, row: str) -> DataFrame:
    """In hash order, the first row of each chunk until n are held out."""
    h = hash_order(seed, F.col(row))
    first = df.withColumn("h", h).groupBy(chunk).agg(F.min_by(F.struct(*df.columns, "h"), F.struct("h", row)).alias("r")).select("r.*")
    return first.orderBy("h", row).limit(n).drop("h")


def cap_shuffled(df: DataFrame, seed: int, n: int, row: str) -> DataFrame:
    return df.withColumn("h", hash_order(seed, F.col(row))).orderBy("h", row).limit(n).drop("h")


def stratified_round_robin(df: DataFrame, seed: int, k: int, stratum: str, row: str) -> DataFrame:
    """k rows, one of each stratum in turn, in hash order within a stratum. Only k rows of a stratum can be wanted."""
    order = W.partitionBy(stratum).orderBy(hash_order(seed, F.col(row)), row)
    turn = df.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k)
    return turn.orderBy("turn", stratum).limit(k)


def first_n(df: DataFrame, by: str, n: int, *order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("n") <= n)


def ranks(df: DataFrame, by: str, order: str, name: str = "rank", rows: int = 10_000) -> DataFrame:
    """Row numbers from 1 within `by` (null is a group) in the order of a column of distinct integers, without a task for a whole group.

    The column's range is cut into parts of about `rows` rows; parts are counted, then numbered within."""
    low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    part = F.floor((F.col(order) - F.lit(low or 0)) / F.lit(max(1, ((high or 0) - (low or 0) + 1) * rows // max(1, n)))).cast("long")
    cut = df.withColumn("_part", part)
    counts = cut.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy("_by").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(W.partitionBy(by, "_part").orderBy(order))
    out = cut.withColumn("_n", inner).join(counts.withColumn("_before", before).drop("_c"), F.col(by).eqNullSafe(F.col("_by")) & F.col("_part").eqNullSafe(F.col("_of")))
    return out.withColumn(name, F.col("_n") + F.col("_before")).drop("_n", "_before", "_part", "_by", "_of")


def interleaved(ranked: DataFrame, weights: dict[str | None, int], counts: dict[str | None, int], source: str = "source", rank: str = "rank", name: str = "pos") -> DataFrame:
    """A place from 0 for each row of ranked sources, so that every source has its share of any beginning until it ends.

    Row r of a source of weight w is due at (2 r - 1) / w, and rows stand in the order in which they are due, ties by the
    sources' order. A row's place is thus the number of rows due before it, a sum over the sources that needs no sort and
    no schedule: of a source of weight v and n rows, those due before are the ones with 2 r' - 1 < (2 r - 1) v / w."""
    order = sorted(counts, key=lambda s: (s is None, (s or "").encode()))
    listed = spark_array([(counts[s], weights[s], i) for i, s in enumerate(order)])
    own = ranked.sparkSession.createDataFrame([(s, weights[s], i) for i, s in enumerate(order)], "_source string, _w long, _i int")
    due = 2 * F.col(rank) - 1

    def before(total: Column, other: Column) -> Column:
        reach = due * other["w"]
        div = lambda a, b: F.call_function("div", a, b)  # noqa: E731, whole numbers throughout
        earlier = div(div(reach - 1, F.col("_w")) + 1, F.lit(2).cast("long"))
        tie = (reach % F.col("_w") == 0) & (div(reach, F.col("_w")) % 2 == 1) & (other["i"] < F.col("_i"))
        return total + F.least(other["n"], earlier + tie.cast("long"))

    met = ranked.join(F.broadcast(own), F.col(source).eqNullSafe(F.col("_source")))  # a row a source
    return met.withColumn(name, F.aggregate(listed, F.lit(0).cast("long"), before)).drop("_source", "_w", "_i")


def spark_array(rows: list[tuple[int, int, int]]) -> Column:
    one = lambda n, w, i: F.struct(F.lit(n).cast("long").alias("n"), F.lit(w).cast("long").alias("w"), F.lit(i).alias("i"))
    return F.array(*[one(*r) for r in rows]) if rows else F.array().cast("array<struct<n:bigint,w:bigint,i:int>>")


def targets(needs: DataFrame, sizes: dict[str, int], kept: float) -> DataFrame:
    """task, per_call, raw_target, calls of (task, of_raft, of_sft, per_call): raw pairs to ask for, so that enough are left of filters that keep the share `kept`."""
    net = F.col("of_raft") * sizes["raft"] + F.col("of_sft") * sizes["sft"]
    raw = F.ceil(net / kept)
    return needs.select("task", "per_call", raw.alias("raw_target"), F.ceil(raw / F.col("per_call")).alias("calls"))


def scheduled(calls: DataFrame, seed: int) -> DataFrame:
    """pos, task: every call of every task in one hashed order."""
    each = calls.select("task", F.explode(F.sequence(F.lit(1).cast("long"), F.col("calls"))).alias("i")).withColumn("key", F.concat_ws("|", "task", F.col("i").cast("string")))
    return positions(each, hash_order(seed, F.col("key")), "key").select(F.col("pos").cast("long").alias("pos"), "task")


def holdout(df: DataFrame, order: str, n: int) -> DataFrame:
    """Every row with `held_out` for the first n in order; ties to all columns alike."""
    edge = df.select(order).orderBy(order).limit(n).agg(F.max(order)).first()[0]
    return df.withColumn("held_out", F.lit(False) if edge is None else F.coalesce(F.col(order) <= F.lit(edge), F.lit(False)))


def positions(df: DataFrame, h: Column, row: str, name: str = "pos", parts: int = 256) -> DataFrame:
    """Row numbers from 0 in the order of a hash below 2 ** 32 (ties by `row`), without one task for all rows:
    equal ranges of the hash are counted, then numbered within."""
    ranged = df.withColumn("_h", h).withColumn("_p", F.floor(F.col("_h") * parts / (1 << 32)).cast("int"))
    before = F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("_p").count().withColumn("_before", before).drop("count")  # `parts` rows
    n = F.row_number().over(W.partitionBy("_p").orderBy("_h", row))
    return ranged.withColumn("_n", n).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_n") + F.col("_before") - 1).drop("_p", "_n", "_before", "_h")
