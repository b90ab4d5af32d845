"""Statistics over scored items: bootstrap intervals, paired differences, rank tests, agreement, corrections.

Resampling n items with replacement is a multinomial draw over the items' distinct values, so replicates are drawn
from counts of values: exact in law, with work by the number of distinct values and not of items. Columns that name
groups may not be null; null values don't count."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Distinct values that one task draws at once, and replicates.
VALUES, REPLICATES = 4_096, 250


def replicates(items: DataFrame, by: list[str], value: str, n_boot: int, seed: int) -> DataFrame:
    """by, replicate, replicate_mean: means of resampled items. Draws are dealt to chunks of values first, then to the values of each chunk."""
    counts = items.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("item_value")).agg(F.count("*").alias("items"))
    most = counts.groupBy(*by).agg(F.count("*").alias("values")).agg(F.max("values")).first()[0] or 0
    counts = counts.withColumn("value_chunk", F.pmod(F.xxhash64("item_value"), F.lit(max(1, -(-most // VALUES)))))
    blocks = F.sequence(F.lit(0), F.lit(-(-n_boot // REPLICATES) - 1))
    totals = counts.groupBy(*by, "value_chunk").agg(F.sum("items").alias("chunk_items")).withColumn("replicate_block", F.explode(blocks))
    of = items.select(*by).schema
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in of.fields)

    def rng(*key) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(key=[seed, zlib.crc32(repr(key).encode())]))

    def dealt(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("value_chunk")
        n, block = rows["chunk_items"].to_numpy(), int(key[-1])
        k = rng(*map(str, key)).multinomial(int(n.sum()), n / n.sum(), size=min(REPLICATES, n_boot - block * REPLICATES))
        return rows[[*by, "value_chunk", "replicate_block"]].assign(draws=list(k.T))

    def drawn(key: tuple, values: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        values = values.sort_values("item_value")
        v, share, out = values["item_value"].to_numpy(), values["items"].to_numpy() / values["items"].sum(), []
        for block, k in sorted(zip(draws["replicate_block"], draws["draws"], strict=True), key=lambda x: x[0]):
            s = rng(*map(str, key), int(block), "values").multinomial(np.asarray(k), share) @ v
            out.append(pd.DataFrame({"replicate": block * REPLICATES + np.arange(len(s)), "drawn": s}))
        found = pd.concat(out)
        for name, x in zip(by, key, strict=False):
            found[name] = x
        return found[[*by, "replicate", "drawn"]]

    deals = totals.groupBy(*by, "replicate_block").applyInPandas(dealt, f"{names}, value_chunk long, replicate_block int, draws array<long>")
    sums = counts.groupBy(*by, "value_chunk").cogroup(deals.groupBy(*by, "value_chunk")).applyInPandas(drawn, f"{names}, replicate int, drawn double")
    n = counts.groupBy(*by).agg(F.sum("items").alias("all_items"))
    return sums.groupBy(*by, "replicate").agg(F.sum("drawn").alias("drawn")).join(n, by).select(*by, "replicate", (F.col("drawn") / F.col("all_items")).alias("replicate_mean"))


def bootstrap_ci(items: DataFrame, by: list[str], value: str, n_boot: int = 5000, seed: int = 0) -> DataFrame:
    """by, n, mean, lo, hi: the mean with a 95 % percentile interval."""
    ms = replicates(items, by, value, n_boot, seed).groupBy(*by).agg(F.expr("percentile(replicate_mean, 0.025)").alias("lo"), F.expr("percentile(replicate_mean, 0.975)").alias("hi"))
    return items.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(ms, by)


def n_of(df: DataFrame, column: str) -> int:
    return df.agg(F.count_distinct(column)).first()[0]


def correlations(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, spearman, pearson, over counts of distinct values, so that no group is sorted whole."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c: str) -> DataFrame:
        n = s.groupBy(*by, c).agg(F.count("*").alias("c"))
        below = F.coalesce(F.sum("c").over(W.partitionBy(*by).orderBy(c).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return n.withColumn(f"r_{c}", below + (F.col("c") + 1) / 2).drop("c")

    r = s.groupBy(*by, x, y).agg(F.count("*").alias("k")).join(ranks(x), [*by, x]).join(ranks(y), [*by, y])

    def weighted(a: str, b: str) -> Column:
        k, u, v = F.col("k"), F.col(a), F.col(b)
        n, su, sv = F.sum(k), F.sum(k * u), F.sum(k * v)
        return F.try_divide(n * F.sum(k * u * v) - su * sv, F.sqrt((n * F.sum(k * u * u) - su * su) * (n * F.sum(k * v * v) - sv * sv)))

    return r.groupBy(*by).agg(weighted(f"r_{x}", f"r_{y}").alias("spearman"), weighted(x, y).alias("pearson"))


def paired(items: DataFrame, a: str, b: str, version: str = "version", key: str = "pair_id", value: str = "score") -> DataFrame:
    """pair_id, diff over the items that both versions have."""
    x = items.where(F.col(version) == a).select(key, F.col(value).alias("x"))
    y = items.where(F.col(version) == b).select(key, F.col(value).alias("y"))
    return x.join(y, key).select(key, (F.col("x") - F.col("y")).alias("diff"))


def significant(lo: Column, hi: Column) -> Column:
    return (lo > 0) | (hi < 0)


def ranked_means(items: DataFrame, version: str = "version", value: str = "score", ascending: bool = False) -> DataFrame:
    means = items.where(F.col(value).isNotNull()).groupBy(version).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    order = F.asc("mean") if ascending else F.desc("mean")
    return means.withColumn("rank", F.row_number().over(W.orderBy(order, version)))


def signed_rank(diffs: DataFrame, by: list[str], diff: str = "diff") -> DataFrame:
    """by, n, w_plus, w_minus, w (the lesser), z: Wilcoxon's signed ranks, zeros left out, ties at mean ranks, normal law with tie correction.

    Ranks come from counts of distinct sizes, so a test's items are never sorted whole."""
    d = diffs.where((F.col(diff) != 0) & F.col(diff).isNotNull()).groupBy(*by, F.round(F.abs(diff), 12).alias("a")).agg(F.count("*").alias("t"), F.count_if(F.col(diff) > 0).alias("up"))
    below = F.coalesce(F.sum("t").over(W.partitionBy(*by).orderBy("a").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    r = d.withColumn("r", below + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    s = r.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("up") * F.col("r")).alias("w_plus"), F.sum((F.col("t") - F.col("up")) * F.col("r")).alias("w_minus"), F.sum(t * t * t - t).alias("ties"))
    s = s.withColumn("w", F.least("w_plus", "w_minus"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return s.withColumn("z", F.try_divide(F.col("w") - n * (n + 1) / 4, spread)).drop("ties")


def holm(df: DataFrame, p: str = "p", key: str = "test") -> DataFrame:
    """Each p times (k - rank from 0), at most 1, with no running maximum. For the few tests of a report."""
    rank = F.row_number().over(W.orderBy(p, key)) - 1
    k = F.count("*").over(W.partitionBy())
    return df.withColumn("p_holm", F.least(F.lit(1.0), F.col(p) * (k - rank)))


def discordant(x: Column, y: Column) -> list[Column]:
    """McNemar's two counts."""
    return [F.sum((x & ~y).cast("long")).alias("b"), F.sum((~x & y).cast("long")).alias("c")]


def mcnemar_p(b: int, c: int) -> float:
    """Exact binomial under 25 discordant pairs, else chi square with continuity correction."""
    n = b + c
    if n == 0:
        return 1.0
    if n < 25:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    return math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / n / 2))


def normal_p(z: float) -> float:
    """Two-sided p of a standard normal z."""
    return math.erfc(abs(z) / math.sqrt(2))


def two_sided_p(z: Column) -> Column:
    """normal_p of a column, for the few rows that tests have."""

    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return x.map(normal_p).astype("float64")

    return p(z)


def mcnemar_test(b: Column, c: Column) -> Column:
    @F.pandas_udf("double")
    def p(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([mcnemar_p(int(i), int(j)) for i, j in zip(x, y, strict=True)], dtype="float64")

    return p(b, c)


def weighted_kappa(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Quadratic weighted kappa of two grades in one pass; null without disagreement to expect.

    With weights (i - j)^2 the disagreement expected from the margins needs their sums and sums of squares alone."""
    i, j = F.col(a).cast("double"), F.col(b).cast("double")
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    seen = F.sum((i - j) * (i - j))
    expected = F.sum(i * i) + F.sum(j * j) - 2 * F.sum(i) * F.sum(j) / F.count("*")
    return both.groupBy(*by).agg((1 - F.try_divide(seen, expected)).alias("kappa"), F.count("*").alias("n"))


def row_pairs(df: DataFrame, order: list[Column]) -> DataFrame:
    """Pairs (a, b) of a leaderboard's rows, a before b in the order: structs joined on row numbers."""
    cols = df.columns
    r = df.withColumn("i", F.row_number().over(W.orderBy(*order))).withColumn("n", F.count("*").over(W.partitionBy()))
    j = F.explode(F.sequence(F.col("i") + 1, F.col("n").cast("int"))).alias("j")
    left = r.where("i < n").select(*[F.col(c).alias(f"a_{c}") for c in cols], j)
    right = r.select(*[F.col(c).alias(f"b_{c}") for c in cols], F.col("i").alias("j"))
    # The structs are made after the join, so that taking their fields apart again needs no nested pruning.
    pair = [F.struct(*[F.col(f"{side}_{c}").alias(c) for c in cols]).alias(side) for side in "ab"]
    return left.join(right, "j").select(*pair)


def kendall_tau_b(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Tau-b over the pairs of a leaderboard's rows."""
    p = row_pairs(df, [F.col(key)])
    s = F.signum(F.col(f"a.{x}") - F.col(f"b.{x}")) * F.signum(F.col(f"a.{y}") - F.col(f"b.{y}"))
    free = lambda c: F.sum((F.col(f"a.{c}") != F.col(f"b.{c}")).cast("double"))
    return p.agg(F.try_divide(F.sum(s), F.sqrt(free(x) * free(y))).alias("tau_b"), F.count("*").alias("n_pairs"))
