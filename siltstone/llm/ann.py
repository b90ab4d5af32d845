"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Every vector is rotated by one random orthogonal matrix; of the rotated direction only the signs are kept, packed
to a bit a dimension, with two scalars: the vector's norm and the inner product of the direction with its code. From
these the inner product with a query is estimated without bias, within an error of at most
norm * |query| * EPSILON * sqrt((1 - x^2) / x^2 / (D - 1)), x the second scalar, but for a chance that falls off as
exp(-c * EPSILON^2). A vector is reranked in double precision if its estimate plus that bound reaches the least score
that is still among the best k.

Queries come in blocks of at most QUERY_BLOCK, each sent to all tasks with thresholds from a bounded sample of the
table; each task keeps k rows a query, and the best k of these are the result. The index is a table of codes over
every row, written once to the shared folder; with several blocks so are the results of each, so that neither the
driver's memory nor the plan grows with the queries. Vectors that are null, zero, of another length than most of a bounded sample, or that hold null or
non-finite components take no part, nor do rows without an id. Repeated ids are rows like others; a query leaves out
all rows of its own id. Ties go to the smaller id. An empty table gives an empty result; other columns are unread."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Stash, lean

EPSILON = 2.4
QUERY_BLOCK = 8_192
#: Rows whose exact scores give the first thresholds, at most.
SAMPLE_ROWS = 4_096
#: Estimates made at once, and pairs reranked at once.
TILE, PAIRS = 1_000_000, 50_000
#: What single precision may be off by, relative to the norms' product.
SLACK = 1e-5


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def index(vectors: DataFrame, d: int, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 5) -> DataFrame:
    """One row per usable vector: vec_id, code (packed signs), norm, fit (inner product of direction and code), embedding."""
    turn = rotation(d, seed)
    kind = vectors.schema[vector].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column(1), d)
            norm = np.sqrt((m * m).sum(axis=1))
            unit = (m / norm[:, None]) @ turn
            codes = np.packbits(unit > 0, axis=1)
            fit = np.abs(unit).sum(axis=1) / np.sqrt(d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(fit), batch.column(1)], ["vec_id", "code", "norm", "fit", "embedding"])

    rows = vectors.where(usable(F.col(vector)) & (F.size(vector) == d) & F.col(vec_id).isNotNull())
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding")).mapInArrow(lean(run), f"vec_id long, code binary, norm double, fit double, embedding {kind}")


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, components added from the first on, so that equal vectors score alike everywhere."""
    out = a[:, 0] * b[:, 0]
    for j in range(1, a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.q, self.s, self.i = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        q, s, i = np.concatenate([self.q, q]), np.concatenate([self.s, s]), np.concatenate([self.i, i])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.q, self.s, self.i = q[keep], s[keep], i[keep]
        full = rank == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], s[full])


def search_block(queries: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], turn: np.ndarray, k: int, batches: Iterator[pa.RecordBatch], epsilon: float) -> Best:
    """One task: estimate all its rows against a block of queries, rerank what the bounds leave."""
    ids, vectors, floor, always = queries
    d = vectors.shape[1]
    spun = (vectors @ turn).astype(np.float32)
    length = np.sqrt((vectors * vectors).sum(axis=1)).astype(np.float32)
    short = vectors.astype(np.float32)
    best = Best(len(ids), k, floor)
    for batch in batches:
        vec, norm, fit = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(vec), -1)
        exact = matrix(batch.column(4), d)
        rough = exact.astype(np.float32)
        scale = (norm / fit / np.sqrt(d)).astype(np.float32)
        bound = (norm * (epsilon * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit / np.sqrt(max(1, d - 1)) + SLACK)).astype(np.float32)
        # What a query's floor comes from is never left out, so k rows are found.
        lo_, hi_ = np.searchsorted(always[0], vec, "left"), np.searchsorted(always[0], vec, "right")
        given = {int(i): always[1][lo_[i] : hi_[i]] for i in np.flatnonzero(hi_ > lo_)}
        step = max(1, TILE // max(1, len(ids)))
        for lo in range(0, len(vec), step):
            hi = min(len(vec), lo + step)
            signs = np.unpackbits(code[lo:hi], axis=1, count=d).astype(np.float32) * 2 - 1
            guess = (signs * scale[lo:hi, None]) @ spun.T
            guess += bound[lo:hi, None] * length[None, :]
            for i in range(lo, hi) if given else ():
                if i in given:
                    guess[i - lo, given[i]] = np.inf
            c, q = np.nonzero(guess >= best.floor.astype(np.float32)[None, :])
            other = vec[c + lo] != ids[q]
            c, q = c[other] + lo, q[other]
            for a in range(0, len(c), PAIRS):
                x, y = c[a : a + PAIRS], q[a : a + PAIRS]
                # Reranked twice: in single precision with room for its error, then what is left in double.
                near = np.einsum("ij,ij->i", rough[x], short[y]) + SLACK * norm[x] * length[y] >= best.floor[y]
                x, y = x[near], y[near]
                s = dots(exact[x], vectors[y])
                good = s >= best.floor[y]
                best.add(y[good], s[good], vec[x[good]])
    return best


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 5, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that is_query holds for, its own id left out."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    sizes = [r[0] for r in vectors.where(usable(F.col(vector))).select(F.size(vector)).limit(SAMPLE_ROWS).collect()]
    if not sizes:
        return spark.createDataFrame([], result)
    d = max(set(sizes), key=lambda s: (sizes.count(s), -s))
    stash = Stash(spark, "neighbours")
    coded = stash(index(vectors, d, vec_id, vector, seed))
    turn = rotation(d, seed)
    asked = vectors.where(usable(F.col(vector)) & (F.size(vector) == d) & is_query).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding")).where("vec_id is not null")
    blocks = max(1, -(-asked.count() // (QUERY_BLOCK * 3 // 4)))
    some = coded.select("vec_id", "embedding").limit(SAMPLE_ROWS).collect()
    sample_ids, sample = np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.float64).reshape(-1, d)
    parts = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).distinct().collect() if blocks > 1 else asked.distinct().collect()
        if not rows:
            continue
        ids, own = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
        # The k-th best score in the sample is a floor that any true neighbour reaches.
        floor, above = np.full(len(ids), -np.inf), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(sample) > k:
            for lo in range(0, len(ids), 1024):
                s = own[lo : lo + 1024] @ sample.T
                s[sample_ids[None, :] == ids[lo : lo + 1024, None]] = -np.inf
                floor[lo : lo + 1024] = np.partition(s, len(sample) - k, axis=1)[:, len(sample) - k] - 1e-9
                q, i = np.nonzero(s >= floor[lo : lo + 1024, None])
                above.append((sample_ids[i], q + lo))
        vec, q = (np.concatenate(x) for x in zip(*above, strict=True))
        order = np.argsort(vec, kind="stable")
        sent = spark.sparkContext.broadcast((ids, own, floor, (vec[order], q[order])))  # QUERY_BLOCK vectors or so

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = search_block(sent.value, turn, k, batches, epsilon)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[0][best.q]), pa.array(best.i), pa.array(best.s)], ["query_id", "vec_id", "score"])

        part = coded.mapInArrow(lean(run), "query_id long, vec_id long, score double")
        if blocks > 1:
            part = stash(part)
            sent.unpersist()
        parts.append(part)
    if not parts:
        return spark.createDataFrame([], result)
    out = parts[0] if len(parts) == 1 else spark.read.schema(parts[0].schema).parquet(*[p._stash_path for p in parts])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
