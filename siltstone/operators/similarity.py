"""Cosine similarity: pairs over a threshold, order-true greedy near-duplicate removal, nearest distinct texts.

Pairs come from a blocked exact search at every size: rows travel in blocks of BLOCK rows or, where there are many, of up
to LARGE, and each pair of blocks is met once, in strips of STRIP rows, by a grouping on block numbers, so no join is
without a key. Work is the square of the rows by nature, and each row is sent once for each block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BLOCK, LARGE, STRIP = 8_000, 32_000, 500
#: Blocks up to which they stay small, for the sake of tasks side by side.
BLOCKS = 32


def blocks(df: DataFrame, id_col: str, vec_col: str, n_blocks: int) -> DataFrame:
    return df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(n_blocks)).cast("int").alias("b"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))


def blocks_of(rows: int) -> int:
    """Into how many blocks rows go: fewer and larger ones for large tables, so that rows are sent less often."""
    return max(1, min(-(-rows // BLOCK), max(BLOCKS, -(-rows // LARGE))))


def pairs_over(df: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", rows: int | None = None) -> DataFrame:
    """(i, j, sim) with i < j and dot product at least `threshold`, exact at every size."""
    rows = df.count() if rows is None else rows
    n = blocks_of(rows)
    b = blocks(df, id_col, vec_col, n)
    others = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = b.withColumn("o", others).withColumn("key", F.least("b", "o").cast("long") * n + F.greatest("b", "o"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[0] // n, key[0] % n
        a, c = pdf[pdf.b == lo], pdf[pdf.b == hi]
        found = [pd.DataFrame({"i": [], "j": [], "sim": []}).astype({"i": "int64", "j": "int64", "sim": "float64"})]
        if len(a) and len(c):
            m, other, a_id, c_id = matrix(a.v), matrix(c.v).T, a.id.to_numpy(), c.id.to_numpy()
            for at in range(0, len(a), STRIP):
                s = m[at : at + STRIP] @ other
                x, y = np.nonzero(s >= threshold)
                i, j = a_id[x + at], c_id[y]
                keep = i < j if lo == hi else i != j
                i, j, s = i[keep], j[keep], s[x, y][keep]
                found.append(pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "sim": s}))
        return pd.concat(found)

    return left.groupBy("key").applyInPandas(run, "i long, j long, sim double")


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def greedy_keep(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that a pass in rising order keeps when it drops whatever is close to one kept before.

    Rounds over (i < j) edges: a node whose lower neighbours are all dropped is kept, a node with a kept lower
    neighbour is dropped, until none is open. Only nodes with edges take part; every round is checkpointed."""
    state = edges.select(F.col("j").alias("node"), F.col("i").alias("low")).distinct()
    touched = edges.select(F.col("i").alias("node")).union(edges.select(F.col("j").alias("node"))).distinct()
    open_ = touched
    dropped = touched.limit(0)
    while True:
        blocked = state.select("node").distinct()
        kept = open_.join(blocked, "node", "left_anti")
        gone = state.join(kept.select(F.col("node").alias("low")), "low", "left_semi").select("node").distinct()
        dropped = dropped.union(gone).checkpoint()
        settled = kept.union(gone)
        open_ = open_.join(settled, "node", "left_anti").checkpoint()
        # Edges from nodes that are settled say no more; neither do edges to dropped ones.
        state = state.join(open_, "node", "left_semi").join(dropped.select(F.col("node").alias("low")), "low", "left_anti").checkpoint()
        if open_.limit(1).count() == 0:
            return nodes.join(dropped, nodes.columns[0] if nodes.columns[0] == "node" else nodes[nodes.columns[0]] == dropped["node"], "left_anti")


def nearest_distinct(vectors: DataFrame, texts: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", rows: int | None = None) -> DataFrame:
    """q, text_key, id, sim, rank: of all other vectors the k of largest dot product (to six places) with distinct texts; ties to the smaller id.

    texts: id, text_key (32 bytes), doc. Candidates of the query's own document or text are left out. No similarity is
    too low. A block's k best distinct texts of a query hold all of its rows that can be among the k best of all."""
    rows = vectors.count() if rows is None else rows
    n = blocks_of(rows)
    b = blocks(vectors, id_col, vec_col, n).join(texts.where("text_key is not null and doc is not null"), "id")
    others = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = b.withColumn("o", others).withColumn("key", F.least("b", "o").cast("long") * n + F.greatest("b", "o"))

    def best(asked: pd.DataFrame, pool: pd.DataFrame, found: list[pd.DataFrame]) -> None:
        pool = pool.sort_values("id", kind="stable")  # the first of equal scores has the smallest id
        names = pd.factorize(pd.concat([asked.text_key, pool.text_key]))[0].astype(np.int32)
        own, theirs = names[: len(asked)], names[len(asked) :]
        m, other = matrix(asked.v), matrix(pool.v).T
        q, ids, q_doc, doc, keys = asked.id.to_numpy(), pool.id.to_numpy(), asked.doc.to_numpy(), pool.doc.to_numpy(), pool.text_key.to_numpy()
        for at in range(0, len(asked), STRIP):
            to = slice(at, at + STRIP)
            s = m[to] @ other
            s = np.copysign(np.floor(np.abs(s) * 1e6 + 0.5), s) / 1e6
            s[(doc[None, :] == q_doc[to, None]) | (theirs[None, :] == own[to, None]) | (ids[None, :] == q[to, None]) | np.isnan(s)] = -np.inf
            for _ in range(k):
                top = s.argmax(axis=1)
                x = np.flatnonzero(s[np.arange(len(s)), top] > -np.inf)
                if not len(x):
                    break
                found.append(pd.DataFrame({"q": q[to][x], "text_key": keys[top[x]], "id": ids[top[x]], "sim": s[x, top[x]]}))
                s[theirs[None, :] == theirs[top][:, None]] = -np.inf

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[0] // n, key[0] % n
        a, c = pdf[pdf.b == lo], pdf[pdf.b == hi]
        found = [pd.DataFrame({"q": [], "text_key": [], "id": [], "sim": []}).astype({"q": "int64", "text_key": "object", "id": "int64", "sim": "float64"})]
        if len(a) and len(c):
            best(a, c, found)
            if lo != hi:
                best(c, a, found)
        return pd.concat(found)

    c = left.groupBy("key").applyInPandas(run, "q long, text_key binary, id long, sim double")
    one = c.groupBy("q", "text_key").agg(F.max(F.struct("sim", (-F.col("id")).alias("minus"))).alias("b"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "id"))
    return one.select("q", "text_key", (-F.col("b.minus")).alias("id"), F.col("b.sim").alias("sim")).withColumn("rank", rank).where(F.col("rank") <= k)
