"""Neighbours of a table well above the sample that gives the first bounds."""

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import ann


def recall(spark, m, k=10, every=50):
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<float>")
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    want = {(q, int(i)) for q in range(0, len(m), every) for i in np.argsort(-s[q], kind="stable")[:k]}
    got = ann.search(v, F.col("vec_id") % every == 0, k=k).collect()
    assert len(got) == len(want)
    return len(want & {(r.query_id, r.vec_id) for r in got}) / len(want)


def test_recall_of_clusters_and_of_noise_above_the_sample_size(spark):
    """More rows than the sample holds, with no constant patched."""
    rng = np.random.default_rng(9)
    noise = rng.standard_normal((ann.SAMPLE_ROWS + 1500, 48))
    centres = rng.standard_normal((60, 48))
    for m in (noise, centres[rng.integers(0, 60, len(noise))] + 0.2 * noise):
        assert recall(spark, m.astype(np.float32).astype(float), every=100) >= 0.98


def test_codes_leave_most_pairs_out_of_small_tables():
    """The estimates decide at every size: few pairs reach the exact scores."""
    rng = np.random.default_rng(10)
    m = (rng.standard_normal((40, 64))[rng.integers(0, 40, 1000)] + 0.3 * rng.standard_normal((1000, 64)))
    turn = ann.rotation(64, 5)
    norm = np.linalg.norm(m, axis=1)
    unit = (m / norm[:, None]) @ turn
    fit = np.abs(unit).sum(axis=1) / 8
    guess = ((unit > 0) * 2 - 1) @ (m[:50] @ turn).T * (norm / fit / 8)[:, None]
    bound = (norm * ann.EPSILON * np.sqrt(1 - fit * fit) / fit / np.sqrt(63))[:, None] * norm[None, :50]
    exact = m @ m[:50].T
    assert (np.abs(guess - exact) <= bound).mean() > 0.97
    floor = np.sort(exact, axis=0)[-20]
    assert (guess + bound >= floor[None, :]).mean() < 0.25


def test_repeated_ids_ties_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 8)
    rows = [(i, [float(i % 3), 1.0]) for i in range(40)] + [(0, [9.0, 9.0]), (None, [1.0, 1.0]), (50, None), (51, []), (52, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit(1)).withColumn("score", F.lit(2.0)).withColumn("norm", F.lit("x"))
    got = ann.search(v, F.col("vec_id") % 20 == 0, k=3).collect()
    at = lambda q: [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert at(20)[:1] == [(1, 0)] and len(at(20)) == 3
    assert ann.search(v.limit(0), F.col("vec_id") % 20 == 0, k=3).count() == 0


def test_recall_above_the_sample(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 64)
    m = np.random.default_rng(8).standard_normal((3000, 64)).astype(np.float32).astype(float)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<float>")
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    want = {(q, int(i)) for q in range(0, 3000, 50) for i in np.argsort(-s[q])[:10]}
    got = {(r.query_id, r.vec_id) for r in ann.search(v, F.col("vec_id") % 50 == 0, k=10).collect()}
    assert len(want & got) >= 0.9 * len(want)
