"""Similarity against brute force."""

import numpy as np
import pytest

from siltstone.operators import similarity


def unit(n, d=16, seed=3):
    m = np.random.default_rng(seed).standard_normal((n, d))
    return m / np.linalg.norm(m, axis=1)[:, None]


def table(spark, m):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("rows", [None, 200_001])
def test_pairs_over_are_all_found_at_every_size(spark, rows):
    """`rows` stands in for a large table: no size may lose pairs."""
    m = unit(300)
    s = m @ m.T
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.4}
    got = similarity.pairs_over(table(spark, m), 0.4, rows=rows).collect()
    assert len(got) == len(want) and {(r.i, r.j) for r in got} == want
    assert all(abs(r["sim"] - s[r.i, r.j]) < 1e-9 for r in got)


def test_strips_and_blocks_meet_every_pair(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 50)
    monkeypatch.setattr(similarity, "STRIP", 7)
    m = unit(120)
    s = m @ m.T
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 0.3}
    got = similarity.pairs_over(table(spark, m), 0.3).collect()
    assert len(got) == len(want) and {(r.i, r.j) for r in got} == want


def test_two_distractors_are_found_however_far(spark, monkeypatch, tmp_path):
    """An outlier has no neighbour of another label at 0.2 and gets its two all the same; copies of a text count once."""
    from siltstone.plans.curation import knn_topk_distinct

    monkeypatch.setattr(similarity, "BLOCK", 40)
    monkeypatch.setattr(similarity, "STRIP", 7)
    rng = np.random.default_rng(5)
    m = unit(90, d=64)
    m[:30] = np.eye(64)[0] * 0.95 + m[:30] * 0.05
    m[:, 63] *= 0.1
    m[30] = np.eye(64)[63]
    m /= np.linalg.norm(m, axis=1)[:, None]
    label = [7 if i < 30 else int(rng.integers(0, 3)) for i in range(90)]
    label[30] = 9
    text = [f"text {i if i % 3 else i // 30}" for i in range(90)]
    spark.createDataFrame([(i, v.tolist(), label[i]) for i, v in enumerate(m)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(text)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    m = m.astype(np.float32).astype(float)
    s = np.round(m @ m.T, 6)
    want = set()
    for q in range(90):
        seen = {text[q]}
        for i in sorted(range(90), key=lambda i: (-s[q, i], i)):
            if label[i] != label[q] and text[i] not in seen:
                seen.add(text[i])
                want.add((q, i, len(seen) - 1))
            if len(seen) == 3:
                break
    got = knn_topk_distinct(spark, str(tmp_path)).collect()
    assert {(r.q, r.id, r["rank"]) for r in got} == want and len(got) == 180
    assert max(s[30, i] for q, i, _ in want if q == 30) < 0.2
