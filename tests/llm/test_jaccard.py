"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from cases import edited, linked_roots, some_text
from pyspark.sql import functions as F

from siltstone.llm import jaccard


@pytest.mark.parametrize("percent", [50, 60, 80, 85, 95])
def test_jaccard_components_equal_brute_force(spark, docs, percent):
    rng = random.Random(percent)
    texts = [None, "", "  ", "one two", "One TWO", "one"]
    for _ in range(14):
        base = some_text(rng, rng.choice([3, 7, 12, 30, 60, 150, 300, 900])).split(" ")
        steps = max(1, len(base) * (100 - percent) // (100 + percent) // 4)
        texts += [edited(rng, base, e) for e in (0, 0, 1, 2, steps - 1, steps, steps + 1, 2 * steps)] + [" ".join(base[: -max(1, len(base) * (100 - percent) // 100)])]
    n, root = linked_roots(texts, 4, percent)
    assert len(set(root)) < len(texts) - 20
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.joined(docs(texts), 4, percent).collect()}
    assert got == dict(enumerate(zip(n, root, strict=True)))


def test_pairs_at_the_threshold_share_a_region():
    """Sets that differ in as many shingles as linked ones may, of all sizes and thresholds."""
    rng = np.random.default_rng(7)
    for percent in (50, 70, 80, 85, 90, 99):
        bands = jaccard.Bands(percent)
        for n in (2, 5, 9, 17, 40, 100, 333, 1000, 4000):
            m = int(rng.integers(n, n * 100 // percent + 1))
            both = -(-percent * (n + m) // (100 + percent))
            if both > n:
                continue
            pool = rng.integers(1, 1 << 63, n + m, dtype=np.uint64)
            sets = [np.sort(np.concatenate([pool[:both], pool[both + at : both + at + size - both]])) for at, size in ((0, n), (n - both, m))]
            key, who = bands.cells(np.concatenate(sets), np.array([0, n, n + m]), np.array([1, 2]))
            shared = np.intersect1d(key[who == 1], key[who == 2])
            limits = bands.limits()
            # In some projection they share more regions than either may leave.
            left = {p: c - limits[p] for p, c in zip(*np.unique((shared >> np.uint64(1)) & np.uint64(511), return_counts=True), strict=True)}
            assert n == m == both or max(left.values()) > 0, (percent, n, m)


@pytest.mark.parametrize("copies", [0, 100])
def test_jaccard_of_large_regions_equals_brute_force(spark, docs, monkeypatch, copies):
    """Regions of more members than a task joins: split by pivots and by blocks; and parts within a task."""
    for name, value in (("LEAF", 8), ("PIVOTS", 4), ("COPIES", copies), ("HOT", 3), ("PART", 4), ("PART_PIVOTS", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(6)
    base = some_text(rng, 120, 10**6).split(" ")
    # Edits at places of their own: many pairs lie about the threshold.
    texts = [edited(rng, base, rng.randrange(1, 5)) for _ in range(40)] + [edited(rng, base, 9) for _ in range(20)]
    _, root = linked_roots(texts, 4, 85)
    assert 1 < len(set(root)) < len(texts)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.joined(docs(texts), 4, 85).collect()} == dict(enumerate(root))


@pytest.mark.parametrize("shared", [20, 300, 480])
def test_voronoi_join_within_a_task_loses_no_pair(shared):
    """Sets with more or less in common: every pair that links is among those found."""
    rng = np.random.default_rng(shared)
    core = rng.integers(1, 1 << 63, 500, dtype=np.uint64)
    sets = []
    for _ in range(260):
        own = np.concatenate([rng.choice(core, shared, replace=False), rng.integers(1, 1 << 63, 500 - shared, dtype=np.uint64)])
        sets += [own] if rng.random() < 0.5 else [own, np.concatenate([own[25:], rng.integers(1, 1 << 63, int(rng.integers(0, 40)), dtype=np.uint64)])]
    n = np.array([len(x) for x in sets])
    cell = np.concatenate([i * jaccard.SKETCH_BITS + (x % np.uint64(jaccard.SKETCH_BITS)).astype(np.int64) for i, x in enumerate(sets)])
    odd = np.bincount(cell, minlength=len(sets) * jaccard.SKETCH_BITS).astype(np.uint8) & 1
    marks = np.packbits(odd.reshape(len(sets), -1), axis=1).view(np.uint64)
    i, j = jaccard.near_pairs(marks, n, np.arange(len(sets)), jaccard.Bands(85))
    got = {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist(), strict=True)}
    as_sets = [set(x.tolist()) for x in sets]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(as_sets[a] & as_sets[b]) >= 85 * len(as_sets[a] | as_sets[b])}
    assert want and want <= got and len(got) <= max(2 * len(want), len(sets) ** 2 * (shared > 400))


def test_keep_one_of_each_component(spark, docs):
    rng = random.Random(3)
    base = [some_text(rng, 80, 10**6).split(" ") for _ in range(5)]
    texts = [edited(rng, b, e) for b in base for e in (0, 0, 1, 6)] + [None, "", "a b"]
    _, root = linked_roots(texts, 5, 80)
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs(texts), 5, 80).collect()) == sorted(set(root))


def test_keep_one_with_clashing_names_and_repeated_rows(spark):
    text = "a b c d e f g h i j"
    rows = [(3, text, 1), (2, text, 2), (2, text, 3), (5, None, 4), (6, "", 5), (None, text, 6), (7, "other words stand here at last now", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _n int").withColumn("set", F.lit(0)).withColumn("gone_id", F.lit(1)).withColumn("n", F.lit(2)).withColumn("sid", F.lit(2))
    got = jaccard.keep_one(d, 5, 80)
    assert got.columns == d.columns
    assert sorted((r["doc_id"] for r in got.collect())) == [2, 5, 6, 7]


def test_jaccard_of_no_rows(spark, docs):
    assert jaccard.joined(docs([]), 4, 85).count() == 0
