"""Statistics without SQL against plain Python."""

import math
import random

import numpy as np
import pytest

from siltstone.operators import stats
from siltstone.plans import reports


def plain_interval(values, n_boot=4000):
    x = np.asarray(values)
    m = x[np.random.default_rng(7).integers(0, len(x), (n_boot, len(x)))].mean(axis=1)
    return np.percentile(m, [2.5, 97.5])


@pytest.mark.parametrize("chunk", [4_096, 5])
def test_bootstrap_intervals(spark, monkeypatch, chunk):
    """Few and many distinct values, in one chunk and in several; a null doesn't count."""
    monkeypatch.setattr(stats, "VALUES", chunk)
    rng = random.Random(1)
    groups = {"few": [rng.choice([0.0, 0.2, 1.0]) for _ in range(300)], "many": [rng.gauss(3, 1) for _ in range(200)], "same": [0.5] * 40}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    got = {r.g: r for r in stats.bootstrap_ci(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        lo, hi = plain_interval(vs)
        assert got[g].n == len(vs) and got[g].mean == pytest.approx(np.mean(vs))
        assert got[g].lo == pytest.approx(lo, abs=0.1 * (hi - lo) + 1e-9) and got[g].hi == pytest.approx(hi, abs=0.1 * (hi - lo) + 1e-9)


def test_bootstrap_is_the_same_again_whatever_the_partitions(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("a", rng.random()) for _ in range(500)], "g string, v double")
    one, two = (stats.bootstrap_ci(d, ["g"], "v", n_boot=600).collect() for d in (df, df.repartition(7)))
    assert one[0].lo == pytest.approx(two[0].lo, rel=1e-12) and one[0].hi == pytest.approx(two[0].hi, rel=1e-12)


def test_bootstrap_of_nothing(spark):
    assert stats.bootstrap_ci(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


SF = "/root/testdata/sf0.001"


def clean(spark):
    from siltstone.sources import tables

    return [r.asDict() for r in tables.scores(spark, SF).collect()]


def test_intervals_of_every_query_over_whole_tables(spark):
    """Counts and means of all items, and intervals about the means."""
    rows = clean(spark)
    by = {}
    for r in rows:
        if r["cond"] == "clean":
            by.setdefault(r["version"], {})[r["pair_id"]] = r["f1"]
    got = {r.version: r for r in reports.bootstrap_ci(spark, SF).collect()}
    assert set(got) == set(by)
    for v, items in by.items():
        x = list(items.values())
        lo, hi = plain_interval(x)
        assert (got[v].n, round(got[v].mean, 9)) == (len(x), round(float(np.mean(x)), 9)) and abs(got[v].lo - lo) + abs(got[v].hi - hi) < 0.3 * (hi - lo)
    order = sorted(by, key=lambda v: (-np.mean(list(by[v].values())), v))
    pairs = {(r.a, r.b): r for r in reports.paired_delta_ci(spark, SF).collect()}
    assert set(pairs) == {(a, b) for i, a in enumerate(order) for b in order[i + 1 :]}
    for (a, b), r in pairs.items():
        d = [by[a][k] - by[b][k] for k in by[a].keys() & by[b].keys()]
        assert r.n == len(d) and r["mean"] == pytest.approx(np.mean(d)) and r.lo <= r["mean"] <= r.hi and r.significant == (r.lo > 0 or r.hi < 0)
    gaps = {(r.version, r.gap): r for r in reports.paired_gap_ci(spark, SF).collect()}
    at = {(r["version"], r["cond"], r["pair_id"]): r["f1"] for r in rows}
    for (v, gap), r in gaps.items():
        a, b = ("realistic", "closed_book") if gap == "grounding" else ("clean", "realistic")
        d = [x - at[v, b, k] for (w, c, k), x in at.items() if w == v and c == a and (v, b, k) in at]
        assert r.n == len(d) and r["mean"] == pytest.approx(np.mean(d))
    found = {(r.version, r.cond, r.metric): r for r in reports.cond_intervals(spark, SF).collect()}
    rewards = {}
    for r in rows:
        if r["reward"] is not None:
            rewards.setdefault((r["version"], r["cond"], "reward"), []).append(r["reward"])
    assert {k for k in found if k[2] == "reward"} == set(rewards) and all(found[k].n == len(x) for k, x in rewards.items())


def test_p_values(spark):
    def normal(z):
        return math.erfc(abs(z) / math.sqrt(2))

    for r, w in zip(sorted(reports.signed_rank_p(spark, SF).collect(), key=lambda r: r.test), sorted(reports.signed_rank_w(spark, SF).collect(), key=lambda r: r.test), strict=True):
        assert r.p == pytest.approx(normal(w.z or 0.0)) and r.p_holm <= 1
    for r in reports.mcnemar_p(spark, SF).collect():
        n = r.b + r.c
        if n < 25:
            want = min(1.0, sum(math.comb(n, i) for i in range(min(r.b, r.c) + 1)) / 2 ** (n - 1)) if n else 1.0
        else:
            want = normal(math.sqrt((abs(r.b - r.c) - 1) ** 2 / n))
        assert r.p == pytest.approx(want)
    assert stats.mcnemar_p(3, 3) == 1.0 and stats.mcnemar_p(0, 6) == pytest.approx(2 / 64)
