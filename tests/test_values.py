"""Ranks, quantiles, curves and lookups on value tables, whole and cut into blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels as K
from tidemark.operators import metrics as M
from tidemark.operators import policy as P
from tidemark.plans import values as V
from tidemark.plans.blocks import plan_blocks


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    # One cohort holds most rows, and one value most of that cohort.
    return [(f"e{i}", rnd.choice(["a", "a", "a", "b", "c"]) if i else "lone", float(rnd.choice([0, 0, 0, 1, 2, rnd.randrange(100)])), rnd.choice([0, 0, 1, -1]))
            for i in range(300)]


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, "event_id string, g string, v double, y int")


def test_hot_groups_are_cut(df, mode):
    plan = plan_blocks(df, ["g"], "v")
    assert bool(plan.cuts) == (mode == "cut")
    if plan.cuts:
        blocks = plan.with_block(plan.split(df, F.lit(True))[0], "v").groupBy("g", "v").agg(F.countDistinct("__blk").alias("n"))
        assert blocks.filter("n > 1").count() == 0
        assert bool(V.hot_values(df, ["g", "v"]))


def test_pct_rank(df, rows, mode):
    got = {r["event_id"]: r["p"] for r in V.pct_rank(df, F.col("v"), "p", by=["g"]).collect()}
    for e, g, v, _ in rows:
        peers = [x[2] for x in rows if x[1] == g]
        want = 0.5 if len(peers) == 1 else (sum(x < v for x in peers) + (sum(x == v for x in peers) - 1) / 2) / (len(peers) - 1)
        assert got[e] == pytest.approx(want)


def test_quantiles(df, rows, mode):
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r["g"], r["q_idx"]): r["value"] for r in V.exact_quantiles(df, F.col("v"), qs, by=["g"]).collect()}
    for g in "abc":
        want = np.quantile([x[2] for x in rows if x[1] == g], qs)
        for i, w in enumerate(want):
            assert got[(g, i)] == pytest.approx(w)


def test_rank_against(df, rows, mode):
    ref = df.filter("event_id < 'e2'")
    ref_rows = [r for r in rows if r[0] < "e2"]
    for r in V.rank_against(df, ref, F.col("v"), F.col("v"), by=["g"], neighbours=True).collect():
        peers = [x[2] for x in ref_rows if x[1] == r["g"]]
        assert (r["n_less"], r["n_equal"], r["n_ref"]) == (sum(x < r["v"] for x in peers), sum(x == r["v"] for x in peers), len(peers))
        assert r["ref_prev"] == max((x for x in peers if x < r["v"]), default=None)
        assert r["ref_next"] == min((x for x in peers if x >= r["v"]), default=None)


def test_metrics(df, rows, mode):
    known = [(v, y) for _, _, v, y in rows if y >= 0]
    pos, neg = [v for v, y in known if y], [v for v, y in known if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert M.roc_auc(df, "v").first()["roc_auc"] == pytest.approx(auc)
    got = M.recall_at_fpr(df, 0.05, "v").first()
    k = int(0.05 * len(neg))
    t = sorted(neg)[len(neg) - k]
    if sum(n >= t for n in neg) > k:
        t = min(n for n in neg if n > t)
    assert got["recall"] == pytest.approx(np.mean([p >= t for p in pos]))
    assert got["realised_fpr"] == pytest.approx(np.mean([n >= t for n in neg]))


@pytest.mark.parametrize("scores, budget, threshold, alerts, overflow", [
    ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 0.2, 9, 2, False),
    ([1] * 8 + [5, 5], 0.1, 5, 2, True),      # the top tie alone exceeds the budget: published, not hidden
    ([1] * 5 + [5, 5, 5, 5, 9], 0.3, 9, 1, False),  # the k-th row sits in a tie: the next score up
    ([3] * 10, 0.2, 3, 10, True),
    ([1, 2, 3], 0.1, 3, 0, False),             # less than one alert
])
def test_capacity(spark, scores, budget, threshold, alerts, overflow, mode):
    df = spark.createDataFrame([(float(s),) for s in scores], "s double")
    got = P.capacity_threshold(df, "s", F.lit(budget)).first()
    assert (got["threshold"], got["n_alerts"], got["overflow"]) == (threshold, alerts, overflow)


def test_running_kernels(spark, mode):
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["h", "h", "h", "x", ""]), rnd.randrange(0, 30) * 10, rnd.choice("pqr")) for i in range(150)]
    df = spark.createDataFrame(rows, "event_id long, k string, ts_us long, v string")
    hhi = {r["event_id"]: r["o"] for r in K.running_herfindahl(df, "k", "v", "o").collect()}
    ent = {r["event_id"]: r["o"] for r in K.running_distinct(df, "k", "v", "o").collect()}
    run = {r["event_id"]: r["o"] for r in K.run_length(df, "k", F.col("v") != "r", "o").collect()}
    modal = {r["event_id"]: r["o"] for r in K.modal_value(df, "k", "v", "o").collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    for r in order:
        prior = [p for p in order if p[1] == r[1] != "" and (p[2], p[0]) < (r[2], r[0])]
        vals = [p[3] for p in prior]
        want = sum((vals.count(x) / len(vals)) ** 2 for x in set(vals)) if vals else -1.0
        assert hhi[r[0]] == pytest.approx(want)
        assert ent[r[0]] == len(set(vals))
        length = 0
        for x in reversed(vals):
            if x == "r":
                break
            length += 1
        assert run[r[0]] == length
        whole = [p[3] for p in order if p[1] == r[1]]
        assert modal[r[0]] == ("" if r[1] == "" else max(whole, key=lambda x: (whole.count(x), -whole.index(x))))


def test_resampled_counts_are_poisson_and_repeatable(spark):
    """Draws depend on the key alone, and their mean and variance are those of Poisson(n) at every size."""
    from tidemark.operators import metrics as M

    sizes = [1, 3, 15, 16, 40, 300, 4095, 5000, 40_000]
    cells = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "k int, n long")
    got = M.replicate_counts(cells, ["k"], "n", 600, 3)
    again = M.replicate_counts(cells.repartition(5), ["k"], "n", 600, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    by = {n: [r["w"] for r in got.collect() if r["n"] == n and r["rep"] > 0] for n in sizes}
    for n, w in by.items():
        mean = sum(w) / len(w)
        var = sum((x - mean) ** 2 for x in w) / len(w)
        assert len(w) == 600 and abs(mean - n) < 5 * (n / 600) ** 0.5 and 0.75 * n < var < 1.3 * n, n
    assert [r["w"] for r in got.filter("rep = 0").orderBy("k").collect()] == sizes


def test_three_arms(spark):
    import random

    from tidemark.operators import metrics as M

    rnd = random.Random(4)
    rows = []
    for i in range(900):
        y = int(rnd.random() < 0.2)
        rows.append((i, y if i % 11 else -1, round(0.5 * y + 0.5 * rnd.random(), 3), round(0.1 * y + 0.9 * rnd.random(), 3), round(0.5 * y + 0.5 * rnd.random(), 3)))
    df = spark.createDataFrame(rows, "event_id long, y long, a double, b double, d double")
    out = {r["arm"]: r for r in M.controlled_comparison(df, "a", ["b", "d"], 0.05, replicates=80).collect()}
    assert set(out) == {"b", "d"} and all(r["replicates"] == 80 and r["lo"] <= r["hi"] for r in out.values())
    assert out["b"]["reported_as"] == "effect" and out["b"]["delta"] > 0.3
    assert out["d"]["lo"] - 0.05 <= out["d"]["delta"] <= out["d"]["hi"] + 0.05
