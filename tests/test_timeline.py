"""Every causal column against a brute-force loop, on rows with ties, blanks and a hub key."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import timeline as T

HOUR = 3_600_000_000
W = 7200


def make_rows(n=180, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = rnd.choice(["hub", "hub", "hub", "a", "b", ""])
        rows.append((f"e{i:04d}", key, rnd.randrange(0, 24) * HOUR // 2 + 1, rnd.choice(["x", "y", "z", "q", ""]),
                     float(rnd.randrange(0, 50)), rnd.random() < 0.4))
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, "event_id string, k string, ts_us long, cp string, v double, f boolean")


def history(rows):
    """(row, earlier rows of the same key) in stream order."""
    out = {}
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    for r in ordered:
        prior = [p for p in ordered if p[1] == r[1] and r[1] != "" and (p[2], p[0]) < (r[2], r[0])]
        out[r[0]] = (r, prior)
    return out


def inside(r, prior, seconds=W):
    return [p for p in prior if p[2] >= r[2] - seconds * 1_000_000]


def got(frame, name):
    return {r["event_id"]: r[name] for r in frame.select("event_id", name).collect()}


def test_prefix_and_trailing(df, rows, mode):
    out = (
        T.Timeline(df, "k")
        .prev("p", F.col("v")).next("nx", F.col("v")).last_n("l5", F.col("v"), 5)
        .last_where("lw", F.col("f"), F.col("ts_us")).running("rs", "sum", F.col("v"))
        .running("mx", "max", F.col("v")).running("ct", "count", F.lit(1), inclusive=True)
        .trailing_sum("s", F.col("v"), W).trailing_count("c", W).trailing_count("c1", 3600)
        .build().persist()
    )
    assert out.count() == len(rows)
    h = history(rows)
    later = {e: None for e in h}
    for e, (r, prior) in h.items():
        if prior:
            later[prior[-1][0]] = r[4]
    cols = {n: got(out, n) for n in ("p", "nx", "l5", "lw", "rs", "mx", "ct", "s", "c", "c1")}
    for e, (r, prior) in h.items():
        assert cols["p"][e] == (prior[-1][4] if prior else None)
        assert cols["nx"][e] == later[e]
        assert [x["v"] for x in cols["l5"][e]] == [p[4] for p in prior[-5:]]
        flagged = [p[2] for p in prior if p[5]]
        assert cols["lw"][e] == (flagged[-1] if flagged else None)
        assert cols["rs"][e] == sum(p[4] for p in prior)
        assert cols["mx"][e] == (max(p[4] for p in prior) if prior else None)
        assert cols["ct"][e] == len(prior) + 1
        assert cols["s"][e] == pytest.approx(sum(p[4] for p in inside(r, prior)))
        assert cols["c"][e] == len(inside(r, prior))
        assert cols["c1"][e] == len(inside(r, prior, 3600))
    out.unpersist()


def test_distinct(df, rows, mode):
    out = T.trailing_distinct(df, ["k"], "cp", {"d2h": W, "d1h": 3600})
    a, b = got(out, "d2h"), got(out, "d1h")
    for e, (r, prior) in history(rows).items():
        assert a[e] == len({p[3] for p in inside(r, prior)} - {""})
        assert b[e] == len({p[3] for p in inside(r, prior, 3600)} - {""})


def test_max(df, rows, mode):
    out = got(T.trailing_max(df, ["k"], F.col("v"), W, "m"), "m")
    for e, (r, prior) in history(rows).items():
        frame = [p[4] for p in inside(r, prior)]
        assert out[e] == (max(frame) if frame else None)


def test_novelty(df, rows, mode):
    out = got(T.novelty(df, ["k"], ["cp"], "n"), "n")
    for e, (r, prior) in history(rows).items():
        assert out[e] == (1.0 if r[1] != "" and r[3] not in {p[3] for p in prior} else 0.0)


def test_later_rows_change_nothing(spark, df, rows):
    cutoff = sorted(r[2] for r in rows)[100]
    early = df.filter(F.col("ts_us") <= cutoff)
    build = lambda d: got(T.Timeline(d, "k").trailing_sum("s", F.col("v"), W).build(), "s")
    full = build(df)
    for e, s in build(early).items():
        assert s == pytest.approx(full[e])


def test_trailing_sums_do_not_depend_on_the_plan(spark):
    """Large values leave no residue, and cutting the key changes no bit."""
    rnd = random.Random(5)
    rows = [(f"e{i:04d}", "hub", i * HOUR // 4, 1e9 if i in (40, 41, 200) else rnd.choice([2.5, 0.1, 3.7])) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id string, k string, ts_us long, v double")
    whole = got(T.Timeline(df, "k").trailing_sum("s", F.col("v"), W).build(), "s")
    spark.conf.set("spark.tidemark.blocks.targetRows", "12")
    cut = got(T.Timeline(df, "k").trailing_sum("s", F.col("v"), W).build(), "s")
    spark.conf.unset("spark.tidemark.blocks.targetRows")
    assert whole == cut
    for i, r in enumerate(rows):
        want = sum(p[3] for p in rows[max(0, i - 8):i])
        assert whole[r[0]] == pytest.approx(want, rel=1e-12)


def test_one_plan_serves_derived_frames(spark, rows, df):
    from tidemark.plans import blocks

    spark.conf.set("spark.tidemark.blocks.targetRows", "12")
    plain = got(T.trailing_distinct(df, ["k"], "cp", {"d": W}), "d")
    counted = []
    real = blocks.count_and_cut
    blocks.count_and_cut = lambda *a: counted.append(a[1]) or real(*a)
    try:
        with blocks.planning(df):
            shared = got(T.trailing_distinct(df, ["k"], "cp", {"d": W}), "d")
            again = got(T.Timeline(df, "k").trailing_count("n", W).prev("p", F.col("v")).build(), "n")
    finally:
        blocks.count_and_cut = real
        spark.conf.unset("spark.tidemark.blocks.targetRows")
    assert shared == plain and len(again) == len(rows)
    assert sorted(counted) == [("k",), ("k", "cp")]


def test_velocity_ranks_of_amount_sums(spark):
    """Cohort ranks of trailing counts and sums, on amounts that binary numbers hold exactly."""
    from tidemark.operators.kernels import velocity_panel

    rnd = random.Random(8)
    rows = [(f"e{i:03d}", rnd.choice("abc"), rnd.randrange(0, 40) * HOUR, rnd.choice("xyz"), rnd.randrange(0, 40) / 4, rnd.choice("pq")) for i in range(150)]
    df = spark.createDataFrame(rows, "event_id string, k string, ts_us long, cp string, amount_inr double, _cohort string")
    frames = velocity_panel(df, {"k": "cp"}, windows=["1h", "24h"])
    ranks = {r["event_id"]: r for r in next(f for f in frames if "vel_k_24h_amount_sum_pct" in f.columns).collect()}
    sums = {e: sum(p[4] for p in inside(r, prior, 86_400)) for e, (r, prior) in history([(*r[:5], False, r[5]) for r in rows]).items()}
    cohort = {r[0]: r[5] for r in rows}
    for e, s in sums.items():
        peers = [sums[x] for x in sums if cohort[x] == cohort[e]]
        assert ranks[e]["vel_k_24h_amount_sum_pct"] == pytest.approx((sum(x < s for x in peers) + (sum(x == s for x in peers) - 1) / 2) / (len(peers) - 1))
