"""Drift signals and fidelity checks on whole windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.labels import unpivot_features
from tidemark.plans.cut import written
from tidemark.plans.values import exact_quantiles, settled

c = F.col

# Drift thresholds.
PSI_LIMIT, SHIFT_LIMIT, NULL_EXPLAINED, CANARY_DROP = 0.20, 0.03, 0.60, 0.02
FLOOR = 1e-6


def psi(reference: DataFrame, current: DataFrame, features: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Population stability index per feature over the reference's quantile bins.

    Values outside the reference range fall in no bin; fewer than 20 rows on a side, or fewer than two
    bins, give 0.
    """
    ref, cur = unpivot_features(reference, features), unpivot_features(current, features)
    ref, cur = (d.filter(c("value").isNotNull() & ~F.isnan("value")) for d in (ref, cur))
    q = exact_quantiles(ref, c("value"), [i / n_bins for i in range(n_bins + 1)], by=["feature"])
    edges = q.groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("edges"))  # n_bins + 1 values each
    both = ref.withColumn("side", F.lit("r")).unionByName(cur.withColumn("side", F.lit("c"))).join(F.broadcast(edges), "feature")
    last = F.size("edges") - 1
    at = F.size(F.filter("edges", lambda e: e <= c("value")))
    # Bins are closed on the left; the last one on both sides.
    bin_ = F.when(c("value") == F.element_at("edges", -1), last).otherwise(at)
    binned = both.withColumn("bin", F.when((bin_ >= 1) & (bin_ <= last), bin_)).groupBy("feature", "side", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.max(last).alias("n_edges"))
    total = binned.groupBy("feature", "side").agg(F.sum("n").alias("rows"), F.sum(F.when(c("bin").isNotNull(), c("n")).otherwise(0)).alias("kept"), F.max("n_edges").alias("bins"))
    sizes = total.groupBy("feature").agg(*[F.max(F.when(c("side") == s, c(v))).alias(f"{s}_{v}") for s in "rc" for v in ("rows", "kept")], F.max("bins").alias("bins"))
    grid = sizes.withColumn("bin", F.explode(F.sequence(F.lit(1), F.greatest(c("bins"), F.lit(1)))))
    wide = binned.filter(c("bin").isNotNull()).groupBy("feature", "bin").agg(*[F.sum(F.when(c("side") == s, c("n")).otherwise(0)).alias(s) for s in "rc"])
    joined = grid.join(wide, ["feature", "bin"], "left").fillna({"r": 0, "c": 0})
    share = lambda s: F.greatest(c(s) / F.greatest(F.coalesce(c(f"{s}_kept"), F.lit(0)), F.lit(1)), F.lit(FLOOR))
    part = (share("c") - share("r")) * F.ln(share("c") / share("r"))
    usable = (F.coalesce(F.max("r_rows"), F.lit(0)) >= 20) & (F.coalesce(F.max("c_rows"), F.lit(0)) >= 20) & (F.max("bins") >= 2)
    return joined.groupBy("feature").agg(F.when(usable, F.sum(part)).otherwise(0.0).alias("psi"))


def conformal_shift(reference: DataFrame, current: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Share of p at or below alpha in both windows and its change; zeros below 20 rows on a side."""
    mass = lambda d, n: d.agg(F.count(F.lit(1)).alias(f"n_{n}"), F.avg(S.flag(c(p) <= alpha)).alias(n))
    both = mass(reference, "reference_mass").crossJoin(F.broadcast(mass(current, "current_mass")))
    ok = (c("n_reference_mass") >= 20) & (c("n_current_mass") >= 20)
    keep = lambda v: F.when(ok, v).otherwise(0.0)
    return both.select(keep(c("reference_mass")).alias("reference_mass"), keep(c("current_mass")).alias("current_mass"),
                       keep(c("current_mass") - c("reference_mass")).alias("shift"))


def freeze_canaries(rows: DataFrame, key: str, n: int = 200) -> DataFrame:
    """The n rows with the smallest id hash: the same probes whenever they are drawn."""
    return rows.orderBy(S.hash_bits(c(key), "canary", 15), key).limit(n)


def canary_history(scored: DataFrame, version: str, score: str) -> DataFrame:
    """Mean and 90th percentile of the probe scores per model version."""
    means = scored.groupBy(version).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))
    p90 = exact_quantiles(scored, c(score), [0.9], by=[version]).select(version, c("value").alias("p90_score"))
    return means.join(p90, version)


def canary_degradation(history: DataFrame, version: str, min_versions: int = 3) -> DataFrame:
    """Monotone decline of the probe mean by more than 0.02 over at least three versions."""
    # One row per model version: a handful, whatever the traffic.
    w = Window.partitionBy(F.lit(0)).orderBy(version)
    steps = history.withColumn("before", F.lag("mean_score").over(w))
    out = steps.agg(F.count(F.lit(1)).alias("n_versions"), F.max(S.flag(c("mean_score") > c("before") + 1e-12)).alias("rose"),
                    F.min_by("mean_score", version).alias("first"), F.max_by("mean_score", version).alias("last"))
    monotone = F.coalesce(c("rose"), F.lit(0.0)) == 0
    drop = c("first") - c("last")
    return out.select("n_versions", monotone.alias("monotone_decline"), drop.alias("total_drop"),
                      (monotone & (drop > CANARY_DROP) & (c("n_versions") >= min_versions)).alias("detected"))


def drift_conjunction(observed: DataFrame, benign_null: DataFrame, shift: DataFrame, canary: DataFrame) -> DataFrame:
    """Fires only when unexplained feature drift, a conformal shift and a canary decline hold together."""
    joined = observed.join(benign_null.select("feature", c("psi").alias("null_psi")), "feature", "left")
    explained = F.when(c("psi") > 1e-9, F.coalesce("null_psi", F.lit(0.0)) / F.nullif(c("psi"), F.lit(0.0))).otherwise(1.0)
    unexplained = (c("psi") >= PSI_LIMIT) & (explained < NULL_EXPLAINED)
    drift = joined.agg(F.sum(unexplained.cast("long")).alias("n_unexplained"), F.count(F.lit(1)).alias("n_features"))
    flags = drift.crossJoin(F.broadcast(shift.select("shift"))).crossJoin(F.broadcast(canary.select("detected")))
    a, b, d = c("n_unexplained") > 0, c("shift") >= SHIFT_LIMIT, c("detected")
    n = a.cast("int") + b.cast("int") + d.cast("int")
    return flags.select("n_features", "n_unexplained", "shift", a.alias("drift_fired"), b.alias("conformal_fired"), d.alias("canary_fired"),
                        n.alias("n_signals"), (n == 3).alias("fired"))


# --- fidelity ------------------------------------------------------------------------------------------


def band_check(df: DataFrame, check: str, gate: str, lo: float, hi: float, value: str = "measured") -> DataFrame:
    """PASS/FAIL of one measured value against its band; SKIPPED without a measurement."""
    v = c(value)
    status = F.when(v.isNull(), "SKIPPED").when((v >= lo) & (v <= hi), "PASS").otherwise("FAIL")
    return df.select(F.lit(check).alias("check"), F.lit(gate).alias("gate"), v.cast("double").alias("measured"), F.lit(float(lo)).alias("lo"),
                     F.lit(float(hi)).alias("hi"), status.alias("status"))


def atom_share(df: DataFrame, amount: str, atoms: Sequence[float]) -> DataFrame:
    near = F.least(*[F.abs(c(amount) - float(a)) for a in atoms]) < 0.5
    return df.filter(c(amount) > 0).agg(F.avg(S.flag(near)).alias("measured"))


def benford_deviation(df: DataFrame, amount: str) -> DataFrame:
    """Sum of absolute deviations of the first-digit shares (amounts of at least 1) from Benford's law."""
    v = F.greatest(c(amount), F.lit(1.0))
    digit = F.floor(c(amount) / F.pow(F.lit(10.0), F.floor(F.log10(v)))).cast("int")
    rows = df.filter(c(amount) > 0).select(digit.alias("d")).filter("d between 1 and 9")
    shares = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(S.flag(c("d") == k)).alias(f"s{k}") for k in range(1, 10)])
    dev = sum((F.abs(c(f"s{k}") - F.log10(F.lit(1.0 + 1.0 / k))) for k in range(2, 10)), F.abs(c("s1") - F.log10(F.lit(2.0))))
    return shares.select(F.when(c("n") > 0, dev).otherwise(1.0).alias("measured"))


def weekday_share(df: DataFrame, dow: str) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    return df.groupBy(dow).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select(dow, "n", (c("n") / c("__n")).alias("share"))


def volume_multiplier(day_index: Column, cfg) -> Column:
    """Calendar multiplier of a day: weekday x payday x festival ramp.  ``cfg`` is a ``FeatureConfig``."""
    # Monday to Sunday, payday and festival peak multipliers.
    weekday = (0.94, 0.96, 1.00, 1.06, 1.18, 1.24, 1.02)
    date = F.date_add(F.lit(cfg.start_date).cast("date"), day_index.cast("int"))
    start, peak, end = cfg.festival
    d = day_index.cast("double")
    climb = F.when(d <= peak, (d - start) / max(1, peak - start)).otherwise(1.0 - (d - peak) / max(1, end - peak))
    festival = F.when((d < start) | (d > end), 1.0).otherwise(1.0 + 0.9 * F.greatest(F.least(climb, F.lit(1.0)), F.lit(0.0)))
    payday = F.when(F.dayofmonth(date).isin(*cfg.payday_days), 1.35).otherwise(1.0)
    return S.mapped(F.weekday(date), dict(enumerate(weekday))) * payday * festival


def expected_weekday_share(days: DataFrame, day_index: str, cfg) -> DataFrame:
    """Calendar-weighted share per weekday over the distinct days present."""
    m = days.select(c(day_index).alias("d")).distinct().withColumn("m", volume_multiplier(c("d"), cfg))
    date = F.date_add(F.lit(cfg.start_date).cast("date"), c("d").cast("int"))
    per = m.groupBy(F.weekday(date).alias("dow")).agg(F.sum("m").alias("m"))
    total = per.agg(F.sum("m").alias("t"))
    return per.crossJoin(F.broadcast(total)).select("dow", (c("m") / c("t")).alias("expected_share"))


def weekday_peak(df: DataFrame, dow: str, day_index: str, cfg) -> DataFrame:
    """Distance between the weekday with most rows and the one the calendar expects most on; 0 is agreement."""
    seen = df.groupBy(dow).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by(c(dow), F.struct(c("n"), -c(dow))).alias("seen"))
    due = expected_weekday_share(df, day_index, cfg).agg(F.max_by(c("dow"), F.struct(F.round("expected_share", 12), -c("dow"))).alias("due"))
    return seen.crossJoin(F.broadcast(due)).select(F.abs(c("seen") - c("due")).cast("double").alias("measured"))


def payday_share(df: DataFrame, day_index: str, cfg) -> DataFrame:
    date = F.date_add(F.lit(cfg.start_date).cast("date"), c(day_index).cast("int"))
    return df.agg(F.avg(S.flag(F.dayofmonth(date).isin(*cfg.payday_days))).alias("measured"))


def top_share(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Share of rows held by the k largest values of the key."""
    counts = df.filter(c(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), key).limit(k).agg(F.sum("n").alias("t"))
    return top.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("n")))).select((c("t") / c("n")).alias("measured"))


def conditional_share(df: DataFrame, scope: Column, cond: Column, minimum: int) -> DataFrame:
    """Share of the scope's rows that satisfy the condition; null below the minimum row count."""
    rows = df.filter(scope)
    return rows.agg(F.when(F.count(F.lit(1)) > minimum, F.avg(S.flag(cond))).alias("measured"))


def bounded_correlation(df: DataFrame, a: Column, b: Column, minimum: int = 100) -> DataFrame:
    """Absolute correlation; null below the minimum row count, not a number (no division by zero) where a side is constant."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    share = F.when(spread == 0, F.lit(float("nan"))).otherwise(F.abs(F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))))
    return df.agg(F.when(F.count(F.lit(1)) > minimum, share).alias("measured"))


def summarise_checks(checks: DataFrame) -> DataFrame:
    """Per gate: counts by status and the pass rate of what was checked."""
    n = lambda s: F.sum((c("status") == s).cast("long"))
    return checks.groupBy("gate").agg(n("PASS").alias("passed"), n("FAIL").alias("failed"), n("SKIPPED").alias("skipped"),
                                      (n("PASS") / F.nullif(n("PASS") + n("FAIL"), F.lit(0))).alias("pass_rate"))


def shuffled_marginals(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Rows whose columns were permuted independently: same marginals, no joint structure.

    Column i takes the value of the row with the same position in another stable hash order.  Both
    orders are positions from blocked running counts, joined on the position: no single-task sort.
    """
    from tidemark.plans.ordered import Running, ordered

    df = settled(df.select(key, *columns))  # each column's order counts and reads it anew

    def placed(salt: str, *keep: str) -> DataFrame:
        h = df.select(key, *keep).withColumns({"__all": F.lit(0), "__h": S.hash_bits(c(key), salt, 15)})
        return ordered(h, ["__all"], ["__h", key], {"__pos": Running("count", F.lit(1))})
    out = placed("base").select(key, "__pos")
    for n in columns:
        out = out.join(placed(n, n).select("__pos", n), "__pos")
    return out.drop("__pos")


def discriminator_auc(real: DataFrame, other: DataFrame, features: Sequence[str], key: str, rounds: int = 5, max_depth: int = 3) -> DataFrame:
    """AUC of trees told to separate two samples, on a held-out 30 percent: 0.5 means indistinguishable."""
    from tidemark.operators import gbdt as G
    from tidemark.operators import metrics as M

    rows = real.select(key, *features).withColumn("y", F.lit(1)).unionByName(other.select(key, *features).withColumn("y", F.lit(0)))
    marked = written(rows.withColumns({"w": F.lit(1.0), "y_fit": c("y"), "fit": S.hash_unit(F.concat_ws(":", c("y").cast("string"), c(key).cast("string")), "two") < 0.7}))
    model = G.fit(marked.filter("fit"), features, config=G.TreeConfig(rounds=rounds, depth=max_depth, rate=0.3, directions={}), key=key)
    return M.roc_auc(G.predict(model, marked.filter("not fit")), "g1")
