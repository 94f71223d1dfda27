"""Training weights, novelty scores and model fitting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.plans.values import exact_quantiles, lookup, rank_against

c = F.col


# --- training weights ----------------------------------------------------------------------------------


def pu_expand(rows: DataFrame, prior: float, y: str = "y") -> DataFrame:
    """Labelled rows once with weight 1; unlabelled rows twice, as positive (prior) and negative (1 - prior)."""
    pi = min(max(prior, 1e-6), 0.5)
    pair = lambda label, w: F.struct(F.lit(label).alias("y_fit"), F.lit(float(w)).alias("w"))
    copies = F.when(c(y) == 1, F.array(pair(1, 1))).when(c(y) == 0, F.array(pair(0, 1))).otherwise(F.array(pair(1, pi), pair(0, 1 - pi)))
    return rows.withColumn("__p", F.explode(copies)).select("*", "__p.y_fit", "__p.w").drop("__p")


def cap_unlabelled(rows: DataFrame, cap: int, key: str = "event_id", y: str = "y") -> DataFrame:
    """A stable hash sample of the unlabelled rows of about ``cap`` rows: a fitting option, off by default."""
    total = rows.agg(F.sum((c(y) == -1).cast("long")).alias("__u"))
    share = F.least(F.lit(1.0), cap / F.greatest(c("__u"), F.lit(1)))
    return rows.crossJoin(F.broadcast(total)).filter((c(y) != -1) | (S.hash_unit(c(key), "pu") < share)).drop("__u")


def ipw_weight(p: Column, declined: Column, lo: float = 0.05, hi: float = 20.0) -> Column:
    """Inverse accept probability for accepted rows with a usable one, else 1, clipped."""
    valid = ~declined & (p > 0) & (p <= 1)
    return F.least(F.greatest(F.when(valid, 1.0 / F.nullif(p, F.lit(0.0))).otherwise(1.0), F.lit(lo)), F.lit(hi))


def ipw_report(rows: DataFrame, p: Column, declined: Column, lo: float = 0.05, hi: float = 20.0) -> DataFrame:
    raw = ipw_weight(p, declined, 0.0, float("inf"))
    w = ipw_weight(p, declined, lo, hi)
    valid = ~declined & (p > 0) & (p <= 1)
    clipped = (raw < lo) | (raw > hi)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(declined.cast("long")).alias("n_declined"), F.sum(clipped.cast("long")).alias("n_clipped"),
        F.avg(S.flag(clipped)).alias("share_clipped"), F.avg(F.when(valid, w)).alias("mean_weight"), F.max(w).alias("max_weight"))


def combined_weight(ipw: Column, maturity: Column) -> Column:
    return ipw * F.when(maturity > 0, maturity).otherwise(1.0)


def undersample(rows: DataFrame, beta: float, key: str = "event_id", y: str = "y_fit") -> DataFrame:
    """Keep all positives and a stable share beta of the negatives."""
    return rows.filter((c(y) == 1) | (S.hash_unit(c(key), "neg") < beta))


def prior_corrected(p: Column, beta: float) -> Column:
    """Undo undersampling of negatives on a predicted probability."""
    return p / (p + (1.0 - p) / beta)


def propensity_histogram(rows: DataFrame, p: str, bins: int = 20) -> DataFrame:
    """Counts of logged propensities on [0, 1]; rows without one (-1) are left out."""
    live = rows.filter(c(p) >= 0)
    index = F.least(F.floor(c(p) * bins), F.lit(bins - 1)).cast("int")
    return live.filter(c(p) <= 1).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def propensity_overlap(rows: DataFrame, p: str) -> DataFrame:
    live = rows.filter(c(p) >= 0)
    return live.agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("p_min"), F.max(p).alias("p_max"), F.avg(p).alias("p_mean"),
                    F.avg(S.flag(c(p) < 0.05)).alias("share_below"), F.avg(S.flag(c(p) > 0.95)).alias("share_above")).withColumn(
        "positivity_ok", (c("p_min") > 0) & (c("p_max") < 1))


# --- density -------------------------------------------------------------------------------------------


def ecod_raw(rows: DataFrame, fit: DataFrame, features: Sequence[str], key: str = "event_id") -> DataFrame:
    """(key, raw): sum over features of -log of the smaller empirical tail in the fit rows.

    Rows and fit rows are unpivoted to (feature, value); one rank lookup per distinct value serves all
    features, and the sum per row is a map-side combined aggregate.
    """
    def long(df: DataFrame, *keep: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(i).alias("f"), c(n).cast("double").alias("x")) for i, n in enumerate(features)])
        return df.select(*keep, F.explode(pairs).alias("e")).select(*keep, c("e.f").alias("f"), c("e.x").alias("x"))
    placed = rank_against(long(rows, key), long(fit), c("x"), c("x"), by=["f"], tie=key)
    n = c("n_ref").cast("double")
    low, high = (c("n_less") + c("n_equal")) / n, 1.0 - c("n_less") / n
    floor = 1.0 / F.greatest(2.0 * n, F.lit(2.0))
    tail = F.least(F.greatest(F.least(low, high), floor), F.lit(1.0))
    return placed.groupBy(key).agg(F.sum(-F.ln(tail)).alias("raw"))


def ecod_moments(raw_fit: DataFrame) -> DataFrame:
    """One row: n, mean and deviation of the raw score on the fit rows, and whether they can calibrate."""
    m = raw_fit.agg(F.count(F.lit(1)).alias("n_fit"), F.avg("raw").alias("raw_mean"), F.stddev_pop("raw").alias("raw_std"))
    return m.withColumn("calibrated", (c("n_fit") >= 50) & (c("raw_std") > 1e-9))


def ecod_score(rows: DataFrame, fit: DataFrame, features: Sequence[str], key: str = "event_id") -> DataFrame:
    """(key, raw, z, quantile) of each row against the fit rows; neutral values when uncalibrated."""
    fitted = ecod_raw(fit, fit, features, key)
    moments = ecod_moments(fitted)
    raw = ecod_raw(rows, fit, features, key).crossJoin(F.broadcast(moments))
    placed = rank_against(raw, fitted, c("raw"), c("raw"), tie=key, neighbours=True)
    z = F.when(c("calibrated"), (c("raw") - c("raw_mean")) / F.greatest(c("raw_std"), F.lit(1e-9))).otherwise(0.0)
    # Position of the score among the sorted fit scores, between neighbours by linear interpolation,
    # then how many of the 1001 evenly spaced quantiles lie below it.
    gap = F.nullif(c("ref_next") - c("ref_prev"), F.lit(0.0))
    between = (c("n_less") - 1) + (c("raw") - c("ref_prev")) / gap
    at = F.when(c("n_equal") > 0, c("n_less").cast("double")).when(c("ref_next").isNull(), F.lit(float("inf"))).otherwise(F.coalesce(between, F.lit(0.0)))
    share = F.ceil(F.least(F.lit(1000.0) * at / F.greatest(c("n_ref") - 1, F.lit(1)), F.lit(1000.0))) / 1000.0
    q = F.when(c("calibrated"), F.greatest(share, F.lit(0.0))).otherwise(0.5)
    return placed.select(key, "raw", z.alias("z"), q.alias("quantile"))


def density_channel(z: Column) -> Column:
    """The density component: z/3 kept in [0, 4]."""
    return F.least(F.greatest(z / 3.0, F.lit(0.0)), F.lit(4.0))


# --- conformal -----------------------------------------------------------------------------------------

MIN_STRATUM = 200


def strata(rail: Column, mcc: Column, geo: Column) -> list[Column]:
    """The stratum at each level, finest first: rail x category x region, rail x category, rail, all."""
    band, star = S.mcc_band(mcc), F.lit("*")
    region = F.substring(geo, 1, 4)
    return [F.concat_ws("|", rail, band, region), F.concat_ws("|", rail, band, star), F.concat_ws("|", rail, star, star), F.lit("*|*|*")]


def stratum_sizes(calib: DataFrame, rail: str = "rail", mcc: str = "mcc", geo: str = "geo_cell") -> DataFrame:
    levels = F.array(*strata(c(rail), c(mcc), c(geo)))
    return calib.select(F.explode(F.array_distinct(levels)).alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n_calib"))


def with_stratum(rows: DataFrame, sizes: DataFrame, minimum: int = MIN_STRATUM, rail: str = "rail", mcc: str = "mcc", geo: str = "geo_cell",
                 key: str = "event_id") -> DataFrame:
    """Add ``stratum``: the finest level with enough calibration rows, else all rows together."""
    enough = sizes.filter(c("n_calib") >= minimum).select("stratum")
    out = rows
    levels = strata(c(rail), c(mcc), c(geo))
    for i, s in enumerate(levels[:3]):
        known = enough.select(c("stratum").alias(f"__s{i}"), F.lit(True).alias(f"__ok{i}"))
        out = lookup(out.withColumn(f"__s{i}", s), known, [f"__s{i}"], key)  # a rail may hold most rows
    pick = S.first_match([(c(f"__ok{i}"), c(f"__s{i}")) for i in range(3)], levels[3])
    return out.withColumn("stratum", pick).drop(*[f"__s{i}" for i in range(3)], *[f"__ok{i}" for i in range(3)])


def conformal_p(rows: DataFrame, calib: DataFrame, score: str, minimum: int = MIN_STRATUM, key: str = "event_id") -> DataFrame:
    """Split-conformal p value per row within its stratum: (1 + #{calibration >= score}) / (1 + n).

    A calibration row belongs to all four levels of its ladder, so it is exploded to the levels in use.
    """
    sizes = stratum_sizes(calib)
    asked = with_stratum(rows, sizes, minimum, key=key)
    levels = F.array_distinct(F.array(*strata(c("rail"), c("mcc"), c("geo_cell"))))
    used = sizes.filter((c("n_calib") >= minimum) | (c("stratum") == "*|*|*")).select("stratum")
    ref = calib.select(c(score).alias("__c"), F.explode(levels).alias("stratum")).join(used, "stratum", "left_semi")
    placed = rank_against(asked, ref, c(score), c("__c"), by=["stratum"], tie=key)
    ge = c("n_ref") - c("n_less")
    p = F.when(c("n_ref") > 0, (1.0 + ge) / (1.0 + c("n_ref"))).otherwise(1.0)
    return placed.withColumn("p", p).drop("n_less", "n_equal", "n_ref")


def conformal_coverage(scored: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Measured share of p above alpha, overall and per stratum used, with the gap to nominal."""
    covered = F.avg(S.flag(c("p") > alpha))
    out = scored.rollup("stratum").agg(F.count(F.lit(1)).alias("n"), covered.alias("coverage"))
    return out.select(F.coalesce("stratum", F.lit("overall")).alias("stratum"), "n", "coverage", (c("coverage") - (1.0 - alpha)).alias("gap"))


def smallest_strata(sizes: DataFrame, k: int = 10) -> DataFrame:
    """Diagnostics: the k smallest calibration strata that are narrower than a rail."""
    return sizes.filter(~c("stratum").endswith("|*|*")).orderBy("n_calib", "stratum").limit(k)


def abstention_price(rows: DataFrame, abstained: str = "abstained", attack: str = "is_attack", rail: str = "rail", tag: str = "cohort_tag") -> DataFrame:
    """Abstention rate of benign rows overall, per rail and per cohort block, and of attacks."""
    block = F.when(c(tag).startswith("hb12_"), "hard_benign_12").when(c(tag).startswith("hbb_"), "hard_benign_b").when(c(tag) == "ordinary", "ordinary")
    groups = F.when(c(attack), F.array(F.lit("attack"))).otherwise(F.array_compact(F.array(F.lit("benign"), F.concat(F.lit("rail:"), c(rail)), block)))
    return rows.select(S.flag(c(abstained)).alias("a"), F.explode(groups).alias("population")).groupBy("population").agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("abstention_rate"))


# --- models: the trees themselves are in ``gbdt`` -----------------------------------------------------


def train_baseline(rows: DataFrame, key: str = "event_id", y: str = "y") -> DataFrame:
    """The replica's random, class-stratified 75/25 split: a hash of the id within each class."""
    return rows.withColumn("in_train", S.hash_unit(F.concat_ws(":", c(y).cast("string"), c(key).cast("string")), "replica") < 0.75)


def incumbent_as_detector(rows: DataFrame, score: str, out: str = "detector") -> DataFrame:
    """Min-max of the incumbent's score over the rows that have one; 0 without."""
    lim = rows.filter(c(score) > -1).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    span = F.nullif(c("__hi") - c("__lo"), F.lit(0.0))
    return rows.crossJoin(F.broadcast(lim)).withColumn(out, F.when(c(score) > -1, F.coalesce((c(score) - c("__lo")) / span, F.lit(0.0))).otherwise(0.0)).drop("__lo", "__hi")


# --- beneficiary-side components -----------------------------------------------------------------------

# Weights of the onboarding cohort score.
COHORT_WEIGHTS = {
    "onboarding_batch_timing_cluster": 0.20, "device_os_entropy_collapse": 0.22, "asn_reuse_rate": 0.18, "name_ngram_unlikelihood": 0.12,
    "address_geocode_density": 0.10, "first_credit_source_concentration_batch": 0.10, "batch_kyc_tier_uniformity": 0.08,
}


def unit(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def beneficiary_component(present: Sequence[str]) -> Column:
    """Mean of the clipped terms of those beneficiary columns a view has; 0 without any."""
    shape = {
        "in_out_skew": lambda v: unit(1.0 - v / 0.15), "pass_through_dwell_seconds": lambda v: unit(1.0 - v / 3600.0),
        "beneficiary_account_age_days": lambda v: unit(1.0 - v / 30.0), "beneficiary_distinct_payers_24h": lambda v: unit(v / 40.0),
        "first_credit_source_concentration": unit,
    }
    terms = [F.when(c(n) > -1.0, f(c(n))).otherwise(0.0) for n, f in shape.items() if n in present]
    return sum(terms[1:], terms[0]) / len(terms) if terms else F.lit(0.0)


def fit_cohort_edges(fit: DataFrame, weights: Mapping[str, float] = COHORT_WEIGHTS, minimum: int = 20) -> DataFrame:
    """One row with a 101-point quantile array per feature, over its values above -1 (null below ``minimum`` values)."""
    long = fit.select(F.explode(F.array(*[F.struct(F.lit(n).alias("f"), c(n).cast("double").alias("x")) for n in weights])).alias("e")).select(
        c("e.f").alias("f"), c("e.x").alias("x")).filter(c("x") > -1.0)
    q = exact_quantiles(long, c("x"), [i / 100 for i in range(101)], by=["f"])
    sizes = long.groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter(c("n") >= minimum)
    edges = q.join(sizes, "f", "left_semi").groupBy("f").agg(F.transform(F.array_sort(F.collect_list(F.struct("q_idx", "value"))), lambda s: s["value"]).alias("e"))
    return edges.groupBy().agg(*[F.max(F.when(c("f") == n, c("e"))).alias(f"edges_{n}") for n in weights])


def cohort_score(rows: DataFrame, edges: DataFrame, weights: Mapping[str, float] = COHORT_WEIGHTS, out: str = "cohort_score") -> DataFrame:
    """Weighted percentile of a batch's statistics against the fitted edges, in [0, 1]."""
    total = sum(weights.values())
    def part(n: str, w: float) -> Column:
        below = F.size(F.filter(f"edges_{n}", lambda e: e < c(n)))
        pct = unit(below / 100.0)
        return F.when((c(n) > -1.0) & c(f"edges_{n}").isNotNull(), w * pct).otherwise(0.0)
    terms = [part(n, w) for n, w in weights.items()]
    return rows.crossJoin(F.broadcast(edges)).withColumn(out, sum(terms[1:], terms[0]) / total).drop(*[f"edges_{n}" for n in weights])


def sketch_risk(row: Mapping[str, str]) -> Column:
    """Mean of the available bounded graph terms; 0 without any. ``row`` maps term to column."""
    shape = {"fanin": lambda v: unit(v / 40.0), "skew": lambda v: unit(1.0 - v / 0.15), "requestor": lambda v: unit(v / 12.0),
             "device": lambda v: unit(v / 6.0), "terminal": lambda v: unit(v / 30.0)}
    terms = F.array_compact(F.array(*[F.when(c(row[t]) >= 0, f(c(row[t]))) for t, f in shape.items() if t in row]))
    return F.when(F.size(terms) > 0, S.array_mean(terms)).otherwise(0.0)
