"""The feature table: every catalogued feature as Spark columns, built one key at a time.

Each key's features come from a *frame*: the few columns it needs are selected, shuffled by that key
and reduced to ``event_id`` plus its features.  The frames then meet in joins on ``event_id``; the
wide event row itself is never shuffled by any entity key.  Only the frames behind the requested
features are planned.  Every join holds a sorted side in memory, so more than ``MEET`` frames meet in
written tables first, ``MEET`` at a time: a task's memory does not grow with the number of features.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import catalogue as C
from tidemark.operators import kernels as K
from tidemark.operators.beneficiary import exchange_prior
from tidemark.operators.timeline import DAY, HOUR, WINDOWS, Timeline, novelty, trailing_distinct
from tidemark.plans.blocks import blank, planning
from tidemark.plans.cut import written
from tidemark.plans.values import exact_quantiles, lookup
from tidemark.schema import RAILS, UPI_RAILS, apply_sentinel

c = F.col

#: Frames that one plan joins.
MEET = 6

# Ordinal scales, lowest risk first.
ENTRY_MODE_ORDER = tuple("""
    chip contactless biometric_assisted secure_intent intent in_app qr_dynamic collect file_upload agent
    on_device_ledger ecommerce qr_static contactless_no_cvm keyed magstripe_fallback
""".split())
AVS_ORDER = ("not_requested", "unavailable", "no_match", "partial_match", "match")
CVM_ORDER = ("none", "signature", "offline_pin", "online_pin", "cdcvm", "biometric")
ASSURANCE_ORDER = ("none", "low", "medium", "high")
KYC_ORDER = ("none", "min_kyc", "full_kyc", "video_kyc")
ATTESTATION_ORDER = ("not_applicable", "unattested", "self_attested", "attested")
INITIATION_ORDER = (
    "not_applicable", "in_app", "intent", "secure_intent", "qr_dynamic", "mandate", "collect", "qr_static", "ivr",
)
CATEGORY_ORDER = (
    "payroll", "biller", "corporate_vendor", "small_merchant", "p2p_individual", "unknown", "wallet_load", "giftcard",
    "quasi_cash", "crypto_onramp",
)
AGE_BANDS = (1.0, 7.0, 30.0)
COUNTERPARTY = {
    "pan_canonical": "merchant_id", "token_id": "merchant_id", "token_requestor_id": "pan_canonical",
    "device_fingerprint_id": "cardholder_id", "terminal_id": "pan_canonical", "merchant_id": "pan_canonical",
    "bin_prefix": "merchant_id", "vpa": "payee_vpa", "beneficiary_id": "cardholder_id",
}


@dataclass(frozen=True)
class FeatureConfig:
    """Policy numbers of the feature layer."""

    thresholds_card: tuple[float, ...] = (2_000.0, 5_000.0, 15_000.0, 50_000.0, 100_000.0)
    thresholds_upi: tuple[float, ...] = (500.0, 2_000.0, 5_000.0, 15_000.0, 100_000.0)
    afa_band: float = 15_000.0
    daily_count_ceiling: int = 12
    atoms: tuple[float, ...] = (100.0, 200.0, 500.0, 1_000.0, 2_000.0, 5_000.0)
    start_date: str = "2026-03-02"
    payday_days: tuple[int, ...] = (1, 2, 28, 29, 30, 31)
    festival: tuple[int, int, int] = (38, 44, 49)


@dataclass(frozen=True)
class ReferenceStats:
    """Statistics fitted on training rows and then frozen; every member is a DataFrame."""

    bin_prior: DataFrame
    cohort_prior: DataFrame
    geo_prior: DataFrame
    mcc_median: DataFrame
    scalars: DataFrame  # one row: global_rate, modal_gap_log, n_fit, window_end_ts

    def save(self, path: str) -> None:
        for name in self.__dataclass_fields__:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> "ReferenceStats":
        return cls(**{name: spark.read.parquet(f"{path}/{name}") for name in cls.__dataclass_fields__})


def fit_reference_stats(prepared: DataFrame, y: Column, fit_rows: Column) -> ReferenceStats:
    """Fit priors, medians and the usual gap on the rows where ``fit_rows`` holds."""
    slim = prepared.select("event_id", "ts_us", "ts", "_primary_key", "bin_prefix", "_cohort", "geo_cell", "mcc",
                           "auth_to_presentment_ratio", y.cast("double").alias("__y"), fit_rows.alias("__fit"))
    # The gap looks back over all rows, so it is taken before the fit rows are picked.
    fit = K.with_gap(slim).filter("__fit")
    prior = lambda key: K.shrunk_prior(fit, key, c("__y"), "prior")
    gap = exact_quantiles(fit, c("_inter_arrival_log"), [0.5]).select(c("value").alias("modal_gap_log"))
    totals = fit.agg(
        F.coalesce(F.avg(F.when(c("__y") >= 0, c("__y"))), F.lit(0.0)).alias("global_rate"),
        F.count(F.lit(1)).alias("n_fit"),
        F.max("ts").alias("window_end_ts"),
    )
    return ReferenceStats(
        bin_prior=prior("bin_prefix"), cohort_prior=prior("_cohort"), geo_prior=prior("geo_cell"),
        mcc_median=K.group_median(fit, "mcc", c("auth_to_presentment_ratio"), "mcc_median"),
        scalars=totals.join(F.broadcast(gap), how="left").withColumn("modal_gap_log", F.coalesce("modal_gap_log", F.lit(0.0))),
    )


def _neg(cond: Column, v: Column) -> Column:
    """The value where the condition holds, -1 elsewhere."""
    return F.when(cond, v).otherwise(-1.0)


def _gap_to(v: Column, points: Sequence[float]) -> Column:
    return v - S.nearest(v, points)


@lru_cache(maxsize=8)
def row_features(cfg: FeatureConfig) -> dict[str, Column]:
    """Features of the row alone."""
    amount, kind, rail = c("amount_inr"), c("message_kind"), c("rail")
    theta = c("hour_ist") * (2.0 * math.pi / 24.0)
    week = c("dow") * (2.0 * math.pi / 7.0)
    out = {f"tod_vonmises_{n}_h{h}": f(theta * h) for h in (1, 2, 3) for n, f in (("sin", F.sin), ("cos", F.cos))}
    dom = F.dayofmonth(F.date_add(F.lit(cfg.start_date).cast("date"), c("day_index").cast("int")))
    start, peak, end = cfg.festival
    day = c("day_index").cast("double")
    festive = (day >= start) & (day <= end)
    ramp = F.when(day <= peak, (day - start) / max(1, peak - start)).otherwise(1.0 - (day - peak) / max(1, end - peak))
    out |= {
        "is_night_hours": S.flag((c("hour_ist") >= 0) & (c("hour_ist") < 5)),
        "dow_sin": F.sin(week), "dow_cos": F.cos(week),
        "is_payday_window": S.flag(dom.isin(*cfg.payday_days)),
        "is_festival_window": S.flag(festive),
        "festival_ramp_position": _neg(festive, ramp),
        "avs_trajectory_shape": S.ordinal(c("avs_result"), AVS_ORDER),
    }
    has_3ds = c("threeds_authentication_result") != "not_applicable"
    tz, lang, asn = c("threeds_timezone_offset_min"), c("threeds_language"), c("threeds_ip_asn")
    oddities = {
        "threeds_timezone_disagrees_with_geo": (tz >= 0) & (F.abs(tz - 330) > 1),
        "threeds_language_disagrees_with_geo": (lang != "") & ~lang.endswith("-IN"),
        "threeds_channel_screen_mismatch": c("threeds_screen_wh").isin("1280x720", "1920x1080")
        & (c("threeds_device_channel") == "app"),
    }
    foreign_asn = (asn != "") & ~asn.startswith("AS645")
    out |= {n: S.flag_where(has_3ds, cond) for n, cond in oddities.items()}
    age_band = S.band(c("device_age_days"), AGE_BANDS)
    assurance, cvm = S.ordinal(c("token_assurance_level"), ASSURANCE_ORDER), S.ordinal(c("cvm_result"), CVM_ORDER)
    first_spend, present = c("provisioning_to_first_spend_minutes"), c("emv_cryptogram_present")
    out |= {
        "field_combination_implausibility": _neg(has_3ds, sum((S.flag(x) for x in oddities.values()), S.flag(foreign_asn))),
        "threeds_field_population_score": c("threeds_field_population_score"),
        "threeds_authenticated_flag": S.flag(c("threeds_eci") == "authenticated"),
        "threeds_frictionless_flag": S.flag(c("threeds_authentication_result") == "frictionless_success"),
        "threeds_challenge_abandoned_flag": S.flag(c("threeds_authentication_result") == "challenge_abandoned"),
        "token_assurance_ordinal": assurance,
        "token_assurance_vs_device_age": _neg((assurance >= 0) & (age_band >= 0), assurance - age_band),
        "provisioning_to_first_spend_minutes": first_spend,
        "provisioning_to_first_spend_log": S.log1p_where(first_spend, first_spend >= 0),
        "cvm_result_ordinal": cvm,
        "cvm_vs_device_age": _neg((cvm >= 0) & (age_band >= 0), cvm - age_band),
        "cryptogram_present_but_unverified": S.flag_where(present, ~c("emv_cryptogram_verified")),
        "issuer_application_data_inconsistent": S.flag_where(present, ~c("issuer_application_data_consistent")),
        "exemption_flag_present": S.flag(c("exemption_flag") != ""),
        "stand_in_flag": S.flag(c("stand_in_indicator")),
        "agent_attestation_ordinal": S.ordinal(c("agent_attestation_status"), ATTESTATION_ORDER),
        "agent_mandate_signature_invalid": S.flag_where(c("agentic_indicator"), ~c("agent_mandate_signature_valid")),
        "agentic_indicator_without_mandate": S.flag(c("agentic_indicator") & (c("mandate_id") == "")),
    }
    mandated, cap = c("mandate_id") != "", c("mandate_max_amount_inr")
    debits, created = c("mandate_debit_count_to_date"), c("mandate_created_ts")
    expected = F.when(c("mandate_frequency") == "weekly", 4.0).when(c("mandate_frequency") == "monthly", 1.0).otherwise(8.0)
    out |= {
        "mandate_present": S.flag(mandated),
        "mandate_amount_headroom": headroom(),
        "mandate_count_vs_frequency": _neg(mandated, debits / expected),
        "mandate_mcc_drift": S.flag_where(mandated & (c("mandate_permitted_mcc") != ""), c("mcc") != c("mandate_permitted_mcc")),
        "mandate_to_first_debit_minutes": _neg(mandated & (created > 0) & (debits <= 1), (c("ts") - created) / 60.0),
        "pre_debit_notification_absent": S.flag_where(kind == "mandate_debit", ~c("pre_debit_notification_sent")),
        "mandate_amount_vs_afa_band": _neg(mandated, (amount - cfg.afa_band) / cfg.afa_band),
    }
    points = F.when(rail.isin(*UPI_RAILS), S.nearest(amount, cfg.thresholds_upi)).otherwise(S.nearest(amount, cfg.thresholds_card))
    atom = F.abs(_gap_to(amount, cfg.atoms))
    out |= {
        "distance_to_nearest_threshold": amount - points,
        "distance_to_nearest_threshold_rel": (amount - points) / points,
        "just_below_threshold_flag": S.flag(just_below(cfg)),
        "amount_log": F.log1p(F.greatest(amount, F.lit(0.0))),
        "amount_is_round_atom": S.flag(atom < 0.5),
        "amount_round_number_avoidance": F.least(atom / F.greatest(amount, F.lit(1.0)), F.lit(1.0)),
    }
    presented, refund = kind == "presentment", kind == "refund_credit"
    out |= {
        "auth_to_presentment_ratio": c("auth_to_presentment_ratio"),
        "presentment_age_days": c("presentment_age_days"),
        "incremental_auth_absent": S.flag_where(presented, ~c("incremental_auth_present")),
        "reversal_absent": S.flag_where(presented, ~c("reversal_present")),
        "refund_without_original_auth": S.flag_where(refund, c("original_auth_event_id") == ""),
        "refund_exceeds_original_flag": S.flag_where(refund & (c("refund_amount_inr") >= 0), c("refund_amount_inr") > amount + 1e-6),
        "refund_to_different_credential": S.flag_where(refund, c("refund_to_different_credential")),
        "time_to_dispute_days": _neg(c("dispute_filed_ts") > 0, (c("dispute_filed_ts") - c("ts")) / 86_400.0),
        "label_channel_disagreement": F.lit(0.0),
        "sketch_beneficiary_fanin_degree": c("beneficiary_fanin_degree").cast("double"),
        "sketch_beneficiary_fanout_degree": c("beneficiary_fanout_degree").cast("double"),
    }
    dwell, change = c("beneficiary_dwell_seconds"), c("beneficiary_change_ts")
    out |= {
        "beneficiary_account_age_days": c("beneficiary_account_age_days"),
        "beneficiary_age_band_ordinal": S.band(c("beneficiary_account_age_days"), AGE_BANDS),
        "pass_through_dwell_seconds": dwell,
        "pass_through_dwell_log": S.log1p_where(dwell, dwell >= 0),
        "beneficiary_onward_send_minutes": c("beneficiary_onward_send_minutes"),
        "beneficiary_category_ordinal": S.ordinal(c("beneficiary_category"), CATEGORY_ORDER),
        "beneficiary_kyc_tier_ordinal": S.ordinal(c("beneficiary_kyc_tier"), KYC_ORDER),
        "creditor_name_match_score": c("creditor_name_match_score"),
        "beneficiary_change_within_cooling_hours": _neg(change > 0, (c("ts") - change) / 3600.0),
        "payee_vpa_age_days": c("payee_vpa_age_days"),
        "payee_name_brand_similarity": S.token_jaccard(c("payee_name_string"), c("acceptor_descriptor")),
        "beneficiary_prior_from_exchange": F.lit(0.0),
    }
    ages = [c(n) for n in ("pan_age_days", "vpa_age_days", "device_age_days", "merchant_age_days", "account_age_days",
                           "beneficiary_account_age_days", "payee_vpa_age_days")]
    youngest = F.coalesce(F.least(*[F.when(a >= 0, a) for a in ages]), F.lit(-1.0))
    out |= {n: c(n) for n in ("pan_age_days", "vpa_age_days", "device_age_days", "merchant_age_days", "account_age_days")}
    out |= {
        "min_entity_age_days": youngest,
        "entity_age_band_ordinal": S.band(youngest, AGE_BANDS),
        "cold_start_flag": S.flag((youngest >= 0) & (youngest < 1)),
        "mcc_vs_basket_semantics": 1.0 - S.token_jaccard(c("mcc"), c("acceptor_descriptor")),
        "chargeback_after_funding_flag": S.flag_where(kind == "chargeback", c("presentment_age_days") > 0),
        "settlement_to_withdrawal_days": _neg(c("settlement_amount_inr") >= 0, c("presentment_age_days")),
        "device_rebinding_event": S.flag(c("device_rebinding_event")),
        "pin_reset_event": S.flag(c("pin_reset_event")),
        "sms_silence_window_minutes": c("sms_silence_window_minutes"),
        "session_duration_minutes": c("session_duration_minutes"),
        "fd_liquidation_before_transfer": S.flag(c("fd_liquidation_flag")),
        "referrer_domain_age_days": c("referrer_domain_age_days"),
        "reconciliation_lag_minutes": _neg(c("reconciliation_lag_minutes") >= 0, c("reconciliation_lag_minutes")),
    }
    out |= {C.rail_feature(r): S.flag(rail == r) for r in RAILS}
    fired = c("incumbent_rule_fired")
    out |= {
        "tier_is_b": S.flag(c("tier") == "B"),
        "message_kind_is_authorisation": S.flag(kind == "authorisation"),
        "message_kind_is_credit_leg": S.flag(kind.isin("inbound_credit", "onward_send")),
        "message_kind_is_post_auth": S.flag(kind.isin("presentment", "chargeback", "representment", "refund_credit")),
        "has_beneficiary_leg": S.flag(c("beneficiary_id") != ""),
        "entry_mode_ordinal": S.ordinal(c("pos_entry_mode"), ENTRY_MODE_ORDER),
        "initiation_mode_ordinal": S.ordinal(c("upi_initiation_mode"), INITIATION_ORDER),
        "is_cross_border": S.flag(c("acceptor_country") != "IN"),
        "incumbent_score": c("incumbent_score"),
        "incumbent_rule_count": F.when(fired == "", 0.0).otherwise(F.size(F.split(fired, ",")).cast("double")),
    }
    return out


def headroom() -> Column:
    cap = c("mandate_max_amount_inr")
    return S.ratio_where(cap - c("amount_inr"), cap, cap > 0)


def just_below(cfg: FeatureConfig) -> Column:
    """Amount under its nearest threshold by at most 2 percent."""
    amount = c("amount_inr")
    near = lambda points: S.nearest(amount, points)
    t = F.when(c("rail").isin(*UPI_RAILS), near(cfg.thresholds_upi)).otherwise(near(cfg.thresholds_card))
    return (amount < t) & ((t - amount) / t <= 0.02)


# --- frames: event_id plus the features of one key ---------------------------------------------


def _habit(df: DataFrame, cfg: FeatureConfig, stats: ReferenceStats | None) -> DataFrame:
    """The payer's own history: gaps, habits, runs, approval rate, baselines."""
    pk = "_primary_key"
    slim = df.select(
        "event_id", "ts_us", pk, "amount_inr", "geo_cell", "mcc", "rail", "ip_asn", "beneficiary_id",
        c("hour_ist").alias("hour"), c("pos_entry_mode").alias("entry"), "response_code",
        S.ordinal(c("avs_result"), AVS_ORDER).alias("avs"), (c("cvv2_result") == "no_match").alias("cvv_bad"),
        F.greatest(c("response_latency_ms"), F.lit(0.0)).alias("latency"), S.flag(c("approved")).alias("ok"),
        just_below(cfg).alias("below"), S.flag(c("rail").isin(*UPI_RAILS)).alias("upi"),
        c("device_rebinding_event").alias("rebound"), (c("message_kind") == "profile_change").alias("profiled"),
    )
    for name, col in (("mcc", "mcc"), ("geo", "geo_cell"), ("rail", "rail"), ("asn", "ip_asn"), ("ben", "beneficiary_id")):
        slim = novelty(slim, [pk], [col], f"new_{name}")
    t0 = Timeline(slim, pk)
    for n in ("hour", "amount_inr", "entry", "avs", "geo_cell"):
        t0.prev(f"prev_{n}", c(n))
    first = t0.prev("prev_us", c("ts_us")).running("pos", "count", F.lit(1)).build().withColumns({
        "gap": K.gap_of("prev_us"),
        "same_amount": F.coalesce((F.abs(c("amount_inr") - c("prev_amount_inr")) < 1.0) & (c("prev_amount_inr") >= 0), F.lit(False)),
        "step": F.concat(F.coalesce("prev_entry", F.lit("")), F.lit(">"), c("entry")),
    })
    # The histories come last: rows that hold them are read at once, never sorted again.
    t = Timeline(first, pk).last_n("h_step", c("step"), 16).last_n("h_gap", F.greatest(c("gap"), F.lit(0.0)), 8)
    t.last_n("h_latency", c("latency"), 8).last_n("h_amount", c("amount_inr"), 8)
    t.last_n("h_code", c("response_code"), 16).last_n("h_amounts", c("amount_inr").cast("double"), 64)
    t.last_where("at_rebind", c("rebound"), c("ts_us")).last_where("at_profile", c("profiled"), c("ts_us"))
    for w in ("1h", "24h", "30d"):
        t.trailing_count(f"n_{w}", WINDOWS[w])
    for w in ("1h", "30d"):
        t.trailing_sum(f"ok_{w}", c("ok"), WINDOWS[w])
    t.trailing_sum("below_24h", S.flag(c("below")), DAY).trailing_sum("fresh_24h", c("new_ben"), DAY)
    t.trailing_sum("amt_30d", c("amount_inr"), WINDOWS["30d"])
    t.trailing_sum("amt2_30d", c("amount_inr") * c("amount_inr"), WINDOWS["30d"])
    t.trailing_sum("known_mcc_30d", 1.0 - c("new_mcc"), WINDOWS["30d"]).trailing_sum("upi_30d", c("upi"), WINDOWS["30d"])
    for n in ("same_amount", "cvv_bad", "below"):
        t.last_where(f"miss_{n}", ~c(n), c("pos"))
    # What walks a history is a column of its own: named twice in an expression, it would be walked twice.
    df2 = t.build().withColumns({
        "median_30d": K.median_of_latest("h_amounts", F.when(c("ts_us").isNotNull(), c("n_30d")).otherwise(0.0)),
        **{f"cv_{n}": S.array_cv(c(f"h_{n}.v")) for n in ("gap", "latency", "amount")},
    })

    live = ~blank(df2, [pk])
    run = lambda n: F.when(live, (c("pos") - F.coalesce(c(f"miss_{n}") + 1, F.lit(0))).cast("double")).otherwise(0.0)
    rate = lambda s, n: S.ratio_where(c(s), c(n), c(n) > 0)
    calm = lambda cv: _neg(cv >= 0, 1.0 - F.least(cv, F.lit(1.0)))
    gap = c("gap")
    hours = gap / 3600.0
    n30 = F.nullif(c("n_30d"), F.lit(0.0))
    mean30 = rate("amt_30d", "n_30d")
    std30 = F.sqrt(F.greatest(c("amt2_30d") / n30 - (c("amt_30d") / n30) * (c("amt_30d") / n30), F.lit(0.0)))
    median = c("median_30d")
    moved = F.coalesce((c("prev_geo_cell") != "") & (c("prev_geo_cell") != c("geo_cell")), F.lit(False))
    seen_entry = F.coalesce(c("prev_entry"), F.lit(""))
    minutes_since = lambda t, div: F.coalesce((c("ts_us") - c(t)) / (div * 1_000_000.0), F.lit(-1.0))
    amount = c("amount_inr")
    return df2.select(
        "event_id",
        F.when(F.coalesce(c("prev_hour") >= 0, F.lit(False)), S.circular_gap(c("hour"), c("prev_hour"), 24.0))
        .otherwise(-1.0).alias("hour_deviation_from_habit"),
        gap.alias("inter_arrival_seconds"), S.log1p_where(gap, gap >= 0).alias("inter_arrival_log"),
        calm(c("cv_gap")).alias("inter_arrival_regularity"),
        run("same_amount").alias("single_field_delta_retry_chain"),
        S.rolling_entropy(c("h_code.v")).alias("decline_reason_entropy"),
        S.rolling_entropy(c("h_step.v")).alias("response_code_transition_entropy"),
        F.when(F.coalesce(c("prev_avs") >= 0, F.lit(False)), S.flag(c("avs") >= c("prev_avs"))).otherwise(-1.0)
        .alias("avs_trajectory_monotone"),
        run("cvv_bad").alias("cvv2_retry_count"),
        S.flag_where(seen_entry != "", seen_entry != c("entry")).alias("entry_mode_transition_flag"),
        S.flag(c("entry").isin("magstripe_fallback", "keyed", "contactless_no_cvm") & seen_entry.isin("chip", "contactless"))
        .alias("entry_mode_downgrade_flag"),
        c("cv_latency").alias("response_latency_probe_pattern"),
        _neg((c("n_1h") > 0) & (c("n_30d") > 0), rate("ok_1h", "n_1h") - rate("ok_30d", "n_30d"))
        .alias("approval_ratio_delta_vs_baseline"),
        calm(c("cv_amount")).alias("amount_uniformity_score"),
        rate("below_24h", "n_24h").alias("amount_mass_below_cap_24h"),
        run("below").alias("threshold_hug_run_length"),
        (c("n_24h") / float(cfg.daily_count_ceiling)).alias("cumulative_count_24h_vs_cap"),
        S.ratio_where(amount, median, median > 0).alias("amount_ratio_to_own_baseline"),
        S.ratio_where(amount - mean30, std30, (c("n_30d") >= 2) & (mean30 >= 0) & (std30 > 0)).alias("amount_zscore_to_own_baseline"),
        c("new_mcc").alias("mcc_novelty"), c("new_geo").alias("geo_novelty"),
        c("new_rail").alias("rail_novelty"), c("new_asn").alias("ip_asn_novelty"),
        rate("known_mcc_30d", "n_30d").alias("mcc_habit_probability"),
        S.flag_where(moved & (gap >= 0), hours < 0.5).alias("geovelocity_break"),
        rate("upi_30d", "n_30d").alias("__own_upi_share"),
        S.flag_where(gap >= 0, hours > 720.0).alias("dormancy_reactivation_flag"),
        minutes_since("at_rebind", 60).alias("rebinding_to_first_payee_minutes"),
        minutes_since("at_profile", 86_400).alias("profile_change_before_spend_days"),
        c("fresh_24h").alias("fresh_beneficiary_count_24h"),
    )


def _largest(df, cfg, stats):
    slim = df.select("event_id", "ts_us", "_primary_key", "amount_inr")
    out = K.trailing_max_value(slim, "_primary_key", c("amount_inr"), WINDOWS["30d"], "m")
    return out.select("event_id", S.flag_where(c("m") >= 0, c("amount_inr") > c("m")).alias("is_largest_ever_for_entity"))


def _churn(df, cfg, stats):
    slim = df.select("event_id", "ts_us", "_primary_key", "device_fingerprint_id")
    out = trailing_distinct(slim, ["_primary_key"], "device_fingerprint_id", {"device_churn_30d": WINDOWS["30d"]})
    return out.select("event_id", "device_churn_30d")


def _cohort_share(df, cfg, stats):
    slim = df.select("event_id", "ts_us", "_cohort", S.flag(c("rail").isin(*UPI_RAILS)).alias("upi"))
    out = K.add_moments(Timeline(slim, "_cohort"), "u", c("upi"), WINDOWS["30d"]).build()
    return out.select("event_id", K.mean_of("u").alias("__cohort_upi_share"))


def _cohort_ranks(df, cfg, stats):
    lag = c("reconciliation_lag_minutes")
    slim = df.select("event_id", "_cohort", c("amount_inr").alias("a"), F.when(lag >= 0, lag).otherwise(0.0).alias("b"),
                     (lag >= 0).alias("has"))
    out = K.pct_ranks(slim, ["a", "b"], ["_cohort"], "event_id").join(slim.select("event_id", "has"), "event_id")
    return out.select("event_id", c("a_pct").alias("amount_pct_in_peer_cohort"),
                      _neg(c("has"), c("b_pct")).alias("reconciliation_lag_pct_in_peer_cohort"))


def _session(df, cfg, stats):
    slim = df.select("event_id", "ts_us", "session_id", "amount_inr",
                     F.greatest(c("in_app_dwell_seconds"), F.lit(0.0)).alias("dwell"))
    out = (
        Timeline(slim, "session_id").running("seen", "count", F.lit(1)).trailing_count("n", DAY)
        .last_n("h", c("dwell"), 8).prev("p", c("amount_inr")).build()
    )
    cv = S.array_cv(c("h.v"))
    return out.select(
        "event_id", c("seen").cast("double").alias("events_in_session"),
        c("n").alias("debits_per_uninterrupted_session"),
        _neg(cv >= 0, 1.0 - F.least(cv, F.lit(1.0))).alias("in_app_dwell_uniformity"),
        F.when(F.coalesce(c("p") >= 0, F.lit(False)), S.flag(c("amount_inr") > c("p"))).otherwise(-1.0)
        .alias("escalating_amount_in_session"),
    )


def _bin(df, cfg, stats):
    slim = df.select("event_id", "ts_us", "bin_prefix", S.flag(c("exemption_flag") != "").alias("x"))
    out = K.add_moments(Timeline(slim, "bin_prefix"), "x", c("x"), DAY).build()
    return out.select("event_id", K.mean_of("x").alias("exemption_rate_per_bin_24h"))


def _token(df, cfg, stats):
    slim = df.select("event_id", "ts_us", "token_id", c("cit_mit_indicator").alias("who"))
    out = Timeline(slim, "token_id").prev("p", c("who")).build()
    before = F.coalesce(c("p"), F.lit(""))
    return out.select("event_id", S.flag((before != "") & (c("who") != "") & (before != c("who"))).alias("cit_mit_flip_flag"))


def _mandate_terms(df, cfg, stats):
    slim = df.select(
        "event_id", "ts_us", (c("mandate_id") != "").alias("has"),
        F.concat_ws("|", c("mandate_max_amount_inr").cast("string"), "mandate_frequency").alias("terms"),
    )
    out = K.trailing_count_where(slim, "terms", DAY, c("has"), "mandate_cohort_identical_params")
    return out.select("event_id", "mandate_cohort_identical_params")


def _mandate_rank(df, cfg, stats):
    slim = df.select("event_id", headroom().alias("h"))
    return K.pct_rank_or_sentinel(slim, c("h"), "r").select(
        "event_id", _neg(c("h") >= -1.0, c("r")).alias("mandate_amount_headroom_pct"))


def _beneficiary(df, cfg, stats):
    """The receiving account's history."""
    ben, amount, kind = "beneficiary_id", c("amount_inr"), c("message_kind")
    credit = F.greatest(amount, F.lit(0.0))
    slim = df.select(
        "event_id", "ts_us", ben, "amount_inr", c("cardholder_id").alias("payer"), c("remittance_info").alias("remit"),
        c("beneficiary_first_credit_source").alias("source"), c("beneficiary_dwell_seconds").alias("dwell"),
        F.greatest(c("beneficiary_fanin_degree").cast("double"), F.lit(0.0)).alias("core"),
        F.when(kind == "inbound_credit", credit).otherwise(0.0).alias("inflow"),
        F.when(kind == "onward_send", credit).otherwise(0.0).alias("outflow"),
        S.flag((kind == "inbound_credit") & (amount < 500.0)).alias("small_in"),
        S.flag(c("beneficiary_category") == "biller").alias("biller"),
        (kind == "mandate_creation").alias("creation"),
    )
    slim = novelty(slim, [ben], ["payer"], "new_payer")
    slim = K.running_herfindahl(slim, ben, "source", "hhi")
    t = Timeline(slim, ben).prev("p_payer", c("payer")).prev("p_core", c("core")).prev("p_remit", c("remit"))
    t.running("first_us", "min", c("ts_us"), inclusive=True)
    for w in ("24h", "7d", "30d"):
        t.trailing_count(f"n_{w}", WINDOWS[w])
    t.trailing_sum("in_24h", c("inflow"), DAY).trailing_sum("out_24h", c("outflow"), DAY)
    t.trailing_sum("new_24h", c("new_payer"), DAY).trailing_sum("made_24h", S.flag(c("creation")), DAY)
    t.trailing_sum("repeat_7d", 1.0 - c("new_payer"), WINDOWS["7d"]).trailing_sum("small_7d", c("small_in"), WINDOWS["7d"])
    t.trailing_sum("biller_30d", c("biller"), WINDOWS["30d"]).trailing_sum("amt_30d", c("amount_inr"), WINDOWS["30d"])
    first = t.build().withColumn(
        "round_trip", S.flag((F.coalesce("p_payer", F.lit("")) != "") & (c("p_payer") == c("payer"))))
    df2 = Timeline(first, ben).trailing_sum("trips_7d", c("round_trip"), WINDOWS["7d"]).build()
    live = ~blank(df2, [ben])
    rate = lambda s, n: S.ratio_where(c(s), c(n), c(n) > 0)
    remit = F.coalesce(c("p_remit"), F.lit(""))
    mean30 = rate("amt_30d", "n_30d")
    return df2.select(
        "event_id",
        S.ratio_where(F.abs(c("in_24h") - c("out_24h")), c("in_24h"), c("in_24h") > 0).alias("in_out_skew"),
        S.ratio_where(c("out_24h"), c("in_24h"), c("in_24h") > 0).alias("value_conservation_net_of_skim"),
        _neg(live & (c("dwell") >= 0), (c("ts_us") - c("first_us")) / 60e6 + c("dwell") / 60.0)
        .alias("first_receipt_to_first_send_minutes"),
        rate("repeat_7d", "n_7d").alias("repeat_payer_share"),
        (c("new_24h") / 24.0).alias("payer_set_growth_rate"),
        _neg(live, 1.0 - F.least(F.greatest(rate("biller_30d", "n_30d"), F.lit(0.0)), F.lit(1.0)))
        .alias("biller_continuity_absent"),
        c("hhi").alias("first_credit_source_concentration"),
        _neg(remit != "", 1.0 - S.token_jaccard(c("remit"), remit)).alias("remittance_info_drift"),
        S.ratio_where(c("amount_inr"), mean30, mean30 > 0).alias("amount_vs_vendor_history"),
        c("round_trip").alias("sketch_round_trip_flow_flag"),
        F.coalesce(F.when(c("p_core") >= 0, c("core") - c("p_core")), F.lit(-1.0)).alias("sketch_kcore_acquisition_rate"),
        rate("trips_7d", "n_7d").alias("sketch_motif_reciprocity"),
        rate("small_7d", "n_7d").alias("sketch_seeder_cluster_membership"),
        _neg(live & c("creation"), c("made_24h")).alias("mandate_creation_rate_per_payee_24h"),
    )


def _payer(df, cfg, stats):
    aeps, kind = c("rail") == "aeps-microatm", c("message_kind")
    slim = df.select(
        "event_id", "ts_us", "cardholder_id", "beneficiary_id", c("message_kind").alias("kind"), aeps.alias("aeps"),
        S.flag(aeps & (kind == "balance_enquiry")).alias("enq"), S.flag(aeps & (kind == "assisted_withdrawal")).alias("wd"),
    )
    slim = novelty(slim, ["cardholder_id"], ["beneficiary_id"], "new_ben")
    out = (
        Timeline(slim, "cardholder_id").prev("p", c("kind")).running("bens", "sum", c("new_ben"))
        .trailing_sum("enq_24h", c("enq"), DAY).trailing_sum("wd_24h", c("wd"), DAY).build()
    )
    return out.select(
        "event_id", c("bens").cast("double").alias("sketch_payer_fanout_degree_24h"),
        S.flag(F.coalesce(c("p") == "inbound_credit", F.lit(False)) & (c("kind") == "authorisation"))
        .alias("inbound_credit_then_outbound_different_payee"),
        _neg(c("aeps"), c("enq_24h")).alias("balance_enquiry_count_24h"),
        _neg(c("aeps"), c("enq_24h") / F.greatest(c("wd_24h"), F.lit(1.0))).alias("balance_enquiry_to_withdrawal_ratio_24h"),
    )


def _geo_payee(df, cfg, stats):
    slim = df.select("event_id", "ts_us", F.concat_ws("|", "geo_cell", "payee_vpa").alias("spot"), "device_fingerprint_id")
    out = K.running_distinct(slim, "spot", "device_fingerprint_id", "n")
    return out.select("event_id", c("n").cast("double").alias("sketch_geohash_distinct_payer_devices"))


def _merchant(df, cfg, stats):
    mid, amount = "merchant_id", c("amount_inr")
    refund = c("message_kind") == "refund_credit"
    slim = df.select(
        "event_id", "ts_us", mid, "amount_inr", c("cardholder_id").alias("payer"), S.flag(c("approved")).alias("ok"),
        S.flag(c("acceptor_country") != "IN").alias("foreign"), S.flag(refund).alias("refund"),
        F.when(refund, amount).otherwise(0.0).alias("credit"), F.when(refund, 0.0).otherwise(amount).alias("debit"),
        c("merchant_age_days").alias("age"),
    )
    slim = novelty(slim, [mid], ["payer"], "new_payer")
    t = Timeline(slim, mid)
    for w in WINDOWS:
        t.trailing_count(f"n_{w}", WINDOWS[w])
    t.trailing_sum("credit_24h", c("credit"), DAY).trailing_sum("debit_24h", c("debit"), DAY)
    t.trailing_sum("new_24h", c("new_payer"), DAY).trailing_sum("amt_24h", amount, DAY)
    t.trailing_sum("ok_1h", c("ok"), HOUR).trailing_sum("foreign_7d", c("foreign"), WINDOWS["7d"])
    for n, v in (("amt", amount), ("ok", c("ok")), ("known", 1.0 - c("new_payer")), ("refund", c("refund"))):
        t.trailing_sum(f"{n}_30d", v, WINDOWS["30d"])
    out = t.build()
    live = ~blank(out, [mid])
    rate = lambda s, n: S.ratio_where(c(s), c(n), c(n) > 0)
    m24, m30 = rate("amt_24h", "n_24h"), rate("amt_30d", "n_30d")
    return out.select(
        "event_id",
        S.ratio_where(c("credit_24h"), c("debit_24h"), c("debit_24h") > 0).alias("credit_to_debit_ratio_per_acceptor_24h"),
        rate("new_24h", "n_24h").alias("sketch_first_txn_at_acceptor_share_24h"),
        S.ratio_where(m24, m30, (m24 >= 0) & (m30 > 0)).alias("merchant_ticket_step_change"),
        S.ratio_where(c("n_24h") * 7.0, c("n_7d"), c("n_7d") > 0).alias("merchant_ramp_curve_shape"),
        _neg((c("n_1h") > 0) & (c("n_30d") > 0), rate("ok_1h", "n_1h") - rate("ok_30d", "n_30d"))
        .alias("merchant_approval_ratio_delta"),
        _neg((c("age") >= 0) & (c("age") < 30), c("n_24h")).alias("new_mid_ticket_velocity"),
        rate("foreign_7d", "n_7d").alias("foreign_issuer_concentration"),
        rate("known_30d", "n_30d").alias("repeat_customer_share_merchant"),
        rate("refund_30d", "n_30d").alias("refund_rate_anomaly"),
    )


def _merchant_modes(df, cfg, stats):
    slim = df.select("event_id", "ts_us", "merchant_id", "acceptor_descriptor", "geo_cell")
    out = K.modal_value(K.modal_value(slim, "merchant_id", "acceptor_descriptor", "d"), "merchant_id", "geo_cell", "g")
    return out.select("event_id", S.flag(c("acceptor_descriptor") != c("d")).alias("acceptor_descriptor_mismatch"),
                      S.flag(c("geo_cell") != c("g")).alias("traffic_geo_vs_registered_geo"))


def _note_mode(df, cfg, stats):
    slim = df.select("event_id", "ts_us", "beneficiary_id", "txn_note")
    out = K.modal_value(slim, "beneficiary_id", "txn_note", "m")
    return out.select("event_id", S.token_jaccard(c("txn_note"), c("m")).alias("txn_note_template_score"))


def _geo(df, cfg, stats):
    slim = df.select("event_id", "ts_us", "geo_cell")
    out = Timeline(slim, "geo_cell").trailing_count("d", DAY).trailing_count("w", 7 * DAY).build()
    return out.select("event_id", _neg(c("w") > 0, S.ratio_where(c("d") * 7.0, c("w"), c("w") > 0) - 1.0)
                      .alias("merchant_volume_delta_in_cell"))


def _device(df, cfg, stats):
    slim = df.select("event_id", "ts_us", "device_fingerprint_id", "cardholder_id",
                     F.concat_ws("|", "device_model", "device_os", "ip_asn").alias("bundle"))
    out = K.rolling_entropy(slim, "device_fingerprint_id", c("bundle"), "device_fingerprint_entropy")
    return out.select("event_id", "device_fingerprint_entropy")


def _shared(key: str, out: str):
    def frame(df, cfg, stats):
        slim = df.select("event_id", key, "cardholder_id")
        return K.shared_entity_count(slim, key, "cardholder_id", out).select("event_id", out)
    return frame


def _lite(df, cfg, stats):
    cond = (c("rail") == "upi-lite-offline") & (c("message_kind") == "lite_debit")
    slim = df.select("event_id", "ts_us", "original_auth_event_id", cond.alias("hit"))
    out = K.trailing_count_where(slim, "original_auth_event_id", DAY, c("hit"), "lite_debits_since_topup_24h")
    return out.select("event_id", "lite_debits_since_topup_24h")


def _first_sight(df, cfg, stats):
    """First row of each payer; the blank payer counts as one."""
    slim = df.select("event_id", "ts_us", F.concat(F.lit("p"), c("_primary_key")).alias("k"))
    out = Timeline(slim, "k").prev("p", c("ts_us")).build()
    return out.select("event_id", S.flag(c("p").isNull()).alias("is_first_event_for_entity"))


def onboarding_batches(df: DataFrame) -> DataFrame:
    """Population statistics of each onboarding batch (one row per non-blank batch)."""
    by = "onboarding_batch_id"
    rows = df.filter(~blank(df, [by])).select(
        by, "event_id", "ts_us", "device_model", "ip_asn", "name_ngram_unlikelihood", "address_geocode_density",
        c("beneficiary_first_credit_source").alias("source"), "kyc_tier")
    gaps = Timeline(rows, by).prev("p", c("ts_us")).build().withColumn("gap", (c("ts_us") - c("p")) / 1e6)
    mean, dev = F.avg("gap"), F.stddev_pop("gap")
    cv = F.when(F.abs(mean) > 1e-9, dev / F.nullif(mean, F.lit(0.0))).otherwise(0.0)
    n = F.count(F.lit(1))
    base = gaps.groupBy(by).agg(
        n.cast("double").alias("onboarding_batch_size"),
        F.when(n >= 3, 1.0 - F.least(cv, F.lit(1.0))).otherwise(-1.0).alias("onboarding_batch_timing_cluster"),
        F.avg("name_ngram_unlikelihood").alias("name_ngram_unlikelihood"),
        F.avg("address_geocode_density").alias("address_geocode_density"),
    )
    asn = rows.groupBy(by).agg((1.0 - F.countDistinct(F.coalesce("ip_asn", F.lit(""))) / n).alias("asn_reuse_rate"))
    source = rows.groupBy(by, "source").agg(n.alias("k")).groupBy(by).agg(
        (F.sum(c("k") * c("k")) / (F.sum("k") * F.sum("k"))).alias("first_credit_source_concentration_batch"))
    tier = rows.groupBy(by, "kyc_tier").agg(n.alias("k")).groupBy(by).agg(
        (F.max("k") / F.sum("k")).alias("batch_kyc_tier_uniformity"))
    model = K.group_entropy(rows, [by], "device_model", "device_model_entropy").withColumn(
        "device_os_entropy_collapse", 1.0 - c("device_model_entropy"))
    return reduce(lambda a, b: a.join(b, by), [asn, source, tier, model], base)


def _onboarding(df, cfg, stats):
    names = [n for n in C.family("onboarding_cohort") if n != "onboarding_to_first_credit_minutes"]
    slim = df.select("event_id", "ts", "onboarding_batch_id", "onboarding_ts")
    out = lookup(slim, onboarding_batches(df), ["onboarding_batch_id"], "event_id")
    has = c("onboarding_batch_id") != ""
    return out.select(
        "event_id", *[F.coalesce(c(n), F.lit(-1.0)).alias(n) for n in names],
        _neg(has & (c("onboarding_ts") > 0), (c("ts") - c("onboarding_ts")) / 60.0).alias("onboarding_to_first_credit_minutes"),
    )


def _against_stats(df, cfg, stats: ReferenceStats):
    slim = K.with_gap(df.select(
        "event_id", "ts_us", "_primary_key", "bin_prefix", "_cohort", "geo_cell", "mcc", "auth_to_presentment_ratio"))
    for key, table, out in (("bin_prefix", stats.bin_prior, "p_bin"), ("_cohort", stats.cohort_prior, "p_cohort"),
                            ("geo_cell", stats.geo_prior, "p_geo")):
        slim = lookup(slim, table.withColumnRenamed("prior", out), [key], "event_id")
    slim = lookup(slim, stats.mcc_median, ["mcc"], "event_id").crossJoin(F.broadcast(stats.scalars))
    ratio, gap = c("auth_to_presentment_ratio"), c("_inter_arrival_log")
    return slim.select(
        "event_id",
        F.coalesce("p_bin", "global_rate").alias("bin_issuer_prior_fraud_rate"),
        F.coalesce("p_cohort", "global_rate").alias("peer_cohort_prior_fraud_rate"),
        F.coalesce("p_geo", "global_rate").alias("geo_cell_prior_fraud_rate"),
        F.when(F.coalesce((ratio > 0) & (c("mcc_median") > 0), F.lit(False)), ratio - c("mcc_median")).otherwise(-1.0)
        .alias("auth_to_presentment_ratio_vs_mcc"),
        _neg(gap >= 0, gap - c("modal_gap_log")).alias("inter_arrival_zscore_vs_habit"),
        _neg(gap >= 0, 1.0 / (1.0 + F.abs(gap - c("modal_gap_log")))).alias("inter_arrival_microstructure_similarity"),
    )


def _ben_distinct(df, cfg, stats):
    slim = df.select("event_id", "ts_us", "beneficiary_id", "cardholder_id")
    out = trailing_distinct(slim, ["beneficiary_id"], "cardholder_id", {"beneficiary_distinct_payers_24h": DAY})
    return out.select("event_id", "beneficiary_distinct_payers_24h")


def _velocity(key: str):
    def frame(df, cfg, stats):
        parts = K.velocity_panel(df, {key: COUNTERPARTY[key]}, distinct=False)
        return reduce(lambda a, b: a.join(b, "event_id"), parts)
    return frame


def _distinct(key: str):
    def frame(df, cfg, stats):
        return K.velocity_panel(df, {key: COUNTERPARTY[key]}, encodings=False)[0]
    return frame


@dataclass(frozen=True)
class _Frame:
    build: Callable
    provides: tuple[str, ...]
    needs_stats: bool = field(default=False)


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


FRAMES: tuple[_Frame, ...] = (
    _Frame(_habit, _words("""hour_deviation_from_habit inter_arrival_seconds inter_arrival_log inter_arrival_regularity
        single_field_delta_retry_chain decline_reason_entropy response_code_transition_entropy avs_trajectory_monotone
        cvv2_retry_count entry_mode_transition_flag entry_mode_downgrade_flag response_latency_probe_pattern
        approval_ratio_delta_vs_baseline amount_uniformity_score amount_mass_below_cap_24h threshold_hug_run_length
        cumulative_count_24h_vs_cap amount_ratio_to_own_baseline amount_zscore_to_own_baseline mcc_novelty geo_novelty
        rail_novelty ip_asn_novelty mcc_habit_probability geovelocity_break dormancy_reactivation_flag
        rebinding_to_first_payee_minutes profile_change_before_spend_days fresh_beneficiary_count_24h __own_upi_share""")),
    _Frame(_largest, ("is_largest_ever_for_entity",)),
    _Frame(_churn, ("device_churn_30d",)),
    _Frame(_cohort_share, ("__cohort_upi_share",)),
    _Frame(_cohort_ranks, _words("amount_pct_in_peer_cohort reconciliation_lag_pct_in_peer_cohort")),
    _Frame(_session, _words("""events_in_session debits_per_uninterrupted_session in_app_dwell_uniformity
        escalating_amount_in_session""")),
    _Frame(_bin, ("exemption_rate_per_bin_24h",)),
    _Frame(_token, ("cit_mit_flip_flag",)),
    _Frame(_mandate_terms, ("mandate_cohort_identical_params",)),
    _Frame(_mandate_rank, ("mandate_amount_headroom_pct",)),
    _Frame(_beneficiary, _words("""in_out_skew value_conservation_net_of_skim first_receipt_to_first_send_minutes
        repeat_payer_share payer_set_growth_rate biller_continuity_absent first_credit_source_concentration
        remittance_info_drift amount_vs_vendor_history sketch_round_trip_flow_flag sketch_kcore_acquisition_rate
        sketch_motif_reciprocity sketch_seeder_cluster_membership mandate_creation_rate_per_payee_24h""")),
    _Frame(_payer, _words("""sketch_payer_fanout_degree_24h inbound_credit_then_outbound_different_payee
        balance_enquiry_count_24h balance_enquiry_to_withdrawal_ratio_24h""")),
    _Frame(_geo_payee, ("sketch_geohash_distinct_payer_devices",)),
    _Frame(_merchant, _words("""credit_to_debit_ratio_per_acceptor_24h sketch_first_txn_at_acceptor_share_24h
        merchant_ticket_step_change merchant_ramp_curve_shape merchant_approval_ratio_delta new_mid_ticket_velocity
        foreign_issuer_concentration repeat_customer_share_merchant refund_rate_anomaly""")),
    _Frame(_merchant_modes, _words("acceptor_descriptor_mismatch traffic_geo_vs_registered_geo")),
    _Frame(_note_mode, ("txn_note_template_score",)),
    _Frame(_geo, ("merchant_volume_delta_in_cell",)),
    _Frame(_device, ("device_fingerprint_entropy",)),
    _Frame(_shared("device_fingerprint_id", "sketch_device_shared_entity_count"), ("sketch_device_shared_entity_count",)),
    _Frame(_shared("address_id", "sketch_address_node_density"), ("sketch_address_node_density",)),
    _Frame(_lite, ("lite_debits_since_topup_24h",)),
    _Frame(_first_sight, ("is_first_event_for_entity",)),
    _Frame(_onboarding, tuple(C.family("onboarding_cohort"))),
    _Frame(_ben_distinct, ("beneficiary_distinct_payers_24h",)),
    _Frame(_against_stats, _words("""bin_issuer_prior_fraud_rate peer_cohort_prior_fraud_rate geo_cell_prior_fraud_rate
        auth_to_presentment_ratio_vs_mcc inter_arrival_zscore_vs_habit inter_arrival_microstructure_similarity"""), True),
    *[_Frame(_velocity(k), tuple(n for n in C.family("velocity_panel") if n.startswith(f"vel_{k}_"))) for k in COUNTERPARTY],
    *[_Frame(_distinct(k), tuple(n for n in C.family("velocity_distinct") if n.startswith(f"vel_{k}_"))) for k in COUNTERPARTY],
)

# Features computed from other features once the frames have met.
DERIVED: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "distinct_pan_per_terminal_1h": (("vel_terminal_id_1h_distinct_counterparty",),
                                     lambda: c("vel_terminal_id_1h_distinct_counterparty")),
    "sketch_distinct_payers_per_beneficiary_1h": (("vel_beneficiary_id_1h_distinct_counterparty",),
                                                  lambda: c("vel_beneficiary_id_1h_distinct_counterparty")),
    "sketch_distinct_payers_per_beneficiary_24h": (("vel_beneficiary_id_24h_distinct_counterparty",),
                                                   lambda: c("vel_beneficiary_id_24h_distinct_counterparty")),
    "sketch_pan_token_fanout_7d": (("vel_pan_canonical_7d_distinct_counterparty",),
                                   lambda: c("vel_pan_canonical_7d_distinct_counterparty")),
    "sketch_two_hop_reach_24h": (
        ("vel_beneficiary_id_24h_distinct_counterparty", "sketch_payer_fanout_degree_24h"),
        lambda: F.greatest(c("vel_beneficiary_id_24h_distinct_counterparty"), F.lit(0.0))
        * F.greatest(c("sketch_payer_fanout_degree_24h"), F.lit(0.0))),
    "sketch_fingerprint_collision_degree": (("sketch_device_shared_entity_count",), lambda: c("sketch_device_shared_entity_count")),
    "first_txn_at_acceptor_share": (("sketch_first_txn_at_acceptor_share_24h",), lambda: c("sketch_first_txn_at_acceptor_share_24h")),
    "rail_ratio_vs_peer_cohort": (
        ("__own_upi_share", "__cohort_upi_share"),
        lambda: S.ratio_where(c("__own_upi_share"), c("__cohort_upi_share"),
                              (c("__own_upi_share") >= 0) & (c("__cohort_upi_share") > 0))),
}


def _met(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "event_id", "left"), frames)


def build_features(
    prepared: DataFrame,
    stats: ReferenceStats | None = None,
    names: Iterable[str] | None = None,
    cfg: FeatureConfig = FeatureConfig(),
    carry: Sequence[str] = (),
    as_float: bool = False,
    exchange: DataFrame | None = None,
) -> DataFrame:
    """``event_id``, the ``carry`` columns and the requested features (all model features by default).

    ``prepared`` comes from ``kernels.keyed``; ``event_id`` must be unique.  ``exchange`` holds the set bits of the
    shared risk exchange; without it no beneficiary has a prior.
    """
    names = list(C.MODEL_FEATURES if names is None else names)
    banned = [n for n in names if n in C.NEVER_FEATURES]
    unknown = [n for n in names if n not in C.FEATURES]
    if banned or unknown:
        raise ValueError(f"not features: {banned + unknown}")
    wanted = set(names)
    for n in names:
        wanted |= set(DERIVED[n][0]) if n in DERIVED else set()
    own = {n: col for n, col in row_features(cfg).items() if n in wanted}
    clash = [n for n in carry if n in own]
    if clash:
        raise ValueError(f"carried columns {clash} are features too")
    out = prepared.select("event_id", *carry, *[col.cast("double").alias(n) for n, col in own.items()])
    if exchange is not None and (prior := "beneficiary_prior_from_exchange") in wanted:
        told = exchange_prior(prepared.select("event_id", "beneficiary_id"), exchange, "beneficiary_id", prior)
        out = out.drop(prior).join(told.select("event_id", prior), "event_id", "left")
    parts = []
    with planning(prepared):  # all frames share one count per key
        for frame in FRAMES:
            give = [n for n in frame.provides if n in wanted]
            if not give:
                continue
            if frame.needs_stats and stats is None:
                raise ValueError(f"{give} need fitted reference statistics")
            parts.append(frame.build(prepared, cfg, stats).select("event_id", *give))
    while len(parts) > MEET:  # every frame has all events
        parts = [written(_met(parts[i:i + MEET])) for i in range(0, len(parts), MEET)]
    out = _met([out, *parts])
    out = out.withColumns({n: DERIVED[n][1]() for n in names if n in DERIVED})
    return apply_sentinel(out.select("event_id", *carry, *names), names, as_float)


def missing_features() -> list[str]:
    """Catalogued features no code provides; must be empty."""
    have = set(row_features(FeatureConfig())) | set(DERIVED) | {n for f in FRAMES for n in f.provides}
    return [n for n in C.FEATURES if n not in have]
