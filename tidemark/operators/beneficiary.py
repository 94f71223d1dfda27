"""Beneficiary-side decisions and the shared risk exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

c = F.col

# Exchange geometry and prior, hold bounds.
BITS, HASHES, PRIOR = 65_536, 4, 0.55
MAX_HOLD_HOURS, GOLDEN_HOUR_MINUTES = 24, 60


def positions(key: Column, bits: int = BITS, hashes: int = HASHES) -> Column:
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in range(hashes)]))


def build_exchange(ids: DataFrame, column: str, bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """The set bits of the exchange: at most ``bits`` distinct positions, however many ids."""
    return ids.filter(c(column) != "").select(F.explode(positions(c(column), bits, hashes)).alias("bit")).distinct()


def exchange_prior(rows: DataFrame, exchange: DataFrame, column: str, out: str = "exchange_prior", bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """0.55 where every position of the id is set, else 0.

    The bits travel as one row of 64-bit words indexed by position, ``bits`` / 64 of them, so a probe is one array
    access and one bit test however many bits are set.
    """
    word = lambda b: F.floor(b / 64).cast("int")
    packed = exchange.groupBy(word(c("bit")).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("m"))
    zero = F.lit(0).cast("long")
    every = F.transform(F.sequence(F.lit(0), F.lit((bits + 63) // 64 - 1)), lambda i: F.coalesce(F.try_element_at("__by", i), zero))
    table = packed.agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("__by")).select(every.alias("__held"))
    set_ = lambda b: F.getbit(F.get(c("__held"), word(b)), F.pmod(b, F.lit(64)).cast("int")) == 1
    probe = F.forall(positions(c(column), bits, hashes), set_)
    return rows.crossJoin(F.broadcast(table)).withColumn(out, F.when((c(column) != "") & probe, PRIOR).otherwise(0.0)).drop("__held")


def expected_false_positive_rate(n_inserted: Column, bits: int = BITS, hashes: int = HASHES) -> Column:
    return F.when(n_inserted > 0, F.pow(1.0 - F.exp(-hashes * n_inserted / float(bits)), F.lit(float(hashes)))).otherwise(0.0)


def given(name: str) -> Column:
    """The column, with 0 read as 'not given' like -1: a zero here means the field was never filled."""
    return F.when(c(name) == 0, -1.0).otherwise(c(name).cast("double"))


def no_exchange_fallback(rows: DataFrame) -> DataFrame:
    """What a payer side can use without the exchange: four flags from the row itself."""
    age = given("beneficiary_account_age_days")
    return rows.withColumns({
        "on_us_beneficiary_history": given("beneficiary_inbound_credit_count_24h"), "new_payee_age_days": age,
        "first_payment_to_this_payee": S.flag((age >= 0) & (age < 1)), "payer_side_cooling_off_applicable": S.flag((age >= 0) & (age < 2))})


def decide(rows: DataFrame, t_hold: float, t_freeze: float, score: str = "score", prior: str = "exchange_prior") -> DataFrame:
    """Add ``action`` and ``reason_codes``: a freeze needs two on-us signals, a hold one, the exchange alone a review."""
    within = lambda n, hi: F.coalesce((given(n) >= 0) & (given(n) <= hi), F.lit(False))
    below = lambda n, hi: F.coalesce((given(n) >= 0) & (given(n) < hi), F.lit(False))
    on_us = F.array_compact(F.array(
        F.when(within("in_out_skew", 0.05), "GB_IN_OUT_SKEW"), F.when(within("beneficiary_onward_send_minutes", 10.0), "GB_SHORT_DWELL"),
        F.when((c("beneficiary_distinct_payers_24h") >= 20) & below("beneficiary_account_age_days", 7.0), "GB_PAYER_FANIN"),
        F.when(below("beneficiary_account_age_days", 2.0), "GB_YOUNG_BENEFICIARY"),
        F.when(c("first_credit_source_concentration") >= 0.6, "GB_FIRST_CREDIT_CONCENTRATION"),
        F.when(below("creditor_name_match_score", 0.6), "GB_NAME_MISMATCH")))
    shared = F.array_compact(F.array(F.when(c(prior) > 0, "GB_EXCHANGE_PRIOR")))
    n = F.size("__on_us")
    s = c(score)
    action = S.first_match([((s >= t_freeze) & (n >= 2), "freeze_recommend"), ((s >= t_hold) & (n >= 1), "hold"),
                            ((s >= t_hold) & (F.size("__shared") > 0), "review")], F.lit("approve"))
    out = rows.withColumns({"__on_us": on_us, "__shared": shared}).withColumn("action", action)
    codes = F.when(c("action") == "approve", F.array().cast("array<string>")).otherwise(F.concat("__on_us", "__shared"))
    hold = F.when(c("action").isin("freeze_recommend", "hold"), MAX_HOLD_HOURS).otherwise(0)
    return out.withColumns({"reason_codes": codes, "hold_hours": hold}).drop("__on_us", "__shared")


def freeze_payload(rows: DataFrame, inflow: str, score: str = "score") -> DataFrame:
    """Add ``freeze_payload``: a bounded, auto-releasing hold recommendation on freeze rows, null elsewhere."""
    payload = F.struct(
        c("beneficiary_id"), F.lit("hold_and_escalate").alias("recommendation"), c(score).alias("score"), c("reason_codes"),
        c(inflow).alias("inflow_at_risk_inr"), F.lit(MAX_HOLD_HOURS).alias("max_hold_hours"), F.lit(True).alias("auto_release_unless_escalated"),
        F.lit(GOLDEN_HOUR_MINUTES).alias("golden_hour_target_minutes"))
    return rows.withColumn("freeze_payload", F.when(c("action") == "freeze_recommend", payload))


def false_action_rates(decided: DataFrame, tag: str = "cohort_tag") -> DataFrame:
    """Freeze, hold and review rates on the payee-side hard-benign cohorts, per cohort and overall."""
    rows = decided.filter(c(tag).startswith("hbb_"))
    rate = lambda a: F.avg(S.flag(c("action") == a))
    out = rows.rollup(tag).agg(F.count(F.lit(1)).alias("n"), rate("freeze_recommend").alias("freeze_rate"), rate("hold").alias("hold_rate"), rate("review").alias("review_rate"))
    return out.withColumn(tag, F.coalesce(tag, F.lit("all")))
