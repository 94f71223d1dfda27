"""Rule operators: the invariant catalogue, structural guards, the incumbent scorecard, text rules.

A rule is data: an id, a scope and a SQL condition.  All per-event rules are evaluated in a single
projection that yields the array of broken ids, which is exploded; stream rules are joins and
running columns over the keyed stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schema as V
from tidemark.functions import scalars as S
from tidemark.operators.timeline import novelty
from tidemark.plans.blocks import over_cores
from tidemark.plans.ordered import Running, ordered
from tidemark.plans.values import lookup

c = F.col


def _in(col: str, values: Sequence[str]) -> str:
    return f"{col} IN ({', '.join(repr(v) for v in values)})"


@dataclass(frozen=True)
class Rule:
    """``ok`` must hold within the scope; ``benign_only`` exempts attack events."""

    id: str
    group: str
    ok: str
    rails: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    benign_only: bool = False

    def broken(self) -> str:
        scope = [_in("rail", self.rails)] if self.rails else []
        scope += [_in("message_kind", self.kinds)] if self.kinds else []
        scope += ["NOT oracle_is_attack"] if self.benign_only else []
        return " AND ".join([*scope, f"NOT ({self.ok})"])


# The rail groups the rules refer to.
CNP = ("card-cnp-keyed", "card-cnp-3ds", "card-token-provisioning")
_UNEMPTY = "{} <> ''".format
_NO_3DS = "threeds_authentication_result = 'not_applicable' AND threeds_eci = 'none'"
_NO_CARD_CHECKS = "avs_result IN ('not_requested', '') AND cvv2_result IN ('not_provided', '')"
_AGES = ("device_age_days", "pan_age_days", "vpa_age_days", "account_age_days", "merchant_age_days", "payee_vpa_age_days",
         "beneficiary_account_age_days", "agent_endpoint_age_days", "presentment_age_days", "referrer_domain_age_days")
_ENUMS = (("11", "pos_entry_mode", V.ENTRY_MODES), ("12", "cvm_result", V.CVM_RESULTS), ("13", "avs_result", V.AVS_RESULTS),
          ("14", "cvv2_result", V.CVV2_RESULTS), ("15", "threeds_authentication_result", V.THREEDS_RESULTS),
          ("16", "threeds_eci", V.THREEDS_ECI_BANDS), ("17", "response_code", V.RESPONSE_CODES),
          ("18", "token_assurance_level", V.TOKEN_ASSURANCE), ("19", "dispute_reason_code", V.DISPUTE_REASON_CODES),
          ("20", "upi_initiation_mode", V.INITIATION_MODES), ("21", "cohort_tag", V.COHORT_TAGS))


def _rules(group: str, prefix: str, *rows: tuple) -> list[Rule]:
    """Rows are (number, condition[, rails[, kinds]])."""
    return [Rule(f"F1-{prefix}-{r[0]}", group, r[1], *(tuple(x) for x in r[2:])) for r in rows]


def event_rules(grammar_generator: str = "sim") -> list[Rule]:
    """The 116 per-event invariants."""
    card_auth = (("card-cnp-3ds", "card-cnp-keyed", "card-cp-emv"), ("authorisation",))
    any_rail: tuple[str, ...] = ()
    auths = ("authorisation", "provisioning_request")
    return [
        *_rules(
            "structural", "STR",
            ("01", _UNEMPTY("event_id")), ("02", _in("rail", V.RAILS)), ("03", _in("message_kind", V.MESSAGE_KINDS)),
            ("04", "tier IN ('A', 'B')"),
            ("05", f"({_in('rail', V.TIER_A_RAILS)} AND tier = 'A') OR ({_in('rail', V.TIER_B_RAILS)} AND tier = 'B')"),
            ("06", "amount_inr >= 0"), ("07", "currency = 'INR'"), ("08", "hour_ist >= 0 AND hour_ist < 24"),
            ("09", "dow BETWEEN 0 AND 6"), ("10", "day_index >= 0"),
            *[(n, f"{col} = '' OR {_in(col, values)}") for n, col, values in _ENUMS],
            ("22", "hour_ist >= 0 AND hour_ist <= 23.99"),
            *[(f"AGE-{a}", f"{a} = -1 OR {a} >= 0") for a in _AGES],
        ),
        *_rules(
            "card", "CARD",
            ("01", "NOT emv_cryptogram_present", CNP),
            ("02", "threeds_authentication_result = 'not_applicable'", ("card-cnp-keyed",)),
            ("03", "threeds_eci = 'none'", ("card-cnp-keyed",)),
            ("04", "NOT emv_cryptogram_present OR emv_cryptogram_atc >= 0"),
            ("05", "NOT emv_cryptogram_present OR emv_unpredictable_number <> ''"),
            ("06", "pos_entry_mode <> 'magstripe_fallback' OR NOT emv_cryptogram_present"),
            ("07", _NO_3DS, ("card-cp-emv",)), ("08", _NO_CARD_CHECKS, ("card-cp-emv",)),
            ("09", "pos_entry_mode NOT IN ('chip', 'contactless', 'contactless_no_cvm') OR emv_cryptogram_present", ("card-cp-emv",)),
            ("10", "pos_entry_mode <> 'contactless_no_cvm' OR cvm_result = 'none'"),
            ("11", "threeds_eci <> 'authenticated' OR threeds_authentication_result IN ('frictionless_success', 'challenge_success')"),
            ("12", "threeds_authentication_result NOT IN ('challenge_success', 'challenge_abandoned') OR threeds_challenge_requested", any_rail, auths),
            ("13", "threeds_authentication_result = 'not_applicable' OR threeds_acs_id <> ''", any_rail, auths),
            ("14", "token_assurance_level = 'none' OR token_id <> ''"), ("15", "token_id = '' OR token_requestor_id <> ''"),
            ("16", _UNEMPTY("pan_canonical"), *card_auth), ("17", _UNEMPTY("terminal_id"), ("card-cp-emv",), ("authorisation",)),
            ("18", "provisioning_to_first_spend_minutes >= 0", ("card-token-provisioning",), ("authorisation",)),
            ("19", "amount_inr = 0", any_rail, ("provisioning_request",)),
        ),
        *_rules(
            "upi", "UPI",
            ("01", "NOT emv_cryptogram_present", V.UPI_RAILS), ("02", _NO_3DS, V.UPI_RAILS), ("03", _NO_CARD_CHECKS, V.UPI_RAILS),
            ("04", _UNEMPTY("vpa"), ("upi-pay",), ("authorisation",)), ("05", _UNEMPTY("payee_vpa"), ("upi-pay",), ("authorisation",)),
            ("06", "upi_initiation_mode <> 'not_applicable'", ("upi-pay",), ("authorisation",)),
            ("07", "pos_entry_mode = 'on_device_ledger'", ("upi-lite-offline",), ("lite_debit", "lite_topup")),
            ("08", "cvm_result = 'none'", ("upi-lite-offline",), ("lite_debit", "lite_topup")),
            ("09", "collect_request_id <> '' AND original_auth_event_id <> ''", any_rail, ("collect_response",)),
            ("10", "collect_accepted OR NOT approved", any_rail, ("collect_response",)),
            ("11", "NOT collect_accepted OR cvm_result <> 'none'", any_rail, ("collect_response",)),
            ("12", "cvm_result = 'none'", any_rail, ("collect_request",)),
        ),
        *_rules(
            "a2a", "A2A",
            ("01", _UNEMPTY("pacs_end_to_end_id"), ("a2a-credit-transfer",), ("credit_transfer",)),
            ("02", "pacs_status_code <> '' AND original_auth_event_id <> ''", any_rail, ("credit_transfer_status",)),
            ("03", "pacs_status_code = '' OR (pacs_status_code = 'ACSC') = approved", any_rail, ("credit_transfer_status",)),
            ("04", _UNEMPTY("creditor_name_string"), ("a2a-credit-transfer",), ("credit_transfer",)),
        ),
        *_rules(
            "mandate", "MND",
            *[(n, ok, any_rail, ("mandate_debit",)) for n, ok in (
                ("01", _UNEMPTY("mandate_id")), ("02", "mandate_max_amount_inr > 0"),
                ("03", "amount_inr <= mandate_max_amount_inr OR NOT approved"),
                ("04", "amount_inr <= mandate_max_amount_inr OR response_code = 'declined_mandate_scope'"),
                ("05", "cit_mit_indicator = 'MIT'"))],
            ("06", "cit_mit_indicator <> 'MIT' OR cvm_result = 'none'"),
            ("07", "pre_debit_notification_sent", any_rail, ("mandate_debit",)),
            ("08", "cit_mit_indicator = 'CIT'", any_rail, ("mandate_creation",)), ("09", "amount_inr = 0", any_rail, ("mandate_creation",)),
            ("10", "mandate_created_ts <= 0 OR ts >= mandate_created_ts", any_rail, ("mandate_debit",)),
            ("11", "mandate_max_amount_inr <= 0 OR (amount_inr > mandate_max_amount_inr) = (response_code = 'declined_mandate_scope')", any_rail, ("agent_authorisation",)),
        ),
        *_rules(
            "agentic", "AGT",
            ("01", "agentic_indicator", ("agentic-commerce",)), ("02", _UNEMPTY("agent_identity_id"), ("agentic-commerce",)),
            ("03", "cvm_result = 'none' AND NOT emv_cryptogram_present", ("agentic-commerce",)),
            ("04", "agent_quoted_amount_inr >= 0", any_rail, ("agent_authorisation",)),
        ),
        *_rules(
            "aeps", "AEPS",
            ("01", "cvm_result = 'biometric'", ("aeps-microatm",)), ("02", _UNEMPTY("terminal_id"), ("aeps-microatm",)),
            ("03", "beneficiary_id = ''", ("aeps-microatm",)), ("04", "amount_inr = 0", any_rail, ("balance_enquiry",)),
        ),
        *_rules(
            "response", "RESP",
            ("01", "NOT approved OR response_code IN ('approved', 'approved_partial')"),
            ("02", "NOT approved OR NOT (response_code LIKE 'declined!_%' ESCAPE '!' OR response_code LIKE 'step!_up%' ESCAPE '!' "
                   "OR response_code LIKE 'referred%' OR response_code LIKE 'timeout%')"),
            ("03", "incumbent_decision <> 'decline' OR NOT approved"),
            ("04", "incumbent_accept_probability = -1 OR (incumbent_accept_probability > 0 AND incumbent_accept_probability < 1)"),
            ("05", "incumbent_decision = '' OR incumbent_accept_probability > 0"), ("06", "response_code = '' OR response_latency_ms >= 0"),
            ("07", "response_code <> 'step_up_required' OR rail IN ('card-cnp-3ds', 'card-token-provisioning')"),
        ),
        *_rules(
            "beneficiary", "BEN",
            ("01", _UNEMPTY("beneficiary_id"), any_rail, ("inbound_credit",)), ("02", _UNEMPTY("original_auth_event_id"), any_rail, ("inbound_credit",)),
            ("03", "approved", any_rail, ("inbound_credit",)),
            ("04", "beneficiary_id <> '' AND original_auth_event_id <> ''", any_rail, ("onward_send",)),
            ("05", "rail NOT IN ('card-cp-emv', 'aeps-microatm', 'card-clearing-dispute')", any_rail, ("inbound_credit", "onward_send")),
            ("06", "beneficiary_dwell_seconds < 0 OR beneficiary_onward_send_minutes < 0 OR abs(beneficiary_dwell_seconds / 60 - beneficiary_onward_send_minutes) < 0.001"),
            ("07", "beneficiary_fanin_degree < 0 OR beneficiary_distinct_payers_24h < 0 OR beneficiary_fanin_degree >= beneficiary_distinct_payers_24h"),
        ),
        *_rules("provisioning", "PROV", ("01", _UNEMPTY("token_id"), any_rail, ("provisioning_request",)),
                ("02", "provisioning_event_id = event_id", any_rail, ("provisioning_request",))),
        *_rules(
            "dispute", "DSP",
            ("01", "dispute_reason_code <> 'none'", any_rail, ("chargeback",)), ("02", "dispute_filed_ts > 0", any_rail, ("chargeback",)),
            ("03", "NOT representment_won OR representment_filed"), ("04", "dispute_reason_code = 'none' OR message_kind IN ('chargeback', 'representment')"),
        ),
        *_rules(
            "clearing", "CLR",
            ("01", "settlement_amount_inr >= 0", any_rail, ("presentment",)), ("02", "presentment_age_days >= 0", any_rail, ("presentment",)),
            ("03", "CASE WHEN auth_to_presentment_ratio < 0 OR amount_inr <= 0 THEN TRUE "
                   "ELSE abs(settlement_amount_inr / amount_inr - auth_to_presentment_ratio) < 0.0001 END", any_rail, ("presentment",)),
            ("04", "refund_amount_inr >= 0", any_rail, ("refund_credit",)),
            ("05", "refund_amount_inr < 0 OR abs(refund_amount_inr - amount_inr) < 0.000001", any_rail, ("refund_credit",)),
        ),
        *_rules(
            "oracle", "ORC",
            ("01", "NOT oracle_is_attack OR attack_campaign_id <> ''"), ("02", "oracle_is_attack OR attack_campaign_id = ''"),
            ("03", f"NOT oracle_is_attack OR generator <> '{grammar_generator}' OR attack_grammar_str <> ''"),
            ("04", "NOT sealed_holdout OR oracle_is_attack"), ("05", "cohort_tag = 'ordinary' OR NOT oracle_is_attack"),
        ),
    ]


STREAM_RULES = ("F1-PAIR-01", "F1-PAIR-02", "F1-PAIR-03", "F1-PAIR-04", "F1-PAIR-05", "F1-PAIR-06",
                "F1-AMT-01", "F1-AMT-02", "F1-ATC-01", "F1-BEN-08")
# Kinds that must point at an earlier message, and kinds that can be pointed at.
DERIVED_KINDS = ("presentment", "chargeback", "representment", "refund_credit", "reversal", "incremental_auth")
ANTECEDENT_KINDS = ("authorisation", "provisioning_request", "collect_request", "mandate_creation", "pre_debit_notification",
                    "credit_transfer", "inbound_credit", "lite_topup", "agent_mandate_object", "mandate_debit")
VIOLATION = ("invariant_id", "event_id", "rail", "message_kind")


def check_event_rules(events: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """(invariant_id, event_id, rail, message_kind) per broken per-event rule."""
    rules = event_rules() if rules is None else rules
    broken = ", ".join(f"CASE WHEN {r.broken()} THEN '{r.id}' END" for r in rules)
    # A projection of its own, without a lambda: both would leave the rules to be interpreted row by row.
    told = over_cores(events).select(F.expr(f"concat_ws(',', {broken})").alias("__ids"), "event_id", "rail", "message_kind")
    # Outer, as a filter below the explode would look at all rules a second time.
    return told.select(F.explode_outer(F.split("__ids", ",")).alias("invariant_id"), "event_id", "rail", "message_kind").filter("invariant_id != ''")


def check_stream_rules(events: DataFrame) -> DataFrame:
    """The ten cross-event invariants over the stream in (ts, event_id) order."""
    at = F.struct("ts", "event_id")
    slim = events.select("event_id", "ts", "rail", "message_kind", "amount_inr", "approved", "rrn", "settlement_amount_inr",
                         "original_auth_event_id", "pan_canonical", "emv_cryptogram_present", "emv_cryptogram_atc",
                         "oracle_is_attack", "beneficiary_id").withColumn("at", at).withColumn("ts_us", F.round(c("ts") * 1e6).cast("long"))
    benign = ~c("oracle_is_attack")

    # Everything an event id can be resolved to: its time, and its antecedent fields if it is one.
    by_id = slim.groupBy(c("event_id").alias("original_auth_event_id")).agg(
        F.min("at").alias("ref_at"), F.count(F.lit(1)).alias("copies"),
        F.min(F.when(c("message_kind").isin(*ANTECEDENT_KINDS), F.struct("at", "rrn", "amount_inr", "approved"))).alias("ante"),
    )
    first_rrn = slim.filter(c("message_kind").isin(*ANTECEDENT_KINDS) & (c("rrn") != "")).groupBy("rrn").agg(F.min("at").alias("rrn_at"))
    derived = slim.filter(c("message_kind").isin(*DERIVED_KINDS))
    linked = lookup(lookup(derived, by_id, ["original_auth_event_id"], "event_id"), first_rrn, ["rrn"], "event_id")
    ante = F.when(c("ante.at") < c("at"), c("ante"))
    resolved = ante.isNotNull() | F.coalesce((c("rrn") != "") & (c("rrn_at") < c("at")), F.lit(False))
    # Presentments of the same antecedent that came earlier, and refunds accumulated against it.
    presented = slim.filter(c("message_kind") == "presentment").groupBy("original_auth_event_id").agg(F.min("at").alias("presented_at"))
    linked = lookup(linked, presented, ["original_auth_event_id"], "event_id")
    refunds = ordered(
        slim.filter((c("message_kind") == "refund_credit") & (c("original_auth_event_id") != "")).select("original_auth_event_id", "ts_us", "event_id", "amount_inr"),
        ["original_auth_event_id"], ["ts_us", "event_id"], {"refunded": Running("sum", c("amount_inr"), inclusive=True)},
    ).select("event_id", "refunded")
    linked = linked.join(refunds, "event_id", "left")
    kind, base = c("message_kind"), ante["amount_inr"]
    ratio = F.when((kind == "presentment") & (base > 0) & (c("settlement_amount_inr") >= 0), c("settlement_amount_inr") / F.nullif(base, F.lit(0.0)))
    cases = {
        "F1-PAIR-01": benign & ~resolved & c("ref_at").isNull(),
        "F1-PAIR-06": benign & ~resolved & c("ref_at").isNotNull(),
        "F1-PAIR-02": benign & (c("rrn") != "") & (ante["rrn"] != "") & (c("rrn") != ante["rrn"]),
        "F1-PAIR-03": (kind == "presentment") & ~ante["approved"],
        "F1-PAIR-04": (kind == "chargeback") & (c("original_auth_event_id") != "") & ~F.coalesce(c("presented_at") < c("at"), F.lit(False)),
        "F1-AMT-01": benign & (kind == "refund_credit") & (c("refunded") > base + 1e-6),
        "F1-AMT-02": (ratio < 0.5) | (ratio > 2.0),
    }
    paired = linked.select(F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(i)) for i, cond in cases.items()]))).alias("invariant_id"),
                           "event_id", "rail", "message_kind")

    dup = slim.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "rail", "message_kind")).alias("last"))
    dups = dup.filter("n > 1").select(F.explode(F.array_repeat(F.lit("F1-PAIR-05"), (c("n") - 1).cast("int"))).alias("invariant_id"),
                                      "event_id", "last.rail", "last.message_kind")
    # Cards without a number share one counter here, as any other value would.
    counters = counter_regressions(slim.filter(benign).withColumn("pan_canonical", F.concat(F.lit("p"), "pan_canonical"))).filter("regressed").select(F.lit("F1-ATC-01").alias("invariant_id"), "event_id", "rail", "message_kind")
    flows = slim.filter(kind.isin("inbound_credit", "onward_send") & (c("beneficiary_id") != "")).select("event_id", "ts_us", "rail", "message_kind", "beneficiary_id", "amount_inr")
    net = ordered(flows, ["beneficiary_id"], ["ts_us", "event_id"], {
        "net": Running("sum", F.when(kind == "onward_send", c("amount_inr")).otherwise(-c("amount_inr")), inclusive=True)})
    over = net.filter((kind == "onward_send") & (c("net") > 1e-6)).select(F.lit("F1-BEN-08").alias("invariant_id"), "event_id", "rail", "message_kind")
    return paired.unionByName(dups).unionByName(counters).unionByName(over)


def counter_regressions(events: DataFrame) -> DataFrame:
    """Events with a cryptogram counter, flagged where it is not above the card's running maximum."""
    rows = events.filter(c("emv_cryptogram_present") & (c("emv_cryptogram_atc") >= 0))
    seen = ordered(rows, ["pan_canonical"], ["ts_us", "event_id"], {"__max": Running("max", c("emv_cryptogram_atc"))})
    return seen.withColumn("regressed", F.coalesce(c("emv_cryptogram_atc") <= c("__max"), F.lit(False))).drop("__max")


def check_events(events: DataFrame) -> DataFrame:
    return check_event_rules(events).unionByName(check_stream_rules(events))


def violation_report(violations: DataFrame, samples: int = 6) -> DataFrame:
    """Count and first event ids per invariant, loudest first.

    The rank filter is pushed below the shuffle, so a loud rule moves a handful of rows per task.
    """
    counts = violations.groupBy("invariant_id").agg(F.count(F.lit(1)).alias("n_violations"))
    ranked = violations.withColumn("r", F.row_number().over(Window.partitionBy("invariant_id").orderBy("event_id")))
    taken = ranked.filter(c("r") <= samples).groupBy("invariant_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("event_id"))).alias("samples"))
    return counts.join(taken, "invariant_id").orderBy(F.desc("n_violations"), "invariant_id")


def rule_catalogue(spark) -> DataFrame:
    rows = [(r.id, r.group, "per-event", r.ok) for r in event_rules()] + [(i, i.split("-")[1].lower(), "stream", "") for i in STREAM_RULES]
    return spark.createDataFrame(rows, "invariant_id string, rule_group string, kind string, condition string")


# --- structural guards -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Guard:
    id: str
    code: str
    hit: str
    advisory: bool = False
    override: str | None = None


# Guard ids, reason codes, conditions and action overrides.
GUARDS = (
    Guard("G0-01", "G0_CRYPTOGRAM_ON_KEYED", f"{_in('rail', CNP)} AND emv_cryptogram_present"),
    Guard("G0-02", "G0_THREEDS_ON_NON_CNP", "rail NOT IN ('card-cnp-3ds', 'card-token-provisioning', 'card-clearing-dispute') AND "
          f"{_in('rail', V.RAILS)} AND threeds_authentication_result NOT IN ('', 'not_applicable')"),
    Guard("G0-03", "G0_MIT_WITHOUT_ORIGINAL", "cit_mit_indicator = 'MIT' AND original_auth_event_id = '' AND mandate_id = ''"),
    Guard("G0-04", "G0_MANDATE_SCOPE_VIOLATION", "mandate_max_amount_inr > 0 AND amount_inr > mandate_max_amount_inr + 0.000001"),
    Guard("G0-05", "G0_CRYPTOGRAM_UNVERIFIED", "emv_cryptogram_present AND NOT emv_cryptogram_verified"),
    Guard("G0-06", "G0_REFUND_NO_ORIGINAL", "message_kind = 'refund_credit' AND original_auth_event_id = '' AND rrn = ''"),
    Guard("G0-07", "G0_REFUND_EXCEEDS_ORIGINAL", "message_kind = 'refund_credit' AND refund_amount_inr > 0 AND refund_amount_inr > amount_inr + 0.000001"),
    Guard("G0-08", "G0_AGENT_OVER_MANDATE", "message_kind = 'agent_authorisation' AND agent_quoted_amount_inr > 0 AND amount_inr > agent_quoted_amount_inr * 1.001",
          override="mandate_refuse"),
    Guard("G0-09", "G0_COLLECT_FANOUT", "message_kind = 'collect_request' AND collect_fanout >= {fanout}", advisory=True, override="collect_suppress"),
    Guard("G0-10", "G0_ATC_REGRESSION", "atc_regressed"),
)


def collect_fanout(events: DataFrame) -> DataFrame:
    """(event_id, collect_fanout): distinct payers this payee has asked within the hour, this one included."""
    rows = events.filter((c("message_kind") == "collect_request") & (c("payee_vpa") != "")).select(
        "event_id", "ts_us", "payee_vpa", F.floor(c("ts_us") / 3_600_000_000).alias("hour"), "cardholder_id")
    fresh = novelty(rows, ["payee_vpa", "hour"], ["cardholder_id"], "__new")
    run = ordered(fresh, ["payee_vpa", "hour"], ["ts_us", "event_id"], {"collect_fanout": Running("sum", c("__new"), inclusive=True)})
    return run.select("event_id", "collect_fanout")


def structural_guards(events: DataFrame, fanout_threshold: int = 25) -> DataFrame:
    """Fired guards per event: codes in rule order, refusal, first override and first rule."""
    full = V.complete(events).withColumn("ts_us", F.round(c("ts") * 1e6).cast("long"))
    counters = counter_regressions(full.filter(c("pan_canonical") != "").select(
        "event_id", "ts_us", "pan_canonical", "emv_cryptogram_present", "emv_cryptogram_atc")).select("event_id", c("regressed").alias("atc_regressed"))
    rows = full.join(collect_fanout(full), "event_id", "left").join(counters, "event_id", "left").fillna({"collect_fanout": -1.0, "atc_regressed": False})
    hits = ", ".join(
        f"CASE WHEN {g.hit.format(fanout=fanout_threshold)} THEN named_struct('id', '{g.id}', 'code', '{g.code}', 'hard', {str(not g.advisory).lower()}, "
        f"'override', {repr(g.override) if g.override else 'CAST(NULL AS STRING)'}) END" for g in GUARDS)
    fired = rows.select("event_id", F.expr(f"array_compact(array({hits}))").alias("g"))
    return fired.select(
        "event_id", c("g.code").alias("reason_codes"), F.exists("g", lambda x: x["hard"]).alias("refuse"),
        F.get(F.filter(c("g.override"), lambda o: o.isNotNull()), F.lit(0)).alias("action_override"), F.get(c("g.id"), F.lit(0)).alias("guard_rule"))


# --- incumbent scorecard -------------------------------------------------------------------------------

# The incumbent's per-rail ceilings, weights and conditions.
INCUMBENT_CEILING = {
    "card-cnp-3ds": 60_000.0, "card-cnp-keyed": 25_000.0, "card-cp-emv": 50_000.0, "card-token-provisioning": 40_000.0,
    "upi-pay": 50_000.0, "upi-collect": 20_000.0, "upi-autopay-mandate": 30_000.0, "a2a-credit-transfer": 300_000.0,
    "upi-lite-offline": 500.0, "aeps-microatm": 10_000.0, "agentic-commerce": 30_000.0, "card-clearing-dispute": 1e12,
}
INCUMBENT_RULES = (
    ("INC-01", 0.34, "amount_inr > ceiling"), ("INC-02", 0.30, "cvv2_result = 'no_match'"), ("INC-03", 0.22, "avs_result = 'no_match'"),
    ("INC-04", 0.26, "pos_entry_mode = 'magstripe_fallback'"),
    ("INC-05", 0.20, "pos_entry_mode = 'contactless_no_cvm' AND amount_inr > 3000"),
    ("INC-06", 0.28, "payee_vpa_age_days >= 0 AND payee_vpa_age_days < 2"), ("INC-07", 0.24, "device_age_days >= 0 AND device_age_days < 1"),
    ("INC-08", 0.18, "acceptor_country NOT IN ('', 'IN')"), ("INC-09", 0.32, "nth_today > 12"),
    ("INC-10", 0.16, "mcc IN ('6011', '6051', '6540', '4814')"), ("INC-11", 0.36, "mandate_max_amount_inr > 0 AND amount_inr > mandate_max_amount_inr"),
    ("INC-12", 0.14, "hour_ist >= 0 AND hour_ist < 5"), ("INC-13", 0.20, "emv_cryptogram_present AND NOT emv_cryptogram_verified"),
    ("INC-14", 0.30, "message_kind = 'refund_credit' AND original_auth_event_id = ''"),
)


def incumbent_scorecard(events: DataFrame, epsilon: float = 0.05, threshold: float = 0.62, tau: float = 0.12) -> DataFrame:
    """The legacy engine's additive score, the rules behind it and its accept probability."""
    key = F.concat(F.lit("k"), F.coalesce(*[F.nullif(c(k), F.lit("")) for k in ("pan_canonical", "vpa", "cardholder_id")], F.lit("")))
    rows = events.withColumns({"__who": key, "ts_us": F.round(c("ts") * 1e6).cast("long"),
                               "ceiling": S.mapped(c("rail"), INCUMBENT_CEILING, 50_000.0)})
    slim = rows.select("event_id", "ts_us", "__who", "day_index")
    nth = ordered(slim, ["__who", "day_index"], ["ts_us", "event_id"], {"nth_today": Running("count", F.lit(1), inclusive=True)}).select("event_id", "nth_today")
    hits = ", ".join(f"CASE WHEN {cond} THEN '{i}' END" for i, _, cond in INCUMBENT_RULES)
    total = " + ".join(f"CASE WHEN {cond} THEN {w}D ELSE 0D END" for _, w, cond in INCUMBENT_RULES)
    scored = rows.join(nth, "event_id").select("event_id", F.expr(total).alias("score"), F.expr(f"array_join(array_compact(array({hits})), ',')").alias("rules_fired"))
    decline = epsilon + (1.0 - 2.0 * epsilon) / (1.0 + F.exp(-(c("score") - threshold) / tau))
    return scored.withColumn("accept_probability", 1.0 - decline)


# --- text rules ------------------------------------------------------------------------------------------

# Content-policy patterns (case-insensitive) and why each rejects.
TEXT_RULES = (
    ("DU-01", r"\b(bypass|circumvent|defeat|evade)\s+(the\s+)?(3ds|3-d\s*secure|liveness|kyc|otp|captcha|bot\s*defence|bot\s*defense)\b", "describes defeating a control"),
    ("DU-02", r"\b(step\s*1|step\s*one|first,?\s+then|procedure:|instructions:|how\s+to\s+(?:obtain|generate|produce))\b", "reads as instruction"),
    ("DU-03", r"(?:^|\n)\s*(?:import\s+\w+|def\s+\w+\s*\(|curl\s+|POST\s+/|SELECT\s+.+FROM|<\?php|#!/)", "executable code"),
    ("DU-04", r"\b(?:4[0-9]{15}|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", "card number of a real scheme"),
    ("DU-05", r"\b(?:\+91[\-\s]?)?[6-9]\d{9}\b", "mobile number shape"),
    ("DU-06", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "bank branch code shape"),
    ("DU-07", r"\b(?:enumerat\w+|brute[\s-]?forc\w+|card[\s-]?test\w+)\s+(?:script|tool|procedure|routine|loop)\b", "enumeration procedure"),
    ("DU-08", r"\b(?:visa|mastercard|amex|american\s+express|rupay|npci|upi\s+api|paytm|phonepe|gpay|razorpay)\b\s*(?:\w+\s+){0,3}(?:bypass|vulnerab\w+|exploit|weakness|flaw)\b", "vulnerability claim about a named product"),
    ("DU-09", r"\b(?:dear\s+(?:customer|sir|madam)|your\s+account\s+(?:has\s+been|will\s+be)\s+(?:suspended|blocked|frozen)|click\s+(?:here|the\s+link)|urgent(?:ly)?\s+(?:verify|update)|congratulations,?\s+you)\b", "scam copy"),
    ("DU-10", r"\b(?:deepfake|face[\s-]?swap|voice[\s-]?clon\w+)\s+(?:pipeline|model|code|implementation|how|tutorial)\b", "impersonation tooling"),
    ("DU-11", r"\b(?:cvv|cvc|cvv2)\s*[:=]\s*\d{3,4}\b|\bexpiry\s*[:=]\s*\d{2}\s*/\s*\d{2}\b", "credential value"),
    ("DU-12", r"\b(?:aadhaar|aadhar)\s*(?:number|no\.?|#)?\s*[:=]?\s*\d{4}\s*\d{4}\s*\d{4}\b", "national id shape"),
)


def scan_text(df: DataFrame, key: str, columns: Sequence[str], rules=TEXT_RULES) -> DataFrame:
    """One row per (row, field, rule) hit, with the first match cut to 80 characters."""
    def hit(col: str, rule: tuple) -> Column:
        found = F.regexp_extract(F.coalesce(c(col), F.lit("")), f"(?iuU){rule[1]}", 0)
        return F.when(found != "", F.struct(F.lit(rule[0]).alias("rule_id"), F.lit(rule[2]).alias("rationale"), F.lit(col).alias("field"),
                                            F.substring(found, 1, 80).alias("matched_text")))
    hits = F.explode(F.array_compact(F.array(*[hit(col, r) for col in columns for r in rules])))
    return over_cores(df.select(key, *columns)).select(key, hits.alias("h")).select(key, "h.rule_id", "h.rationale", "h.field", "h.matched_text")


def text_rule_summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_hits"))
