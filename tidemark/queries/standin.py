"""Payment events derived from the given ``events`` table.

Every event row becomes one payment event whose columns are arithmetic on the row's own values, so
the derived table grows with the given one.  The expressions are written in SQL that both Spark and
the checking engine understand; columns not listed take their schema default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.blocks import offer, over_cores
from tidemark.queries.registry import epoch_us, table
from tidemark.schema import EVENT_SCHEMA, complete

HOUR_US = 3_600_000_000


def pick(index: str, *values: str) -> str:
    """CASE over ``index % n`` choosing one of n texts."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE ({index}) % {len(values)} {whens} ELSE '{values[-1]}' END"


def tag(prefix: str, index: str) -> str:
    return f"CONCAT('{prefix}', CAST({index} AS STRING))"


def maybe(cond: str, expr: str, other: str = "''") -> str:
    return f"CASE WHEN {cond} THEN {expr} ELSE {other} END"


def whole(expr: str) -> str:
    return f"CAST(FLOOR({expr}) AS BIGINT)"


# Base columns: e event_id, us microseconds, u user, v value, k the number in props.
_HOUR = f"{whole(f'us / {HOUR_US}.0')}"
_BEN = "(e % 5 < 2)"
COLUMNS: dict[str, str] = {
    "event_id": tag("e", "e"),
    "ts": f"CAST({_HOUR} AS DOUBLE) * 3600",
    "day_index": whole(f"us / {24 * HOUR_US}.0") + " - 19723",
    "hour_ist": f"CAST({_HOUR} % 24 AS DOUBLE)",
    "dow": whole(f"us / {24 * HOUR_US}.0") + " % 7",
    "rail": pick("e + k", "card-cnp-3ds", "upi-pay", "card-cnp-keyed", "upi-collect", "card-cp-emv", "aeps-microatm",
                 "upi-autopay-mandate", "a2a-credit-transfer", "card-clearing-dispute", "upi-lite-offline",
                 "card-token-provisioning", "agentic-commerce"),
    "message_kind": pick("e * 7 + k", "authorisation", "inbound_credit", "authorisation", "onward_send", "presentment",
                         "refund_credit", "mandate_debit", "authorisation", "collect_request", "chargeback",
                         "mandate_creation", "profile_change", "inbound_credit"),
    "tier": maybe("(e + k) % 12 IN (5, 9, 11)", "'B'", "'A'"),
    "amount_inr": "CASE WHEN e % 6 = 0 THEN 500.0 * (1 + k % 4) WHEN e % 6 = 1 THEN 4950.0 + k % 49 ELSE v * 41.730585786 END",
    "settlement_amount_inr": maybe("e % 4 = 1", "v * 40.0", "-1.0"),
    "pan_canonical": maybe("e % 13 <> 0", tag("p", "u % 50")),
    "token_id": maybe("e % 3 = 0", tag("t", "u % 30")),
    "token_requestor_id": maybe("e % 3 = 0", tag("r", "u % 5")),
    "device_fingerprint_id": maybe("e % 23 <> 0", tag("d", "(u * 7 + k) % 45")),
    "terminal_id": maybe("e % 4 = 0", tag("x", "k % 12")),
    "merchant_id": maybe("e % 7 <> 0", tag("m", "k % 20")),
    "bin_prefix": tag("b", "u % 8"),
    "vpa": maybe("e % 2 = 0", tag("v", "u % 40")),
    "beneficiary_id": maybe(_BEN, tag("ben", "(u + k) % 35")),
    "cardholder_id": maybe("e % 19 <> 0", tag("c", "u % 60")),
    "issuer_id": tag("i", "u % 4"),
    "address_id": maybe("e % 9 <> 0", tag("a", "(u + e) % 25")),
    "mcc": pick("k", "6011", "5411", "4111", "5999", "8011", "", "7011", "1234", "6051"),
    "acceptor_descriptor": f"CONCAT('Shop ', {pick('k', '6011', '5411', 'north', 'east')}, ' ', {pick('e', 'one', 'two', 'one')})",
    "acceptor_country": maybe("k % 10 = 0", "'US'", "'IN'"),
    "geo_cell": tag("te7", "k % 15"),
    "merchant_age_days": "k * 1.5 - 1",
    "pos_entry_mode": pick("e + u", "chip", "keyed", "contactless", "magstripe_fallback", "ecommerce", "intent", "contactless_no_cvm"),
    "cvm_result": pick("e + k", "none", "online_pin", "none", "biometric", "cdcvm", "none", "signature"),
    "avs_result": pick("u + k", "not_requested", "no_match", "match", "partial_match", "unavailable"),
    "cvv2_result": pick("e * 3 + k", "not_provided", "no_match", "match"),
    "stand_in_indicator": "e % 29 = 0",
    "threeds_authentication_result": pick("e + k", "frictionless_success", "not_applicable", "not_applicable",
                                          "challenge_abandoned", "not_applicable", "challenge_success"),
    "threeds_eci": pick("k", "none", "authenticated", "none", "attempted"),
    "threeds_acs_id": maybe("e % 8 <> 0", "'acs1'"),
    "threeds_field_population_score": "k / 100.0",
    "threeds_challenge_requested": "e % 5 <> 0",
    "threeds_device_channel": pick("k", "app", "browser"),
    "threeds_screen_wh": pick("e", "1280x720", "390x844", "1920x1080"),
    "threeds_timezone_offset_min": "CASE WHEN k % 3 = 0 THEN 330 WHEN k % 3 = 1 THEN 60 ELSE -1 END",
    "threeds_language": pick("e + u", "en-IN", "ru-RU", "hi-IN", ""),
    "threeds_ip_asn": pick("u", "AS64501", "AS13335", "", "AS64510"),
    "emv_cryptogram_present": "(e + k) % 12 IN (4, 5) OR e % 31 = 0",
    "emv_cryptogram_atc": maybe("e % 37 <> 0", whole("e / 2.0") + " + k", "-1"),
    "emv_cryptogram_verified": "k % 6 <> 0",
    "emv_unpredictable_number": maybe("e % 41 <> 0", "'un'"),
    "issuer_application_data_consistent": "k % 8 <> 0",
    "token_assurance_level": pick("u + e", "none", "low", "medium", "high"),
    "provisioning_event_id": maybe("e % 2 = 0", tag("e", "e")),
    "provisioning_to_first_spend_minutes": "k - 5.0",
    "mandate_id": maybe("e % 4 < 2", tag("md", "u % 25")),
    "mandate_max_amount_inr": maybe("e % 4 < 2", "2000.0 * (k % 5)", "-1.0"),
    "mandate_frequency": pick("k", "weekly", "monthly", "daily"),
    "mandate_permitted_mcc": pick("e", "6011", "", "5411"),
    "mandate_debit_count_to_date": "k % 4 - 1",
    "mandate_created_ts": maybe("e % 4 < 2 AND k % 7 <> 0", f"CAST({_HOUR} AS DOUBLE) * 3600 - k * 1000", "-1.0"),
    "cit_mit_indicator": pick("e + k", "CIT", "MIT", ""),
    "pre_debit_notification_sent": "k % 2 = 0",
    "upi_initiation_mode": pick("e + k", "intent", "qr_static", "not_applicable", "collect", "mandate"),
    "payee_vpa": maybe("e % 3 <> 0", tag("pv", "k % 10")),
    "payee_name_string": pick("k", "Shop north one", "Acme", "shop 6011", ""),
    "payee_vpa_age_days": "k / 4.0 - 1",
    "txn_note": pick("e + k", "rent march", "gift", "", "rent april", "gift"),
    "referrer_domain_age_days": "k * 3.0 - 1",
    "collect_request_id": maybe("e % 3 = 0", tag("cr", "e % 50")),
    "collect_accepted": "k % 3 = 0",
    "pacs_end_to_end_id": maybe("e % 5 <> 0", tag("ee", "e")),
    "pacs_status_code": pick("k", "ACSC", "RJCT", ""),
    "creditor_name_string": maybe("e % 6 <> 0", "'Acme'"),
    "creditor_name_match_score": "k / 100.0 - 0.05",
    "remittance_info": pick("e + u", "invoice 12 acme", "invoice 13 acme", "salary", "", "invoice 12 acme"),
    "beneficiary_category": pick("u + k", "biller", "p2p_individual", "crypto_onramp", "payroll", "unknown"),
    "beneficiary_change_ts": maybe("k % 9 = 0", f"CAST({_HOUR} AS DOUBLE) * 3600 - 7200", "-1.0"),
    "beneficiary_account_age_days": maybe(_BEN, "CAST(k AS DOUBLE) / 3", "-1.0"),
    "beneficiary_inbound_credit_count_24h": "k % 9 - 1",
    "beneficiary_distinct_payers_24h": maybe(_BEN, "k % 30", "-1"),
    "beneficiary_inflow_24h_inr": maybe(_BEN, "k * 100.0", "-1.0"),
    "beneficiary_outflow_24h_inr": maybe(_BEN, "k * 97.0", "-1.0"),
    "beneficiary_dwell_seconds": maybe(_BEN, "k * 30.0", "-1.0"),
    "beneficiary_onward_send_minutes": maybe(f"{_BEN} AND k % 5 <> 0", "k * 0.5", "-1.0"),
    "beneficiary_fanin_degree": maybe(_BEN, "k % 25", "-1"),
    "beneficiary_fanout_degree": maybe(_BEN, "k % 6", "-1"),
    "beneficiary_first_credit_source": pick("k", "salary", "p2p", "wallet"),
    "beneficiary_kyc_tier": pick("u", "none", "min_kyc", "full_kyc"),
    "original_auth_event_id": maybe("e % 3 <> 0", tag("e", "CASE WHEN k % 10 = 0 THEN e + 5 WHEN k % 10 = 1 THEN -1 ELSE e - 1 - k % 5 END")),
    "rrn": maybe("k % 11 <> 0", tag("rr", "CASE WHEN e % 17 = 0 THEN e ELSE " + whole("e / 10.0") + " END")),
    "presentment_age_days": "k / 10.0 - 1",
    "auth_to_presentment_ratio": "0.5 + k / 80.0",
    "incremental_auth_present": "k % 4 = 0",
    "reversal_present": "k % 5 = 0",
    "refund_amount_inr": maybe("e % 2 = 0", "v * 41.730585786", "4000.0"),
    "dispute_reason_code": maybe("e % 3 = 0", "'fraud_card_absent'", "'none'"),
    "dispute_filed_ts": maybe("e % 5 = 0", f"CAST({_HOUR} AS DOUBLE) * 3600 + 86400 * k", "-1.0"),
    "representment_filed": "k % 2 = 0",
    "representment_won": "k % 3 = 0",
    "device_age_days": "k / 5.0 - 1",
    "device_model": tag("mod", "k % 6"),
    "device_os": pick("k", "os1", "os2"),
    "device_rebinding_event": "k % 17 = 0",
    "pin_reset_event": "k % 19 = 0",
    "sms_silence_window_minutes": "k - 1.0",
    "session_id": maybe("e % 3 <> 1", tag("s", f"u % 20")),
    "session_duration_minutes": "k * 0.25",
    "in_app_dwell_seconds": "v * 1.3170585786",
    "ip_asn": tag("AS", "(u + k) % 12"),
    "agent_attestation_status": pick("k", "not_applicable", "attested", "unattested"),
    "agent_mandate_signature_valid": "k % 4 <> 0",
    "agent_identity_id": maybe("e % 6 <> 0", tag("ag", "u % 4")),
    "agent_quoted_amount_inr": maybe("k % 5 <> 0", "v * 41.730585786", "-1.0"),
    "agentic_indicator": "(e + k) % 12 = 11",
    "credit_limit_inr": "CASE WHEN u % 5 = 0 THEN -1.0 ELSE (u % 5) * 60000.0 END",
    "onboarding_batch_id": maybe("e % 3 = 2", tag("ob", "u % 70")),
    "onboarding_ts": maybe("k % 6 <> 0", f"CAST({_HOUR} AS DOUBLE) * 3600 - 60.0 * k", "-1.0"),
    "name_ngram_unlikelihood": "CAST(k AS DOUBLE) / 99",
    "address_geocode_density": "k * 0.37",
    "kyc_tier": pick("e + k", "min_kyc", "full_kyc", "none", "min_kyc"),
    "pan_age_days": "k - 1.0",
    "vpa_age_days": "k / 2.0 - 1",
    "account_age_days": "k * 2.0 - 1",
    "incumbent_score": "(k % 20) / 20.0",
    "incumbent_accept_probability": "CASE WHEN k % 25 = 0 THEN -1.0 WHEN k % 25 = 1 THEN 1.0 ELSE 0.05 + 0.9 * (k % 20) / 20.0 END",
    "incumbent_decision": maybe("k % 20 > 14", "'decline'", "'accept'"),
    "incumbent_rule_fired": pick("k", "", "INC-01", "INC-01,INC-08"),
    "response_code": pick("e * 5 + k", "approved", "declined_risk", "approved", "declined_expired", "approved",
                          "step_up_required", "timeout"),
    "response_latency_ms": "v * 1.931058579 - 1",
    "approved": "(e * 5 + k) % 7 IN (0, 2, 4) OR e % 43 = 0",
    "exemption_flag": maybe("k % 6 = 0", "'low_value'"),
    "reconciliation_lag_minutes": maybe("(e + k) % 12 IN (5, 9)", "k * 3.0", "-1.0"),
    "fd_liquidation_flag": "k % 23 = 0",
    "refund_to_different_credential": "k % 4 = 0",
    "cohort_tag": "CASE WHEN k % 20 = 0 THEN 'hb12_wedding' WHEN k % 20 = 1 THEN 'hb12_gig_fanin' "
                  "WHEN k % 20 = 2 THEN 'hbb_school_fee_collection' WHEN k % 20 = 3 THEN 'hbb_festival_street_vendor' ELSE 'ordinary' END",
    "attack_campaign_id": maybe("e % 15 = 0", tag("cmp", "u % 12")),
    "attack_family_id": maybe("e % 15 = 0", tag("fam", "u % 6")),
    "attack_grammar_str": maybe("e % 30 = 0", "'ACCESS=stolen-credential'"),
    "oracle_is_attack": "e % 15 = 0 OR k = 99",
    "oracle_value_at_risk_inr": maybe("e % 15 = 0", "v", "0.0"),
    "sealed_holdout": "e % 60 = 0 OR e % 97 = 0",
    "entity_pool": maybe("u % 6 = 0", "'sealed'", "'train'"),
}

_DUCK = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "boolean": "BOOLEAN"}
_BASE_SQL = ("SELECT event_id AS e, epoch_us(ts) AS us, user_id AS u, value AS v, "
             "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


def payments_sql(*names: str) -> str:
    """The derived table as a CTE body named ``pay``, for the given columns plus ``event_id``, ``ts_us`` and ``e``."""
    types = {f.name: _DUCK[f.dataType.simpleString()] for f in EVENT_SCHEMA}
    cols = dict.fromkeys(["event_id", "ts", *names])
    picked = ", ".join(f"CAST({COLUMNS[n]} AS {types[n]}) AS {n}" for n in cols)
    return f"pay AS (SELECT e, CAST({_HOUR} AS BIGINT) * {HOUR_US} AS ts_us, {picked} FROM ({_BASE_SQL}))"


def payments(spark: SparkSession, folder: str) -> DataFrame:
    """The derived payment events as a complete event table."""
    base = table(spark, folder, "events").select(
        F.col("event_id").alias("e"), epoch_us("ts").alias("us"), F.col("user_id").alias("u"), F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    return offer(complete(over_cores(base).selectExpr(*[f"{expr} AS {n}" for n, expr in COLUMNS.items()])), F.col("ts") * 1e6)
