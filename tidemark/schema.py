"""The event table: fixed columns, vocabularies and column roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, DOUBLE, LONG, BOOLEAN = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()
REQUIRED_FIELD = object()

# Column name, type and default, in table order.
_FIELDS = (
    ("event_id", STRING, REQUIRED_FIELD),
    ("ts", DOUBLE, REQUIRED_FIELD),
    ("day_index", LONG, REQUIRED_FIELD),
    ("hour_ist", DOUBLE, REQUIRED_FIELD),
    ("dow", LONG, REQUIRED_FIELD),
    ("rail", STRING, REQUIRED_FIELD),
    ("message_kind", STRING, REQUIRED_FIELD),
    ("tier", STRING, REQUIRED_FIELD),
    ("amount_inr", DOUBLE, REQUIRED_FIELD),
    ("currency", STRING, "INR"),
    ("settlement_amount_inr", DOUBLE, -1.0),
    ("pan_canonical", STRING, ""),
    ("token_id", STRING, ""),
    ("token_requestor_id", STRING, ""),
    ("device_fingerprint_id", STRING, ""),
    ("terminal_id", STRING, ""),
    ("merchant_id", STRING, ""),
    ("bin_prefix", STRING, ""),
    ("vpa", STRING, ""),
    ("beneficiary_id", STRING, ""),
    ("cardholder_id", STRING, ""),
    ("acquirer_id", STRING, ""),
    ("issuer_id", STRING, ""),
    ("payee_psp_id", STRING, ""),
    ("agent_identity_id", STRING, ""),
    ("sim_id", STRING, ""),
    ("address_id", STRING, ""),
    ("mcc", STRING, ""),
    ("acceptor_descriptor", STRING, ""),
    ("acceptor_country", STRING, "IN"),
    ("geo_cell", STRING, ""),
    ("merchant_age_days", DOUBLE, -1.0),
    ("pos_entry_mode", STRING, ""),
    ("cvm_result", STRING, "none"),
    ("avs_result", STRING, "not_requested"),
    ("cvv2_result", STRING, "not_provided"),
    ("terminal_verification_result", STRING, ""),
    ("stand_in_indicator", BOOLEAN, False),
    ("threeds_authentication_result", STRING, "not_applicable"),
    ("threeds_eci", STRING, "none"),
    ("threeds_acs_id", STRING, ""),
    ("threeds_field_population_score", DOUBLE, -1.0),
    ("threeds_challenge_requested", BOOLEAN, False),
    ("threeds_device_channel", STRING, ""),
    ("threeds_screen_wh", STRING, ""),
    ("threeds_ua_family", STRING, ""),
    ("threeds_timezone_offset_min", LONG, -1),
    ("threeds_language", STRING, ""),
    ("threeds_ip_asn", STRING, ""),
    ("emv_cryptogram_present", BOOLEAN, False),
    ("emv_cryptogram_atc", LONG, -1),
    ("emv_cryptogram_verified", BOOLEAN, False),
    ("emv_unpredictable_number", STRING, ""),
    ("issuer_application_data_consistent", BOOLEAN, True),
    ("token_assurance_level", STRING, "none"),
    ("provisioning_event_id", STRING, ""),
    ("provisioning_to_first_spend_minutes", DOUBLE, -1.0),
    ("mandate_id", STRING, ""),
    ("mandate_max_amount_inr", DOUBLE, -1.0),
    ("mandate_frequency", STRING, ""),
    ("mandate_permitted_mcc", STRING, ""),
    ("mandate_debit_count_to_date", LONG, -1),
    ("mandate_created_ts", DOUBLE, -1.0),
    ("cit_mit_indicator", STRING, ""),
    ("pre_debit_notification_sent", BOOLEAN, False),
    ("upi_initiation_mode", STRING, "not_applicable"),
    ("payee_vpa", STRING, ""),
    ("payee_name_string", STRING, ""),
    ("payee_vpa_age_days", DOUBLE, -1.0),
    ("txn_note", STRING, ""),
    ("referrer_domain", STRING, ""),
    ("referrer_domain_age_days", DOUBLE, -1.0),
    ("collect_request_id", STRING, ""),
    ("collect_accepted", BOOLEAN, False),
    ("pacs_end_to_end_id", STRING, ""),
    ("pacs_status_code", STRING, ""),
    ("creditor_name_string", STRING, ""),
    ("creditor_name_match_score", DOUBLE, -1.0),
    ("remittance_info", STRING, ""),
    ("beneficiary_category", STRING, "unknown"),
    ("beneficiary_change_ts", DOUBLE, -1.0),
    ("beneficiary_account_age_days", DOUBLE, -1.0),
    ("beneficiary_inbound_credit_count_24h", LONG, -1),
    ("beneficiary_distinct_payers_24h", LONG, -1),
    ("beneficiary_inflow_24h_inr", DOUBLE, -1.0),
    ("beneficiary_outflow_24h_inr", DOUBLE, -1.0),
    ("beneficiary_dwell_seconds", DOUBLE, -1.0),
    ("beneficiary_onward_send_minutes", DOUBLE, -1.0),
    ("beneficiary_fanin_degree", LONG, -1),
    ("beneficiary_fanout_degree", LONG, -1),
    ("beneficiary_first_credit_source", STRING, ""),
    ("beneficiary_kyc_tier", STRING, "none"),
    ("original_auth_event_id", STRING, ""),
    ("rrn", STRING, ""),
    ("trace_number", STRING, ""),
    ("presentment_age_days", DOUBLE, -1.0),
    ("auth_to_presentment_ratio", DOUBLE, -1.0),
    ("incremental_auth_present", BOOLEAN, False),
    ("reversal_present", BOOLEAN, False),
    ("refund_amount_inr", DOUBLE, -1.0),
    ("dispute_reason_code", STRING, "none"),
    ("dispute_filed_ts", DOUBLE, -1.0),
    ("representment_filed", BOOLEAN, False),
    ("representment_won", BOOLEAN, False),
    ("device_age_days", DOUBLE, -1.0),
    ("device_model", STRING, ""),
    ("device_os", STRING, ""),
    ("device_rebinding_event", BOOLEAN, False),
    ("pin_reset_event", BOOLEAN, False),
    ("sms_silence_window_minutes", DOUBLE, -1.0),
    ("session_id", STRING, ""),
    ("session_duration_minutes", DOUBLE, -1.0),
    ("in_app_dwell_seconds", DOUBLE, -1.0),
    ("typing_cadence_score", DOUBLE, -1.0),
    ("ip_asn", STRING, ""),
    ("screen_share_app_present", BOOLEAN, False),
    ("accessibility_permission", BOOLEAN, False),
    ("agent_attestation_status", STRING, "not_applicable"),
    ("agent_endpoint_age_days", DOUBLE, -1.0),
    ("agent_mandate_signature_valid", BOOLEAN, False),
    ("agent_quoted_amount_inr", DOUBLE, -1.0),
    ("agent_human_confirmation_event", BOOLEAN, False),
    ("agentic_indicator", BOOLEAN, False),
    ("credit_limit_inr", DOUBLE, -1.0),
    ("credit_line_activated_ts", DOUBLE, -1.0),
    ("onboarding_batch_id", STRING, ""),
    ("onboarding_ts", DOUBLE, -1.0),
    ("name_ngram_unlikelihood", DOUBLE, -1.0),
    ("address_geocode_density", DOUBLE, -1.0),
    ("kyc_tier", STRING, "none"),
    ("pan_age_days", DOUBLE, -1.0),
    ("vpa_age_days", DOUBLE, -1.0),
    ("account_age_days", DOUBLE, -1.0),
    ("incumbent_score", DOUBLE, -1.0),
    ("incumbent_accept_probability", DOUBLE, -1.0),
    ("incumbent_decision", STRING, ""),
    ("incumbent_rule_fired", STRING, ""),
    ("response_code", STRING, ""),
    ("response_latency_ms", DOUBLE, -1.0),
    ("approved", BOOLEAN, False),
    ("exemption_flag", STRING, ""),
    ("reconciliation_lag_minutes", DOUBLE, -1.0),
    ("fd_liquidation_flag", BOOLEAN, False),
    ("refund_to_different_credential", BOOLEAN, False),
    ("cohort_tag", STRING, "ordinary"),
    ("generator", STRING, "sim"),
    ("rng_stream", STRING, ""),
    ("attack_campaign_id", STRING, ""),
    ("attack_family_id", STRING, ""),
    ("attack_grammar_str", STRING, ""),
    ("attack_cell_id", STRING, ""),
    ("attack_stage", STRING, ""),
    ("oracle_is_attack", BOOLEAN, False),
    ("oracle_value_at_risk_inr", DOUBLE, 0.0),
    ("sealed_holdout", BOOLEAN, False),
    ("entity_pool", STRING, "train"),
)

FIELDS: tuple[str, ...] = tuple(n for n, _, _ in _FIELDS)
EVENT_SCHEMA = T.StructType([T.StructField(n, t) for n, t, _ in _FIELDS])
REQUIRED: tuple[str, ...] = tuple(n for n, _, d in _FIELDS if d is REQUIRED_FIELD)
DEFAULTS: dict[str, object] = {n: d for n, _, d in _FIELDS if d is not REQUIRED_FIELD}

LABEL_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("as_of_ts", T.DoubleType()),
    T.StructField("label", T.LongType()),
    T.StructField("poisoned", T.BooleanType()),
])

# Closed vocabularies.
RAILS = (
    "card-cnp-3ds", "card-cnp-keyed", "card-cp-emv", "card-clearing-dispute", "card-token-provisioning",
    "upi-pay", "upi-collect", "upi-autopay-mandate", "a2a-credit-transfer", "upi-lite-offline",
    "aeps-microatm", "agentic-commerce",
)
TIER_B_RAILS = ("upi-lite-offline", "aeps-microatm", "agentic-commerce")
TIER_A_RAILS = tuple(r for r in RAILS if r not in TIER_B_RAILS)
UPI_RAILS = ("upi-pay", "upi-collect", "upi-autopay-mandate", "upi-lite-offline")
MESSAGE_KINDS = tuple("""
    authorisation authorisation_advice reversal incremental_auth presentment refund_credit chargeback
    representment provisioning_request collect_request collect_response mandate_creation mandate_debit
    pre_debit_notification credit_transfer credit_transfer_status inbound_credit onward_send lite_topup
    lite_debit assisted_withdrawal balance_enquiry agent_mandate_object agent_authorisation
    onboarding_application profile_change
""".split())
ENTRY_MODES = tuple("""
    ecommerce keyed magstripe_fallback chip contactless contactless_no_cvm intent secure_intent collect
    qr_static qr_dynamic biometric_assisted agent on_device_ledger in_app file_upload
""".split())
CVM_RESULTS = ("none", "signature", "online_pin", "offline_pin", "cdcvm", "biometric")
AVS_RESULTS = ("not_requested", "no_match", "partial_match", "match", "unavailable")
CVV2_RESULTS = ("not_provided", "no_match", "match", "unavailable")
THREEDS_RESULTS = (
    "not_applicable", "frictionless_success", "challenge_success", "challenge_abandoned", "attempted", "failed",
)
THREEDS_ECI_BANDS = ("none", "authenticated", "attempted", "not_authenticated")
RESPONSE_CODES = tuple("""
    approved approved_partial declined_insufficient_funds declined_invalid_card declined_expired
    declined_cvv2_mismatch declined_avs_mismatch declined_do_not_honour declined_risk declined_velocity
    declined_mandate_scope declined_stand_in step_up_required referred timeout
""".split())
TOKEN_ASSURANCE = ("none", "low", "medium", "high")
DISPUTE_REASON_CODES = tuple("""
    none fraud_card_absent fraud_card_present authorisation_issue processing_error goods_not_received
    goods_not_as_described cancelled_recurring credit_not_processed duplicate_processing
""".split())
KYC_TIERS = ("none", "min_kyc", "full_kyc", "video_kyc")
BENEFICIARY_CATEGORIES = tuple("""
    unknown p2p_individual small_merchant biller giftcard wallet_load quasi_cash crypto_onramp payroll
    corporate_vendor
""".split())
INITIATION_MODES = (
    "not_applicable", "intent", "secure_intent", "qr_static", "qr_dynamic", "collect", "mandate", "in_app", "ivr",
)
HARD_BENIGN_PAYER_TAGS = tuple("""
    hb12_bereavement hb12_wedding hb12_relocation hb12_new_phone_reprovision hb12_gig_fanin
    hb12_festival_travel hb12_first_high_ticket hb12_joint_account hb12_seasonal_merchant_ramp
    hb12_student_fee hb12_nri_remittance hb12_medical_fd_liquidation
""".split())
HARD_BENIGN_PAYEE_TAGS = tuple("""
    hbb_new_gig_aggregator_payee hbb_week_old_small_merchant hbb_school_fee_collection
    hbb_festival_street_vendor hbb_community_chit_collection hbb_freelancer_foreign_inbound
""".split())
COHORT_TAGS = ("ordinary", *HARD_BENIGN_PAYER_TAGS, *HARD_BENIGN_PAYEE_TAGS)

ENTITY_KEYS = (
    "pan_canonical", "token_id", "token_requestor_id", "device_fingerprint_id", "terminal_id", "merchant_id",
    "bin_prefix", "vpa", "beneficiary_id",
)
ORACLE_FIELDS = (
    "attack_campaign_id", "attack_family_id", "attack_grammar_str", "attack_cell_id", "attack_stage",
    "oracle_is_attack", "oracle_value_at_risk_inr", "sealed_holdout", "entity_pool",
)
OUT_OF_PERSONA_FIELDS = (
    "screen_share_app_present", "accessibility_permission", "typing_cadence_score", "agent_human_confirmation_event",
)
_ALWAYS_PRESENT = ("ts", "day_index", "hour_ist", "dow", "amount_inr", "oracle_value_at_risk_inr")
SENTINEL_FIELDS: tuple[str, ...] = tuple(
    f.name for f in EVENT_SCHEMA
    if isinstance(f.dataType, (T.DoubleType, T.LongType)) and f.name not in _ALWAYS_PRESENT
)
SENTINEL = -1.0


def check_columns(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """Raise unless the frame has exactly the schema's columns, in order and type."""
    want = [(f.name, f.dataType) for f in schema]
    have = [(f.name, f.dataType) for f in df.schema]
    if want != have:
        missing = [n for n, _ in want if n not in df.columns]
        extra = [n for n in df.columns if n not in schema.names]
        changed = [n for (n, t), (m, u) in zip(want, have) if (n, t) != (m, u)][:5]
        raise ValueError(f"{what}: missing {missing}, unexpected {extra}, first differing {changed}")
    return df


def complete(df: DataFrame) -> DataFrame:
    """Fill columns a partial event frame lacks with their defaults and put all in table order."""
    lacking = [n for n in REQUIRED if n not in df.columns]
    if lacking:
        raise ValueError(f"events lack required columns {lacking}")
    have = set(df.columns)

    def filled(f: T.StructField) -> str:
        kind = f.dataType.simpleString()
        default = f"CAST({_literal(DEFAULTS[f.name])} AS {kind})" if f.name in DEFAULTS else None
        if f.name not in have:
            return f"{default} AS {f.name}"
        value = f"CAST({f.name} AS {kind})"
        return f"{value} AS {f.name}" if default is None else f"coalesce({value}, {default}) AS {f.name}"

    return df.selectExpr(*[filled(f) for f in EVENT_SCHEMA])


def _literal(value: object) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value).lower()


def nullify(df: DataFrame) -> DataFrame:
    """Turn the stored 'not applicable' marks (-1 and the empty string) into nulls."""
    def clean(f: T.StructField) -> Column:
        c = F.col(f.name)
        if f.name in SENTINEL_FIELDS:
            return F.nullif(c, F.lit(-1).cast(f.dataType))
        if isinstance(f.dataType, T.StringType):
            return F.nullif(c, F.lit(""))
        return c
    return df.select(*[clean(f).alias(f.name) for f in df.schema])


def apply_sentinel(df: DataFrame, columns: list[str], as_float: bool = False) -> DataFrame:
    """The edge rule for feature columns: null and NaN become -1, infinities become +-1e12."""
    kind = "float" if as_float else "double"
    edge = {
        n: f"CAST(CASE WHEN {n} IS NULL OR isnan({n}) THEN -1D "
           f"ELSE greatest(least(CAST({n} AS double), 1e12D), -1e12D) END AS {kind}) AS {n}"
        for n in columns
    }
    return df.selectExpr(*[edge.get(n, n) for n in df.columns])


def strip_oracle(df: DataFrame) -> DataFrame:
    return df.drop(*ORACLE_FIELDS)
