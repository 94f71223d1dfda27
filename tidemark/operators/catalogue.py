"""Names, families and deployment views of the features."""

from __future__ import annotations

from tidemark.operators.timeline import WINDOWS
from tidemark.schema import ENTITY_KEYS, ORACLE_FIELDS, RAILS

VIEWS = ("issuer", "acquirer", "payee_psp", "network")

# Which view can see each entity key.
KEY_VIEWS = {
    "pan_canonical": "issuer network",
    "token_id": "issuer acquirer network",
    "token_requestor_id": "issuer network",
    "device_fingerprint_id": "issuer acquirer payee_psp",
    "terminal_id": "acquirer network",
    "merchant_id": "issuer acquirer network",
    "bin_prefix": "issuer acquirer network",
    "vpa": "issuer payee_psp",
    "beneficiary_id": "payee_psp network",
}

# Family, the views that can construct it, and its features.
_FAMILIES = {
    "temporal": ("issuer acquirer payee_psp network", """
        tod_vonmises_sin_h1 tod_vonmises_cos_h1 tod_vonmises_sin_h2 tod_vonmises_cos_h2 tod_vonmises_sin_h3
        tod_vonmises_cos_h3 hour_deviation_from_habit is_night_hours dow_sin dow_cos is_payday_window
        is_festival_window festival_ramp_position inter_arrival_seconds inter_arrival_log
        inter_arrival_regularity inter_arrival_zscore_vs_habit events_in_session"""),
    "sequence_artefacts": ("issuer acquirer network", """
        single_field_delta_retry_chain decline_reason_entropy response_code_transition_entropy
        avs_trajectory_shape avs_trajectory_monotone cvv2_retry_count entry_mode_transition_flag
        entry_mode_downgrade_flag response_latency_probe_pattern approval_ratio_delta_vs_baseline
        amount_uniformity_score distinct_pan_per_terminal_1h inter_arrival_microstructure_similarity"""),
    "trust_envelope": ("issuer network", """
        threeds_field_population_score field_combination_implausibility threeds_timezone_disagrees_with_geo
        threeds_language_disagrees_with_geo threeds_channel_screen_mismatch threeds_authenticated_flag
        threeds_frictionless_flag threeds_challenge_abandoned_flag token_assurance_ordinal
        token_assurance_vs_device_age provisioning_to_first_spend_minutes provisioning_to_first_spend_log
        cvm_result_ordinal cvm_vs_device_age cryptogram_present_but_unverified
        issuer_application_data_inconsistent exemption_flag_present exemption_rate_per_bin_24h stand_in_flag
        agent_attestation_ordinal agent_mandate_signature_invalid agentic_indicator_without_mandate"""),
    "mandate_deltas": ("issuer", """
        mandate_present mandate_amount_headroom mandate_amount_headroom_pct mandate_count_vs_frequency
        mandate_mcc_drift mandate_to_first_debit_minutes cit_mit_flip_flag pre_debit_notification_absent
        mandate_cohort_identical_params mandate_creation_rate_per_payee_24h mandate_amount_vs_afa_band"""),
    "threshold_geometry": ("issuer acquirer network", """
        distance_to_nearest_threshold distance_to_nearest_threshold_rel just_below_threshold_flag
        amount_mass_below_cap_24h threshold_hug_run_length cumulative_count_24h_vs_cap amount_log
        amount_is_round_atom amount_round_number_avoidance"""),
    "cross_message": ("issuer acquirer network", """
        auth_to_presentment_ratio auth_to_presentment_ratio_vs_mcc presentment_age_days incremental_auth_absent
        reversal_absent refund_without_original_auth refund_exceeds_original_flag
        refund_to_different_credential credit_to_debit_ratio_per_acceptor_24h time_to_dispute_days
        label_channel_disagreement"""),
    "graph_sketches": ("issuer payee_psp network", """
        sketch_distinct_payers_per_beneficiary_1h sketch_distinct_payers_per_beneficiary_24h
        sketch_beneficiary_fanin_degree sketch_beneficiary_fanout_degree sketch_payer_fanout_degree_24h
        sketch_pan_token_fanout_7d sketch_device_shared_entity_count sketch_address_node_density
        sketch_two_hop_reach_24h sketch_round_trip_flow_flag sketch_kcore_acquisition_rate
        sketch_motif_reciprocity sketch_fingerprint_collision_degree sketch_geohash_distinct_payer_devices
        sketch_first_txn_at_acceptor_share_24h sketch_seeder_cluster_membership"""),
    "beneficiary_side": ("payee_psp network", """
        beneficiary_account_age_days beneficiary_age_band_ordinal in_out_skew value_conservation_net_of_skim
        pass_through_dwell_seconds pass_through_dwell_log beneficiary_onward_send_minutes
        first_receipt_to_first_send_minutes beneficiary_distinct_payers_24h repeat_payer_share
        payer_set_growth_rate biller_continuity_absent first_credit_source_concentration
        beneficiary_category_ordinal beneficiary_kyc_tier_ordinal creditor_name_match_score
        beneficiary_change_within_cooling_hours remittance_info_drift amount_vs_vendor_history
        payee_vpa_age_days payee_name_brand_similarity inbound_credit_then_outbound_different_payee
        beneficiary_prior_from_exchange"""),
    "onboarding_cohort": ("payee_psp", """
        onboarding_batch_size onboarding_batch_timing_cluster device_os_entropy_collapse device_model_entropy
        asn_reuse_rate name_ngram_unlikelihood address_geocode_density onboarding_to_first_credit_minutes
        first_credit_source_concentration_batch batch_kyc_tier_uniformity"""),
    "entity_age": ("issuer acquirer payee_psp network", """
        pan_age_days vpa_age_days device_age_days merchant_age_days account_age_days min_entity_age_days
        entity_age_band_ordinal is_first_event_for_entity cold_start_flag bin_issuer_prior_fraud_rate
        peer_cohort_prior_fraud_rate geo_cell_prior_fraud_rate"""),
    "habit_deviation": ("issuer acquirer payee_psp network", """
        amount_ratio_to_own_baseline amount_zscore_to_own_baseline amount_pct_in_peer_cohort
        is_largest_ever_for_entity mcc_novelty mcc_habit_probability geo_novelty geovelocity_break
        device_churn_30d rail_novelty rail_ratio_vs_peer_cohort dormancy_reactivation_flag"""),
    "merchant_side": ("acquirer network issuer", """
        mcc_vs_basket_semantics acceptor_descriptor_mismatch merchant_ticket_step_change
        merchant_ramp_curve_shape merchant_approval_ratio_delta new_mid_ticket_velocity
        foreign_issuer_concentration first_txn_at_acceptor_share repeat_customer_share_merchant
        refund_rate_anomaly chargeback_after_funding_flag settlement_to_withdrawal_days
        traffic_geo_vs_registered_geo merchant_volume_delta_in_cell"""),
    "device_session": ("issuer payee_psp", """
        device_rebinding_event pin_reset_event sms_silence_window_minutes rebinding_to_first_payee_minutes
        profile_change_before_spend_days session_duration_minutes debits_per_uninterrupted_session
        in_app_dwell_uniformity escalating_amount_in_session fresh_beneficiary_count_24h
        fd_liquidation_before_transfer device_fingerprint_entropy ip_asn_novelty referrer_domain_age_days
        txn_note_template_score"""),
    "channel_context": ("issuer acquirer payee_psp network", """
        tier_is_b message_kind_is_authorisation message_kind_is_credit_leg message_kind_is_post_auth
        has_beneficiary_leg entry_mode_ordinal initiation_mode_ordinal is_cross_border incumbent_score
        incumbent_rule_count"""),
}
# Features of the thin rails, whose views differ inside the family.
_THIN_RAILS = {
    "reconciliation_lag_minutes": "issuer payee_psp network",
    "reconciliation_lag_pct_in_peer_cohort": "issuer payee_psp network",
    "balance_enquiry_count_24h": "issuer acquirer network",
    "balance_enquiry_to_withdrawal_ratio_24h": "issuer acquirer network",
    "lite_debits_since_topup_24h": "issuer payee_psp network",
}
AUDIT_ONLY = ("label_channel_disagreement",)
NEVER_FEATURES = ("incumbent_accept_probability", *[f for f in ORACLE_FIELDS if f != "entity_pool"],
                  "screen_share_app_present", "accessibility_permission")
#: Features that look at a key's whole history instead of its past.
NOT_POINT_IN_TIME = (
    "sketch_device_shared_entity_count", "sketch_address_node_density", "sketch_fingerprint_collision_degree",
    "acceptor_descriptor_mismatch", "traffic_geo_vs_registered_geo", "txn_note_template_score",
)


def rail_feature(rail: str) -> str:
    return "rail_is_" + rail.replace("-", "_")


def _expand() -> dict[str, tuple[str, frozenset[str]]]:
    """feature name -> (family, views), in registry order."""
    out: dict[str, tuple[str, frozenset[str]]] = {}
    for key in ENTITY_KEYS:
        views = frozenset(KEY_VIEWS[key].split())
        for w in WINDOWS:
            for stat in ("count", "amount_sum"):
                for enc in ("ratio", "pct"):
                    out[f"vel_{key}_{w}_{stat}_{enc}"] = ("velocity_panel", views)
    for key in ENTITY_KEYS:
        for w in WINDOWS:
            out[f"vel_{key}_{w}_distinct_counterparty"] = ("velocity_distinct", frozenset(KEY_VIEWS[key].split()))
    for name, views in _THIN_RAILS.items():
        out[name] = ("thin_rail_observables", frozenset(views.split()))
    for family, (views, names) in _FAMILIES.items():
        if family == "channel_context":
            for r in RAILS:
                out[rail_feature(r)] = ("rail_context", frozenset(VIEWS))
        for n in names.split():
            out[n] = (family, frozenset(views.split()))
    return out


FEATURES = _expand()
MODEL_FEATURES = tuple(n for n in FEATURES if n not in AUDIT_ONLY)


def family(name: str) -> list[str]:
    return [n for n, (f, _) in FEATURES.items() if f == name]


def features_for_view(view: str) -> list[str]:
    """Model features a deployment view can construct; the others are absent, not zero."""
    if view not in VIEWS:
        raise ValueError(f"unknown view {view}; one of {VIEWS}")
    return [n for n in MODEL_FEATURES if view in FEATURES[n][1]]
