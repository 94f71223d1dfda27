"""Feature families on the derived payment events, each against SQL over explicit earlier rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalogue as C
from tidemark.operators.beneficiary import build_exchange
from tidemark.operators import features as FE
from tidemark.operators import kernels as K
from tidemark.queries.registry import query, rounded
from tidemark.queries.standin import COLUMNS, payments, payments_sql

H1, D1, D7, D30 = 3_600_000_000, 86_400_000_000, 604_800_000_000, 2_592_000_000_000
PK = "primary_key"
# The whole derived table plus the primary key, cohort and gap to the previous row of that key.
PAY = payments_sql(*COLUMNS).replace("pay AS (", "raw AS (", 1) + """,
    keyed AS (SELECT *, coalesce(nullif(cardholder_id, ''), nullif(pan_canonical, ''), vpa) AS primary_key,
      issuer_id || '|' || CASE WHEN credit_limit_inr >= 200000 THEN 'hi' WHEN credit_limit_inr >= 50000 THEN 'mid'
        WHEN credit_limit_inr >= 0 THEN 'lo' ELSE 'nolimit' END AS cohort FROM raw),
    pay AS (SELECT *, CASE WHEN primary_key = '' OR lag(ts_us) OVER w IS NULL THEN -1 ELSE (ts_us - lag(ts_us) OVER w) / 1e6 END AS gap
      FROM keyed WINDOW w AS (PARTITION BY primary_key ORDER BY ts_us, event_id))"""
IS_UPI = "rail IN ('upi-pay', 'upi-collect', 'upi-autopay-mandate', 'upi-lite-offline')"
GAP_LOG = "(CASE WHEN gap >= 0 THEN ln(1 + gap) ELSE -1 END)"


def pairs(name: str, key: str, *cols: str) -> str:
    """CTE of (row, earlier row of the same non-blank key); ``back`` counts from the latest."""
    taken = "".join(f", b.{x} AS b_{x}" for x in cols)
    return f"""{name} AS (SELECT a.event_id, a.ts_us, b.ts_us AS b_ts, b.event_id AS b_id{taken},
      row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts_us DESC, b.event_id DESC) AS back
      FROM pay a JOIN pay b ON a.{key} = b.{key} AND a.{key} <> '' AND (b.ts_us, b.event_id) < (a.ts_us, a.event_id))"""


def hist(name: str, source: str, **aggs: str) -> str:
    """CTE with aggregates of each row's earlier rows."""
    return f"{name} AS (SELECT event_id, {', '.join(f'{a} AS {n}' for n, a in aggs.items())} FROM {source} GROUP BY event_id)"


def within(agg: str, width: int, cond: str = "TRUE") -> str:
    return f"{agg} FILTER (b_ts >= ts_us - {width} AND {cond})"


def entropy(name: str, source: str, value: str) -> str:
    """CTE ``name(event_id, h)`` with the normalised entropy of the last 16 earlier values."""
    return f"""{name}_c AS (SELECT event_id, {value} AS x, count(*) AS n FROM {source} WHERE back <= 16 GROUP BY ALL),
      {name}_t AS (SELECT event_id, sum(n) AS t, count(*) AS kinds FROM {name}_c GROUP BY event_id),
      {name} AS (SELECT event_id, CASE WHEN max(t) >= 3 THEN -sum(n / t * ln(n / t)) / ln(greatest(max(kinds), 2)) ELSE -1 END AS h
        FROM {name}_c JOIN {name}_t USING (event_id) GROUP BY event_id)"""


def first_of(name: str, *keys: str) -> str:
    """CTE of the event ids where a key combination occurs first."""
    return f"{name} AS (SELECT arg_min(event_id, (ts_us, event_id)) AS event_id FROM pay GROUP BY {', '.join(keys)})"


def calm(cv: str) -> str:
    return f"CASE WHEN {cv} IS NULL THEN -1 ELSE 1 - least({cv}, 1) END"


def cv(value: str, n: int = 8) -> str:
    f = f"FILTER (back <= {n})"
    return (f"CASE WHEN count(*) {f} >= 3 AND abs(avg({value}) {f}) > 1e-12 "
            f"THEN nullif(greatest(stddev_pop({value}) {f} / avg({value}) {f}, -1), -1) END")


def family_sql(exprs: dict[str, str], ctes: list[str] = (), joins: list[str] = ()) -> str:
    body = ",\n    ".join([PAY, *ctes])
    cols = ",\n    ".join(f"round(CAST({e} AS DOUBLE), 7) + 0 AS {n}" for n, e in exprs.items())
    on = " ".join(f"LEFT JOIN {j} ON pay.event_id = {j}.event_id" for j in joins)
    return f"WITH {body}\n    SELECT pay.event_id,\n    {cols}\n    FROM pay {on}"


STAT_ROWS = "day_index < 20"


def prepared(spark, sf):
    return K.keyed(payments(spark, sf))


def stats_for(prep):
    y = F.when(F.col("oracle_is_attack"), 1.0).otherwise(0.0)
    return FE.fit_reference_stats(prep, y, F.col("day_index") < 20)


FAMILY_SQL: dict[str, tuple[list[str], str]] = {}


def family(name: str, names: list[str], sql: str | None, needs_stats: bool = False):
    if sql is not None:
        FAMILY_SQL[name] = (list(names), sql)

    def run(spark, sf):
        prep = prepared(spark, sf)
        return rounded(FE.build_features(prep, stats_for(prep) if needs_stats else None, names), 7)
    query(name, sql)(run)


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def where(scope: str, value: str) -> str:
    return f"CASE WHEN {scope} THEN {value} ELSE -1 END"


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN {num} / {den} ELSE -1 END"


def scale(col: str, order) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(order)) + " ELSE -1 END"


def age(col: str) -> str:
    return f"CASE WHEN {col} < 0 THEN -1 WHEN {col} < 1 THEN 0 WHEN {col} < 7 THEN 1 WHEN {col} < 30 THEN 2 ELSE 3 END"


def words(col: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(upper({col}), '\\s+'), lambda x: x <> ''))"


def jaccard(a: str, b: str) -> str:
    x, y = words(a), words(b)
    return (f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN "
            f"len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) ELSE 0 END")


def ledger(name: str, key: str, *cols: str, **aggs: str) -> list[str]:
    return [pairs(f"{name}_p", key, *cols), hist(name, f"{name}_p", **aggs)]


# --- temporal ------------------------------------------------------------------------------------
_modal = f"modal AS (SELECT median({GAP_LOG}) AS m FROM pay WHERE {STAT_ROWS})"
_dom = "day(DATE '2026-03-02' + CAST(day_index AS INTEGER))"
family("temporal_shape", C.family("temporal"), family_sql({
    **{f"tod_vonmises_{f}_h{h}": f"{f}({h} * 2 * pi() * hour_ist / 24)" for h in (1, 2, 3) for f in ("sin", "cos")},
    "hour_deviation_from_habit": "CASE WHEN p_hour >= 0 THEN least(abs(hour_ist - p_hour), 24 - abs(hour_ist - p_hour)) ELSE -1 END",
    "is_night_hours": flag("hour_ist < 5"),
    "dow_sin": "sin(2 * pi() * dow / 7)", "dow_cos": "cos(2 * pi() * dow / 7)",
    "is_payday_window": flag(f"{_dom} IN (1, 2, 28, 29, 30, 31)"),
    "is_festival_window": flag("day_index BETWEEN 38 AND 49"),
    "festival_ramp_position": "CASE WHEN day_index BETWEEN 38 AND 44 THEN (day_index - 38) / 6.0 WHEN day_index BETWEEN 45 AND 49 THEN 1 - (day_index - 44) / 5.0 ELSE -1 END",
    "inter_arrival_seconds": "gap", "inter_arrival_log": GAP_LOG,
    "inter_arrival_regularity": calm("gap_cv"),
    "inter_arrival_zscore_vs_habit": where("gap >= 0", f"{GAP_LOG} - (SELECT m FROM modal)"),
    "events_in_session": "coalesce(n_sess, 0)",
}, [_modal, *ledger("h", PK, "hour_ist", "gap", p_hour="max(b_hour_ist) FILTER (back = 1)", gap_cv=cv("greatest(b_gap, 0)")),
    *ledger("s", "session_id", n_sess="count(*)")], ["h", "s"]), needs_stats=True)

# --- sequence artefacts --------------------------------------------------------------------------
_avs = scale("avs_result", FE.AVS_ORDER)
_seq_ctes = [
    "prevs AS (SELECT event_id, lag(amount_inr) OVER w AS p_amt, lag(pos_entry_mode) OVER w AS p_entry FROM pay WHERE primary_key <> '' "
    "WINDOW w AS (PARTITION BY primary_key ORDER BY ts_us, event_id))",
    "base AS (SELECT pay.*, coalesce(abs(amount_inr - p_amt) < 1 AND p_amt >= 0, FALSE) AS same, "
    f"coalesce(p_entry, '') AS p_entry, coalesce(p_entry, '') || '>' || pos_entry_mode AS step, {_avs} AS avs, "
    "cvv2_result = 'no_match' AS bad FROM pay LEFT JOIN prevs USING (event_id))",
    pairs("p", PK, "same", "bad", "response_code", "step", "avs", "amount_inr", "approved", "response_latency_ms").replace("FROM pay a JOIN pay b", "FROM base a JOIN base b"),
    hist("x", "p", n="count(*)", stop_same="min(back) FILTER (NOT b_same)", stop_bad="min(back) FILTER (NOT b_bad)",
         p_avs="max(b_avs) FILTER (back = 1)", lat_cv=cv("greatest(b_response_latency_ms, 0)"), amt_cv=cv("b_amount_inr"),
         ok1=within("avg(CAST(b_approved AS INT))", H1), ok30=within("avg(CAST(b_approved AS INT))", D30)),
    entropy("e1", "p", "b_response_code"), entropy("e2", "p", "b_step"),
    *ledger("t", "terminal_id", "pan_canonical", d=within("count(DISTINCT nullif(b_pan_canonical, ''))", H1)),
    _modal,
]
family("sequence_artefacts", C.family("sequence_artefacts"), family_sql({
    "single_field_delta_retry_chain": "coalesce(stop_same - 1, n, 0)",
    "decline_reason_entropy": "coalesce(e1.h, -1)", "response_code_transition_entropy": "coalesce(e2.h, -1)",
    "avs_trajectory_shape": _avs,
    "avs_trajectory_monotone": f"CASE WHEN p_avs >= 0 THEN {flag(f'({_avs}) >= p_avs')} ELSE -1 END",
    "cvv2_retry_count": "coalesce(stop_bad - 1, n, 0)",
    "entry_mode_transition_flag": where("base.p_entry <> ''", flag("base.p_entry <> base.pos_entry_mode")),
    "entry_mode_downgrade_flag": flag("base.pos_entry_mode IN ('magstripe_fallback', 'keyed', 'contactless_no_cvm') AND base.p_entry IN ('chip', 'contactless')"),
    "response_latency_probe_pattern": "coalesce(lat_cv, -1)",
    "approval_ratio_delta_vs_baseline": "coalesce(ok1 - ok30, -1)",
    "amount_uniformity_score": calm("amt_cv"),
    "distinct_pan_per_terminal_1h": "coalesce(d, 0)",
    "inter_arrival_microstructure_similarity": where("pay.gap >= 0", f"1 / (1 + abs({GAP_LOG.replace('gap', 'pay.gap')} - (SELECT m FROM modal)))"),
}, _seq_ctes, ["base", "x", "e1", "e2", "t"]).replace(_avs + " AS DOUBLE", _avs.replace("avs_result", "pay.avs_result") + " AS DOUBLE")
    .replace(f"({_avs}) >= p_avs", f"({_avs.replace('avs_result', 'pay.avs_result')}) >= p_avs"), needs_stats=True)

# --- trust envelope ------------------------------------------------------------------------------
_3ds = "threeds_authentication_result <> 'not_applicable'"
_tz = "threeds_timezone_offset_min >= 0 AND abs(threeds_timezone_offset_min - 330) > 1"
_lang = "threeds_language <> '' AND threeds_language NOT LIKE '%-IN'"
_screen = "threeds_screen_wh IN ('1280x720', '1920x1080') AND threeds_device_channel = 'app'"
_asn = "threeds_ip_asn <> '' AND threeds_ip_asn NOT LIKE 'AS645%'"
_assure, _cvm = scale("token_assurance_level", FE.ASSURANCE_ORDER), scale("cvm_result", FE.CVM_ORDER)
family("trust_envelope", C.family("trust_envelope"), family_sql({
    "threeds_field_population_score": "threeds_field_population_score",
    "field_combination_implausibility": where(_3ds, " + ".join(f"({flag(x)})" for x in (_tz, _lang, _screen, _asn))),
    "threeds_timezone_disagrees_with_geo": where(_3ds, flag(_tz)),
    "threeds_language_disagrees_with_geo": where(_3ds, flag(_lang)),
    "threeds_channel_screen_mismatch": where(_3ds, flag(_screen)),
    "threeds_authenticated_flag": flag("threeds_eci = 'authenticated'"),
    "threeds_frictionless_flag": flag("threeds_authentication_result = 'frictionless_success'"),
    "threeds_challenge_abandoned_flag": flag("threeds_authentication_result = 'challenge_abandoned'"),
    "token_assurance_ordinal": _assure,
    "token_assurance_vs_device_age": where("device_age_days >= 0", f"({_assure}) - ({age('device_age_days')})"),
    "provisioning_to_first_spend_minutes": "provisioning_to_first_spend_minutes",
    "provisioning_to_first_spend_log": where("provisioning_to_first_spend_minutes >= 0", "ln(1 + provisioning_to_first_spend_minutes)"),
    "cvm_result_ordinal": _cvm,
    "cvm_vs_device_age": where("device_age_days >= 0", f"({_cvm}) - ({age('device_age_days')})"),
    "cryptogram_present_but_unverified": where("emv_cryptogram_present", flag("NOT emv_cryptogram_verified")),
    "issuer_application_data_inconsistent": where("emv_cryptogram_present", flag("NOT issuer_application_data_consistent")),
    "exemption_flag_present": flag("exemption_flag <> ''"),
    "exemption_rate_per_bin_24h": "coalesce(rate, -1)",
    "stand_in_flag": flag("stand_in_indicator"),
    "agent_attestation_ordinal": scale("agent_attestation_status", FE.ATTESTATION_ORDER),
    "agent_mandate_signature_invalid": where("agentic_indicator", flag("NOT agent_mandate_signature_valid")),
    "agentic_indicator_without_mandate": flag("agentic_indicator AND mandate_id = ''"),
}, ledger("x", "bin_prefix", "exemption_flag", rate=within("avg(CASE WHEN b_exemption_flag <> '' THEN 1 ELSE 0 END)", D1)), ["x"]))

# --- mandates ------------------------------------------------------------------------------------
_has, _cap = "mandate_id <> ''", "mandate_max_amount_inr"
_head = f"CASE WHEN {_cap} > 0 THEN ({_cap} - amount_inr) / {_cap} ELSE -1 END"
family("mandate_deltas", C.family("mandate_deltas"), family_sql({
    "mandate_present": flag(_has), "mandate_amount_headroom": _head,
    "mandate_amount_headroom_pct": "CASE WHEN hp > -1 THEN pct ELSE -1 END",
    "mandate_count_vs_frequency": where(_has, "mandate_debit_count_to_date / CASE mandate_frequency WHEN 'weekly' THEN 4.0 WHEN 'monthly' THEN 1.0 ELSE 8.0 END"),
    "mandate_mcc_drift": where(f"{_has} AND mandate_permitted_mcc <> ''", flag("mcc <> mandate_permitted_mcc")),
    "mandate_to_first_debit_minutes": where(f"{_has} AND mandate_created_ts > 0 AND mandate_debit_count_to_date <= 1", "(ts - mandate_created_ts) / 60"),
    "cit_mit_flip_flag": flag("coalesce(p_cit, '') <> '' AND cit_mit_indicator <> '' AND p_cit <> cit_mit_indicator"),
    "pre_debit_notification_absent": where("message_kind = 'mandate_debit'", flag("NOT pre_debit_notification_sent")),
    "mandate_cohort_identical_params": where(_has, "coalesce(n_terms, 0)"),
    "mandate_creation_rate_per_payee_24h": where("message_kind = 'mandate_creation' AND beneficiary_id <> ''", "coalesce(n_made, 0)"),
    "mandate_amount_vs_afa_band": where(_has, "(amount_inr - 15000) / 15000"),
}, [f"ranks AS (SELECT event_id, h AS hp, (rank() OVER (PARTITION BY h > -1 ORDER BY h) - 1 + (count(*) OVER (PARTITION BY h) - 1) / 2.0) "
    f"/ (count(*) OVER (PARTITION BY h > -1) - 1) AS pct FROM (SELECT event_id, {_head} AS h FROM pay))",
    *ledger("c", "token_id", "cit_mit_indicator", p_cit="max(b_cit_mit_indicator) FILTER (back = 1)"),
    "m_p AS (SELECT a.event_id FROM pay a JOIN pay b ON a.mandate_max_amount_inr = b.mandate_max_amount_inr AND a.mandate_frequency = b.mandate_frequency "
    f"AND a.{_has} AND b.{_has} AND b.ts_us >= a.ts_us - {D1} AND (b.ts_us, b.event_id) < (a.ts_us, a.event_id))",
    hist("m", "m_p", n_terms="count(*)"),
    *ledger("b", "beneficiary_id", "message_kind", n_made=within("count(*)", D1, "b_message_kind = 'mandate_creation'"))],
    ["ranks", "c", "m", "b"]))

# --- amounts near thresholds ---------------------------------------------------------------------
def _nearest(points) -> str:
    best = f"{points[0]}"
    for p in points[1:]:
        best = f"CASE WHEN abs(amount_inr - {p}) < abs(amount_inr - ({best})) THEN {p} ELSE ({best}) END"
    return best


_geo_base = (f"thr AS (SELECT *, CASE WHEN {IS_UPI} THEN u WHEN TRUE THEN c END AS t FROM (SELECT *, {_nearest((500, 2000, 5000, 15000, 100000))} AS u, "
             f"{_nearest((2000, 5000, 15000, 50000, 100000))} AS c FROM pay))")
_base2 = "base AS (SELECT *, amount_inr < t AND (t - amount_inr) / t <= 0.02 AS below FROM thr)"
_atom = "least(" + ", ".join(f"abs(pay.amount_inr - {a})" for a in (100, 200, 500, 1000, 2000, 5000)) + ")"
family("threshold_geometry", C.family("threshold_geometry"), family_sql({
    "distance_to_nearest_threshold": "pay.amount_inr - t", "distance_to_nearest_threshold_rel": "(pay.amount_inr - t) / t",
    "just_below_threshold_flag": flag("below"), "amount_mass_below_cap_24h": "coalesce(mass, -1)",
    "threshold_hug_run_length": "coalesce(stop - 1, n, 0)", "cumulative_count_24h_vs_cap": "coalesce(n24, 0) / 12.0",
    "amount_log": "ln(1 + pay.amount_inr)", "amount_is_round_atom": flag(f"{_atom} < 0.5"),
    "amount_round_number_avoidance": f"least({_atom} / greatest(pay.amount_inr, 1), 1)",
}, [_geo_base, _base2, pairs("p", PK, "below").replace("FROM pay a JOIN pay b", "FROM base a JOIN base b"),
    hist("x", "p", n="count(*)", stop="min(back) FILTER (NOT b_below)", n24=within("count(*)", D1),
         mass=within("avg(CAST(b_below AS INT))", D1))], ["base", "x"]))

# --- messages against each other -----------------------------------------------------------------
_refund = "message_kind = 'refund_credit'"
family("cross_message_divergence", C.family("cross_message"), family_sql({
    "auth_to_presentment_ratio": "auth_to_presentment_ratio",
    "auth_to_presentment_ratio_vs_mcc": "CASE WHEN auth_to_presentment_ratio > 0 AND med > 0 THEN auth_to_presentment_ratio - med ELSE -1 END",
    "presentment_age_days": "presentment_age_days",
    "incremental_auth_absent": where("message_kind = 'presentment'", flag("NOT incremental_auth_present")),
    "reversal_absent": where("message_kind = 'presentment'", flag("NOT reversal_present")),
    "refund_without_original_auth": where(_refund, flag("original_auth_event_id = ''")),
    "refund_exceeds_original_flag": where(f"{_refund} AND refund_amount_inr >= 0", flag("refund_amount_inr > amount_inr + 1e-6")),
    "refund_to_different_credential": where(_refund, flag("refund_to_different_credential")),
    "credit_to_debit_ratio_per_acceptor_24h": ratio("coalesce(cr, 0)", "coalesce(db, 0)"),
    "time_to_dispute_days": where("dispute_filed_ts > 0", "(dispute_filed_ts - ts) / 86400"),
    "label_channel_disagreement": "0",
}, [*ledger("x", "merchant_id", "amount_inr", "message_kind", cr=within("sum(b_amount_inr)", D1, f"b_{_refund}"),
            db=within("sum(b_amount_inr)", D1, "b_message_kind <> 'refund_credit'")),
    f"meds AS (SELECT mcc, median(auth_to_presentment_ratio) AS med FROM pay WHERE {STAT_ROWS} AND auth_to_presentment_ratio > 0 AND mcc <> '' GROUP BY mcc HAVING count(*) >= 10)",
    "med AS (SELECT event_id, med FROM pay JOIN meds USING (mcc))"], ["x", "med"]), needs_stats=True)

# --- graph -----------------------------------------------------------------------------------------
def trips(extra: str = "") -> list[str]:
    return [f"trip AS (SELECT *, CASE WHEN lag(cardholder_id) OVER w <> '' AND lag(cardholder_id) OVER w = cardholder_id AND beneficiary_id <> '' THEN 1 ELSE 0 END AS rt,"
            f" CASE WHEN beneficiary_id <> '' THEN lag(greatest(beneficiary_fanin_degree, 0)) OVER w END AS p_core{extra} FROM pay"
            " WINDOW w AS (PARTITION BY beneficiary_id ORDER BY ts_us, event_id))"]


family("graph_fanout", C.family("graph_sketches"), family_sql({
    "sketch_distinct_payers_per_beneficiary_1h": "coalesce(d1h, 0)", "sketch_distinct_payers_per_beneficiary_24h": "coalesce(d24, 0)",
    "sketch_beneficiary_fanin_degree": "pay.beneficiary_fanin_degree", "sketch_beneficiary_fanout_degree": "pay.beneficiary_fanout_degree",
    "sketch_payer_fanout_degree_24h": "coalesce(fan, 0)", "sketch_pan_token_fanout_7d": "coalesce(d7, 0)",
    "sketch_device_shared_entity_count": "coalesce(n_dev, -1)", "sketch_address_node_density": "coalesce(n_addr, -1)",
    "sketch_two_hop_reach_24h": "coalesce(d24, 0) * coalesce(fan, 0)", "sketch_round_trip_flow_flag": "rt",
    "sketch_kcore_acquisition_rate": "CASE WHEN p_core IS NOT NULL THEN greatest(pay.beneficiary_fanin_degree, 0) - p_core ELSE -1 END",
    "sketch_motif_reciprocity": "coalesce(recip, -1)", "sketch_fingerprint_collision_degree": "coalesce(n_dev, -1)",
    "sketch_geohash_distinct_payer_devices": "coalesce(n_spot, 0)",
    "sketch_first_txn_at_acceptor_share_24h": "coalesce(fresh, -1)", "sketch_seeder_cluster_membership": "coalesce(seed, -1)",
}, [*trips(), pairs("b_p", "beneficiary_id", "cardholder_id", "rt", "message_kind", "amount_inr").replace("FROM pay a JOIN pay b", "FROM trip a JOIN trip b"),
    hist("b", "b_p", d1h=within("count(DISTINCT nullif(b_cardholder_id, ''))", H1), d24=within("count(DISTINCT nullif(b_cardholder_id, ''))", D1),
         recip=within("avg(b_rt)", D7), seed=within("avg(CASE WHEN b_message_kind = 'inbound_credit' AND b_amount_inr < 500 THEN 1 ELSE 0 END)", D7)),
    *ledger("y", "cardholder_id", "beneficiary_id", fan="count(DISTINCT b_beneficiary_id)"),
    *ledger("z", "pan_canonical", "merchant_id", d7=within("count(DISTINCT nullif(b_merchant_id, ''))", D7)),
    "dev AS (SELECT pay.event_id, n_dev FROM pay JOIN (SELECT device_fingerprint_id, count(DISTINCT cardholder_id) AS n_dev FROM pay WHERE device_fingerprint_id <> '' GROUP BY 1) USING (device_fingerprint_id))",
    "addr AS (SELECT pay.event_id, n_addr FROM pay JOIN (SELECT address_id, count(DISTINCT cardholder_id) AS n_addr FROM pay WHERE address_id <> '' GROUP BY 1) USING (address_id))",
    "spot AS (SELECT a.event_id, count(DISTINCT b.device_fingerprint_id) AS n_spot FROM pay a JOIN pay b ON a.geo_cell = b.geo_cell AND a.payee_vpa = b.payee_vpa "
    "AND (b.ts_us, b.event_id) < (a.ts_us, a.event_id) GROUP BY a.event_id)",
    first_of("firsts", "merchant_id", "cardholder_id"),
    "mp AS (SELECT *, event_id IN (SELECT event_id FROM firsts) AS is_first FROM pay)",
    pairs("m_p", "merchant_id", "is_first").replace("FROM pay a JOIN pay b", "FROM mp a JOIN mp b"),
    hist("m", "m_p", fresh=within("avg(CAST(b_is_first AS INT))", D1))],
    ["trip", "b", "y", "z", "dev", "addr", "spot", "m"]))

# --- beneficiary side ------------------------------------------------------------------------------
family("beneficiary_flow", C.family("beneficiary_side"), family_sql({
    "beneficiary_account_age_days": "pay.beneficiary_account_age_days", "beneficiary_age_band_ordinal": age("pay.beneficiary_account_age_days"),
    "in_out_skew": ratio("abs(coalesce(i24, 0) - coalesce(o24, 0))", "coalesce(i24, 0)"),
    "value_conservation_net_of_skim": ratio("coalesce(o24, 0)", "coalesce(i24, 0)"),
    "pass_through_dwell_seconds": "pay.beneficiary_dwell_seconds",
    "pass_through_dwell_log": where("pay.beneficiary_dwell_seconds >= 0", "ln(1 + pay.beneficiary_dwell_seconds)"),
    "beneficiary_onward_send_minutes": "pay.beneficiary_onward_send_minutes",
    "first_receipt_to_first_send_minutes": where("pay.beneficiary_id <> '' AND pay.beneficiary_dwell_seconds >= 0",
                                                 "(pay.ts_us - coalesce(t0, pay.ts_us)) / 60e6 + pay.beneficiary_dwell_seconds / 60"),
    "beneficiary_distinct_payers_24h": "coalesce(d24, 0)", "repeat_payer_share": "coalesce(rep, -1)",
    "payer_set_growth_rate": "coalesce(grow, 0) / 24.0",
    "biller_continuity_absent": where("pay.beneficiary_id <> ''", "1 - coalesce(bill, 0)"),
    "first_credit_source_concentration": "coalesce(hhi, -1)",
    "beneficiary_category_ordinal": scale("pay.beneficiary_category", FE.CATEGORY_ORDER),
    "beneficiary_kyc_tier_ordinal": scale("pay.beneficiary_kyc_tier", FE.KYC_ORDER),
    "creditor_name_match_score": "pay.creditor_name_match_score",
    "beneficiary_change_within_cooling_hours": where("pay.beneficiary_change_ts > 0", "(pay.ts - pay.beneficiary_change_ts) / 3600"),
    "remittance_info_drift": where("coalesce(p_remit, '') <> ''", f"1 - ({jaccard('pay.remittance_info', 'p_remit')})"),
    "amount_vs_vendor_history": "CASE WHEN m30 > 0 THEN pay.amount_inr / m30 ELSE -1 END",
    "payee_vpa_age_days": "pay.payee_vpa_age_days",
    "payee_name_brand_similarity": jaccard("pay.payee_name_string", "pay.acceptor_descriptor"),
    "inbound_credit_then_outbound_different_payee": flag("p_kind = 'inbound_credit' AND pay.message_kind = 'authorisation'"),
    "beneficiary_prior_from_exchange": "0",
}, [first_of("firsts", "beneficiary_id", "cardholder_id"), "bp AS (SELECT *, event_id IN (SELECT event_id FROM firsts) AS is_first FROM pay)",
    pairs("b_p", "beneficiary_id", "cardholder_id", "is_first", "message_kind", "amount_inr", "beneficiary_category", "beneficiary_first_credit_source", "remittance_info")
    .replace("FROM pay a JOIN pay b", "FROM bp a JOIN bp b"),
    hist("b", "b_p", i24=within("sum(b_amount_inr)", D1, "b_message_kind = 'inbound_credit'"), o24=within("sum(b_amount_inr)", D1, "b_message_kind = 'onward_send'"),
         t0="min(b_ts)", d24=within("count(DISTINCT nullif(b_cardholder_id, ''))", D1), rep=within("avg(1 - CAST(b_is_first AS INT))", D7),
         grow=within("sum(CAST(b_is_first AS INT))", D1), bill=within("avg(CASE WHEN b_beneficiary_category = 'biller' THEN 1 ELSE 0 END)", D30),
         p_remit="max(b_remittance_info) FILTER (back = 1)", m30=within("avg(b_amount_inr)", D30)),
    "src AS (SELECT event_id, sum(n * n) / (sum(n) * sum(n)) AS hhi FROM (SELECT event_id, b_beneficiary_first_credit_source, count(*) AS n FROM b_p GROUP BY ALL) GROUP BY event_id)",
    *ledger("y", "cardholder_id", "message_kind", p_kind="max(b_message_kind) FILTER (back = 1)")], ["b", "src", "y"]))

# --- onboarding batches ------------------------------------------------------------------------------
_ob = "onboarding_batch_id"
BATCH_CTES = [
    f"rows AS (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY {_ob} ORDER BY ts_us, event_id)) / 1e6 AS d FROM pay WHERE {_ob} <> '')",
    f"g AS (SELECT {_ob}, count(*) AS n, CASE WHEN count(*) >= 3 THEN 1 - least(CASE WHEN abs(avg(d)) > 1e-9 THEN stddev_pop(d) / avg(d) ELSE 0 END, 1) ELSE -1 END AS timing, "
    f"1 - count(DISTINCT ip_asn) / count(*) AS asn, avg(name_ngram_unlikelihood) AS ngram, avg(address_geocode_density) AS dens FROM rows GROUP BY 1)",
    f"e AS (SELECT {_ob}, CASE WHEN count(*) > 1 THEN -sum(k / t * ln(k / t)) / ln(count(*)) ELSE 0 END AS ent FROM (SELECT {_ob}, device_model, count(*) AS k, "
    f"sum(count(*)) OVER (PARTITION BY {_ob}) AS t FROM rows GROUP BY 1, 2) GROUP BY 1)",
    f"f AS (SELECT {_ob}, sum(k * k) / (sum(k) * sum(k)) AS hhi FROM (SELECT {_ob}, beneficiary_first_credit_source, count(*) AS k FROM rows GROUP BY 1, 2) GROUP BY 1)",
    f"k AS (SELECT {_ob}, max(k) / sum(k) AS tier_share FROM (SELECT {_ob}, kyc_tier, count(*) AS k FROM rows GROUP BY 1, 2) GROUP BY 1)",
]
family("onboarding_cohort", C.family("onboarding_cohort"), family_sql({
    "onboarding_batch_size": "coalesce(n, -1)", "onboarding_batch_timing_cluster": "coalesce(timing, -1)",
    "device_os_entropy_collapse": "coalesce(1 - ent, -1)", "device_model_entropy": "coalesce(ent, -1)", "asn_reuse_rate": "coalesce(asn, -1)",
    "name_ngram_unlikelihood": "coalesce(ngram, -1)", "address_geocode_density": "coalesce(dens, -1)",
    "onboarding_to_first_credit_minutes": where(f"pay.{_ob} <> '' AND onboarding_ts > 0", "(ts - onboarding_ts) / 60"),
    "first_credit_source_concentration_batch": "coalesce(hhi, -1)", "batch_kyc_tier_uniformity": "coalesce(tier_share, -1)",
}, [*BATCH_CTES,
    f"x AS (SELECT event_id, g.*, ent, hhi, tier_share FROM rows JOIN g USING ({_ob}) JOIN e USING ({_ob}) JOIN f USING ({_ob}) JOIN k USING ({_ob}))"], ["x"]))

# --- entity age --------------------------------------------------------------------------------------
_ages = ("pan_age_days", "vpa_age_days", "device_age_days", "merchant_age_days", "account_age_days")
_min = "coalesce(least(" + ", ".join(f"CASE WHEN {a} >= 0 THEN {a} END" for a in (*_ages, "beneficiary_account_age_days", "payee_vpa_age_days")) + "), -1)"


def _prior(name: str, key: str) -> list[str]:
    return [f"{name}_g AS (SELECT {key}, count(*) / (count(*) + 30.0) * avg(CAST(oracle_is_attack AS INT)) + (1 - count(*) / (count(*) + 30.0)) * (SELECT g FROM overall) AS r "
            f"FROM pay WHERE {STAT_ROWS} AND {key} <> '' GROUP BY 1 HAVING count(*) >= 30)",
            f"{name} AS (SELECT event_id, r FROM pay JOIN {name}_g USING ({key}))"]


family("entity_age", C.family("entity_age"), family_sql({
    **{a: a for a in _ages}, "min_entity_age_days": _min, "entity_age_band_ordinal": age(f"({_min})"),
    "is_first_event_for_entity": flag("firsts.event_id IS NOT NULL"), "cold_start_flag": flag(f"{_min} >= 0 AND {_min} < 1"),
    "bin_issuer_prior_fraud_rate": "coalesce(p1.r, (SELECT g FROM overall))", "peer_cohort_prior_fraud_rate": "coalesce(p2.r, (SELECT g FROM overall))",
    "geo_cell_prior_fraud_rate": "coalesce(p3.r, (SELECT g FROM overall))",
}, [f"overall AS (SELECT avg(CAST(oracle_is_attack AS INT)) AS g FROM pay WHERE {STAT_ROWS})", first_of("firsts", PK),
    *_prior("p1", "bin_prefix"), *_prior("p2", "cohort"), *_prior("p3", "geo_cell")], ["firsts", "p1", "p2", "p3"]), needs_stats=True)

# --- habit deviation ---------------------------------------------------------------------------------
_new = {"mcc": "mcc", "geo": "geo_cell", "rail": "rail"}
family("habit_deviation", C.family("habit_deviation"), family_sql({
    "amount_ratio_to_own_baseline": "CASE WHEN med > 0 THEN pay.amount_inr / med ELSE -1 END",
    "amount_zscore_to_own_baseline": "CASE WHEN n30 >= 2 AND sd > 0 THEN (pay.amount_inr - m) / sd ELSE -1 END",
    "amount_pct_in_peer_cohort": "pct", "is_largest_ever_for_entity": "CASE WHEN mx >= 0 THEN CASE WHEN pay.amount_inr > mx THEN 1 ELSE 0 END ELSE -1 END",
    **{f"{k}_novelty": flag(f"pay.primary_key <> '' AND f_{k}.event_id IS NOT NULL") for k in _new},
    "mcc_habit_probability": "coalesce(known, -1)",
    "geovelocity_break": "CASE WHEN p_geo <> '' AND p_geo <> pay.geo_cell AND pay.gap >= 0 THEN CASE WHEN pay.gap < 1800 THEN 1 ELSE 0 END ELSE -1 END",
    "device_churn_30d": "coalesce(churn, 0)", "rail_ratio_vs_peer_cohort": "CASE WHEN own >= 0 AND coh > 0 THEN own / coh ELSE -1 END",
    "dormancy_reactivation_flag": where("pay.gap >= 0", flag("pay.gap > 2592000")),
}, [*[first_of(f"f_{k}", PK, col) for k, col in _new.items()],
    f"hb AS (SELECT *, event_id IN (SELECT event_id FROM f_mcc) AS new_mcc, CASE WHEN {IS_UPI} THEN 1 ELSE 0 END AS upi FROM pay)",
    pairs("p", PK, "amount_inr", "new_mcc", "geo_cell", "device_fingerprint_id", "upi").replace("FROM pay a JOIN pay b", "FROM hb a JOIN hb b"),
    hist("x", "p", med=within("median(b_amount_inr)", D30, "back <= 64"), n30=within("count(*)", D30), m=within("avg(b_amount_inr)", D30),
         sd=within("stddev_pop(b_amount_inr)", D30), mx=within("max(b_amount_inr)", D30), known=within("avg(1 - CAST(b_new_mcc AS INT))", D30),
         p_geo="max(b_geo_cell) FILTER (back = 1)", churn=within("count(DISTINCT nullif(b_device_fingerprint_id, ''))", D30), own=within("avg(b_upi)", D30)),
    pairs("q", "cohort", "upi").replace("FROM pay a JOIN pay b", "FROM hb a JOIN hb b"), hist("y", "q", coh=within("avg(b_upi)", D30)),
    "r AS (SELECT event_id, (rank() OVER (PARTITION BY cohort ORDER BY amount_inr) - 1 + (count(*) OVER (PARTITION BY cohort, amount_inr) - 1) / 2.0) / (count(*) OVER (PARTITION BY cohort) - 1) AS pct FROM pay)"],
    ["x", "y", "r", "f_mcc", "f_geo", "f_rail"]))

# --- merchant side -----------------------------------------------------------------------------------
def _mode(name: str, key: str, col: str) -> list[str]:
    return [f"{name}_m AS (SELECT {key}, arg_min({col}, (-n, seen)) AS v FROM (SELECT {key}, {col}, count(*) AS n, min((ts_us, event_id)) AS seen FROM pay WHERE {key} <> '' GROUP BY 1, 2) GROUP BY 1)",
            f"{name} AS (SELECT event_id, coalesce(v, '') AS v FROM pay LEFT JOIN {name}_m USING ({key}))"]


family("merchant_side", C.family("merchant_side"), family_sql({
    "mcc_vs_basket_semantics": f"1 - ({jaccard('pay.mcc', 'pay.acceptor_descriptor')})",
    "acceptor_descriptor_mismatch": flag("pay.acceptor_descriptor <> md.v"),
    "merchant_ticket_step_change": "CASE WHEN a24 >= 0 AND a30 > 0 THEN a24 / a30 ELSE -1 END",
    "merchant_ramp_curve_shape": "CASE WHEN n7 > 0 THEN 7.0 * n1 / n7 ELSE -1 END",
    "merchant_approval_ratio_delta": "coalesce(ok1 - ok30, -1)",
    "new_mid_ticket_velocity": where("pay.merchant_age_days >= 0 AND pay.merchant_age_days < 30", "coalesce(n1, 0)"),
    "foreign_issuer_concentration": "coalesce(fgn, -1)", "first_txn_at_acceptor_share": "coalesce(fresh, -1)",
    "repeat_customer_share_merchant": "coalesce(rep, -1)", "refund_rate_anomaly": "coalesce(rf, -1)",
    "chargeback_after_funding_flag": where("pay.message_kind = 'chargeback'", flag("pay.presentment_age_days > 0")),
    "settlement_to_withdrawal_days": where("pay.settlement_amount_inr >= 0", "pay.presentment_age_days"),
    "traffic_geo_vs_registered_geo": flag("pay.geo_cell <> mg.v"),
    "merchant_volume_delta_in_cell": "CASE WHEN g7 > 0 THEN 7.0 * g1 / g7 - 1 ELSE -1 END",
}, [first_of("firsts", "merchant_id", "cardholder_id"), "mp AS (SELECT *, event_id IN (SELECT event_id FROM firsts) AS is_first FROM pay)",
    pairs("p", "merchant_id", "is_first", "amount_inr", "approved", "acceptor_country", "message_kind").replace("FROM pay a JOIN pay b", "FROM mp a JOIN mp b"),
    hist("x", "p", a24=within("avg(b_amount_inr)", D1), a30=within("avg(b_amount_inr)", D30), n1=within("count(*)", D1), n7=within("count(*)", D7),
         ok1=within("avg(CAST(b_approved AS INT))", H1), ok30=within("avg(CAST(b_approved AS INT))", D30),
         fgn=within("avg(CASE WHEN b_acceptor_country <> 'IN' THEN 1 ELSE 0 END)", D7), fresh=within("avg(CAST(b_is_first AS INT))", D1),
         rep=within("avg(1 - CAST(b_is_first AS INT))", D30), rf=within("avg(CASE WHEN b_message_kind = 'refund_credit' THEN 1 ELSE 0 END)", D30)),
    *ledger("g", "geo_cell", g1=within("count(*)", D1), g7=within("count(*)", D7)),
    *_mode("md", "merchant_id", "acceptor_descriptor"), *_mode("mg", "merchant_id", "geo_cell")], ["x", "g", "md", "mg"]))

# --- device and session --------------------------------------------------------------------------------
family("device_session", C.family("device_session"), family_sql({
    "device_rebinding_event": flag("pay.device_rebinding_event"), "pin_reset_event": flag("pay.pin_reset_event"),
    "sms_silence_window_minutes": "pay.sms_silence_window_minutes",
    "rebinding_to_first_payee_minutes": "coalesce((pay.ts_us - t_re) / 60e6, -1)", "profile_change_before_spend_days": "coalesce((pay.ts_us - t_pr) / 86400e6, -1)",
    "session_duration_minutes": "pay.session_duration_minutes", "debits_per_uninterrupted_session": "coalesce(n24, 0)",
    "in_app_dwell_uniformity": calm("dw"), "escalating_amount_in_session": "CASE WHEN p_amt >= 0 THEN CASE WHEN pay.amount_inr > p_amt THEN 1 ELSE 0 END ELSE -1 END",
    "fresh_beneficiary_count_24h": "coalesce(fresh, 0)", "fd_liquidation_before_transfer": flag("pay.fd_liquidation_flag"),
    "device_fingerprint_entropy": "coalesce(e.h, -1)", "ip_asn_novelty": flag("pay.primary_key <> '' AND f_asn.event_id IS NOT NULL"),
    "referrer_domain_age_days": "pay.referrer_domain_age_days", "txn_note_template_score": jaccard("pay.txn_note", "nm.v"),
}, [first_of("f_asn", PK, "ip_asn"), first_of("f_ben", PK, "beneficiary_id"),
    "base AS (SELECT *, event_id IN (SELECT event_id FROM f_ben) AS new_ben, device_model || '|' || device_os || '|' || ip_asn AS bundle FROM pay)",
    pairs("p", PK, "new_ben", "device_rebinding_event", "message_kind").replace("FROM pay a JOIN pay b", "FROM base a JOIN base b"),
    hist("x", "p", t_re="max(b_ts) FILTER (b_device_rebinding_event)", t_pr="max(b_ts) FILTER (b_message_kind = 'profile_change')", fresh=within("sum(CAST(b_new_ben AS INT))", D1)),
    *ledger("s", "session_id", "amount_inr", "in_app_dwell_seconds", n24=within("count(*)", D1), dw=cv("greatest(b_in_app_dwell_seconds, 0)"), p_amt="max(b_amount_inr) FILTER (back = 1)"),
    pairs("d", "device_fingerprint_id", "bundle").replace("FROM pay a JOIN pay b", "FROM base a JOIN base b"), entropy("e", "d", "b_bundle"),
    *_mode("nm", "beneficiary_id", "txn_note")], ["x", "s", "e", "f_asn", "nm"]))

# --- thin rails ------------------------------------------------------------------------------------------
_aeps = "rail = 'aeps-microatm'"
_lite = "rail = 'upi-lite-offline' AND message_kind = 'lite_debit'"
family("thin_rail", C.family("thin_rail_observables"), family_sql({
    "reconciliation_lag_minutes": where("reconciliation_lag_minutes >= 0", "reconciliation_lag_minutes"),
    "reconciliation_lag_pct_in_peer_cohort": where("reconciliation_lag_minutes >= 0", "pct"),
    "balance_enquiry_count_24h": where(f"pay.{_aeps}", "coalesce(enq, 0)"),
    "balance_enquiry_to_withdrawal_ratio_24h": where(f"pay.{_aeps}", "coalesce(enq, 0) / greatest(coalesce(wd, 0), 1)"),
    "lite_debits_since_topup_24h": where(f"pay.{_lite} AND original_auth_event_id <> ''", "0"),
}, ["r AS (SELECT event_id, (rank() OVER (PARTITION BY cohort ORDER BY l) - 1 + (count(*) OVER (PARTITION BY cohort, l) - 1) / 2.0) / (count(*) OVER (PARTITION BY cohort) - 1) AS pct "
    "FROM (SELECT *, greatest(reconciliation_lag_minutes, 0) AS l FROM pay))",
    *ledger("y", "cardholder_id", "rail", "message_kind", enq=within("count(*)", D1, f"b_{_aeps} AND b_message_kind = 'balance_enquiry'"),
            wd=within("count(*)", D1, f"b_{_aeps} AND b_message_kind = 'assisted_withdrawal'"))], ["r", "y"]))

# --- context -----------------------------------------------------------------------------------------------
family("channel_context", [*C.family("rail_context"), *C.family("channel_context")], family_sql({
    **{n: flag(f"rail = '{r}'") for r, n in ((r, C.rail_feature(r)) for r in FE.RAILS)},
    "tier_is_b": flag("tier = 'B'"), "message_kind_is_authorisation": flag("message_kind = 'authorisation'"),
    "message_kind_is_credit_leg": flag("message_kind IN ('inbound_credit', 'onward_send')"),
    "message_kind_is_post_auth": flag("message_kind IN ('presentment', 'chargeback', 'representment', 'refund_credit')"),
    "has_beneficiary_leg": flag("beneficiary_id <> ''"), "entry_mode_ordinal": scale("pos_entry_mode", FE.ENTRY_MODE_ORDER),
    "initiation_mode_ordinal": scale("upi_initiation_mode", FE.INITIATION_ORDER), "is_cross_border": flag("acceptor_country <> 'IN'"),
    "incumbent_score": "incumbent_score", "incumbent_rule_count": "CASE incumbent_rule_fired WHEN '' THEN 0 WHEN 'INC-01' THEN 1 ELSE 2 END",
}))

# --- velocity ----------------------------------------------------------------------------------------------
_KEYS = ("merchant_id", "beneficiary_id")


def _velocity_sql(keys=_KEYS) -> str:
    """All but the cohort rank of amount sums: the engines cast doubles to decimals differently in the last place, which
    reorders near ties; that rank is tested on exact amounts."""
    exprs, ctes, joins = {}, [], []
    wins = {"1h": H1, "24h": D1, "7d": D7, "30d": D30}
    for key in keys:
        cp = FE.COUNTERPARTY[key]
        aggs = {}
        for w, us in wins.items():
            aggs |= {f"n_{w}": within("count(*)", us), f"s_{w}": within("sum(CAST(b_amount_inr AS DECIMAL(38, 12)))", us), f"d_{w}": within(f"count(DISTINCT nullif(b_{cp}, ''))", us)}
        ctes += [*ledger(f"{key}_h", key, "amount_inr", cp, **aggs),
                 f"{key}_b AS (SELECT pay.event_id, cohort, " + ", ".join(
                     f"coalesce(n_{w}, 0) AS n_{w}, coalesce(s_{w}, 0) AS s_{w}, coalesce(d_{w}, 0) AS d_{w}" for w in wins)
                 + f" FROM pay LEFT JOIN {key}_h ON pay.event_id = {key}_h.event_id)",
                 f"{key}_r AS (SELECT *, " + ", ".join(
                     f"(rank() OVER (PARTITION BY cohort ORDER BY n_{w}) - 1 + (count(*) OVER (PARTITION BY cohort, n_{w}) - 1) / 2.0) / (count(*) OVER (PARTITION BY cohort) - 1) AS r_{w}"
                     for w in wins) + f" FROM {key}_b)"]
        joins.append(f"{key}_r")
        for w, us in wins.items():
            p, t = f"vel_{key}_{w}_", f"{key}_r"
            for stat, s in (("count", "n"), ("amount_sum", "s")):
                exprs[f"{p}{stat}_ratio"] = f"CASE WHEN {t}.n_30d > 0 THEN {t}.{s}_{w} / greatest({t}.{s}_30d * {us / D30}, 1e-9) ELSE -1 END"
            exprs[f"{p}count_pct"] = f"{t}.r_{w}"
            exprs[f"{p}distinct_counterparty"] = f"{t}.d_{w}"
    return family_sql(exprs, ctes, joins)


_velocity_names = [n for n in C.FEATURES if any(n.startswith(f"vel_{k}_") for k in _KEYS) and not n.endswith("amount_sum_pct")]
family("velocity_two_keys", _velocity_names, _velocity_sql())
for _key in FE.COUNTERPARTY:
    family(f"velocity_{_key}", [n for n in C.FEATURES if n.startswith(f"vel_{_key}_") and not n.endswith("amount_sum_pct")], _velocity_sql((_key,)))


@query("view_projection", f"""WITH {payments_sql('amount_inr', 'acceptor_country', 'tier')}
    SELECT event_id, round(ln(1 + amount_inr), 6) AS amount_log, CAST({flag("acceptor_country <> 'IN'")} AS DOUBLE) AS is_cross_border,
      CAST({flag("tier = 'B'")} AS DOUBLE) AS tier_is_b FROM pay""")
def _view(spark, sf):
    """Three columns through the acquirer's view: features it cannot construct are absent."""
    visible = set(C.features_for_view("acquirer"))
    names = [n for n in ("amount_log", "is_cross_border", "tier_is_b", "mandate_present") if n in visible]
    return rounded(FE.build_features(prepared(spark, sf), None, names))


@query("exchange_feature", f"""WITH {payments_sql("beneficiary_id", "oracle_is_attack", "acceptor_country")}, h AS (SELECT DISTINCT beneficiary_id AS b FROM pay WHERE oracle_is_attack AND beneficiary_id <> '')
    SELECT event_id, CASE WHEN beneficiary_id IN (SELECT b FROM h) THEN 0.55e0 ELSE 0e0 END AS beneficiary_prior_from_exchange, CAST({flag("acceptor_country <> 'IN'")} AS DOUBLE) AS is_cross_border FROM pay""")
def _exchange_feature(spark, sf):
    """The exchange's prior as a feature; so few ids set no bit by chance."""
    prep = prepared(spark, sf)
    exchange = build_exchange(prep.filter("oracle_is_attack"), "beneficiary_id")
    return FE.build_features(prep, None, ["beneficiary_prior_from_exchange", "is_cross_border"], exchange=exchange)


def _view_query(view: str) -> None:
    """The whole view in one build, next to the joined SQL of the families; cohort ranks of amount sums have no SQL."""
    names = [n for n in C.features_for_view(view) if not n.endswith("amount_sum_pct")]
    left, parts = set(names), {}
    for fam, (given, sql) in FAMILY_SQL.items():
        if fam != "velocity_two_keys" and (mine := [n for n in given if n in left]):
            parts[fam] = (mine, sql)
            left -= set(mine)
    if left:
        raise ValueError(f"no family gives {sorted(left)}")
    ctes = ", ".join(f"f_{fam} AS ({sql})" for fam, (_, sql) in parts.items())
    cols = ", ".join(f"f_{fam}.{n}" for fam, (mine, _) in parts.items() for n in mine)
    first, *rest = [f"f_{fam}" for fam in parts]

    @query(f"view_{view}", f"WITH {ctes} SELECT {first}.event_id, {cols} FROM {first} " + " ".join(f"JOIN {x} ON {x}.event_id = {first}.event_id" for x in rest))
    def whole(spark, sf):
        prep = prepared(spark, sf)
        return rounded(FE.build_features(prep, stats_for(prep), names), 7)


for _v in ("issuer", "payee_psp"):
    _view_query(_v)


@query("feature_matrix")
def _matrix(spark, sf):
    """Every model feature the payee PSP can construct."""
    prep = prepared(spark, sf)
    return FE.build_features(prep, stats_for(prep), C.features_for_view("payee_psp"), as_float=True)
