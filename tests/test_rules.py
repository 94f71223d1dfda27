"""Every rule on one row that breaks it and one that keeps it, written by hand from the rules' definitions."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rules as R
from tidemark.schema import EVENT_SCHEMA, complete

BASE = {"event_id": "x", "ts": 1000.0, "day_index": 1, "hour_ist": 12.0, "dow": 2, "rail": "upi-pay", "message_kind": "authorisation", "tier": "A",
        "amount_inr": 100.0}
AGES = ("device_age_days", "pan_age_days", "vpa_age_days", "account_age_days", "merchant_age_days", "payee_vpa_age_days",
        "beneficiary_account_age_days", "agent_endpoint_age_days", "presentment_age_days", "referrer_domain_age_days")
ENUMS = {"11": ("pos_entry_mode", "chip"), "12": ("cvm_result", "none"), "13": ("avs_result", "no_match"), "14": ("cvv2_result", "no_match"),
         "15": ("threeds_authentication_result", "frictionless_success"), "16": ("threeds_eci", "authenticated"), "17": ("response_code", "approved"),
         "18": ("token_assurance_level", "none"), "19": ("dispute_reason_code", "none"), "20": ("upi_initiation_mode", "not_applicable"),
         "21": ("cohort_tag", "ordinary")}


def on(rail, kind="authorisation", **more):
    return {"rail": rail, "message_kind": kind, **more}


CHIP = {"emv_cryptogram_present": True, "emv_cryptogram_atc": 4, "emv_unpredictable_number": "n"}
DEBIT = {"message_kind": "mandate_debit", "mandate_id": "m", "mandate_max_amount_inr": 500.0, "cit_mit_indicator": "MIT", "cvm_result": "none",
         "pre_debit_notification_sent": True}
# id: (what breaks it, what keeps it)
CASES = {
    "STR-01": ({"event_id": ""}, {}), "STR-02": ({"rail": "card-x"}, {}), "STR-03": ({"message_kind": "hello"}, {}), "STR-04": ({"tier": "C"}, {"tier": "B"}),
    "STR-05": ({"rail": "upi-pay", "tier": "B"}, {"rail": "upi-pay", "tier": "A"}), "STR-06": ({"amount_inr": -0.5}, {"amount_inr": 0.0}),
    "STR-07": ({"currency": "USD"}, {"currency": "INR"}), "STR-08": ({"hour_ist": 24.0}, {"hour_ist": 0.0}), "STR-09": ({"dow": 7}, {"dow": 6}),
    "STR-10": ({"day_index": -1}, {"day_index": 0}), "STR-22": ({"hour_ist": 23.995}, {"hour_ist": 23.99}),
    **{f"STR-{n}": ({name: "no such value"}, {name: good}) for n, (name, good) in ENUMS.items()},
    **{f"STR-AGE-{name}": ({name: -2.0}, {name: -1.0}) for name in AGES},
    "CARD-01": (on("card-cnp-3ds", **CHIP), on("card-cp-emv", **CHIP)),
    "CARD-02": (on("card-cnp-keyed", threeds_authentication_result="frictionless_success"), on("card-cnp-3ds", threeds_authentication_result="frictionless_success")),
    "CARD-03": (on("card-cnp-keyed", threeds_eci="authenticated"), on("card-cnp-keyed", threeds_eci="none")),
    "CARD-04": ({**CHIP, "emv_cryptogram_atc": -1}, {**CHIP, "emv_cryptogram_atc": 0}),
    "CARD-05": ({**CHIP, "emv_unpredictable_number": ""}, CHIP),
    "CARD-06": ({**CHIP, "pos_entry_mode": "magstripe_fallback"}, {"pos_entry_mode": "magstripe_fallback", "emv_cryptogram_present": False}),
    "CARD-07": (on("card-cp-emv", threeds_eci="authenticated"), on("card-cp-emv", threeds_eci="none", threeds_authentication_result="not_applicable")),
    "CARD-08": (on("card-cp-emv", avs_result="no_match"), on("card-cp-emv", avs_result="not_requested", cvv2_result="not_provided")),
    "CARD-09": (on("card-cp-emv", pos_entry_mode="contactless", emv_cryptogram_present=False), on("card-cp-emv", pos_entry_mode="contactless", **CHIP)),
    "CARD-10": ({"pos_entry_mode": "contactless_no_cvm", "cvm_result": "biometric"}, {"pos_entry_mode": "contactless_no_cvm", "cvm_result": "none"}),
    "CARD-11": ({"threeds_eci": "authenticated", "threeds_authentication_result": "challenge_abandoned"}, {"threeds_eci": "authenticated", "threeds_authentication_result": "challenge_success"}),
    "CARD-12": ({"threeds_authentication_result": "challenge_success", "threeds_challenge_requested": False},
                {"message_kind": "presentment", "threeds_authentication_result": "challenge_success", "threeds_challenge_requested": False}),
    "CARD-13": ({"threeds_authentication_result": "challenge_success", "threeds_acs_id": ""}, {"threeds_authentication_result": "challenge_success", "threeds_acs_id": "acs"}),
    "CARD-14": ({"token_assurance_level": "high", "token_id": ""}, {"token_assurance_level": "high", "token_id": "t"}),
    "CARD-15": ({"token_id": "t", "token_requestor_id": ""}, {"token_id": "t", "token_requestor_id": "r"}),
    "CARD-16": (on("card-cnp-keyed", pan_canonical=""), on("card-cnp-keyed", "presentment", pan_canonical="")),
    "CARD-17": (on("card-cp-emv", terminal_id=""), on("card-cp-emv", terminal_id="t")),
    "CARD-18": (on("card-token-provisioning", provisioning_to_first_spend_minutes=-1.0), on("card-token-provisioning", provisioning_to_first_spend_minutes=0.0)),
    "CARD-19": ({"message_kind": "provisioning_request", "amount_inr": 1.0}, {"message_kind": "provisioning_request", "amount_inr": 0.0}),
    "UPI-01": (on("upi-collect", **CHIP), on("card-cp-emv", **CHIP)), "UPI-02": (on("upi-pay", threeds_eci="attempted"), on("upi-pay")),
    "UPI-03": (on("upi-lite-offline", cvv2_result="no_match"), on("upi-lite-offline", cvv2_result="")),
    "UPI-04": (on("upi-pay", vpa=""), on("upi-pay", vpa="a@b")), "UPI-05": (on("upi-pay", payee_vpa=""), on("upi-pay", "inbound_credit", payee_vpa="")),
    "UPI-06": (on("upi-pay", upi_initiation_mode="not_applicable"), on("upi-pay", upi_initiation_mode="intent")),
    "UPI-07": (on("upi-lite-offline", "lite_debit", pos_entry_mode="intent"), on("upi-lite-offline", "inbound_credit", pos_entry_mode="intent")),
    "UPI-08": (on("upi-lite-offline", "lite_topup", cvm_result="upi_pin"), on("upi-lite-offline", "lite_topup", cvm_result="none")),
    "UPI-09": ({"message_kind": "collect_response", "collect_request_id": "q", "original_auth_event_id": ""}, {"message_kind": "collect_response", "collect_request_id": "q", "original_auth_event_id": "o"}),
    "UPI-10": ({"message_kind": "collect_response", "collect_accepted": False, "approved": True}, {"message_kind": "collect_response", "collect_accepted": False, "approved": False}),
    "UPI-11": ({"message_kind": "collect_response", "collect_accepted": True, "cvm_result": "none"}, {"message_kind": "collect_response", "collect_accepted": True, "cvm_result": "upi_pin"}),
    "UPI-12": ({"message_kind": "collect_request", "cvm_result": "upi_pin"}, {"message_kind": "collect_request", "cvm_result": "none"}),
    "A2A-01": (on("a2a-credit-transfer", "credit_transfer", pacs_end_to_end_id=""), on("a2a-credit-transfer", "credit_transfer", pacs_end_to_end_id="e")),
    "A2A-02": ({"message_kind": "credit_transfer_status", "pacs_status_code": "ACSC", "original_auth_event_id": ""}, {"message_kind": "credit_transfer_status", "pacs_status_code": "ACSC", "original_auth_event_id": "o"}),
    "A2A-03": ({"message_kind": "credit_transfer_status", "pacs_status_code": "RJCT", "approved": True}, {"message_kind": "credit_transfer_status", "pacs_status_code": "RJCT", "approved": False}),
    "A2A-04": (on("a2a-credit-transfer", "credit_transfer", creditor_name_string=""), on("a2a-credit-transfer", "credit_transfer", creditor_name_string="n")),
    "MND-01": ({**DEBIT, "mandate_id": ""}, DEBIT), "MND-02": ({**DEBIT, "mandate_max_amount_inr": 0.0}, DEBIT),
    "MND-03": ({**DEBIT, "amount_inr": 501.0, "approved": True}, {**DEBIT, "amount_inr": 501.0, "approved": False}),
    "MND-04": ({**DEBIT, "amount_inr": 501.0, "response_code": "approved"}, {**DEBIT, "amount_inr": 501.0, "response_code": "declined_mandate_scope"}),
    "MND-05": ({**DEBIT, "cit_mit_indicator": "CIT"}, DEBIT), "MND-06": ({"cit_mit_indicator": "MIT", "cvm_result": "upi_pin"}, {"cit_mit_indicator": "CIT", "cvm_result": "upi_pin"}),
    "MND-07": ({**DEBIT, "pre_debit_notification_sent": False}, DEBIT),
    "MND-08": ({"message_kind": "mandate_creation", "cit_mit_indicator": "MIT"}, {"message_kind": "mandate_creation", "cit_mit_indicator": "CIT"}),
    "MND-09": ({"message_kind": "mandate_creation", "amount_inr": 5.0}, {"message_kind": "mandate_creation", "amount_inr": 0.0}),
    "MND-10": ({**DEBIT, "mandate_created_ts": 1001.0}, {**DEBIT, "mandate_created_ts": 1000.0}),
    "MND-11": ({"message_kind": "agent_authorisation", "mandate_max_amount_inr": 500.0, "response_code": "declined_mandate_scope"},
               {"message_kind": "agent_authorisation", "mandate_max_amount_inr": 50.0, "response_code": "declined_mandate_scope"}),
    "AGT-01": (on("agentic-commerce", agentic_indicator=False), on("agentic-commerce", agentic_indicator=True)),
    "AGT-02": (on("agentic-commerce", agent_identity_id=""), on("agentic-commerce", agent_identity_id="a")),
    "AGT-03": (on("agentic-commerce", cvm_result="none", **CHIP), on("agentic-commerce", cvm_result="none", emv_cryptogram_present=False)),
    "AGT-04": ({"message_kind": "agent_authorisation", "agent_quoted_amount_inr": -1.0}, {"message_kind": "agent_authorisation", "agent_quoted_amount_inr": 0.0}),
    "AEPS-01": (on("aeps-microatm", cvm_result="none"), on("aeps-microatm", cvm_result="biometric")), "AEPS-02": (on("aeps-microatm", terminal_id=""), on("aeps-microatm", terminal_id="t")),
    "AEPS-03": (on("aeps-microatm", beneficiary_id="b"), on("upi-pay", beneficiary_id="b")),
    "AEPS-04": ({"message_kind": "balance_enquiry", "amount_inr": 1.0}, {"message_kind": "balance_enquiry", "amount_inr": 0.0}),
    "RESP-01": ({"approved": True, "response_code": "referred"}, {"approved": True, "response_code": "approved_partial"}),
    "RESP-02": ({"approved": True, "response_code": "timeout"}, {"approved": False, "response_code": "timeout"}),
    "RESP-03": ({"approved": True, "incumbent_decision": "decline"}, {"approved": False, "incumbent_decision": "decline"}),
    "RESP-04": ({"incumbent_accept_probability": 1.0}, {"incumbent_accept_probability": -1.0}),
    "RESP-05": ({"incumbent_decision": "approve", "incumbent_accept_probability": -1.0}, {"incumbent_decision": "approve", "incumbent_accept_probability": 0.4}),
    "RESP-06": ({"response_code": "approved", "response_latency_ms": -1.0}, {"response_code": "approved", "response_latency_ms": 0.0}),
    "RESP-07": (on("upi-pay", response_code="step_up_required"), on("card-cnp-3ds", response_code="step_up_required")),
    "BEN-01": ({"message_kind": "inbound_credit", "beneficiary_id": ""}, {"message_kind": "inbound_credit", "beneficiary_id": "b"}),
    "BEN-02": ({"message_kind": "inbound_credit", "original_auth_event_id": ""}, {"message_kind": "inbound_credit", "original_auth_event_id": "o"}),
    "BEN-03": ({"message_kind": "inbound_credit", "approved": False}, {"message_kind": "inbound_credit", "approved": True}),
    "BEN-04": ({"message_kind": "onward_send", "beneficiary_id": "b", "original_auth_event_id": ""}, {"message_kind": "onward_send", "beneficiary_id": "b", "original_auth_event_id": "o"}),
    "BEN-05": (on("card-cp-emv", "inbound_credit"), on("upi-pay", "inbound_credit")),
    "BEN-06": ({"beneficiary_dwell_seconds": 60.0, "beneficiary_onward_send_minutes": 2.0}, {"beneficiary_dwell_seconds": 120.0, "beneficiary_onward_send_minutes": 2.0}),
    "BEN-07": ({"beneficiary_fanin_degree": 2.0, "beneficiary_distinct_payers_24h": 3.0}, {"beneficiary_fanin_degree": 3.0, "beneficiary_distinct_payers_24h": 3.0}),
    "PROV-01": ({"message_kind": "provisioning_request", "token_id": ""}, {"message_kind": "provisioning_request", "token_id": "t"}),
    "PROV-02": ({"message_kind": "provisioning_request", "provisioning_event_id": "other"}, {"message_kind": "provisioning_request", "provisioning_event_id": "SELF"}),
    "DSP-01": ({"message_kind": "chargeback", "dispute_reason_code": "none"}, {"message_kind": "presentment", "dispute_reason_code": "none"}),
    "DSP-02": ({"message_kind": "chargeback", "dispute_filed_ts": 0.0}, {"message_kind": "chargeback", "dispute_filed_ts": 5.0}),
    "DSP-03": ({"representment_won": True, "representment_filed": False}, {"representment_won": True, "representment_filed": True}),
    "DSP-04": ({"dispute_reason_code": "fraud"}, {"message_kind": "representment", "dispute_reason_code": "fraud"}),
    "CLR-01": ({"message_kind": "presentment", "settlement_amount_inr": -1.0}, {"message_kind": "presentment", "settlement_amount_inr": 0.0}),
    "CLR-02": ({"message_kind": "presentment", "presentment_age_days": -1.0}, {"message_kind": "presentment", "presentment_age_days": 0.0}),
    "CLR-03": ({"message_kind": "presentment", "settlement_amount_inr": 50.0, "auth_to_presentment_ratio": 0.6}, {"message_kind": "presentment", "settlement_amount_inr": 50.0, "auth_to_presentment_ratio": 0.5}),
    "CLR-04": ({"message_kind": "refund_credit", "refund_amount_inr": -1.0}, {"message_kind": "refund_credit", "refund_amount_inr": 0.0}),
    "CLR-05": ({"message_kind": "refund_credit", "refund_amount_inr": 99.0}, {"message_kind": "refund_credit", "refund_amount_inr": 100.0}),
    "ORC-01": ({"oracle_is_attack": True, "attack_campaign_id": ""}, {"oracle_is_attack": True, "attack_campaign_id": "k"}),
    "ORC-02": ({"oracle_is_attack": False, "attack_campaign_id": "k"}, {"oracle_is_attack": True, "attack_campaign_id": "k"}),
    "ORC-03": ({"oracle_is_attack": True, "generator": "sim", "attack_grammar_str": ""}, {"oracle_is_attack": True, "generator": "b", "attack_grammar_str": ""}),
    "ORC-04": ({"sealed_holdout": True, "oracle_is_attack": False}, {"sealed_holdout": True, "oracle_is_attack": True}),
    "ORC-05": ({"cohort_tag": "COHORT", "oracle_is_attack": True}, {"cohort_tag": "ordinary", "oracle_is_attack": True}),
}


def defaults(spark):
    return complete(spark.createDataFrame([tuple(BASE.values())], ", ".join(
        f"{k} {'string' if isinstance(v, str) else 'long' if isinstance(v, int) else 'double'}" for k, v in BASE.items()))).first().asDict()


def frame(spark, rows):
    base = defaults(spark)
    unknown = {k for r in rows for k in r} - set(base)
    assert not unknown, unknown
    typed = {"bigint": int, "int": int, "double": float}
    return spark.createDataFrame([tuple(typed.get(f.dataType.simpleString(), lambda v: v)({**base, **r}[f.name]) for f in EVENT_SCHEMA.fields) for r in rows], EVENT_SCHEMA)


def test_every_event_rule_fires_and_rests(spark):
    assert {r.id for r in R.event_rules()} == {f"F1-{k}" for k in CASES}
    from tidemark.schema import COHORT_TAGS

    cohort = next(t for t in COHORT_TAGS if t != "ordinary")
    rows = []
    for k, pair in CASES.items():
        for word, row in zip(("bad", "ok"), pair):
            row = {"event_id": f"{word}:{k}", **row}
            rows.append({n: row["event_id"] if v == "SELF" else cohort if v == "COHORT" else v for n, v in row.items()})
    found = {(r["invariant_id"], r["event_id"]) for r in R.check_event_rules(frame(spark, rows)).collect()}
    assert not [k for k in CASES if (f"F1-{k}", "" if k == "STR-01" else f"bad:{k}") not in found]
    assert not [k for k in CASES if (f"F1-{k}", f"ok:{k}") in found]


def stream_rows():
    auth = {"message_kind": "authorisation", "rrn": "r1", "approved": True, "amount_inr": 100.0}
    rows = [{"event_id": "a1", "ts": 10.0, **auth}, {"event_id": "a2", "ts": 11.0, **auth, "rrn": "r2", "approved": False}, {"event_id": "a3", "ts": 12.0, **auth, "rrn": "r3"}]
    at = lambda i, ts, kind, ref, **m: {"event_id": i, "ts": ts, "message_kind": kind, "original_auth_event_id": ref, "amount_inr": 100.0, **m}
    rows += [
        at("ok-p", 20.0, "presentment", "a1", rrn="r1", settlement_amount_inr=100.0), at("lost", 21.0, "presentment", "none", rrn="zz"),
        at("early", 9.0, "presentment", "a1", rrn=""), at("other-rrn", 22.0, "presentment", "a1", rrn="r2"), at("declined", 23.0, "presentment", "a2", rrn="r2"),
        at("ok-c", 30.0, "chargeback", "a1", rrn="r1"), at("never-presented", 31.0, "chargeback", "a3", rrn="r3"),
        at("ok-r", 40.0, "refund_credit", "a1", rrn="r1", amount_inr=60.0), at("too-much", 41.0, "refund_credit", "a1", rrn="r1", amount_inr=60.0),
        at("off-by-three", 42.0, "presentment", "a3", rrn="r3", settlement_amount_inr=300.0), {"event_id": "twin", "ts": 50.0}, {"event_id": "twin", "ts": 51.0}]
    chip = {**CHIP, "pan_canonical": "p"}
    rows += [{"event_id": "c1", "ts": 60.0, **chip}, {"event_id": "c2", "ts": 61.0, **chip, "emv_cryptogram_atc": 5}, {"event_id": "c3", "ts": 62.0, **chip, "emv_cryptogram_atc": 5}]
    flow = {"beneficiary_id": "b", "original_auth_event_id": "a1"}
    rows += [{"event_id": "in", "ts": 70.0, "message_kind": "inbound_credit", "amount_inr": 10.0, **flow}, {"event_id": "out-ok", "ts": 71.0, "message_kind": "onward_send", "amount_inr": 10.0, **flow},
             {"event_id": "out", "ts": 72.0, "message_kind": "onward_send", "amount_inr": 1.0, **flow}]
    return rows


def test_every_stream_rule_fires(spark):
    found = {(r["invariant_id"], r["event_id"]) for r in R.check_stream_rules(frame(spark, stream_rows())).collect()}
    want = {("F1-PAIR-01", "lost"), ("F1-PAIR-06", "early"), ("F1-PAIR-02", "other-rrn"), ("F1-PAIR-03", "declined"), ("F1-PAIR-04", "never-presented"), ("F1-PAIR-05", "twin"),
            ("F1-AMT-01", "too-much"), ("F1-AMT-02", "off-by-three"), ("F1-ATC-01", "c3"), ("F1-BEN-08", "out")}
    assert want <= found
    assert {i for i, _ in want} == set(R.STREAM_RULES)
    assert not {e for _, e in found} & {"a1", "a2", "a3", "ok-p", "ok-c", "ok-r", "c1", "c2", "in", "out-ok"}


GUARD_CASES = {
    "G0_CRYPTOGRAM_ON_KEYED": (on("card-cnp-keyed", emv_cryptogram_present=True, emv_cryptogram_verified=True), on("card-cp-emv", emv_cryptogram_present=True, emv_cryptogram_verified=True)),
    "G0_THREEDS_ON_NON_CNP": (on("upi-pay", threeds_authentication_result="frictionless_success"), on("card-clearing-dispute", threeds_authentication_result="frictionless_success")),
    "G0_MIT_WITHOUT_ORIGINAL": ({"cit_mit_indicator": "MIT"}, {"cit_mit_indicator": "MIT", "mandate_id": "m"}),
    "G0_MANDATE_SCOPE_VIOLATION": ({"mandate_max_amount_inr": 99.0}, {"mandate_max_amount_inr": 100.0}),
    "G0_CRYPTOGRAM_UNVERIFIED": (on("card-cp-emv", emv_cryptogram_present=True, emv_cryptogram_verified=False), on("card-cp-emv", emv_cryptogram_present=True, emv_cryptogram_verified=True)),
    "G0_REFUND_NO_ORIGINAL": ({"message_kind": "refund_credit"}, {"message_kind": "refund_credit", "rrn": "r"}),
    "G0_REFUND_EXCEEDS_ORIGINAL": ({"message_kind": "refund_credit", "rrn": "r", "refund_amount_inr": 101.0}, {"message_kind": "refund_credit", "rrn": "r", "refund_amount_inr": 100.0}),
    "G0_AGENT_OVER_MANDATE": ({"message_kind": "agent_authorisation", "agent_quoted_amount_inr": 99.0}, {"message_kind": "agent_authorisation", "agent_quoted_amount_inr": 99.95}),
}


def test_every_guard_fires_and_rests(spark):
    rows = [{"event_id": f"{w}:{k}", **r} for k, pair in GUARD_CASES.items() for w, r in zip(("bad", "ok"), pair)]
    rows += [{"event_id": f"ask{i:02d}", "ts": 7200.0 + i, "message_kind": "collect_request", "payee_vpa": "shop", "cardholder_id": f"h{i}"} for i in range(25)]
    rows += [{"event_id": f"atc{i}", "ts": 9000.0 + i, "rail": "card-cp-emv", "emv_cryptogram_present": True, "emv_cryptogram_verified": True, "pan_canonical": "p", "emv_cryptogram_atc": a} for i, a in enumerate((7, 8, 8))]
    got = {r["event_id"]: r for r in R.structural_guards(frame(spark, rows)).collect()}
    for k in GUARD_CASES:
        assert k in got[f"bad:{k}"]["reason_codes"] and got[f"bad:{k}"]["refuse"], k
        assert k not in got[f"ok:{k}"]["reason_codes"], k
    assert got["bad:G0_AGENT_OVER_MANDATE"]["action_override"] == "mandate_refuse"
    assert got["ask24"]["reason_codes"] == ["G0_COLLECT_FANOUT"] and not got["ask24"]["refuse"] and got["ask24"]["action_override"] == "collect_suppress"
    assert got["ask23"]["reason_codes"] == []
    assert got["atc2"]["reason_codes"] == ["G0_ATC_REGRESSION"] and got["atc1"]["reason_codes"] == []


INCUMBENT_CASES = {
    "INC-01": ({"amount_inr": 50_000.5}, {"amount_inr": 50_000.0}), "INC-02": ({"cvv2_result": "no_match"}, {"cvv2_result": "match"}), "INC-03": ({"avs_result": "no_match"}, {"avs_result": "not_requested"}),
    "INC-04": ({"pos_entry_mode": "magstripe_fallback"}, {"pos_entry_mode": "chip"}), "INC-05": ({"pos_entry_mode": "contactless_no_cvm", "amount_inr": 3001.0}, {"pos_entry_mode": "contactless_no_cvm", "amount_inr": 3000.0}),
    "INC-06": ({"payee_vpa_age_days": 1.5}, {"payee_vpa_age_days": -1.0}), "INC-07": ({"device_age_days": 0.0}, {"device_age_days": 1.0}), "INC-08": ({"acceptor_country": "AE"}, {"acceptor_country": "IN"}),
    "INC-10": ({"mcc": "6540"}, {"mcc": "5411"}), "INC-11": ({"mandate_max_amount_inr": 99.0}, {"mandate_max_amount_inr": -1.0}), "INC-12": ({"hour_ist": 4.9}, {"hour_ist": 5.0}),
    "INC-13": ({"emv_cryptogram_present": True, "emv_cryptogram_verified": False}, {"emv_cryptogram_present": True, "emv_cryptogram_verified": True}),
    "INC-14": ({"message_kind": "refund_credit", "original_auth_event_id": ""}, {"message_kind": "refund_credit", "original_auth_event_id": "o"}),
}
WEIGHTS = {"INC-01": 0.34, "INC-02": 0.30, "INC-03": 0.22, "INC-04": 0.26, "INC-05": 0.20, "INC-06": 0.28, "INC-07": 0.24, "INC-08": 0.18, "INC-09": 0.32, "INC-10": 0.16, "INC-11": 0.36,
           "INC-12": 0.14, "INC-13": 0.20, "INC-14": 0.30}


def test_every_incumbent_rule_fires_and_rests(spark):
    rows = [{"event_id": f"{w}:{k}", "cardholder_id": f"{w}{k}", **r} for k, pair in INCUMBENT_CASES.items() for w, r in zip(("bad", "ok"), pair)]
    rows += [{"event_id": f"n{i:02d}", "ts": 100.0 + i, "cardholder_id": "busy"} for i in range(13)]
    got = {r["event_id"]: r for r in R.incumbent_scorecard(frame(spark, rows)).collect()}
    for k in INCUMBENT_CASES:
        fired = got[f"bad:{k}"]["rules_fired"].split(",")
        assert k in fired and got[f"bad:{k}"]["score"] == pytest.approx(sum(WEIGHTS[f] for f in fired)), k
        assert k not in got[f"ok:{k}"]["rules_fired"].split(","), k
    assert got["n12"]["rules_fired"] == "INC-09" and got["n11"]["rules_fired"] == ""


TEXTS = {
    "DU-01": ("how to bypass the 3DS flow", "the 3DS flow was bypassed"), "DU-02": ("Step 1 open it", "a step forward"), "DU-03": ("x\nimport os", "we import goods"), "DU-04": ("pay 4111111111111111 now", "pay 999111111111111 now"),
    "DU-05": ("call 9876543210", "call 1234567890"), "DU-06": ("HDFC0ABC123", "HDFC1ABC123"), "DU-07": ("a brute-forcing script", "brute strength"), "DU-08": ("paytm has a known flaw", "paytm is an app"),
    "DU-09": ("Dear Customer, hello", "my customer"), "DU-10": ("a voice-cloning tutorial", "a voice lesson"), "DU-11": ("cvv: 123", "cvv is short"), "DU-12": ("Aadhaar no. 1234 5678 9012", "Aadhaar card"),
}


def test_every_text_rule_fires_and_rests(spark):
    rows = [(f"{w}:{k}", t, None) for k, pair in TEXTS.items() for w, t in zip(("bad", "ok"), pair)]
    got = {(r["id"], r["rule_id"]) for r in R.scan_text(spark.createDataFrame(rows, "id string, text string, other string"), "id", ["text", "other"]).collect()}
    assert all((f"bad:{k}", k) in got and (f"ok:{k}", k) not in got for k in TEXTS)


def test_js_merge_follows_long_chains(spark):
    """300 elites whose attribution drifts step by step: components as a union-find gives them."""
    import math

    from tidemark.operators.composition import js_merge

    shares = [0.5 + 0.4 * math.sin(i / 40) * (1 + 0.03 * (i % 25 == 0)) for i in range(300)]
    rows = [(f"c{i:03d}", {"a": s, "b": 1 - s}) for i, s in enumerate(shares)]

    def js(p, q):
        kl = lambda x, m: x * math.log2(x / m)
        return sum(kl(x, (x + y) / 2) + kl(y, (x + y) / 2) for x, y in ((p, q), (1 - p, 1 - q))) / 2

    root = list(range(300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(300):
        for j in range(i):
            if js(shares[i], shares[j]) < 1e-6:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["cell_id"]: r["component"] for r in js_merge(spark.createDataFrame(rows, "cell_id string, attribution map<string,double>"), "cell_id", "attribution", 1e-6).collect()}
    assert got == {f"c{i:03d}": f"c{find(i):03d}" for i in range(300)}
    assert 1 < len(set(got.values())) < 200
    one_empty = js_merge(spark.createDataFrame([("x", {"a": 1.0}), ("y", {"b": 1.0}), ("z", {})], "cell_id string, attribution map<string,double>"), "cell_id", "attribution")
    assert {r["component"] for r in one_empty.collect()} == {"x"}


def test_exchange_probe_reads_single_bits(spark):
    from tidemark.operators import beneficiary as B

    ids = spark.createDataFrame([(f"b{i}",) for i in range(200)], "beneficiary_id string")
    exchange = B.build_exchange(ids.filter(F.substring("beneficiary_id", 2, 9).cast("int") < 100), "beneficiary_id")
    bits = {r["bit"] for r in exchange.collect()}
    asked = ids.withColumn("all", B.positions(F.col("beneficiary_id")))
    got = B.exchange_prior(asked, exchange, "beneficiary_id").collect()
    assert all((r["exchange_prior"] > 0) == set(r["all"]).issubset(bits) for r in got)
    assert sum(r["exchange_prior"] > 0 for r in got) >= 100
    assert B.exchange_prior(ids, exchange.limit(0), "beneficiary_id").filter("exchange_prior > 0").count() == 0
