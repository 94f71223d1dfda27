"""Invariants, guards, the incumbent scorecard and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import rules as R
from tidemark.queries.registry import query, rounded, table
from tidemark.queries.standin import COLUMNS, payments, payments_sql
from tidemark.schema import DEFAULTS

# The SQL twin sees the same columns; those the stand-in leaves out carry their schema default.
_rest = {n: d for n, d in DEFAULTS.items() if n not in COLUMNS}
_defaults = ", ".join(f"{repr(d) if isinstance(d, str) else str(d).upper()} AS {n}" for n, d in _rest.items())
FULL = payments_sql(*COLUMNS).replace("pay AS (SELECT e,", f"pay AS (SELECT {_defaults}, e,", 1)
# Two events share an id so that the uniqueness rule has something to find.
DOUBLED = FULL.replace("pay AS (", "one AS (", 1) + """, pay AS (SELECT * REPLACE (CASE WHEN e % 501 = 0 THEN 'e' || (e + 1) ELSE event_id END AS event_id) FROM one)"""


def doubled(spark, sf):
    e = F.substring("event_id", 2, 20).cast("long")
    return payments(spark, sf).withColumn("event_id", F.when(e % 501 == 0, F.concat(F.lit("e"), (e + 1).cast("string"))).otherwise(F.col("event_id")))


EVENT_RULES_SQL = f"WITH {FULL} " + " UNION ALL ".join(
    f"SELECT '{r.id}' AS invariant_id, event_id, rail, message_kind FROM pay WHERE {r.broken()}" for r in R.event_rules())


@query("invariants_per_event", EVENT_RULES_SQL)
def _event_rules(spark, sf):
    return R.check_event_rules(payments(spark, sf))


_ANTE = ", ".join(f"'{k}'" for k in R.ANTECEDENT_KINDS)
_DER = ", ".join(f"'{k}'" for k in R.DERIVED_KINDS)
STREAM_RULES_SQL = f"""WITH {DOUBLED}, s AS (SELECT *, row_number() OVER (ORDER BY ts, event_id, rail, message_kind) AS pos FROM pay),
    ante AS (SELECT * FROM s WHERE message_kind IN ({_ANTE})),
    d AS (SELECT *, (SELECT min((a.ts, a.event_id)) FROM ante a WHERE a.event_id = s.original_auth_event_id) < (s.ts, s.event_id) AS has_ante,
      EXISTS (SELECT 1 FROM ante a WHERE a.rrn <> '' AND a.rrn = s.rrn AND (a.ts, a.event_id) < (s.ts, s.event_id)) AS by_rrn,
      EXISTS (SELECT 1 FROM pay a WHERE a.event_id = s.original_auth_event_id) AS present FROM s WHERE message_kind IN ({_DER})),
    f AS (SELECT event_id, arg_min(struct_pack(rrn := rrn, amount := amount_inr, ok := approved), (ts, event_id)) AS a FROM ante GROUP BY event_id),
    p AS (SELECT d.*, CASE WHEN has_ante THEN f.a END AS a, coalesce(has_ante, FALSE) OR by_rrn AS found,
      EXISTS (SELECT 1 FROM s q WHERE q.message_kind = 'presentment' AND q.original_auth_event_id = d.original_auth_event_id AND (q.ts, q.event_id) < (d.ts, d.event_id)) AS shown,
      (SELECT sum(q.amount_inr) FROM s q WHERE q.message_kind = 'refund_credit' AND q.original_auth_event_id = d.original_auth_event_id AND (q.ts, q.event_id) <= (d.ts, d.event_id)) AS refunded
      FROM d LEFT JOIN f ON d.original_auth_event_id = f.event_id),
    c AS (SELECT *, max(emv_cryptogram_atc) OVER (PARTITION BY pan_canonical ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
      FROM s WHERE NOT oracle_is_attack AND emv_cryptogram_present AND emv_cryptogram_atc >= 0),
    b AS (SELECT *, sum(CASE message_kind WHEN 'onward_send' THEN amount_inr ELSE -amount_inr END) OVER (PARTITION BY beneficiary_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS net
      FROM s WHERE message_kind IN ('inbound_credit', 'onward_send') AND beneficiary_id <> ''),
    v AS (SELECT 'F1-PAIR-01' AS invariant_id, event_id, rail, message_kind FROM p WHERE NOT oracle_is_attack AND NOT found AND NOT present
    UNION ALL SELECT 'F1-PAIR-06', event_id, rail, message_kind FROM p WHERE NOT oracle_is_attack AND NOT found AND present
    UNION ALL SELECT 'F1-PAIR-02', event_id, rail, message_kind FROM p WHERE NOT oracle_is_attack AND rrn <> '' AND a.rrn <> '' AND rrn <> a.rrn
    UNION ALL SELECT 'F1-PAIR-03', event_id, rail, message_kind FROM p WHERE message_kind = 'presentment' AND NOT a.ok
    UNION ALL SELECT 'F1-PAIR-04', event_id, rail, message_kind FROM p WHERE message_kind = 'chargeback' AND original_auth_event_id <> '' AND NOT shown
    UNION ALL SELECT 'F1-AMT-01', event_id, rail, message_kind FROM p WHERE NOT oracle_is_attack AND message_kind = 'refund_credit' AND original_auth_event_id <> '' AND refunded > a.amount + 1e-6
    UNION ALL SELECT 'F1-AMT-02', event_id, rail, message_kind FROM p WHERE message_kind = 'presentment' AND a.amount > 0 AND settlement_amount_inr >= 0 AND NOT (settlement_amount_inr / a.amount BETWEEN 0.5 AND 2)
    UNION ALL SELECT 'F1-ATC-01', event_id, rail, message_kind FROM c WHERE emv_cryptogram_atc <= top
    UNION ALL SELECT 'F1-BEN-08', event_id, rail, message_kind FROM b WHERE message_kind = 'onward_send' AND net > 1e-6
    UNION ALL SELECT 'F1-PAIR-05', event_id, rail, message_kind FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, rail DESC, message_kind DESC) AS r, count(*) OVER (PARTITION BY event_id) AS n FROM pay) WHERE n > 1 AND r = 1)
    """


@query("invariants_stream", STREAM_RULES_SQL.replace(DOUBLED, FULL, 1) + " SELECT invariant_id, event_id, rail, message_kind FROM v WHERE invariant_id <> 'F1-PAIR-05'")
def _stream_rules(spark, sf):
    return R.check_stream_rules(payments(spark, sf)).filter("invariant_id <> 'F1-PAIR-05'")


@query("invariants_unique_ids", STREAM_RULES_SQL + " SELECT invariant_id, event_id, rail, message_kind FROM v WHERE invariant_id = 'F1-PAIR-05'")
def _unique(spark, sf):
    return R.check_stream_rules(doubled(spark, sf)).filter("invariant_id = 'F1-PAIR-05'")


@query("invariant_report", EVENT_RULES_SQL.replace(f"WITH {FULL} ", f"WITH {FULL}, v AS (", 1) + """),
    r AS (SELECT *, row_number() OVER (PARTITION BY invariant_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY invariant_id) AS n FROM v)
    SELECT invariant_id, max(n) AS n_violations, string_agg(event_id, ',' ORDER BY event_id) AS samples FROM r WHERE r <= 6 GROUP BY invariant_id""")
def _report(spark, sf):
    return R.violation_report(R.check_event_rules(payments(spark, sf)))


_hits = ", ".join(f"CASE WHEN {g.hit.format(fanout=2)} THEN '{g.code}' END" for g in R.GUARDS)
_hard = " OR ".join(f"coalesce({g.hit.format(fanout=2)}, FALSE)" for g in R.GUARDS if not g.advisory)
_over = "CASE " + " ".join(f"WHEN {g.hit.format(fanout=2)} THEN '{g.override}'" for g in R.GUARDS if g.override) + " END"
_first = "CASE " + " ".join(f"WHEN {g.hit.format(fanout=2)} THEN '{g.id}'" for g in R.GUARDS) + " END"


@query("structural_guards", f"""WITH {FULL}, fan AS (SELECT a.event_id, count(DISTINCT b.cardholder_id) AS collect_fanout FROM pay a JOIN pay b
      ON a.message_kind = 'collect_request' AND b.message_kind = 'collect_request' AND a.payee_vpa = b.payee_vpa AND a.payee_vpa <> ''
      AND a.ts_us // 3600000000 = b.ts_us // 3600000000 AND (b.ts_us, b.event_id) <= (a.ts_us, a.event_id) GROUP BY a.event_id),
    ctr AS (SELECT event_id, coalesce(emv_cryptogram_atc <= max(emv_cryptogram_atc) OVER (PARTITION BY pan_canonical ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS r
      FROM pay WHERE emv_cryptogram_present AND emv_cryptogram_atc >= 0 AND pan_canonical <> ''),
    x AS (SELECT pay.*, coalesce(collect_fanout, -1) AS collect_fanout, coalesce(r, FALSE) AS atc_regressed FROM pay LEFT JOIN fan USING (event_id) LEFT JOIN ctr USING (event_id))
    SELECT event_id, array_to_string(list_filter([{_hits}], lambda g: g IS NOT NULL), ',') AS reason_codes, {_hard} AS refuse, {_over} AS action_override, {_first} AS guard_rule FROM x""")
def _guards(spark, sf):
    out = R.structural_guards(payments(spark, sf), fanout_threshold=2)
    return out.withColumn("reason_codes", F.concat_ws(",", "reason_codes"))


_score = " + ".join(f"CASE WHEN {cond} THEN {w} ELSE 0 END" for _, w, cond in R.INCUMBENT_RULES)
_fired = ", ".join(f"CASE WHEN {cond} THEN '{i}' END" for i, _, cond in R.INCUMBENT_RULES)
_ceil = "CASE rail " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in R.INCUMBENT_CEILING.items()) + " ELSE 50000 END"


@query("incumbent_scorecard", f"""WITH {FULL}, x AS (SELECT *, {_ceil} AS ceiling, row_number() OVER (PARTITION BY coalesce(nullif(pan_canonical, ''), nullif(vpa, ''), cardholder_id), day_index
      ORDER BY ts_us, event_id) AS nth_today FROM pay), y AS (SELECT event_id, CAST({_score} AS DOUBLE) AS s, array_to_string(list_filter([{_fired}], lambda g: g IS NOT NULL), ',') AS rules_fired FROM x)
    SELECT event_id, round(s, 6) AS score, rules_fired, round(1 - (0.05 + 0.9 / (1 + exp(-(s - 0.62) / 0.12))), 6) AS accept_probability FROM y""")
def _incumbent(spark, sf):
    return rounded(R.incumbent_scorecard(payments(spark, sf)))


def _text_sql(src: str, key: str, rules) -> str:
    return f"""SELECT {key}, rule_id, left(m, 80) AS matched_text FROM (""" + " UNION ALL ".join(
        f"SELECT {key}, '{i}' AS rule_id, regexp_extract(text, '{p.replace(chr(39), chr(39) * 2)}', 0, 'i') AS m FROM {src}" for i, p, _ in rules) + ") WHERE m <> ''"


@query("text_rule_scan", _text_sql("documents", "doc_id", R.TEXT_RULES))
def _text(spark, sf):
    return R.scan_text(table(spark, sf, "documents"), "doc_id", ["text"]).select("doc_id", "rule_id", "matched_text")


_TURNS = "(SELECT conv_id || ':' || turn AS turn_id, text FROM conversations)"


@query("text_rule_scan_conversations", _text_sql(_TURNS, "turn_id", R.TEXT_RULES))
def _text_turns(spark, sf):
    """The same rules over every turn of every conversation."""
    turns = table(spark, sf, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"), "text")
    return R.scan_text(turns, "turn_id", ["text"]).select("turn_id", "rule_id", "matched_text")


@query("text_rule_summary", f"SELECT rule_id, count(*) AS n_hits FROM ({_text_sql('documents', 'doc_id', R.TEXT_RULES)}) GROUP BY rule_id")
def _text_summary(spark, sf):
    return R.text_rule_summary(R.scan_text(table(spark, sf, "documents"), "doc_id", ["text"]))
