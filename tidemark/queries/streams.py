"""Streaming forms run over the events replayed in order, micro-batch by micro-batch; the SQL covers what a closed stream must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.queries.registry import epoch_us, query, rounded, table
from tidemark.queries.standin import COLUMNS, payments, payments_sql
from tidemark.schema import complete
from tidemark.sources.replay import ROWS_PER_BATCH, prepare, prepared_rows, replay
from tidemark.queries.labels import _RANK, LABELS_SQL, labels
from tidemark.streaming import keyed as K
from tidemark.streaming import label_store as S
from tidemark.streaming import twins as W

c = F.col


END_ID, END_US = 9_000_000_000_000_000, 4_102_444_800_000_000
BATCHES = 11


def replayed_together(spark, *tables):
    """Tables (rows, order) as ordered streams of as many micro-batches, eleven or more, none of over ``ROWS_PER_BATCH`` rows a core."""
    folders = [prepare(rows, W.scratch(spark), order) for rows, order in tables]
    counts = [prepared_rows(spark, f) for f in folders]
    batches = max(BATCHES, -(-max(counts) // (ROWS_PER_BATCH * spark.sparkContext.defaultParallelism)))
    return [replay(spark, f, rows.schema, max(1, n // batches), order) for f, n, (rows, order) in zip(folders, counts, tables, strict=True)]


def replayed(spark, rows, order):
    """The rows as an ordered stream of eleven or more micro-batches; more where a batch would be too large."""
    return replayed_together(spark, (rows, order))[0]


def with_end(rows, end):
    """The rows and some of a far future, which move the watermark past all windows of the data."""
    return rows.unionByName(end.select(*[c(f.name).cast(f.dataType) for f in rows.schema]))


def payment_stream(spark, sf, ended=False):
    base = table(spark, sf, "events").select(c("event_id").alias("e"), epoch_us("ts").alias("us"), c("user_id").alias("u"), c("value").alias("v"),
                                             F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    if ended:
        base = with_end(base, spark.range(300).selectExpr(f"{END_ID} + id AS e", f"{END_US} AS us", "0 AS u", "0 AS v", "id % 10 AS k"))
    return complete(replayed(spark, base, ["us", "e"]).selectExpr(*[f"{x} AS {n}" for n, x in COLUMNS.items()]))


_KEYS = " UNION ALL ".join(f"SELECT event_id, '{k}' AS key_type, {k} AS key, ts, ts_us, amount_inr, message_kind FROM pay WHERE {k} <> ''" for k in W.COUNTERPARTY)
_FLOW = lambda kind: f"round(coalesce(sum(amount_inr) FILTER (message_kind = '{kind}'), 0), 3) + 0e0"
COUNTERS_SQL = f"""WITH {payments_sql(*W.COUNTERPARTY, "amount_inr", "message_kind")}, kk AS ({_KEYS}), h AS (SELECT *, ts_us // 3600000000 AS h FROM kk),
    w AS (SELECT key_type, key, amount_inr, message_kind, unnest([h // 12, h // 12 - 1]) AS s FROM h)
    SELECT key_type, key, s * 12 AS start_hour, count(*) AS n, round(sum(amount_inr), 3) AS amount, {_FLOW("inbound_credit")} AS inflow, {_FLOW("onward_send")} AS outflow FROM w GROUP BY 1, 2, 3"""


def hour_of(name):
    return F.floor(F.unix_micros(name) / 3_600_000_000).cast("long")


def counters(out):
    """Exact columns of the counters; distinct counterparties are an estimate."""
    return rounded(out.select("key_type", "key", hour_of("w_start").alias("start_hour"), "n", "amount", "inflow", "outflow"), 3)


@query("stream_window_counters", COUNTERS_SQL)
def _counters(spark, sf):
    """Sliding day counters of all nine keys, each emitted when the watermark closes it; the end closes the last."""
    return counters(K.run_batches(W.window_counters(W.observed(payment_stream(spark, sf, ended=True)), "24 hours", "12 hours"), W.scratch(spark)))


@query("stream_collect_fanout", f"""WITH {payments_sql("message_kind", "payee_vpa", "cardholder_id")} SELECT ts_us // 3600000000 AS start_hour, payee_vpa, count(DISTINCT cardholder_id) AS n_payers
    FROM pay WHERE message_kind = 'collect_request' AND payee_vpa <> '' GROUP BY 1, 2""")
def _fanout(spark, sf):
    out = K.run_batches(W.collect_fanout(payment_stream(spark, sf, ended=True), threshold=1), W.scratch(spark))
    return out.select(hour_of("w_start").alias("start_hour"), "payee_vpa", "n_payers")


@query("stream_counter_regression", f"""WITH {payments_sql("pan_canonical", "emv_cryptogram_present", "emv_cryptogram_atc")}
    SELECT event_id, pan_canonical, emv_cryptogram_atc, coalesce(emv_cryptogram_atc <= max(emv_cryptogram_atc) OVER (PARTITION BY pan_canonical ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS regressed
    FROM pay WHERE emv_cryptogram_present AND emv_cryptogram_atc >= 0 AND pan_canonical <> ''""")
def _regression(spark, sf):
    return K.run_batches(K.counter_regressions(payment_stream(spark, sf)), W.scratch(spark))


_TRAIL = ", ".join(f"""CAST(count(*) OVER (PARTITION BY key_type, key ORDER BY ts_us RANGE BETWEEN {int(s * 1e6)} PRECEDING AND CURRENT ROW) - peers AS DOUBLE) AS n_{w},
    round(sum(amount_inr) OVER (PARTITION BY key_type, key ORDER BY ts_us RANGE BETWEEN {int(s * 1e6)} PRECEDING AND CURRENT ROW) - peer_amount, 3) + 0e0 AS amount_{w}""" for w, s in W.WINDOW_S.items())


@query("stream_entity_state", f"""WITH {payments_sql(*W.COUNTERPARTY, "amount_inr", "message_kind")}, k AS ({_KEYS}),
    p AS (SELECT *, count(*) OVER e AS peers, sum(amount_inr) OVER e AS peer_amount FROM k WINDOW e AS (PARTITION BY key_type, key, ts_us ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, key_type, key, {_TRAIL}, round((ts - min(ts) OVER (PARTITION BY key_type, key)) / 86400, 6) AS age_days FROM p""")
def _state(spark, sf):
    """All nine key types, all windows; event times are whole hours, so buckets of a minute are exact."""
    out = K.run_batches(K.entity_state(payment_stream(spark, sf)), W.scratch(spark))
    fields = [f"{x}_{w}" for w in W.WINDOW_S for x in ("n", "amount")]
    return rounded(out.select("event_id", "key_type", "key", *fields, "age_days"), 6, **{f"amount_{w}": 3 for w in W.WINDOW_S})


_OBSERVED = " UNION ALL ".join(f"SELECT event_id, '{k}' AS key_type, {k} AS key, {cp} AS cp, ts, ts_us, amount_inr, message_kind FROM pay WHERE {k} <> ''" for k, cp in W.COUNTERPARTY.items())
_BEFORE = "OVER (PARTITION BY key_type, key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
# The state before each event: windows, the sketch from what raises a register, ages and flows.
_STATE = f"""{payments_sql(*W.COUNTERPARTY, *W.COUNTERPARTY.values(), "amount_inr", "message_kind")}, k AS ({_OBSERVED}),
    o AS (SELECT *, row_number() OVER (PARTITION BY key_type, key ORDER BY ts_us, event_id) AS i,
        count(*) OVER e AS peers, sum(amount_inr) OVER e AS peer_amount,
        CASE WHEN cp <> '' THEN ('0x' || substr(md5(cp), 1, 2))::BIGINT % 64 ELSE -1 END AS reg, ('0x' || substr(md5(cp), 3, 13))::BIGINT AS bits
        FROM k WINDOW e AS (PARTITION BY key_type, key, ts_us ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    m AS (SELECT *, CASE WHEN bits = 0 THEN 53 ELSE 53 - length(bin(bits)) END AS rho FROM o),
    g AS (SELECT *, coalesce(max(rho) OVER (PARTITION BY key_type, key, reg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM m),
    z AS (SELECT *, coalesce(sum(CASE WHEN reg >= 0 AND rho > held THEN power(2.0, -rho) - power(2.0, -held) ELSE 0 END) {_BEFORE}, 0) + 64 AS z,
        64 - coalesce(sum(CASE WHEN reg >= 0 AND rho > held AND held = 0 THEN 1 ELSE 0 END) {_BEFORE}, 0) AS empty FROM g),
    st AS (SELECT event_id, key_type, i - 1 AS seen, {_TRAIL},
        CASE WHEN 0.709 * 4096 / z <= 160 AND empty > 0 THEN 64 * ln(64e0 / empty) ELSE 0.709 * 4096 / z END AS "distinct",
        (ts - min(ts) OVER (PARTITION BY key_type, key)) / 86400 AS age_days,
        coalesce(sum(CASE WHEN message_kind = 'inbound_credit' THEN amount_inr ELSE 0 END) {_BEFORE}, 0) AS inflow,
        coalesce(sum(CASE WHEN message_kind = 'onward_send' THEN amount_inr ELSE 0 END) {_BEFORE}, 0) AS outflow FROM z)"""
_PICK = lambda k, x, places: f"round(coalesce(max({x}) FILTER (key_type = '{k}' AND seen > 0), -1), {places}) + 0e0"
_FLAT = ", ".join(", ".join([*[f"{_PICK(k, f'n_{w}', 6)} AS sk_{k}_{w}_count, {_PICK(k, f'amount_{w}', 3)} AS sk_{k}_{w}_sum" for w in W.WINDOW_S],
                             f"""{_PICK(k, '"distinct"', 6)} AS sk_{k}_distinct, {_PICK(k, "age_days", 6)} AS sk_{k}_age_days"""]) for k in W.COUNTERPARTY)
_FLOWS = [f"coalesce(max({x}) FILTER (key_type = 'beneficiary_id' AND seen > 0), -1)" for x in ("inflow", "outflow")]
_ROW = f"""{_STATE}, fl AS (SELECT event_id, {_FLAT}, {_FLOWS[0]} AS i, {_FLOWS[1]} AS o FROM st GROUP BY event_id),
    rw AS (SELECT * EXCLUDE (i, o), round(i, 3) + 0e0 AS sk_ben_inflow, round(o, 3) + 0e0 AS sk_ben_outflow, round(CASE WHEN i > 0 THEN abs(i - o) / i ELSE -1 END, 6) + 0e0 AS sk_ben_in_out_skew FROM fl)"""


def entity_rows(spark, sf):
    return K.flat_row(K.run_batches(K.entity_state(payment_stream(spark, sf)), W.scratch(spark)))


@query("stream_entity_row", f"WITH {_ROW} SELECT * FROM rw")
def _entity_row(spark, sf):
    """One flat row per event over its nine entity keys: counts and sums of four windows, distinct sketch, age, flows."""
    sums = {f"sk_{k}_{w}_sum": 3 for k in W.COUNTERPARTY for w in W.WINDOW_S}
    return rounded(entity_rows(spark, sf), 6, **sums, sk_ben_inflow=3, sk_ben_outflow=3)


_TERM = lambda col, value: f"CASE WHEN {col} >= 0 THEN least(greatest({value}, 0), 1) END"
_TERMS = [_TERM("sk_beneficiary_id_distinct", "sk_beneficiary_id_distinct / 40"), _TERM("sk_ben_in_out_skew", "1 - sk_ben_in_out_skew / 0.15"),
          _TERM("sk_token_requestor_id_distinct", "sk_token_requestor_id_distinct / 12"), _TERM("sk_device_fingerprint_id_distinct", "sk_device_fingerprint_id_distinct / 6"),
          _TERM("sk_terminal_id_1h_count", "sk_terminal_id_1h_count / 30")]


@query("stream_sketch_risk", f"WITH {_ROW} SELECT event_id, round(coalesce(list_avg([{', '.join(_TERMS)}]), 0), 4) + 0e0 AS sketch_risk FROM rw")
def _sketch_risk(spark, sf):
    return rounded(K.risk(_entity_row(spark, sf)), 4)  # of the rounded row, as in the SQL


@query("stream_live_fanout", f"""WITH {payments_sql("message_kind", "payee_vpa", "cardholder_id")},
    f AS (SELECT event_id, payee_vpa, ts_us, ts_us // 3600000000 AS h, row_number() OVER (PARTITION BY payee_vpa, ts_us // 3600000000, cardholder_id ORDER BY ts_us, event_id) = 1 AS fresh
        FROM pay WHERE message_kind = 'collect_request' AND payee_vpa <> ''),
    n AS (SELECT event_id, payee_vpa, (count(*) FILTER (fresh) OVER (PARTITION BY payee_vpa, h ORDER BY ts_us, event_id))::BIGINT AS collect_fanout FROM f)
    SELECT event_id, payee_vpa, collect_fanout, collect_fanout >= 2 AS reached FROM n""")
def _live_fanout(spark, sf):
    """Each collect request with its payee's distinct payers so far this hour, as it arrives."""
    return K.run_batches(K.live_fanout(payment_stream(spark, sf), threshold=2), W.scratch(spark))


@query("stream_late_labels", "SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN 'analyst' END AS channel FROM orders")
def _late(spark, sf):
    """Orders joined to an analyst label six hours later; unlabelled orders appear once no label can come."""
    orders = table(spark, sf, "orders")
    ts = epoch_us("o_orderdate") / 1e6
    end = lambda i, name: spark.range(1).selectExpr(f"{END_ID} + {i} AS event_id", f"{END_US} / 1e6 AS {name}", "'analyst' AS channel", "0 AS label")
    events = with_end(orders.select(c("o_orderkey").alias("event_id"), ts.alias("ts")), end(0, "ts"))
    labels = with_end(orders.filter("o_orderkey % 3 = 0").select(
        c("o_orderkey").alias("event_id"), (ts + 21_600).alias("as_of_ts"), F.lit("analyst").alias("channel"), (c("o_orderkey") % 2).alias("label")), end(1, "as_of_ts"))
    streams = replayed_together(spark, (events, ["ts", "event_id"]), (labels, ["as_of_ts", "event_id"]))  # the watermark is the slower one's
    out = K.run_batches(W.late_labels(*streams), W.scratch(spark))
    return out.filter(c("event_id") < END_ID).select("event_id", "channel")


@query("stream_label_snapshot", f"""WITH {LABELS_SQL}, won AS (SELECT event_id, arg_max(label, ({_RANK}, as_of_ts)) AS label, arg_max(channel, ({_RANK}, as_of_ts)) AS channel,
    min(label) <> max(label) AS disagree, max(as_of_ts) AS as_of FROM lab GROUP BY event_id) SELECT event_id, CAST(label AS BIGINT) AS label, channel, disagree, as_of FROM won""")
def _snapshot(spark, sf):
    """Labels replayed in order of arrival, merged micro-batch by micro-batch; the last batch is delivered twice."""
    folder, work = W.scratch(spark), W.scratch(spark)
    rows = labels(spark, sf).select("event_id", "channel", "as_of_ts", "label")
    stream = replayed(spark, rows, ["as_of_ts", "event_id", "channel"])
    with K.stream_settings(spark):
        query_ = S.keep_labels(stream, folder, work)
    query_.processAllAvailable()
    query_.stop()
    S.upsert(rows.limit(0), folder, 0)  # a number that is taken changes nothing
    return S.resolved(S.snapshot(spark, folder))


@query("window_counters_batch", COUNTERS_SQL)
def _batch_counters(spark, sf):
    return counters(W.window_counters(W.observed(payments(spark, sf)), "24 hours", "12 hours"))


@query("state_footprint", f"""WITH {payments_sql(*W.COUNTERPARTY)} """ + " UNION ALL ".join(f"SELECT '{k}' AS key_type, count(DISTINCT {k}) AS active_entities FROM pay WHERE {k} <> ''" for k in W.COUNTERPARTY))
def _footprint(spark, sf):
    return W.footprint(W.observed(payments(spark, sf)))
