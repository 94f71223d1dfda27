"""Labels read point in time, splits and leakage audits, on orders with three derived label channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import composition as X
from tidemark.operators import labels as L
from tidemark.plans.cut import written
from tidemark.queries.composition import COMP, SEALED_FAMILY, comps
from tidemark.queries.features import PAY, prepared, stats_for
from tidemark.queries.registry import epoch_us, query, rounded, table
from tidemark.queries.standin import COLUMNS, payments, payments_sql
from tidemark.schema import EVENT_SCHEMA

T = 959_817_600.0  # 2000-06-01, the reading time
_CHANNELS = {
    "analyst": ("o_orderkey % 3 = 0", 21_600, "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END"),
    "issuer_tag": ("o_orderkey % 4 < 2", 432_000, "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END"),
    "chargeback": ("o_orderkey % 5 = 0", 5_184_000, "CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END"),
}
LABELS_SQL = "lab AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS event_id, '{ch}' AS channel, epoch_us(o_orderdate) / 1e6 + {lag} AS as_of_ts, {y} AS label, o_orderkey % 50 = 0 AS poisoned "
    f"FROM orders WHERE {cond}" for ch, (cond, lag, y) in _CHANNELS.items()) + ")"
EV_SQL = "ev AS (SELECT o_orderkey AS event_id, epoch_us(o_orderdate) / 1e6 AS ts, o_custkey AS entity, 'c' || (o_custkey % 30) AS grp FROM orders)"
_RANK = "CASE channel WHEN 'chargeback' THEN 3 WHEN 'issuer_tag' THEN 2 ELSE 1 END"
WON_SQL = f"""{EV_SQL}, {LABELS_SQL}, vis AS (SELECT * FROM lab WHERE as_of_ts <= {T}),
    won AS (SELECT event_id, arg_max(label, ({_RANK}, as_of_ts)) AS label, arg_max(channel, ({_RANK}, as_of_ts)) AS channel,
      min(label) <> max(label) AS disagree, max(as_of_ts) AS as_of, count(*) AS n_records FROM vis GROUP BY event_id),
    res AS (SELECT ev.*, CAST(coalesce(label, -1) AS BIGINT) AS y, coalesce(as_of, -1.0) AS a FROM ev LEFT JOIN won USING (event_id))"""


def labels(spark, sf):
    o = table(spark, sf, "orders").withColumn("ts", epoch_us("o_orderdate") / 1e6)
    parts = [o.filter(cond).select(F.col("o_orderkey").alias("event_id"), F.lit(ch).alias("channel"), (F.col("ts") + lag).alias("as_of_ts"),
                                   F.expr(y).cast("long").alias("label"), (F.col("o_orderkey") % 50 == 0).alias("poisoned"))
             for ch, (cond, lag, y) in _CHANNELS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def events(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), (epoch_us("o_orderdate") / 1e6).alias("ts"), F.col("o_custkey").alias("entity"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 30).cast("string")).alias("grp"))


@query("label_asof_resolve", f"WITH {WON_SQL} SELECT event_id, y, a FROM res")
def _resolve(spark, sf):
    return L.resolve_onto(events(spark, sf), labels(spark, sf), T).select("event_id", "y", "a")


@query("label_winner", f"WITH {WON_SQL} SELECT event_id, CAST(label AS BIGINT) AS label, channel, disagree, n_records FROM won")
def _winner(spark, sf):
    return L.resolve(labels(spark, sf), T).drop("as_of")


@query("label_visible", f"WITH {LABELS_SQL} SELECT event_id, channel, as_of_ts FROM lab WHERE as_of_ts <= {T}")
def _visible(spark, sf):
    return L.visible(labels(spark, sf), T).select("event_id", "channel", "as_of_ts")


@query("label_maturity", f"""WITH {WON_SQL}, f AS (SELECT ev.event_id, {', '.join(f"max(CASE WHEN channel = '{ch}' THEN 1 ELSE 0 END) AS {ch}" for ch in _CHANNELS)},
    max(CASE WHEN channel IS NOT NULL THEN 1 ELSE 0 END) AS seen FROM ev LEFT JOIN vis USING (event_id) GROUP BY ev.event_id)
    SELECT count(*) AS n_events, round(avg(analyst), 9) AS analyst, round(avg(issuer_tag), 9) AS issuer_tag, round(avg(chargeback), 9) AS chargeback,
    round(avg(seen), 9) AS "any" FROM f""")
def _maturity(spark, sf):
    return rounded(L.maturity(events(spark, sf), labels(spark, sf), T).withColumnRenamed("any", "any_"), 9).withColumnRenamed("any_", "any")


@query("label_positives_visible", f"WITH {WON_SQL} SELECT count(*) FILTER (y = 1) AS n_positives FROM res")
def _positives(spark, sf):
    return L.positives_visible(events(spark, sf), labels(spark, sf), T)


@query("label_disagreement", f"WITH {WON_SQL} SELECT count(*) AS n_compared, round(coalesce(avg(CAST(disagree AS INT)), -1), 9) AS disagreement_rate FROM won WHERE n_records >= 2")
def _disagreement(spark, sf):
    return rounded(L.disagreement(events(spark, sf), labels(spark, sf), T), 9)


@query("label_stats", f"""WITH {LABELS_SQL} SELECT channel, count(*) AS n_records, count(DISTINCT event_id) AS n_events,
    count(*) FILTER (label = 1) AS n_positives, count(*) FILTER (poisoned) AS n_poisoned FROM lab GROUP BY channel""")
def _stats(spark, sf):
    return L.label_stats(labels(spark, sf))


@query("maturity_weights", f"""WITH {WON_SQL} SELECT event_id, round(CASE WHEN a > 0 THEN 0.25 + 0.75 * greatest(least(({T} - ts) / 86400 / 120, 1), 0) ELSE 0 END, 6) + 0e0 AS weight FROM res""")
def _weights(spark, sf):
    rows = L.resolve_onto(events(spark, sf), labels(spark, sf), T)
    return rounded(rows.select("event_id", L.maturity_weight(F.col("ts"), F.col("a"), T).alias("weight")))


@query("queue_pressure", """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS queue_depth FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
    SELECT day, queue_depth, round(queue_depth / 2.0, 6) AS pressure, round(CASE WHEN queue_depth / 2.0 <= 1 THEN 0.08 ELSE least(0.45, 0.08 + 0.12 * (queue_depth / 2.0 - 1)) END, 6) AS wrong_rate FROM d""")
def _queue(spark, sf):
    o = table(spark, sf, "orders").filter(F.col("o_orderkey") % 3 == 0).withColumn("day", F.to_date("o_orderdate"))
    return rounded(L.queue_pressure(o, "day", 2.0))


_EDGES = "[0.55, 0.59, 0.69, 0.73, 1.0]"
SPLIT_SQL = f"""b AS (SELECT quantile_cont(ts, {_EDGES}) AS q FROM ev),
    sp AS (SELECT ev.*, CASE WHEN ts <= q[1] THEN 'train' WHEN ts <= q[2] THEN 'purge' WHEN ts <= q[3] THEN 'stats' WHEN ts <= q[4] THEN 'embargo' ELSE 'test' END AS split FROM ev, b)"""


@query("temporal_split", f"WITH {EV_SQL}, {SPLIT_SQL} SELECT event_id, split FROM sp")
def _split(spark, sf):
    return L.temporal_split(events(spark, sf)).select("event_id", "split")


@query("split_report", f"""WITH {EV_SQL}, {SPLIT_SQL} SELECT split, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM ev), 9) AS share,
    min(ts) AS first_ts, max(ts) AS last_ts FROM sp GROUP BY split""")
def _split_report(spark, sf):
    return rounded(L.split_report(L.temporal_split(events(spark, sf))), 9)


@query("maturity_report", f"""WITH {WON_SQL}, {SPLIT_SQL}, j AS (SELECT split, y, a, res.ts FROM res JOIN sp USING (event_id))
    SELECT split, count(*) AS n_rows, round(avg(CASE WHEN a > 0 THEN 1 ELSE 0 END), 9) AS share_visible, count(*) FILTER (a > 0 AND y = 1) AS n_visible_positives,
    count(*) FILTER (a <= 0) AS n_unlabelled, round(avg(CASE WHEN a > 0 THEN 0 ELSE 1 END), 9) AS share_unlabelled,
    round(coalesce(median((a - ts) / 86400) FILTER (a > 0), -1), 9) AS median_days_to_label FROM j GROUP BY split""")
def _maturity_report(spark, sf):
    rows = L.resolve_onto(events(spark, sf), labels(spark, sf), T)
    return rounded(L.maturity_report(L.temporal_split(rows)), 9)


@query("entity_disjoint_folds", f"""WITH {EV_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM ev),
    f AS (SELECT entity, min(pos) AS first_pos FROM p GROUP BY entity), g AS (SELECT unnest([0, 1, 2, 3]) AS fold),
    x AS (SELECT event_id, fold, pos, first_pos, round_even(n * (fold + 1) / 5.0, 0) AS b, greatest(1, floor(n / 5)) AS w FROM p JOIN f USING (entity), g)
    SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN pos < b THEN 'train' ELSE 'validate' END AS role, count(*) AS n_rows, CAST(sum(event_id) AS DOUBLE) AS id_sum
    FROM x WHERE pos < b OR (pos < b + w AND first_pos >= b) GROUP BY 1, 2""")
def _folds(spark, sf):
    ev = events(spark, sf).withColumn("ts_key", F.col("ts"))
    out = L.entity_disjoint_folds(ev, "entity", ["ts_key", "event_id"])
    return out.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").cast("double").alias("id_sum"))


@query("entity_pool", f"""SELECT CASE WHEN CAST('0x' || substr(md5('pool|' || c_custkey), 1, 13) AS BIGINT) / {float(1 << 52)!r} < {L.SEALED_SHARE} THEN 'sealed' ELSE 'train' END AS pool,
    count(*) AS n_entities FROM customer GROUP BY 1""")
def _pool(spark, sf):
    """Customers whose hash falls into the sealed pool, and the others."""
    pool = table(spark, sf, "customer").withColumn("pool", L.entity_pool(F.col("c_custkey").cast("string")))
    return pool.groupBy("pool").agg(F.count(F.lit(1)).alias("n_entities"))


@query("split_gaps", f"WITH {EV_SQL}, b AS (SELECT quantile_cont(ts, {_EDGES}) AS q FROM ev) SELECT round((q[2] - q[1]) / 86400, 9) AS purge_days, round((q[4] - q[3]) / 86400, 9) AS embargo_days FROM b")
def _gaps(spark, sf):
    return rounded(L.split_gaps(L.split_bounds(events(spark, sf))), 9)


HELD_SQL = f"""{payments_sql("entity_pool")}, {COMP}, sm AS (SELECT DISTINCT txt FROM ok WHERE {SEALED_FAMILY} IS NOT NULL),
    hd AS (SELECT event_id, entity_pool = 'sealed' AS pooled, coalesce(ch.txt IN (SELECT txt FROM sm), FALSE) AS member, coalesce(EVASION = '{X.WITHHELD_EVASION}', FALSE) AS withheld FROM pay LEFT JOIN ch ON pay.e = ch.id)"""


def flagged(spark, sf):
    """Payments that carry the composition of the order of their number, flagged against the sealed families among all orders."""
    found = comps(spark, sf)
    told = found.select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_id"), X.to_text().alias("attack_grammar_str"))
    rows = payments(spark, sf).select("event_id", "entity_pool").join(told, "event_id", "left").fillna("", ["attack_grammar_str"])
    manifest = X.sealed_members(found).filter("family IS NOT NULL").select(X.to_text().alias("composition"))
    return L.flag_holdout(rows, manifest, {"EVASION": X.WITHHELD_EVASION})


@query("sealed_flag", f"WITH {HELD_SQL} SELECT event_id, pooled OR member OR withheld AS holdout FROM hd")
def _sealed(spark, sf):
    return flagged(spark, sf).select("event_id", "holdout")


@query("training_partition", f"""WITH {HELD_SQL} SELECT CASE WHEN pooled OR member OR withheld THEN 'withheld' ELSE 'trainable' END AS part, count(*) AS n_rows,
    count(*) FILTER (NOT pooled AND (member OR withheld)) AS n_by_composition FROM hd GROUP BY 1""")
def _partition(spark, sf):
    """What training may see and what it may not; rows withheld for their composition alone."""
    trainable, withheld = L.partition_training(written(flagged(spark, sf).select("event_id", "entity_pool", "holdout")))  # both halves read what was flagged once
    both = trainable.withColumn("part", F.lit("trainable")).unionByName(withheld.withColumn("part", F.lit("withheld")))
    composed = (F.col("entity_pool") != "sealed") & F.col("holdout")
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(composed.cast("long")).alias("n_by_composition"))


@query("label_time_audit", f"""WITH {WON_SQL}, x AS (SELECT *, ts > 8e8 AND a > 9.5e8 + 1e-6 AS late FROM res)
    SELECT count(*) AS n_rows, count(*) FILTER (a > 0) AS n_resolved, count(*) FILTER (a > 9.5e8 + 1e-6) AS n_future_labels,
    count(*) FILTER (a > 0 AND a < ts - 1e-6) AS n_backwards_labels,
    CASE WHEN count(*) FILTER (a > 9.5e8 + 1e-6) + count(*) FILTER (a > 0 AND a < ts - 1e-6) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM x""")
def _time_audit(spark, sf):
    return L.label_time_audit(L.resolve_onto(events(spark, sf), labels(spark, sf), T), 9.5e8)


_AUDIT_KEYS = ("merchant_id", "beneficiary_id", "device_fingerprint_id")
ENTITY_AUDIT_SQL = f"""WITH {payments_sql("day_index", *_AUDIT_KEYS)}, u AS ({' UNION ALL '.join(f"SELECT '{k}' AS key, {k} AS id, day_index FROM pay" for k in _AUDIT_KEYS)}),
    s AS (SELECT key, id FROM u WHERE id <> '' GROUP BY key, id HAVING bool_or(day_index < 10) AND bool_or(day_index >= 25)),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS r, count(*) OVER (PARTITION BY key) AS n FROM s)
    SELECT key, max(n) AS n_shared, string_agg(id, ',' ORDER BY id) AS sample FROM r WHERE r <= 20 GROUP BY key"""


@query("entity_audit", ENTITY_AUDIT_SQL)
def _entity_audit(spark, sf):
    out = L.entity_audit(payments(spark, sf), F.col("day_index") < 10, F.col("day_index") >= 25, _AUDIT_KEYS)
    return out.withColumn("sample", F.concat_ws(",", "sample"))


@query("statistic_fit_audit", f"""WITH {PAY}, b AS (SELECT quantile_cont(ts, {_EDGES}) AS q FROM pay), f AS (SELECT count(*) AS n_fit, max(ts) AS window_end_ts FROM pay WHERE day_index < 20)
    SELECT n_fit, window_end_ts, round(q[1], 6) AS train_end, n_fit <= 0 AS no_rows, window_end_ts > q[1] + 1e-6 AS beyond_train, window_end_ts >= q[4] AS past_embargo,
    CASE WHEN n_fit <= 0 OR window_end_ts > q[1] + 1e-6 OR window_end_ts >= q[4] THEN 'FAIL' ELSE 'PASS' END AS status FROM f, b""")
def _fit_audit(spark, sf):
    prep = prepared(spark, sf)
    return rounded(L.statistic_fit_audit(stats_for(prep).scalars, L.split_bounds(prep)))


_NUMERIC = [f.name for f in EVENT_SCHEMA if f.dataType.simpleString() in ("double", "bigint") and f.name in COLUMNS and f.name not in ("ts", "day_index")]
_SEPARATORS = list(dict.fromkeys([*_NUMERIC, "oracle_value_at_risk_inr"]))  # every numeric column of the events
SEPARATOR_SQL = f"""WITH {payments_sql("oracle_is_attack", *_SEPARATORS)}, u AS ({' UNION ALL '.join(
    f"SELECT '{n}' AS feature, CAST({'CASE WHEN oracle_is_attack THEN 1 ELSE -1 END' if n == 'oracle_value_at_risk_inr' else n} AS DOUBLE) AS v, oracle_is_attack AS atk FROM pay" for n in _SEPARATORS)})
    SELECT feature, count(*) FILTER (v > -1 AND atk) AS n_attack, count(*) FILTER (v > -1 AND NOT atk) AS n_benign,
    count(*) FILTER (v > -1 AND atk) > 0 AND count(*) FILTER (v > -1 AND NOT atk) = 0 AS one_sided FROM u GROUP BY feature"""


@query("one_sided_separators", SEPARATOR_SQL)
def _separators(spark, sf):
    """One column is a planted separator, so the check has something to find."""
    rows = payments(spark, sf).withColumn("oracle_value_at_risk_inr", F.when(F.col("oracle_is_attack"), 1.0).otherwise(-1.0))
    return L.one_sided_separators(rows, _SEPARATORS, "oracle_is_attack")


_ART = _NUMERIC
ARTEFACT_SQL = f"""WITH {payments_sql("oracle_is_attack", *_ART)}, u AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, {n} AS v, CAST(oracle_is_attack AS INT) AS y FROM pay" for n in _ART)}),
    z AS (SELECT feature, sum(y) AS P, sum(1 - y) AS N, sum(CASE WHEN v > -1 THEN y ELSE 0 END) AS ps, sum(CASE WHEN v > -1 THEN 1 - y ELSE 0 END) AS ns FROM u GROUP BY feature),
    s AS (SELECT feature, v, sum(y) AS pos, sum(1 - y) AS neg FROM u WHERE v > -1 GROUP BY feature, v),
    k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (PARTITION BY feature ORDER BY v DESC ROWS UNBOUNDED PRECEDING))
    SELECT feature, round(max(ns) / max(N), 9) AS support_benign, round(max(ps) / max(P), 9) AS support_attack,
      round(coalesce(max(tp / P) FILTER (fp / N <= 0.05), 0), 9) AS recall_alone, round(greatest(max(tp / P - fp / N), 0), 9) AS best_gap,
      round(sum(pos * (ns - fp + neg / 2.0)) / (max(ps) * max(ns)), 9) AS auc_on_support, round(sum(pos * tp / (tp + fp)) / max(ps), 9) AS ap_on_support,
      sum(pos * (ns - fp + neg / 2.0)) / (max(ps) * max(ns)) >= 0.9 AS flagged
    FROM k JOIN z USING (feature) GROUP BY feature"""


@query("artefact_audit", ARTEFACT_SQL)
def _artefacts(spark, sf):
    return rounded(L.artefact_audit(payments(spark, sf), _ART, "oracle_is_attack", target_fpr=0.05), 9)
