"""Campaign economics and escape mining on campaign steps derived from ``lineitem`` and scored orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import loop as L
from tidemark.queries.metrics import wilson_sql
from tidemark.queries.registry import query, rounded, split_columns, table
from tidemark.queries.scored import SCORED_SQL, scored
from tidemark.queries.standin import payments, payments_sql

c = F.col

_STEPS = """l_orderkey AS campaign_id, l_linenumber AS step, l_partkey * 10 + l_linenumber AS tie, l_extendedprice * 0.731058578630 AS value_retained, l_partkey % 9 AS probes, l_suppkey % 3 AS mules,
    l_partkey % 2 AS credentials, l_linenumber AS elapsed_steps, l_returnflag = 'R' AS ruined, l_extendedprice * l_discount * 0.931058578630 AS unrecovered, l_returnflag <> 'N' AS adverse,
    l_tax * 100 AS latency_hours, l_discount * 100 AS break_even_hours, CASE WHEN l_linestatus = 'O' THEN 'beneficiary_freeze' ELSE '' END AS trigger_name"""
STEPS_SQL = f"st AS (SELECT {_STEPS} FROM lineitem)"


def steps(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*split_columns(_STEPS))


@query("campaign_pnl", f"""WITH {STEPS_SQL} SELECT campaign_id, count(*) AS n_steps, round(sum(value_retained), 4) AS value_retained, round(sum(3.5e0 * probes), 4) AS probe_cost, round(sum(900e0 * mules), 4) AS mule_cost,
    round(sum(2600e0 * credentials), 4) AS credential_cost, round(sum(12e0 * elapsed_steps), 4) AS time_cost, round(sum(CASE WHEN ruined THEN 1.5e0 * unrecovered ELSE 0 END), 4) AS ruin_penalty,
    round(sum(value_retained - 3.5e0 * probes - 900e0 * mules - 2600e0 * credentials - 12e0 * elapsed_steps - CASE WHEN ruined THEN 1.5e0 * unrecovered ELSE 0 END), 4) AS reward FROM st GROUP BY 1""")
def _pnl(spark, sf):
    return rounded(L.campaign_pnl(steps(spark, sf)), 4)


@query("ruin", f"WITH {STEPS_SQL} SELECT trigger_name <> '' AND latency_hours < break_even_hours AS ruined, count(*) AS n FROM st GROUP BY 1")
def _ruin(spark, sf):
    hit = L.ruin(c("latency_hours"), c("break_even_hours"), c("trigger_name"))
    return steps(spark, sf).groupBy(hit.alias("ruined")).agg(F.count(F.lit(1)).alias("n"))


@query("outcome_severity", f"""WITH {STEPS_SQL} SELECT CASE WHEN mules = 2 THEN 'account_frozen' WHEN probes = 3 THEN 'credit_held' WHEN adverse AND credentials = 1 THEN 'decline' WHEN ruined THEN 'approve' ELSE 'none' END AS outcome,
    CASE WHEN break_even_hours / 10 > 0.66 THEN 'high' WHEN break_even_hours / 10 > 0.33 THEN 'mid' ELSE 'low' END AS budget, count(*) AS n FROM st GROUP BY 1, 2""")
def _outcome(spark, sf):
    what = L.outcome(account_frozen=c("mules") == 2, credit_held=c("probes") == 3, decline=c("adverse") & (c("credentials") == 1), approve=c("ruined"))
    return steps(spark, sf).groupBy(what.alias("outcome"), L.budget_bucket(c("break_even_hours"), F.lit(10.0)).alias("budget")).agg(F.count(F.lit(1)).alias("n"))


@query("heat_level", """WITH o AS (SELECT *, avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS r FROM orders)
    SELECT o_orderkey, round(r, 9) AS adverse_rate, CASE WHEN r < 0.15 THEN 'cold' WHEN r < 0.45 THEN 'warm' ELSE 'hot' END AS heat FROM o""")
def _heat(spark, sf):
    o = table(spark, sf, "orders").withColumn("adverse", c("o_orderstatus") == "F")
    return rounded(L.with_heat(o, "o_custkey", ["o_orderkey"], "adverse").select("o_orderkey", "adverse_rate", "heat"), 9)


_RUNS = "o_orderkey AS run, o_custkey % 6 AS tick, CONCAT('fam', CAST(o_custkey % 7 AS STRING)) AS family, o_totalprice AS cost, CASE WHEN o_orderkey % 4 = 0 THEN 0e0 ELSE o_totalprice * 0.531058578630 + o_orderkey END AS value_retained"


@query("cost_per_extracted", f"WITH r AS (SELECT {_RUNS} FROM orders) SELECT tick, family, round(avg(cost / value_retained), 6) AS cost_per_extracted, count(*) AS n_campaigns FROM r WHERE value_retained > 0 GROUP BY 1, 2")
def _cpe(spark, sf):
    return rounded(L.cost_per_extracted(table(spark, sf, "orders").selectExpr(*split_columns(_RUNS))))


RECALLS = f"{SCORED_SQL}, rc AS (SELECT family, event_id % 8 AS tick, avg(CASE WHEN score >= 0.3 + (event_id % 8) * 0.02 THEN 1 ELSE 0 END) AS recall FROM sc WHERE y = 1 GROUP BY 1, 2)"


def recalls(spark, sf):
    tick = c("event_id") % 8
    rows = scored(spark, sf).filter("y = 1").withColumn("tick", tick)
    return rows.groupBy("family", "tick").agg(F.avg(F.when(c("score") >= 0.3 + c("tick") * 0.02, 1.0).otherwise(0.0)).alias("recall"))


@query("time_to_close", f"WITH {RECALLS} SELECT family, min(tick) AS discovered, min(tick) FILTER (recall >= 0.6) AS closed, min(tick) FILTER (recall >= 0.6) - min(tick) AS ticks_to_close FROM rc GROUP BY family HAVING min(tick) FILTER (recall >= 0.6) IS NOT NULL")
def _close(spark, sf):
    return L.time_to_close(recalls(spark, sf), 0.6)


@query("regression_ledger", f"""WITH {RECALLS}, w AS (SELECT *, lag(recall) OVER (PARTITION BY family ORDER BY tick) AS before FROM rc)
    SELECT tick, 'fam3' AS closed_family, family, round(before, 9) AS before, round(recall, 9) AS after FROM w WHERE before - recall >= 0.05 AND family <> 'fam3'""")
def _ledger(spark, sf):
    return rounded(L.regression_ledger(recalls(spark, sf).withColumn("closed_family", F.lit("fam3"))), 9)


@query("escapes_by_cell", f"WITH {SCORED_SQL} SELECT rail || '|' || family AS cell_id, count(*) AS n_escapes FROM sc WHERE y = 1 AND score < 0.5 GROUP BY 1")
def _escapes(spark, sf):
    rows = scored(spark, sf).filter("y = 1").withColumns({"cell_id": F.concat_ws("|", "rail", "family"), "escaped": c("score") < 0.5})
    return L.escapes_by_cell(rows)


_REGION = ("device_age_days", "amount_log", "sms_silence_window_minutes", "merchant_age_days")


def _region_sql() -> str:
    """One round after the other: all cuts of all features not used yet, the best of them, the rows on its side."""
    least = L.MIN_ESCAPES
    out = [payments_sql("oracle_is_attack", "device_age_days", "amount_inr", "sms_silence_window_minutes", "merchant_age_days"),
           f"""g0 AS (SELECT ln(1 + amount_inr) AS amount_log, device_age_days, sms_silence_window_minutes, merchant_age_days, '' AS used,
      (device_age_days < 8 AND amount_inr < 5000) OR sms_silence_window_minutes > 90 AS escaped FROM pay WHERE oracle_is_attack)"""]
    for k in range(1, L.MAX_CONJUNCTS + 1):
        g = f"g{k - 1}"
        long = " UNION ALL ".join(f"SELECT '{f}' AS feature, {i} AS r, {f} AS v, escaped FROM {g} WHERE NOT contains(used, '{f}')" for i, f in enumerate(_REGION))
        pick = " ".join(f"WHEN '{f}' THEN {f}" for f in _REGION)
        out += [
            f"n{k} AS (SELECT count(*) AS n, count(*) FILTER (escaped) AS e FROM {g})",
            f"l{k} AS ({long})",
            f"t{k} AS (SELECT DISTINCT feature, r, unnest(q) AS t FROM (SELECT feature, r, quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM l{k} WHERE v > -1 GROUP BY feature, r HAVING count(*) >= {least}))",
            f"c{k} AS (SELECT feature, r, t, count(*) FILTER (v <= t) AS nl, count(*) FILTER (v <= t AND escaped) AS el FROM t{k} JOIN l{k} USING (feature, r) GROUP BY ALL)",
            f"""s{k} AS (SELECT feature, r, t, nl, el, n - nl AS nr, e - el AS er, n, e, 2 * (e / n) * (1 - e / n) AS whole FROM c{k}, n{k}
      WHERE nl >= {least} AND n - nl >= {least} AND e >= {least} AND n >= {2 * least})""",
            f"""b{k} AS (SELECT feature, t, el / nl >= er / nr AS low, CASE WHEN el / nl >= er / nr THEN el ELSE er END AS inside,
      round(whole - (nl / n * 2 * (el / nl) * (1 - el / nl) + nr / n * 2 * (er / nr) * (1 - er / nr)), 12) AS gain FROM s{k} ORDER BY gain DESC, r, t LIMIT 1)""",
            f"w{k} AS (SELECT * FROM b{k} WHERE gain > 1e-6 AND inside >= {least})",
            f"""g{k} AS (SELECT {g}.* REPLACE (used || coalesce(' ' || feature, '') AS used) FROM {g} LEFT JOIN w{k} ON TRUE
      WHERE feature IS NULL OR (CASE feature {pick} END <= t) = low)"""]
    won = " UNION ALL ".join(f"SELECT {k - 1} AS position, feature, CASE WHEN low THEN 'at_most' ELSE 'above' END AS side, t AS threshold FROM w{k}" for k in range(1, L.MAX_CONJUNCTS + 1))
    last = f"g{L.MAX_CONJUNCTS}"
    return f"""WITH {', '.join(out)}, won AS ({won})
    SELECT CAST(position AS INTEGER) AS position, feature, side, round(threshold, 6) + 0e0 AS threshold, n1.n AS n_rows, n1.e AS n_escapes, (SELECT count(*) FROM {last}) AS inside,
      (SELECT count(*) FILTER (escaped) FROM {last}) AS inside_escapes FROM won, n1"""


@query("escape_region", _region_sql())
def _region(spark, sf):
    """Where attacks with a young device and a small amount get through: one row per bound of the region."""
    rows = payments(spark, sf).filter("oracle_is_attack").withColumns({
        "amount_log": F.log1p("amount_inr"), "escaped": (c("device_age_days") < 8) & (c("amount_inr") < 5000) | (c("sms_silence_window_minutes") > 90)})
    found = L.mine_escape_region(rows, list(_REGION))
    flat = found.select(F.posexplode("bounds").alias("position", "b"), "n_rows", "n_escapes", "inside", "inside_escapes")
    return rounded(flat.select("position", "b.feature", "b.side", "b.threshold", "n_rows", "n_escapes", "inside", "inside_escapes"))


_u12, _unb = wilson_sql("a12", "n12")[1], wilson_sql("afz", "nb")[1]
GATE_SQL = f"""WITH {SCORED_SQL}, x AS (SELECT sum(CASE WHEN cohort_tag LIKE 'hb12%' AND score >= 0.65 THEN 1 ELSE 0 END) AS b12, sum(CASE WHEN cohort_tag LIKE 'hb12%' AND score >= 0.66 THEN 1 ELSE 0 END) AS a12,
    sum(CASE WHEN cohort_tag LIKE 'hb12%' THEN 1 ELSE 0 END) AS n12, sum(CASE WHEN cohort_tag LIKE 'hbb%' AND s_base >= 0.65 THEN 1 ELSE 0 END) AS bfz, sum(CASE WHEN cohort_tag LIKE 'hbb%' AND s_base >= 0.6 THEN 1 ELSE 0 END) AS afz,
    sum(CASE WHEN cohort_tag LIKE 'hbb%' THEN 1 ELSE 0 END) AS nb FROM sc WHERE y <> 1), z AS (SELECT 100 * ({_u12} - b12 / n12) AS fp, 100 * ({_unb} - bfz / nb) AS fz FROM x),
    b AS (SELECT *, array_to_string(list_filter([CASE WHEN fp > 0.25 THEN 'hard_benign_false_positives' END, CASE WHEN fz > 0.25 THEN 'false_freezes' END, 'approval_rate'], lambda v: v IS NOT NULL), ',') AS blocks FROM z)
    SELECT round(fp, 6) AS fp_upper_pp, round(fz, 6) AS freeze_upper_pp, blocks, blocks = '' AS promoted FROM b"""


@query("promotion_gate", GATE_SQL)
def _gate(spark, sf):
    rows = scored(spark, sf).filter("y <> 1")
    at = lambda t, u: rows.select("cohort_tag", (c("score") >= t).alias("declined"), (c("s_base") >= u).alias("frozen"))
    return rounded(L.promotion_gate(at(0.65, 0.65), at(0.66, 0.60), F.lit(False), F.lit(-0.2)))


_ARMS = {"full": 0.60, "static": 0.62, "bandit_only": 0.601, "random_tactic": 0.66}


@query("arm_lift", f"WITH {SCORED_SQL}, a AS (" + " UNION ALL ".join(f"SELECT '{a}' AS arm, avg(CASE WHEN score >= {t} THEN 1e0 ELSE 0e0 END) AS v FROM sc" for a, t in _ARMS.items()) + """)
    SELECT x.arm AS arm_a, y.arm AS arm_b, round(x.v, 9) AS a, round(y.v, 9) AS b, round(x.v - y.v, 9) AS delta, CASE WHEN abs(x.v - y.v) < 0.01 THEN 'no measured effect' ELSE 'effect' END AS verdict FROM a x, a y WHERE x.arm = 'full' AND y.arm <> 'full'""")
def _lift(spark, sf):
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(t).alias("t")) for a, t in _ARMS.items()]))
    cov = scored(spark, sf).select("score", arms.alias("e")).groupBy("e.arm").agg(F.avg(F.when(c("score") >= c("e.t"), 1.0).otherwise(0.0)).alias("coverage"))
    return rounded(L.arm_lift(cov), 9)


@query("mule_sweep", f"""WITH {STEPS_SQL}, g AS (SELECT unnest([0.33e0, 1e0, 3e0]) AS multiplier), p AS (SELECT multiplier, avg(CASE WHEN value_retained - unrecovered - mules * 900e0 * multiplier > 20000 THEN 1 ELSE 0 END) AS s FROM st, g GROUP BY 1)
    SELECT multiplier, round(s, 9) AS solvent_share, round((SELECT min(s) FROM p), 9) AS range_lo, round((SELECT max(s) FROM p), 9) AS range_hi FROM p""")
def _sweep(spark, sf):
    return rounded(L.mule_sweep(steps(spark, sf).withColumn("other_cost", c("unrecovered") + 20_000.0)), 9)


@query("campaign_summary", f"""WITH {SCORED_SQL}, u AS (SELECT 'family' AS dimension, family AS value, * FROM sc UNION ALL SELECT 'cell_id', mcc || '|' || geo_cell, * FROM sc UNION ALL SELECT 'rail', rail, * FROM sc UNION ALL SELECT 'all', 'all', * FROM sc)
    SELECT dimension, value, count(*) AS n_campaigns, count(*) FILTER (sealed) AS n_sealed, CAST(sum((event_id % 5 + 1) * (event_id % 3 + 1)) AS BIGINT) AS planned_events FROM u GROUP BY 1, 2""")
def _summary(spark, sf):
    rows = scored(spark, sf).withColumns({"cell_id": F.concat_ws("|", "mcc", "geo_cell"), "events_per_day": c("event_id") % 5 + 1, "duration_days": c("event_id") % 3 + 1})
    return L.campaign_summary(rows)
