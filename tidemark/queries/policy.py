"""Fusion, capacity, action bands and beneficiary actions over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import beneficiary as B
from tidemark.operators import policy as P
from tidemark.operators import rules as R
from tidemark.plans.cut import cut
from tidemark.queries.metrics import AP, AUC
from tidemark.queries import rules as _rules  # noqa: F401  (registers the guards' SQL)
from tidemark.queries.registry import SQL, query, rounded
from tidemark.queries.scored import SCORED_SQL, scored
from tidemark.streaming.twins import scratch
from tidemark.queries.standin import payments, payments_sql

c = F.col


def components(spark, sf):
    return scored(spark, sf).withColumn("g1", c("score"))


def _ranks_sql() -> str:
    """Mid-ranks against the fit half, from per-value counts."""
    parts = []
    for n in P.COMPONENTS:
        parts.append(f"""v_{n} AS (SELECT {n} AS x, count(*) FILTER (half) AS eq, sum(count(*) FILTER (half)) OVER (ORDER BY {n} ROWS UNBOUNDED PRECEDING) - count(*) FILTER (half) AS less FROM comp GROUP BY 1),
    r_{n} AS (SELECT event_id, least(greatest((less + (eq - 1) / 2.0) / ((SELECT count(*) FROM comp WHERE half) - 1), 0), 1) AS r_{n} FROM comp JOIN v_{n} ON comp.{n} = v_{n}.x)""")
    joins = " ".join(f"JOIN r_{n} USING (event_id)" for n in P.COMPONENTS)
    return f"{SCORED_SQL}, comp AS (SELECT *, score AS g1 FROM sc), " + ",\n".join(parts) + f", rk AS (SELECT comp.event_id, comp.y, {', '.join('r_' + n for n in P.COMPONENTS)} FROM comp {joins})"


RANKS = _ranks_sql()


def ranks(spark, sf):
    rows = components(spark, sf)
    return P.ecdf_ranks(rows, rows.filter("half"), P.COMPONENTS)


def mean_sql(weights: dict, tail: bool = False) -> str:
    total = sum(weights.get(n, 0.0) for n in P.COMPONENTS)
    r = lambda n: f"-ln(least(greatest(1 - r_{n}, 0.001), 1))" if tail else f"r_{n}"
    return " + ".join(f"CAST({weights.get(n, 0.0) / total!r} AS DOUBLE) * {r(n)}" for n in P.COMPONENTS)


@query("ecdf_rank", f"WITH {RANKS} SELECT event_id, {', '.join(f'round(CAST(r_{n} AS DOUBLE), 9) AS r_{n}' for n in P.COMPONENTS)} FROM rk")
def _ecdf(spark, sf):
    return rounded(ranks(spark, sf), 9)


@query("fuse_weighted", f"WITH {RANKS} SELECT event_id, round(CAST({mean_sql(P.WEIGHTS)} AS DOUBLE), 9) AS fused FROM rk")
def _fuse(spark, sf):
    return rounded(ranks(spark, sf).select("event_id", P.fused(P.COMPONENTS).alias("fused")), 9)


@query("fuse_fisher", f"WITH {RANKS} SELECT event_id, round(CAST({mean_sql(P.WEIGHTS, True)} AS DOUBLE), 9) AS fused FROM rk")
def _fisher(spark, sf):
    return rounded(ranks(spark, sf).select("event_id", P.fused(P.COMPONENTS, tail=True).alias("fused")), 9)


@query("fuse_max", f"WITH {RANKS} SELECT event_id, round(CAST(greatest({', '.join('r_' + n for n in P.COMPONENTS)}) AS DOUBLE), 9) AS fused FROM rk")
def _fuse_max(spark, sf):
    return rounded(ranks(spark, sf).select("event_id", P.fused(P.COMPONENTS, max_rule=True).alias("fused")), 9)


@query("component_contributions", f"WITH {RANKS} SELECT event_id, {', '.join(f'round(CAST({w!r}e0 * r_{n} AS DOUBLE), 9) AS {n}' for n, w in P.WEIGHTS.items())} FROM rk")
def _contributions(spark, sf):
    m = P.contributions(P.COMPONENTS)
    return rounded(ranks(spark, sf).select("event_id", *[m[n].alias(n) for n in P.COMPONENTS]), 9)


@query("saturation_report", f"WITH {RANKS}, u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS component, CAST(r_{n} AS DOUBLE) AS r FROM rk" for n in P.COMPONENTS) + """)
    SELECT component, count(*) AS n, round(avg(CASE WHEN r >= 1 - 1e-12 THEN 1 ELSE 0 END), 9) AS share_at_rank_1, count(DISTINCT round(r, 12)) AS n_distinct_ranks FROM u GROUP BY component""")
def _saturation(spark, sf):
    return rounded(P.saturation_report(ranks(spark, sf), P.COMPONENTS), 9)


def _grid_sql() -> str:
    arms = " UNION ALL ".join(f"SELECT '{a}' AS arm, y, round(CAST({mean_sql(w, t)} AS DOUBLE), 9) AS s FROM rk WHERE y IN (0, 1)" for a, (w, t) in P.ARMS.items())
    return f"""WITH {RANKS}, kn AS ({arms}), g AS (SELECT arm, s, sum(y) AS pos, sum(1 - y) AS neg FROM kn GROUP BY 1, 2),
    cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY arm) AS P, sum(neg) OVER (PARTITION BY arm) AS N FROM g WINDOW w AS (PARTITION BY arm ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT arm, max(P) AS n_pos, max(N) AS n_neg, {AUC} AS auc, {AP} AS ap, floor(0.01e0 * max(N)) AS k, max(s) FILTER (neg > 0) AS top FROM cu GROUP BY arm),
    t AS (SELECT arm, min(s) FILTER (neg > 0 AND fp <= k) AS t, max(fp) FILTER (neg > 0 AND fp <= k) AS f, max(tp) FILTER (neg > 0 AND fp <= k) AS h FROM cu JOIN m USING (arm) GROUP BY arm)"""


@query("fusion_arm_grid", _grid_sql() + """ SELECT arm, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision,
    round(h / n_pos, 6) AS recall, round(f / n_neg, 6) AS realised_fpr FROM m JOIN t USING (arm)""")
def _grid(spark, sf):
    rows = ranks(spark, sf).join(scored(spark, sf).select("event_id", "y"), "event_id")
    return rounded(P.fusion_arm_grid(rows, 0.01))


@query("fusion_arm_choice", _grid_sql() + f""", sh AS (SELECT unnest({[a for a in P.ARMS]!r}) AS arm, unnest({[sum(v > 0 for v in w.values()) for w, _ in P.ARMS.values()]!r}) AS n, unnest({[bool(t) for _, t in P.ARMS.values()]!r}) AS tail)
    SELECT arm, CAST(NULL AS VARCHAR) AS refused FROM m JOIN sh USING (arm) WHERE ap >= 0.99 * (SELECT max(ap) FROM m) ORDER BY n, tail, ap DESC LIMIT 1""")
def _choice(spark, sf):
    rows = ranks(spark, sf).join(scored(spark, sf).select("event_id", "y"), "event_id")
    return P.select_arm(P.fusion_arm_grid(rows, 0.01))


# The fitted value of a score is the largest, over starts at or before it, of the least mean to an end at or after it.
_ISOTONIC = f"""{SCORED_SQL}, f AS (SELECT score AS s, count(*) AS n, sum(y) AS sy FROM sc WHERE half AND y >= 0 GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY s) AS j, sum(n) OVER (ORDER BY s) AS cn, sum(sy) OVER (ORDER BY s) AS cs FROM f),
    a AS (SELECT i.j AS i, k.j AS k, CAST(k.cs - i.cs + i.sy AS DOUBLE) / (k.cn - i.cn + i.n) AS v FROM o i JOIN o k ON k.j >= i.j),
    m AS (SELECT i, k AS j, min(v) OVER (PARTITION BY i ORDER BY k DESC) AS v FROM a), g AS (SELECT j, max(v) AS p FROM m GROUP BY j),
    t AS (SELECT o.s, g.p, abs(coalesce(sum(o.n * g.p) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - (o.cs - o.sy)) < 1e-7 AS touch FROM o JOIN g USING (j)),
    kn AS (SELECT s, p, lead(s) OVER (ORDER BY s) AS s1, lead(p) OVER (ORDER BY s) AS p1 FROM t WHERE touch),
    iso AS (SELECT sc.event_id, CASE WHEN kn.s IS NULL THEN (SELECT arg_min(p, s) FROM kn) WHEN kn.s1 IS NULL OR kn.s = sc.score THEN kn.p
        ELSE kn.p + (kn.p1 - kn.p) * (sc.score - kn.s) / (kn.s1 - kn.s) END AS p FROM sc ASOF LEFT JOIN kn ON sc.score >= kn.s WHERE NOT sc.half)"""


@query("isotonic", f"WITH {_ISOTONIC} SELECT event_id, round(p, 9) AS p FROM iso")
def _isotonic(spark, sf):
    """Knots from the labelled rows of one half, probabilities of the other."""
    rows = scored(spark, sf)
    return rounded(P.calibrate(P.fit_isotonic(rows.filter("half"), "score"), rows.filter("not half"), "score").select("event_id", "p"), 9)


@query("isotonic_knots", f"WITH {_ISOTONIC} SELECT s, round(p, 9) AS p FROM kn")
def _knots(spark, sf):
    return P.fit_isotonic(scored(spark, sf).filter("half"), "score").select("s", F.round("p", 9).alias("p"))


CAPS = "CASE rail " + " ".join(f"WHEN '{r}' THEN {v}e0" for r, v in P.FRICTION_CAPS.items()) + " END"


def capacity_sql(name: str, rows: str, budget: str, by: str) -> str:
    """CTE with the k-th largest threshold per group, moved above a tie that does not fit."""
    return f"""{name}_s AS (SELECT {by} AS grp, score, row_number() OVER (PARTITION BY {by} ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY {by}) AS n, floor(({budget}) * count(*) OVER (PARTITION BY {by})) AS k FROM {rows}),
    {name}_k AS (SELECT grp, max(n) AS n, max(k) AS k, max(score) AS top, max(score) FILTER (r = greatest(k, 1)) AS cand FROM {name}_s GROUP BY grp),
    {name}_c AS (SELECT k.*, (SELECT count(*) FROM {name}_s s WHERE s.grp = k.grp AND s.score >= cand) AS at_cand, (SELECT min(score) FROM {name}_s s WHERE s.grp = k.grp AND s.score > cand) AS up FROM {name}_k k),
    {name} AS (SELECT *, k <= 0 AS above_max, k > 0 AND at_cand > k AND up IS NULL AS overflow, CASE WHEN k <= 0 THEN top WHEN at_cand > k THEN coalesce(up, cand) ELSE cand END AS threshold FROM {name}_c)"""


@query("capacity_threshold", f"""WITH {SCORED_SQL}, {capacity_sql('cap', 'sc', CAPS, 'rail')}
    SELECT grp AS rail, threshold, above_max, overflow, n, CASE WHEN above_max THEN 0 ELSE (SELECT count(*) FROM sc WHERE rail = grp AND score >= threshold) END AS n_alerts,
    round(CASE WHEN above_max THEN 0 ELSE (SELECT count(*) FROM sc WHERE rail = grp AND score >= threshold) END / n, 9) AS realised_share FROM cap""")
def _capacity(spark, sf):
    return rounded(P.capacity_threshold(scored(spark, sf), "score", P.friction_cap(c("rail")), ["rail"]), 9)


_up = lambda n: f"CASE WHEN {n}.above_max THEN {n}.threshold + greatest(abs({n}.threshold) * 1e-12, 1e-12) ELSE {n}.threshold END"
_QS = ", ".join(repr(0.9 + i * ((0.99999 - 0.9) / 39)) for i in range(40))
TABLE_SQL = f"""{SCORED_SQL}, {capacity_sql('c1', 'sc', CAPS, 'rail')}, mid AS (SELECT median({_up('c1')}) AS t_fr FROM c1),
    cand AS (SELECT DISTINCT unnest(quantile_cont(score, [{_QS}])) AS t FROM sc),
    cost AS (SELECT t, sum(CASE WHEN score >= t THEN CASE WHEN y = 1 THEN 0 ELSE 4200 + amount * 0.009e0 END
      WHEN score >= t_fr THEN 45 + CASE WHEN y = 1 THEN 0.89e0 * (amount + 350) ELSE 0.11e0 * (4200 + amount * 0.009e0) END
      ELSE CASE WHEN y = 1 THEN amount + 350 ELSE -amount * 0.009e0 END END) AS cost FROM sc, cand, mid WHERE y >= 0 AND t >= t_fr GROUP BY t),
    dec AS (SELECT greatest(coalesce((SELECT t FROM cost ORDER BY round(cost, 4), t LIMIT 1), (SELECT quantile_cont(score, 0.999) FROM sc)), t_fr) AS t_decline, t_fr FROM mid),
    sh AS (SELECT avg(CASE WHEN score >= t_decline THEN 1e0 ELSE 0e0 END) AS declined FROM sc, dec),
    {capacity_sql('c2', 'sc', f'least(1, CAST({P.ALERT_BUDGET!r} AS DOUBLE) + (SELECT declined FROM sh))', '1')},
    bands AS (SELECT t_decline, least(greatest({_up('c2')}, t_fr), t_decline) AS t_review FROM dec, c2),
    ov AS (SELECT rail AS r0, avg(CASE WHEN score >= t_review THEN 1e0 ELSE 0e0 END) AS over_share FROM sc, bands GROUP BY rail), sc2 AS (SELECT * FROM sc JOIN ov ON rail = r0),
    {capacity_sql('c3', 'sc2', f'least(1, {CAPS} + over_share)', 'rail')},
    tab AS (SELECT grp AS rail, least({_up('c3')}, t_review) AS t_friction, greatest(t_review, least({_up('c3')}, t_review)) AS t_review, greatest(t_decline, t_review) AS t_decline FROM c3, bands)"""


def action_table(spark, sf):
    return P.fit_action_table(scored(spark, sf))


def frozen_table(spark, sf):
    """The fitted table as scoring would load it."""
    return cut(action_table(spark, sf))


@query("action_table", f"WITH {TABLE_SQL} SELECT rail, round(t_friction, 9) AS t_friction, round(t_review, 9) AS t_review, round(t_decline, 9) AS t_decline FROM tab")
def _table(spark, sf):
    return rounded(action_table(spark, sf), 9)


@query("collapsed_bands", f"WITH {TABLE_SQL} SELECT rail, abs(t_review - t_friction) <= 1e-12 AS review_is_friction, abs(t_decline - t_review) <= 1e-12 AS decline_is_review FROM tab")
def _collapsed(spark, sf):
    return P.collapsed_bands(action_table(spark, sf)).select("rail", "review_is_friction", "decline_is_review")


BAND_SQL = f"""{TABLE_SQL}, bd AS (SELECT sc.*, CASE WHEN score >= t_decline THEN 'auto_decline' WHEN score >= t_review THEN 'review' WHEN score >= t_friction THEN 'friction' ELSE 'approve' END AS band0 FROM sc JOIN tab USING (rail)),
    ba AS (SELECT *, CASE WHEN event_id % 101 = 0 THEN 'auto_decline' WHEN event_id % 37 = 0 AND band0 = 'approve' THEN 'friction' ELSE band0 END AS band FROM bd)"""
_LADDER = "CASE band WHEN 'approve' THEN 'approve' " + " ".join(
    f"WHEN '{b}' THEN CASE rail " + " ".join(f"WHEN '{r}' THEN '{v[i]}'" for r, v in P.LADDER.items()) + " END" for i, b in enumerate(("friction", "review", "auto_decline"))) + " END"


def banded(spark, sf):
    rows = scored(spark, sf).withColumns({"guard": c("event_id") % 101 == 0, "abstained": c("event_id") % 37 == 0})
    return P.with_band(rows, frozen_table(spark, sf), guard=c("guard"), abstained=c("abstained"))


@query("band_and_action", f"WITH {BAND_SQL} SELECT event_id, band, {_LADDER} AS action FROM ba")
def _bands(spark, sf):
    return banded(spark, sf).select("event_id", "band", "action")


@query("band_decomposition", f"WITH {BAND_SQL} SELECT band, count(*) AS n, round(count(*) / (SELECT count(*) FROM ba), 9) AS share, CAST(round(count(*) / (SELECT count(*) FROM ba) * 10000000) AS BIGINT) AS scaled_daily_count FROM ba GROUP BY band")
def _decomposition(spark, sf):
    return rounded(P.band_decomposition(banded(spark, sf)), 9)


@query("band_diagnosis", f"WITH {BAND_SQL} SELECT rail, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN band = '{b}' THEN 1 ELSE 0 END), 9) AS share_{b}" for b in ("approve", "friction", "review", "auto_decline"))
       + ", count(DISTINCT score) AS n_distinct_scores, count(*) FILTER (y = 1) AS n_visible_positives FROM ba GROUP BY rail")
def _diagnosis(spark, sf):
    return rounded(P.band_diagnosis(banded(spark, sf)), 9)


@query("outcome_split", f"""WITH {BAND_SQL} SELECT CASE WHEN event_id % 101 = 0 THEN 'blocked' WHEN event_id % 37 = 0 THEN 'abstained' WHEN band <> 'approve' THEN 'caught' ELSE 'slipped' END AS outcome, count(*) AS n FROM ba WHERE is_attack GROUP BY 1""")
def _outcome(spark, sf):
    return P.outcome_split(banded(spark, sf))


@query("value_stopped", f"""WITH {BAND_SQL}, s AS (SELECT CASE WHEN y = 1 THEN amount ELSE 0 END AS f, CASE WHEN y = 1 THEN 0 ELSE amount END AS g, band, y FROM ba)
    SELECT round(sum(f), 2) AS fraud_attempted, round(sum(f) FILTER (band <> 'approve'), 2) AS fraud_stopped, round(coalesce(sum(g) FILTER (band = 'auto_decline'), 0), 2) AS good_declined,
    round(coalesce(sum(g) FILTER (band = 'friction'), 0), 2) AS good_challenged, count(*) FILTER (y = 1 AND band <> 'approve') AS n_fraud_stopped FROM s""")
def _value(spark, sf):
    return rounded(P.value_stopped(banded(spark, sf)), 2)


_BEN = ("beneficiary_id", "beneficiary_onward_send_minutes", "beneficiary_distinct_payers_24h", "beneficiary_account_age_days", "creditor_name_match_score", "cohort_tag", "beneficiary_inbound_credit_count_24h")
_BASE = f"""{payments_sql(*_BEN)}, b0 AS (SELECT *, CAST((e * 31) % 100 AS DOUBLE) / 100 AS score, CAST((e * 17) % 50 AS DOUBLE) / 200 AS in_out_skew, CAST(e % 10 AS DOUBLE) / 10 AS first_credit_source_concentration,
    CASE WHEN e % 7 = 0 THEN 0.55e0 ELSE 0e0 END AS exchange_prior FROM pay), b1 AS (SELECT *, nullif(beneficiary_account_age_days, 0) AS age, nullif(in_out_skew, 0) AS skew, nullif(beneficiary_onward_send_minutes, 0) AS dwell,
    nullif(creditor_name_match_score, 0) AS nm FROM b0),
    b2 AS (SELECT *, list_filter([CASE WHEN skew >= 0 AND skew <= 0.05 THEN 'GB_IN_OUT_SKEW' END, CASE WHEN dwell >= 0 AND dwell <= 10 THEN 'GB_SHORT_DWELL' END,
      CASE WHEN beneficiary_distinct_payers_24h >= 20 AND age >= 0 AND age < 7 THEN 'GB_PAYER_FANIN' END, CASE WHEN age >= 0 AND age < 2 THEN 'GB_YOUNG_BENEFICIARY' END,
      CASE WHEN first_credit_source_concentration >= 0.6 THEN 'GB_FIRST_CREDIT_CONCENTRATION' END, CASE WHEN nm >= 0 AND nm < 0.6 THEN 'GB_NAME_MISMATCH' END], lambda x: x IS NOT NULL) AS own FROM b1),
    b3 AS (SELECT *, CASE WHEN score >= 0.8 AND len(own) >= 2 THEN 'freeze_recommend' WHEN score >= 0.5 AND len(own) >= 1 THEN 'hold' WHEN score >= 0.5 AND exchange_prior > 0 THEN 'review' ELSE 'approve' END AS action FROM b2)"""


def decided(spark, sf):
    e = F.substring("event_id", 2, 20).cast("long")
    rows = payments(spark, sf).withColumns({
        "score": ((e * 31) % 100).cast("double") / 100, "in_out_skew": ((e * 17) % 50).cast("double") / 200,
        "first_credit_source_concentration": (e % 10).cast("double") / 10, "exchange_prior": F.when(e % 7 == 0, 0.55).otherwise(0.0)})
    return B.decide(rows, 0.5, 0.8)


@query("beneficiary_action", f"""WITH {_BASE} SELECT event_id, action, CASE WHEN action = 'approve' THEN '' ELSE array_to_string(list_concat(own, CASE WHEN exchange_prior > 0 THEN ['GB_EXCHANGE_PRIOR'] ELSE [] END), ',') END AS codes,
    CASE WHEN action IN ('freeze_recommend', 'hold') THEN 24 ELSE 0 END AS hold_hours FROM b3""")
def _beneficiary(spark, sf):
    return decided(spark, sf).select("event_id", "action", F.concat_ws(",", "reason_codes").alias("codes"), "hold_hours")


@query("freeze_payload", f"WITH {_BASE} SELECT event_id, beneficiary_id, score, 24 AS max_hold_hours FROM b3 WHERE action = 'freeze_recommend'")
def _freeze(spark, sf):
    out = B.freeze_payload(decided(spark, sf), "beneficiary_inflow_24h_inr").filter(c("freeze_payload").isNotNull())
    return out.select("event_id", "freeze_payload.beneficiary_id", "freeze_payload.score", "freeze_payload.max_hold_hours")


@query("false_action_rates", f"""WITH {_BASE} SELECT coalesce(cohort_tag, 'all') AS cohort_tag, count(*) AS n, round(avg(CASE WHEN action = 'freeze_recommend' THEN 1 ELSE 0 END), 9) AS freeze_rate,
    round(avg(CASE WHEN action = 'hold' THEN 1 ELSE 0 END), 9) AS hold_rate, round(avg(CASE WHEN action = 'review' THEN 1 ELSE 0 END), 9) AS review_rate FROM b3 WHERE cohort_tag LIKE 'hbb%' GROUP BY ROLLUP (cohort_tag)""")
def _false(spark, sf):
    return rounded(B.false_action_rates(decided(spark, sf)), 9)


@query("no_exchange_fallback", f"""WITH {_BASE} SELECT event_id, coalesce(nullif(CAST(beneficiary_inbound_credit_count_24h AS DOUBLE), 0), -1) AS on_us_beneficiary_history, coalesce(age, -1) AS new_payee_age_days,
    CASE WHEN age >= 0 AND age < 1 THEN 1e0 ELSE 0e0 END AS first_payment_to_this_payee, CASE WHEN age >= 0 AND age < 2 THEN 1e0 ELSE 0e0 END AS payer_side_cooling_off_applicable FROM b3""")
def _fallback(spark, sf):
    out = B.no_exchange_fallback(payments(spark, sf))
    return out.select("event_id", "on_us_beneficiary_history", "new_payee_age_days", "first_payment_to_this_payee", "payer_side_cooling_off_applicable")


@query("risk_exchange", f"""WITH {payments_sql("beneficiary_id", "oracle_is_attack", "cohort_tag")}, h AS (SELECT DISTINCT beneficiary_id AS b FROM pay WHERE oracle_is_attack AND beneficiary_id <> '')
    SELECT event_id, CASE WHEN beneficiary_id IN (SELECT b FROM h) THEN 0.55e0 ELSE 0e0 END AS exchange_prior FROM pay""")
def _exchange(spark, sf):
    """At this many ids the expected false-positive rate is far below one in the table, so exact membership agrees."""
    rows = payments(spark, sf)
    return B.exchange_prior(rows, B.build_exchange(rows.filter("oracle_is_attack"), "beneficiary_id"), "beneficiary_id").select("event_id", "exchange_prior")


def guarded(spark, sf):
    """Fired guards by the scored rows' ids."""
    fired = R.structural_guards(payments(spark, sf), fanout_threshold=2)
    return fired.withColumn("event_id", F.expr("cast(substring(event_id, 2) AS bigint)"))


@query("batch_score")
def _batch(spark, sf):
    """Everything together: guards, ranks, calibration, abstention, bands and reason codes of the serving half."""
    rows = components(spark, sf).withColumn("conformal_p", 1.0 - c("g2_conformal") * 0.99)
    fit = rows.filter("half")
    fitted = P.ecdf_ranks(fit, fit, P.COMPONENTS).withColumn("fused", P.fused(P.COMPONENTS))
    fitted = cut(fitted.select("event_id", "fused").join(fit.select("event_id", "y", "rail", "amount"), "event_id"))
    model = P.fit_isotonic(fitted, "fused")
    table = cut(P.fit_action_table(P.calibrate(model, fitted, "fused", "score")))
    folder = scratch(spark)
    P.Bundle(fit.select(*P.COMPONENTS), table, model, view="issuer", model_version="r1").save(folder)
    out = P.score_batch(rows.filter("not half").drop("score"), P.Bundle.load(spark, folder), guards=guarded(spark, sf))
    return out.select("event_id", "score", "band", "action", F.concat_ws(",", "reason_codes").alias("codes"))


@query("kill_switch_score", f"""WITH {SCORED_SQL}, g AS (SELECT CAST(substr(event_id, 2) AS BIGINT) AS event_id, refuse, reason_codes FROM ({SQL["structural_guards"]})),
    x AS (SELECT sc.event_id, coalesce(refuse, FALSE) AS refuse, coalesce(reason_codes, '') AS own FROM sc LEFT JOIN g USING (event_id))
    SELECT event_id, CASE WHEN refuse THEN 1e0 ELSE 0e0 END AS score, CASE WHEN refuse THEN 'auto_decline' ELSE 'approve' END AS band,
    CASE WHEN own = '' THEN '' ELSE own || ',' END || 'POLICY_KILL_SWITCH_G0_ONLY' AS codes FROM x""")
def _kill_switch(spark, sf):
    """With the kill switch thrown the guards alone decide."""
    rows = components(spark, sf).drop("score")
    out = P.score_batch(rows, P.Bundle(rows.select(*P.COMPONENTS), None, None), guards=guarded(spark, sf), guards_only=True)
    return out.select("event_id", c("score").cast("double").alias("score"), "band", F.concat_ws(",", "reason_codes").alias("codes"))


# What a reviewer reads next to a code.
_TEXTS = {
    "GB_IN_OUT_SKEW": "Nearly all that comes in goes out again.", "GB_SHORT_DWELL": "Money leaves within minutes.",
    "GB_PAYER_FANIN": "Many payers on a new account.", "GB_YOUNG_BENEFICIARY": "The account is less than two days old.",
    "GB_FIRST_CREDIT_CONCENTRATION": "First credits come from one source.", "GB_EXCHANGE_PRIOR": "Reported by another member.",
}


@query("explained_codes", f"""WITH {_BASE}, a AS (SELECT event_id, list_concat(own, CASE WHEN exchange_prior > 0 THEN ['GB_EXCHANGE_PRIOR'] ELSE [] END) AS codes FROM b3 WHERE action <> 'approve'),
    u AS (SELECT event_id, codes, unnest(range(len(codes))) AS position FROM a), x AS (SELECT event_id, CAST(position AS INTEGER) AS position, codes[position + 1] AS code FROM u)
    SELECT event_id, position, code, CASE code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _TEXTS.items())} END AS text FROM x""")
def _explained(spark, sf):
    """Each code of a decision with its text; a code without one keeps a null."""
    texts = spark.createDataFrame(list(_TEXTS.items()), "code string, text string")
    return P.explain_codes(decided(spark, sf), "reason_codes", texts).select("event_id", "position", "code", "text")


@query("exchange_saturation", f"""WITH {payments_sql("beneficiary_id", "oracle_is_attack")}, n AS (SELECT count(DISTINCT beneficiary_id) AS n_ids FROM pay WHERE oracle_is_attack AND beneficiary_id <> '')
    SELECT n_ids, round(CASE WHEN n_ids > 0 THEN pow(1 - exp(-{B.HASHES} * n_ids / {B.BITS}.0), {B.HASHES}) ELSE 0 END, 15) + 0e0 AS expected_false_positive_rate FROM n""")
def _saturation(spark, sf):
    """Ids in the exchange and the share of strangers it is expected to take for one of them."""
    ids = payments(spark, sf).filter("oracle_is_attack AND beneficiary_id <> ''").agg(F.countDistinct("beneficiary_id").alias("n_ids"))
    return rounded(ids.withColumn("expected_false_positive_rate", B.expected_false_positive_rate(c("n_ids"))), 15)


@query("reason_vocabulary", f"WITH {_BASE}, u AS (SELECT unnest(own) AS code FROM b3 WHERE action <> 'approve') SELECT code, count(*) AS n FROM u WHERE code IN ('GB_NAME_MISMATCH', 'GB_SHORT_DWELL') GROUP BY code")
def _vocabulary(spark, sf):
    """Codes outside a vocabulary that lacks two of them on purpose."""
    known = ["GB_IN_OUT_SKEW", "GB_PAYER_FANIN", "GB_YOUNG_BENEFICIARY", "GB_FIRST_CREDIT_CONCENTRATION", "GB_EXCHANGE_PRIOR"]
    return P.unknown_codes(decided(spark, sf), "reason_codes", known)
