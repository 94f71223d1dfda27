"""Training weights, novelty scores and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalogue as C
from tidemark.operators import features as FE
from tidemark.operators import gbdt as G
from tidemark.operators import metrics as M
from tidemark.operators import scores as SC
from tidemark.operators.labels import maturity_weight
from tidemark.plans.cut import cut
from tidemark.queries.features import BATCH_CTES, PAY, prepared, stats_for
from tidemark.queries.registry import query, rounded, table
from tidemark.queries.scored import SCORED_SQL, scored
from tidemark.queries.standin import payments, payments_sql

c = F.col


@query("pu_expand", f"""WITH {SCORED_SQL} SELECT event_id, CAST(1 AS INTEGER) AS y_fit, CASE WHEN y = 1 THEN 1e0 ELSE 0.01e0 END AS w FROM sc WHERE y IN (1, -1)
    UNION ALL SELECT event_id, 0, CASE WHEN y = 0 THEN 1e0 ELSE 0.99e0 END FROM sc WHERE y IN (0, -1)""")
def _pu(spark, sf):
    return SC.pu_expand(scored(spark, sf), 0.01).select("event_id", "y_fit", "w")


_IPW = ("incumbent_accept_probability", "incumbent_decision")
_w = ("CASE WHEN incumbent_decision <> 'decline' AND incumbent_accept_probability > 0 AND incumbent_accept_probability <= 1 "
      "THEN least(greatest(1 / incumbent_accept_probability, 0.05), 4) ELSE 1 END")


@query("ipw_weights", f"WITH {payments_sql(*_IPW)} SELECT event_id, round({_w}, 9) AS w FROM pay")
def _ipw(spark, sf):
    w = SC.ipw_weight(c("incumbent_accept_probability"), c("incumbent_decision") == "decline", hi=4.0)
    return rounded(payments(spark, sf).select("event_id", w.alias("w")), 9)


@query("ipw_report", f"""WITH {payments_sql(*_IPW)}, x AS (SELECT {_w} AS w, {_w.replace(', 4)', ', 1e9)').replace('0.05', '0')} AS raw, incumbent_decision = 'decline' AS d,
    incumbent_decision <> 'decline' AND incumbent_accept_probability > 0 AND incumbent_accept_probability <= 1 AS ok FROM pay)
    SELECT count(*) AS n_rows, count(*) FILTER (d) AS n_declined, count(*) FILTER (raw < 0.05 OR raw > 4) AS n_clipped, round(avg(CASE WHEN raw < 0.05 OR raw > 4 THEN 1 ELSE 0 END), 9) AS share_clipped,
    round(avg(w) FILTER (ok), 9) AS mean_weight, round(max(w), 9) AS max_weight FROM x""")
def _ipw_report(spark, sf):
    return rounded(SC.ipw_report(payments(spark, sf), c("incumbent_accept_probability"), c("incumbent_decision") == "decline", hi=4.0), 9)


@query("propensity_histogram", f"""WITH {payments_sql(*_IPW)} SELECT CAST(least(floor(incumbent_accept_probability * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM pay
    WHERE incumbent_accept_probability BETWEEN 0 AND 1 GROUP BY 1""")
def _propensity(spark, sf):
    return SC.propensity_histogram(payments(spark, sf), "incumbent_accept_probability")


@query("propensity_overlap", f"""WITH {payments_sql(*_IPW)} SELECT count(*) AS n, min(incumbent_accept_probability) AS p_min, max(incumbent_accept_probability) AS p_max,
    round(avg(incumbent_accept_probability), 9) AS p_mean, round(avg(CASE WHEN incumbent_accept_probability < 0.05 THEN 1 ELSE 0 END), 9) AS share_below,
    round(avg(CASE WHEN incumbent_accept_probability > 0.95 THEN 1 ELSE 0 END), 9) AS share_above,
    min(incumbent_accept_probability) > 0 AND max(incumbent_accept_probability) < 1 AS positivity_ok FROM pay WHERE incumbent_accept_probability >= 0""")
def _overlap(spark, sf):
    return rounded(SC.propensity_overlap(payments(spark, sf), "incumbent_accept_probability"), 9)


_DIMS = 64
_EMB = f"em AS (SELECT vec_id AS event_id, label, {', '.join(f'CAST(floor(embedding[{i + 1}] * 50) AS DOUBLE) AS d{i}' for i in range(_DIMS))} FROM embeddings)"


def embeddings(spark, sf):
    return table(spark, sf, "embeddings").select(
        c("vec_id").alias("event_id"), "label", *[F.floor(F.get("embedding", F.lit(i)) * 50).cast("double").alias(f"d{i}") for i in range(_DIMS)])


_FEATURES = [f"d{i}" for i in range(_DIMS)]
_LONG = ", ".join(f"('{f}', {f})" for f in _FEATURES)
ECOD_SQL = f"""{_EMB}, lo AS (SELECT event_id, unnest([{', '.join(repr(f) for f in _FEATURES)}]) AS f, unnest([{', '.join(_FEATURES)}]) AS x, label FROM em),
    ref AS (SELECT f, x FROM lo WHERE label < 8), n AS (SELECT f, count(*) AS n FROM ref GROUP BY f),
    v AS (SELECT DISTINCT f, x FROM lo), t AS (SELECT v.f, v.x, (SELECT count(*) FROM ref WHERE ref.f = v.f AND ref.x <= v.x) / CAST(n AS DOUBLE) AS l,
      1 - (SELECT count(*) FROM ref WHERE ref.f = v.f AND ref.x < v.x) / CAST(n AS DOUBLE) AS r, n FROM v JOIN n USING (f)),
    raw AS (SELECT event_id, max(label) AS label, sum(-ln(least(greatest(least(l, r), 1 / greatest(2 * n, 2)), 1))) AS raw FROM lo JOIN t ON lo.f = t.f AND lo.x = t.x GROUP BY event_id),
    m AS (SELECT avg(raw) AS mu, stddev_pop(raw) AS sd, quantile_cont(raw, [{', '.join(repr(i / 1000) for i in range(1001))}]) AS q FROM raw WHERE label < 8)"""


@query("ecod_score", f"""WITH {ECOD_SQL} SELECT event_id, round(raw, 6) AS raw, round((raw - mu) / sd, 6) AS z FROM raw, m""")
def _ecod(spark, sf):
    rows = embeddings(spark, sf)
    return rounded(SC.ecod_score(rows, rows.filter("label < 8"), _FEATURES).select("event_id", "raw", "z"))


@query("ecod_quantile", f"""WITH {ECOD_SQL} SELECT event_id, CASE WHEN raw > q[1001] THEN 1e0 ELSE CAST(len(list_filter(q, lambda x: x < raw - 1e-9)) AS DOUBLE) / 1000 END AS quantile FROM raw, m""")
def _ecod_q(spark, sf):
    rows = embeddings(spark, sf)
    return SC.ecod_score(rows, rows.filter("label < 8"), _FEATURES).select("event_id", "quantile")


_BAND = "CASE WHEN mcc = '6011' THEN 'quasi_cash' WHEN mcc = '5411' THEN 'grocery_dining' WHEN mcc = '4111' THEN 'travel' WHEN mcc = '' THEN 'none' ELSE 'other' END"
CONF_SQL = f"""{SCORED_SQL}, l AS (SELECT *, rail || '|' || {_BAND} || '|' || left(geo_cell, 4) AS s0, rail || '|' || {_BAND} || '|*' AS s1, rail || '|*|*' AS s2 FROM sc),
    ca AS (SELECT * FROM l WHERE half AND y <> 1), a0 AS (SELECT s0 AS s, count(*) AS n FROM ca GROUP BY 1 HAVING count(*) >= 60), a1 AS (SELECT s1 AS s, count(*) AS n FROM ca GROUP BY 1 HAVING count(*) >= 60),
    a2 AS (SELECT s2 AS s, count(*) AS n FROM ca GROUP BY 1 HAVING count(*) >= 60),
    u AS (SELECT l.event_id, l.score, l.y, CASE WHEN s0 IN (SELECT s FROM a0) THEN s0 WHEN s1 IN (SELECT s FROM a1) THEN s1 WHEN s2 IN (SELECT s FROM a2) THEN s2 ELSE '*|*|*' END AS stratum FROM l WHERE NOT half),
    x AS (SELECT u.event_id, u.stratum, count(*) AS n, count(*) FILTER (ca.score >= u.score) AS ge FROM u JOIN ca ON u.stratum IN (ca.s0, ca.s1, ca.s2, '*|*|*') GROUP BY 1, 2),
    pv AS (SELECT event_id, stratum, (1.0 + ge) / (1.0 + n) AS p FROM x)"""


def conformal(spark, sf):
    rows = scored(spark, sf)
    return SC.conformal_p(rows.filter(~c("half")), rows.filter(c("half") & (c("y") != 1)), "score", minimum=60)


@query("conformal_p", f"WITH {CONF_SQL} SELECT event_id, stratum, round(CAST(p AS DOUBLE), 9) AS p FROM pv")
def _conformal(spark, sf):
    return rounded(conformal(spark, sf).select("event_id", "stratum", "p"), 9)


@query("conformal_coverage", f"""WITH {CONF_SQL} SELECT coalesce(stratum, 'overall') AS stratum, count(*) AS n, round(avg(CASE WHEN p > 0.05 THEN 1 ELSE 0 END), 9) AS coverage,
    round(avg(CASE WHEN p > 0.05 THEN 1 ELSE 0 END) - 0.95, 9) AS gap FROM pv GROUP BY ROLLUP (stratum)""")
def _coverage(spark, sf):
    return rounded(SC.conformal_coverage(conformal(spark, sf)), 9)


@query("conformal_strata", f"""WITH {CONF_SQL}, z AS (SELECT s, count(*) AS n FROM (SELECT unnest([s0, s1]) AS s FROM ca) GROUP BY s) SELECT s AS stratum, n AS n_calib FROM z ORDER BY n, s LIMIT 10""")
def _strata(spark, sf):
    """Diagnostics: the ten smallest calibration strata."""
    rows = scored(spark, sf)
    return SC.smallest_strata(SC.stratum_sizes(rows.filter(c("half") & (c("y") != 1))))


@query("abstention_price", f"""WITH {SCORED_SQL}, a AS (SELECT *, score >= 0.65 AS ab FROM sc), u AS (SELECT 'attack' AS population, ab FROM a WHERE is_attack UNION ALL SELECT 'benign', ab FROM a WHERE NOT is_attack
    UNION ALL SELECT 'rail:' || rail, ab FROM a WHERE NOT is_attack UNION ALL SELECT CASE WHEN cohort_tag LIKE 'hb12%' THEN 'hard_benign_12' WHEN cohort_tag LIKE 'hbb%' THEN 'hard_benign_b' ELSE 'ordinary' END, ab FROM a WHERE NOT is_attack)
    SELECT population, count(*) AS n, round(avg(CAST(ab AS INT)), 9) AS abstention_rate FROM u GROUP BY population""")
def _price(spark, sf):
    return rounded(SC.abstention_price(scored(spark, sf).withColumn("abstained", c("score") >= 0.65)), 9)


_BATCH = FE.onboarding_batches


_BATCH_VALUES = {"onboarding_batch_timing_cluster": "timing", "device_os_entropy_collapse": "1 - ent", "asn_reuse_rate": "asn", "name_ngram_unlikelihood": "ngram",
                 "address_geocode_density": "dens", "first_credit_source_concentration_batch": "hhi", "batch_kyc_tier_uniformity": "tier_share"}
_EDGE = ", ".join(f"CASE WHEN count(*) FILTER ({n} > -1) >= 20 THEN quantile_cont({n}, {[i / 100 for i in range(101)]}) FILTER ({n} > -1) END AS q_{n}" for n in SC.COHORT_WEIGHTS)
_PART = " + ".join(f"CASE WHEN {n} > -1 AND q_{n} IS NOT NULL THEN {w} * least(len(list_filter(q_{n}, lambda e: e < {n})) / 100, 1) ELSE 0 END" for n, w in SC.COHORT_WEIGHTS.items())


@query("cohort_batch_score", f"""WITH {PAY}, {', '.join(BATCH_CTES)}, bt AS (SELECT g.onboarding_batch_id, {', '.join(f"round({x}, 9) AS {n}" for n, x in _BATCH_VALUES.items())}
      FROM g JOIN e USING (onboarding_batch_id) JOIN f USING (onboarding_batch_id) JOIN k USING (onboarding_batch_id)), ed AS (SELECT {_EDGE} FROM bt)
    SELECT onboarding_batch_id AS event_id, round(({_PART}) / {sum(SC.COHORT_WEIGHTS.values())}, 6) + 0e0 AS cohort_score FROM bt, ed""")
def _cohort_score(spark, sf):
    """Cohort risk of each onboarding batch against edges fitted on every batch."""
    batches = rounded(_BATCH(prepared(spark, sf)).withColumnRenamed("onboarding_batch_id", "event_id"), 9)
    return rounded(SC.cohort_score(batches, SC.fit_cohort_edges(batches)).select("event_id", "cohort_score"))


_WEIGHT_T = 1_712_000_000.0


@query("combined_weights", f"""WITH {payments_sql("incumbent_accept_probability", "incumbent_decision", "dispute_filed_ts")}, w AS (SELECT event_id,
      least(greatest(CASE WHEN incumbent_decision <> 'decline' AND incumbent_accept_probability > 0 AND incumbent_accept_probability <= 1 THEN 1 / incumbent_accept_probability ELSE 1 END, 0.05), 20) AS ipw,
      CASE WHEN dispute_filed_ts > 0 THEN 0.25 + 0.75 * greatest(least(({_WEIGHT_T} - ts) / 86400 / 120, 1), 0) ELSE 0 END AS maturity FROM pay)
    SELECT event_id, round(ipw * CASE WHEN maturity > 0 THEN maturity ELSE 1 END, 6) + 0e0 AS weight FROM w""")
def _combined(spark, sf):
    """Sample weights: inverse accept probability times how settled the label is; events without a label keep the first."""
    ipw = SC.ipw_weight(c("incumbent_accept_probability"), c("incumbent_decision") == "decline")
    settled = maturity_weight(c("ts"), c("dispute_filed_ts"), _WEIGHT_T)
    return rounded(payments(spark, sf).select("event_id", SC.combined_weight(ipw, settled).alias("weight")))


_SHAPES = {
    "in_out_skew": "1 - v / 0.15", "pass_through_dwell_seconds": "1 - v / 3600", "beneficiary_account_age_days": "1 - v / 30", "beneficiary_distinct_payers_24h": "v / 40",
    "first_credit_source_concentration": "v",
}
_FIVE = """SELECT event_id, beneficiary_account_age_days::DOUBLE AS beneficiary_account_age_days, beneficiary_distinct_payers_24h::DOUBLE AS beneficiary_distinct_payers_24h,
    beneficiary_dwell_seconds::DOUBLE AS pass_through_dwell_seconds, CAST((e * 17) % 50 AS DOUBLE) / 200 - 0.05e0 AS in_out_skew, CAST(e % 10 AS DOUBLE) / 8 - 1e0 AS first_credit_source_concentration FROM pay"""


@query("beneficiary_component", f"""WITH {payments_sql("beneficiary_dwell_seconds", "beneficiary_account_age_days", "beneficiary_distinct_payers_24h")}, f AS ({_FIVE})
    SELECT event_id, round(({" + ".join(f"CASE WHEN {n} > -1 THEN least(greatest({x.replace('v', n, 1) if x == 'v' else x.replace('v ', n + ' ')}, 0), 1) ELSE 0 END" for n, x in _SHAPES.items())}) / 5, 9) + 0e0 AS component FROM f""")
def _component(spark, sf):
    """All five terms: skew, dwell, account age, payers and source concentration."""
    e = F.substring("event_id", 2, 20).cast("long")
    rows = payments(spark, sf).withColumnRenamed("beneficiary_dwell_seconds", "pass_through_dwell_seconds").withColumns({
        "in_out_skew": ((e * 17) % 50).cast("double") / 200 - 0.05, "first_credit_source_concentration": (e % 10).cast("double") / 8 - 1.0})
    return rounded(rows.select("event_id", SC.beneficiary_component(list(_SHAPES)).alias("component")), 9)


@query("incumbent_as_detector", f"""WITH {SCORED_SQL}, x AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1 ELSE s_inc END AS s FROM sc), m AS (SELECT min(s) AS lo, max(s) AS hi FROM x WHERE s > -1)
    SELECT event_id, round(CASE WHEN s > -1 THEN (s - lo) / (hi - lo) ELSE 0 END, 9) AS detector FROM x, m""")
def _detector(spark, sf):
    rows = scored(spark, sf).withColumn("s", F.when(c("event_id") % 7 == 0, -1.0).otherwise(c("s_inc")))
    return rounded(SC.incumbent_as_detector(rows, "s").select("event_id", "detector"), 9)


VIEW = "payee_psp"
TREES = G.TreeConfig(rate=0.2, patience=8)  # four times the default step: a fourth of the passes
_HELD: dict[tuple, object] = {}  # the view's features and the model fitted on them, once per application and folder


def held(name, spark, sf, make):
    key = (name, spark.sparkContext.applicationId, sf)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def view_rows(spark, sf):
    """Every feature of the view, the truth, and labels of which a third of the others is known to be negative."""
    def make():
        prep = prepared(spark, sf)
        e = F.substring("event_id", 2, 20).cast("long")
        rows = FE.build_features(prep, stats_for(prep), C.features_for_view(VIEW), carry=["oracle_is_attack", "day_index"])
        return cut(rows.withColumns({"truth": c("oracle_is_attack").cast("int"), "y": F.when(c("oracle_is_attack"), 1).when(e % 3 == 0, 0).otherwise(-1)}))
    return held("view", spark, sf, make)


def fitted(spark, sf):
    """Default rounds on all rows of the first 18 days, stopped on the average precision of the next three."""
    def make():
        rows = view_rows(spark, sf)
        train = SC.pu_expand(rows.filter("day_index < 18"), 0.05).withColumn("held", F.lit(False))
        valid = rows.filter("day_index >= 18 and day_index < 21").withColumns({"y_fit": c("truth"), "w": F.lit(1.0), "held": F.lit(True)})
        return G.fit(train.unionByName(valid), C.features_for_view(VIEW), valid="held", config=TREES, balance=False)
    return held("trees", spark, sf, make)


def later(spark, sf):
    return view_rows(spark, sf).filter("day_index >= 21").withColumn("y", c("truth"))


@query("boosted_trees")
def _trees(spark, sf):
    """AUC of the days after those the trees were fitted and stopped on."""
    return M.roc_auc(G.predict(fitted(spark, sf), later(spark, sf)), "g1")


@query("attribution_topk")
def _attribution(spark, sf):
    """The five largest Shapley values of every actioned event; with the rest and the base they add up to the margin."""
    model = fitted(spark, sf)
    return G.attributions(model, G.predict(model, later(spark, sf)).filter("g1 >= 0.5"), 5)


@query("feature_importance")
def _importance(spark, sf):
    return G.importance(fitted(spark, sf), spark)


@query("undersampled_trees")
def _undersampled(spark, sf):
    """Trees on half of the known negatives, with the prior put right again: mean probability against the share of attacks."""
    rows = view_rows(spark, sf)
    known = rows.filter("day_index < 21 and y >= 0").withColumns({"y_fit": c("y"), "w": F.lit(1.0)})
    model = G.fit(SC.undersample(known, 0.5), C.features_for_view(VIEW), config=G.replace(TREES, rounds=12, rate=0.2), balance=False)
    out = G.predict(model, rows.filter("day_index >= 21 and y >= 0")).withColumn("p", SC.prior_corrected(c("g1"), F.lit(0.5)))
    return out.agg(F.avg("g1").alias("mean_raw"), F.avg("p").alias("mean_corrected"), F.avg("y").alias("share_attacks"), F.count(F.lit(1)).alias("n"))


@query("replica_metrics")
def _replica(spark, sf):
    """The trees against the naive replica (random split, unlabelled as negative) on rows neither has seen, and on all."""
    rows = SC.train_baseline(view_rows(spark, sf))
    naive = rows.filter("in_train").withColumns({"y_fit": F.greatest(c("y"), F.lit(0)), "w": F.lit(1.0)})
    replica = G.fit(naive, C.features_for_view(VIEW), config=G.replace(TREES, rounds=12, rate=0.2))
    out = G.predict(replica, G.predict(fitted(spark, sf), rows.filter("day_index >= 21").withColumn("y", c("truth"))), "replica")
    return M.head_to_head(out, ["g1", "replica"], c("in_train"), 0.05)
