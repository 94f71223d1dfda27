"""Drift signals and fidelity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import drift as D
from tidemark.operators.features import FeatureConfig
from tidemark.operators.timeline import Timeline
from tidemark.plans.cut import written
from tidemark.queries.registry import query, rounded
from tidemark.queries.scored import SCORED_SQL, scored
from tidemark.queries.scores import CONF_SQL, conformal
from tidemark.queries.standin import payments, payments_sql

c = F.col
_F = ("amount_inr", "device_age_days", "response_latency_ms")
_PAY = payments_sql("day_index", "rail", "message_kind", "merchant_id", "mcc", "dow", "pan_canonical", "approved", "mandate_max_amount_inr", "threeds_eci",
                    "threeds_field_population_score", "auth_to_presentment_ratio", "collect_accepted", *_F)
_CUR = "CASE WHEN day_index >= 15 THEN {f} * 1.25e0 ELSE {f} END"


def windows(spark, sf):
    rows = payments(spark, sf)
    later = rows.filter("day_index >= 15")
    return rows.filter("day_index < 15"), later.select(*[(c(f) * 1.25).alias(f) for f in _F]), later


def psi_sql(f: str, factor: str) -> str:
    return f"""SELECT '{f}' AS feature, (WITH e AS (SELECT list_distinct(quantile_cont({f}, [{', '.join(str(i / 10) for i in range(11))}])) AS e FROM pay WHERE day_index < 15), es AS (SELECT list_sort(e) AS e FROM e),
      v AS (SELECT day_index < 15 AS is_ref, CASE WHEN day_index < 15 THEN {f} ELSE {f} * {factor} END AS x FROM pay),
      b AS (SELECT is_ref, CASE WHEN x = e[len(e)] THEN len(e) - 1 ELSE len(list_filter(e, lambda q: q <= x)) END AS bin, len(e) AS m FROM v, es),
      k AS (SELECT * FROM b WHERE bin >= 1 AND bin < m), g AS (SELECT unnest(range(1, (SELECT max(m) FROM b))) AS bin),
      s AS (SELECT g.bin, greatest((SELECT count(*) FROM k WHERE k.bin = g.bin AND is_ref) / (SELECT count(*) FROM k WHERE is_ref), 1e-6) AS r,
        greatest((SELECT count(*) FROM k WHERE k.bin = g.bin AND NOT is_ref) / (SELECT count(*) FROM k WHERE NOT is_ref), 1e-6) AS c FROM g)
      SELECT sum((c - r) * ln(c / r)) FROM s) AS v"""


def psi_all(factor: str) -> str:
    return " UNION ALL ".join(psi_sql(f, factor) for f in _F)


@query("psi", f"WITH {_PAY}, u AS ({psi_all('1.25e0')}) SELECT feature, round(v, 6) AS psi FROM u")
def _psi(spark, sf):
    ref, cur, _ = windows(spark, sf)
    return rounded(D.psi(ref, cur, _F))


@query("conformal_mass_shift", f"""WITH {CONF_SQL}, m AS (SELECT avg(CASE WHEN p <= 0.1 THEN 1 ELSE 0 END) FILTER (event_id % 4 = 1) AS r, avg(CASE WHEN p <= 0.1 THEN 1 ELSE 0 END) FILTER (event_id % 4 = 3) AS c FROM pv)
    SELECT round(r, 9) AS reference_mass, round(c, 9) AS current_mass, round(c - r, 9) AS shift FROM m""")
def _shift(spark, sf):
    p = conformal(spark, sf)
    return rounded(D.conformal_shift(p.filter("event_id % 4 = 1"), p.filter("event_id % 4 = 3"), alpha=0.1), 9)


def probes(spark, sf):
    """Probe scores of four model versions, each a little lower."""
    canary = D.freeze_canaries(scored(spark, sf), "event_id")
    versions = F.explode(F.sequence(F.lit(1), F.lit(4)))
    return canary.withColumn("version", versions).withColumn("probe", c("score") - 0.02 * c("version"))


def hash_sql(salt: str, value: str, digits: int = 15) -> str:
    return f"CAST('0x' || substr(md5('{salt}|' || {value}), 1, {digits}) AS BIGINT)"


_PROBES = f"""pb AS (SELECT event_id, version, score - 0.02e0 * version AS probe FROM (SELECT * FROM sc ORDER BY {hash_sql('canary', 'event_id')}, event_id LIMIT 200), (SELECT unnest([1, 2, 3, 4]) AS version)),
    hi AS (SELECT version, count(*) AS n, avg(probe) AS mean_score, quantile_cont(probe, 0.9) AS p90_score FROM pb GROUP BY version),
    st AS (SELECT *, lag(mean_score) OVER (ORDER BY version) AS before FROM hi),
    hc AS (SELECT count(*) AS n_versions, NOT bool_or(coalesce(mean_score > before + 1e-12, FALSE)) AS monotone_decline, arg_min(mean_score, version) - arg_max(mean_score, version) AS total_drop FROM st),
    cd AS (SELECT *, monotone_decline AND total_drop > 0.02 AND n_versions >= 3 AS detected FROM hc)"""


@query("canary_degradation", f"WITH {SCORED_SQL}, {_PROBES} SELECT n_versions, monotone_decline, round(total_drop, 6) + 0e0 AS total_drop, detected FROM cd")
def _canary(spark, sf):
    return rounded(D.canary_degradation(D.canary_history(probes(spark, sf), "version", "probe"), "version"))


@query("canary_history", f"WITH {SCORED_SQL}, {_PROBES} SELECT version, n, round(mean_score, 6) + 0e0 AS mean_score, round(p90_score, 6) + 0e0 AS p90_score FROM hi")
def _history(spark, sf):
    return rounded(D.canary_history(probes(spark, sf), "version", "probe"))


@query("drift_conjunction", f"""WITH {_PAY}, {CONF_SQL}, {_PROBES},
    d1 AS ({psi_all('1.25e0')}), d0 AS ({psi_all('1e0')}),
    df AS (SELECT count(*) AS n_features, CAST(count(*) FILTER (d1.v >= {D.PSI_LIMIT} AND CASE WHEN d1.v > 1e-9 THEN coalesce(d0.v, 0) / d1.v ELSE 1 END < {D.NULL_EXPLAINED}) AS BIGINT) AS n_unexplained FROM d1 LEFT JOIN d0 USING (feature)),
    ms AS (SELECT avg(CASE WHEN p <= 0.05 THEN 1 ELSE 0 END) FILTER (event_id % 4 = 3) - avg(CASE WHEN p <= 0.05 THEN 1 ELSE 0 END) FILTER (event_id % 4 = 1) AS shift FROM pv),
    fl AS (SELECT n_features, n_unexplained, shift, n_unexplained > 0 AS a, shift >= {D.SHIFT_LIMIT} AS b, detected AS d FROM df, ms, cd)
    SELECT n_features, n_unexplained, round(shift, 6) + 0e0 AS shift, a AS drift_fired, b AS conformal_fired, d AS canary_fired, CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(d AS INTEGER) AS n_signals, a AND b AND d AS fired FROM fl""")
def _conjunction(spark, sf):
    ref, cur, null = windows(spark, sf)
    p = conformal(spark, sf)
    shift = D.conformal_shift(p.filter("event_id % 4 = 1"), p.filter("event_id % 4 = 3"))
    canary = D.canary_degradation(D.canary_history(probes(spark, sf), "version", "probe"), "version")
    return rounded(D.drift_conjunction(D.psi(ref, cur, _F), D.psi(ref, null, _F), shift, canary))


_DIGIT = "CAST(floor(amount_inr / pow(10, floor(log10(greatest(amount_inr, 1))))) AS INTEGER)"
BENFORD_SQL = f"(SELECT sum(abs((SELECT avg(CASE WHEN d = k THEN 1 ELSE 0 END) FROM dg WHERE d BETWEEN 1 AND 9) - log10(1 + 1.0 / k))) FROM (SELECT unnest(range(1, 10)) AS k))"


@query("benford", f"WITH {_PAY}, dg AS (SELECT {_DIGIT} AS d FROM pay WHERE amount_inr > 0) SELECT round({BENFORD_SQL}, 9) AS measured")
def _benford(spark, sf):
    return rounded(D.benford_deviation(payments(spark, sf), "amount_inr"), 9)


@query("weekday_share", f"WITH {_PAY} SELECT dow, count(*) AS n, round(count(*) / (SELECT count(*) FROM pay), 9) AS share FROM pay GROUP BY dow")
def _weekday(spark, sf):
    return rounded(D.weekday_share(payments(spark, sf), "dow"), 9)


@query("expected_weekday_share", f"""WITH {_PAY}, d AS (SELECT DISTINCT day_index AS d, DATE '2026-03-02' + CAST(day_index AS INTEGER) AS dt FROM pay),
    m AS (SELECT (isodow(dt) - 1) AS dow, [0.94, 0.96, 1.00, 1.06, 1.18, 1.24, 1.02][isodow(dt)] * CASE WHEN day(dt) IN (1, 2, 28, 29, 30, 31) THEN 1.35 ELSE 1 END
      * CASE WHEN d BETWEEN 38 AND 44 THEN 1 + 0.9 * (d - 38) / 6.0 WHEN d BETWEEN 45 AND 49 THEN 1 + 0.9 * (1 - (d - 44) / 5.0) ELSE 1 END AS m FROM d)
    SELECT CAST(dow AS INTEGER) AS dow, round(CAST(sum(m) AS DOUBLE) / (SELECT sum(m) FROM m), 9) AS expected_share FROM m GROUP BY dow""")
def _expected(spark, sf):
    return rounded(D.expected_weekday_share(payments(spark, sf), "day_index", FeatureConfig()), 9)


@query("topk_concentration", f"WITH {_PAY}, k AS (SELECT merchant_id, count(*) AS n FROM pay WHERE merchant_id <> '' GROUP BY 1), t AS (SELECT n FROM k ORDER BY n DESC, merchant_id LIMIT 10) SELECT round((SELECT sum(n) FROM t) / (SELECT sum(n) FROM k), 9) AS measured")
def _topk(spark, sf):
    return rounded(D.top_share(payments(spark, sf), "merchant_id"), 9)


def with_gap(rows):
    """``gap_log``: log1p of the seconds since the card's previous event; -1 on its first."""
    gap = (c("ts_us") - c("before")) / 1e6
    placed = Timeline(rows.select("event_id", (c("ts") * 1e6).cast("long").alias("ts_us"), "pan_canonical", "amount_inr"), "pan_canonical").prev("before", c("ts_us")).build()
    return placed.withColumn("gap_log", F.when(gap >= 0, F.log1p(gap)).otherwise(-1.0))


_CHECKED = ("event_id", "ts", "amount_inr", "rail", "mcc", "merchant_id", "threeds_eci", "threeds_field_population_score", "auth_to_presentment_ratio", "message_kind", "collect_accepted", "approved",
            "mandate_max_amount_inr", "pan_canonical", "dow", "day_index")


def checks(spark, sf):
    # Twelve checks read the events some twenty times: the columns they need are derived once, and no plan holds the derivation.
    rows = written(payments(spark, sf).select(*_CHECKED))
    kind, ratio = c("message_kind"), c("auth_to_presentment_ratio")
    parts = [
        D.band_check(D.atom_share(rows, "amount_inr", (100, 200, 500, 1000, 2000, 5000)), "F5-01", "F5", 0.1, 0.5),
        D.band_check(D.benford_deviation(rows, "amount_inr"), "F5-02", "F5", 0.0, 0.6),
        D.band_check(D.top_share(rows.filter(c("rail").startswith("card-c") & (c("rail") != "card-clearing-dispute")), "mcc"), "F5-08", "F5", 0.3, 1.0),
        D.band_check(D.conditional_share(rows, c("threeds_eci") == "authenticated", c("threeds_field_population_score") >= 0, 20), "F3-12", "F3", 0.95, 1.0),
        D.band_check(D.conditional_share(rows, ratio > 0, (ratio >= 0.5) & (ratio <= 2.0), 50), "F3-15", "F3", 0.95, 1.0),
        D.band_check(D.conditional_share(rows, kind == "collect_response", c("collect_accepted"), 20), "F3-18", "F3", 0.4, 0.95),
        D.band_check(D.conditional_share(rows, (kind == "mandate_debit") & c("approved") & (c("mandate_max_amount_inr") > 0), c("amount_inr") <= c("mandate_max_amount_inr"), 10), "F3-20", "F3", 1.0, 1.0),
        D.band_check(D.conditional_share(rows, c("pan_canonical") != "", c("pan_canonical").startswith("999"), 0), "F6-02", "F6", 1.0, 1.0),
        D.band_check(D.bounded_correlation(with_gap(rows).filter("amount_inr > 0 and gap_log > 0"), F.log1p("amount_inr"), c("gap_log")), "F3-10", "F3", 0.0, 0.5),
        D.band_check(D.weekday_peak(rows, "dow", "day_index", FeatureConfig()), "F5-05", "F5", 0.0, 0.0),
        D.band_check(D.payday_share(rows, "day_index", FeatureConfig()), "F5-06", "F5", 0.05, 0.55),
        D.band_check(D.top_share(rows.filter(c("rail").startswith("card-c") & (c("rail") != "card-clearing-dispute")), "merchant_id"), "F5-07", "F5", 0.16, 0.42),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CHECK_SQL = f"""WITH {_PAY}, dg AS (SELECT {_DIGIT} AS d FROM pay WHERE amount_inr > 0), cards AS (SELECT mcc, count(*) AS n FROM pay WHERE rail IN ('card-cnp-3ds', 'card-cnp-keyed', 'card-cp-emv') AND mcc <> '' GROUP BY 1),
    shops AS (SELECT merchant_id, count(*) AS n FROM pay WHERE rail IN ('card-cnp-3ds', 'card-cnp-keyed', 'card-cp-emv') AND merchant_id <> '' GROUP BY 1),
    cal AS (SELECT isodow(dt) - 1 AS dow, [0.94, 0.96, 1.00, 1.06, 1.18, 1.24, 1.02][isodow(dt)] * CASE WHEN day(dt) IN (1, 2, 28, 29, 30, 31) THEN 1.35 ELSE 1 END
      * CASE WHEN d BETWEEN 38 AND 44 THEN 1 + 0.9 * (d - 38) / 6.0 WHEN d BETWEEN 45 AND 49 THEN 1 + 0.9 * (1 - (d - 44) / 5.0) ELSE 1 END AS m FROM (SELECT DISTINCT day_index AS d, DATE '2026-03-02' + CAST(day_index AS INTEGER) AS dt FROM pay)),
    m(chk, gate, measured, lo, hi) AS (
    SELECT 'F5-01', 'F5', avg(CASE WHEN least({', '.join(f'abs(amount_inr - {a})' for a in (100, 200, 500, 1000, 2000, 5000))}) < 0.5 THEN 1 ELSE 0 END), 0.1, 0.5 FROM pay WHERE amount_inr > 0
    UNION ALL SELECT 'F5-02', 'F5', {BENFORD_SQL}, 0, 0.6 UNION ALL SELECT 'F5-08', 'F5', (SELECT sum(n) FROM (SELECT n FROM cards ORDER BY n DESC LIMIT 10)) / (SELECT sum(n) FROM cards), 0.3, 1
    UNION ALL SELECT 'F3-12', 'F3', avg(CASE WHEN threeds_field_population_score >= 0 THEN 1 ELSE 0 END), 0.95, 1 FROM pay WHERE threeds_eci = 'authenticated'
    UNION ALL SELECT 'F3-15', 'F3', avg(CASE WHEN auth_to_presentment_ratio BETWEEN 0.5 AND 2 THEN 1 ELSE 0 END), 0.95, 1 FROM pay WHERE auth_to_presentment_ratio > 0
    UNION ALL SELECT 'F3-18', 'F3', CASE WHEN count(*) > 20 THEN avg(CASE WHEN collect_accepted THEN 1 ELSE 0 END) END, 0.4, 0.95 FROM pay WHERE message_kind = 'collect_response'
    UNION ALL SELECT 'F3-20', 'F3', avg(CASE WHEN amount_inr <= mandate_max_amount_inr THEN 1 ELSE 0 END), 1, 1 FROM pay WHERE message_kind = 'mandate_debit' AND approved AND mandate_max_amount_inr > 0
    UNION ALL SELECT 'F6-02', 'F6', avg(CASE WHEN pan_canonical LIKE '999%' THEN 1 ELSE 0 END), 1, 1 FROM pay WHERE pan_canonical <> ''
    UNION ALL SELECT 'F3-10', 'F3', abs(corr(ln(1 + amount_inr), gap)), 0, 0.5 FROM (SELECT amount_inr, ln(1 + (ts_us - lag(ts_us) OVER (PARTITION BY pan_canonical ORDER BY ts_us, event_id)) / 1e6) AS gap FROM pay WHERE pan_canonical <> '') WHERE amount_inr > 0 AND gap > 0
    UNION ALL SELECT 'F5-05', 'F5', abs((SELECT dow FROM pay GROUP BY dow ORDER BY count(*) DESC, dow LIMIT 1) - (SELECT dow FROM cal GROUP BY dow ORDER BY round(sum(m), 9) DESC, dow LIMIT 1)), 0, 0
    UNION ALL SELECT 'F5-06', 'F5', avg(CASE WHEN day(DATE '2026-03-02' + CAST(day_index AS INTEGER)) IN (1, 2, 28, 29, 30, 31) THEN 1 ELSE 0 END), 0.05, 0.55 FROM pay
    UNION ALL SELECT 'F5-07', 'F5', (SELECT sum(n) FROM (SELECT n FROM shops ORDER BY n DESC LIMIT 10)) / (SELECT sum(n) FROM shops), 0.16, 0.42),
    r AS (SELECT *, CASE WHEN measured IS NULL THEN 'SKIPPED' WHEN measured BETWEEN lo AND hi THEN 'PASS' ELSE 'FAIL' END AS status FROM m)"""


@query("conditional_bands", CHECK_SQL + """ SELECT chk AS "check", gate, round(CAST(measured AS DOUBLE), 6) AS measured, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, status FROM r""")
def _bands(spark, sf):
    return rounded(checks(spark, sf).withColumnRenamed("check", "chk")).withColumnRenamed("chk", "check")


@query("check_summary", CHECK_SQL + """ SELECT gate, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'SKIPPED') AS skipped,
    round(count(*) FILTER (status = 'PASS') / nullif(count(*) FILTER (status <> 'SKIPPED'), 0), 9) AS pass_rate FROM r GROUP BY gate""")
def _summary(spark, sf):
    return rounded(D.summarise_checks(checks(spark, sf)), 9)


_SHUFFLED = ("amount_inr", "device_age_days", "response_latency_ms", "merchant_age_days", "account_age_days", "auth_to_presentment_ratio")
_PLACED = lambda salt, *keep: f"SELECT {', '.join(['event_id', *keep])}, row_number() OVER (ORDER BY {hash_sql(salt, 'event_id')}, event_id) AS pos FROM pay"


@query("shuffled_marginals", f"""WITH {payments_sql(*_SHUFFLED)}, base AS ({_PLACED("base")}), {', '.join(f"x_{n} AS ({_PLACED(n, n)})" for n in _SHUFFLED)}
    SELECT base.event_id, {', '.join(f"round(x_{n}.{n}, 6) + 0e0 AS {n}" for n in _SHUFFLED)} FROM base {' '.join(f"JOIN x_{n} ON x_{n}.pos = base.pos" for n in _SHUFFLED)}""")
def _shuffled(spark, sf):
    """Six columns of the payments, each in an order of its own."""
    return rounded(D.shuffled_marginals(payments(spark, sf), list(_SHUFFLED), "event_id"))


@query("shuffled_control")
def _control(spark, sf):
    """Payments against their column-wise shuffle: the two-sample trees must tell them apart."""
    rows, names = payments(spark, sf).select("event_id", *_SHUFFLED), list(_SHUFFLED)
    return D.discriminator_auc(rows, D.shuffled_marginals(rows, names, "event_id"), names, "event_id")
