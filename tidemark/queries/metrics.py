"""Evaluation metrics over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.queries.registry import query, rounded
from tidemark.queries.scored import SCORED_SQL, scored

KNOWN = f"{SCORED_SQL}, kn AS (SELECT * FROM sc WHERE y IN (0, 1))"
Z = 1.959963984540054


def curve_sql(score: str = "score", by: str = "1") -> str:
    """CTEs: per distinct score and group, cumulative counts from the top."""
    return f"""g AS (SELECT {by} AS grp, {score} AS s, sum(y) AS pos, sum(1 - y) AS neg FROM kn GROUP BY 1, 2),
    cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY grp) AS P, sum(neg) OVER (PARTITION BY grp) AS N
      FROM g WINDOW w AS (PARTITION BY grp ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


AUC = "CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - fp + neg / 2.0)) / (max(P) * max(N)) END"
AP = "CASE WHEN max(P) > 0 THEN sum(pos * tp / (tp + fp)) / max(P) END"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    n = f"CAST({n} AS DOUBLE)"
    p, d = f"({k} / {n})", f"(1 + {Z * Z} / {n})"
    mid = f"(({p} + {Z * Z} / (2 * {n})) / {d})"
    half = f"({Z} * sqrt(greatest({p} * (1 - {p}) / {n} + {Z * Z} / (4 * {n} * {n}), 0)) / {d})"
    return f"greatest(0, {mid} - {half})", f"least(1, {mid} + {half})"


@query("roc_auc", f"WITH {KNOWN}, {curve_sql()} SELECT CAST(max(P) AS BIGINT) AS n_pos, CAST(max(N) AS BIGINT) AS n_neg, round({AUC}, 9) AS roc_auc FROM cu")
def _auc(spark, sf):
    return rounded(M.roc_auc(scored(spark, sf)), 9)


@query("pr_curve", f"WITH {KNOWN}, {curve_sql()} SELECT s AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / P, 9) AS recall FROM cu")
def _pr(spark, sf):
    return rounded(M.pr_curve(scored(spark, sf)), 9)


@query("average_precision", f"WITH {KNOWN}, {curve_sql()} SELECT CAST(max(P) AS BIGINT) AS n_pos, CAST(max(N) AS BIGINT) AS n_neg, round({AP}, 9) AS average_precision FROM cu")
def _ap(spark, sf):
    return rounded(M.average_precision(scored(spark, sf)), 9)


def fpr_sql(target: float, by: str = "1", score: str = "score") -> str:
    """Recall at a pinned false-positive rate by its definition on the sorted negatives."""
    return f"""neg AS (SELECT {by} AS grp, {score} AS s, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC) AS r,
      count(*) OVER (PARTITION BY {by}) AS n, floor({target}e0 * count(*) OVER (PARTITION BY {by})) AS k FROM kn WHERE y = 0),
    kth AS (SELECT grp, max(n) AS n, max(k) AS k, max(s) FILTER (r = greatest(k, 1)) AS t, max(s) AS top FROM neg GROUP BY grp),
    thr AS (SELECT kth.grp, kth.n, k, CASE WHEN k <= 0 THEN top WHEN (SELECT count(*) FROM neg WHERE neg.grp = kth.grp AND s >= t) > k
      THEN coalesce((SELECT min(s) FROM neg WHERE neg.grp = kth.grp AND s > t), t) ELSE t END AS t FROM kth)"""


RECALL = "avg(CASE WHEN (k > 0 AND {s} >= t) OR {s} > t THEN 1 ELSE 0 END) FILTER (y = 1)"
FPR = "avg(CASE WHEN k > 0 AND {s} >= t THEN 1 ELSE 0 END) FILTER (y = 0)"


@query("recall_at_fpr", f"""WITH {KNOWN}, {fpr_sql(0.01)} SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, max(t) AS threshold,
    round({FPR.format(s='score')}, 9) AS realised_fpr, round({RECALL.format(s='score')}, 9) AS recall FROM kn, thr""")
def _recall(spark, sf):
    return rounded(M.recall_at_fpr(scored(spark, sf), 0.01), 9)


_lo, _hi = wilson_sql("hits", "k_effective")


@query("precision_at_k", f"""WITH {KNOWN}, top AS (SELECT y FROM kn ORDER BY score DESC, event_id LIMIT 200), a AS (SELECT count(*) FILTER (y = 1) AS hits, count(*) AS k_effective FROM top)
    SELECT hits, k_effective, round(hits / k_effective, 9) AS precision_at_k, round({_lo}, 9) AS ci_lo, round({_hi}, 9) AS ci_hi, '200 alerts a day' AS k_provenance FROM a""")
def _patk(spark, sf):
    return rounded(M.precision_at_k(scored(spark, sf), 200, "200 alerts a day"), 9)


_plo, _phi = wilson_sql("tp", "greatest(tp + fp, 1)")
_rlo, _rhi = wilson_sql("tp", "greatest(tp + fn, 1)")


@query("confusion_at_threshold", f"""WITH {KNOWN}, x AS (SELECT count(*) FILTER (score >= 0.6 AND y = 1) AS tp, count(*) FILTER (score >= 0.6 AND y = 0) AS fp,
    count(*) FILTER (score < 0.6 AND y = 1) AS fn, count(*) FILTER (score < 0.6 AND y = 0) AS tn FROM kn)
    SELECT tp, fp, fn, tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2e0 * tp / (2 * tp + fp + fn), 9) AS f1, round(fp / (fp + tn), 9) AS fpr,
    round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round({_plo}, 9) AS precision_lo, round({_phi}, 9) AS precision_hi, round({_rlo}, 9) AS recall_lo, round({_rhi}, 9) AS recall_hi FROM x""")
def _confusion(spark, sf):
    return rounded(M.confusion(scored(spark, sf), 0.6), 9)


@query("value_detection", f"""WITH {KNOWN} SELECT round(sum(amount), 2) AS attempted, round(sum(amount) FILTER (score >= 0.6), 2) AS caught,
    round(avg(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END), 9) AS count_recall, round(sum(amount) FILTER (score >= 0.6) / sum(amount), 9) AS vdr FROM kn WHERE y = 1""")
def _vdr(spark, sf):
    return rounded(M.value_detection(scored(spark, sf), 0.6, "amount"), 9, attempted=2, caught=2)


def recall_sql(by: str, name: str, source: str = "sc") -> str:
    lo, hi = wilson_sql("caught", "n_positives")
    return f"""x AS (SELECT {by} AS {name}, count(*) AS n_positives, count(*) FILTER (score >= 0.6) AS caught FROM {source} WHERE y = 1 GROUP BY 1)
    SELECT {name}, n_positives, caught, round(caught / n_positives, 9) AS recall, round({lo}, 9) AS ci_lo, round({hi}, 9) AS ci_hi, n_positives < 20 AS underpowered, caught = 0 AS zero_recall FROM x"""


@query("per_family_recall", f"WITH {SCORED_SQL}, {recall_sql('family', 'family')}")
def _family(spark, sf):
    return rounded(M.recall_by(scored(spark, sf), 0.6, "family"), 9)


@query("recall_by_age", f"WITH {SCORED_SQL}, " + recall_sql("CASE age_band WHEN 0 THEN '0-1d' WHEN 1 THEN '1-7d' WHEN 2 THEN '7-30d' WHEN 3 THEN '30d+' ELSE 'unknown' END", "stratum"))
def _age(spark, sf):
    return rounded(M.recall_by_age(scored(spark, sf), 0.6, "age_band"), 9)


@query("sealed_recall", f"WITH {SCORED_SQL}, " + recall_sql("CASE WHEN sealed THEN 'sealed' ELSE 'trainable' END", "side"))
def _sealed(spark, sf):
    return rounded(M.sealed_recall(scored(spark, sf), 0.6), 9)


_flo, _fhi = wilson_sql("false_positives", "n")
_mde = 100 * (Z + 0.8416212335729143) * (2 * 0.001 * 0.999) ** 0.5


@query("cohort_fpr_mde", f"""WITH {SCORED_SQL}, x AS (SELECT CASE WHEN cohort_tag LIKE 'hb12%' THEN 'hard_benign_12' WHEN cohort_tag LIKE 'hbb%' THEN 'hard_benign_b' ELSE 'ordinary' END AS block, * FROM sc WHERE y <> 1),
    r AS (SELECT block, cohort_tag, count(*) AS n, count(*) FILTER (score >= 0.6) AS false_positives FROM x GROUP BY GROUPING SETS ((block), (block, cohort_tag)))
    SELECT block, cohort_tag, n, false_positives, round(false_positives / n, 9) AS fpr, round({_flo}, 9) AS ci_lo, round({_fhi}, 9) AS ci_hi, round({_mde} / sqrt(n), 9) AS realised_mde_pp FROM r""")
def _cohort(spark, sf):
    return rounded(M.cohort_fpr(scored(spark, sf), 0.6), 9)


@query("per_rail", f"""WITH {KNOWN}, {curve_sql(by='rail')}, {fpr_sql(0.01, 'rail')}, m AS (SELECT grp, CAST(max(P) AS BIGINT) AS n_pos, CAST(max(N) AS BIGINT) AS n_neg, {AUC} AS auc, {AP} AS ap FROM cu GROUP BY grp),
    f AS (SELECT rail, max(t) AS t, {FPR.format(s='score')} AS fpr, {RECALL.format(s='score')} AS rec FROM kn JOIN thr ON rail = thr.grp GROUP BY rail), z AS (SELECT rail, count(*) AS n FROM sc GROUP BY rail)
    SELECT z.rail, n, n_pos, n_neg, round(auc, 9) AS roc_auc, round(ap, 9) AS average_precision, t AS threshold, round(fpr, 9) AS realised_fpr, round(rec, 9) AS recall, n_pos > 0 AND n_neg > 0 AS reportable
    FROM z JOIN m ON z.rail = m.grp JOIN f ON z.rail = f.rail""")
def _rail(spark, sf):
    return rounded(M.per_group(scored(spark, sf), "rail", 0.01), 9)


def _uniform_sql(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 12))::BIGINT / 281474976710656e0)"


def resampled_sql(n: str, text: str) -> str:
    """``metrics.resampled`` for DuckDB."""
    parts = []
    for k, unit in enumerate((1, 16, 256)):
        edges = ", ".join(f"{v!r}e0" if "e" not in repr(v) else repr(v) for v in M._poisson_cdf(unit))
        draw = f"len(list_filter([{edges}], lambda e: e <= {_uniform_sql(f'{text} || {chr(39)}|{k}|{chr(39)} || i')}))"
        parts.append(f"coalesce(list_sum(list_transform(range(1, (({n}) // {unit}) % 16 + 1), lambda i: {draw})), 0)")
    z = " + ".join(_uniform_sql(f"{text} || '|z|{i}'") for i in range(M._HALVES))
    rest = f"(({n}) // 4096 * 4096)"
    return f"({' + '.join(parts)} + CASE WHEN {rest} > 0 THEN greatest(round({rest} + sqrt({rest}) * ({z} - {M._HALVES / 2})), 0) ELSE 0 END)::BIGINT"


_ARMS = ("score", "s_inc", "s_base")
_KEYS = ", ".join(f"{a} AS k{i}" for i, a in enumerate(_ARMS))
_RATES = """cu AS (SELECT *, sum(pos) OVER o - pos AS ap, sum(neg) OVER o - neg AS an, sum(pos) OVER p AS tp, sum(neg) OVER p AS tn FROM cv
      WINDOW o AS (PARTITION BY rep, arm ORDER BY s DESC), p AS (PARTITION BY rep, arm)),
    rc AS (SELECT rep, arm, max(tp) AS n_pos, max(floor(0.01e0 * tn)) AS k, max(ap + pos) FILTER (neg > 0 AND an + neg <= floor(0.01e0 * tn)) AS t, sum(pos) FILTER (an + neg = 0) AS clear,
      arg_max(ap + pos, s) FILTER (neg > 0) AS first FROM cu GROUP BY rep, arm),
    re AS (SELECT rep, arm, CAST(CASE WHEN k > 0 AND t IS NULL THEN first ELSE coalesce(t, clear, 0) END AS DOUBLE) / n_pos AS recall FROM rc)"""


@query("paired_bootstrap", f"""WITH {KNOWN}, ce AS (SELECT y, {_KEYS}, count(*) AS n FROM kn GROUP BY ALL),
    dr AS (SELECT rep, y, k0, k1, k2, {resampled_sql("n", "(y || '|' || k0 || '|' || k1 || '|' || k2 || '|' || rep || '|11')")} AS w FROM ce, (SELECT unnest(range(1, 301)) AS rep)),
    lo AS (SELECT 0 AS rep, y, 1 AS w, unnest(['score', 's_inc', 's_base']) AS arm, unnest([score, s_inc, s_base]) AS s FROM kn
      UNION ALL SELECT rep, y, w, unnest(['score', 's_inc', 's_base']), unnest([k0, k1, k2])::DOUBLE FROM dr WHERE w > 0),
    cv AS (SELECT rep, arm, s, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS neg FROM lo GROUP BY ALL), {_RATES},
    de AS (SELECT o.rep, o.arm, o.recall AS other, m.recall AS ours, m.recall - o.recall AS d FROM re o JOIN re m ON m.rep = o.rep AND m.arm = 'score' WHERE o.arm <> 'score'),
    su AS (SELECT arm, max(ours) FILTER (rep = 0) AS recall_ours, max(other) FILTER (rep = 0) AS recall_other, max(d) FILTER (rep = 0) AS delta,
      quantile_cont(d, 0.025) FILTER (rep > 0) AS lo, quantile_cont(d, 0.975) FILTER (rep > 0) AS hi, count(*) FILTER (rep > 0) AS replicates FROM de GROUP BY arm)
    SELECT arm, round(recall_ours, 9) AS recall_ours, round(recall_other, 9) AS recall_other, round(delta, 9) AS delta, round(lo, 9) AS lo, round(hi, 9) AS hi, replicates,
      CASE WHEN lo <= 0 AND hi >= 0 THEN 'no measured effect' ELSE 'effect' END AS reported_as FROM su""")
def _paired(spark, sf):
    """Three arms on the same rows: ours against the incumbent and against the baseline."""
    return rounded(M.controlled_comparison(scored(spark, sf), "score", ["s_inc", "s_base"], 0.01, replicates=300), 9)


@query("bootstrap_interval", f"""WITH {KNOWN}, ce AS (SELECT CASE WHEN score >= 0.6 THEN 1 ELSE 0 END AS value, count(*) AS n FROM kn WHERE y = 1 GROUP BY 1),
    dr AS (SELECT rep, value, {resampled_sql("n", "((value * 1000000) || '|' || rep || '|7')")} AS w FROM ce, (SELECT unnest(range(1, 401)) AS rep)),
    v AS (SELECT rep, CAST(sum(w * value) AS DOUBLE) / sum(w) AS v FROM dr GROUP BY rep)
    SELECT count(*) AS replicates, round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.5), 9) AS mid, round(quantile_cont(v, 0.975), 9) AS hi FROM v""")
def _bootstrap(spark, sf):
    rows = M.known(scored(spark, sf)).filter("y = 1")
    return rounded(M.bootstrap_interval(rows, F.when(F.col("score") >= 0.6, 1.0).otherwise(0.0), replicates=400), 9)


@query("approval_delta_equal_bps", f"""WITH {KNOWN}, r AS (SELECT quantile_cont(s_inc, 0.9) AS ti, sum(amount) AS total, count(*) AS n FROM kn),
    base AS (SELECT 10000 * sum(CASE WHEN s_inc < ti AND y = 1 THEN amount ELSE 0 END) / max(total) AS bps, avg(CASE WHEN s_inc < ti THEN 1 ELSE 0 END) AS appr FROM kn, r),
    q AS (SELECT unnest(quantile_cont(score, [{', '.join(repr(0.5 + i * (0.4999 / 119)) for i in range(120))}])) AS t, unnest(range(120)) AS i FROM kn),
    z AS (SELECT i, t, 10000 * sum(CASE WHEN score < t AND y = 1 THEN amount ELSE 0 END) / max(total) AS bps, avg(CASE WHEN score < t THEN 1 ELSE 0 END) AS appr FROM kn, q, r GROUP BY i, t),
    b AS (SELECT z.* FROM z, base ORDER BY round(abs(z.bps - base.bps), 9), i LIMIT 1)
    SELECT round(base.bps, 6) AS target_bps, round(b.bps, 6) AS realised_bps, round(base.appr, 9) AS incumbent_approval, round(b.appr, 9) AS our_approval,
    round(100 * (b.appr - base.appr), 6) AS approval_delta_pp FROM base, b""")
def _approval(spark, sf):
    return rounded(M.approval_delta(scored(spark, sf), "score", "s_inc", "amount"), 6, incumbent_approval=9, our_approval=9)


@query("sibling_transfer_recall", f"""WITH {SCORED_SQL}, x AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'EVASION' ELSE 'RAIL' END AS mutated_slot, half AND event_id % 4 = 0 AS cell_crossing, count(*) AS n_positives,
    count(*) FILTER (score >= 0.6) AS caught FROM sc WHERE y = 1 GROUP BY 1, 2)
    SELECT mutated_slot, cell_crossing, n_positives, caught, round(caught / n_positives, 9) AS recall, round({wilson_sql('caught', 'n_positives')[0]}, 9) AS ci_lo, round({wilson_sql('caught', 'n_positives')[1]}, 9) AS ci_hi,
    CASE WHEN cell_crossing AND mutated_slot = 'EVASION' THEN 'headline' WHEN NOT cell_crossing THEN 'same-cell' ELSE 'cross-cell' END AS tier FROM x""")
def _sibling(spark, sf):
    rows = scored(spark, sf).withColumns({"mutated_slot": F.when(F.col("event_id") % 2 == 0, "EVASION").otherwise("RAIL"), "cell_crossing": F.col("half") & (F.col("event_id") % 4 == 0)})
    return rounded(M.sibling_recall(rows, 0.6), 9)


CHANNELS = ("score", "g2_conformal", "g2_density", "sketch", "gate_b", "s_inc")


def channel_sql(ch: str) -> str:
    return f"""SELECT '{ch}' AS channel, * FROM (WITH {curve_sql(ch)}, {fpr_sql(0.01, score=ch)}
      SELECT (SELECT CAST(max(P) AS BIGINT) FROM cu) AS n_pos, (SELECT CAST(max(N) AS BIGINT) FROM cu) AS n_neg, (SELECT {AUC} FROM cu) AS auc, (SELECT {AP} FROM cu) AS ap, {RECALL.format(s=ch)} AS rec FROM kn, thr)"""


@query("channel_metrics", f"WITH {KNOWN}, u AS (" + " UNION ALL ".join(channel_sql(ch) for ch in CHANNELS) + """)
    SELECT channel, n_pos, n_neg, round(auc, 9) AS roc_auc, round(ap, 9) AS average_precision, round(rec, 9) AS recall, round(ap / (n_pos / (n_pos + n_neg)), 9) AS lift FROM u""")
def _channels(spark, sf):
    return rounded(M.channel_metrics(scored(spark, sf), CHANNELS, 0.01), 9)


_VIEWS = {"all": "score", "issuer": "s_base", "acquirer": "s_inc"}


@query("view_ablation", f"WITH {KNOWN}, u AS (" + " UNION ALL ".join(
    f"SELECT '{v}' AS view, (SELECT rec FROM ({channel_sql(s)})) AS recall" for v, s in _VIEWS.items()) + """),
    f AS (SELECT recall AS r FROM u WHERE view = 'all') SELECT view, round(recall, 9) AS recall, round(recall - r, 9) AS delta_vs_full, round(recall / r, 9) AS share_of_full FROM u, f WHERE view <> 'all'""")
def _ablation(spark, sf):
    per = M.channel_metrics(scored(spark, sf).select("y", *[F.col(s).alias(v) for v, s in _VIEWS.items()]), list(_VIEWS), 0.01)
    return rounded(M.view_ablation(per.select(F.col("channel").alias("view"), "recall")), 9)


@query("reportability", f"WITH {SCORED_SQL} SELECT count(*) FILTER (y = 1) AS n_positives, count(*) FILTER (y = 1) >= 100 AS reportable FROM sc")
def _reportable(spark, sf):
    return M.reportable(scored(spark, sf))


@query("union_truth_auc", f"WITH {SCORED_SQL}, kn AS (SELECT score, CASE WHEN is_attack OR sealed AND y = 0 THEN 1 ELSE 0 END AS y FROM sc), {curve_sql()} SELECT CAST(max(P) AS BIGINT) AS n_pos, CAST(max(N) AS BIGINT) AS n_neg, round({AUC}, 9) AS roc_auc FROM cu")
def _union(spark, sf):
    truth = M.union_truth(F.col("is_attack"), F.col("sealed") & (F.col("y") == 0))
    return rounded(M.roc_auc(scored(spark, sf).withColumn("y", truth)), 9)
