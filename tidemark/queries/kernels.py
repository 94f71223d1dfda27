"""Kernel operators on the activity stream; the SQL twins work on explicit (row, earlier row) pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import kernels as K
from tidemark.operators.timeline import WINDOWS, novelty
from tidemark.plans.blocks import over_cores
from tidemark.plans.values import exact_quantiles, pct_rank
from tidemark.queries.registry import PAIRS_SQL, STREAM_SQL, epoch_us, query, rounded, stream, table

DAY = 86_400
W24, W7, W30 = (f"b_ts >= pr.ts_us - {s * 1_000_000}" for s in (DAY, 7 * DAY, 30 * DAY))


def per_row(agg: str, outer: str = "", where: str = "TRUE", out: str = "*") -> str:
    """SQL: aggregate each row's earlier rows and keep rows without any."""
    return f"""WITH {PAIRS_SQL},
    x AS (SELECT event_id, {agg} FROM pr WHERE {where} GROUP BY event_id)
    SELECT ev.event_id, {outer} FROM ev LEFT JOIN x ON ev.event_id = x.event_id"""


@query("prev_value", per_row("max(CASE WHEN back = 1 THEN b_amt END) AS v", "coalesce(v, -1.0) AS prev_amt"))
def _prev(spark, sf):
    return K.prev_value(stream(spark, sf), "k1", F.col("amt"), "prev_amt").select("event_id", "prev_amt")


@query("trailing_count", per_row("count(*) AS n", "CAST(coalesce(n, 0) AS DOUBLE) AS n_24h", W24))
def _count(spark, sf):
    return K.trailing_count(stream(spark, sf), "k1", DAY, "n_24h").select("event_id", "n_24h")


@query("trailing_sum", per_row("sum(b_amt) AS s", "round(coalesce(s, 0), 4) AS s_7d", W7))
def _sum(spark, sf):
    return rounded(K.trailing_sum(stream(spark, sf), "k1", F.col("amt"), 7 * DAY, "s_7d").select("event_id", "s_7d"), 4)


@query("trailing_mean_std", per_row(
    "avg(b_amt) AS m, CASE WHEN count(*) >= 2 THEN stddev_pop(b_amt) END AS d",
    "round(coalesce(m, -1), 4) AS mean_7d, round(coalesce(d, -1), 4) AS std_7d", W7))
def _mean_std(spark, sf):
    out = K.trailing_mean_std(stream(spark, sf), "k1", F.col("amt"), 7 * DAY, "mean_7d", "std_7d")
    return rounded(out.select("event_id", "mean_7d", "std_7d"), 4)


@query("trailing_max", per_row("max(b_amt) AS m", "coalesce(m, -1.0) AS max_7d", W7))
def _max(spark, sf):
    return K.trailing_max_value(stream(spark, sf), "k1", F.col("amt"), 7 * DAY, "max_7d").select("event_id", "max_7d")


@query("trailing_median_64", per_row(
    "median(b_amt) AS m", "round(coalesce(m, -1), 6) AS median_30d", f"back <= 64 AND {W30}"))
def _median(spark, sf):
    out = K.trailing_median(stream(spark, sf), "k1", F.col("amt"), 30 * DAY, "median_30d")
    return rounded(out.select("event_id", "median_30d"))


@query("trailing_distinct", f"""WITH {PAIRS_SQL}, x AS (SELECT event_id,
    {", ".join(f"count(DISTINCT CASE WHEN b_ts >= ts_us - {s * 1000000} THEN nullif(b_cp, '') END) AS d_{w}" for w, s in WINDOWS.items())}
    FROM pr GROUP BY event_id)
    SELECT ev.event_id, {", ".join(f"CAST(coalesce(d_{w}, 0) AS DOUBLE) AS d_{w}" for w in WINDOWS)}
    FROM ev LEFT JOIN x ON ev.event_id = x.event_id""")
def _distinct(spark, sf):
    out = K.trailing_distinct_multi(stream(spark, sf), "k1", "cp", {f"d_{w}": s for w, s in WINDOWS.items()})
    return out.select("event_id", *[f"d_{w}" for w in WINDOWS])


@query("trailing_distinct_approx")
def _distinct_approx(spark, sf):
    return K.trailing_distinct_approx(stream(spark, sf), "k1", "cp", 24, "distinct_24h")


@query("trailing_count_where", f"""WITH {PAIRS_SQL},
    x AS (SELECT event_id, count(*) AS n FROM pr WHERE b_hit AND {W7} GROUP BY event_id)
    SELECT ev.event_id, CASE WHEN ev.hit AND ev.k1 <> '' THEN CAST(coalesce(n, 0) AS DOUBLE) ELSE -1.0 END AS n_hits
    FROM ev LEFT JOIN x ON ev.event_id = x.event_id""")
def _count_where(spark, sf):
    return K.trailing_count_where(stream(spark, sf), "k1", 7 * DAY, F.col("hit"), "n_hits").select("event_id", "n_hits")


@query("rolling_cv", per_row(
    "CASE WHEN count(*) >= 3 AND abs(avg(b_amt)) > 1e-12 THEN stddev_pop(b_amt) / avg(b_amt) END AS c",
    "round(coalesce(c, -1), 6) AS cv_8", "back <= 8"))
def _cv(spark, sf):
    return rounded(K.rolling_cv(stream(spark, sf), "k1", F.col("amt"), "cv_8").select("event_id", "cv_8"))


@query("rolling_entropy", f"""WITH {PAIRS_SQL},
    c AS (SELECT event_id, b_cp, count(*) AS n FROM pr WHERE back <= 16 GROUP BY ALL),
    t AS (SELECT event_id, sum(n) AS t, count(*) AS kinds FROM c GROUP BY event_id),
    x AS (SELECT c.event_id, max(t) AS t, max(kinds) AS kinds, -sum(n / t * ln(n / t)) AS h
          FROM c JOIN t ON c.event_id = t.event_id GROUP BY c.event_id)
    SELECT ev.event_id, round(CASE WHEN t >= 3 THEN h / ln(greatest(kinds, 2)) ELSE -1 END, 6) + 0.0 AS h_16
    FROM ev LEFT JOIN x ON ev.event_id = x.event_id""")
def _entropy(spark, sf):
    return rounded(K.rolling_entropy(stream(spark, sf), "k1", F.col("cp"), "h_16").select("event_id", "h_16"))


@query("run_length", per_row(
    "count(*) AS n, min(CASE WHEN NOT b_hit THEN back END) AS stop",
    "CAST(coalesce(stop - 1, n, 0) AS DOUBLE) AS run"))
def _run(spark, sf):
    return K.run_length(stream(spark, sf), "k1", F.col("hit"), "run").select("event_id", "run")


@query("novelty", f"""WITH {PAIRS_SQL},
    x AS (SELECT DISTINCT event_id, b_cp FROM pr)
    SELECT ev.event_id, CASE WHEN ev.k1 <> '' AND x.event_id IS NULL THEN 1e0 ELSE 0e0 END AS is_new
    FROM ev LEFT JOIN x ON ev.event_id = x.event_id AND ev.cp = x.b_cp""")
def _novelty(spark, sf):
    return novelty(stream(spark, sf), ["k1"], ["cp"], "is_new").select("event_id", "is_new")


@query("running_distinct", per_row("count(DISTINCT b_cp) AS n", "CAST(coalesce(n, 0) AS DOUBLE) AS n_seen"))
def _running_distinct(spark, sf):
    return K.running_distinct(stream(spark, sf), "k1", "cp", "n_seen").select("event_id", "n_seen")


@query("last_true_ts", per_row(
    "max(CASE WHEN b_hit THEN b_ts END) AS t", "coalesce(t / 1000000.0, -1.0) AS last_hit"))
def _last_true(spark, sf):
    return K.last_true_ts(stream(spark, sf), "k1", F.col("hit"), "last_hit").select("event_id", "last_hit")


@query("first_seen_ts", f"""WITH {STREAM_SQL}
    SELECT event_id, CASE WHEN k1 = '' THEN -1.0 ELSE min(ts_us) OVER (PARTITION BY k1) / 1000000.0 END AS first_seen FROM ev""")
def _first_seen(spark, sf):
    return K.first_seen_ts(stream(spark, sf), "k1", "first_seen").select("event_id", "first_seen")


@query("modal_value", f"""WITH {STREAM_SQL},
    c AS (SELECT k1, cp, count(*) AS n, min((ts_us, event_id)) AS seen FROM ev WHERE k1 <> '' GROUP BY k1, cp),
    m AS (SELECT k1, cp FROM c QUALIFY row_number() OVER (PARTITION BY k1 ORDER BY n DESC, seen) = 1)
    SELECT event_id, coalesce(m.cp, '') AS modal_cp FROM ev LEFT JOIN m ON ev.k1 = m.k1""")
def _modal(spark, sf):
    return K.modal_value(stream(spark, sf), "k1", "cp", "modal_cp").select("event_id", "modal_cp")


@query("shared_entity_count", f"""WITH {STREAM_SQL},
    c AS (SELECT cp, count(DISTINCT user_id) AS n FROM ev WHERE cp <> '' GROUP BY cp)
    SELECT event_id, coalesce(CAST(n AS DOUBLE), -1.0) AS n_users FROM ev LEFT JOIN c ON ev.cp = c.cp""")
def _shared(spark, sf):
    df = stream(spark, sf).withColumn("u", F.col("user_id").cast("string"))
    return K.shared_entity_count(df, "cp", "u", "n_users").select("event_id", "n_users")


@query("running_herfindahl", f"""WITH {PAIRS_SQL},
    c AS (SELECT event_id, b_cp, count(*) AS n FROM pr GROUP BY ALL),
    x AS (SELECT event_id, sum(n * n) / (sum(n) * sum(n)) AS h FROM c GROUP BY event_id)
    SELECT ev.event_id, round(coalesce(h, -1), 6) AS hhi FROM ev LEFT JOIN x ON ev.event_id = x.event_id""")
def _herfindahl(spark, sf):
    return rounded(K.running_herfindahl(stream(spark, sf), "k1", "cp", "hhi").select("event_id", "hhi"))


RANK_SQL = f"""WITH {STREAM_SQL}, x AS (SELECT *, CAST(round(amt, 0) AS DOUBLE) AS r FROM ev)
    SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY cohort) <= 1 THEN 0.5 ELSE
      (rank() OVER (PARTITION BY cohort ORDER BY r) - 1 + (count(*) OVER (PARTITION BY cohort, r) - 1) / 2.0)
      / (count(*) OVER (PARTITION BY cohort) - 1) END, 9) AS pct FROM x"""


@query("pct_rank_in_cohort", RANK_SQL)
def _pct(spark, sf):
    return rounded(pct_rank(stream(spark, sf), F.round("amt", 0), "pct", by=["cohort"]).select("event_id", "pct"), 9)


@query("pct_rank_or_sentinel", f"""WITH {STREAM_SQL}, x AS (SELECT *, CASE WHEN hit THEN amt END AS r FROM ev)
    SELECT event_id, CASE WHEN r IS NULL THEN -1.0 ELSE round(
      (rank() OVER (PARTITION BY r IS NULL ORDER BY r) - 1 + (count(*) OVER (PARTITION BY r) - 1) / 2.0)
      / (count(*) OVER (PARTITION BY r IS NULL) - 1), 9) END AS pct FROM x""")
def _pct_sentinel(spark, sf):
    df = stream(spark, sf)
    out = K.pct_rank_or_sentinel(df, F.when(F.col("hit"), F.col("amt")).otherwise(-1.0), "pct")
    return rounded(out.select("event_id", "pct"), 9)


@query("normalised_entropy", f"""WITH {STREAM_SQL},
    c AS (SELECT cohort, cp, count(*) AS n FROM ev GROUP BY cohort, cp),
    t AS (SELECT cohort, sum(n) AS t, count(*) AS kinds FROM c GROUP BY cohort)
    SELECT c.cohort, round(CASE WHEN max(kinds) > 1 THEN -sum(n / t * ln(n / t)) / ln(max(kinds)) ELSE 0 END, 6) AS h
    FROM c JOIN t ON c.cohort = t.cohort GROUP BY c.cohort""")
def _norm_entropy(spark, sf):
    return rounded(K.group_entropy(stream(spark, sf), ["cohort"], "cp", "h"))


@query("ordinal_encode", """SELECT event_id,
    CASE event_type WHEN 'view' THEN 0e0 WHEN 'click' THEN 1e0 WHEN 'purchase' THEN 2e0 ELSE -1e0 END AS step FROM events""")
def _ordinal(spark, sf):
    return table(spark, sf, "events").select("event_id", S.ordinal(F.col("event_type"), ("view", "click", "purchase")).alias("step"))


@query("band_encode", """SELECT o_orderkey, CASE WHEN o_totalprice - 50000 < 0 THEN -1e0 WHEN o_totalprice - 50000 < 50000 THEN 0e0
    WHEN o_totalprice - 50000 < 150000 THEN 1e0 WHEN o_totalprice - 50000 < 300000 THEN 2e0 ELSE 3e0 END AS price_band FROM orders""")
def _band(spark, sf):
    v = F.col("o_totalprice") - 50_000
    return table(spark, sf, "orders").select("o_orderkey", S.band(v, (50_000.0, 150_000.0, 300_000.0)).alias("price_band"))


@query("guarded_ratio", """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(1000.0 / c_acctbal, 6) ELSE -1.0 END AS ratio,
    CASE WHEN c_acctbal >= 0 THEN round(ln(1 + c_acctbal), 6) ELSE -1.0 END AS log_bal FROM customer""")
def _guarded(spark, sf):
    b = F.col("c_acctbal")
    return rounded(table(spark, sf, "customer").select(
        "c_custkey", S.ratio_where(F.lit(1000.0), b, b > 0).alias("ratio"), S.log1p_where(b, b >= 0).alias("log_bal")))


JACCARD_SQL = r"""WITH d AS (SELECT doc_id, source, lang,
      list_distinct(list_filter(string_split_regex(upper(source || ' ' || lang), '\s+'), lambda x: x <> '')) AS a,
      list_distinct(list_filter(string_split_regex(upper(replace(substr(text, 1, strpos(text || chr(10), chr(10)) - 1), 'ß', 'SS')), '\s+'), lambda x: x <> '')) AS b,
      list_distinct(list_filter(string_split_regex(upper(replace(text, 'ß', 'SS')), '\s+'), lambda x: x <> '')) AS c FROM documents)
    SELECT doc_id, round(CASE WHEN len(b) > 0 AND len(c) > 0 THEN len(list_intersect(b, c)) / len(list_distinct(b || c)) ELSE 0 END, 9) AS sim
    FROM d"""


@query("token_jaccard", JACCARD_SQL)
def _jaccard(spark, sf):
    """Overlap of a document's first line with its whole text."""
    docs = over_cores(table(spark, sf, "documents").select("doc_id", "text"))
    head = F.substring_index("text", "\n", 1)
    return rounded(docs.select("doc_id", S.token_jaccard(head, F.col("text")).alias("sim")), 9)


@query("prepare_columns", """WITH o AS (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS pk
      FROM orders JOIN customer ON o_custkey = c_custkey),
    g AS (SELECT *, lag(epoch_us(o_orderdate)) OVER (PARTITION BY pk ORDER BY o_orderdate, o_orderkey) AS p FROM o)
    SELECT o_orderkey AS event_id, c_mktsegment || '|' || CASE WHEN c_acctbal * 30 >= 200000 THEN 'hi' WHEN c_acctbal * 30 >= 50000 THEN 'mid'
      WHEN c_acctbal * 30 >= 0 THEN 'lo' ELSE 'nolimit' END AS cohort,
      CASE WHEN pk = '' OR p IS NULL THEN -1.0 ELSE (epoch_us(o_orderdate) - p) / 1000000.0 END AS gap,
      round(CASE WHEN pk = '' OR p IS NULL THEN -1.0 ELSE ln(1 + (epoch_us(o_orderdate) - p) / 1000000.0) END, 6) AS gap_log FROM g""")
def _prepare(spark, sf):
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    events = orders.select(
        F.col("o_orderkey").alias("event_id"), (epoch_us("o_orderdate") / 1_000_000.0).alias("ts"),
        F.col("c_mktsegment").alias("issuer_id"), (F.col("c_acctbal") * 30).alias("credit_limit_inr"),
        F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("cardholder_id"),
        F.lit("").alias("pan_canonical"), F.lit("").alias("vpa"),
    )
    out = K.prepare(events)
    return rounded(out.select("event_id", F.col("_cohort").alias("cohort"), F.col("_inter_arrival").alias("gap"),
                              F.col("_inter_arrival_log").alias("gap_log")))


@query("shrunk_prior", """WITH y AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1.0 WHEN l_returnflag = 'A' THEN 0.0 END AS y
      FROM lineitem WHERE l_returnflag IN ('R', 'A')), g AS (SELECT avg(y) AS g FROM y)
    SELECT l_suppkey, round(n / (n + 30.0) * raw + (1 - n / (n + 30.0)) * g, 9) AS prior
    FROM (SELECT l_suppkey, avg(y) AS raw, count(*) AS n FROM y GROUP BY l_suppkey HAVING count(*) >= 30), g""")
def _prior(spark, sf):
    flag = F.col("l_returnflag")
    y = F.when(flag == "R", 1.0).when(flag == "A", 0.0).otherwise(-1.0)
    return rounded(K.shrunk_prior(table(spark, sf, "lineitem"), "l_suppkey", y, "prior"), 9)


@query("group_median", """SELECT l_suppkey, round(median(l_extendedprice / l_quantity), 6) AS mid FROM lineitem
    WHERE l_extendedprice / l_quantity > 0 GROUP BY l_suppkey HAVING count(*) >= 10""")
def _median_group(spark, sf):
    ratio = F.col("l_extendedprice") / F.col("l_quantity")
    return rounded(K.group_median(table(spark, sf, "lineitem"), "l_suppkey", ratio, "mid"))


@query("exact_quantiles", """SELECT cohort, CAST(i AS INTEGER) AS q_idx, round(v, 6) AS value FROM (
      SELECT event_type AS cohort, unnest([0, 1, 2, 3]) AS i, unnest(quantile_cont(value * 0.731058578630, [0.1, 0.5, 0.9, 0.999])) AS v
      FROM events GROUP BY event_type)""")
def _quantiles(spark, sf):
    out = exact_quantiles(stream(spark, sf), F.col("amt"), [0.1, 0.5, 0.9, 0.999], by=["cohort"])
    return rounded(out.select("cohort", "q_idx", "value"))


def panel(df, windows=("24h",)):
    """Ratio, percentile and distinct columns of one key, joined on the event."""
    named = df.withColumnRenamed("amt", "amount_inr").withColumnRenamed("cohort", "_cohort")
    frames = K.velocity_panel(named, {"k1": "cp"}, windows=windows)
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, "event_id")
    return out


PANEL_SQL = f"""WITH {PAIRS_SQL}, x AS (SELECT event_id, count(*) AS n30, sum(b_amt) AS s30,
      count(*) FILTER (b_ts >= ts_us - 86400000000) AS n1, coalesce(sum(b_amt) FILTER (b_ts >= ts_us - 86400000000), 0) AS s1,
      count(DISTINCT nullif(b_cp, '')) FILTER (b_ts >= ts_us - 86400000000) AS d1
      FROM pr WHERE b_ts >= ts_us - 2592000000000 GROUP BY event_id),
    y AS (SELECT ev.event_id, cohort, coalesce(n30, 0) AS n30, coalesce(s30, 0) AS s30, coalesce(n1, 0) AS n1,
      coalesce(s1, 0) AS s1, coalesce(d1, 0) AS d1 FROM ev LEFT JOIN x ON ev.event_id = x.event_id),
    r AS (SELECT *, count(*) OVER (PARTITION BY cohort) AS t,
      rank() OVER (PARTITION BY cohort ORDER BY n1) - 1 + (count(*) OVER (PARTITION BY cohort, n1) - 1) / 2.0 AS rn FROM y)
    SELECT event_id, round(CASE WHEN n30 > 0 THEN n1 / greatest(n30 / 30.0, 1e-9) ELSE -1 END, 6) AS count_ratio,
      round(CASE WHEN n30 > 0 THEN s1 / greatest(s30 / 30.0, 1e-9) ELSE -1 END, 6) AS sum_ratio,
      round(rn / (t - 1), 9) AS count_pct, CAST(d1 AS DOUBLE) AS n_distinct FROM r"""


@query("velocity_panel", PANEL_SQL)
def _panel(spark, sf):
    out = panel(stream(spark, sf))
    p = "vel_k1_24h_"
    return rounded(out.select(
        "event_id", F.col(p + "count_ratio").alias("count_ratio"), F.col(p + "amount_sum_ratio").alias("sum_ratio"),
        F.col(p + "count_pct").alias("count_pct"), F.col(p + "distinct_counterparty").alias("n_distinct"),
    ), 6, count_pct=9)


@query("unusual_activity_top", PANEL_SQL.rsplit("SELECT event_id", 1)[0] + """
    SELECT event_id, round(CASE WHEN n30 > 0 THEN n1 / greatest(n30 / 30.0, 1e-9) ELSE -1 END, 6) AS count_ratio,
      round(rn / (t - 1), 9) AS count_pct FROM r ORDER BY count_ratio DESC, event_id LIMIT 100""")
def unusual_activity(spark, sf):
    """Events whose last day is furthest above their key's own 30-day rate: a top-100 report."""
    out = panel(stream(spark, sf))
    p = "vel_k1_24h_"
    shaped = rounded(out.select("event_id", F.col(p + "count_ratio").alias("count_ratio"),
                                F.col(p + "count_pct").alias("count_pct")), 6, count_pct=9)
    return shaped.orderBy(F.desc("count_ratio"), "event_id").limit(100)
