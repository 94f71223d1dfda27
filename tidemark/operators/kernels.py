"""The kernel operators: one causal or population column each, as a DataFrame function.

All take an event frame with a time column ``ts_us`` (long, microseconds) and a unique ``event_id``
that breaks ties, and return it with the named columns added.  -1 marks "no history"; rows with a
blank key take the fill value of the operator.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.timeline import WINDOWS, Timeline, novelty, trailing_distinct, trailing_max
from tidemark.plans.blocks import blank
from tidemark.plans.ordered import Running, ordered
from tidemark.plans.values import exact_quantiles, lookup, pct_rank, settled

__all__ = [
    "prev_value", "trailing_count", "trailing_sum", "trailing_mean_std", "trailing_max_value", "trailing_median",
    "trailing_distinct_multi", "trailing_distinct_approx", "trailing_count_where", "rolling_cv", "rolling_entropy",
    "run_length", "novelty", "running_distinct", "last_true_ts", "first_seen_ts", "modal_value",
    "shared_entity_count", "running_herfindahl", "pct_rank", "pct_rank_or_sentinel", "group_entropy",
    "prepare", "keyed", "shrunk_prior", "group_median", "velocity_panel",
]


def prev_value(df: DataFrame, key: str, value: Column, out: str, fill=-1.0) -> DataFrame:
    """Value on the previous row of the key."""
    built = Timeline(df, key).prev(out, value).build()
    return built.withColumn(out, F.when(~blank(df, [key]), F.coalesce(F.col(out), F.lit(fill))).otherwise(F.lit(fill)))


def trailing_count(df: DataFrame, key: str, seconds: float, out: str) -> DataFrame:
    return Timeline(df, key).trailing_count(out, seconds).build()


def trailing_sum(df: DataFrame, key: str, value: Column, seconds: float, out: str) -> DataFrame:
    return Timeline(df, key).trailing_sum(out, value, seconds).build()


def add_moments(t: Timeline, name: str, value: Column, seconds: float, squares: bool = False) -> Timeline:
    """Register the trailing count and sum (and sum of squares) behind a mean or deviation."""
    value = value.cast("double")
    t.trailing_count(f"__{name}_n", seconds).trailing_sum(f"__{name}_s", value, seconds)
    return t.trailing_sum(f"__{name}_q", value * value, seconds) if squares else t


def mean_of(name: str) -> Column:
    return S.ratio_where(F.col(f"__{name}_s"), F.col(f"__{name}_n"), F.col(f"__{name}_n") > 0)


def std_of(name: str) -> Column:
    n = F.nullif(F.col(f"__{name}_n"), F.lit(0.0))
    mean = F.col(f"__{name}_s") / n
    var = F.greatest(F.col(f"__{name}_q") / n - mean * mean, F.lit(0.0))
    return F.when(n >= 2, F.sqrt(var)).otherwise(-1.0)


def trailing_mean_std(df: DataFrame, key: str, value: Column, seconds: float, mean: str, std: str) -> DataFrame:
    """Trailing mean (-1 without history) and population deviation (-1 below two values)."""
    built = add_moments(Timeline(df, key), "m", value, seconds, squares=True).build()
    return built.withColumns({mean: mean_of("m"), std: std_of("m")}).drop("__m_n", "__m_s", "__m_q")


def trailing_max_value(df: DataFrame, key: str, value: Column, seconds: float, out: str) -> DataFrame:
    return trailing_max(df, [key], value, seconds, out).withColumn(out, F.coalesce(out, F.lit(-1.0)))


def median_in_window(history: str, seconds: float) -> Column:
    """Median of the (ts_us, v) history entries not older than the window; -1 when none is."""
    floor = F.col("ts_us") - int(seconds * 1_000_000)
    recent = F.filter(F.col(history), lambda x: x["v"]["t"] >= floor)
    return F.coalesce(S.array_median(F.transform(recent, lambda x: x["v"]["x"])), F.lit(-1.0))


def median_of_latest(history: str, n: Column) -> Column:
    """Median of the latest ``n`` entries of a history (all, where it holds fewer); -1 when there is none.

    With the trailing count of a window as ``n`` these are the entries inside it: the rows of a window are the latest ones.
    """
    v = F.col(f"{history}.v")
    k = F.least(n.cast("int"), F.size(v))
    return F.coalesce(S.array_median(F.slice(v, F.size(v) - k + 1, k)), F.lit(-1.0))


def stamped(value: Column) -> Column:
    return F.struct(F.col("ts_us").alias("t"), value.cast("double").alias("x"))


def trailing_median(df: DataFrame, key: str, value: Column, seconds: float, out: str, cap: int = 64) -> DataFrame:
    """Median of the latest ``cap`` earlier rows that lie inside the window."""
    built = Timeline(df, key).last_n("__h", stamped(value), cap).build()
    return built.withColumn(out, median_in_window("__h", seconds)).drop("__h")


def trailing_distinct_multi(df: DataFrame, key: str, counterparty: str, windows: Mapping[str, float]) -> DataFrame:
    return trailing_distinct(df, [key], counterparty, dict(windows))


def trailing_distinct_approx(
    df: DataFrame, key: str, counterparty: str, hours: int, out: str, rsd: float = 0.05
) -> DataFrame:
    """Approximate distinct counterparties per key in sliding hours, from mergeable hourly sketches.

    The result has one row per (key, hour): the estimate over that hour and the ``hours - 1`` before.
    """
    live = df.filter(~blank(df, [key, counterparty]))
    lg_k = 12 if rsd <= 0.02 else 10
    hourly = live.groupBy(key, F.floor(F.col("ts_us") / 3_600_000_000).cast("long").alias("hour")).agg(
        F.hll_sketch_agg(counterparty, F.lit(lg_k)).alias("__sk")
    )
    reach = hourly.withColumn("hour", F.explode(F.sequence(F.col("hour"), F.col("hour") + hours - 1)))
    return reach.groupBy(key, "hour").agg(F.hll_sketch_estimate(F.hll_union_agg("__sk")).alias(out))


def trailing_count_where(df: DataFrame, key: str, seconds: float, where: Column, out: str) -> DataFrame:
    """Earlier matching rows in the window, given to matching rows only; -1 on the others."""
    built = Timeline(df, key).trailing_sum(out, S.flag(where), seconds).build()
    return built.withColumn(out, F.when(where & ~blank(df, [key]), F.col(out)).otherwise(-1.0))


def rolling_cv(df: DataFrame, key: str, value: Column, out: str, n: int = 8) -> DataFrame:
    built = Timeline(df, key).last_n("__h", value.cast("double"), n).build()
    return built.withColumn(out, S.array_cv(F.col("__h.v"))).drop("__h")


def rolling_entropy(df: DataFrame, key: str, value: Column, out: str, n: int = 16) -> DataFrame:
    built = Timeline(df, key).last_n("__h", F.coalesce(value.cast("string"), F.lit("")), n).build()
    return built.withColumn(out, S.rolling_entropy(F.col("__h.v"))).drop("__h")


def run_length(df: DataFrame, key: str, cond: Column, out: str) -> DataFrame:
    """How many rows in a row, right before this one, satisfied the condition."""
    placed = Timeline(df, key).running("__pos", "count", F.lit(1)).build().withColumn("__c", F.coalesce(cond, F.lit(False)))
    built = Timeline(placed, key).last_where("__miss", ~F.col("__c"), F.col("__pos")).build()
    run = F.col("__pos") - F.coalesce(F.col("__miss") + 1, F.lit(0))
    return built.withColumn(out, F.when(blank(df, [key]), 0.0).otherwise(run.cast("double"))).drop("__pos", "__c", "__miss")


def running_distinct(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Distinct values seen strictly before the row."""
    seen = novelty(df, [key], [value], "__new")
    return Timeline(seen, key).running(out, "sum", F.col("__new")).build().drop("__new")


def last_true_ts(df: DataFrame, key: str, cond: Column, out: str) -> DataFrame:
    """Epoch seconds of the latest earlier row where the condition held, else -1."""
    built = Timeline(df, key).last_where(out, cond, F.col("ts_us") / 1_000_000.0).build()
    return built.withColumn(out, F.coalesce(out, F.lit(-1.0)))


def first_seen_ts(df: DataFrame, key: str, out: str) -> DataFrame:
    """Epoch seconds of the key's first row (its own time on that row)."""
    built = Timeline(df, key).running(out, "min", F.col("ts_us"), inclusive=True).build()
    return built.withColumn(out, F.when(blank(df, [key]), -1.0).otherwise(F.col(out) / 1_000_000.0))


def modal_table(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Most frequent value per key over all history; the one seen first wins a tie."""
    counts = df.filter(~blank(df, [key])).groupBy(key, F.coalesce(F.col(value), F.lit("")).alias("__v")).agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct("ts_us", "event_id")).alias("__at")
    )
    top = counts.groupBy(key).agg(F.max("__n").alias("__n"))
    best = lookup(counts, top.withColumnRenamed("__n", "__top"), [key], "__v").filter(F.col("__n") == F.col("__top"))
    return best.groupBy(key).agg(F.min_by("__v", "__at").alias(out))


def modal_value(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    return lookup(df, modal_table(df, key, value, out), [key], "event_id").withColumn(out, F.coalesce(out, F.lit("")))


def shared_entity_count(df: DataFrame, key: str, entity: str, out: str) -> DataFrame:
    """Distinct entities that ever used the key (blank entity counts as one); -1 for a blank key."""
    table = df.filter(~blank(df, [key])).groupBy(key).agg(
        F.countDistinct(F.coalesce(F.col(entity), F.lit(""))).cast("double").alias(out)
    )
    return lookup(df, table, [key], "event_id").withColumn(out, F.coalesce(out, F.lit(-1.0)))


def running_herfindahl(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Concentration of the key's earlier values: sum of squared shares, -1 without any.

    The sum of squared counts grows by 2m + 1 when a value seen m times comes again.
    """
    named = df.withColumn("__hv", F.concat(F.lit("v"), F.coalesce(F.col(value).cast("string"), F.lit(""))))
    counted = ordered(named, [key, "__hv"], ["ts_us", "event_id"], {"__m": Running("count", F.lit(1))})
    built = (
        Timeline(counted, key)
        .running("__sq", "sum", 2 * F.col("__m") + 1).running("__t", "count", F.lit(1)).build()
    )
    t = F.col("__t").cast("double")
    return built.withColumn(out, S.ratio_where(F.col("__sq").cast("double"), t * t, t > 0)).drop("__hv", "__m", "__sq", "__t")


def pct_rank_or_sentinel(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Average-tie rank over the rows with a value above -1; -1 on the rest."""
    marked = df.withColumn("__live", F.coalesce(value > -1.0, F.lit(False)))
    ranked = pct_rank(marked, F.when(F.col("__live"), value).otherwise(-1.0), "__r", by=["__live"])
    # A single ranked row gets 0 here, not 0.5.
    alone = marked.agg(F.sum(F.col("__live").cast("int")).alias("__n"))
    joined = ranked.crossJoin(F.broadcast(alone))
    rank = F.when(F.col("__n") <= 1, 0.0).otherwise(F.col("__r"))
    return joined.withColumn(out, F.when(F.col("__live"), rank).otherwise(-1.0)).drop("__live", "__r", "__n")


def group_entropy(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Entropy of the value shares per group over log of the distinct values; 0 for one value."""
    counts = df.groupBy(*by, F.coalesce(F.col(value).cast("string"), F.lit("")).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    n = F.sum("__n")
    # H = ln N - sum(c ln c) / N, so one pass over the counts is enough.
    h = F.ln(n) - F.sum(F.col("__n") * F.ln("__n")) / n
    kinds = F.count(F.lit(1))
    return counts.groupBy(*by).agg(F.when(kinds > 1, h / F.ln(kinds)).otherwise(0.0).alias(out))


def keyed(df: DataFrame) -> DataFrame:
    """Integer time, peer cohort and primary key; expressions only, no shuffle."""
    cohort = F.concat_ws("|", "issuer_id", S.credit_band(F.col("credit_limit_inr")))
    primary = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("cardholder_id", "pan_canonical", "vpa")], F.lit(""))
    return df.withColumns({
        "ts_us": F.round(F.col("ts") * 1_000_000).cast("long"), "_cohort": cohort, "_primary_key": primary,
    })


def prepare(df: DataFrame) -> DataFrame:
    """Derived columns features start from: integer time, peer cohort, primary key, inter-arrival gap."""
    return with_gap(keyed(df))


def gap_of(previous: str) -> Column:
    """Seconds since the previous row's ``ts_us``, -1 without one."""
    return F.coalesce((F.col("ts_us") - F.col(previous)) / 1_000_000.0, F.lit(-1.0))


def with_gap(df: DataFrame) -> DataFrame:
    """Seconds since the primary key's previous row and its log1p, -1 on the first."""
    built = Timeline(df, "_primary_key").prev("__pt", F.col("ts_us")).build()
    return built.withColumn("_inter_arrival", gap_of("__pt")).withColumn(
        "_inter_arrival_log", S.log1p_where(F.col("_inter_arrival"), F.col("_inter_arrival") >= 0)
    ).drop("__pt")


def shrunk_prior(df: DataFrame, key: str, y: Column, out: str, min_n: int = 30) -> DataFrame:
    """Rate per group with at least ``min_n`` labelled rows, shrunk towards the overall rate."""
    known = df.withColumn("__y", y.cast("double")).filter(F.col("__y") >= 0)
    overall = known.agg(F.coalesce(F.avg("__y"), F.lit(0.0)).alias("__g"))
    groups = known.filter(~blank(df, [key])).groupBy(key).agg(
        F.avg("__y").alias("__raw"), F.count(F.lit(1)).alias("__n")
    ).filter(F.col("__n") >= min_n)
    w = F.col("__n") / (F.col("__n") + float(min_n))
    return groups.crossJoin(F.broadcast(overall)).select(key, (w * F.col("__raw") + (1 - w) * F.col("__g")).alias(out))


def group_median(df: DataFrame, key: str, value: Column, out: str, min_n: int = 10) -> DataFrame:
    """Exact median per group with at least ``min_n`` rows of a positive value."""
    live = df.withColumn("__gv", value.cast("double")).filter((F.col("__gv") > 0) & ~blank(df, [key]))
    mids = exact_quantiles(live, F.col("__gv"), [0.5], by=[key]).select(key, F.col("value").alias(out))
    sizes = live.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_n)
    return mids.join(sizes, key).drop("__n")


def pct_ranks(df: DataFrame, columns: Sequence[str], by: Sequence[str], tie: str, suffix: str = "_pct") -> DataFrame:
    """Cohort percentile ranks of many columns in one long pass: ``tie`` plus one column each.

    The columns are unpivoted, so value counts, their running sums and the lookup back run once for
    all of them instead of once per column.
    """
    long = df.select(
        tie, *by,
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)
        ])).alias("__e"),
    ).select(tie, *by, F.col("__e.f").alias("__f"), F.col("__e.x").alias("__x"))
    ranked = pct_rank(long, F.col("__x"), "__r", by=["__f", *by], tie=tie)
    return ranked.groupBy(tie).agg(
        *[F.max(F.when(F.col("__f") == i, F.col("__r"))).alias(c + suffix) for i, c in enumerate(columns)]
    )


def velocity_panel(
    df: DataFrame,
    keys: Mapping[str, str],
    amount: str = "amount_inr",
    cohort: str = "_cohort",
    windows: Sequence[str] = tuple(WINDOWS),
    distinct: bool = True,
    encodings: bool = True,
) -> list[DataFrame]:
    """Trailing activity per key and window, as ratio to the key's own 30-day rate and cohort rank.

    ``keys`` maps a key column to its counterparty column.  Returns narrow frames keyed by
    ``event_id``; joining them is left to the caller, who knows which columns are wanted.
    """
    frames = []
    for key, cp in keys.items():
        slim = df.select("event_id", "ts_us", key, cohort, F.col(amount).alias("__amt"), F.col(cp).alias("__cp"))
        if encodings:
            t = Timeline(slim, key)
            for w in dict.fromkeys([*windows, "30d"]):
                t.trailing_count(f"{key}_{w}_count", WINDOWS[w])
                t.trailing_sum(f"{key}_{w}_amount_sum", F.col("__amt"), WINDOWS[w])
            raw = settled(t.build())  # ranks and ratios read it
            scale = {w: WINDOWS[w] / WINDOWS["30d"] for w in windows}
            had = F.col(f"{key}_30d_count") > 0
            ratios = [
                F.when(had, F.col(f"{key}_{w}_{s}") / F.greatest(F.col(f"{key}_30d_{s}") * scale[w], F.lit(1e-9)))
                .otherwise(-1.0).alias(f"vel_{key}_{w}_{s}_ratio")
                for w in windows for s in ("count", "amount_sum")
            ]
            stats = [f"{key}_{w}_{s}" for w in windows for s in ("count", "amount_sum")]
            frames.append(raw.select("event_id", *ratios))
            named = raw.select("event_id", cohort, *[F.col(s).alias(f"vel_{s}") for s in stats])
            frames.append(pct_ranks(named, [f"vel_{s}" for s in stats], [cohort], "event_id"))
        if distinct:
            counted = trailing_distinct(
                slim.drop("__amt", cohort), [key], "__cp",
                {f"vel_{key}_{w}_distinct_counterparty": WINDOWS[w] for w in windows},
            )
            frames.append(counted.select("event_id", *[f"vel_{key}_{w}_distinct_counterparty" for w in windows]))
    return frames
