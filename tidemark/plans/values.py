"""Work on distinct values instead of rows: ranks, exact quantiles, score curves, salted lookups.

A value table has one row per (group, value) with summed weights; it is built with map-side partial
aggregation, so a mass point costs one row.  Ordered sums over it use block cuts, so neither one
cohort nor the whole table has to fit into one task.

Groups are counted before they are cut, and a salted lookup counts its keys; each count runs the frame's
lineage again.  Where a group can be hot, a value table is therefore written before it is counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.blocks import group_hash, no_hot_group, sized, target_rows
from tidemark.plans.cut import written
from tidemark.plans.ordered import Running, ordered


def _group(by: Sequence[str]) -> Column:
    """Group marker that is never blank: an empty-string cohort is a cohort."""
    return F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("all"))


def hot_values(df: DataFrame, on: Sequence[str]) -> dict[int, int]:
    """Hashes of join keys carried by more rows than one task should get, with the salts each needs.

    Fewer than rows / target are collected.
    """
    if no_hot_group(df):
        return {}
    target = target_rows(df.sparkSession)
    counts = df.select(group_hash(on).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return {r["h"]: -(-r["n"] // target) for r in counts.filter(F.col("n") > target).collect()}


def settled(df: DataFrame) -> DataFrame:
    """The frame as a written table where operators would count its groups, running its lineage each time; else as it is."""
    return df if no_hot_group(df) else written(df)


def told_hot(table: DataFrame, on: Sequence[str], n: str) -> dict[int, int]:
    """``hot_values`` of rows that a value table has counted, without another pass over them."""
    if no_hot_group(table):
        return {}
    target = target_rows(table.sparkSession)
    counts = table.filter(F.col(n) > target).groupBy(group_hash(on).alias("h")).agg(F.sum(n).alias("n"))
    return {r["h"]: -(-r["n"] // target) for r in counts.collect()}


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], tie: str, hot: dict[int, int] | None = None) -> DataFrame:
    """Left join to a table that is unique on ``on``; hot keys of the left side are salted by their counts."""
    on = list(on)
    hot = hot_values(rows, on) if hot is None else hot
    if not hot:
        return rows.join(table, on, "left")
    salts = F.broadcast(rows.sparkSession.createDataFrame(list(hot.items()), "__gh bigint, __salts bigint"))
    marked = lambda df: df.withColumn("__gh", group_hash(on)).join(salts, "__gh", "left").withColumn(
        "__salts", F.coalesce("__salts", F.lit(1).cast("bigint")))
    salted = marked(rows).withColumn("__salt", F.pmod(F.xxhash64(tie), F.col("__salts"))).drop("__gh", "__salts")
    spread = marked(table).withColumn("__salt", F.explode(F.expr("sequence(0L, __salts - 1)"))).drop("__gh", "__salts")
    return salted.join(spread, [*on, "__salt"], "left").drop("__salt")


def value_table(df: DataFrame, by: Sequence[str], value: Column, **weights: Column) -> DataFrame:
    """One row per (group, value): ``__grp``, ``__val`` and the summed weights."""
    base = df.select(_group(by).alias("__grp"), value.cast("double").alias("__val"),
                     *[w.alias(n) for n, w in weights.items()])
    return base.groupBy("__grp", "__val").agg(*[F.sum(n).alias(n) for n in weights])


def below(table: DataFrame, **sums: str) -> DataFrame:
    """Add, per named column, the sum over smaller values of the group."""
    return ordered(table, ["__grp"], ["__val"], {out: Running("sum", F.col(src)) for out, src in sums.items()})


def with_total(table: DataFrame, **sums: str) -> DataFrame:
    totals = table.groupBy("__grp").agg(*[F.sum(src).alias(out) for out, src in sums.items()])
    return lookup(table, totals, ["__grp"], "__val")


def pct_rank(df: DataFrame, value: Column, out: str, by: Sequence[str] = (), tie: str = "event_id") -> DataFrame:
    """Rank in [0, 1] within the group, ties averaged; a group of one ranks 0.5."""
    rows = df.withColumn("__grp", _group(by)).withColumn("__val", value.cast("double"))
    table = settled(value_table(df, by, value, __n=F.lit(1)))
    hot = told_hot(table, ["__grp", "__val"], "__n")
    with sized(table):
        table = with_total(below(table, __less="__n"), __tot="__n")
    rank = F.when(F.col("__tot") <= 1, F.lit(0.5)).otherwise(
        (F.col("__less") + (F.col("__n") - 1) / 2.0) / (F.col("__tot") - 1)
    )
    table = table.select("__grp", "__val", rank.alias(out))
    return lookup(rows, table, ["__grp", "__val"], tie, hot).drop("__grp", "__val")


def rank_against(
    rows: DataFrame, ref: DataFrame, value: Column, ref_value: Column,
    by: Sequence[str] = (), ref_by: Sequence[str] | None = None, tie: str = "event_id", neighbours: bool = False,
) -> DataFrame:
    """Position of each row's value in a stored sample of the same group.

    Adds ``n_less`` and ``n_equal`` (sample values below / equal) and ``n_ref`` (sample size, 0 for a
    group the sample lacks).  With ``neighbours`` also ``ref_prev`` and ``ref_next``, the closest sample
    values below and at-or-above.
    """
    ref_by = by if ref_by is None else ref_by
    stored = value_table(ref, ref_by, ref_value, __n=F.lit(1)).withColumn(
        "__grp", F.struct(*[F.col(f"__grp.{r}").alias(b) for r, b in zip(ref_by, by)]) if by else F.col("__grp")
    )
    asked = value_table(rows, by, value, __n=F.lit(0), __asked=F.lit(1))
    table = settled(stored.withColumn("__asked", F.lit(0).cast("long")).unionByName(asked).groupBy("__grp", "__val").agg(
        F.sum("__n").alias("n_equal"), F.sum("__asked").alias("__asked")))
    hot = told_hot(table, ["__grp", "__val"], "__asked")
    with sized(table):
        table = settled(with_total(below(table.drop("__asked"), n_less="n_equal"), n_ref="n_equal"))
        if neighbours:
            held = F.when(F.col("n_equal") > 0, F.col("__val"))
            table = settled(ordered(table, ["__grp"], ["__val"], {"ref_prev": Running("max", held)}))
            table = ordered(table.withColumn("__neg", -F.col("__val")), ["__grp"], ["__neg"],
                            {"ref_next": Running("min", held, inclusive=True)}).drop("__neg")
    marked = rows.withColumn("__grp", _group(by)).withColumn("__val", value.cast("double"))
    return lookup(marked, table, ["__grp", "__val"], tie, hot).drop("__grp", "__val")


def exact_quantiles(df: DataFrame, value: Column, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles per group: columns of ``by``, ``q_idx``, ``q``, ``value``.

    Works on value counts and their running sums; no group's values are gathered anywhere.
    """
    table = settled(value_table(df, by, value, __n=F.lit(1)).filter(F.col("__val").isNotNull()))
    with sized(table):
        table = with_total(below(table, __less="__n"), __tot="__n")
    first, last = F.col("__less"), F.col("__less") + F.col("__n") - 1
    # Only the few values at a requested rank survive the filter over the (short, literal) grid.
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])
    ranked = F.transform(grid, lambda g: F.struct(g["i"].alias("i"), g["q"].alias("q"), (g["q"] * (F.col("__tot") - 1)).alias("h")))
    picks = F.filter(ranked, lambda g: (F.ceil(g["h"]) >= first) & (F.floor(g["h"]) <= last))
    hits = table.select("__grp", "__val", "__less", "__n", F.explode(picks).alias("p"))
    covers = lambda r: (r >= F.col("__less")) & (r < F.col("__less") + F.col("__n"))
    h = F.col("p.h")
    out = hits.groupBy("__grp", F.col("p.i").alias("q_idx"), F.col("p.q").alias("q")).agg(
        F.max(F.when(covers(F.floor(h)), F.col("__val"))).alias("lo"),
        F.max(F.when(covers(F.ceil(h)), F.col("__val"))).alias("hi"),
        F.max(h - F.floor(h)).alias("t"),
    )
    group = [F.col(f"__grp.{b}").alias(b) for b in by]
    return out.select(*group, "q_idx", "q", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("t")).alias("value"))


def score_curve(df: DataFrame, score: Column, by: Sequence[str] = (), **sums: Column) -> DataFrame:
    """Per distinct score: the summed columns, their sums over higher scores (``above_*``) and totals."""
    table = settled(value_table(df, by, -score, **sums))
    with sized(table):
        table = below(table, **{f"above_{n}": n for n in sums})
        table = settled(with_total(table, **{f"total_{n}": n for n in sums}))
    return table.withColumn("score", F.lit(0.0) - F.col("__val")).select(
        *[F.col(f"__grp.{b}").alias(b) for b in by], "score", *sums,
        *[f"above_{n}" for n in sums], *[f"total_{n}" for n in sums],
    )


def sums_at_or_above(df: DataFrame, value: Column, points: DataFrame, **sums: Column) -> DataFrame:
    """For each row (q_idx, t) of a bounded point table: the sums over rows with ``value >= t``.

    Rows are bucketed by how many points they reach and summed per bucket, so one pass and a table of
    at most points + 1 rows replace a rows-by-points product.
    """
    edges = points.agg(F.array_sort(F.collect_list("t")).alias("__pts"))
    reach = lambda v: F.size(F.filter("__pts", lambda p: p <= v))
    buckets = df.crossJoin(F.broadcast(edges)).groupBy(reach(value).alias("__b")).agg(*[F.sum(s).alias(n) for n, s in sums.items()])
    asked = points.crossJoin(F.broadcast(edges)).withColumn("__r", reach(F.col("t"))).drop("__pts")
    joined = asked.join(F.broadcast(buckets), F.col("__b") >= F.col("__r"), "left")
    return joined.groupBy("q_idx", "t").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums])
