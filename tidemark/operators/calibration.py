"""Exact isotonic calibration as the greatest convex minorant of the cumulative label diagram.

One row per distinct score (count, positives).  Ranges of scores build the minorant of their own rows, and minorants are
merged sixteen ranges at a time until one is left: pooling neighbours whose means do not rise is the same in any order.  All
comparisons are in integers.  A knot is the first score of every pool; points where the diagram only touches the minorant
start a pool of their own.  Between knots the value is interpolated, beyond them it is constant.

What a task holds is a minorant: with n rows it has at most about n^(2/3) edges, as their slopes are different fractions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.blocks import sized
from tidemark.plans.cut import written
from tidemark.plans.ordered import Running, ordered
from tidemark.plans.values import lookup, rank_against, settled, value_table
from tidemark.plans.workers import package_on_path

c = F.col
MINIMUM, FAN = 20, 16
_EDGE = "range int, s double, n long, pos long"


def pooled(rows: Iterable[tuple[float, int, int]], edges: list[tuple[float, int, int]] | None = None) -> list[tuple[float, int, int]]:
    """Neighbours (first score, rows, positives) pooled until the share of positives rises from each to the next."""
    out = edges if edges is not None else []
    for s, n, pos in rows:
        while out and out[-1][2] * n >= pos * out[-1][1]:
            s, n, pos = out[-1][0], out[-1][1] + n, out[-1][2] + pos
            out.pop()
        out.append((s, n, pos))
    return out


def _edges(range_: int, rows: list[tuple[float, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array([range_] * len(rows), pa.int32()), *[pa.array(v, t) for v, t in zip(cols, (pa.float64(), pa.int64(), pa.int64()), strict=True)]],
                                      names=["range", "s", "n", "pos"])


def minorant(table: DataFrame) -> DataFrame:
    """(s, n, pos): the edges of the greatest convex minorant of (s, n, pos), by their first score."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[float, int, int]] = []
        at = 0
        for part in batches:
            at = part.column("range")[0].as_py() if part.num_rows else at
            pooled(zip(*[part.column(x).to_pylist() for x in ("s", "n", "pos")], strict=True), out)
        if out:
            yield _edges(at, out)

    def merge(held: pa.Table) -> pa.Table:
        held = held.sort_by("s")
        out = pooled(zip(*[held.column(x).to_pylist() for x in ("s", "n", "pos")], strict=True))
        return pa.Table.from_batches([_edges(held.column("group")[0].as_py(), out)])

    package_on_path(table.sparkSession)
    ranged = table.repartitionByRange("s").withColumn("range", F.spark_partition_id()).sortWithinPartitions("s")
    edges = written(ranged.select("range", "s", "n", "pos").mapInArrow(first, _EDGE))
    ranges = (edges.agg(F.max("range")).first()[0] or 0) + 1
    while ranges > 1:
        edges = written(edges.withColumn("group", F.floor(c("range") / FAN).cast("int")).groupBy("group").applyInArrow(merge, _EDGE))
        ranges = -(-ranges // FAN)
    return edges.select("s", "n", "pos")


def fit_isotonic(rows: DataFrame, score: str, y: str = "y", minimum: int = MINIMUM) -> DataFrame | None:
    """Knots (s, p) of the calibration; None with fewer than ``minimum`` labelled rows or one class.

    Rows with a negative or null label or without a finite score are left out.
    """
    s = c(score).cast("double")
    live = rows.filter((c(y) >= 0) & s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))
    table = value_table(live, [], s, n=F.lit(1).cast("long"), pos=c(y).cast("long"))
    table = written(table.select("__grp", c("__val").alias("s"), "n", "pos"))
    n, pos = table.agg(F.sum("n"), F.sum("pos")).first()
    if not n or n < minimum or pos in (0, n):
        return None
    edges = written(minorant(table))
    # each score to its edge: the last edge that starts at or before it
    marked = table.join(edges.select("s", c("s").alias("starts")), "s", "left")
    own = edges.select(c("s").alias("edge"), c("n").alias("edge_n"), c("pos").alias("edge_pos"))
    with sized(table):
        placed = settled(ordered(marked, ["__grp"], ["s"], {"edge": Running("max", c("starts"), inclusive=True)}))
        known = settled(lookup(placed, own, ["edge"], "s"))
        inside = ordered(known, ["edge"], ["s"], {"n_before": Running("sum", c("n")), "pos_before": Running("sum", c("pos"))})
    wide = lambda x: c(x).cast("decimal(19,0)")
    touches = wide("pos_before") * wide("edge_n") == wide("edge_pos") * wide("n_before")
    return written(inside.filter(touches).select("s", (c("edge_pos") / c("edge_n")).alias("p")))


def calibrate(knots: DataFrame | None, rows: DataFrame, score: str, out: str = "p", tie: str = "event_id") -> DataFrame:
    """Calibrated probability; the clipped score itself without knots; null for a null score."""
    if knots is None:
        return rows.withColumn(out, F.least(F.greatest(c(score).cast("double"), F.lit(0.0)), F.lit(1.0)))
    asked = settled(rows.select(c(score).cast("double").alias("__x")).filter(c("__x").isNotNull()).distinct())
    placed = settled(rank_against(asked, knots, c("__x"), c("s"), tie="__x", neighbours=True))
    low = knots.select(c("s").alias("ref_prev"), c("p").alias("p0"))
    high = knots.select(c("s").alias("ref_next"), c("p").alias("p1"))
    with sized(placed):
        near = lookup(settled(lookup(placed, low, ["ref_prev"], "__x")), high, ["ref_next"], "__x")
    between = c("p0") + (c("p1") - c("p0")) * (c("__x") - c("ref_prev")) / (c("ref_next") - c("ref_prev"))
    value = F.when(c("n_equal") > 0, c("p1")).when(c("p0").isNull(), c("p1")).when(c("p1").isNull(), c("p0")).otherwise(between)
    table = near.select("__x", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias(out))
    return lookup(rows.withColumn("__x", c(score).cast("double")), table, ["__x"], tie).drop("__x")
