"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame functions only.

Sources in code point order (null last) take the weights in turn, for ever.  A source's target is its share of
``budget`` times all words, clamped at ``epochs`` times its own words; what is clamped off is shared
again by weight among the open sources until no target is above its clamp.  A source then takes every
document floor(target / size) times whole, and the fraction that is left by walking its documents in the order of
a seeded hash: documents are taken whole until the next would pass the target, and that one is taken in part.
So a source's words equal its rounded target.

The walk needs no global sort: hashes fall into 4096 ranges, sums per range show in which range the
walk ends, and only that range of each source is put in order.  A source that holds a third of all
rows is summed map-side; the table of sources is broadcast only while it has at most ``BROADCAST`` rows.

Edge cases: a null text has size 0; a null source is a source; sources without words have target 0; repeated rows are
taken one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, written

WEIGHTS, BUDGET, EPOCHS, SEED, BROADCAST = (3, 1, 2), 1.5, 2, "mix", 100_000


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """Rows with ``place``, their number (from 0) in the order of the column, null last; sorted in ranges, not in one task."""
    ranged = rows.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("range", F.spark_partition_id())
    held = written(ranged)  # the ranges are sampled: fixed here
    within = F.row_number().over(Window.partitionBy("range").orderBy(F.col(column).asc_nulls_last()))
    sums = held.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("range", before.alias("start"))
    return held.withColumn("within", within).join(starts, "range").withColumn("place", F.col("start") + F.col("within") - 1).drop("range", "within", "start")


def water_fill(sources: DataFrame, total: float) -> float:
    """The level at which sum(least(cap, level * weight)) is ``total``; ``sources`` has cap and weight.

    Each round shares what the clamped sources leave among the open ones, until none is newly above its clamp.
    """
    level = -1.0
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        capped, weight = sources.agg(F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)),
                                     F.sum(F.when(~above, F.col("weight")))).first()
        new = (total - capped) / weight if weight else level
        if new <= level:
            return max(level, 0.0)
        level = new


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target (its source's) and taken (words) of every row; ``docs`` has doc_id, text, source."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = written(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key")))
    sums = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    sources = written(sums.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * epochs))
    n_sources, words = sources.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    level = water_fill(sources, budget * (words or 0))
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = sources.select("source", "place", "source_size", target.alias("target")).withColumn("whole", whole).withColumn(
        "need", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))

    def with_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "__source")
        return left.join(F.broadcast(right) if n_sources <= BROADCAST else right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")

    ranges = rows.groupBy("source", F.substring("key", 1, 3).alias("range")).agg(F.sum("size").alias("words"))
    run = F.sum("words").over(Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    last = with_source(ranges, aims.select("source", "place", "need")).withColumn("upto", run).filter(
        "need > 0 and upto - words < need and upto >= need").select("place", F.col("range").alias("last"), (F.col("need") - F.col("upto") + F.col("words")).alias("rest"))
    plan = written(aims.join(last, "place", "left"))
    aimed = with_source(rows, plan).withColumn("range", F.substring("key", 1, 3))
    ends = F.coalesce(F.col("range") == F.col("last"), F.lit(False))
    full = F.coalesce(F.col("range") < F.col("last"), F.lit(False))
    clear = aimed.filter(~ends).withColumn("extra", F.when(full, F.col("size")).otherwise(F.lit(0)))
    upto = F.sum("size").over(Window.partitionBy("place").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0))
    walk = aimed.filter(ends).withColumn("upto", upto).withColumn(
        "extra", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("upto") + F.col("size")))).drop("upto")
    return clear.unionByName(walk).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


# The same mix for DuckDB: the water level in closed form over sources in order of clamp per weight.
SQL = r"""
WITH r AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS key
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place
    FROM r GROUP BY source
), c AS (SELECT *, source_size * 2 AS cap, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s
), o AS (
    SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM c) - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
           row_number() OVER (ORDER BY cap::DOUBLE / weight, place) AS turn
    FROM c
), l AS (SELECT coalesce(arg_min(level, turn) FILTER (cap >= level * weight), arg_max(level, turn)) AS level FROM o
), t AS (SELECT c.*, least(cap::DOUBLE, l.level * weight) AS target FROM c, l
), w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), n AS (SELECT *, round(target - whole * source_size)::BIGINT AS need FROM w
), k AS (
    SELECT r.doc_id, r.size, n.source_size, n.target, n.whole, n.need,
           sum(r.size) OVER (PARTITION BY n.place ORDER BY r.key, r.size ROWS UNBOUNDED PRECEDING) AS upto
    FROM r JOIN n ON r.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, need - upto + size)))::BIGINT AS taken FROM k
"""
