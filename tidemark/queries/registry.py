"""Registration of queries and the stand-in frames they run on."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.blocks import offer, planning

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, folder) -> DataFrame function under a name, with its SQL when there is one."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        @wraps(fn)
        def planned(spark: SparkSession, folder: str) -> DataFrame:
            with planning():  # the stand-in frame a query reads becomes its source
                return fn(spark, folder)

        QUERIES[name] = planned
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return offer(spark.read.parquet(os.path.join(folder, f"{name}.parquet")))


def epoch_us(col: str) -> Column:
    """Microseconds since 1970 of a timestamp column, zone-free or not."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({col} AS TIMESTAMP_NTZ))")


# The activity stream: events with time cut to the hour (so that ties occur), a string key that is
# sometimes blank, and a counterparty that is sometimes blank.
STREAM_COLUMNS = """
    event_id, us - us % 3600000000 AS ts_us, user_id,
    CASE WHEN event_id % 17 = 0 THEN '' ELSE CONCAT('u', CAST(user_id % 40 AS STRING)) END AS k1,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE CONCAT(event_type, CAST(user_id % 3 AS STRING)) END AS cp,
    event_type AS cohort, value * 0.731058578630 AS amt, event_id % 3 = 0 AS hit
"""
STREAM_SQL = f"ev AS (SELECT {STREAM_COLUMNS} FROM (SELECT *, epoch_us(ts) AS us FROM events))"
# Every (row, earlier row of the same non-blank key) pair; the brute-force basis of the SQL twins.
PAIRS_SQL = STREAM_SQL + """, pr AS (
    SELECT a.event_id, a.ts_us, b.event_id AS b_id, b.ts_us AS b_ts, b.cp AS b_cp, b.amt AS b_amt, b.hit AS b_hit,
           row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts_us DESC, b.event_id DESC) AS back
    FROM ev a JOIN ev b ON a.k1 = b.k1 AND a.k1 <> ''
     AND (b.ts_us < a.ts_us OR (b.ts_us = a.ts_us AND b.event_id < a.event_id)))"""


def stream(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "events").withColumn("us", epoch_us("ts"))
    return offer(raw.selectExpr(*split_columns(STREAM_COLUMNS)))


def split_columns(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    out.append(text[start:].strip())
    return out


def rounded(df: DataFrame, places: int = 6, **override: int) -> DataFrame:
    """Round every double column, as the SQL twins do, so that summation order cannot show."""
    return df.selectExpr(*[
        f"round({n}, {override.get(n, places)}) + 0D AS {n}" if t in ("double", "float") else n for n, t in df.dtypes
    ])
