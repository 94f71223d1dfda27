"""Scored rows derived from ``orders``: label, scores with ties, amount, rail, strata."""

from __future__ import annotations

from tidemark.queries.registry import split_columns, table
from tidemark.schema import RAILS

_RAIL = "CASE o_custkey % 12 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(RAILS)) + " END"
_Y = "CASE WHEN o_orderkey % 9 = 0 THEN 1 WHEN o_orderkey % 5 = 3 THEN -1 ELSE 0 END"


def _score(a: int, b: int, gain: str) -> str:
    return (f"FLOOR((CAST((o_orderkey * {a}) % 997 AS DOUBLE) / 997 * 0.7e0 + CASE WHEN o_orderkey % 9 = 0 "
            f"THEN {gain} * CAST((o_custkey * {b}) % 100 AS DOUBLE) / 100 ELSE 0e0 END) * 400e0) / 400e0")


SCORED_COLUMNS = f"""
    o_orderkey AS event_id, CAST({_Y} AS BIGINT) AS y, {_score(7919, 31, '0.5e0')} AS score, {_score(104729, 17, '0.1e0')} AS s_inc,
    {_score(15485863, 13, '0.3e0')} AS s_base, o_totalprice AS amount, {_RAIL} AS rail, CONCAT('fam', CAST(o_custkey % 7 AS STRING)) AS family,
    CASE o_custkey % 10 WHEN 0 THEN 'hb12_wedding' WHEN 1 THEN 'hb12_relocation' WHEN 2 THEN 'hbb_school_fee_collection' ELSE 'ordinary' END AS cohort_tag,
    CAST(o_custkey % 5 - 1 AS BIGINT) AS age_band, o_custkey % 6 = 0 AS sealed, o_orderkey % 9 = 0 AS is_attack,
    CASE o_custkey % 5 WHEN 0 THEN '6011' WHEN 1 THEN '5411' WHEN 2 THEN '4111' WHEN 3 THEN '' ELSE '1234' END AS mcc,
    CONCAT('te7', CAST(o_custkey % 3 AS STRING)) AS geo_cell, o_orderkey % 2 = 0 AS half,
    {_score(611953, 7, '0.2e0')} AS g2_conformal, {_score(1299709, 5, '0.2e0')} * 4e0 AS g2_density,
    CAST(o_orderkey % 8 AS DOUBLE) / 8e0 AS sketch, CAST(o_custkey % 4 AS DOUBLE) / 4e0 AS gate_b
"""
SCORED_SQL = f"sc AS (SELECT {SCORED_COLUMNS} FROM orders)"


def scored(spark, sf):
    return table(spark, sf, "orders").selectExpr(*split_columns(SCORED_COLUMNS))
