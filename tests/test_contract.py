"""The registered queries, the catalogue and the rules hold together."""

import re
from pathlib import Path

import __spark_entry__ as entry
from pyspark.sql import functions as F

from tidemark import schema as V
from tidemark.operators import catalogue as C
from tidemark.operators import composition as X
from tidemark.operators import features as FE
from tidemark.operators import rules as R


def test_catalogue_counts():
    assert len(C.FEATURES) == 393 and len(C.MODEL_FEATURES) == 392
    assert [len(C.features_for_view(v)) for v in ("issuer", "network", "acquirer", "payee_psp")] == [319, 316, 212, 191]
    assert not set(C.FEATURES) & set(C.NEVER_FEATURES)


def test_every_feature_is_built(spark):
    assert FE.missing_features() == []


def test_rule_counts():
    ids = [r.id for r in R.event_rules()]
    assert len(ids) == len(set(ids)) == 116 and len(R.STREAM_RULES) == 10


def test_schema():
    assert len(V.FIELDS) == 156 and len(V.COHORT_TAGS) == 19


def test_composition_space(spark):
    raw = X.raw_space(spark)
    assert raw.count() == 188_160
    legal = X.filter_legal(raw)
    assert legal.count() == 15_271
    cells = X.feasible(X.all_cells(spark))
    assert cells.count() == 380
    reached = X.occupiable(legal)
    assert X.consistency(reached, cells).filter("finding = 'contradiction'").count() == 0
    assert X.constraint_binds(raw).count() == len(X.CONSTRAINTS) == 41


def test_every_sql_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 190


def test_partial_rows_pass_the_guards(spark):
    df = spark.createDataFrame([("e1", 0.0, 0, 12.0, 0, "card-cnp-keyed", "authorisation", "A", 10.0, True)],
                               "event_id string, ts double, day_index long, hour_ist double, dow long, rail string, message_kind string, tier string, amount_inr double, emv_cryptogram_present boolean")
    row = R.structural_guards(df).first()
    assert row["refuse"] and row["guard_rule"] == "G0-01"


def test_schema_drift_is_refused(spark):
    import pytest

    full = V.complete(spark.range(1).select(F.lit("e").alias("event_id"), F.lit(0.0).alias("ts"), F.lit(0).alias("day_index"), F.lit(1.0).alias("hour_ist"),
                                            F.lit(0).alias("dow"), F.lit("upi-pay").alias("rail"), F.lit("authorisation").alias("message_kind"),
                                            F.lit("A").alias("tier"), F.lit(1.0).alias("amount_inr")))
    V.check_columns(full, V.EVENT_SCHEMA, "events")
    with pytest.raises(ValueError):
        V.check_columns(full.drop("rrn"), V.EVENT_SCHEMA, "events")


def test_no_forbidden_calls():
    root = Path(__file__).resolve().parents[1] / "tidemark"
    for f in root.rglob("*.py"):
        text = f.read_text()
        assert not re.search(r"localCheckpoint|toPandas|\.rdd\b(?!\.getNumPartitions)", text), f


def test_holdouts_in_name_only_are_told(spark):
    space = X.raw_space(spark).filter("ACCESS = 'stolen-credential' AND RAIL IN ('aeps-microatm', 'card-cnp-3ds')")
    arm = f"EVASION={X.WITHHELD_EVASION}"
    full = {r["arm"]: r for r in X.sealed_audit(space, space.limit(0)).collect()}
    assert set(full) == {*X.SEALED, arm}
    assert full["SEALED-01"]["n_members"] > 0 and full["SEALED-01"]["problem"] == ""
    assert full["SEALED-05"]["n_members"] == 0 and full["SEALED-05"]["problem"] == "no legal member"
    assert full[arm]["problem"] == "no seed uses the withheld value"
    none = X.sealed_audit(space.limit(0), space.limit(0)).collect()
    assert {r["problem"] for r in none} == {"no legal member"} and len(none) == 13


def test_reasons_name_every_broken_constraint(spark):
    rows = X.raw_space(spark).limit(500).withColumn("id", F.to_json(F.struct(*X.SLOT_ORDER)))
    told = X.explain_violations(rows, "id").collect()
    broken = {(r["id"], i) for r in X.violations(rows).collect() for i in r["violated"]}
    assert {(r["id"], r["constraint_id"]) for r in told} == broken and len(told) == len(broken)
    assert all(", found " in r["reason"] for r in told)
