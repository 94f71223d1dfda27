"""Work that must not grow faster than the rows, or be done more than once."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import composition as X
from tidemark.operators import drift as D
from tidemark.operators import features as FE
from tidemark.operators import kernels as K
from tidemark.operators import labels as L
from tidemark.operators import metrics as M
from tidemark.operators import rules as R
from tidemark.plans import values as V
from tidemark.plans.blocks import planning
from tidemark.queries import drift as QD
from tidemark.queries import scores as QT
from tidemark.queries import streams as QS
from tidemark.schema import complete
from tidemark.sources.replay import ReplayReader, prepare, replay
from tidemark.streaming import keyed as KS
from tidemark.streaming import label_store as LS


def test_bootstrap_hashes_once_per_draw_and_draws_once(spark, monkeypatch):
    made = []
    keep = M.written
    monkeypatch.setattr(M, "written", lambda df: made.append(df.columns) or keep(df))
    rows = spark.range(400).selectExpr("cast(id % 2 as int) AS y", "(id % 7) / 8D AS a", "(id % 5) / 8D AS b")
    out = M.controlled_comparison(rows, "a", ["b"], 0.1, replicates=5, cells=4).collect()
    assert out[0]["replicates"] == 5
    assert "w" in made[0]  # the counts are stored as drawn, before any filter on them

    def uniform(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:12], 16) / 2 ** 48

    def draw(mean, text):
        return sum(e <= uniform(text) for e in M._poisson_cdf(mean))

    for n in (0, 7, 40, 300):
        turns = [(k, unit, n // unit % 16) for k, unit in enumerate((1, 16, 256))]
        want = sum(draw(unit, f"t|{k}|{i}") for k, unit, d in turns for i in range(1, d + 1))
        assert spark.range(1).select(M.resampled(F.lit(n), F.lit("t"))).first()[0] == want


def test_bootstrap_replicates_use_the_scores_themselves(spark):
    """Scores that differ within a cell: cut to cells the arm loses its recall in every replicate, by itself it keeps it."""
    rows = spark.range(400).selectExpr("cast(id % 4 = 0 AS int) AS y", "0.5D + if(id % 4 = 0, 0.001D, 0D) + (id % 7) / 1e5D AS a", "(id % 5) / 8D AS b")
    out = M.controlled_comparison(rows, "a", ["b"], 0.1, replicates=20).first()
    assert out["recall_ours"] == 1 and out["recall_other"] < 0.5
    assert out["lo"] <= out["delta"] <= out["hi"] and out["lo"] > 0.5
    cells = spark.createDataFrame([(i, i + 1) for i in range(3)], "k int, n long")
    assert {(r["k"], r["rep"]) for r in M.replicate_counts(cells, ["k"], "n", 37, 3).collect()} == {(k, r) for k in range(3) for r in range(38)}


def test_many_frames_meet_in_written_tables(spark, monkeypatch):
    names = ["device_churn_30d", "lite_debits_since_topup_24h", "sketch_device_shared_entity_count", "is_first_event_for_entity", "merchant_volume_delta_in_cell"]
    rows = complete(spark.range(60).selectExpr("concat('e', id) AS event_id", "cast(id div 3 as double) * 3600 AS ts", "0L AS day_index", "0D AS hour_ist", "0L AS dow",
                                               "'upi-lite-offline' AS rail", "'lite_debit' AS message_kind", "'A' AS tier", "10D AS amount_inr", "concat('c', id % 4) AS cardholder_id",
                                               "concat('d', id % 7) AS device_fingerprint_id", "concat('g', id % 3) AS geo_cell"))
    one = FE.build_features(K.keyed(rows), None, names)
    monkeypatch.setattr(FE, "MEET", 2)
    met = FE.build_features(K.keyed(rows), None, names)
    assert sorted(met.collect()) == sorted(one.collect())
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")
    assert joins(met) <= 2 < joins(one)  # the frames of a whole view do not share one stage


def test_a_history_is_walked_once_a_row(spark):
    rows = complete(spark.range(40).selectExpr("concat('e', id) AS event_id", "cast(id div 3 as double) * 86400 * 9 AS ts", "0L AS day_index", "0D AS hour_ist", "0L AS dow", "'upi-pay' AS rail",
                                               "'authorisation' AS message_kind", "'A' AS tier", "10D + id % 7 AS amount_inr", "concat('c', id % 2) AS cardholder_id",
                                               "id * 1.5D AS response_latency_ms"))
    ratio, calm = "amount_ratio_to_own_baseline", "amount_uniformity_score"
    plan = lambda name: FE.build_features(K.keyed(rows), None, [name])._jdf.queryExecution().optimizedPlan().toString()
    assert plan(ratio).count("sort_array(") == 1  # the median
    assert plan(calm).count("SQRT(") == 1  # the deviation
    keyed = K.keyed(rows)
    want = K.trailing_median(keyed, "_primary_key", F.col("amount_inr"), 30 * 86_400, "m")
    want = {r["event_id"]: r["amount_inr"] / r["m"] if r["m"] > 0 else -1.0 for r in want.collect()}
    got = {r["event_id"]: r[ratio] for r in FE.build_features(keyed, None, [ratio]).collect()}
    assert got == want and 0 < sum(v == -1.0 for v in got.values()) < 10
    some = spark.createDataFrame([([1.0, 9.0, 4.0], 2), ([1.0, 9.0, 4.0], 5), ([3.0, None], 1), ([3.0], 0), ([], 3)], "a array<double>, n int")
    held = some.withColumn("h", F.transform("a", lambda x: F.struct(x.alias("v"))))
    assert [r["m"] for r in held.select(K.median_of_latest("h", F.col("n")).alias("m")).collect()] == [6.5, 4.0, -1.0, -1.0, -1.0]


def test_streams_commit_a_state_store_per_core(spark, tmp_path):
    folder = prepare(spark.range(40).selectExpr("id AS event_id", "cast(id as double) AS ts"), f"{tmp_path}/ordered", files=2)
    stream = replay(spark, folder, spark.read.parquet(f"{folder}/rows").schema, 20)
    counted = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 second").groupBy(F.window("at", "10 seconds")).count()
    spark.conf.set(KS.PARTITIONS_CONF, "64")
    try:
        KS.run_batches(counted.select("count"), f"{tmp_path}/out")
        assert spark.conf.get(KS.PARTITIONS_CONF) == "64"
    finally:
        spark.conf.set(KS.PARTITIONS_CONF, "8")
    stores = [p for p in (tmp_path / "out" / "progress" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(stores) <= max(KS.LEAST_PARTITIONS, spark.sparkContext.defaultParallelism)


def test_micro_batches_are_bounded_in_number_and_read_by_all_cores(spark, tmp_path, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(QS, "ROWS_PER_BATCH", 100)
    seen = {}
    monkeypatch.setattr(QS, "replay", lambda s, folder, schema, n, order: seen.setdefault(folder, n))
    few, many = (spark.range(n).selectExpr("id AS event_id", "cast(id as double) AS ts") for n in (1200 * cores, 3600 * cores))
    QS.replayed_together(spark, (many, ["ts", "event_id"]), (few, ["ts", "event_id"]))
    assert sorted(seen.values()) == [1200 * cores // 36, 100 * cores]  # as many batches each, of at most 100 rows a core
    folder = prepare(spark.range(100_000).selectExpr("id AS event_id", "cast(id as double) AS ts"), f"{tmp_path}/ordered", files=1)
    reader = ReplayReader({"path": folder, "rowsperbatch": "64000", "order": "ts,event_id", "progress": f"{tmp_path}/p", "slices": "4"}, ["event_id", "ts"])
    parts = reader.partitions({"rows": 1000}, {"rows": 65_000})
    assert len(parts) == 4 and [p.last - p.first for p in parts] == [16_000] * 4
    assert [x for p in parts for b in reader.read(p) for x in b.column("event_id").to_pylist()] == list(range(1000, 65_000))


def test_a_label_is_rewritten_a_few_times_whatever_the_batches(spark, tmp_path):
    folder, batches = f"{tmp_path}/snap", 16
    for k in range(batches):
        batch = spark.range(k * 10, k * 10 + 20).selectExpr("concat('e', id) AS event_id", "'analyst' AS channel", f"{k}D AS as_of_ts", f"{k % 2}L AS label")
        assert LS.upsert(batch.coalesce(1), folder, k, parts=1)
    put = sum(spark.read.parquet(str(p)).count() for p in (tmp_path / "snap").iterdir() if p.name.startswith("batch-"))
    assert put <= 800  # 1,520 where every batch writes the whole part
    held = {r["event_id"]: (r["as_of"], r["label"], r["disagree"]) for r in LS.resolved(LS.snapshot(spark, folder)).collect()}
    assert len(held) == 170 and held["e0"] == (0.0, 0, False) and held["e169"] == (15.0, 1, False) and held["e35"] == (3.0, 1, True)
    assert LS.snapshot(spark, folder, 4).count() == 50


def test_one_slot_changes_are_judged_in_the_row(spark):
    i = F.col("id")
    slots = [F.when(i % 31 == k, None).otherwise(F.element_at(F.array(*[F.lit(v) for v in X.SLOTS[s]]), (i * (2 * k + 3) % len(X.SLOTS[s]) + 1).cast("int"))).alias(s) for k, s in enumerate(X.SLOT_ORDER)]
    rows = spark.range(600).select((i % 590).alias("id"), *slots, (i % 4 + 1).alias("n_stages"))  # ten ids come twice, some slots are missing
    changed = X.violations(X.variants(rows)).filter("size(violated) = 0")
    want = changed.groupBy("id", "slot").agg(F.array_sort(F.collect_set("value")).alias("legal_values"))
    got = X.legal_values(rows, "id")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and plan.count("Generate") == 1  # rows meet before they become one a slot
    as_rows = lambda df: sorted(map(str, df.collect()))
    assert as_rows(got.select("id", "slot", "legal_values")) == as_rows(want)

    moved = changed.filter("value != was")
    before = X.with_axes(rows).select("id", F.concat_ws("|", "rail_class", "locus", "evasion").alias("before"))
    crossing = F.concat_ws("|", "rail_class", "locus", "evasion") != F.col("before")
    counts = X.with_axes(moved).join(before, "id").groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum(crossing.cast("long")).alias("n_crossing"))
    effects = X.mutation_effects(rows, "id")
    assert as_rows(effects.select("slot", "n", "n_crossing")) == as_rows(counts)
    assert "explode" not in effects._jdf.queryExecution().optimizedPlan().toString()

    order = {(s, v): k for k, (s, v) in enumerate((s, v) for s in ["EVASION", *[s for s in X.SLOT_ORDER if s != "EVASION"]] for v in X.SLOTS[s])}
    best = {}
    for r in moved.filter(F.col("n_stages") >= X.min_depth()).select("id", "slot", "value").collect():
        best[r["id"]] = min(best.get(r["id"], 99), order[r["slot"], r["value"]])
    found = X.siblings(rows, "id").collect()
    assert {(r["id"], order[r["slot"], r["value"]]) for r in found} == set(best.items())
    assert "explode" not in X.siblings(rows, "id")._jdf.queryExecution().optimizedPlan().toString()


def test_rules_are_compiled_and_looked_at_once(spark):
    rows = complete(spark.range(20).selectExpr("concat('e', id) AS event_id", "cast(id as double) AS ts", "0L AS day_index", "12D AS hour_ist", "0L AS dow", "'upi-pay' AS rail",
                                               "'authorisation' AS message_kind", "'A' AS tier", "if(id = 3, -5D, 10D) AS amount_inr")).repartition(8)
    found = R.check_event_rules(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    some = R.event_rules()[0].id
    assert plan.count(f"THEN {some} END") == 1 and "lambda" not in plan  # a lambda leaves all its input to the interpreter
    want = {(r.id, e["event_id"]) for r in R.event_rules() for e in rows.filter(r.broken()).select("event_id").collect()}
    assert {(r["invariant_id"], r["event_id"]) for r in found.collect()} == want and want


def _watched(spark, df):
    """The frame, and how many of its rows have been made since."""
    made = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(tell, df.schema), made


@pytest.fixture
def many(spark):
    """120 rows that count as too many for one task."""
    spark.conf.set("spark.tidemark.blocks.targetRows", "12")
    rows = spark.range(120).selectExpr("concat('e', id) AS event_id", "id * 3600000000L AS ts_us", "concat('k', id % 3) AS k1", "concat('c', id % 5) AS cp", "concat('h', id % 2) AS _cohort",
                                       "cast(id % 50 as double) AS amount_inr", "id % 4 = 0 AS bad")
    yield _watched(spark, rows)
    spark.conf.unset("spark.tidemark.blocks.targetRows")


def test_counting_groups_does_not_run_the_lineage_again(many):
    df, made = many
    with planning(df):
        V.score_curve(df, F.col("amount_inr"), by=["_cohort"], pos=F.col("bad").cast("long")).collect()
        assert made.value <= 2 * 120  # the source is counted, the value table made
        made.value = 0
        V.pct_rank(df, F.col("amount_inr"), "r", by=["_cohort"]).collect()
        assert made.value <= 2 * 120  # the value table, and the rows that look it up
        made.value = 0
        V.exact_quantiles(df, F.col("amount_inr"), [0.1, 0.5], by=["_cohort"]).collect()
        assert made.value <= 120


def test_ranks_of_cut_groups_are_those_of_whole_ones(spark, many):
    df = many[0]
    found = lambda: sorted((r.event_id, r.n_less, r.n_equal, r.n_ref, r.ref_prev, r.ref_next) for r in V.rank_against(
        df, df.filter("bad"), F.col("amount_inr"), F.col("amount_inr"), by=["_cohort"], neighbours=True).collect())
    cut = found()
    spark.conf.unset("spark.tidemark.blocks.targetRows")
    assert cut == found()


def test_single_feature_audit_reads_the_rows_once(many):
    df, made = many
    with planning(df):
        out = {r["feature"]: r for r in L.artefact_audit(df, ["amount_inr", "ts_us"], "bad", target_fpr=0.1).collect()}
    assert made.value <= 2 * 120
    assert out["amount_inr"]["support_benign"] == 1.0 and out["amount_inr"]["support_attack"] == 1.0


def test_trailing_sums_of_a_panel_are_worked_out_once(many):
    df, made = many
    with planning(df):
        ratios, ranks = K.velocity_panel(df, {"k1": "cp"}, windows=("24h",), distinct=False)
        ratios.join(ranks, "event_id").collect()
    assert made.value <= 10 * 120  # the source and the key counted, the key cut, then one run of the cut timeline


def test_shuffled_columns_and_their_control_derive_the_rows_once(many):
    df, made = many
    with planning(df):
        other = D.shuffled_marginals(df, ["amount_inr", "ts_us"], "event_id")
        assert sorted(r.amount_inr for r in other.collect()) == sorted(float(i % 50) for i in range(120))
        assert made.value <= 2 * 120
        made.value = 0
        D.discriminator_auc(df, other, ["amount_inr", "ts_us"], "event_id", rounds=1).collect()
        assert made.value <= 120


def test_checks_do_not_hold_the_derivation_of_the_events(spark, tmp_path):
    spark.range(40).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) AS ts", "id % 5 AS user_id", "'view' AS event_type",
                               "cast(id as double) AS value", "concat('{\"k\": ', id % 7, '}') AS props").write.parquet(f"{tmp_path}/events.parquet")
    with planning():
        plan = QD.checks(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 0  # some twenty reads of the events, each derived anew


def test_trees_are_fitted_on_every_unlabelled_row(spark, monkeypatch):
    n, seen = 420_000, []
    rows = spark.range(n).selectExpr("concat('e', id) AS event_id", "if(id % 50 = 0, 19, 2) AS day_index", "cast(id % 60 = 0 AS int) AS truth", "if(id % 60 = 0, 1, -1) AS y")
    monkeypatch.setattr(QT, "view_rows", lambda spark, sf: rows)
    monkeypatch.setattr(QT.G, "fit", lambda train, *a, **k: seen.append(train))
    QT.fitted(spark, "none")
    early = sum(i % 50 != 0 and i % 60 != 0 for i in range(n))
    assert early > 400_000 and seen[0].filter("not held and y = -1").count() == 2 * early


def test_correlation_of_a_constant_is_no_error(spark):
    rows = spark.range(300).selectExpr("cast(id as double) AS a", "if(id % 3 = 0, null, sqrt(id)) AS b", "5D AS k")
    assert D.bounded_correlation(rows, F.col("a"), F.col("k")).filter("isnan(measured)").count() == 1
    checked = D.band_check(D.bounded_correlation(rows, F.col("k"), F.col("b")), "x", "g", 0.0, 0.5).first()
    assert checked["status"] == "FAIL"  # as in the SQL
    want = rows.agg(F.abs(F.corr("a", "b"))).first()[0]
    assert D.bounded_correlation(rows, F.col("a"), F.col("b")).first()[0] == pytest.approx(want, abs=1e-12)
    assert D.bounded_correlation(rows.limit(50), F.col("a"), F.col("b")).first()[0] is None
