"""Streaming twins give what their batch forms give."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark import schema as V
from tidemark.operators import rules as R
from tidemark.sources.replay import prepare, replay
from tidemark.streaming import keyed as K
from tidemark.streaming import twins as W


def events(spark, n=120):
    i = F.col("id")
    base = spark.range(n).select(
        F.concat(F.lit("e"), i.cast("string")).alias("event_id"), (1_700_000_000.0 + F.floor(i / 3) * 600).alias("ts"), F.lit(0).alias("day_index"),
        F.lit(1.0).alias("hour_ist"), F.lit(0).alias("dow"), F.lit("upi-collect").alias("rail"),
        F.when(i % 2 == 0, "collect_request").otherwise("authorisation").alias("message_kind"), F.lit("A").alias("tier"), (i * 1.5).alias("amount_inr"),
        F.concat(F.lit("pv"), (i % 3).cast("string")).alias("payee_vpa"), F.concat(F.lit("c"), (i % 7).cast("string")).alias("cardholder_id"),
        F.concat(F.lit("p"), (i % 2).cast("string")).alias("pan_canonical"), (i % 3 == 0).alias("emv_cryptogram_present"), ((i * 7) % 50).alias("emv_cryptogram_atc"))
    return V.complete(base)


def as_stream(spark, df, tmp_path):
    path = str(tmp_path / "in")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def rows(df):
    return sorted(map(str, df.collect()))


def replayed(spark, df, tmp_path, per_batch, files=3):
    folder = prepare(df, str(tmp_path / "ordered"), files=files)
    return replay(spark, folder, df.schema, per_batch, progress=str(tmp_path / "position"))


def test_replay_is_ordered_in_batches_of_the_asked_size(spark, tmp_path):
    df = events(spark).select("event_id", "ts", "amount_inr", "emv_cryptogram_present")
    seen = []
    stream = replayed(spark, df.orderBy(F.rand(3)), tmp_path, 17)
    query = stream.writeStream.foreachBatch(lambda part, k: seen.append((k, sorted((r["ts"], r["event_id"]) for r in part.collect())))).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    last = [p for p in query.recentProgress if p["numInputRows"]][-1]
    query.stop()
    assert [len(rows_) for _, rows_ in seen] == [17] * 7 + [1]
    flat = [r for _, part in sorted(seen) for r in part]
    assert flat == sorted((r["ts"], r["event_id"]) for r in df.collect())
    assert f'"event_id":"{flat[-1][1]}"' in str(last["sources"][0]["endOffset"]).replace("'", '"').replace(": ", ":")


def test_replay_refuses_what_is_not_in_order(spark, tmp_path):
    df = events(spark, 30).select("event_id", "ts")
    folder = prepare(df, str(tmp_path / "ordered"), files=2)
    spark.createDataFrame([("a", 5, (0.0, "e0"), (9.0, "e1")), ("b", 5, (8.0, "e0"), (9.0, "e2"))],
                          "file string, n long, low struct<ts:double,event_id:string>, high struct<ts:double,event_id:string>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/index")
    with pytest.raises(Exception, match="overlap"):
        query = replay(spark, folder, df.schema, 5).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()


def test_restart_from_the_middle(spark, tmp_path):
    """Stopped after a few micro-batches and started again, in one folder, the rows are those of an undisturbed run."""
    df = events(spark)
    stream = lambda name: K.entity_state(replay(spark, folder, df.schema, 11, progress=str(tmp_path / name)))
    folder = prepare(df, str(tmp_path / "ordered"), files=3)
    whole = rows(K.run_batches(stream("one"), str(tmp_path / "whole")))
    part = K.run_batches(stream("two"), str(tmp_path / "parts"), stop_after=4).count()
    assert 0 < part < len(whole)
    assert rows(K.run_batches(stream("two"), str(tmp_path / "parts"))) == whole
    assert len(whole) == W.observed(df).count()


def test_counter_regressions(spark, tmp_path):
    df = events(spark)
    got = K.run_batches(K.counter_regressions(replayed(spark, df, tmp_path, 13)), str(tmp_path / "out"))
    want = R.counter_regressions(df.withColumn("ts_us", F.round(F.col("ts") * 1e6).cast("long")))
    assert rows(got.select("event_id", "regressed")) == rows(want.select("event_id", "regressed"))
    assert got.filter("regressed").count() > 0


def test_live_fanout_is_the_guard(spark, tmp_path):
    df = events(spark).withColumn("cardholder_id", F.when(F.col("event_id").endswith("4"), "").otherwise(F.col("cardholder_id")))
    got = K.run_batches(K.live_fanout(replayed(spark, df, tmp_path, 9), threshold=3), str(tmp_path / "out"))
    want = R.collect_fanout(df.withColumn("ts_us", F.round(F.col("ts") * 1e6).cast("long")))
    assert rows(got.select("event_id", F.col("collect_fanout").cast("double"))) == rows(want.select("event_id", F.col("collect_fanout").cast("double")))
    assert got.filter("reached").count() == want.filter("collect_fanout >= 3").count() > 0


def brute_state(events_):
    """The state before each event of one key, by looking at all earlier ones; times are whole minutes."""
    out = []
    for i, (event_id, ts, amount, other, flow) in enumerate(events_):
        before = events_[:i]
        held = [0] * 64
        for _, _, _, o, _ in before:
            if o:
                digest = hashlib.md5(o.encode()).hexdigest()
                bits = int(digest[2:15], 16)
                held[int(digest[:2], 16) % 64] = max(held[int(digest[:2], 16) % 64], 53 - bits.bit_length())
        z = sum(2.0 ** -h for h in held)
        raw, empty = 0.709 * 4096 / z, held.count(0)
        spans = [x for s in W.WINDOW_S.values() for x in (float(sum(ts - s <= t for _, t, *_ in before)), round(sum(a for _, t, a, _, _ in before if ts - s <= t), 6))]
        out.append((event_id, i, *spans, round(64 * math.log(64 / empty) if raw <= 160 and empty else raw, 9), (ts - events_[0][1]) / 86400,
                    round(sum(a for _, _, a, _, f in before if f > 0), 6), round(sum(a for _, _, a, _, f in before if f < 0), 6)))
    return out


def test_entity_state_of_a_hot_key(spark, tmp_path):
    """A key with nine tenths of all rows over many micro-batches, with gaps beyond the longest window."""
    rnd = random.Random(5)
    data, at = [], 1_700_000_040.0
    for i in range(400):
        at += 60 * rnd.choice([0, 0, 1, 5, 60, 600, 1440]) + (40 * 86400 if i == 250 else 0)
        data.append((f"e{i:04d}", at, float(rnd.choice([1, 2.5, 1e9])), rnd.choice(["", *[f"p{k}" for k in range(80)]]), "hot" if rnd.random() < 0.9 else f"k{i}",
                     rnd.choice(["inbound_credit", "onward_send", "authorisation"])))
    df = V.complete(spark.createDataFrame([(e, t, 0, 1.0, 0, "upi-pay", m, "A", a, cp, k) for e, t, a, cp, k, m in data],
                                          "event_id string, ts double, day_index long, hour_ist double, dow long, rail string, message_kind string, tier string, amount_inr double, cardholder_id string, beneficiary_id string"))
    got = K.run_batches(K.entity_state(replayed(spark, df, tmp_path, 23)), str(tmp_path / "out")).filter("key = 'hot'").orderBy("event_id").collect()
    want = brute_state([(e, t, a, cp, {"inbound_credit": 1, "onward_send": -1}.get(m, 0)) for e, t, a, cp, k, m in data if k == "hot"])
    assert len(got) == len(want) > 300
    # the sketch is dropped with the rest of an idle key's windows
    gap = next(i for i, w in enumerate(want) if w[0] >= "e0250") + 1
    for i, (g, w) in enumerate(zip(got, want, strict=True)):
        fields = [g["event_id"], g["seen"], *[round(g[f"{x}_{s}"], 6) for s in W.WINDOW_S for x in ("n", "amount")], round(g["distinct"], 9), g["age_days"], round(g["inflow"], 6), round(g["outflow"], 6)]
        assert fields[:10] == list(w[:10]) and fields[11:] == list(w[11:])
        assert i >= gap - 1 or fields[10] == w[10]


def test_idle_keys_leave_the_state(spark, tmp_path):
    base = events(spark, 60)
    other = lambda tag, days: events(spark, 3).withColumn("ts", F.col("ts") + days * 86400).withColumn("event_id", F.concat(F.lit(tag), "event_id")).withColumn("pan_canonical", F.lit(tag))
    later, end = other("z", 90), other("zz", 200)
    out = str(tmp_path / "out")
    K.run_batches(K.entity_state(replayed(spark, base.unionByName(later).unionByName(end), tmp_path, 20)), out)
    spark.conf.set(K.STATE_STORE_CONF, K.ROCKS)
    try:
        days = spark.read.format("statestore").option("path", f"{out}/progress").option("stateVarName", "days").load()
        held = {r[0] for r in days.select(F.col("key.key")).distinct().collect()}
        heads = {r[0] for r in spark.read.format("statestore").option("path", f"{out}/progress").option("stateVarName", "head").load().select(F.col("key.key")).distinct().collect()}
    finally:
        spark.conf.unset(K.STATE_STORE_CONF)
    assert heads == {"p0", "p1", "z", "zz"} and held == {"zz"}  # first times stay, windows and sketches go


def test_window_counters(spark, tmp_path):
    df = events(spark)
    batch = W.window_counters(W.observed(df), "2 hours", "1 hour")
    got = W.run_to_table(W.window_counters(W.observed(as_stream(spark, df, tmp_path)), "2 hours", "1 hour"), str(tmp_path / "out"))
    last = df.agg(F.max("ts")).first()[0]
    closed = batch.filter(F.col("w_end").cast("double") <= last - 7200)
    assert rows(got) == rows(closed) and got.count() > 0


def test_fanout(spark, tmp_path):
    df = events(spark)
    got = W.run_to_table(W.collect_fanout(as_stream(spark, df, tmp_path), threshold=2), str(tmp_path / "out"))
    batch = W.collect_fanout(df, threshold=2)
    closed = {(r["w_start"], r["payee_vpa"]): r["n_payers"] for r in batch.collect()}
    assert got.count() > 0
    for r in got.collect():
        assert closed[(r["w_start"], r["payee_vpa"])] == r["n_payers"]
