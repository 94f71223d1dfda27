"""Versioned table sets, the label snapshot, the ordered fingerprint and exact calibration."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration, labels, policy
from tidemark.sources import tables, versions
from tidemark.streaming import label_store as S


def rows(df):
    return sorted(map(str, df.collect()))


# ---------------------------------------------------------------- table sets and bundles

def test_a_version_is_whole_or_refused(spark, tmp_path):
    folder = str(tmp_path / "set")
    one = spark.range(20).withColumn("v", F.col("id") * 2)
    assert versions.save_set(spark, folder, {"a": one, "b": one.limit(0)}, {"view": "issuer"}) == 1
    assert versions.save_set(spark, folder, {"a": one.filter("id < 5")}) == 2
    tables_, meta = versions.load_set(spark, folder, 1)
    assert rows(tables_["a"]) == rows(one) and tables_["b"].count() == 0 and meta == {"view": "issuer"}
    assert versions.load_set(spark, folder)[0]["a"].count() == 5
    with pytest.raises(versions.VersionMismatch):
        versions.load_set(spark, folder, 3)
    one.limit(3).write.parquet(f"{folder}/a-half-written")  # files without a manifest are no version
    assert versions.numbers(spark, folder) == [1, 2]
    assert versions.publish(spark, folder, 2, {"tables": {}, "meta": {}}) is False
    with pytest.raises(versions.VersionMismatch):
        versions.load_set(spark, str(tmp_path / "nothing"))


@pytest.mark.parametrize("harm", ["rows", "schema", "gone"])
def test_a_changed_table_is_refused(spark, tmp_path, harm):
    folder = str(tmp_path / "set")
    versions.save_set(spark, folder, {"a": spark.range(20).withColumn("v", F.col("id") * 2)})
    path = versions.manifest(spark, folder)["tables"]["a"]["path"]
    if harm == "rows":
        spark.range(20).withColumn("v", F.col("id") * 2 + (F.col("id") == 3).cast("long")).write.mode("overwrite").parquet(path)
    elif harm == "schema":
        spark.range(20).withColumn("v", F.col("id").cast("string")).write.mode("overwrite").parquet(path)
    else:
        versions._fs(spark, path)[0].delete(versions._fs(spark, path)[1], True)
    with pytest.raises(versions.VersionMismatch):
        versions.load_set(spark, folder)


def test_bundle_scores_alike_before_and_after(spark, tmp_path):
    rnd = random.Random(3)
    data = [(i, *[rnd.choice([0.1, 0.4, rnd.random()]) for _ in policy.COMPONENTS], int(rnd.random() < 0.2), rnd.choice(["upi-pay", "card-cp-emv"]), 10.0 + i, rnd.random()) for i in range(300)]
    frame = spark.createDataFrame(data, "event_id long, " + ", ".join(f"{n} double" for n in policy.COMPONENTS) + ", y long, rail string, amount double, conformal_p double")
    ranked = policy.ecdf_ranks(frame, frame, policy.COMPONENTS).withColumn("fused", policy.fused(policy.COMPONENTS)).join(frame.select("event_id", "y", "rail", "amount"), "event_id")
    knots = policy.fit_isotonic(ranked, "fused")
    table = policy.fit_action_table(policy.calibrate(knots, ranked, "fused", "score"))
    bundle = policy.Bundle(frame.select(*policy.COMPONENTS), table, knots, view="network", model_version="m7")
    assert bundle.save(str(tmp_path / "b")) == 1
    loaded = policy.Bundle.load(spark, str(tmp_path / "b"))
    assert (loaded.view, loaded.model_version, tuple(loaded.components)) == ("network", "m7", policy.COMPONENTS)
    out = [rows(policy.score_batch(frame.drop("y", "amount"), b).select("event_id", F.round("score", 12), "band", "action", "reason_codes")) for b in (bundle, loaded)]
    assert out[0] == out[1] and len(out[0]) == 300


# ---------------------------------------------------------------- labels

def records(seed, n=400):
    rnd = random.Random(seed)
    return [(f"e{rnd.randint(0, 90)}", rnd.choice(["analyst", "issuer_tag", "chargeback"]), float(rnd.randint(0, 50)), rnd.randint(0, 1)) for _ in range(n)]


def test_label_snapshot(spark, tmp_path):
    folder, schema = str(tmp_path / "snap"), "event_id string, channel string, as_of_ts double, label long"
    batches = [spark.createDataFrame(records(k), schema) for k in range(4)]
    want = labels.resolve(batches[0].union(batches[1]).union(batches[2]).union(batches[3]), 1e9).drop("n_records")
    for k, batch in enumerate(batches):
        assert S.upsert(batch, folder, k, parts=8)
        before = rows(S.snapshot(spark, folder))
        assert not S.upsert(batch, folder, k, parts=8) and rows(S.snapshot(spark, folder)) == before  # delivered again
        assert k == 0 or not S.upsert(batches[0], folder, 0, parts=8)
    cols = ["event_id", "label", "channel", "disagree", "as_of"]
    assert rows(S.resolved(S.snapshot(spark, folder)).select(*cols)) == rows(want.select(*cols))
    batches[0].write.parquet(f"{folder}/batch-4-dead/part=1")  # died before its manifest
    assert S.upsert(batches[1], folder, 4, parts=8)  # records that came before change nothing
    assert rows(S.resolved(S.snapshot(spark, folder)).select(*cols)) == rows(want.select(*cols))
    assert S.upsert(batches[1].limit(0), folder, 5, parts=8) and S.snapshot(spark, folder).count() == want.count()
    with pytest.raises(ValueError):
        S.upsert(batches[0], folder, 6, parts=4)
    assert S.snapshot(spark, str(tmp_path / "none")) is None


def test_a_batch_touches_only_its_parts(spark, tmp_path):
    folder, schema = str(tmp_path / "snap"), "event_id string, channel string, as_of_ts double, label long"
    S.upsert(spark.createDataFrame(records(1), schema), folder, 0, parts=16)
    first = versions.manifest(spark, folder)["parts"]
    S.upsert(spark.createDataFrame([("e1", "chargeback", 60.0, 1)], schema), folder, 1, parts=16)
    second = versions.manifest(spark, folder)["parts"]
    assert len(first) > 8 and sum(first.get(k) != v for k, v in second.items()) == 1


# ---------------------------------------------------------------- fingerprint

def test_ordered_fingerprint(spark, mode):
    rnd = random.Random(2)
    data = [(float(i // 3), i, rnd.choice(["a", None, "", "\x00"]), rnd.random()) for i in range(90)]
    frame = lambda d: spark.createDataFrame(d, "at double, id long, s string, x double")
    hash_of = lambda d: tables.ordered_fingerprint(d, ["at", "id"]).first()
    base = hash_of(frame(data))
    assert base["n_rows"] == 90
    assert hash_of(frame(data[::-1]).repartition(7)) == base and hash_of(frame(data).coalesce(1)) == base
    swapped = list(data)
    swapped[10], swapped[50] = (*data[10][:2], *data[50][2:]), (*data[50][:2], *data[10][2:])
    assert hash_of(frame(swapped))["row_hash"] != base["row_hash"]
    assert tables.fingerprint(frame(swapped).drop("at", "id")).first() == tables.fingerprint(frame(data).drop("at", "id")).first()  # blind to it
    for k in (3, 40):
        changed = list(data)
        changed[k] = (*data[k][:2], "other", data[k][3])
        assert hash_of(frame(changed))["row_hash"] != base["row_hash"]
    assert hash_of(frame(data[:-1]))["row_hash"] != base["row_hash"]
    assert hash_of(frame(data).limit(0))["row_hash"] == "0" * 16
    by_hand = [0, 0]
    import hashlib
    for at, i, s, x in data[:5]:
        digest = hashlib.md5("\x1f".join([str(at), str(i), "\x00" if s is None else s, str(x)]).encode()).hexdigest()
        for k, (prime, b) in enumerate(tables._MODULI):
            by_hand[k] = (by_hand[k] * b + int(digest[7 * k:7 * k + 7], 16)) % prime
    assert hash_of(frame(data[:5]))["row_hash"] == "%08x%08x" % tuple(by_hand)


# ---------------------------------------------------------------- calibration

def brute_knots(pairs):
    """Pools by the max-min formula; a pool starts where the fitted sums equal the observed ones."""
    from fractions import Fraction

    s = sorted({a for a, _ in pairs})
    n = [sum(a == x for a, _ in pairs) for x in s]
    pos = [sum(y for a, y in pairs if a == x) for x in s]
    mean = lambda i, k: Fraction(sum(pos[i:k + 1]), sum(n[i:k + 1]))
    fit = [max(min(mean(i, k) for k in range(j, len(s))) for i in range(j + 1)) for j in range(len(s))]
    out, held = [], Fraction(0)
    for j in range(len(s)):
        if held == sum(pos[:j]):
            out.append((s[j], float(fit[j])))
        held += n[j] * fit[j]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_isotonic_is_exact(spark, mode, seed):
    rnd = random.Random(seed)
    pairs = [(round(rnd.random(), 2 if seed < 3 else 1), int(rnd.random() < 0.1 + 0.6 * rnd.random())) for _ in range(160)]
    pairs = [(s, int(rnd.random() < s)) if rnd.random() < 0.7 else (s, y) for s, y in pairs]
    frame = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(pairs)] + [(900, 0.5, -1), (901, float("nan"), 1), (902, None, 1)], "event_id long, score double, y long").repartition(6)
    knots = calibration.fit_isotonic(frame, "score")
    got = sorted((r["s"], r["p"]) for r in knots.collect())
    want = brute_knots(pairs)
    assert [s for s, _ in got] == [s for s, _ in want] and all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got, want, strict=True))
    asked = [-1.0, 0.0, 0.005, 0.333, 0.5, 0.77, 0.999, 2.0, *[s for s, _ in pairs[:20]], None]
    out = {r["event_id"]: r["p"] for r in calibration.calibrate(knots, spark.createDataFrame(list(enumerate(asked)), "event_id long, score double"), "score").collect()}
    import numpy as np
    for i, x in enumerate(asked):
        assert out[i] is None if x is None else abs(out[i] - np.interp(x, [s for s, _ in want], [p for _, p in want])) < 1e-12


def test_isotonic_needs_twenty_rows_and_two_classes(spark):
    frame = lambda d: spark.createDataFrame(d, "event_id long, score double, y long")
    assert calibration.fit_isotonic(frame([(i, i / 10, i % 2) for i in range(19)]), "score") is None
    assert calibration.fit_isotonic(frame([(i, i / 10, 1) for i in range(40)]), "score") is None
    assert calibration.fit_isotonic(frame([]), "score") is None
    same = calibration.calibrate(None, frame([(1, 1.5, 0), (2, -3.0, 0), (3, 0.25, 0)]), "score")
    assert [r["p"] for r in same.orderBy("event_id").collect()] == [1.0, 0.0, 0.25]
