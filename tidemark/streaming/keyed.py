"""Per-entity state with expiry: what the store knew of an event's nine keys just before it.

Rows reach the state in time order, a bounded number per micro-batch (``sources.replay``), so a hot key is served over several
micro-batches and no task ever holds more of it than one.  State per key: a head (first and last time, events,
flows, 64 registers of a distinct sketch) and, per day, the minutes that had events with their number and amount.  Days leave
the state when no window reaches them; a timer in event time drops the days and the sketch of a key that was idle for the
longest window.  The head's first time stays: ages count from it.

The distinct sketch hashes counterparties with MD5, so any engine can repeat it; its error is about 13 %.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.scores import sketch_risk
from tidemark.plans.workers import package_on_path
from tidemark.streaming.twins import COUNTERPARTY, WINDOW_S, observed

c = F.col
REGISTERS, MINUTE, DAY = 64, 60.0, 1440
STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS_CONF, LEAST_PARTITIONS = "spark.sql.shuffle.partitions", 8
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ", ".join(f"n_{w} double, amount_{w} double" for w in WINDOW_S)
OUTPUT = f"event_id string, key_type string, key string, seen long, {FIELDS}, distinct double, age_days double, inflow double, outflow double"


def register(counterparty: Column) -> Column:
    """The sketch register (0 to 63) a counterparty falls in; -1 for a blank one."""
    return F.when(F.coalesce(counterparty, F.lit("")) == "", -1).otherwise(F.conv(F.substring(F.md5(counterparty.cast("binary")), 1, 2), 16, 10).cast("int") % REGISTERS)


def rank(counterparty: Column) -> Column:
    """Position of the first set bit among 52 bits of the hash, from 1."""
    bits = F.conv(F.substring(F.md5(F.coalesce(counterparty, F.lit("")).cast("binary")), 3, 13), 16, 10).cast("long")
    return F.when(bits == 0, 53).otherwise(53 - F.length(F.bin(bits))).cast("int")


def estimate(z: float, empty: int) -> float:
    """Distinct values of a sketch with sum z of 2^-register and so many empty registers."""
    raw = 0.709 * REGISTERS * REGISTERS / z
    return REGISTERS * math.log(REGISTERS / empty) if raw <= 2.5 * REGISTERS and empty else raw


class EntityState(StatefulProcessor):
    """Trailing counts, sums, distinct counterparties, age and flows of one key, before each of its events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "first double, last double, seen long, inflow double, outflow double")
        self.sketch = handle.getValueState("sketch", "registers binary")
        self.days = handle.getMapState("days", "day long", "minute array<int>, n array<long>, amount array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # at most a micro-batch
        ts, value, flow = (new[x].to_numpy(float) for x in ("ts", "amount", "flow"))
        first, last, seen, inflow, outflow = self.head.get() if self.head.exists() else (float(ts[0]), float(ts[0]), 0, 0.0, 0.0)
        own = np.floor(ts / MINUTE).astype(np.int64)
        reach = int(max(WINDOW_S.values()) // MINUTE)
        held = sorted((int(d[0]), v) for d, v in self.days.iterator()) if self.days.exists() else []
        old = own[0] - reach
        for d, _ in held:
            if (d + 1) * DAY <= old:
                self.days.removeKey((d,))
        held = [(d, v) for d, v in held if (d + 1) * DAY > old]
        minute = np.concatenate([np.asarray(v[0], np.int64) + d * DAY for d, v in held] + [own])
        n = np.concatenate([np.asarray(v[1], np.int64) for _, v in held] + [np.ones(len(own), np.int64)])
        amount = np.concatenate([np.asarray(v[2], float) for _, v in held] + [value])
        order = np.argsort(minute, kind="stable")
        at = np.argsort(order, kind="stable")[len(minute) - len(own):]
        minute, n, amount = minute[order], n[order], amount[order]
        n_before = np.concatenate([[0], np.cumsum(n)])
        sum_before = np.concatenate([[0], np.cumsum(amount.astype(np.longdouble))])  # what is added and taken away leaves no trace
        out = {"event_id": new["event_id"].to_numpy(), "key_type": key[0], "key": key[1], "seen": seen + np.arange(len(own))}
        for name, seconds in WINDOW_S.items():
            start = np.searchsorted(minute, own - int(seconds // MINUTE), side="left")
            out[f"n_{name}"] = (n_before[at] - n_before[start]).astype(float)
            out[f"amount_{name}"] = (sum_before[at] - sum_before[start]).astype(float)
        out["distinct"] = self._distinct(new["register"].to_numpy(), new["rank"].to_numpy())
        out["age_days"] = (ts - first) / 86_400.0
        for name, before, sign in (("inflow", inflow, 1), ("outflow", outflow, -1)):
            run = np.cumsum(np.where(flow == sign, value, 0.0).astype(np.longdouble))
            out[name] = (before + np.concatenate([[0], run[:-1]])).astype(float)
            inflow, outflow = (float(before + run[-1]), outflow) if sign > 0 else (inflow, float(before + run[-1]))
        self.head.update((first, float(max(last, ts[-1])), int(seen + len(own)), inflow, outflow))
        touched = np.unique(own // DAY)
        for d in touched.tolist():
            inside = minute // DAY == d
            some, where = np.unique(minute[inside] - d * DAY, return_inverse=True)
            self.days.updateValue((d,), (some.tolist(), np.bincount(where, weights=n[inside]).astype(np.int64).tolist(), np.bincount(where, weights=amount[inside]).tolist()))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((max(last, ts[-1]) + reach * MINUTE + MINUTE) * 1000))
        yield pd.DataFrame(out)

    def _distinct(self, register_: np.ndarray, rank_: np.ndarray) -> list[float]:
        held = bytearray(self.sketch.get()[0]) if self.sketch.exists() else bytearray(REGISTERS)
        z, empty, out, changed = sum(2.0 ** -r for r in held), held.count(0), [], False
        for r, v in zip(register_.tolist(), rank_.tolist(), strict=True):
            out.append(estimate(z, empty))
            if r >= 0 and v > held[r]:
                z += 2.0 ** -v - 2.0 ** -held[r]
                empty -= held[r] == 0
                held[r], changed = v, True
        if changed:
            self.sketch.update((bytes(held),))
        return out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.days.clear()
        self.sketch.clear()
        yield from ()

    def close(self) -> None:
        pass


def keyed_rows(events: DataFrame, delay: str) -> DataFrame:
    rows = observed(events).withWatermark("at", delay)
    return rows.select("event_id", "key_type", "key", c("at").cast("double").alias("ts"), "at", "amount", c("flow").cast("double").alias("flow"),
                       register(c("counterparty")).alias("register"), rank(c("counterparty")).alias("rank"))


def entity_state(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream of one row per event and key it carries: the state of the key before the event.

    Windows move by whole minutes: exact where event times are, else an event leaves up to a minute late.
    """
    return keyed_rows(events, delay).groupBy("key_type", "key").transformWithStateInPandas(EntityState(), OUTPUT, "append", "EventTime")


def flat_row(state_rows: DataFrame) -> DataFrame:
    """One row per event with all columns of its nine keys; -1 for a key it does not carry or that was never seen before."""
    known = c("seen") > 0
    out = []
    for k in COUNTERPARTY:
        names = {**{f"{w}_count": f"n_{w}" for w in WINDOW_S}, **{f"{w}_sum": f"amount_{w}" for w in WINDOW_S}, "distinct": "distinct", "age_days": "age_days"}
        out += [F.coalesce(F.max(F.when((c("key_type") == k) & known, c(x))), F.lit(-1.0)).alias(f"sk_{k}_{n}") for n, x in names.items()]
    ben = (c("key_type") == "beneficiary_id") & known
    out += [F.coalesce(F.max(F.when(ben, c(x))), F.lit(-1.0)).alias(f"sk_ben_{x}") for x in ("inflow", "outflow")]
    rows = state_rows.groupBy("event_id").agg(*out)
    skew = F.when(c("sk_ben_inflow") > 0, F.abs(c("sk_ben_inflow") - c("sk_ben_outflow")) / c("sk_ben_inflow")).otherwise(-1.0)
    return rows.withColumn("sk_ben_in_out_skew", skew)


def risk(rows: DataFrame) -> DataFrame:
    """(event_id, sketch_risk): the bounded graph terms of the flat row."""
    terms = {"fanin": "sk_beneficiary_id_distinct", "skew": "sk_ben_in_out_skew", "requestor": "sk_token_requestor_id_distinct",
             "device": "sk_device_fingerprint_id_distinct", "terminal": "sk_terminal_id_1h_count"}
    return rows.select("event_id", sketch_risk(terms).alias("sketch_risk"))


class TopCounter(StatefulProcessor):
    """Has a card's counter gone back or stood still?  The state is its highest counter; idle cards go after ``idle_days``."""

    def __init__(self, idle_days: int) -> None:
        self.idle_ms = idle_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.top = handle.getValueState("top", "top long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        top = self.top.get()[0] if self.top.exists() else -1
        counter = new["emv_cryptogram_atc"]
        before = counter.cummax().shift(fill_value=-1).clip(lower=top)
        self.top.update((int(max(top, counter.max())),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(new["ts"].iloc[-1] * 1000) + self.idle_ms)
        yield pd.DataFrame({"event_id": new["event_id"], "pan_canonical": key[0], "emv_cryptogram_atc": counter, "regressed": (counter <= before) & (before >= 0)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.top.clear()
        yield from ()

    def close(self) -> None:
        pass


def counter_regressions(events: DataFrame, delay: str = "1 hour", idle_days: int = 3650) -> DataFrame:
    """Stream of (event_id, pan_canonical, emv_cryptogram_atc, regressed)."""
    rows = events.filter(c("emv_cryptogram_present") & (c("emv_cryptogram_atc") >= 0) & (c("pan_canonical") != "")).select(
        "pan_canonical", "ts", "event_id", "emv_cryptogram_atc", c("ts").cast("timestamp").alias("at")).withWatermark("at", delay)
    return rows.groupBy("pan_canonical").transformWithStateInPandas(
        TopCounter(idle_days), "event_id string, pan_canonical string, emv_cryptogram_atc long, regressed boolean", "append", "EventTime")


class Payers(StatefulProcessor):
    """Distinct payers a payee has asked within an hour, at each of its requests.

    Payers are keys of a map in the state store, so a payee with very many is not held in memory; the hour's state goes when it ends.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getMapState("asked", "payer string", "n long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        n = self.count.get()[0] if self.count.exists() else 0
        else_ = not self.count.exists()
        first = ~new["cardholder_id"].duplicated().to_numpy()
        out = []
        for payer, maybe in zip(new["cardholder_id"].tolist(), first.tolist(), strict=True):
            if maybe and (else_ or not self.asked.containsKey((payer,))):
                self.asked.updateValue((payer,), (1,))
                n += 1
            out.append(n)
        self.count.update((n,))
        if else_:
            self.handle.registerTimer(int(key[1] + 1) * 3_600_000)
        yield pd.DataFrame({"event_id": new["event_id"], "payee_vpa": key[0], "collect_fanout": np.array(out, np.int64)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.asked.clear()
        self.count.clear()
        yield from ()

    def close(self) -> None:
        pass


def live_fanout(events: DataFrame, threshold: int = 25, delay: str = "1 hour") -> DataFrame:
    """Stream of (event_id, payee_vpa, collect_fanout, reached): every collect request with its payee's payers so far this hour."""
    rows = events.filter((c("message_kind") == "collect_request") & (c("payee_vpa") != "")).select(
        "event_id", "ts", "payee_vpa", F.coalesce("cardholder_id", F.lit("")).alias("cardholder_id"), F.floor(c("ts") / 3600).cast("long").alias("hour"),
        c("ts").cast("timestamp").alias("at")).withWatermark("at", delay)
    counted = rows.groupBy("payee_vpa", "hour").transformWithStateInPandas(Payers(), "event_id string, payee_vpa string, collect_fanout long", "append", "EventTime")
    return counted.withColumn("reached", c("collect_fanout") >= threshold)


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """For a stream that starts inside: keyed state in RocksDB, and a state store per core; the session's own settings are put back.

    Each micro-batch commits every state store, rows or not, so more stores than cores cost time a batch and nothing else.  A
    stream that goes on from a checkpoint keeps the number it began with.
    """
    own = {STATE_STORE_CONF: ROCKS, PARTITIONS_CONF: str(min(int(spark.conf.get(PARTITIONS_CONF)), max(LEAST_PARTITIONS, spark.sparkContext.defaultParallelism)))}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def run_batches(stream: DataFrame, folder: str, stop_after: int | None = None) -> DataFrame:
    """Process all the replay holds, micro-batch by micro-batch, into a table under the folder, and read it.

    ``stop_after`` stops once so many micro-batches are done; a later call on the same folder goes on from there.
    """
    spark: SparkSession = stream.sparkSession
    package_on_path(spark)
    with stream_settings(spark):
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").start()
    try:
        if stop_after is None:
            query.processAllAvailable()
        else:
            while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] + 1 < stop_after):
                query.awaitTermination(0.05)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
