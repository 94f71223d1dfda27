"""Streaming forms of the causal counters, guards and late labels, each with a batch twin.

Window counters are native aggregations: partial sums per task, so a hot entity costs one row per task
and window.  Forms that answer per event keep state per key: ``streaming.keyed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.cut import shared_folder

c = F.col

# Counterparty observed for each entity key, label latency.
COUNTERPARTY = {
    "pan_canonical": "merchant_id", "token_id": "merchant_id", "token_requestor_id": "pan_canonical", "device_fingerprint_id": "cardholder_id",
    "terminal_id": "pan_canonical", "merchant_id": "pan_canonical", "bin_prefix": "merchant_id", "vpa": "payee_vpa", "beneficiary_id": "cardholder_id",
}
LABEL_DELAY = "120 days"


def observed(events: DataFrame) -> DataFrame:
    """One row per non-blank entity key of an event: key type, key, counterparty, amount, time, direction."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key_type"), c(k).alias("key"), c(cp).alias("counterparty")) for k, cp in COUNTERPARTY.items()])
    flow = F.when(c("message_kind") == "inbound_credit", 1).when(c("message_kind") == "onward_send", -1).otherwise(0)
    rows = events.select("event_id", "ts", c("amount_inr").alias("amount"), flow.alias("flow"), F.explode(pairs).alias("k"))
    return rows.select("event_id", c("ts").cast("timestamp").alias("at"), "amount", "flow", "k.key_type", "k.key", "k.counterparty").filter(c("key") != "")


def window_counters(rows: DataFrame, length: str = "24 hours", slide: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Count, amount and approximate distinct counterparties per entity in sliding windows."""
    late = rows.withWatermark("at", delay) if rows.isStreaming else rows
    span = F.window("at", length, slide)
    return late.groupBy(span.alias("w"), "key_type", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.approx_count_distinct(F.when(c("counterparty") != "", c("counterparty"))).alias("n_counterparties"),
        F.sum(F.when(c("flow") > 0, c("amount")).otherwise(0.0)).alias("inflow"), F.sum(F.when(c("flow") < 0, c("amount")).otherwise(0.0)).alias("outflow"),
    ).select(c("w.start").alias("w_start"), c("w.end").alias("w_end"), "key_type", "key", "n", "amount", "n_counterparties", "inflow", "outflow")


def collect_fanout(events: DataFrame, threshold: int = 25, delay: str = "1 hour") -> DataFrame:
    """Payees that asked at least ``threshold`` distinct payers within an hour: deduplicate, then count."""
    rows = events.filter((c("message_kind") == "collect_request") & (c("payee_vpa") != "")).select(c("ts").cast("timestamp").alias("at"), "payee_vpa", "cardholder_id")
    if rows.isStreaming:
        rows = rows.withWatermark("at", delay)
    hourly = rows.withColumn("w", F.window("at", "1 hour")).select("w", "payee_vpa", "cardholder_id")
    if not events.isStreaming:
        return hourly.groupBy("w", "payee_vpa").agg(F.countDistinct("cardholder_id").alias("n_payers")).filter(c("n_payers") >= threshold).select(
            c("w.start").alias("w_start"), "payee_vpa", "n_payers")
    pairs = hourly.groupBy("w", "payee_vpa", "cardholder_id").agg(F.count(F.lit(1)).alias("asked"))
    counted = pairs.groupBy("w", "payee_vpa").agg(F.count(F.lit(1)).alias("n_payers"))
    return counted.filter(c("n_payers") >= threshold).select(c("w.start").alias("w_start"), "payee_vpa", "n_payers")


WINDOW_S = {"1h": 3600.0, "24h": 86_400.0, "7d": 604_800.0, "30d": 2_592_000.0}


def footprint(rows: DataFrame) -> DataFrame:
    """Active entities per key type."""
    return rows.groupBy("key_type").agg(F.approx_count_distinct("key", 0.02).alias("active_entities"))


def late_labels(events: DataFrame, labels: DataFrame, delay: str = LABEL_DELAY) -> DataFrame:
    """Each event with the labels that arrive within the latency bound; unlabelled ones when it has passed."""
    e = events.select("event_id", c("ts").cast("timestamp").alias("at"))
    lab = labels.select(c("event_id").alias("label_event"), c("as_of_ts").cast("timestamp").alias("as_of"), "channel", "label")
    if e.isStreaming:
        e, lab = e.withWatermark("at", "1 day"), lab.withWatermark("as_of", "1 day")
    bound = F.expr(f"event_id = label_event AND as_of >= at AND as_of <= at + INTERVAL {delay}")
    return e.join(lab, bound, "leftOuter").drop("label_event")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what the source holds, write it as Parquet under the folder and read it back."""
    spark = stream.sparkSession
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/rows")
             .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def scratch(spark) -> str:
    """A new folder under the session's shared checkpoint folder."""
    import uuid

    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
