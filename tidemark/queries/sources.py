"""Readers, writers and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.queries.labels import LABELS_SQL, labels
from tidemark.queries.registry import query
from tidemark.queries.standin import payments, payments_sql
from tidemark.schema import EVENT_SCHEMA, nullify, strip_oracle
from tidemark.sources import tables as T
from tidemark.streaming.twins import scratch


@query("event_table_round_trip", f"WITH {payments_sql('amount_inr', 'rail')} SELECT event_id, rail, amount_inr FROM pay WHERE amount_inr > 5000")
def _round_trip(spark, sf):
    """Write the event table, read three columns back with a filter that reaches the scan."""
    path = scratch(spark)
    T.write_events(payments(spark, sf), path)
    return T.read_events(spark, f"parquet:{path}", ["event_id", "rail", "amount_inr"]).filter("amount_inr > 5000")


@query("table_fingerprint")
def _fingerprint(spark, sf):
    return T.fingerprint(payments(spark, sf))


_PRINT = "concat_ws(chr(31), event_id, CAST(ts_us AS VARCHAR), rail, message_kind, CAST(day_index AS VARCHAR), pan_canonical, CAST(approved AS VARCHAR))"


@query("ordered_fingerprint", f"""WITH {payments_sql('rail', 'message_kind', 'day_index', 'pan_canonical', 'approved')}, h AS (SELECT ts_us, event_id, md5({_PRINT}) AS m FROM pay),
    f AS (SELECT count(*) AS n_rows, """ + ", ".join(
    f"list_reduce(list_prepend(0::HUGEINT, list(('0x' || substr(m, {1 + 7 * k}, 7))::HUGEINT ORDER BY ts_us, event_id)), lambda a, b: (a * {base} + b) % {prime}) AS f{k}"
    for k, (prime, base) in enumerate(T._MODULI)) + """ FROM h) SELECT n_rows, lower(printf('%08x%08x', f0::BIGINT, f1::BIGINT)) AS row_hash FROM f""")
def _ordered_fingerprint(spark, sf):
    """The events in time order; two swapped rows give another hash, another partitioning the same."""
    rows = payments(spark, sf).withColumn("ts_us", F.round(F.col("ts") * 1e6).cast("long"))
    return T.ordered_fingerprint(rows.select("event_id", "ts_us", "rail", "message_kind", "day_index", "pan_canonical", "approved"), ["ts_us", "event_id"]).drop("schema_hash")


@query("nullify_sentinels", f"""WITH {payments_sql('merchant_age_days', 'vpa', 'mandate_max_amount_inr')} SELECT count(*) AS n_rows, count(nullif(merchant_age_days, -1)) AS n_age, count(nullif(vpa, '')) AS n_vpa,
    count(nullif(mandate_max_amount_inr, -1)) AS n_cap FROM pay""")
def _nullify(spark, sf):
    df = nullify(payments(spark, sf))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count("merchant_age_days").alias("n_age"), F.count("vpa").alias("n_vpa"), F.count("mandate_max_amount_inr").alias("n_cap"))


@query("strip_oracle", f"WITH {payments_sql()} SELECT count(*) AS n_rows, CAST({len(EVENT_SCHEMA) - 9} AS INTEGER) AS n_columns FROM pay")
def _strip(spark, sf):
    df = strip_oracle(payments(spark, sf))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


@query("label_table_round_trip", f"WITH {LABELS_SQL} SELECT 'e' || event_id AS event_id, channel, as_of_ts, CAST(label AS BIGINT) AS label, poisoned FROM lab WHERE channel = 'chargeback'")
def _label_round_trip(spark, sf):
    """Write the label table with its schema asserted, read it back with a filter that reaches the scan."""
    path = scratch(spark)
    T.write_labels(labels(spark, sf).withColumn("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string"))), path)
    return T.read_labels(spark, path).filter("channel = 'chargeback'")
