"""Late labels upserted into a snapshot: one row per event with its winning label.

Each micro-batch adds a run of winners to the parts (hashes of event ids) its labels fall in, merged with the part's latest
runs that are no larger; so a part has few runs (log of the batches), a record is rewritten as often, and a reader lets the
runs of a part meet.  It publishes a manifest under the batch's number: every part's runs, with their records.  A batch that is delivered again finds its number taken and changes nothing; one that
died half-way left no manifest and is done anew.  The winner is the one of ``labels.resolve``, so a record that comes
twice, in one batch or in two, changes nothing either.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.labels import PRECEDENCE
from tidemark.sources.versions import manifest, numbers, publish

PARTS = 64
SCHEMA_NAMES = ("label", "channel", "as_of", "lowest", "highest")


def _winners(records: DataFrame) -> DataFrame:
    """(event_id, label, channel, as_of, lowest, highest): ``won`` orders records, the latest arrival is kept apart."""
    key = F.struct(S.mapped(F.col("channel"), PRECEDENCE, 0), F.col("as_of_ts"), F.col("label"))
    return records.groupBy("event_id").agg(
        F.max_by("label", key).alias("label"), F.max_by("channel", key).alias("channel"), F.max_by("as_of_ts", key).alias("as_of_ts"),
        F.max("as_of").alias("as_of"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))


def _part(parts: int):
    return F.pmod(F.xxhash64("event_id"), F.lit(parts)).cast("int")


def _runs(held: list | str) -> list[list]:
    """A part's runs, the oldest first, as [folder, records]; a folder alone is a part that was written whole."""
    return [[held, 0]] if isinstance(held, str) else held


def snapshot(spark: SparkSession, folder: str, number: int | None = None, parts_of: list[int] | None = None) -> DataFrame | None:
    """The stored winners after a batch (the latest by default); None before the first."""
    found = manifest(spark, folder, number)
    if found is None:
        return None
    picked = [_runs(p) for k, p in sorted(found["parts"].items()) if parts_of is None or int(k) in parts_of]
    paths = [path for runs in picked for path, _ in runs]
    if not paths:
        return spark.createDataFrame([], found["schema"])
    rows = spark.read.schema(found["schema"]).parquet(*paths)
    return rows if all(len(runs) == 1 for runs in picked) else _winners(rows)


def upsert(batch: DataFrame, folder: str, batch_id: int, parts: int = PARTS) -> bool:
    """Merge a batch of (event_id, channel, as_of_ts, label) records; False where the batch was merged before."""
    spark = batch.sparkSession
    known = numbers(spark, folder)
    if known and known[-1] >= batch_id + 1:
        return False
    counts = {r["part"]: r["n"] for r in batch.groupBy(_part(parts).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``parts``
    new = _winners(batch.select("event_id", "channel", "as_of_ts", "label", F.col("as_of_ts").alias("as_of"), F.col("label").alias("lowest"), F.col("label").alias("highest")))
    before = manifest(spark, folder)
    if before is not None and before["n_parts"] != parts:
        raise ValueError(f"the snapshot has {before['n_parts']} parts, not {parts}")
    old, runs = [], {int(k): list(_runs(p)) for k, p in (before["parts"] if before else {}).items()}
    path = f"{folder}/batch-{batch_id}-{uuid.uuid4().hex}"
    for k, n in counts.items():
        own = runs.setdefault(k, [])
        while own and own[-1][1] <= n:
            place, more = own.pop()
            old.append(place)
            n += more
        own.append([f"{path}/part={k}", n])
    merged = _winners(spark.read.schema(before["schema"]).parquet(*old).unionByName(new)) if old else new
    merged.withColumn("part", _part(parts)).repartition("part").write.partitionBy("part").parquet(path)
    schema = ", ".join(f"{n} {t}" for n, t in merged.dtypes)
    return publish(spark, folder, batch_id + 1, {"parts": {str(k): own for k, own in runs.items()}, "n_parts": parts, "schema": schema})


def keep_labels(labels: DataFrame, folder: str, progress: str, parts: int = PARTS):
    """Start the stream that merges each micro-batch of labels into the snapshot."""
    return labels.writeStream.foreachBatch(lambda batch, k: upsert(batch, folder, k, parts) and None).option("checkpointLocation", progress).start()


def resolved(rows: DataFrame) -> DataFrame:
    """(event_id, label, channel, disagree, as_of) of a snapshot, as ``labels.resolve`` gives them."""
    return rows.select("event_id", "label", "channel", (F.col("lowest") != F.col("highest")).alias("disagree"), "as_of")
