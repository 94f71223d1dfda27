"""Event and label tables on Parquet: exact schemas, batch and stream readers, sinks, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.ordered import Running, ordered
from tidemark.schema import EVENT_SCHEMA, LABEL_SCHEMA, check_columns


def read_table(spark: SparkSession, path: str, schema: T.StructType, what: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet with exactly the expected columns; a missing path or a drifted schema is an error.

    The file schema is checked, then the known one is applied, so pruning and filters reach the scan.
    """
    found = spark.read.parquet(path)
    check_columns(found, schema, what)
    df = spark.read.schema(schema).parquet(path)
    return df.select(*columns) if columns else df


def read_events(spark: SparkSession, spec: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``parquet:<path>`` for a batch frame, ``stream:<folder>`` for a file stream of the same table."""
    kind, _, path = spec.partition(":")
    if kind == "parquet":
        return read_table(spark, path, EVENT_SCHEMA, "events", columns)
    if kind == "stream":
        df = spark.readStream.schema(EVENT_SCHEMA).parquet(path)
        return df.select(*columns) if columns else df
    raise ValueError(f"unknown source {spec!r}; use parquet:<path> or stream:<folder>")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, LABEL_SCHEMA, "labels")


def write_table(df: DataFrame, path: str, schema: T.StructType, what: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write exactly the schema's columns, zstd-compressed; ``partition_by`` lets readers skip folders."""
    check_columns(df, schema, what)
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_events(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_table(df, path, EVENT_SCHEMA, "events", mode=mode)


def write_labels(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_table(df, path, LABEL_SCHEMA, "labels", mode=mode)


def stream_order(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in (ts, event_id) order across and within files."""
    ranged = df.repartitionByRange(partitions, "ts", "event_id") if partitions else df.repartitionByRange("ts", "event_id")
    return ranged.sortWithinPartitions("ts", "event_id")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-independent sum of row hashes, plus the schema's own hash."""
    row = F.xxhash64(*[F.col(n) for n in df.columns])
    shape = ",".join(f"{n}:{t}" for n, t in df.dtypes)
    # A wide decimal keeps the sum exact whatever the number of rows.
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("row_hash")).withColumn(
        "schema_hash", F.sha2(F.lit(shape), 256))


# Two primes below 2^31 with the base of each, digits of the exponent.
_MODULI = ((2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353))
_DIGIT, _DIGITS = 6, 8


def _power(exponent: Column, base: int, prime: int) -> Column:
    """base ^ exponent modulo the prime, from tables of 64 powers per six bits of the exponent."""
    out = F.lit(1).cast("long")
    for d in range(_DIGITS):
        powers = [pow(base, k << (_DIGIT * d), prime) for k in range(1 << _DIGIT)]
        digit = F.shiftright(exponent, _DIGIT * d).bitwiseAND((1 << _DIGIT) - 1).cast("int")
        out = F.pmod(out * F.get(F.array(*[F.lit(p).cast("long") for p in powers]), digit), F.lit(prime))
    return out


def ordered_fingerprint(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row (n_rows, row_hash, schema_hash) that depends on the order of the rows as well as on their values.

    The rows, in the order of the columns ``order`` (the first a number), are the coefficients of a polynomial over two
    prime fields: row i of n counts hash * base^(n - 1 - i).  A row's hash is taken from the MD5 of its values as text, nulls
    told apart.  Each row finds its own power, so sums combine in the tasks and neither partitions nor block cuts show.  Rows
    that are equal in ``order`` must be equal.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(n).cast("string"), F.lit("\x00")) for n in df.columns])
    digest = F.md5(text.cast("binary"))
    hashes = [F.conv(F.substring(digest, 1 + 7 * k, 7), 16, 10).cast("long").alias(f"h{k}") for k in range(2)]
    rows = df.select(*[F.col(o) for o in order], F.struct(F.lit(0).alias("all")).alias("__grp"), *hashes)
    placed = ordered(rows, ["__grp"], list(order), {"place": Running("count", F.lit(1))})
    n = F.lit(df.count()).cast("long")
    terms = [F.pmod(F.col(f"h{k}") * _power(n - 1 - F.col("place"), base, prime), F.lit(prime)).alias(f"t{k}") for k, (prime, base) in enumerate(_MODULI)]
    sums = [F.pmod(F.coalesce(F.sum(F.col(f"t{k}").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")), F.lit(prime).cast("decimal(38,0)")).cast("long") for k, (prime, _) in enumerate(_MODULI)]
    shape = ",".join(f"{name}:{kind}" for name, kind in df.dtypes)
    out = placed.select(*terms).agg(F.count(F.lit(1)).alias("n_rows"), F.format_string("%08x%08x", *sums).alias("row_hash"))
    return out.withColumn("schema_hash", F.sha2(F.lit(shape), 256))
