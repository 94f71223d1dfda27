"""Helpers shared by the corpus operators: splits, text batches, tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.cut import written
from tidemark.plans.workers import package_on_path

__all__ = ["WORD", "ascii_lower", "bounded_batches", "code_points", "fresh", "held_out", "letters", "slices", "table", "written"]
BATCH_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
# The space characters of the contracts: \x20 and \x09-\x0D, which is what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Before Python tasks: Arrow batches of at most 16 MB in this session, so that very long texts do not pile up,
    and this package on the workers' path."""
    spark.conf.set(BATCH_BYTES_CONF, str(16 << 20))
    package_on_path(spark)


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text falls in the held-out class; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, name: str) -> str:
    """A column name the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        end = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = end[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(end, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point: is it a letter (str.isalpha)?"""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
