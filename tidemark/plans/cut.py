"""Cut a long lineage by writing the frame to the folder all executors share, and drop such tables when used up."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_MADE: ContextVar[list[str] | None] = ContextVar("tables_made", default=None)
_PLACE: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session without one gets its own."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: lineage ends here, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _MADE.get() is not None:
        _MADE.get().append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACE[out] = path
    return out


def discard(table: DataFrame) -> None:
    """Remove the table behind a frame that ``written`` returned; nothing may read it any more."""
    path = _PLACE.pop(table, None)
    if path is not None:
        _remove(table.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``written`` makes inside are removed at the end of the block.

    Yields a ``written`` whose tables stay (an enclosing block removes them with its own).  Nothing lazy that reads
    a table of the block may leave it.
    """
    made: list[str] = []
    kept: list[str] = []
    token = _MADE.set(made)

    def lasting(df: DataFrame) -> DataFrame:
        out = written(df)
        kept.append(made.pop())
        return out

    try:
        yield lasting
    finally:
        _MADE.reset(token)
        for path in made:
            _remove(spark, path)
        if _MADE.get() is not None:
            _MADE.get().extend(kept)


cut = written
