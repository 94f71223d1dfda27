"""Replay of a stored table as a stream in (ts, event_id) order, a fixed number of rows per micro-batch.

``prepare`` sorts the table into range-partitioned Parquet files and writes an index: one row per file with its bounds and
rows.  The stream reader's offset is the last (ts, event_id) handed out and how many rows that is; a micro-batch is the
next ``rows_per_batch`` rows, read as row ranges of files by the executors, ``slices`` ranges or few more; row groups are small, so a
range decodes little besides its own rows.  The driver reads the index and, for an offset, the two key columns of one row group.

The folder must be a place that both Spark and Arrow's file systems can open.  Where an application restarts, the reader goes on
after the last offset it handed out, kept under ``progress``; had that offset not reached the query's own
checkpoint, the next micro-batch spans both, so no row is lost or repeated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.plans.workers import package_on_path

FORMAT = "ordered_replay"
ROWS_PER_BATCH = 100_000
GROUP_BYTES, LEAST_SLICE = 4 << 20, 4096  # of a row group; rows of a range worth a task


def prepare(events: DataFrame, folder: str, order: Sequence[str] = ("ts", "event_id"), files: int | None = None) -> str:
    """Write the table in order, with its index, under the folder; ``order`` is the time and a unique id, neither null."""
    spark = events.sparkSession
    ranged = events.repartitionByRange(files, *order) if files else events.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/rows")
    rows = spark.read.schema(events.schema).parquet(f"{folder}/rows")
    key = F.struct(*order)
    index = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    index.select("file", "n", "low", "high").coalesce(1).write.parquet(f"{folder}/index")
    return folder


def replay(spark: SparkSession, folder: str, schema: StructType, rows_per_batch: int = ROWS_PER_BATCH, order: Sequence[str] = ("ts", "event_id"), progress: str | None = None) -> DataFrame:
    """The prepared table as a stream; ``progress`` is where the position is kept across restarts."""
    package_on_path(spark)
    spark.dataSource.register(OrderedReplay)
    reader = spark.readStream.format(FORMAT).schema(schema).option("path", folder).option("rowsPerBatch", rows_per_batch).option("order", ",".join(order))
    reader = reader.option("slices", spark.sparkContext.defaultParallelism)
    return reader.option("progress", progress or f"{folder}/progress-{uuid.uuid4().hex}").load()


def prepared_rows(spark: SparkSession, folder: str) -> int:
    """The rows of a prepared table, from its index."""
    return spark.read.parquet(f"{folder}/index").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@dataclass
class Rows(InputPartition):
    """A range of rows of one file."""

    file: str
    first: int
    last: int


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


class OrderedReplay(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ReplayReader({k.lower(): v for k, v in self.options.items()}, schema.names)


class ReplayReader(DataSourceStreamReader):
    """Offsets: rows handed out so far and the order key of the last of them."""

    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        import pyarrow.parquet as pq

        self.names, self.per_batch = names, int(options["rowsperbatch"])
        if self.per_batch < 1:
            raise ValueError("rowsPerBatch must be positive")
        self.order, self.progress, self.slices = options["order"].split(","), options["progress"], int(options.get("slices", 1))
        system, path = _place(options["path"])
        held = pq.read_table(f"{path}/index", filesystem=system).to_pylist()
        held.sort(key=lambda r: tuple(r["low"].values()))
        for before, after in zip(held, held[1:], strict=False):
            if tuple(before["high"].values()) >= tuple(after["low"].values()):
                raise ValueError(f"the files {before['file']} and {after['file']} overlap in {self.order}")
        self.files, self.start, total = [r["file"] for r in held], [], 0
        for r in held:
            self.start.append(total)
            total += r["n"]
        self.total = total
        self.at: int | None = None

    # -- the driver's side

    def initialOffset(self) -> dict:
        self.at = 0
        return {"rows": 0, **{k: "" for k in self.order}}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self._kept()
        self.at = min(self.total, self.at + self.per_batch)
        self._keep(self.at)
        return self._offset(self.at)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = int(start["rows"]), int(end["rows"])
        self.at = max(self.at or 0, last)
        out, step = [], max(LEAST_SLICE, -(-(last - first) // self.slices))
        for k, file in enumerate(self.files):
            low, high = self.start[k], self.start[k + 1] if k + 1 < len(self.files) else self.total
            begin, end = max(first, low), min(last, high)
            out += [Rows(file, at - low, min(at + step, end) - low) for at in range(begin, end, step)]
        return out

    def _offset(self, rows: int) -> dict:
        import pyarrow.parquet as pq

        if rows == 0:
            return {"rows": 0, **{k: "" for k in self.order}}
        k = max(i for i, s in enumerate(self.start) if s < rows)
        system, path = _place(self.files[k])
        with pq.ParquetFile(path, filesystem=system) as f:
            at = rows - 1 - self.start[k]
            for g in range(f.num_row_groups):
                n = f.metadata.row_group(g).num_rows
                if at < n:
                    row = f.read_row_group(g, columns=self.order).slice(at, 1).to_pylist()[0]
                    return {"rows": rows, **{c: str(row[c]) for c in self.order}}
                at -= n
        raise ValueError(f"{self.files[k]} has changed since it was prepared")

    def _kept(self) -> int:
        system, path = _place(self.progress)
        try:
            with system.open_input_stream(f"{path}/position.json") as f:
                return int(json.loads(f.read())["rows"])
        except FileNotFoundError:
            return 0

    def _keep(self, rows: int) -> None:
        system, path = _place(self.progress)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/position.next") as f:
            f.write(json.dumps({"rows": rows}).encode())
        system.move(f"{path}/position.next", f"{path}/position.json")

    # -- the executors' side

    def read(self, partition: Rows) -> Iterator:
        import pyarrow.parquet as pq

        system, path = _place(partition.file)
        at = 0
        with pq.ParquetFile(path, filesystem=system) as f:
            for g in range(f.num_row_groups):
                n = f.metadata.row_group(g).num_rows
                if at < partition.last and at + n > partition.first:
                    begin = at
                    for batch in f.iter_batches(row_groups=[g], columns=self.names):
                        low, high = max(partition.first - begin, 0), min(partition.last - begin, batch.num_rows)
                        if low < high:
                            yield batch.slice(low, high - low).select(self.names)
                        begin += batch.num_rows
                at += n
