"""Decide which groups are too large for one task, and where to cut them.

A group (an entity key, a cohort, the whole table) of more rows than one task should sort is *hot*.  A
hot group is cut along its order column into blocks of about half that many rows; ordered operators
then work block by block and add what earlier blocks carried in.  Only balance depends on the cut
points, never a result, so a plan made from the source's key columns serves every frame derived from it.

``planning(source)`` sets the source whose keys are counted, once per key set, for all operators built
inside; without it each operator counts the keys of the frame it is given.  No table of at most the
target's rows can hold a hot group, so such a table costs one count.

What is collected: the hot groups (fewer than rows / target) and their cuts (at most four times as many).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_ROWS_CONF = "spark.tidemark.blocks.targetRows"

#: Rows one task may sort; a group of more is cut.
DEFAULT_TARGET_ROWS = 2_000_000
#: Cuts of one group come from one quantile sketch, which resolves this many.
MAX_CUTS = 1 << 16
#: Up to this many hot groups are a literal list, more are a broadcast table.
MAX_LISTED = 1024
_FAN = 32


def target_rows(spark: SparkSession) -> int:
    value = spark.conf.get(TARGET_ROWS_CONF, None)
    return DEFAULT_TARGET_ROWS if value is None else int(value)


def over_cores(df: DataFrame) -> DataFrame:
    """Before heavy per-row work, deal out a scan that has fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def group_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def blank(df: DataFrame, keys: Sequence[str]) -> Column:
    """True where a key is missing: null, or the empty string for string keys."""
    types = dict(df.dtypes)
    out = F.lit(False)
    for k in keys:
        out = out | F.col(k).isNull()
        if types[k] == "string":
            out = out | (F.col(k) == "")
    return out


@dataclass(frozen=True)
class BlockPlan:
    """Hot groups of one key set, with the cut points of each along the order column."""

    keys: tuple[str, ...]
    cuts: dict[int, tuple[float, ...]] = field(default_factory=dict)

    def split(self, df: DataFrame, live: Column) -> tuple[DataFrame, DataFrame]:
        """The frame's rows of hot groups and all others; ``live`` marks rows that have a key."""
        if len(self.cuts) <= MAX_LISTED:
            hot = live & group_hash(self.keys).isin(list(self.cuts))
            return df.filter(hot), df.filter(~hot)
        listed = F.broadcast(df.sparkSession.createDataFrame([(h,) for h in self.cuts], "__h bigint"))
        marked = df.withColumn("__gh", F.when(live, group_hash(self.keys)))
        on = F.col("__gh") == F.col("__h")
        return marked.join(listed, on, "left_semi").drop("__gh"), marked.join(listed, on, "left_anti").drop("__gh")

    def mirrored(self) -> BlockPlan:
        """The same groups cut along the negated order column."""
        return BlockPlan(self.keys, {h: tuple(sorted(-c for c in cuts)) for h, cuts in self.cuts.items()})

    def with_block(self, df: DataFrame, order: str, out: str = "__blk") -> DataFrame:
        """Block number of each row of a hot group; equal order values always share a block.

        The cuts travel as a two-level array so that a row compares with few of them.
        """
        rows = []
        for h, cuts in self.cuts.items():
            fan = max(_FAN, int(len(cuts) ** 0.5) + 1)
            fine = [list(cuts[i:i + fan]) for i in range(0, len(cuts), fan)]
            rows.append((h, fan, [chunk[-1] for chunk in fine], fine + [[]]))
        table = df.sparkSession.createDataFrame(
            rows, "__gh bigint, __fan int, __coarse array<double>, __fine array<array<double>>"
        )
        v = F.col(order).cast("double")
        joined = df.withColumn("__gh", group_hash(self.keys)).join(F.broadcast(table), "__gh")
        step = F.size(F.filter("__coarse", lambda c: c <= v))
        inner = F.size(F.filter(F.col("__fine")[F.col("__step")], lambda c: c <= v))
        return (
            joined.withColumn("__step", step)
            .withColumn(out, (F.col("__step") * (F.col("__fan") + 1) + inner).cast("int"))
            .drop("__gh", "__fan", "__coarse", "__fine", "__step")
        )


class PlanBook:
    """The plans of a query's sources: the rows of each are counted once, and each key set once."""

    def __init__(self) -> None:
        self.sources: list[tuple[DataFrame, str | Column]] = []
        self.plans: dict[tuple[str, ...], BlockPlan] = {}
        self._counted, self._fits = 0, True

    def add(self, source: DataFrame, order: str | Column) -> None:
        self.sources.append((source, order))

    def fits(self) -> bool:
        """No source is large enough for a hot group; frames derived from them have a small multiple of their rows."""
        while self._counted < len(self.sources):
            source = self.sources[self._counted][0]
            self._fits = self._fits and source.count() <= target_rows(source.sparkSession)
            self._counted += 1
        return self._fits

    def plan(self, keys: Sequence[str]) -> BlockPlan | None:
        """The plan of those of the keys that are columns of an ordered source, the latest first; None where none are."""
        for source, order in reversed(self.sources):
            own = tuple(k for k in keys if k in source.columns)
            if own and not (isinstance(order, str) and order not in source.columns):
                if own not in self.plans:
                    self.plans[own] = count_and_cut(source, own, order)
                return self.plans[own]
        return None


_BOOK: ContextVar[PlanBook | None] = ContextVar("plan_book", default=None)


@contextmanager
def planning(source: DataFrame | None = None, order: str | Column = "ts_us") -> Iterator[None]:
    """Operators built inside share the plans of ``source`` and of frames offered inside; an outer ``planning`` is joined."""
    if _BOOK.get() is not None:
        if source is not None:
            offer(source, order)
        yield
        return
    token = _BOOK.set(PlanBook())
    try:
        if source is not None:
            offer(source, order)
        yield
    finally:
        _BOOK.reset(token)


def offer(source: DataFrame, order: str | Column = "ts_us") -> DataFrame:
    """Make the frame a source of the enclosing ``planning``, if any; ``order`` is what operators will order by."""
    book = _BOOK.get()
    if book is not None and not source.isStreaming:
        book.add(source, order)
    return source


_FEW: ContextVar[bool] = ContextVar("few_rows", default=False)


@contextmanager
def sized(table: DataFrame) -> Iterator[None]:
    """Operators built inside get frames of the rows of ``table``, which is written: where these are few, no key is counted."""
    few = no_hot_group(table) or table.count() <= target_rows(table.sparkSession)
    token = _FEW.set(few)
    try:
        yield
    finally:
        _FEW.reset(token)


def no_hot_group(df: DataFrame) -> bool:
    """Known without counting keys: the planned sources, or else the frame, have too few rows."""
    if _FEW.get():
        return True
    book = _BOOK.get()
    if book is not None and book.sources:
        return book.fits()
    return df.count() <= target_rows(df.sparkSession)


def plan_blocks(df: DataFrame, keys: Sequence[str], order: str) -> BlockPlan:
    """The hot groups of ``keys``, cut along ``order``: from the planned source where it has any of the keys."""
    keys = tuple(keys)
    if no_hot_group(df):
        return BlockPlan(keys)
    book = _BOOK.get()
    plan = book.plan(keys) if book is not None else None
    if plan is None:
        return count_and_cut(df, keys, order)
    return plan.mirrored() if order == "__neg" else plan


def count_and_cut(df: DataFrame, keys: Sequence[str], order: str | Column) -> BlockPlan:
    """One aggregation over the key columns (map-side combined), and one over the hot groups when there are any."""
    keys = tuple(keys)
    target = target_rows(df.sparkSession)
    live = df.filter(~blank(df, keys)).select(group_hash(keys).alias("h"), (F.col(order) if isinstance(order, str) else order).cast("double").alias("o"))
    counts = live.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["h"]: r["n"] for r in counts.filter(F.col("n") > target).collect()}
    if not sizes:
        return BlockPlan(keys)
    blocks = {h: min(MAX_CUTS, -(-n // target) * 2) for h, n in sizes.items()}
    steps = max(64, 1 << (max(blocks.values()) - 1).bit_length())
    grid = [i / steps for i in range(1, steps)]
    hot = live.join(F.broadcast(df.sparkSession.createDataFrame([(h,) for h in sizes], "h bigint")), "h")  # fewer than rows / target
    points = hot.groupBy("h").agg(F.percentile_approx("o", grid, max(20_000, 10 * steps)).alias("p")).collect()
    cuts: dict[int, tuple[float, ...]] = {}
    for r in points:
        n = blocks[r["h"]]
        picked = {r["p"][min(len(grid) - 1, i * steps // n - 1)] for i in range(1, n)}
        cuts[r["h"]] = tuple(sorted(x for x in picked if x is not None))
    return BlockPlan(keys, {h: c for h, c in cuts.items() if c})
