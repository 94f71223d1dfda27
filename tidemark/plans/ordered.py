"""Ordered prefix columns per group, safe for groups that hold a large part of the table.

``ordered(df, keys, order, specs)`` adds one column per spec.  Ordinary groups go through one
window per key set.  Groups found hot are cut into blocks (see ``blocks``): the same window runs per
(group, block), a small table of block totals is accumulated over the blocks of a group, and each
row combines its in-block value with what earlier blocks carried in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.plans.blocks import BlockPlan, blank, plan_blocks

UNB = Window.unboundedPreceding


@dataclass(frozen=True)
class Running:
    """sum / count / min / max over the rows before the current one (or up to it)."""

    how: str
    value: Column
    inclusive: bool = False

    def _agg(self) -> Column:
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[self.how](self.value)

    def local(self, w: WindowSpec) -> Column:
        out = self._agg().over(w.rowsBetween(UNB, 0 if self.inclusive else -1))
        return F.coalesce(out, F.lit(0)) if self.how in ("sum", "count") else out

    def total(self, order: Sequence[str]) -> Column:
        return self._agg()

    def carried(self, total: Column, w: WindowSpec) -> Column:
        fold = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[self.how]
        return fold(total).over(w.rowsBetween(UNB, -1))

    def merge(self, local: Column, carry: Column) -> Column:
        if self.how in ("sum", "count"):
            return local + F.coalesce(carry, F.lit(0))
        return (F.least if self.how == "min" else F.greatest)(local, carry)

    def final(self, merged: Column) -> Column:
        return merged


def _position(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


@dataclass(frozen=True)
class Prev:
    """Value of the previous row of the group (null on the first)."""

    value: Column

    def local(self, w: WindowSpec) -> Column:
        return F.lag(F.struct(self.value.alias("v"))).over(w)

    def total(self, order: Sequence[str]) -> Column:
        return F.max_by(F.struct(self.value.alias("v")), _position(order))

    def carried(self, total: Column, w: WindowSpec) -> Column:
        return F.lag(total).over(w)

    def merge(self, local: Column, carry: Column) -> Column:
        return F.coalesce(local, carry)

    def final(self, merged: Column) -> Column:
        return merged["v"]


@dataclass(frozen=True)
class Next(Prev):
    """Value of the next row of the group (null on the last)."""

    def local(self, w: WindowSpec) -> Column:
        return F.lead(F.struct(self.value.alias("v"))).over(w)

    def total(self, order: Sequence[str]) -> Column:
        return F.min_by(F.struct(self.value.alias("v")), _position(order))

    def carried(self, total: Column, w: WindowSpec) -> Column:
        return F.lead(total).over(w)


@dataclass(frozen=True)
class LastWhere(Prev):
    """Value at the latest earlier row where ``cond`` holds."""

    cond: Column = None

    def local(self, w: WindowSpec) -> Column:
        hit = F.when(self.cond, F.struct(self.value.alias("v")))
        return F.last(hit, ignorenulls=True).over(w.rowsBetween(UNB, -1))

    def total(self, order: Sequence[str]) -> Column:
        hit = F.when(self.cond, F.struct(self.value.alias("v")))
        return F.max_by(hit, F.when(self.cond, _position(order)))

    def carried(self, total: Column, w: WindowSpec) -> Column:
        return F.last(total, ignorenulls=True).over(w.rowsBetween(UNB, -1))


@dataclass(frozen=True)
class LastN:
    """The last ``n`` earlier values, oldest first, as an array of structs with field ``v``."""

    value: Column
    n: int

    def local(self, w: WindowSpec) -> Column:
        return F.collect_list(F.struct(self.value.alias("v"))).over(w.rowsBetween(-self.n, -1))

    def inclusive(self, w: WindowSpec) -> Column:
        return F.collect_list(F.struct(self.value.alias("v"))).over(w.rowsBetween(1 - self.n, 0))

    def carried(self, total: Column, w: WindowSpec) -> Column:
        parts = F.flatten(F.collect_list(total).over(w.rowsBetween(-self.n, -1)))
        return F.slice(parts, F.greatest(F.size(parts) - self.n + 1, F.lit(1)), self.n)

    def merge(self, local: Column, carry: Column) -> Column:
        both = F.concat(F.coalesce(carry, F.slice(local, 1, 0)), local)
        return F.slice(both, F.greatest(F.size(both) - self.n + 1, F.lit(1)), self.n)

    def final(self, merged: Column) -> Column:
        return merged


Spec = Running | Prev | Next | LastWhere | LastN


def spread(df: DataFrame, keys: Sequence[str], tie: str) -> Column:
    """Extra partition column that scatters rows with a blank key, which form no group."""
    return F.when(blank(df, keys), F.xxhash64(F.col(tie), F.lit(7))).otherwise(F.lit(0))


def group_window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "__sp").orderBy(*order)


def _whole(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: Mapping[str, Spec]) -> DataFrame:
    w = group_window(keys, order)
    out = df.withColumn("__sp", spread(df, keys, order[-1]))
    return out.select("*", *[s.final(s.local(w)).alias(n) for n, s in specs.items()]).drop("__sp")


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: Mapping[str, Spec], plan: BlockPlan) -> DataFrame:
    rows = plan.with_block(df, order[0])
    group = [*keys, "__blk"]
    w = Window.partitionBy(*group).orderBy(*order)
    local = rows.select("*", *[s.local(w).alias(f"__l_{n}") for n, s in specs.items()])

    along = Window.partitionBy(*keys).orderBy("__blk")
    scalar = {n: s for n, s in specs.items() if not isinstance(s, LastN)}
    listed = {n: s for n, s in specs.items() if isinstance(s, LastN)}
    totals = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__rows"), *[s.total(order).alias(f"__t_{n}") for n, s in scalar.items()]
    )
    if listed:
        tails = (
            rows.select(
                *group,
                F.lead(F.lit(1)).over(w).alias("__more"),
                *[s.inclusive(w).alias(f"__t_{n}") for n, s in listed.items()],
            )
            .filter(F.col("__more").isNull())
            .drop("__more")
        )
        totals = totals.join(tails, group)
    carry = totals.select(*group, *[s.carried(F.col(f"__t_{n}"), along).alias(f"__c_{n}") for n, s in specs.items()])
    # Where the plan's own keys are the group, the carries are one row per block, which is bounded by the cuts.
    joined = local.join(F.broadcast(carry) if set(keys) == set(plan.keys) else carry, group, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[s.final(s.merge(F.col(f"__l_{n}"), F.col(f"__c_{n}"))).alias(n) for n, s in specs.items()],
    )


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Mapping[str, Spec],
    plan: BlockPlan | None = None,
) -> DataFrame:
    """Add one column per spec, over the rows of each group in ``order`` (ascending).

    The last order column must be unique within a group.  Rows with a blank key form groups of one.
    """
    plan = plan_blocks(df, keys, order[0]) if plan is None else plan
    if not plan.cuts:
        return _whole(df, keys, order, specs)
    hot, rest = plan.split(df, ~blank(df, keys))
    return _whole(rest, keys, order, specs).unionByName(_cut(hot, keys, order, specs, plan))
