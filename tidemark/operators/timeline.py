"""Causal per-entity columns: everything a row may know from earlier rows of the same key.

A trailing frame of length w at row i holds the earlier rows (in ``(ts, event_id)`` order) whose
time is at least ``ts_i - w``; earlier rows with an equal timestamp count.  A ``Timeline`` collects
the columns wanted for one key so that they share one shuffle and one sort.

Ordinary keys: trailing sum = (sum before me) - (sum with time < ts_i - w), two incremental frames
over the same sort.  Hot keys: every row also enters the stream a second time at ``ts + w`` with its
value negated, so the trailing sum is one running sum, which can be cut into blocks.  Sums are exact
(decimals with twelve places), so both ways give the same value and no large value leaves a residue once
it has left the frame; a value beyond 10^26 or not finite counts as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.blocks import BlockPlan, blank, plan_blocks
from tidemark.plans.ordered import (
    UNB, LastN, LastWhere, Next, Prev, Running, Spec, group_window, ordered, spread,
)

EXACT = "decimal(38,12)"
HOUR, DAY = 3600, 86_400
WINDOWS = {"1h": HOUR, "24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY}


def micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


class Timeline:
    """Builder of causal columns over one key."""

    def __init__(
        self,
        df: DataFrame,
        keys: str | Sequence[str],
        ts: str = "ts_us",
        tie: str = "event_id",
        plan: BlockPlan | None = None,
    ) -> None:
        self.df = df
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.ts, self.tie = ts, tie
        self.order = [ts, tie]
        self.plan = plan
        self._prefix: dict[str, Spec] = {}
        self._trailing: dict[str, tuple[Column, int]] = {}

    def add(self, name: str, spec: Spec) -> "Timeline":
        self._prefix[name] = spec
        return self

    def prev(self, name: str, value: Column) -> "Timeline":
        return self.add(name, Prev(value))

    def next(self, name: str, value: Column) -> "Timeline":
        return self.add(name, Next(value))

    def last_n(self, name: str, value: Column, n: int) -> "Timeline":
        return self.add(name, LastN(value, n))

    def last_where(self, name: str, cond: Column, value: Column) -> "Timeline":
        return self.add(name, LastWhere(value, cond))

    def running(self, name: str, how: str, value: Column, inclusive: bool = False) -> "Timeline":
        return self.add(name, Running(how, value, inclusive))

    def trailing_sum(self, name: str, value: Column, seconds: float) -> "Timeline":
        self._trailing[name] = (value.cast("double").try_cast(EXACT), micros(seconds))
        return self

    def trailing_count(self, name: str, seconds: float) -> "Timeline":
        self._trailing[name] = (F.lit(1).cast("long"), micros(seconds))
        return self

    def build(self) -> DataFrame:
        df = self.df
        if not self._prefix and not self._trailing:
            return df
        plan = plan_blocks(df, self.keys, self.ts) if self.plan is None else self.plan
        if not plan.cuts:
            return self._whole(df)
        hot, rest = plan.split(df, ~blank(df, self.keys))
        return self._whole(rest).unionByName(self._hot(hot, plan))

    def _whole(self, df: DataFrame) -> DataFrame:
        rows = group_window(self.keys, self.order)
        times = group_window(self.keys, [self.ts])
        cols = [s.final(s.local(rows)).alias(n) for n, s in self._prefix.items()]
        for name, (value, width) in self._trailing.items():
            so_far = F.sum(value).over(rows.rowsBetween(UNB, -1))
            expired = F.sum(value).over(times.rangeBetween(UNB, -(width + 1)))
            cols.append((F.coalesce(so_far, F.lit(0)) - F.coalesce(expired, F.lit(0))).cast("double").alias(name))
        return df.withColumn("__sp", spread(df, self.keys, self.tie)).select("*", *cols).drop("__sp")

    def _hot(self, df: DataFrame, plan: BlockPlan) -> DataFrame:
        out = self._swept(df, plan) if self._trailing else df
        return ordered(out, self.keys, self.order, self._prefix, plan) if self._prefix else out

    def _swept(self, df: DataFrame, plan: BlockPlan) -> DataFrame:
        """Trailing sums as running sums over rows plus the expiry of each row."""
        named = df.select("*", *[v.alias(f"__v_{n}") for n, (v, _) in self._trailing.items()])
        widths = sorted({w for _, w in self._trailing.values()})
        values = [f"__v_{n}" for n in self._trailing]
        arrivals = named.withColumn("__kind", F.lit(0)).withColumn("__w", F.lit(0).cast("long"))
        slim = named.select(*self.keys, self.ts, self.tie, *values)
        expiries = (
            slim.withColumn("__w", F.explode(F.array(*[F.lit(w).cast("long") for w in widths])))
            .withColumn(self.ts, F.col(self.ts) + F.col("__w"))
            .withColumn("__kind", F.lit(1))
        )
        both = arrivals.unionByName(expiries, allowMissingColumns=True)
        # Expiries sort after every row of their time: a row exactly w old still counts.
        both = both.withColumn("__id", F.struct(F.col("__kind"), F.col("__w"), F.col(self.tie)))
        specs: dict[str, Spec] = {}
        for n, (_, width) in self._trailing.items():
            v = F.col(f"__v_{n}")
            signed = F.when(F.col("__kind") == 0, v).when(F.col("__w") == width, -v)
            specs[f"__s_{n}"] = Running("sum", signed)
        swept = ordered(both, self.keys, [self.ts, "__id"], specs, plan).filter(F.col("__kind") == 0)
        return swept.select(*[F.col(c) for c in df.columns], *[F.col(f"__s_{n}").cast("double").alias(n) for n in self._trailing])


def novelty(
    df: DataFrame, keys: Sequence[str], value: Sequence[str], out: str, ts: str = "ts_us", tie: str = "event_id",
) -> DataFrame:
    """1.0 on the first sight of ``value`` for the key over all history; 0.0 for a blank key.

    A blank value is a value, so it is wrapped before it becomes part of the group.
    """
    marked = df.withColumn("__nv", F.struct(*[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in value]))
    built = ordered(marked, [*keys, "__nv"], [ts, tie], {"__seen": Prev(F.lit(1))})
    flag = F.when(blank(df, keys), 0.0).otherwise(F.when(F.col("__seen").isNull(), 1.0).otherwise(0.0))
    return built.withColumn(out, flag).drop("__seen", "__nv")


def trailing_distinct(
    df: DataFrame,
    keys: Sequence[str],
    counterparty: str,
    windows: dict[str, float],
    ts: str = "ts_us",
    tie: str = "event_id",
) -> DataFrame:
    """Distinct non-blank counterparties in each trailing window, one column per window.

    A counterparty is live from its row until its next row or until ``w`` has passed, whichever
    comes first.  Rows open and hand over these spans, unclaimed expiries close them, and one running
    sum reads the number of open spans.  No sets are held and no frame is rescanned.
    """
    cp_blank = blank(df, [counterparty])
    pair = [*keys, counterparty]
    linked = ordered(
        df.withColumn("__row", F.col(tie)), pair, [ts, tie],
        {"__before": Prev(F.col(ts)), "__after": Next(F.col(ts))},
    )
    widths = {n: micros(s) for n, s in windows.items()}
    live = ~cp_blank & ~blank(df, keys)
    arrivals = linked.withColumn("__kind", F.lit(0)).withColumns({
        f"__d_{n}": F.when(live & (F.col("__before").isNull() | (F.col(ts) - F.col("__before") > w)), 1)
        .otherwise(0)
        for n, w in widths.items()
    })
    ends = [
        F.when(F.col("__after").isNull() | (F.col("__after") - F.col(ts) > w),
               F.struct(F.lit(n).alias("n"), F.lit(w).cast("long").alias("w")))
        for n, w in widths.items()
    ]
    expiries = (
        linked.filter(live)
        .select(*keys, ts, tie, F.explode(F.array_compact(F.array(*ends))).alias("__e"))
        .withColumn(ts, F.col(ts) + F.col("__e.w"))
        .withColumns({f"__d_{n}": F.when(F.col("__e.n") == n, -1).otherwise(0) for n in widths})
        .withColumn("__kind", F.lit(1))
        .withColumn("__w", F.col("__e.w"))
        .drop("__e")
    )
    arrivals = arrivals.withColumn("__w", F.lit(0).cast("long"))
    both = arrivals.unionByName(expiries, allowMissingColumns=True)
    both = both.withColumn("__id", F.struct("__kind", "__w", tie))
    specs = {f"__r_{n}": Running("sum", F.col(f"__d_{n}")) for n in widths}
    read = ordered(both, keys, [ts, "__id"], specs).filter(F.col("__kind") == 0)
    no_key = blank(df, keys)
    return read.select(
        *[F.col(c) for c in df.columns],
        *[F.when(no_key, 0.0).otherwise(F.col(f"__r_{n}").cast("double")).alias(n) for n in widths],
    )


def trailing_max(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    seconds: float,
    out: str,
    ts: str = "ts_us",
    tie: str = "event_id",
) -> DataFrame:
    """Maximum over the trailing window, null when it is empty.

    Time is cut at multiples of w, so a frame is the head of one slice plus the tail of the slice
    before: a running maximum forwards, and one backwards that is read at ``ts - w``.  Both are
    prefix columns, linear in the rows however long the frame is.
    """
    w = micros(seconds)
    base = df.withColumn("__v", value.cast("double")).withColumn("__g", F.floor(F.col(ts) / w).cast("long"))
    head = ordered(base, [*keys, "__g"], [ts, tie], {"__head": Running("max", F.col("__v"))})
    rows = base.select(*keys, "__g", ts, tie, "__v").withColumn("__kind", F.lit(0))
    probes = rows.withColumns({
        "__g": F.col("__g") - 1, ts: F.col(ts) - w, "__kind": F.lit(1), "__v": F.lit(None).cast("double"),
    })
    back = (
        rows.unionByName(probes)
        .withColumn("__neg", -F.col(ts))
        .withColumn("__id", F.struct("__kind", tie))
    )
    tails = (
        ordered(back, [*keys, "__g"], ["__neg", "__id"], {"__tail": Running("max", F.col("__v"))})
        .filter((F.col("__kind") == 1) & F.col("__tail").isNotNull())
        .select(F.col(tie).alias("__probe"), "__tail")
    )
    joined = head.join(tails, head[tie] == tails["__probe"], "left")
    no_key = blank(df, keys)
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.when(~no_key, F.greatest("__head", "__tail")).alias(out),
    )
