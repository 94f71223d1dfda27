"""Column expressions shared by features, rules, scores and metrics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, for array work that is not compiled into the stage."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def flag_where(scope: Column, cond: Column) -> Column:
    """1/0 where the scope holds, -1 outside."""
    return F.when(scope, flag(cond)).otherwise(-1.0)


def ordinal(col: Column, order: Sequence[str]) -> Column:
    """Position in a fixed list, -1 for anything else."""
    return (F.coalesce(F.array_position(F.array(*[F.lit(v) for v in order]), col), F.lit(0)) - 1).cast("double")


def band(v: Column, edges: Sequence[float]) -> Column:
    """Index of the first edge above the value, ``len(edges)`` beyond the last, -1 below zero."""
    out = F.when(v < 0, -1.0)
    for i, e in enumerate(edges):
        out = out.when(v < e, float(i))
    return out.otherwise(float(len(edges)))


def ratio_where(num: Column, den: Column, cond: Column, fill: float = -1.0) -> Column:
    return F.coalesce(F.when(cond, num / F.nullif(den, F.lit(0.0))), F.lit(fill))


def log1p_where(v: Column, cond: Column, fill: float = -1.0) -> Column:
    return F.when(cond, F.log1p(v)).otherwise(fill)


def tokens(text: Column) -> Column:
    """Distinct upper-case words."""
    return F.array_distinct(F.filter(F.split(F.upper(text), r"\s+"), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    pair = F.struct(tokens(F.coalesce(a, F.lit(""))).alias("a"), tokens(F.coalesce(b, F.lit(""))).alias("b"))

    def overlap(p: Column) -> Column:
        # The words of each side are distinct, so the union's size follows from the intersection's.
        common = F.size(F.array_intersect(p["a"], p["b"]))
        return let(common, lambda n: F.when((F.size(p["a"]) > 0) & (F.size(p["b"]) > 0), n / (F.size(p["a"]) + F.size(p["b"]) - n)).otherwise(0.0))
    return let(pair, overlap)


def entropy_of(values: Column) -> Column:
    """Shannon entropy (nats) of an array's values."""
    def total(v: Column) -> Column:
        n = F.size(v).cast("double")
        counts = F.transform(F.array_distinct(v), lambda x: F.size(F.filter(v, lambda y: y == x)).cast("double"))
        return F.ln(n) - F.aggregate(counts, F.lit(0.0), lambda acc, k: acc + k * F.ln(k)) / n
    return let(values, total)


def rolling_entropy(values: Column) -> Column:
    """Entropy over log of the distinct values (at least 2), -1 below three values."""
    def scaled(v: Column) -> Column:
        kinds = F.greatest(F.size(F.array_distinct(v)), F.lit(2)).cast("double")
        return F.when(F.size(v) >= 3, entropy_of(v) / F.ln(kinds)).otherwise(-1.0)
    return let(values, scaled)


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.size(values), F.lit(0))


def array_cv(values: Column) -> Column:
    """Population coefficient of variation, -1 below three values or for a mean near zero."""
    def spread(p: Column) -> Column:
        mean = p["m"]
        var = F.aggregate(p["v"], F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / F.size(p["v"])
        return F.when(F.abs(mean) > 1e-12, F.sqrt(var) / F.nullif(mean, F.lit(0.0))).otherwise(-1.0)
    pair = let(values, lambda v: F.struct(v.alias("v"), array_mean(v).alias("m")))
    return F.when(F.size(values) >= 3, let(pair, spread)).otherwise(-1.0)


def array_median(values: Column) -> Column:
    """Median of an array, null when empty."""
    def middle(s: Column) -> Column:
        n = F.size(s)
        lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
        return F.when(n > 0, (F.get(s, lo) + F.get(s, hi)) / 2.0)
    return let(F.sort_array(values), middle)


def circular_gap(a: Column, b: Column, period: float) -> Column:
    gap = F.abs(a - b)
    return F.least(gap, F.lit(period) - gap)


def nearest(v: Column, points: Sequence[float]) -> Column:
    """The fixed point closest to the value (the earlier one on a tie)."""
    arr = F.array(*[F.lit(float(p)) for p in points])
    pick = F.array_min(F.transform(arr, lambda p, i: F.struct(F.abs(v - p).alias("d"), i.alias("i"), p.alias("p"))))
    return pick["p"]


def first_match(cases: Sequence[tuple[Column, object]], default) -> Column:
    out = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default)


def mapped(col: Column, table: Mapping[str, object], default=None) -> Column:
    """Constant table lookup inside the projection."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.create_map(*pairs)[col]
    return hit if default is None else F.coalesce(hit, F.lit(default))


def starts_with_any(col: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.startswith(p) for p in prefixes])


def credit_band(limit: Column) -> Column:
    return first_match([(limit >= 200_000, "hi"), (limit >= 50_000, "mid"), (limit >= 0, "lo")], F.lit("nolimit"))


def mcc_band(mcc: Column) -> Column:
    # Merchant-category bands.
    return first_match([
        (mcc.isin("6011", "6051", "6540", "4814"), "quasi_cash"),
        (starts_with_any(mcc, ("54", "58")), "grocery_dining"),
        (starts_with_any(mcc, ("41", "47", "70")), "travel"),
        (starts_with_any(mcc, ("59", "57", "53")), "retail"),
        (starts_with_any(mcc, ("80", "82")), "health_education"),
        (mcc == "", "none"),
    ], F.lit("other"))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of a proportion; (0, 1) bounds without trials are (0, 0)."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / n
    d = 1.0 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = F.lit(z) * F.sqrt(F.greatest(p * (1 - p) / n + z * z / (4.0 * n * n), F.lit(0.0))) / d
    lo = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    hi = F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(0.0)
    return lo, hi


def realised_mde(base_rate: float, n: Column, power_z: float = 0.8416212335729143) -> Column:
    """Smallest detectable rate movement, in percentage points, for a group of n."""
    return F.lit(100.0 * (Z95 + power_z) * math.sqrt(2.0 * base_rate * (1.0 - base_rate))) / F.sqrt(n)


def hash_unit(col: Column, salt: str = "") -> Column:
    """A stable number in [0, 1) per value: 52 bits of the MD5 of ``salt|value``; a null counts as empty text."""
    return hash_bits(col, salt, 13) / float(1 << 52)


def hash_bits(col: Column, salt: str, digits: int) -> Column:
    """The first hex digits (15 at most) of the MD5 of ``salt|value`` as a number."""
    text = F.concat(F.lit(f"{salt}|"), F.coalesce(col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")
