"""Whitening of embeddings by a weighted covariance over the distinct vectors.

Entries become the integers x = floor(``scale`` * c) + ``offset``.  Rows with equal x vectors are one row of the fit list,
with weight one or with their count.  Per-dimension sums are exact integers; the numerators n*x - S are formed in
integers and divided once, so centring loses nothing to the offset.  Each task multiplies its centred rows into a
d x d matrix and sends only that; the sum over tasks, divided by n, is the covariance.  Its unit eigenvectors, by falling
eigenvalue, whiten each distinct vector once, and rows get the result back by a join on their x vector.  A vector with
more rows than one task should hold is salted on both sides of that join.

The driver holds one d x d matrix per vector length and nothing that grows with the rows.

Edge cases: null vectors and vectors with null or non-finite entries are dropped; empty vectors have no component and
give no row; vectors of another length are a fit list of their own; components without variance (an eigenvalue below
d * 2.2e-16 of the largest) cannot be whitened and are left out, so equal vectors alone give no row; entries beyond 2^40 count
as 2^40; a deviation beyond 64 bits is null; repeated rows and rows without an id come back as often as they were given; an
empty table gives no rows; of equal eigenvalues the order is arbitrary but the same for all rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, written
from tidemark.plans.blocks import target_rows

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
_LARGEST = float(1 << 40)


def integer_vectors(rows: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, k, x): the rows that can be whitened, their x vector and its hash."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    entry = lambda c: F.floor(F.least(F.greatest(c.cast("double"), F.lit(-_LARGEST)), F.lit(_LARGEST)) * scale) + F.lit(offset)
    kept = rows.filter((F.size("embedding") > 0) & ~F.exists("embedding", bad))
    return kept.select("vec_id", F.transform("embedding", entry).alias("x")).select("vec_id", F.xxhash64("x").alias("k"), "x")


def by_length(part: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the arrays of each length in a batch."""
    size = pc.list_value_length(part.column(column)).to_numpy()
    flat = part.column(column).flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield int(d), at, flat[start[at][:, None] + np.arange(d)]


def totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By vector length: the summed weights and the weighted sums of each dimension, exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for part in batches:
            weight = part.column("weight").to_numpy()
            for d, at, x in by_length(part, "x"):
                own = weight[at][:, None]
                sums = np.stack([(own * (x >> 20)).sum(axis=0), (own * (x & 0xFFFFF)).sum(axis=0)])
                n, before = held.get(d, (0, 0))
                held[d] = n + int(weight[at].sum()), before + sums
        for d, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(sums[0]), pa.array(sums[1])],
                                             names=["length", "at", "n", "high", "low"])

    bounded_batches(fit.sparkSession)
    parts = fit.select("x", "weight").mapInArrow(run, "length int, at int, n long, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("length", "at").agg(*exact).collect():
        out.setdefault(r["length"], (int(r["n"]), [0] * r["length"]))[1][r["at"]] = (int(r["high"]) << 20) + int(r["low"])
    return out


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: 64-bit integers where they are wide enough, else Python's."""
    base = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    low = x - base
    if (int(np.abs(low).max(initial=0)) + 1) * n < 1 << 62:
        return low * n - np.array(rest, np.int64)
    return low.astype(object) * n - np.array(rest, object)


def deviations(num: np.ndarray) -> list[int | None]:
    """The sum of squares of each row; None beyond 64 bits."""
    if num.dtype != object and num.size and num.shape[1] * int(np.abs(num).max()) ** 2 >= 1 << 63:
        num = num.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (num * num).sum(axis=1)]


def covariance(rows: DataFrame, column: str, centred: Callable[[int, np.ndarray], np.ndarray], weight: dict[int, int]) -> dict[int, np.ndarray]:
    """By vector length: the weighted covariance of centred(length, matrix), one product per task summed over tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part in batches:
            own = part.column("weight").to_numpy()
            for d, at, x in by_length(part, column):
                y = centred(d, x)
                held[d] = held.get(d, 0.0) + y.T @ (y * own[at][:, None])
        for d, square in held.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(square[i, j])],
                                             names=["length", "i", "j", "v"])

    bounded_batches(rows.sparkSession)
    cells = rows.select(column, "weight").mapInArrow(run, "length int, i int, j int, v double").groupBy("length", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    length, i, j, v = (cells.column(c).to_numpy() for c in ("length", "i", "j", "v"))
    out = {}
    for d in np.unique(length):
        at, square = length == d, np.zeros((d, d))
        square[i[at], j[at]] = square[j[at], i[at]] = v[at]
        out[int(d)] = square / weight[int(d)]
    return out


def principal(square: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues that are not zero, falling, and their unit vectors as columns."""
    value, vector = np.linalg.eigh(square)
    value, vector = value[::-1], vector[:, ::-1]
    n = int((value > max(value[0], 0.0) * len(value) * np.finfo(float).eps).sum()) if value[0] > 0 else 0
    return value[:min(n, components)], vector[:, :min(n, components)]


def whiten(rows: DataFrame, components: int = COMPONENTS, weights: str = "one", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row that is left and component.

    ``rows`` has vec_id and embedding.  ``weights`` is "one" (each distinct x vector once) or "count" (its rows).
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights: {weights!r}")
    spark = rows.sparkSession
    vectors = integer_vectors(rows, scale, offset)
    fit = written(vectors.groupBy("k", "x").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "weight", F.lit(1).cast("long") if weights == "one" else F.col("copies")))
    sums = totals(fit)
    weight = {d: n for d, (n, _) in sums.items()}

    def centred(d: int, x: np.ndarray) -> np.ndarray:
        n, own = sums[d]
        return (numerators(x, n, own) / n).astype(float)

    square = covariance(fit, "x", centred, weight)
    axes, explained = {}, {}
    for d, v in square.items():
        value, vector = principal(v, components)
        axes[d] = vector / np.sqrt(value)
        explained[d] = (value / np.trace(v)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            size, far, white = [0] * part.num_rows, [None] * part.num_rows, [None] * part.num_rows
            for d, at, x in by_length(part, "x"):
                num = numerators(x, *sums[d])
                own = (num / sums[d][0]).astype(float) @ axes[d]
                for i, a, b in zip(at.tolist(), deviations(num), own.tolist(), strict=True):
                    size[i], far[i], white[i] = d, a, b
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), part.column("x"), part.column("copies"), part.column("weight"), pa.array(size, pa.int32()), pa.array(far, pa.int64()), pa.array(white, pa.list_(pa.float64()))],
                names=["k", "x", "copies", "weight", "length", "deviation", "white"])

    bounded_batches(spark)
    done = written(fit.mapInArrow(run, "k long, x array<long>, copies long, weight long, length int, deviation long, white array<double>"))
    means: dict[int, np.ndarray] = {d: np.zeros(a.shape[1]) for d, a in axes.items()}
    for r in done.select("length", "weight", F.posexplode("white")).groupBy("length", "pos").agg(F.sum(F.col("weight") * F.col("col")).alias("s")).collect():
        means[r["length"]][r["pos"]] = r["s"] / weight[r["length"]]
    # whitened rows of different lengths may have equally many components: told apart by the length
    errors = {}
    for d, a in axes.items():
        k = a.shape[1]
        own = covariance(done.filter(F.col("length") == d), "white", lambda _, w, m=means[d]: w - m, {k: weight[d]}) if k else {}
        errors[d] = float(np.abs(own[k] - np.eye(k)).max()) if k else 0.0
    facts = spark.createDataFrame([(d, weight[d], explained[d], errors[d]) for d in axes], "length int, n long, explained array<double>, identity_error double")

    table = done.select("k", "x", "copies", "deviation", "length", "white").join(F.broadcast(facts), "length")
    target = target_rows(spark)
    heavy = done.filter(F.col("copies") > target).select("k", "copies").collect()  # fewer than rows / target
    on = ["k", "x"]
    if heavy:
        salts = F.broadcast(spark.createDataFrame([(r["k"], -(-r["copies"] // target)) for r in heavy], "k long, salts long").groupBy("k").agg(F.max("salts").alias("salts")))
        marked = lambda df: df.join(salts, "k", "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long")))
        vectors = marked(vectors).withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts"))).drop("salts")
        table = marked(table).withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))).drop("salts")
        on.append("salt")
    joined = vectors.join(table, on)
    each = joined.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("white", "explained")).alias("pos", "c"))
    return each.select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.white").alias("whitened"),
                       F.col("c.explained").alias("explained"), "identity_error")
