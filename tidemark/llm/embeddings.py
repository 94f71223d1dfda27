"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length one, where cosine c is distance sqrt(2 - 2c).  Each of ``TABLES`` tables hashes a
vector to the ``PROJECTIONS`` cells floor((a.x + b) / WIDTH), with normal a (2-stable) and uniform b; vectors
that share all cells of a table meet in a bucket.  Every pair that meets is checked by its exact cosine, in double precision.
A pair of cosine 0.9 shares a cell with probability 0.82, so it meets in some table with probability
0.94; at 0.95 that is 0.998.

Equal vectors are one class.  A pair of classes is counted in the first table where it meets, so no
pair is counted twice and none is emitted: tasks return, per class, the number of vectors it was
found linked with and the edges of a spanning forest.  A bucket above ``CHUNK`` classes is cut
into chunks and each pair of chunks is a work item of its own.

Edge cases: null, empty and zero vectors and vectors with null, infinite or NaN components link with
nothing and are their own component; vectors of different length are never linked; repeated rows are linked
copies; a null vec_id never names a component that has another id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, written
from tidemark.plans.components import components
from tidemark.llm.simhash import chunked, forest, group_numbers, whole_groups

COSINE, TABLES, PROJECTIONS, WIDTH, CHUNK, SEED = 0.9, 28, 12, 2.0, 1024, 42
_SMALL = 24


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of length one, in double precision, padded with zeros to one width."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=1))))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def hash_cells(units: np.ndarray, size: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """rows x tables: each table's cells (and the vector's length) mixed into a 32-bit bucket number."""
    out = np.zeros((len(units), tables), np.int32)
    for d in np.unique(size):
        rng = np.random.default_rng([SEED, int(d)])
        a = rng.standard_normal((int(d), tables * projections))
        b = rng.uniform(0, width, tables * projections)
        mix = rng.integers(1, 1 << 63, projections, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        rows = np.flatnonzero(size == d)
        cells = np.floor((units[rows, :d] @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(rows), tables, projections)
        out[rows] = ((cells * mix).sum(axis=2, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def linked_pairs(units: np.ndarray, group: np.ndarray, part: np.ndarray, across: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of a group with cosine >= least; in a group of two parts (``across``) only pairs across them."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.append(first, len(group)))
    mixed = across[first]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in np.flatnonzero(size > _SMALL):
        lo, hi = first[k], first[k] + size[k]
        if mixed[k]:
            one = part[lo:hi] == part[lo]
            a, b = lo + np.flatnonzero(one), lo + np.flatnonzero(~one)  # a part can be empty
            i, j = np.nonzero(units[a] @ units[b].T >= least)
            found.append((np.minimum(a[i], b[j]), np.maximum(a[i], b[j])))
        else:
            i, j = np.nonzero(np.triu(units[lo:hi] @ units[lo:hi].T >= least, 1))
            found.append((lo + i, lo + j))
    after = (np.cumsum(size)[group] - np.arange(len(group)) - 1) * (size[group] <= _SMALL)
    live, lag = np.flatnonzero(after > 0), 1
    while len(live):
        cos = np.einsum("ij,ij->i", units[live], units[live + lag])
        good = live[(cos >= least) & (~mixed[group[live]] | (part[live] != part[live + lag]))]
        found.append((good, good + lag))
        lag += 1
        live = live[after[live] >= lag]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, projections: int = PROJECTIONS,
                    width: float = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; ``vectors`` has vec_id and embedding."""
    bounded_batches(vectors.sparkSession)
    kind = dict(vectors.dtypes)["embedding"]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    any_ = F.exists("embedding", lambda x: x != 0)
    sound = F.coalesce(~bad & any_, F.lit(False))
    classes = written(rows.filter(sound).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size")).withColumn(
        "class", F.monotonically_increasing_id()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("embedding")
                cells = hash_cells(unit_rows(lists), np.asarray(lists.value_lengths()).astype(np.int64), tables, projections, width)
                offsets = np.arange(0, cells.size + 1, tables, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("class", "embedding", "size")], pa.ListArray.from_arrays(offsets, cells.reshape(-1))],
                                                 names=["class", "embedding", "size", "cells"])

    known = written(classes.select("class", "embedding", "size").mapInArrow(hashed, f"class long, embedding {kind}, size long, cells array<int>"))
    met = known.select("class", F.posexplode("cells").alias("table", "cell")).withColumn(
        "bucket", F.col("table").cast("long") * (1 << 32) + F.col("cell"))
    items = chunked(met.select("class", "table", "bucket"), "bucket", "class", chunk)
    work = items.join(known, "class").repartition("bucket", "item").sortWithinPartitions("bucket", "item", "class")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["bucket", "item"], 1 << 14):
            i, j = linked_pairs(unit_rows(part.column("embedding")), group_numbers(part, ["bucket", "item"]), part.column("part").to_numpy(),
                                part.column("across").to_numpy(zero_copy_only=False), cosine)
            cells = part.column("cells").combine_chunks().flatten().to_numpy().reshape(-1, tables)
            earlier = np.arange(tables)[None, :] < part.column("table").to_numpy()[i][:, None]
            new = ~((cells[i] == cells[j]) & earlier).any(axis=1)
            i, j = i[new], j[new]
            klass, size = part.column("class").to_numpy(), part.column("size").to_numpy()
            value, row = np.unique(klass, return_inverse=True)
            n = np.bincount(row[i], weights=size[j], minlength=len(value)) + np.bincount(row[j], weights=size[i], minlength=len(value))
            root = forest(len(value), row[i], row[j])
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(value[at]), pa.array(n[at].astype(np.int64)), pa.array(value[root[at]])], names=["class", "links", "root"])

    links = written(work.select("class", "table", "bucket", "item", "part", "across", "embedding", "size", "cells").mapInArrow(check, "class long, links long, root long"))
    count = links.groupBy("class").agg(F.sum("links").alias("links"))
    group = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.select("class", "least", "size", "embedding").join(count, "class", "left").join(group.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = written(named.join(least, "component").select(
        F.col("embedding").alias("vector"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    told = rows.filter(sound).join(of_class, F.col("embedding") == F.col("vector")).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
