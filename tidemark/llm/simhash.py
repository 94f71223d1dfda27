"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint is the bitwise majority of the XXH64 (seed 42) of its word shingles.  Two
fingerprints within ``radius`` bits agree on ``keep`` of ``blocks`` bit blocks (blocks - radius = keep),
so each distinct fingerprint goes once into a bucket per choice of ``keep`` blocks; this decides only
which rows meet.  In a bucket the Hamming distances of every row to a fixed list of reference
fingerprints (pivots) are tabled.  By the triangle inequality a pair whose distances to any pivot
differ by more than the radius cannot link; such pairs are discarded coordinate by coordinate and the
survivors are verified bit by bit.  Each task returns a spanning forest of what it verified instead of
its pairs, so a group of copies costs rows in proportion to its size.

Exact copies meet as one row per fingerprint.  A bucket above ``chunk`` rows is dealt by hash to parts;
every pair of parts is a work item of its own, so no task holds a whole bucket.

Edge cases: null and empty texts and texts of spaces have fingerprint zero and link like any other;
repeated rows come back as often as they were given; null doc_ids never become a component's name
while the group has another id; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, slices, written
from tidemark.plans.blocks import target_rows
from tidemark.plans.components import components

SHINGLE, RADIUS, BLOCKS, PIVOTS, CHUNK = 4, 4, 7, 16, 2048
SEED = 42


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at \x20 \x09-\x0D
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(parts) - words + 1)
    last = end[min(words, len(parts)) - 1:][:n]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray, piece: int = 1 << 16) -> int:
    """The bits set in over half of the hashes, as an unsigned integer."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), piece):
        part = hashes[i:i + piece].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = [majority(shingle_hashes(t, words)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- links

def block_masks(blocks: int, keep: int) -> list[int]:
    """Signed 64-bit masks: each keeps ``keep`` of ``blocks`` near-equal bit ranges."""
    edge = [round(i * 64 / blocks) for i in range(blocks + 1)]
    own = [((1 << edge[i + 1]) - (1 << edge[i])) for i in range(blocks)]
    masks = [sum(own[i] for i in c) for c in combinations(range(blocks), keep)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def pivot_points(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


def near_pairs(fp: np.ndarray, group: np.ndarray, pivots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of rows of one group that differ in at most ``radius`` bits; groups lie together."""
    tabled = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)  # the pivot distance table
    size = np.bincount(group)
    left = np.cumsum(size)[group] - np.arange(len(fp)) - 1  # later rows of the same group
    found: list[tuple[np.ndarray, np.ndarray]] = []
    live, lag = np.flatnonzero(left > 0), 1
    while len(live):
        i, j = live, live + lag
        for k in range(tabled.shape[1]):
            near = np.abs(tabled[i, k] - tabled[j, k]) <= radius
            if not near.all():
                i, j = i[near], j[near]
        same = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        if same.any():
            found.append((i[same], j[same]))
        lag += 1
        live = live[left[live] >= lag]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row it is linked with through the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of batches that are sorted by the columns ``by``, cut between groups at about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table.column(n).to_numpy() for n in by]
            begin = int(np.argmax(np.logical_and.reduce([k == k[-1] for k in keys])))  # of the last group, which may go on
            if begin:
                yield table.slice(0, begin)
                table = table.slice(begin)
            held, count = table.to_batches(), table.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_numbers(table: pa.Table, by: list[str]) -> np.ndarray:
    """0, 1, 2 ... by the group of each row of a sorted table."""
    keys = [table.column(n).to_numpy() for n in by]
    return np.cumsum(np.logical_or.reduce([np.r_[True, k[1:] != k[:-1]] for k in keys])) - 1


def chunked(rows: DataFrame, bucket: str, member: str, chunk: int) -> DataFrame:
    """Rows of buckets of two or more, once per work item (``bucket``, ``item``) they take part in.

    A bucket of up to ``chunk`` rows is one item.  The rows of a larger one are dealt by a hash of ``member`` to c parts
    of about ``chunk`` rows and there is an item per pair of parts, so each row is in c items; ``part`` is the row's
    part, and ``across`` says that the item is of two parts, whose rows are only to be compared with the other's.

    Sizes come from a count that starts in the tasks and go back to the rows in a join that is salted for buckets of
    more rows than one task should get; no task ever holds or sorts a bucket.
    """
    target = target_rows(rows.sparkSession)
    sizes = written(rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")).withColumn("salts", F.ceil(F.col("n") / target))
    hot = sizes.filter("salts > 1").select(bucket, F.col("salts").alias("of"))  # fewer than rows / target
    salted = rows.join(F.broadcast(hot), bucket, "left").withColumn(
        "salt", F.pmod(F.xxhash64(member, F.lit(1)), F.coalesce("of", F.lit(1))))
    spread = sizes.select(bucket, "n", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"))
    cut = salted.join(spread, [bucket, "salt"]).withColumn("per", F.expr(f"cast(ceil(n / {chunk}) as int)")).withColumn(
        "part", F.pmod(F.xxhash64(member, F.lit(2)), F.col("per")).cast("int"))
    items = F.transform(F.sequence(F.lit(0), F.col("per") - 1), lambda o: F.struct(
        (F.least(o, F.col("part")) * F.col("per") + F.greatest(o, F.col("part"))).alias("item"), (o != F.col("part")).alias("across")))
    return cut.select(*rows.columns, "part", F.inline(items))


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span all links of at most ``radius`` bits."""
    masks = block_masks(blocks, blocks - radius)
    points = pivot_points(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["bucket", "item"]):
            fp = rows.column("fp").to_numpy()
            a, b = near_pairs(fp.view(np.uint64), group_numbers(rows, ["bucket", "item"]), points, radius)
            value, row = np.unique(fp, return_inverse=True)
            root = forest(len(value), row[a], row[b])
            low = np.flatnonzero(root != np.arange(len(value)))
            yield pa.RecordBatch.from_arrays([pa.array(value[low]), pa.array(value[root[low]])], names=["a", "b"])

    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])
    rows = fps.select("fp").distinct().select("fp", F.explode(keys).alias("bucket"))
    dealt = chunked(rows, "bucket", "fp", chunk).repartition("bucket", "item").sortWithinPartitions("bucket", "item", "fp")
    return dealt.select("bucket", "item", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, **how: int) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id reachable over links of at most ``radius`` bits."""
    rows = written(fingerprints(docs, words))
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    group = components(links(rows, radius, **how))
    named = first.join(group.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = written(named.join(least, "component").select("fp", "component_id"))
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def keep_first(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, **how: int) -> DataFrame:
    """The documents of which each group of near-duplicates keeps the one with the smallest doc_id.

    Of rows that repeat that doc_id one stays.  A row without an id counts as one with an id above all
    others, taken from its text, so it stays only where its group has no id.
    """
    beyond = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), beyond).alias("id"), F.col("text").alias("own"), F.struct(*docs.columns).alias("row"))
    marked = near_duplicates(named.select(F.col("id").alias("doc_id"), F.col("own").alias("text")), words, radius, **how)
    keep = marked.filter("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    return named.select("id", "row").join(keep, "id", "left_semi").dropDuplicates(["id"]).select("row.*")
