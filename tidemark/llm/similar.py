"""Near-duplicates by SimHash pivots and the Jaccard similarity of word shingles.

Texts with equal shingle sets are one class.  Each class has the SimHash fingerprint of its set, and the operator of
``simhash`` (bit-block buckets, pivot distance tables, survivors verified bit by bit) links fingerprints within its radius:
classes whose fingerprints hang together meet.  Sets of similarity 0.8 differ in about 10 of 64 bits, beyond any radius
that buckets can serve, so minima of ``BANDS`` x ``ROWS`` hash functions are dealt in bands as well: two classes also meet
if a band is equal, which at similarity 0.8 fails for 1 pair in 10,000.  Whoever meets is compared by the exact similarity
of the two sets; only pairs of at least ``LEAST`` are linked, and groups are the components of links.

Pairs never leave a task.  A bucket's classes go to work items with their sets, each set once per item; an item holds
at most ``ITEM`` bytes of sets, and a bucket of more is dealt by hash to parts and has an item per pair of parts.  The task
compares what it holds and returns the edges of a spanning forest.  Two rounds keep the traffic low: the first compares, in
the fingerprints' groups and ``FIRST`` bands, each part with itself and with the bucket's smallest class.  The second looks only at buckets that still
hold more than one group: a pass over the minima alone (the share of equal minima must reach ``HINT``, five standard deviations
below 0.8) marks the classes that can have a partner in another group, and only their sets travel.

Edge cases: a null or empty text, or one without a word, has the empty set and is one class; texts of up to five words
are one shingle; repeated rows are copies, and of rows that repeat the kept doc_id one stays; a null doc_id counts as an id
above all others; ties of minima are equal minima; a very long text is one row and its set one array; an empty table
gives no rows; columns of any other name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, slices, written
from tidemark.llm.simhash import SEED, group_numbers, links, majority, shingle_hashes, whole_groups
from tidemark.plans.components import components
from tidemark.plans.cut import passing

WORDS, LEAST, BANDS, ROWS, HINT, FIRST, ITEM = 5, 0.8, 24, 5, 0.6, 3, 16 << 20
#: Bit blocks of the fingerprints: 15 buckets each, of two blocks or 21 bits, where op1 has 35 of three.
BLOCKS = 6
_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64, endpoint=False) | np.uint64(1)
_PLUS = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64, endpoint=False)


# ---------------------------------------------------------------- sets and sketches

def minima(hashes: np.ndarray, piece: int = 1 << 12) -> np.ndarray:
    """The least value of each hash function over a set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), piece):
        low = np.minimum(low, (hashes[None, i:i + piece] * _TIMES + _PLUS).min(axis=1))
    return low


def _same(own: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def sketches(rows: DataFrame) -> DataFrame:
    """(id, same, fp, held, bands, mins): hash of the text's shingle set, its SimHash, its size, band keys, 16 bits of each minimum."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            same, fp, n, bands, mins = [], [], [], [], []
            for t in part.column("text").to_pylist():
                own = np.unique(shingle_hashes(t, WORDS))
                low = minima(own)
                same.append(_same(own))
                fp.append(majority(own))
                n.append(len(own))
                bands.append([xxhash.xxh64_intdigest(low[k * ROWS:(k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)] if len(own) else [])
                mins.append((low & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(same, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(mins, pa.binary())],
                names=["id", "same", "fp", "held", "bands", "mins"])

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, "id long, same long, fp long, held int, bands array<long>, mins binary")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(same, shingles): the sorted set of each text as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [np.unique(shingle_hashes(t, WORDS)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_same(o) for o in own], pa.int64()), pa.array([o.tobytes() for o in own], pa.binary())], names=["same", "shingles"])

    bounded_batches(texts.sparkSession)
    return texts.mapInArrow(run, "same long, shingles binary")


# ---------------------------------------------------------------- work items

def dealt(rows: DataFrame, item: int, whole: bool) -> DataFrame:
    """Rows (bucket, same, held, ...) of buckets of two or more, with the ``item`` of the bucket they take part in.

    A bucket of more than ``item`` bytes of sets is dealt by hash to c parts.  ``whole``: an item per pair of parts, so
    that all pairs meet and each row is in c items.  Otherwise each part is an item, and the bucket's smallest class is in all.
    """
    size = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("bytes"), F.min("same").alias("lead")).filter("n > 1")
    parts = F.expr(f"cast(greatest(1, ceil(8 * bytes / {item if not whole else item // 2})) as int)")
    cut = rows.join(size.select("bucket", "lead", parts.alias("parts")), "bucket").withColumn("part", F.expr("cast(pmod(xxhash64(same), parts) as int)"))
    if whole:
        items = F.expr("if(parts = 1, array(0), transform(sequence(0, parts - 1), o -> least(o, part) * parts + greatest(o, part)))")
    else:
        items = F.expr("if(same = lead, sequence(0, parts - 1), array(part))")
    return cut.withColumn("item", F.explode(items)).drop("parts", "part", "lead")


def linked(sets: list[np.ndarray], group: np.ndarray, least: float = LEAST) -> Iterator[tuple[int, int]]:
    """Pairs of an item that span its links of similarity ``least`` or more; pairs of one ``group`` are not compared."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    end = np.cumsum(n)
    _, value = np.unique(np.concatenate(sets), return_inverse=True)  # shingles as small numbers
    label = np.unique(group, return_inverse=True)[1]
    seen = np.zeros(int(value.max(initial=-1)) + 1, bool)
    order = np.argsort(n, kind="stable")  # partners have similar sizes
    for at, i in enumerate(order):
        later = order[at + 1:]
        later = later[:np.searchsorted(n[later], n[i] / least, side="right")]
        later = later[label[later] != label[i]]
        if not len(later):
            continue
        own = value[end[i] - n[i]:end[i]]
        seen[own] = True
        for k in range(0, len(later), 256):
            some = later[k:k + 256]
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            hits = seen[np.concatenate([value[end[j] - n[j]:end[j]] for j in some])]
            both = np.add.reduceat(hits, np.cumsum(n[some]) - n[some], dtype=np.int64)
            for j in some[both >= least * (n[i] + n[some] - both)]:
                if label[i] != label[j]:
                    yield int(i), int(j)
                    label[label == label[j]] = label[i]
        seen[own] = False


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): a spanning forest of each item's links."""
    for rows in whole_groups(batches, ["bucket", "item"], rows=1):
        same, group = rows.column("same").to_numpy(), rows.column("component").to_numpy()
        item = group_numbers(rows, ["bucket", "item"])
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        a, b = [], []
        begin = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        for first, last in zip(begin.tolist(), [*begin[1:].tolist(), len(item)], strict=True):
            if last - first > 1:
                for i, j in linked(sets[first:last], group[first:last]):
                    a.append(same[first + i])
                    b.append(same[first + j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def forests(items: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) spanning the links inside each work item of (bucket, item, same, component)."""
    bounded_batches(items.sparkSession)
    full = items.select("bucket", "item", "same", "component").join(sets, "same").repartition("bucket", "item").sortWithinPartitions("bucket", "item", "same")
    return full.mapInArrow(_forests, "a long, b long")


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each item that may have a partner in another group, by size and minima."""
    for rows in whole_groups(batches, ["bucket", "item"]):
        n, group = rows.column("held").to_numpy(), rows.column("component").to_numpy()
        mins = np.frombuffer(b"".join(rows.column("mins").to_pylist()), np.uint16).reshape(len(n), -1)
        item = group_numbers(rows, ["bucket", "item"])
        left = np.cumsum(np.bincount(item))[item] - np.arange(len(item)) - 1
        live, lag, some = np.flatnonzero(left > 0), 1, np.zeros(len(n), bool)
        while len(live):
            i, j = live, live + lag
            near = (group[i] != group[j]) & (np.minimum(n[i], n[j]) >= LEAST * np.maximum(n[i], n[j])) & ~(some[i] & some[j])
            i, j = i[near], j[near]
            near = (mins[i] == mins[j]).mean(axis=1) >= HINT
            some[i[near]] = some[j[near]] = True
            lag += 1
            live = live[left[live] >= lag]
        yield pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().filter(pa.array(some)) for c in ("bucket", "item", "same", "component")], names=["bucket", "item", "same", "component"])


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with ``component``: the smallest class that theirs is linked with."""
    group = components(edges).withColumnRenamed("node", "same")
    return rows.join(group, "same", "left").withColumn("component", F.coalesce("component", "same"))


# ---------------------------------------------------------------- groups

def alike(classes: DataFrame) -> DataFrame:
    """(same, least, held, band, bucket): a bucket, as band -1, for the classes whose fingerprints are linked, at once or through others."""
    some = classes.filter("held > 0").select("same", "least", "held", "fp")
    group = components(links(some, blocks=BLOCKS)).withColumnRenamed("node", "fp")
    bucket = F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp"))
    return some.join(group, "fp", "left").select("same", "least", "held", F.lit(-1).alias("band"), bucket.alias("bucket"))


def keep_first(docs: DataFrame, item: int = ITEM) -> DataFrame:
    """The documents of which each group of near-duplicates keeps the one with the smallest doc_id.

    Of rows that repeat that doc_id one stays.  A row without an id counts as one with an id above all
    others, taken from its text, so it stays only where its group has no id.
    """
    beyond = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), beyond).alias("id"), F.col("text").alias("own"), F.struct(*docs.columns).alias("row"))
    texts = named.select("id", F.col("own").alias("text"))
    with passing(docs.sparkSession) as lasting:
        classes = written(sketches(texts).groupBy("same").agg(*[F.first(x).alias(x) for x in ("fp", "held", "bands", "mins")], F.min("id").alias("least")))
        spread = alike(classes).union(classes.select("same", "least", "held", F.posexplode("bands").alias("band", "bucket")))
        busy = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
        met = written(spread.join(busy, "bucket"))
        ids = met.select(F.col("least").alias("id")).distinct()  # one document of each class, not all its copies
        known = met.select("same").distinct()
        sets = written(shingle_sets(texts.join(ids, "id", "left_semi")).join(known, "same", "left_semi").dropDuplicates(["same"]))

        alone = met.filter(F.col("band") < FIRST).withColumn("component", F.col("same"))
        first = written(forests(dealt(alone, item, whole=False), sets))
        rest = written(_labelled(met, first).select("bucket", "same", "held", "component"))
        mixed = rest.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
        open_ = dealt(rest.join(mixed, "bucket"), item, whole=True).join(classes.select("same", "mins"), "same")
        sorted_ = open_.repartition("bucket", "item").sortWithinPartitions("bucket", "item", "same").select("bucket", "item", "same", "held", "component", "mins")
        bounded_batches(docs.sparkSession)
        some = written(sorted_.mapInArrow(_promising, "bucket long, item int, same long, component long"))
        edges = first.union(written(forests(some, sets)))
        grouped = _labelled(classes.select("same", "least"), edges)
        keep = lasting(grouped.groupBy("component").agg(F.min("least").alias("id")).select("id").distinct())
    return named.select("id", "row").join(keep, "id", "left_semi").dropDuplicates(["id"]).select("row.*")
