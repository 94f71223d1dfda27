"""Language-model scores from a probabilistic suffix tree.

Symbols are the bytes of a text's words, joined by one space, and an end symbol, which also stands before
the text.  The ``CLASSES - 2`` most frequent bytes are symbols of their own; the rest share one class and a
distribution of their own inside it.  Training counts every (context of ``DEPTH`` symbols, next symbol);
contexts of lesser depth follow by summing.  A context is a state of the tree if its distribution diverges from that of its parent (the
context without its oldest symbol): count x KL >= ``DIVERGENCE`` nats, however small its share of all positions
(``LEAST`` is 0), so the states grow with the corpus.  The test runs in Spark, by joining each depth to the one before;
only states reach the driver.  A state's distribution is smoothed towards its parent state's with weight ``PRIOR``.  Each symbol of a text is scored in the state
of the longest suffix that is one.

Beside it stands the base model over whole words, c and N over all training texts.  The ``HEAD`` most frequent words
are looked up in the task; occurrences of all other words meet the counts in one shuffled join, so nothing that grows with the corpus is broadcast.

Edge cases: a null text is an empty one: no words, one end; without training texts N and V are 0, base_score is 0 and
every symbol is equally likely; repeated rows are learned from and scored one by one; texts are scored whole; a row is known by its
doc_id and a hash of its text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, held_out, slices, written

CLASSES, DEPTH, LEAST, DIVERGENCE, PRIOR, HEAD = 64, 4, 0.0, 8.0, 4.0, 1 << 16
OTHER, END = CLASSES - 2, CLASSES - 1
_BITS = 6
FLUSH = 1 << 21
SLICE = 1 << 20  # bytes of text turned into arrays at once
PIECE = 1 << 14  # contexts whose distributions are worked out at once


def parts_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def symbols(joined: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all texts' bytes with DEPTH ends before and one after each; positions to score; their owners."""
    pad = np.full(DEPTH, END, np.int32)
    size = np.fromiter(map(len, joined), np.int64, len(joined))
    block = size + DEPTH + 1
    start = np.cumsum(block) - block
    out = np.full(int(block.sum()), END, np.int32)
    inner = np.arange(int(size.sum())) + np.repeat(start + DEPTH - (np.cumsum(size) - size), size)
    out[inner] = classes[np.frombuffer(b"".join(joined), np.uint8)]
    scored = np.ones(len(out), bool)
    for k in range(len(pad)):
        scored[start + k] = False
    at = np.flatnonzero(scored)
    return out, at, np.repeat(np.arange(len(joined)), size + 1)


def contexts(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each position the DEPTH symbols before it, the nearest in the lowest bits."""
    code = np.zeros(len(flat) - DEPTH, np.int32)
    for k in range(DEPTH):
        code = (code << _BITS) | flat[k:len(flat) - DEPTH + k]
    return code[at - DEPTH]


class Tally:
    """Counts of integer keys; ``flush`` hands out and forgets all of them."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > 2 * FLUSH:
            self._merge()

    def _merge(self) -> None:
        key = np.concatenate([p[0] for p in self.parts] or [np.zeros(0, np.int32)])
        n = np.concatenate([p[1] for p in self.parts] or [np.zeros(0, np.int64)])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
        self.parts = [(key[first], np.add.reduceat(n, first) if len(first) else n)]
        self.held = len(first)

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        out = self.parts[0]
        self.__init__()
        return out


@dataclass
class Tree:
    """States by depth: contexts[d] sorted codes of depth d (0 to DEPTH); log_p[state, symbol]; the bytes' own parts."""

    classes: np.ndarray  # 256
    byte_log_p: np.ndarray  # 256: log10 P(byte | its class)
    contexts: list[np.ndarray]
    log_p: np.ndarray  # states x CLASSES, log10, single precision

    def lookup(self) -> np.ndarray:
        """State of the longest known suffix by full context."""
        table = np.zeros(1, np.int32)
        first = 1
        for d in range(1, DEPTH + 1):
            table = np.tile(table, CLASSES)  # a longer context falls back to its suffix
            table[self.contexts[d]] = np.arange(first, first + len(self.contexts[d]), dtype=np.int32)
            first += len(self.contexts[d])
        return table

    def score(self, joined: list[bytes], lookup: np.ndarray) -> np.ndarray:
        flat, at, owner = symbols(joined, self.classes)
        state = lookup[contexts(flat, at)]
        gain = self.log_p.reshape(-1)[state.astype(np.int64) * CLASSES + flat[at]]
        total = np.bincount(owner, weights=gain, minlength=len(joined))
        size = np.fromiter(map(len, joined), np.int64, len(joined))
        own = self.byte_log_p[np.frombuffer(b"".join(joined), np.uint8)]
        return total + np.bincount(np.repeat(np.arange(len(joined)), size), weights=own, minlength=len(joined))


def byte_classes(byte_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-byte_counts, kind="stable")
    classes = np.full(256, OTHER, np.int32)
    classes[order[:OTHER]] = np.arange(OTHER)
    rest = order[OTHER:]
    log_p = np.zeros(256)
    log_p[rest] = np.log10((byte_counts[rest] + 0.5) / (byte_counts[rest].sum() + 0.5 * len(rest)))
    return classes, log_p


def grow(codes: np.ndarray, n: np.ndarray, classes: np.ndarray, byte_log_p: np.ndarray, least: float = LEAST,
         divergence: float = DIVERGENCE, prior: float = PRIOR) -> Tree:
    """The tree of counted (context code, symbol) keys, keyed code * CLASSES + symbol; sorted or not, all of the kept depth first.

    ``codes`` and ``n`` hold, per depth, the contexts that can be states: a list of arrays each.
    """
    base = np.zeros(CLASSES)
    base[codes[0] % CLASSES] = n[0]
    root = (base + 0.5) / (base.sum() + 0.5 * CLASSES)
    kept, rows = [np.zeros(1, np.int64)], [np.log10(root[None]).astype(np.float32)]
    lookup = np.zeros(1, np.int64)  # state of the longest suffix among the depths done
    first = 1
    probability = root[None]
    for d in range(1, DEPTH + 1):
        order = np.argsort(codes[d], kind="stable")
        context, symbol, seen = codes[d][order] // CLASSES, codes[d][order] % CLASSES, n[d][order]
        here, begin = np.unique(context, return_index=True)
        ends = np.r_[begin, len(context)]
        good, new = np.zeros(len(here), bool), []
        for i in range(0, len(here), PIECE):
            some = here[i:i + PIECE]
            own = slice(ends[i], ends[i + len(some)])
            counts = np.zeros((len(some), CLASSES))
            counts[np.searchsorted(some, context[own]), symbol[own]] = seen[own]
            total = counts.sum(axis=1)
            parent = probability[lookup[some % len(lookup)]]
            with np.errstate(divide="ignore", invalid="ignore"):
                p = counts / total[:, None]
                kl = np.where(counts > 0, p * np.log(p / parent), 0.0).sum(axis=1)
            fits = (total >= least * max(base.sum(), 1)) & (total * kl >= divergence)
            good[i:i + len(some)] = fits
            own_p = (counts[fits] + prior * parent[fits]) / (total[fits, None] + prior)
            rows.append(np.log10(own_p).astype(np.float32))
            if d < DEPTH:
                new.append(own_p)
        lookup = np.tile(lookup, CLASSES)
        lookup[here[good]] = np.arange(first, first + int(good.sum()))
        first += int(good.sum())
        kept.append(here[good])
        probability = np.concatenate([probability, *new])
    return Tree(classes, byte_log_p, kept, np.concatenate(rows))


def _training_bytes(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for part in slices(batches):
            flat = np.frombuffer(b"".join(b" ".join(parts_of(t)) for t in part.column("text").to_pylist()), np.uint8)
            total += np.bincount(flat, minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["byte", "n"])

    got = docs.select("text").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()  # at most 256 rows
    out = np.zeros(256)
    for r in got:
        out[r["byte"]] = r["n"]
    return out


def learn(docs: DataFrame) -> Tree:
    """The tree of all given texts."""
    bounded_batches(docs.sparkSession)
    classes, byte_log_p = byte_classes(_training_bytes(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for part in slices(batches, limit=SLICE):
            flat, at, _ = symbols([b" ".join(parts_of(t)) for t in part.column("text").to_pylist()], classes)
            if len(at):
                tally.add((contexts(flat, at) << _BITS) | flat[at])
            if tally.held > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in tally.flush()], names=["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in tally.flush()], names=["key", "n"])

    full = written(docs.select("text").mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")))
    codes, counts = [], []
    above = None  # key and probability of every pair one depth up, in the longest suffix that is a state
    for d in range(DEPTH + 1):
        span = 1 << (_BITS * (d + 1))  # the lowest symbols: the next one and the d before it
        by = full.groupBy((F.col("key") % span).alias("key")).agg(F.sum("n").alias("n"))
        if above is None:
            got = by.toArrow()  # at most CLASSES rows
            total = sum(got["n"].to_pylist())
            above = by.select("key", ((F.col("n") + 0.5) / (total + 0.5 * CLASSES)).alias("p"))
        else:
            met = by.join(above.withColumnRenamed("key", "up"), F.col("key") % (span >> _BITS) == F.col("up")).withColumn(
                "context", F.shiftright("key", _BITS))
            # n log(n / p) - all log(all), summed over the symbols of a context, is count x KL
            size = met.groupBy("context").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log(F.col("n") / F.col("p"))).alias("gain"))
            state = size.select(F.col("context").alias("of"), "all", (F.col("gain") - F.col("all") * F.log("all") >= DIVERGENCE - 1e-3).alias("state"))
            judged = written(met.join(state, F.col("context") == F.col("of")).select(
                "key", "n", "state", F.when(F.col("state"), (F.col("n") + PRIOR * F.col("p")) / (F.col("all") + PRIOR)).otherwise(F.col("p")).alias("p")))
            got = judged.filter("state").select("key", "n").toArrow()  # the states of a depth, at most CLASSES rows each
            above = judged.select("key", "p")
        codes.append(got["key"].to_numpy())
        counts.append(got["n"].to_numpy())
    return grow(codes, counts, classes, byte_log_p)


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, n) of every distinct word, as a written table; counted in the task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
            seen.clear()

        for part in slices(batches):
            for t in part.column("text").to_pylist():
                seen.update(parts_of(t))
            if len(seen) > FLUSH // 4:
                yield from out()
        yield from out()

    return written(docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")))


def score(docs: DataFrame, tree: Tree, counts: DataFrame, n_ends: int) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    distinct, words = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_all, n_distinct = words + n_ends, distinct + (n_ends > 0)
    below = n_all + 0.1 * (n_distinct + 1)
    head = {bytes(r["token"]): r["n"] for r in counts.orderBy(F.desc("n"), "token").limit(HEAD).collect()}
    shared = spark.sparkContext.broadcast((tree.classes, tree.byte_log_p, tree.contexts, tree.log_p, head))
    end = float(np.log10((n_ends + 0.1) / below)) if n_all else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, frequent = shared.value
        model = Tree(*parts)
        lookup = model.lookup()
        gain = {w: float(np.log10((n + 0.1) / below)) for w, n in frequent.items()}
        for part in slices(batches, limit=SLICE):
            ids, hashes = part.column("doc_id").to_pylist(), part.column("h").to_pylist()
            split = [parts_of(t) for t in part.column("text").to_pylist()]
            lm = model.score([b" ".join(w) for w in split], lookup).tolist()
            base, known, rare_at, rare, rare_n = [], [], [], [], []
            for i, w in enumerate(split):
                got = list(map(gain.get, w))
                missing = got.count(None)
                if missing:
                    tail = Counter([x for x, g in zip(w, got, strict=True) if g is None])
                    rare_at += [i] * len(tail)
                    rare += tail.keys()
                    rare_n += tail.values()
                    got = [g for g in got if g is not None]
                base.append(sum(got) + end)
                known.append(len(got) + (n_ends > 0))
            own = [b"\xff%d %d" % (h, k) for k, h in enumerate(hashes)]  # no word: the row itself, dealt evenly
            zero = [0] * len(rare)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids + [ids[i] for i in rare_at], pa.int64()), pa.array(hashes + [hashes[i] for i in rare_at], pa.int64()),
                pa.array(own + rare, pa.binary()), pa.array([0] * len(own) + rare_n, pa.int32()), pa.array([1] * len(own) + zero, pa.int32()),
                pa.array([len(w) + 1 for w in split] + zero, pa.int64()), pa.array(known + zero, pa.int64()),
                pa.array(base + zero, pa.float64()), pa.array(lm + zero, pa.float64())],
                names=["doc_id", "h", "token", "tf", "own", "n_tokens", "known", "base", "lm"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(
        run, "doc_id long, h long, token binary, tf int, own int, n_tokens long, known long, base double, lm double")
    met = rows.join(counts.withColumnRenamed("token", "word"), F.col("token") == F.col("word"), "left")
    seen = F.coalesce("n", F.lit(0))
    rare_gain = F.when(F.col("own") == 0, F.col("tf") * F.log10((seen + 0.1) / F.lit(float(below) if n_all else 1.0))).otherwise(0.0)
    sums = met.groupBy("doc_id", "h").agg(
        F.sum("own").alias("rows"), F.max("n_tokens").alias("n_tokens"), F.max("known").alias("known"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf"))).alias("rare"),
        F.max(F.when(F.col("own") == 1, F.col("base"))).alias("base"), F.sum(rare_gain).alias("rare_gain"), F.max(F.when(F.col("own") == 1, F.col("lm"))).alias("lm"))
    per_row = sums.select(
        "doc_id", "rows", "n_tokens", (F.col("known") + F.coalesce(F.col("rare") / F.col("rows"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_gain") / F.col("rows") if n_all else F.lit(0.0)).alias("base_score"), F.col("lm").alias("score"))
    again = per_row.withColumn("copy", F.explode(F.expr("sequence(1, rows)")))  # repeated rows, one by one
    return again.drop("rows", "copy")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    out = held_out("doc_id", 10, 0)
    training = docs.filter(~out).select("doc_id", "text")
    scored = score(docs.select("doc_id", "text"), learn(training), word_counts(training), training.count())
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
