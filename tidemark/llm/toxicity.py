"""Toxicity scores of texts restored through a noisy channel.

Channel: a writer hides words by leetspeak (1d10t), by spacing (m o r o n, m.o.r.o.n) and by repeating
letters (stuuupid).  Every stretch of text that can have more than one reading becomes a lattice of
characters with the cost of each change; a Viterbi search under a trigram model of letters and word
boundaries picks the reading.  All other text has one reading, itself.

Score: hashed n-grams of letters of the restored text, of which the first may be the gap before a word.  A
cell's weight is the smoothed log ratio of the shares, toxic against clean, of documents that hold it at least once,
twice or ``BINS`` times, whichever is largest.  A text's evidence is the sum of its ``TOP`` strongest distinct cells,
which does not dilute with length.  A logistic curve turns it into a probability; it is fitted on the evidence each
labelled text gets with its own share taken out of the weights.

The letter trigrams are counted over all rows that are not held out; weights and curve are fitted on at most ``SAMPLE``
labelled rows, those with the smallest hash of their id.  Labels of repeated ids are
joined by OR; null labels are not used.  Edge cases: null, empty and letterless texts have no evidence and get the curve's
lowest value; without both classes among the labels every score is 0; texts are scored whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, code_points, fresh, held_out, letters, slices, written

SAMPLE, CELLS, ORDERS, BINS, SMOOTH, TOP, LEAST, BLANKS = 40_000, 1 << 19, (4, 5, 6), 3, 2.0, 3, 1.0, 10
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t"}
# Costs in nats: reading a sign as a letter, keeping it as it is, dropping a space, dropping a repeat.
AS_LETTER, AS_IS, JOIN, REPEAT = 0.7, 5.0, 0.7, 0.2
SETTLE, LONG = 1024, 2000  # places between looks for the shared part of the paths; characters up to which a reading is remembered
SYMBOLS = 28  # boundary, a-z, any other letter
_SIGNS = re.compile(r"[0-9@$!|+]+")
_SPACED = re.compile(r"(?<![^\W_])(?<![@$!|+'\u2019])(?:[^\W_]|[@$!|+])(?:(?:\s+|[._*\-])(?:[^\W_]|[@$!|+])){2,}(?![^\W_])")
_UNIT = re.compile(r"(\s+|[._*\-])|(.)", re.S)
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_TOKEN, _LETTERS = re.compile(r"\S*"), re.compile(r"[^\W\d_]*")
SIGN_LETTERS, STOPS = "@$!|+", "!.,;:?"


@lru_cache(1 << 16)
def symbol(ch: str) -> int:
    """0 for anything but letters, 1-26 for a-z with or without marks, 27 for other letters."""
    if "a" <= ch <= "z":
        return ord(ch) - 96
    if not ch.isalpha():
        return 0
    base = unicodedata.normalize("NFKD", ch)[:1].lower()
    return ord(base) - 96 if "a" <= base <= "z" else 27


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of a symbol after two others, interpolated with the shorter contexts."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    uni = (tri.sum((0, 1)) + 1) / (tri.sum() + SYMBOLS)
    bi = tri.sum(0)
    bi = (bi + 20 * uni) / (bi.sum(-1, keepdims=True) + 20)
    return -np.log((tri + 20 * bi[None]) / (tri.sum(-1, keepdims=True) + 20))


def decode(lattice: list[list[tuple[str, float]]], cost: list[list[list[float]]]) -> str:
    """The cheapest reading: one choice (a string, possibly empty, and its cost) per place; Viterbi over symbol pairs.

    A path is a chain of (path before, string).  Now and then the part all paths share is written out and let go,
    so time grows with the length, and memory with the part still open.
    """
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    done: list[str] = []
    held, due = 0, SETTLE
    for choices in lattice:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (so_far, path) in best.items():
            for out, extra in choices:
                x, y, total = a, b, so_far + extra
                for ch in out:
                    z = symbol(ch)
                    if z or y:  # boundaries in a row are one
                        total += cost[x][y][z]
                        x, y = y, z
                kept = new.get((x, y))
                if kept is None or total < kept[0]:
                    new[(x, y)] = (total, (path, out))
        best = new
        held += 1
        if held >= due:
            best, held = _settle(best, done)
            due = max(SETTLE, 2 * held)
    ends = {state: total + (cost[state[0]][state[1]][0] if state[1] else 0.0) for state, (total, _) in best.items()}
    least = min(ends.values())
    return "".join(done) + min("".join(out for _, out in _chain(path)) for state, (_, path) in best.items() if ends[state] == least)


def _chain(path: tuple | None) -> list[tuple]:
    """The links of a path, first to last."""
    links = []
    while path is not None:
        links.append(path)
        path = path[0]
    return links[::-1]


def _settle(best: dict, done: list[str]) -> tuple[dict, int]:
    """Move the links all paths share to ``done``; the paths without them, and how many links are left."""
    chains = {state: _chain(path) for state, (_, path) in best.items()}
    shared = 0
    for links in zip(*chains.values()):
        if any(link is not links[0] for link in links):
            break
        shared += 1
    done += [out for _, out in next(iter(chains.values()))[:shared]]
    left, again = {}, {}
    for state, links in chains.items():
        path = None
        for link in links[shared:]:
            path = again.setdefault(id(link), (path, link[1]))  # links shared by some paths stay shared
        left[state] = (best[state][0], path)
    return left, len(links) - shared


def _choices(ch: str) -> list[tuple[str, float]]:
    return [(x, AS_LETTER) for x in LEET[ch]] + [(ch, AS_IS)] if ch in LEET else [(ch, 0.0)]


def _core(token: str) -> str:
    """A token with a letter, without the signs before it that are not read as letters, stops at its end and a sign repeated there."""
    begin, end = 0, len(token)
    while begin < end and not token[begin].isalnum():
        begin += 1
    while begin and token[begin - 1] in SIGN_LETTERS:
        begin -= 1
    last = token[-1]
    again = len(token.rstrip(last)) if not last.isalnum() else end
    stops = len(token.rstrip(STOPS))
    if end - again > 1:
        end = again
    if stops and token[stops - 1].isalnum():
        end = min(end, stops)
    return token[begin:end]


def _token(token: str, cost: list) -> str:
    """Read one token: leet signs as letters, runs of three or more as one or two."""
    if not any(c.isalpha() for c in token):
        return token
    core = _core(token)
    lattice: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(core):
        j = i
        while j < len(core) and core[j] == core[i]:
            j += 1
        one = _choices(core[i])
        if j - i >= 3:
            lattice.append([(x, c + REPEAT) for x, c in one] + [(x + x, 2 * c + REPEAT) for x, c in one])
        else:
            lattice += [one] * (j - i)
        i = j
    return decode(lattice, cost)


def _run(run: str, cost: list) -> str:
    """Read single characters with separators between them: each separator is a space or nothing."""
    return decode([[("", JOIN), (" ", 0.0)] if m[1] else _choices(m[2]) for m in _UNIT.finditer(run)], cost)


class Restorer:
    """Restores texts; readings of tokens are remembered, up to a bound, as tokens recur."""

    def __init__(self, costs: np.ndarray, remember: int = 200_000):
        self.cost, self.seen, self.remember = costs.tolist(), {}, remember

    def _read(self, how, text: str) -> str:
        if len(text) > LONG:  # hardly recurs
            return how(text, self.cost)
        got = self.seen.get((how, text))
        if got is None:
            if len(self.seen) >= self.remember:
                self.seen.clear()
            got = self.seen[(how, text)] = how(text, self.cost)
        return got

    def _around(self, text: str, mark: re.Pattern, inside) -> str:
        """Read anew each longest stretch of characters for which ``inside`` holds round a mark."""
        out, done = [], 0
        for m in mark.finditer(text):
            if m.start() < done:
                continue
            start, end = m.span()
            while start > done and inside(text[start - 1]):
                start -= 1
            end = (_LETTERS if inside is str.isalpha else _TOKEN).match(text, end).end()
            out += [text[done:start], self._read(_token, text[start:end])]
            done = end
        return "".join([*out, text[done:]]) if out else text

    def __call__(self, text: str | None) -> str:
        text = (text or "").lower()
        if _SPACED.search(text):
            text = _SPACED.sub(lambda m: self._read(_run, m[0]), text)
        return self._around(self._around(text, _SIGNS, _in_token), _REPEATED, str.isalpha)


def _in_token(ch: str) -> bool:
    return not ch.isspace()


def trigram_counts(texts: list[str]) -> np.ndarray:
    low = " " + " ".join(t.lower() for t in texts) + " "
    table = np.array([symbol(chr(i)) for i in range(0x250)])
    codes = code_points(low)
    s = np.where(codes < 0x250, table[np.minimum(codes, 0x24F)], np.where(letters()[codes], 27, 0))
    s = np.concatenate([[0, 0], s[(s > 0) | np.r_[True, s[:-1] > 0]]])
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS ** 3)


def cells(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the cell of the n-gram that begins at each position of the texts, a space before each, and whether all but its first
    character are letters; anything but a letter is a gap."""
    codes = code_points("".join(f" {t}" for t in texts))
    known = letters()[codes]
    codes = np.where(known, codes, np.uint32(32))
    shift = np.uint32(32 - (CELLS.bit_length() - 1))
    key, inside, done = np.zeros(len(codes), np.uint32), np.ones(len(codes), bool), 0
    for n in ORDERS:
        if len(codes) < n:
            return
        for k in range(done, n):
            key = key[:len(codes) - k] * np.uint32(16777619) + codes[k:]
            if k:
                inside = inside[:len(codes) - k] & known[k:]
        done = n
        mixed = key * np.uint32(n)
        yield ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(2654435761)) >> shift, inside


def held(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, times) of the cells the texts hold, of those marked as wanted."""
    ends, found = np.cumsum([len(t) + 1 for t in texts]), [np.zeros(0, np.int64)]
    for cell, inside in cells(texts):
        at = np.flatnonzero(inside if wanted is None else inside & wanted[cell])
        found.append(np.searchsorted(ends, at, side="right") * CELLS + cell[at])
    both, times = np.unique(np.concatenate(found), return_counts=True)
    return both // CELLS, both % CELLS, times


def evidence(texts: list[str], weight: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each text the sum of the weights of its TOP strongest distinct cells; ``weight`` is BINS x CELLS."""
    owner, cell, times = held(texts, wanted)
    w = weight[np.minimum(times, BINS) - 1, cell].astype(float)
    strong = w > LEAST
    owner, w = owner[strong], w[strong]
    order = np.lexsort((-w, owner))
    owner, w = owner[order], w[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return np.bincount(owner[place < TOP], weights=w[place < TOP], minlength=len(texts))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | x), by damped Newton steps with a weak prior."""
    scale = max(1.0, float(np.abs(x).max(initial=0)))
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta, prior = np.zeros(2), np.array([1e-3, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(prior + 1e-6), z.T @ (y - p) - prior * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


@dataclass
class Model:
    costs: np.ndarray
    weight: np.ndarray
    slope: float = 0.0
    offset: float = -np.inf
    _restore: Restorer | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_restore": None}

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        if self._restore is None:
            self._restore = Restorer(self.costs)
        return evidence([self._restore(t) for t in texts], self.weight, self.weight[-1] > LEAST)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if np.isinf(self.offset):
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(texts) + self.offset, -700, 700)))


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """At most ``size`` labelled ids, by hash, and their documents: (toxic, text)."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out("doc_id", 5, 0))
    mixed = F.xxhash64(F.lit("toxicity sample"), "doc_id")
    ids = known.select("doc_id", "toxic", mixed.alias("mixed")).orderBy("mixed", "doc_id").limit(size)
    ids = ids.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # at most ``size`` small rows
    return written(rows.filter("text is not null").select("toxic", "text"))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = labelled_sample(docs, labels, size)

    def letters_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((trigram_counts(p.column("text").to_pylist()) for p in slices(batches)), np.zeros(SYMBOLS ** 3, np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    corpus = docs.filter(~held_out("doc_id", 5, 0)).filter("text is not null").select("text")
    got = corpus.mapInArrow(letters_of, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS ** 3)
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    model = Model(trigram_costs(counts), np.zeros((BINS, CELLS), np.float32))
    restore_with = spark.sparkContext.broadcast(model.costs)

    names = [f"{kind}{k + 1}" for k in range(BINS) for kind in ("clean", "toxic")]

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, total = Restorer(restore_with.value), np.zeros((2 * BINS, CELLS), np.int64)
        for part in slices(batches, limit=1 << 20):
            owner, cell, times = held([restore(t) for t in part.column("text").to_pylist()])
            toxic = (np.asarray(part.column("toxic")) > 0)[owner]
            for k in range(BINS):
                for value in (0, 1):
                    total[2 * k + value] += np.bincount(cell[(times > k) & (toxic == bool(value))], minlength=CELLS)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(row[at]) for row in total]], names=["cell", *names])

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return model
    schema = ", ".join(["cell long", *[f"{n} long" for n in names]])
    summed = sample.mapInArrow(shares, schema).groupBy("cell").agg(*[F.sum(n).alias(n) for n in names]).filter("toxic1 > 0").toArrow()  # at most CELLS rows
    count = np.zeros((2 * BINS, CELLS), np.float32)
    for row, n in zip(count, names, strict=True):
        row[summed["cell"].to_numpy()] = summed[n].to_numpy()

    def weights(less_clean: int, less_toxic: int) -> np.ndarray:
        """BINS x CELLS; each row is the largest weight of so many times or fewer."""
        c, t = np.maximum(count[0::2] - less_clean, 0), np.maximum(count[1::2] - less_toxic, 0)
        ratio = np.log((t + SMOOTH) / (sizes[True] - less_toxic + 2 * SMOOTH)) - np.log((c + SMOOTH) / (sizes[False] - less_clean + 2 * SMOOTH))
        return np.maximum.accumulate(np.where(t > 0, ratio, 0.0), axis=0).astype(np.float32)

    model.weight = weights(0, 0)
    without = spark.sparkContext.broadcast((weights(1, 0), weights(0, 1)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, by_label = Restorer(restore_with.value), without.value
        for part in slices(batches):
            label = np.asarray(part.column("toxic")) > 0
            texts = [restore(t) for t in part.column("text").to_pylist()]
            x = np.zeros(len(texts))
            for value in (0, 1):
                own = np.flatnonzero(label == bool(value))
                x[own] = evidence([texts[i] for i in own], by_label[value], by_label[value][-1] > LEAST)
            yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(x)], names=["toxic", "x"])

    seen = sample.mapInArrow(measure, "toxic int, x double").toArrow()  # at most ``size`` rows
    # a few clean texts without evidence, so that a handful of labels never makes "no evidence" toxic
    x, y = (np.concatenate([seen[n].to_numpy().astype(float), np.zeros(BLANKS)]) for n in ("x", "toxic"))
    model.slope, model.offset = logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """The ``keep`` columns of every row and its score; ``docs`` has text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = shared.value.score(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.array(got)], names=[*keep, name])

    bounded_batches(docs.sparkSession)
    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField(name, T.DoubleType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    name = fresh(docs, "score")
    return score(docs, fit(docs, labels), docs.columns, name).filter(F.col(name) < 0.5).select(*docs.columns)
