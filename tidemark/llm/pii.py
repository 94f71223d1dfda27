"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

*Base.*  Per kind (email, ip, card, phone) the leftmost non-overlapping matches of a fixed pattern that pass its check; they
always stay.  All scans are linear in the text, also on long runs of digits or word characters.

*Generators.*  Every window of neighbouring digit groups that could be an address, a card or a phone number, and every
``local at host`` written with a sign, in brackets or as words.  They overlap freely: a card number written twice in a row is
one failing match of the base pattern, but two of its windows are cards.

*Trees.*  Format features (lengths, groups, separators, check digit, parts) and context features (neighbouring characters,
groups on either side, letters around) go through gradient boosted trees with logistic loss.  No span is labelled in the
data, so labels come from the base: base spans are positive, windows that overlap one or that fail the check are
negative.  Positives are also written next to each other and in other notations (brackets for signs, dots or wide blanks
for gaps, no country code), which the base cannot match.  A quarter of the rows is kept aside; per kind the
threshold is the lowest at which ``PRECISION`` of the new spans selected there are right.

*All candidates.*  Trees are fitted on every candidate of the table, base and not, each span with its context once.  Examples
are reduced to distinct feature rows with counts; up to ``HELD`` of these are fitted on in one process, more stay a table of one
byte per feature, whose tasks send sums per (feature, node, bin).  Features are cut at the same quantiles and thresholds are the
same either way.

Selection takes the base spans, then candidates by falling score that overlap nothing taken.  Edge cases: null and empty texts
have no span; repeated rows give repeated results; equal scores go by start, end, kind; without a base span in the table
nothing is learned and nothing added; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, slices, written
from tidemark.plans.cut import discard
from tidemark.plans.values import score_curve

KINDS = ("email", "ip", "card", "phone")
CONTEXT, PRECISION, ROUNDS, DEPTH, RATE, BINS, SEED = 48, 0.995, 80, 4, 0.2, 32, 42
HELD, EVERY, BUCKET_BITS = 1 << 18, 8, 12
Span = tuple[int, int, int]  # kind, start, end

# ---------------------------------------------------------------- the base patterns

_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_SPACED = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def local_start(text: str, end: int, floor: int) -> int:
    """Where the run of local-part characters that ends at ``end`` begins, not before ``floor``."""
    while end > floor and text[end - 1] in _LOCAL:
        end -= 1
    return end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def small_parts(parts: list[str]) -> bool:
    return all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in parts)


def base_spans(text: str) -> list[Span]:
    """The valid matches of the four patterns, by kind, then start."""
    out: list[Span] = []
    floor = 0
    if "@" in text:
        for m in _HOST.finditer(text):
            start = local_start(text, m.start(), floor)
            if start < m.start():
                out.append((0, start, m.end()))
                floor = m.end()
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if small_parts(four):
                out.append((1, at, at + size))
            at += size + 1
    for m in _SPACED.finditer(text):
        if 16 <= m.end() - m.start() and m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PLUS.finditer(text):
            if 8 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# ---------------------------------------------------------------- generators

_GROUP = re.compile(r"[0-9]++")
# What may stand between two digit groups of one number, and how a sign or a dot is written out.
_GAPS = {" ": 1, "-": 2, " - ": 2, ".": 3, ") ": 4, " (": 4, ")": 4, "(": 4, " ": 5, " ": 5, "  ": 5, "[.]": 6, "(.)": 6, "/": 7, "--": 7}
_SIGNS = {"@": 0, "\uff20": 1, "[at]": 2, "(at)": 2, "{at}": 2, "[AT]": 2, "(AT)": 2, "[@]": 2, "(@)": 2, " at ": 3, " AT ": 3}
_OUT_DOT = r"(?:\.| ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| dot | DOT | \. )"
_OUT_HOST = re.compile(rf" ?[A-Za-z0-9-]++(?:{_OUT_DOT}[A-Za-z0-9-]++)++")


@dataclass(frozen=True, slots=True)
class Candidate:
    kind: int
    start: int
    end: int
    groups: tuple[str, ...] = ()
    gaps: tuple[str, ...] = ()
    left: int = 0   # digit groups of the same chain before and after
    right: int = 0
    sign: int = 0


def chains(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of digit groups with nothing between them but a gap."""
    held: list[tuple[int, int]] = []
    for m in _GROUP.finditer(text):
        if held and not (m.start() - held[-1][1] <= 3 and text[held[-1][1]:m.start()] in _GAPS):
            yield held
            held = []
        held.append(m.span())
    if held:
        yield held


def candidates(text: str) -> list[Candidate]:
    """Everything that could be personal data; the number is linear in the text."""
    out: list[Candidate] = []
    for sign, code in _SIGNS.items():
        at = text.find(sign)
        while at >= 0:
            m = _OUT_HOST.match(text, at + len(sign))
            if m:
                stop = at - 1 if at and text[at - 1] == " " else at
                start = local_start(text, stop, 0)
                if start < stop:
                    out.append(Candidate(0, start, m.end(), (text[start:stop],), (text[m.start():m.end()],), 0, 0, code))
            at = text.find(sign, at + len(sign))
    for chain in chains(text):
        if len(chain) == 1 and not 7 <= chain[0][1] - chain[0][0] <= 19:
            continue
        size = [b - a for a, b in chain]
        for i in range(len(chain)):
            total = 0
            for j in range(i, min(len(chain), i + 8)):
                total += size[j]
                if total > 19:
                    break
                if total < 4 or (j - i != 3 and total < 7):
                    continue
                groups = tuple(text[a:b] for a, b in chain[i:j + 1])
                gaps = tuple(text[chain[k][1]:chain[k + 1][0]] for k in range(i, j))
                start, end, rest = chain[i][0], chain[j][1], (len(chain) - 1 - j)
                if j - i == 3 and all(g in (".", "[.]", "(.)") for g in gaps):
                    out.append(Candidate(1, start, end, groups, gaps, i, rest))
                if total >= 13:
                    out.append(Candidate(2, start, end, groups, gaps, i, rest))
                if 7 <= total <= 15:
                    if start and text[start - 1] == "(":
                        start -= 1
                    if start and text[start - 1] == "+":
                        start -= 1
                    out.append(Candidate(3, start, end, groups, gaps, i, rest))
    return out


# ---------------------------------------------------------------- features

def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "+(" else 5 if c in ".-/)" else 6 if c in ",;:!?" else 7


def features(text: str, c: Candidate) -> list[float]:
    span = text[c.start:c.end]
    before, after = text[max(0, c.start - 16):c.start], text[c.end:c.end + 16]
    digits = "".join(x for x in span if "0" <= x <= "9") if not c.kind else "".join(c.groups)
    sizes = [len(g) for g in c.groups]
    kinds = {_GAPS.get(g, 0) for g in c.gaps}
    host = re.split(_OUT_DOT, c.gaps[0].strip()) if not c.kind else []
    return [
        c.kind, len(span), len(digits), len(c.groups), sizes[0], sizes[-1], max(sizes), min(sizes), len(kinds), *[k in kinds for k in range(1, 8)],
        span[0] == "+", span[0] == "(", bool(c.kind) and luhn(digits), bool(c.kind) and small_parts(list(c.groups)),
        sum(g[0] == "0" and len(g) > 1 for g in c.groups), int(digits[0]) if digits else -1, len(set(digits)),
        _class(before[-1:]), _class(after[:1]), _class(after[1:2]), _class(before[-2:-1]), min(c.left, 8), min(c.right, 8),
        sum(x.isalpha() for x in before), sum(x.isalpha() for x in after), "\n" in before, "|" in before or "|" in after,
        c.sign, len(host), len(host[-1]) if host else 0, bool(host) and host[-1].isalpha(), span.count(" "), not c.kind and "." in c.groups[0],
        span.count("(") - span.count(")"), sum(_GAPS.get(g, 0) == 4 for g in c.gaps),
    ]


# ---------------------------------------------------------------- boosted trees

@dataclass
class Trees:
    """Complete binary trees: at node i rows with feature <= cut go to 2i + 1, others to 2i + 2."""

    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while (node < len(feature)).any():
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-out))


def edges_of(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """The distinct quantiles of sorted values that come so many times."""
    upto = np.cumsum(counts)
    return np.unique(values[np.searchsorted(upto, np.floor((upto[-1] - 1) * np.linspace(0, 1, bins)[1:-1]).astype(np.int64), side="right")])


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def node_of(binned: np.ndarray, feature: np.ndarray, at: np.ndarray, levels: int) -> np.ndarray:
    """Where rows stand after so many levels: at node i those with bin <= cut go to 2i + 1, others to 2i + 2."""
    node, row = np.zeros(len(binned), np.int64), np.arange(len(binned))
    for _ in range(levels):
        node = 2 * node + 1 + (binned[row, feature[node]] > at[node])
    return node


def level_sums(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, feature: np.ndarray, at: np.ndarray, level: int, bins: int) -> np.ndarray:
    """(features, 2, nodes, bins): gradient and curvature of the rows at each node of a level."""
    width = 1 << level
    base = (node_of(binned, feature, at, level) - width + 1) * bins
    out = np.empty((binned.shape[1], 2, width, bins))
    for f in range(binned.shape[1]):
        cell = base + binned[:, f]
        for k, v in enumerate((grad, hess)):
            out[f, k] = np.bincount(cell, v, width * bins).reshape(width, bins)
    return out


def boosted(sweep: Callable, grown: Callable, edges: list[np.ndarray], share: float, rounds: int, depth: int, rate: float, bins: int) -> Trees:
    """Second-order boosting of the logistic loss: ``sweep(feature, at, level)`` gives a level's sums, ``grown`` is told each tree."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    trees = Trees(float(np.log(share / (1 - share))))
    for _ in range(rounds):
        feature, at = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, bins, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            sums = np.cumsum(sweep(feature, at, level), axis=3)
            g, h = sums[:, 0], sums[:, 1]
            gain = g ** 2 / (h + 1) + (g[:, :, -1:] - g) ** 2 / (h[:, :, -1:] - h + 1) - g[:, :, -1:] ** 2 / (h[:, :, -1:] + 1)
            gain[(h < 1) | (h[:, :, -1:] - h < 1)] = 0
            for f, e in enumerate(edges):
                gain[f, :, len(e):] = 0
            top = gain.max(axis=2)
            best = top.argmax(axis=0)
            for k in np.flatnonzero(top.max(axis=0) > 1e-9):
                feature[first + k], at[first + k] = best[k], gain[best[k], k].argmax()
        node = np.arange(width)
        f, cut = feature[first:], np.minimum(at[first:], bins - 1)
        left = np.stack([g[f, node, cut], h[f, node, cut]])
        both = np.stack([left, np.stack([g[f, node, -1], h[f, node, -1]]) - left], axis=2).reshape(2, -1)  # left, right, left, ...
        leaf = rate * both[0] / (both[1] + 1)
        trees.feature.append(feature)
        trees.cut.append(np.array([edges[i][k] if k < bins else np.inf for i, k in zip(feature, at, strict=True)]))
        trees.leaf.append(leaf)
        grown(feature, at, leaf)
    return trees


def gradients(y: np.ndarray, weight: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return weight * (y - p), weight * p * (1 - p)


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, weight: np.ndarray | None = None) -> Trees:
    """Boosted trees on rows held here; a row of weight w counts as w equal ones."""
    weight = np.ones(len(y)) if weight is None else weight
    edges = []
    for f in range(x.shape[1]):
        values, place = np.unique(x[:, f], return_inverse=True)
        edges.append(edges_of(values, np.bincount(place, weight), bins))
    binned = to_bins(x, edges)
    share = float((y * weight).sum() / weight.sum())
    limited = min(max(share, 1e-6), 1 - 1e-6)
    margin = np.full(len(y), np.log(limited / (1 - limited)))
    now = list(gradients(y, weight, margin))

    def grown(feature: np.ndarray, at: np.ndarray, leaf: np.ndarray) -> None:
        margin[:] += leaf[node_of(binned, feature, at, depth) - len(feature)]
        now[:] = gradients(y, weight, margin)

    return boosted(lambda feature, at, level: level_sums(binned, *now, feature, at, level, bins), grown, edges, share, rounds, depth, rate, bins)


# ---------------------------------------------------------------- examples and thresholds

def _other_notations(kind: int, span: str, turn: int) -> str | None:
    """The same datum as the base cannot match it."""
    if kind == 0:
        local, host = span.rsplit("@", 1)
        dot = (".", " dot ", "[dot]", ".", " (dot) ")[turn % 5]
        return local + (" [at] ", " at ", "(at)", "[at]", " (at) ")[turn % 5] + host.replace(".", dot)
    if kind == 1:
        return span.replace(".", ("[.]", "(.)")[turn % 2])
    if kind == 2:
        digits = re.sub("[^0-9]", "", span)
        return ("\u00a0", ".", "  ")[turn % 3].join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return (re.sub(r"^\+[0-9]{1,3} ?(?=\()", "", span), span.replace(" ", "\u00a0"))[turn % 2]


Fact = tuple[list[float], int, int, bool, bool]


def examples(kind: int, base: bool, h: int, left: str, span: str, right: str, other: tuple[int, str] | None) -> list[Fact]:
    """(features, label, kind, kept aside, is it beyond the base?) of a candidate; ``other`` is a number to write next to a number."""
    out: list[Fact] = []

    def learn(text: str, good: set[Span], area: tuple[int, int]) -> None:
        known = set(base_spans(text))
        for c in candidates(text):
            if c.start < area[1] and c.end > area[0]:
                out.append((features(text, c), int((c.kind, c.start, c.end) in good), c.kind, aside, (c.kind, c.start, c.end) not in known))

    aside, text = h % 4 == 0, left + span + right
    area = (len(left), len(left) + len(span))
    if not base:
        if base_spans(span) != [(kind, 0, len(span))]:  # one that would pass alone stays unlabelled
            out += [(features(text, c), 0, kind, aside, True) for c in candidates(text) if (c.kind, c.start, c.end) == (kind, *area)]
        return out
    learn(text, {(kind, *area)}, area)
    written_out = _other_notations(kind, span, h // 4)
    if written_out and written_out != span:
        area = (len(left), len(left) + len(written_out))
        learn(left + written_out + right, {(kind, *area)}, area)
    if kind == 0:  # a word at a host is no address
        word = re.sub("[^A-Za-z]", "", span.split("@")[0]) or "it"
        some = f"{word} at {span.rsplit('@', 1)[1]}"
        learn(left + some + right, set(), (len(left), len(left) + len(some)))
    if kind and other:  # two numbers in a row
        second = len(left) + len(span) + 1
        area = (len(left), second + len(other[1]))
        learn(f"{left}{span} {other[1]}{right}", {(kind, len(left), second - 1), (other[0], second, area[1])}, area)
    return out


def threshold(score: np.ndarray, label: np.ndarray, precision: float, weight: np.ndarray | None = None) -> float:
    """Where to cut so that as many as possible are taken and the share of right ones among them is still ``precision``:
    half way to the next lower score, 0.5 at least; 2 if no cut is good."""
    order = np.argsort(-score, kind="stable")
    weight = np.ones(len(score)) if weight is None else weight
    right = np.cumsum((label * weight)[order]) / np.cumsum(weight[order])
    last = np.append(score[order][1:] < score[order][:-1], True) if len(order) else np.zeros(0, bool)
    good = np.flatnonzero((right >= precision) & last)
    if not len(good):
        return 2.0
    rest = score[order][good[-1] + 1:]
    return float(max(0.5, (score[order][good[-1]] + rest[0]) / 2)) if len(rest) else 0.5


# ---------------------------------------------------------------- Spark

def found_in(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """(kind, base, h, before, span, after): every candidate with its context and their hash, each once.

    ``sample`` keeps only so many of each kind, base or not: those with the smallest hash.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: dict[tuple[int, bool, int], tuple[str, str, str]] = {}
            for text in part.column("text").to_pylist():
                if not text:
                    continue
                base = set(base_spans(text))
                for kind, a, b in {(c.kind, c.start, c.end) for c in candidates(text)} | base:
                    left, right = text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]
                    h = xxhash.xxh64_intdigest(f"{left}\0{text[a:b]}\0{right}".encode("utf-8", "surrogatepass"), SEED) >> 1
                    out[kind, (kind, a, b) in base, h] = left, text[a:b], right
            if out:
                rows = [(*group, *texts) for group, texts in out.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)],
                                                 names=["kind", "base", "h", "before", "span", "after"])

    bounded_batches(docs.sparkSession)
    found = written(docs.select("text").mapInArrow(run, "kind int, base boolean, h long, before string, span string, after string").dropDuplicates(["kind", "base", "h"]))
    if sample is None:
        return found
    some = [found.filter((F.col("kind") == k) & (F.col("base") == b)).orderBy("h").limit(sample) for k in range(len(KINDS)) for b in (True, False)]
    out = some[0]
    for s in some[1:]:
        out = out.unionByName(s)
    return written(out)


def with_partners(found: DataFrame) -> DataFrame:
    """Add ``other_kind`` and ``other_span``: for each number of the base another one, at place h / 7 modulo their count in the
    order of kind and hash.  Places are counted in buckets of the hash's first bits."""
    is_number = F.col("base") & (F.col("kind") > 0)
    numbers = found.filter(is_number).withColumn("bucket", F.shiftright("h", 63 - BUCKET_BITS))
    sizes = sorted(map(tuple, numbers.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()))  # at most 3 x 2^BUCKET_BITS
    none = found.filter(~is_number).withColumns({"other_kind": F.lit(None).cast("int"), "other_span": F.lit(None).cast("string")})
    if not sizes:
        return none
    upto = list(accumulate(n for *_, n in sizes))
    starts = found.sparkSession.createDataFrame([(k, b, end - n) for (k, b, n), end in zip(sizes, upto, strict=True)], "kind int, bucket long, start long")
    place = F.col("start") + F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("h")) - 1
    placed = numbers.join(F.broadcast(starts), ["kind", "bucket"]).select(place.alias("at"), F.col("kind").alias("other_kind"), F.col("span").alias("other_span"))
    asked = found.filter(is_number).withColumn("at", F.expr("h div 7") % upto[-1])
    return none.unionByName(asked.join(placed, "at").drop("at"))


_FACTS = "x binary, label int, kind int, aside boolean, beyond boolean, n long"


def facts_of(found: DataFrame) -> DataFrame:
    """Distinct examples of all candidates, as 32-bit features, with how many they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            held: Counter = Counter()
            for kind, base, h, left, span, right, k, s in zip(*(part.column(n).to_pylist() for n in ("kind", "base", "h", "before", "span", "after", "other_kind", "other_span")), strict=True):
                held.update((np.array(x, np.int32).tobytes(), *rest) for x, *rest in examples(kind, base, h, left, span, right, None if k is None else (k, s)))
            if held:
                rows = [(*fact, n) for fact, n in held.items()]
                kinds = (pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=["x", "label", "kind", "aside", "beyond", "n"])

    return with_partners(found).mapInArrow(run, _FACTS).groupBy("x", "label", "kind", "aside", "beyond").agg(F.sum("n").alias("n"))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _numpy(part: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [part.column(n).to_numpy() if isinstance(part, pa.Table) else part.column(n).to_numpy(zero_copy_only=False) for n in names]


@dataclass
class Model:
    trees: Trees
    cuts: list[float]  # by kind


def learn(found: DataFrame, precision: float = PRECISION) -> Model | None:
    """Trees and thresholds from all candidates, in this process or, where distinct examples are more than ``HELD``, as a table."""
    facts = written(facts_of(found))
    n = {(r["aside"], r["label"]): r["n"] for r in facts.groupBy("aside", "label").agg(F.sum("n").alias("n")).collect()}
    if not ((True, 0) in n or (True, 1) in n) or (False, 0) not in n or (False, 1) not in n:
        return None
    if facts.count() > HELD:
        trees = fit_spread(facts.filter("not aside"), n[False, 1] / (n[False, 0] + n[False, 1]))
        return Model(trees, cuts_spread(facts.filter("aside and beyond"), trees, precision))
    held = facts.orderBy("x", "label", "kind", "aside", "beyond").toArrow()
    x = _matrix(held.column("x"), np.int32)
    label, kind, aside, beyond, count = _numpy(held, "label", "kind", "aside", "beyond", "n")
    fit, test = ~aside, aside & beyond
    trees = fit_trees(x[fit], label[fit], weight=count[fit].astype(float))
    score = trees.scores(x)
    return Model(trees, [threshold(score[own], label[own], precision, count[own]) for own in (test & (kind == k) for k in range(len(KINDS)))])


def fit_spread(facts: DataFrame, share: float, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """``fit_trees`` on a table of (x, label, n): bins, labels and margins stay with the tasks, which send a level's sums."""
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x, (count,) = _matrix(part.column("x"), np.int32), _numpy(part, "n")
            for f in range(x.shape[1]):
                values, place = np.unique(x[:, f], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f, np.int32)), pa.array(values.astype(np.int64)), pa.array(np.bincount(place, count).astype(np.int64))], names=["f", "v", "n"])

    values: dict[int, list[tuple[int, int]]] = {}
    for r in facts.select("x", "n").mapInArrow(seen, "f int, v long, n long").groupBy("f", "v").agg(F.sum("n").alias("n")).collect():  # lengths and small codes
        values.setdefault(r["f"], []).append((r["v"], r["n"]))
    edges = [edges_of(*(np.array(v) for v in zip(*sorted(values[f]))), bins) for f in range(len(values))]
    limited = min(max(share, 1e-6), 1 - 1e-6)
    start, kept = float(np.log(limited / (1 - limited))), "bins binary, label int, n long, margin double"

    def to_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            own = to_bins(_matrix(part.column("x"), np.int32), edges)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in own], pa.binary()), part.column("label"), part.column("n"), pa.array(np.full(len(own), start))], names=["bins", "label", "n", "margin"])

    state: dict = {"table": written(facts.select("x", "label", "n").mapInArrow(to_table, kept)), "since": []}

    def margins(part: pa.RecordBatch, since: list) -> tuple[np.ndarray, np.ndarray]:
        binned, (margin,) = _matrix(part.column("bins"), np.uint8), _numpy(part, "margin")
        return binned, margin + sum((leaf[node_of(binned, feature, at, depth) - len(feature)] for feature, at, leaf in since), np.zeros(len(margin)))

    def sweep(feature: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        since = list(state["since"])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for part in batches:
                binned, margin = margins(part, since)
                label, count = _numpy(part, "label", "n")
                own = level_sums(binned, *gradients(label, count, margin), feature, at, level, bins)
                total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([v.tobytes() for v in total], pa.binary())], names=["f", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for part in batches:
                for f, v in zip(part.column("f").to_pylist(), part.column("sums").to_pylist(), strict=True):
                    total[f] = total.get(f, 0) + np.frombuffer(v)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["f", "sums"])

        found = state["table"].mapInArrow(sums, "f int, sums binary").repartition("f").mapInArrow(added, "f int, sums binary").collect()  # one row per feature
        return np.stack([np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["f"])]).reshape(len(edges), 2, 1 << level, bins)

    def grown(feature: np.ndarray, at: np.ndarray, leaf: np.ndarray) -> None:
        state["since"].append((feature, at, leaf))
        if len(state["since"]) == EVERY:
            since, old = list(state["since"]), state["table"]

            def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in batches:
                    yield part.set_column(part.schema.get_field_index("margin"), "margin", pa.array(margins(part, since)[1]))

            state["table"], state["since"] = written(old.mapInArrow(update, kept)), []
            discard(old)

    trees = boosted(sweep, grown, edges, share, rounds, depth, rate, bins)
    discard(state["table"])
    return trees


def cuts_spread(facts: DataFrame, trees: Trees, precision: float) -> list[float]:
    """``threshold`` per kind from running counts over the distinct scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            label, count = _numpy(part, "label", "n")
            yield pa.RecordBatch.from_arrays([part.column("kind"), pa.array(trees.scores(_matrix(part.column("x"), np.int32))), pa.array(label * count), part.column("n")], names=["kind", "score", "good", "n"])

    scored = facts.select("x", "kind", "label", "n").mapInArrow(run, "kind int, score double, good long, n long")
    curve = written(score_curve(scored, F.col("score"), ["kind"], good=F.col("good"), n=F.col("n")))
    fine = (F.col("above_good") + F.col("good")) / (F.col("above_n") + F.col("n")) >= precision
    last = curve.filter(fine).groupBy("kind").agg(F.min("score").alias("last"))
    rows = curve.join(F.broadcast(last), "kind").groupBy("kind").agg(F.first("last").alias("last"), F.max(F.when(F.col("score") < F.col("last"), F.col("score"))).alias("next")).collect()  # four
    found = {r["kind"]: 0.5 if r["next"] is None else max(0.5, (r["last"] + r["next"]) / 2) for r in rows}
    return [found.get(k, 2.0) for k in range(len(KINDS))]


def selected(base: list[Span], found: list[tuple[float, Span]], cuts: list[float]) -> list[Span]:
    """The base spans and, by falling score, those of the others at their kind's threshold that overlap none before."""
    taken = list(base)
    starts = sorted((a, b) for _, a, b in base)
    reach = 0
    merged: list[tuple[int, int]] = []  # base spans of different kinds may overlap
    for a, b in starts:
        if merged and a < reach:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
        reach = merged[-1][1]
    for score, (kind, a, b) in sorted(found, key=lambda x: (-x[0], x[1][1], x[1][2], x[1][0])):
        if score < cuts[kind]:
            continue
        at = bisect_right(merged, (a, b))
        if (at == 0 or merged[at - 1][1] <= a) and (at == len(merged) or merged[at][0] >= b):
            insort(merged, (a, b))
            taken.append((kind, a, b))
    return sorted(taken)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def spans_of(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (kind, start, end), code points, by kind, then start."""
    kind = "array<struct<kind:string,start:int,end:int>>"
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            base, found, x = [], [], []
            for t in part.column("text").to_pylist():
                base.append(base_spans(t or ""))
                own = candidates(t) if t and model else []
                sure = set(base[-1])
                own = [c for c in own if (c.kind, c.start, c.end) not in sure]
                x += [features(t, c) for c in own]
                found.append(own)
            score = model.trees.scores(np.array(x, float)).tolist() if x else []
            whole, at = [], 0
            for b, own in zip(base, found, strict=True):
                scored = [(s, (c.kind, c.start, c.end)) for s, c in zip(score[at:at + len(own)], own, strict=True)]
                at += len(own)
                whole.append(selected(b, scored, model.cuts) if scored else b)
            lists = [pa.array([[{"kind": KINDS[k], "start": a, "end": e} for k, a, e in row] for row in rows], spans) for rows in (base, whole)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], names=["doc_id", "base", "spans"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def find(docs: DataFrame, sample: int | None = None, precision: float = PRECISION) -> DataFrame:
    """(doc_id, base, spans) with trees learned from all candidates of the table itself; ``docs`` has doc_id and text."""
    return spans_of(docs, learn(found_in(docs, sample), precision))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans, their SHA-256 and the list of all spans."""
    def text(column: str) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
