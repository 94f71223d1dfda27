"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens.  All pre-tokens a batch has not met before are held as one flat array of
symbols with row borders.  In every round each row finds the lowest rank among its neighbouring
pairs and merges all places of that pair at once, left to right where they overlap; rows without a
pair of any rank are done and leave the arrays.  A pre-token's count is the number of symbols that
survive; a text's count is the sum over its pre-tokens, plus one per special token.

This gives what merging one pair at a time gives as long as no merge yields a symbol that ranks before
the merge itself, which the vocabulary's construction ensures and loading checks.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); texts are counted whole, a long one in
pieces; repeated pre-tokens are looked up in a table of bounded size.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import bounded_batches, slices

LIMIT, REMEMBER, PIECE = 512, 400_000, 1 << 17
# Fixed value: the pre-token pattern of byte-level BPE, with white space spelled out.
_SPACE = r"\t-\r \x85\xA0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, to its byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Merger:
    """Counts the symbols that survive in pre-tokens (bytes)."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.start = np.zeros(256, np.int64)
        for ch, b in byte_letters().items():
            self.start[b] = vocabulary[ch]
        self.base = max(vocabulary.values()) + 1
        left, right, made = (np.array([vocabulary[x] for x in col], np.int64) for col in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        rank_of = np.full(self.base, -1, np.int64)
        rank_of[made] = np.arange(len(pairs))
        if (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a symbol of a later merge")
        order = np.argsort(left * self.base + right)
        self.key, self.rank, self.made = (left * self.base + right)[order], order, made

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], len(self.key))

    def __call__(self, pieces: list[bytes]) -> np.ndarray:
        none = len(self.key)
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        row = np.repeat(np.arange(len(pieces)), counts)
        symbol = self.start[np.frombuffer(b"".join(pieces), np.uint8)]
        while len(symbol) > 1:
            rank = np.append(self.ranks(symbol[:-1], symbol[1:]), none)
            rank[:-1][row[1:] != row[:-1]] = none
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            size = np.diff(np.append(first, len(row)))
            low = np.minimum.reduceat(rank, first)
            hit = (rank == np.repeat(low, size)) & (rank < none)
            at = np.flatnonzero(hit)
            # where a pair overlaps its next place (x x x) every second place counts
            run = np.cumsum(np.append(True, np.diff(at) != 1)[:len(at)]) if len(at) else at
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0] if len(at) else at
            symbol[at] = self.made[rank[at]]
            counts -= np.bincount(row[at], minlength=len(counts))
            stay = np.repeat(low < none, size)  # rows without a pair are done
            stay[at + 1] = False
            symbol, row = symbol[stay], row[stay]
        return counts


@lru_cache(2)
def load(path: str) -> tuple[Merger, regex.Pattern, regex.Pattern | None]:
    """The merger of a byte-level BPE file, its pre-token pattern and the pattern of its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
        raise ValueError("not a plain byte-level BPE file")
    special = [a["content"] for a in spec["added_tokens"]]
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
        raise ValueError("added tokens that take their surroundings are not handled")
    found = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
    return Merger(spec["model"]["vocab"], spec["model"]["merges"]), regex.compile(PATTERN), found


class Counts:
    """Token counts of texts; counts of pre-tokens are remembered up to a bound."""

    def __init__(self, path: str):
        self.merger, self.pattern, self.special = load(path)
        self.known: dict[str, int] = {}

    def _pre_tokens(self, text: str) -> Iterator[tuple[Counter, int]]:
        """Pre-tokens with their numbers, in pieces of bounded length, and special tokens met."""
        at = 0
        for part in (self.special.finditer(text) if self.special else ()):
            yield from self._plain(text, at, part.start())
            yield Counter(), 1
            at = part.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, start: int, end: int) -> Iterator[tuple[Counter, int]]:
        if end - start <= 1 << 20:
            yield Counter(self.pattern.findall(text[start:end])), 0
            return
        found = (m[0] for m in self.pattern.finditer(text[start:end]))
        while piece := Counter(islice(found, PIECE)):
            yield piece, 0

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > REMEMBER:
            self.known = {}
        self.known.update(zip(new, self.merger([w.encode("utf-8", "surrogatepass") for w in new]).tolist(), strict=True))

    def __call__(self, texts: list[str | None]) -> list[int]:
        total = [0] * len(texts)
        parts = [(i, words, n) for i, t in enumerate(texts) if t for words, n in self._pre_tokens(t)]
        for start in range(0, len(parts), 512):
            some = parts[start:start + 512]
            self.known = {} if len(self.known) > REMEMBER else self.known
            self.learn(set().union(*(words for _, words, _ in some)))
            for i, words, n in some:
                missing = [w for w in words if w not in self.known]
                if missing:  # only after the table was emptied
                    self.learn(missing)
                known = self.known
                total[i] += n + sum(known[w] * k for w, k in words.items())
        return total


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``path`` is a byte-level BPE file on every executor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(path)
        for part in slices(batches):
            n = np.array(counts(part.column("text").to_pylist()), np.int64)
            size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
