"""URL rules by a bit-parallel wildcard automaton (Shift-And over packed glob patterns).

Every rule (host, path) becomes a glob over the canonical URL, the bytes of ``.host <FF> path``: a host and
its subdomains are ``*.host``, a path prefix is ``path*``, and the byte FF, which UTF-8 never has, keeps a
pattern's host from matching inside a path.  A glob may hold ``*`` (any bytes of its part) and ``?`` (one byte).  All globs share one array of 64-bit words:
each has a bit per state, one mask per byte value says which states that byte may enter, and one mask
marks the states that loop under a star.  A step for all patterns of all URLs of a batch is a shift with carry,
an and, and an or.  URLs of a batch run together, longest last, and leave as they end.

The longest fitting rule wins; of equally long ones the one that sorts first.  A URL no rule fits gets ``default``.

Edge cases: a null url or one without ``://`` has empty host and path, which no rule with a host fits;
hosts keep ports and user names, so a rule does not fit them; repeated rows are judged one by one;
very long URLs cost time in proportion to their length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, slices

BETWEEN = 0xFF
# (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ALLOW, BLOCK = "allow", "block"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


class Automaton:
    """All globs at once.  A glob is a list of byte values, None for ``?`` and "*" for a star."""

    def __init__(self, globs: Sequence[list]):
        states, loops, self.last = [], [], []  # per state: the byte that enters it (-1 any, -2 none)
        for glob in globs:
            states.append(-2)
            loops.append(False)
            for token in glob:
                if token == "*":
                    loops[-1] = True
                else:
                    states.append(-1 if token is None else token)
                    loops.append(False)
            self.last.append(len(states) - 1)
        self.words = (len(states) + 63) // 64
        accepts = np.array([[s == b or s == -1 and b != BETWEEN for s in states] for b in range(256)], bool)
        stays = np.array([[loop and (b != BETWEEN) for loop in loops] for b in range(256)], bool)
        self.enter, self.stay = self._pack(accepts), self._pack(stays)
        self.start = self._pack(np.array([[s == -2 for s in states]]))[0]

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(bits), self.words * 64), bool)
        padded[:, :bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view("<u8")

    def match(self, texts: list[bytes]) -> np.ndarray:
        """texts x globs: does the whole text fit the glob?"""
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = (np.cumsum(size) - size)[order]
        length = size[order]
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        live = len(texts)
        for at in range(int(length[0]) if live else 0):
            while length[live - 1] <= at:
                live -= 1
            byte = flat[begin[:live] + at]
            now = state[:live]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:live] = (shifted & self.enter[byte]) | (now & self.stay[byte])
        bits = np.unpackbits(state.view(np.uint8), axis=1, bitorder="little")[:, self.last].astype(bool)
        out = np.empty_like(bits)
        out[order] = bits
        return out


def rule_text(host: str, path: str) -> str:
    return host + path


def glob(host: str, path: str) -> list:
    def part(text: str) -> list:
        return ["*" if b == 0x2A else None if b == 0x3F else b for b in text.encode()]

    return ["*", 0x2E, *part(host), BETWEEN, *part(path), "*"]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; ``pages`` has page_id and url."""
    ranked = sorted(rules, key=lambda r: (-len(rule_text(r[1], r[2])), rule_text(r[1], r[2])))
    names = [rule_text(h, p) for _, h, p in ranked]
    verdicts = [v for v, _, _ in ranked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([glob(h, p) for _, h, p in ranked])
        for part in slices(batches, "path"):
            hosts, paths = part.column("host").to_pylist(), part.column("path").to_pylist()
            fits = automaton.match([b"." + h.encode("utf-8", "surrogatepass") + b"\xff" + p.encode("utf-8", "surrogatepass") for h, p in zip(hosts, paths, strict=True)])
            any_, first = fits.any(axis=1), fits.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("host"), part.column("path"),
                 pa.array([names[k] if a else None for a, k in zip(any_, first, strict=True)], pa.string()),
                 pa.array([verdicts[k] if a else default for a, k in zip(any_, first, strict=True)], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    bounded_batches(pages.sparkSession)
    kind = dict(pages.dtypes)["page_id"]
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


SQL = r"""
WITH p AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS rid
    FROM pages
), r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
    SELECT rid, arg_max(r.host || r.path, len(r.host || r.path)) AS rule, arg_max(verdict, len(r.host || r.path)) AS verdict
    FROM p JOIN r ON ends_with('.' || p.host, '.' || r.host) AND starts_with(p.path, r.path) GROUP BY rid
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)
"""
