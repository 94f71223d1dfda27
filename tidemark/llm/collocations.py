"""Phrase collocations by vertical partitioning of a depth-truncated suffix tree.

Texts are cut into pieces at punctuation and pieces into words, all in numpy over the bytes of a batch.  The suffix tree
holds, per language, every run of up to ``longest`` words; a node's count is the sum of the leaf totals below it.

1. Words are counted (batch by batch, then summed).  A phrase of ``least`` occurrences has only word pairs of as many, so pairs are counted
   in a fixed number of hashed cells, saturating at ``least``.  A cell below it holds no such pair; this
   prunes suffixes but loses none.
2. Each position gives its suffix, cut after ``longest`` words or before the first pruned pair.  Equal suffixes are summed in
   the task, then by Spark: one row per distinct leaf.
3. Vertical partitioning: leaves are counted per first word; a prefix with more leaves than ``budget`` is replaced by its
   extensions by one word, again and again, and keeps its own sum.  Prefixes are packed into groups of about ``budget`` leaves.
4. Each group builds its subtree alone: leaves in order, nodes are runs of equal prefixes, counts are sums of leaf totals.
5. A cut's parts are looked up among the nodes and words.  Scores are decimals of 38 digits: exact.  The best of a language are taken per
   salt first, so no task orders a whole language.

Edge cases: a null text has no words; a null lang is ``und`` and shares its counts with a lang of that name; an empty text, table or
piece gives nothing; very long texts are worked on in stretches that end between pieces; repeated rows count as often as they
are there; ties go by count, then by the phrase's bytes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, slices, written

LEAST, LONGEST, BEST, SHARE, BUDGET, STRETCH = 100, 5, 2000, 100, 1 << 17, 4 << 20
_CHUNK = 1 << 16  # cells per row of the table of pair counts
_SPACE, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


# ---------------------------------------------------------------- words of a batch

def stretches(batches: Iterator[pa.RecordBatch], limit: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(lower-case bytes, where documents start in them, their languages), cut between pieces at about ``limit`` bytes."""
    for part in slices(batches, limit=limit):
        text = part.column("text")
        langs = part.column("lang").to_pylist()
        raw = [t.as_buffer() if t.is_valid else b"" for t in text.cast(pa.binary())]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        if len(raw) > 1 or len(data) <= limit:
            yield data, np.cumsum(size) - size, langs
            continue
        begin = 0
        while begin < len(data):  # one long text
            end = begin + limit
            if end < len(data):
                window = np.flatnonzero(_KIND[data[begin:end]] == _BREAK)
                while not len(window) and end < len(data):
                    window = np.flatnonzero(_KIND[data[end:end + limit]] == _BREAK) + (end - begin)
                    end += limit
                end = begin + int(window[-1 if end == begin + limit else 0]) + 1 if len(window) else len(data)
            yield data[begin:end], np.zeros(1, np.int64), langs
            begin = end


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(word numbers in order, the distinct words, document of each, does the next word follow in the same piece?)"""
    kind = _KIND[data]
    inside = kind == 0
    if not inside.any():
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, bool)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = starts[starts < len(data)]
    first[edges] = inside[edges]
    begin = np.flatnonzero(first)
    letters = np.cumsum(inside)
    at = letters[begin] - 1  # where words start among the letters alone
    offsets = np.append(at, letters[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = words.dictionary_encode()
    doc = np.searchsorted(starts, begin, side="right") - 1
    piece = np.cumsum(kind == _BREAK)[begin]
    follows = np.zeros(len(begin), bool)
    follows[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), doc, follows


def lang_codes(langs: list[str | None], doc: np.ndarray) -> tuple[list[str], np.ndarray]:
    names, of = np.unique([x if x is not None else "und" for x in langs], return_inverse=True)
    return names.tolist(), of[doc]


def pair_cells(word: np.ndarray, known: list[bytes], names: list[str], lang: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """The cell of the pair of words at, at + 1."""
    import xxhash

    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
    own = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7) for x in names), np.uint64, len(names))
    mixed = (h[word[at]] * _MIX[0]) ^ (h[word[at + 1]] * _MIX[1]) ^ (own[lang[at]] * _MIX[2])
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MIX[3]) >> np.uint64(64 - bits)).astype(np.int64)


# ---------------------------------------------------------------- counts

def word_counts(docs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(lang, word, f) of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, starts, langs in stretches(batches, stretch):
            word, known, doc, _ = words_of(data, starts)
            if not known:
                continue
            names, lang = lang_codes(langs, doc)
            pair, n = np.unique(lang * len(known) + word, return_counts=True)
            strings = pa.array(known, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(pair // len(known))), strings.take(pa.array(pair % len(known))), pa.array(n.astype(np.int64))],
                                             names=["lang", "word", "f"])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def frequent_cells(docs: DataFrame, least: int, bits: int, stretch: int = STRETCH) -> np.ndarray:
    """By cell: can it hold a pair that occurs ``least`` times?  2^bits cells, whatever the number of pairs."""
    wide = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, wide)
        seen = False
        for data, starts, langs in stretches(batches, stretch):
            word, known, doc, follows = words_of(data, starts)
            names, lang = lang_codes(langs, doc)
            cell, n = np.unique(pair_cells(word, known, names, lang, np.flatnonzero(follows), bits), return_counts=True)
            held[cell] = np.minimum(held[cell].astype(np.int64) + n, least)
            seen = True
        if seen:
            for k, chunk in enumerate(held.reshape(-1, min(_CHUNK, 1 << bits))):
                if chunk.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunk.tobytes()], pa.binary())], names=["chunk", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        done: list[tuple[int, bytes]] = []
        for part in batches:
            for k, cells in zip(part.column("chunk").to_pylist(), part.column("cells").to_pylist(), strict=True):
                own = np.frombuffer(cells, wide).astype(np.int64)
                if k != at:
                    if at is not None:
                        done.append((at, np.packbits(total >= least).tobytes()))
                    at, total = k, own
                else:
                    total = np.minimum(total + own, least)
        if at is not None:
            done.append((at, np.packbits(total >= least).tobytes()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int32()), pa.array([b for _, b in done], pa.binary())], names=["chunk", "cells"])

    bounded_batches(docs.sparkSession)
    parts = docs.mapInArrow(run, "chunk int, cells binary").repartition("chunk").sortWithinPartitions("chunk")
    out = np.zeros(1 << bits, bool)
    width = min(_CHUNK, 1 << bits)
    for r in parts.mapInArrow(add, "chunk int, cells binary").collect():  # 2^bits bits
        out[r["chunk"] * width:(r["chunk"] + 1) * width] = np.unpackbits(np.frombuffer(r["cells"], np.uint8), count=width).astype(bool)
    return out


def leaves(docs: DataFrame, frequent: np.ndarray, bits: int, longest: int, stretch: int = STRETCH) -> DataFrame:
    """(lang, suffix, total): the distinct truncated suffixes of two or more words and how often each starts."""
    packed = np.packbits(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = np.unpackbits(packed, count=1 << bits).astype(bool)
        for data, starts, langs in stretches(batches, stretch):
            word, known, doc, follows = words_of(data, starts)
            names, lang = lang_codes(langs, doc)
            at = np.flatnonzero(follows)
            on = np.zeros(len(word) + longest, bool)
            on[at] = live[pair_cells(word, known, names, lang, at, bits)]
            key = np.flatnonzero(on)
            if not len(key):
                continue
            word = np.append(word, np.zeros(longest, np.int64))
            code, goes = lang[key] * np.int64(len(known)) + word[key], np.ones(len(key), bool)
            rows = [word[key]]
            for k in range(1, longest):  # numbers for ever longer prefixes, exact
                goes &= on[key + k - 1]
                rows.append(np.where(goes, word[key + k], -1))
                _, code = np.unique(code, return_inverse=True)
                code = code * np.int64(len(known) + 1) + rows[-1] + 1
            _, of, n = np.unique(code, return_index=True, return_counts=True)
            table = np.stack(rows, axis=1)[of].tolist()
            suffix = [b" ".join([known[w] for w in r if w >= 0]) for r in table]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lang[key][of])), pa.array(suffix, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))],
                                             names=["lang", "suffix", "total"])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, "lang string, suffix string, total long").groupBy("lang", "suffix").agg(F.sum("total").alias("total"))


# ---------------------------------------------------------------- vertical partitioning

def _first(words: int) -> Column:
    return F.substring_index("suffix", " ", words)


def grouped(rows: DataFrame, budget: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """The leaves with ``group``: whole prefixes, each of at most ``budget`` leaves, packed into groups of about as many;
    and (lang, phrase, words, f) of the prefixes that were replaced by longer ones, which lie above all groups."""
    spark = rows.sparkSession
    prefix, depth = _first(1), 1
    wide, above = rows, []
    while depth < longest:
        busy = wide.groupBy("lang", prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("f")).filter(F.col("n") > budget)
        listed = [(r["lang"], r["p"], depth, r["f"]) for r in busy.collect()]  # fewer than leaves / budget
        if not listed:
            break
        above += listed
        heavy = F.broadcast(spark.createDataFrame([x[:2] for x in listed], "lang string, p string"))
        marked = wide.withColumn("p", prefix).join(heavy.withColumn("heavy", F.lit(True)), ["lang", "p"], "left")
        depth += 1
        wide = marked.withColumn("prefix", F.when(F.col("heavy"), _first(depth)).otherwise(F.col("p"))).drop("p", "heavy")
        prefix = F.col("prefix")
    placed = wide.withColumn("prefix", prefix)
    cells = max(64, 16 * -(-rows.count() // budget))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("lang", "prefix"), F.lit(cells)).cast("int"))
    held = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    group, full, table = 0, 0, []
    for c in range(cells):
        n = held.get(c, 0)
        if full and full + n > budget:
            group, full = group + 1, 0
        full += n
        table.append((c, group))
    top = spark.createDataFrame(above, "lang string, phrase string, words int, f long")
    return placed.join(F.broadcast(spark.createDataFrame(table, "cell int, group int")), "cell").select("group", "lang", "suffix", "total"), top


def nodes(rows: DataFrame, top: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, words, f): the nodes of two or more words and ``least`` occurrences, of every group's subtree and above them."""
    def subtree(held: pa.Table) -> pa.Table:
        lang = held.column("lang").combine_chunks().dictionary_encode()
        total = held.column("total").to_numpy()
        split = pc.split_pattern(held.column("suffix").combine_chunks(), " ")
        size = pc.list_value_length(split).to_numpy()
        words = split.flatten().dictionary_encode()
        known, number = words.dictionary, words.indices.to_numpy()
        first = np.cumsum(size) - size
        word = np.full((longest, len(size)), -1, np.int64)
        for k in range(longest):
            word[k, size > k] = number[first[size > k] + k]
        code = lang.indices.to_numpy()
        order = np.lexsort([*word[::-1], code])  # leaves in the order of the tree
        word, total, code = word[:, order], total[order], code[order]
        new = np.append(True, np.diff(code) != 0)
        out: list[tuple[str, str, int, int]] = []
        for k in range(longest):
            new = new | np.append(True, word[k, 1:] != word[k, :-1])  # a node is a run of leaves with one prefix
            begin = np.flatnonzero(new)
            f = np.add.reduceat(total, begin)
            some = (f >= least) & (word[k, begin] >= 0) & (k > 0)
            for i, n in zip(begin[some].tolist(), f[some].tolist(), strict=True):
                out.append((lang.dictionary[int(code[i])].as_py(), " ".join(known.take(pa.array(word[:k + 1, i])).to_pylist()), k + 1, n))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)],
                                    names=["lang", "phrase", "words", "f"])

    inside = rows.groupBy("group").applyInArrow(subtree, "lang string, phrase string, words int, f long")
    return inside.join(F.broadcast(top), ["lang", "phrase"], "left_anti").union(top.filter((F.col("words") > 1) & (F.col("f") >= least)))


# ---------------------------------------------------------------- scores

def _lasting(found: DataFrame, share: int) -> DataFrame:
    """Candidates inside no longer one of ``share`` hundredths of their count; one word longer decides for all longer ones."""
    parts = F.array(F.regexp_replace("phrase", r" [^ ]*\z", ""), F.regexp_replace("phrase", r"\A[^ ]* ", ""))
    over = found.filter("words > 2").select("lang", F.explode(parts).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return found.join(over, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {share} * f").drop("longer")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, share: int = SHARE,
         budget: int = BUDGET, stretch: int = STRETCH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases of 2 to ``longest`` words; ``docs`` has text and lang."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text is not null")
    words = written(word_counts(texts, stretch))
    size = words.groupBy("lang").agg(F.sum("f").alias("n"))
    n = words.agg(F.sum("f")).first()[0] or 0
    bits = min(26, max(12, (n // 16).bit_length()))
    frequent = frequent_cells(texts, least, bits, stretch)
    suffixes = written(leaves(texts, frequent, bits, longest, stretch))
    tree = written(nodes(*grouped(suffixes, budget, longest), least, longest))
    known = tree.select("lang", "phrase", "f").union(words.filter(F.col("f") >= least).select("lang", "word", "f"))

    spread = F.expr("transform(sequence(1, words - 1), k -> struct(k, substring_index(phrase, ' ', k) as first, substring_index(phrase, ' ', k - words) as rest))")
    cuts = _lasting(tree, share).select("lang", "phrase", F.col("f").alias("a"), F.explode(spread).alias("cut")).select("lang", "phrase", "a", "cut.*")
    part = lambda name, out: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(out))
    whole = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(size, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = whole.withColumn("above", (exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")).withColumn(
        "score", F.expr("above div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))"))
    least_cut = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("c")).select("lang", "phrase", "c.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = least_cut.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# The same for DuckDB: every phrase of up to five words, counted.
SQL = r"""
WITH p AS (
    SELECT lang, unnest(range(len(pieces))) AS at, unnest(pieces) AS piece, doc FROM (
        SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
               regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
        FROM documents WHERE text IS NOT NULL)
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), g AS (
    SELECT lang, k AS words, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4, 5]) AS k)
    WHERE i + k - 1 <= len(words) GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE words = 1 GROUP BY lang
), c AS (SELECT lang, words, phrase, f, string_split(phrase, ' ') AS parts FROM g WHERE words >= 2 AND f >= 100
), s AS (
    SELECT DISTINCT lang, sub FROM (
        SELECT l.lang, array_to_string(l.parts[i:i + k - 1], ' ') AS sub, l.f
        FROM (SELECT *, unnest(range(1, words + 1)) AS i FROM c) l, (SELECT unnest([2, 3, 4]) AS k)
        WHERE k < words AND i + k - 1 <= words) x
    WHERE EXISTS (SELECT 1 FROM c WHERE c.lang = x.lang AND c.phrase = x.sub AND 100 * x.f >= 100 * c.f)
), u AS (
    SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(parts[1:k], ' ') AS first, array_to_string(parts[k + 1:words], ' ') AS rest
    FROM c, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k < words AND NOT EXISTS (SELECT 1 FROM s WHERE s.lang = c.lang AND s.sub = c.phrase)
), x AS (
    SELECT u.lang, u.phrase, a, k, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f) AS score
    FROM u JOIN g l ON l.lang = u.lang AND l.phrase = u.first JOIN g r ON r.lang = u.lang AND r.phrase = u.rest JOIN n ON n.lang = u.lang
), m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM m QUALIFY rank <= 2000
"""
