"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item is asked for through its windows: runs of ``window`` consecutive words, or all its words if it has fewer.
The words of a window, one-word shingles, are ordered by how rare they are in the documents.  A window can
only be contained in full where its rarest word occurs, so that word is its necessary prefix: windows are
indexed by it, and only its occurrences in documents are joined.  An occurrence fixes where the window
would begin; begin and end must lie inside the document (positional and length bounds), and what is
left is verified word for word.  Windows with a word that no document has are dropped at once.

The join happens where the document's words are: a task explodes positions, probes the index and
compares a slice of the words, all in one generated loop, while the index has at most ``BROADCAST``
windows.  A larger index is joined by shuffles instead, with the same result.

Edge cases: null texts have no words; items without words are never found; items that share a window are
all found by it; repeated items count once; items with a null id hit words but are in no list;
repeated rows each get their result; a row is known by its doc_id and a hash of its text, so
rows that share a doc_id but not the text are told apart; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, fresh, written

WINDOW, BROADCAST = 10, 200_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # words are digits, a-z and all that is not ASCII
_WORD_ANY_CASE = r"[0-9A-Za-z\x80-\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), _BETWEEN), "")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(window_id, ws, item_id): the distinct windows and the items they belong to."""
    starts = F.expr(f"sequence(0, greatest(0, size(w) - {window}))")
    each = benchmark.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0").select(
        "item_id", "w", F.explode(starts).alias("at")).select("item_id", F.expr(f"slice(w, at + 1, {window})").alias("ws"))
    return each.distinct().withColumn("window_id", F.sha2(F.array_join("ws", " "), 256))


def prefix_index(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(window_id, ws, token, offset): each window with its rarest word and that word's first place in it."""
    distinct = windows.select("window_id", "ws").distinct()
    placed = distinct.select("window_id", F.posexplode("ws").alias("offset", "token"))
    asked = placed.select("token").distinct()
    seen = docs.select(F.explode(words(F.col("text"))).alias("token")).join(_small(asked), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    by_rarity = placed.join(seen, "token", "left").groupBy("window_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest"))
    return distinct.join(by_rarity.filter("rarest.n > 0"), "window_id").select("window_id", "ws", "rarest.token", "rarest.offset")


def _small(side: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """A broadcast hint for a side that has been counted to be small."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def occurrences(docs: DataFrame, index: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """(doc_id, h, at, k, window_id): every place where a window stands, ``at`` from 0; h is the text's hash."""
    rows = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("words"))
    at = F.col("pos") - F.col("offset")
    inside = (at >= 0) & (at + F.size("ws") <= F.col("n_words"))
    probe = index.select("token", "offset", "ws", "window_id")
    if index.limit(limit + 1).count() <= limit:
        # outer: an inner explode would be given a filter that cuts every text into words twice more
        spread = rows.withColumn("n_words", F.size("words")).select("doc_id", "h", "words", "n_words", F.posexplode_outer("words").alias("pos", "word"))
        verified = F.slice("words", at + 1, F.size("ws")) == F.col("ws")
        met = spread.join(F.broadcast(probe), (F.col("word") == F.col("token")) & inside & verified)
        return met.select("doc_id", "h", at.alias("at"), F.size("ws").alias("k"), "window_id")
    spread = rows.select("doc_id", "h", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    met = spread.join(probe, (F.col("word") == F.col("token")) & inside).select("doc_id", "h", at.alias("at"), "window_id", "ws")
    again = rows.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "words")
    held = met.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    return held.filter(F.slice("words", F.col("at") + 1, F.size("ws")) == F.col("ws")).select("doc_id", "h", "at", F.size("ws").alias("k"), "window_id")


def found(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST) -> tuple[DataFrame, DataFrame]:
    """The distinct occurrences and the windows with their items, both as written tables."""
    windows = written(item_windows(benchmark, window))
    index = written(prefix_index(windows, docs))
    return written(occurrences(docs, index, limit).distinct()), windows


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    hits, windows = found(docs, benchmark, window, limit)
    own = Window.partitionBy("doc_id", "h").orderBy("at", "k")
    covered = F.coalesce(F.max(F.col("at") + F.col("k")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = hits.select("doc_id", "h", "at", "k").distinct().withColumn("covered", covered)
    n_hit = spans.groupBy("doc_id", "h").agg(F.sum(F.greatest(F.lit(0), F.col("at") + F.col("k") - F.greatest("at", "covered"))).cast("long").alias("n_hit"))
    named = hits.select("doc_id", "h", "window_id").distinct().join(windows.select("window_id", F.col("item_id").cast("string").alias("item")), "window_id")
    items = named.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_hit, items = (x.select(F.col("doc_id").alias(f"{c}_id"), F.col("h").alias(f"{c}_h"), x.columns[-1]) for c, x in (("n", n_hit), ("i", items)))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.regexp_count("text", F.lit(_WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    both = n_hit.join(items, F.col("n_id").eqNullSafe(F.col("i_id")) & (F.col("n_h") == F.col("i_h")), "left")
    out = rows.join(both, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("h") == F.col("n_h")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                      F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of any item."""
    hits, _ = found(docs, benchmark, window)
    own, id_, h = (fresh(docs, n) for n in ("own", "bad_id", "bad_h"))
    bad = hits.select(F.col("doc_id").alias(id_), F.col("h").alias(h)).distinct()
    marked = docs.withColumn(own, F.xxhash64("text"))
    return marked.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(h)), "left_anti").select(*docs.columns)


SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL
), q AS (
    SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), p AS (
    SELECT rid, s, k, array_to_string(w[s:s + k - 1], ' ') AS win
    FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)
), f AS (SELECT rid, s, p.k, item_id FROM p JOIN q ON p.win = q.win AND p.k = q.k
), h AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS pos FROM f) GROUP BY rid
), m AS (
    SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM f WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN m USING (rid)
"""
