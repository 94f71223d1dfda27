"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lowered and everything but letters becomes a space.  N-grams of one to three characters that
hold a letter are hashed into ``BUCKETS`` cells.  Fitting sums cells per language over a sample of
labelled rows of at most about ``PER_LANG`` documents a language, chosen by a hash of id and text; the
matrix of log probabilities (languages x BUCKETS) is broadcast and batches are scored with numpy.

Edge cases: a null text or one without a letter is ``und`` with score 0, and so is every text when no
language could be learned; a null language is not learned from; repeated rows and very long texts
are scored as they are, whole; of equally likely languages the first by name is predicted; an empty table gives no rows; columns
of the names used here are ignored.  More than ``MAX_LANGS`` languages is an error, which bounds the matrix.

The evidence of a text is tempered: its mean log probability per n-gram counts as that of at most ``EVIDENCE`` n-grams, as those of one
text are far from independent.  Which language comes first changes only through the prior's weight; the score of a long
text stays below what independence would give.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, code_points, fresh, held_out, letters, slices

BUCKETS, SMOOTH, PER_LANG, MAX_LANGS = 1 << 15, 0.5, 3000, 500
# N-grams of one text are far from independent: evidence counts as that of at most so many of them.
EVIDENCE = 200
UNKNOWN = "und"
_MIX = np.uint32(2654435761)


def grams(texts: list[str | None], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the owners (positions in ``texts``) and cells of all n-grams that hold a letter in their middle."""
    low = [(t or "").lower() for t in texts]
    codes = code_points(" " + "".join(f"{t} " for t in low) + " ")
    owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    known = letters()[codes]
    c = np.where(known, codes, np.uint32(32))
    before, here, after, is_letter = c[:-2], c[1:-1], c[2:], known[1:-1]
    shift = np.uint32(32 - (buckets.bit_length() - 1))

    def cells(key: np.ndarray) -> np.ndarray:
        return ((key ^ (key >> np.uint32(15))) * _MIX) >> shift

    yield owner[is_letter], cells(here[is_letter] * np.uint32(31))
    either = is_letter | known[:-2]
    yield owner[either], cells(before[either] * np.uint32(65599) + here[either] * np.uint32(257) + np.uint32(7))
    yield owner[is_letter], cells(before[is_letter] * np.uint32(2246822519) + here[is_letter] * np.uint32(3266489917)
                                  + after[is_letter] * np.uint32(668265263) + np.uint32(13))


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # languages x BUCKETS
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        total = np.zeros((len(self.langs), len(texts)))
        n = np.zeros(len(texts))
        for owner, cell in grams(texts):
            n += np.bincount(owner, minlength=len(texts))
            for k in range(len(self.langs)):
                total[k] += np.bincount(owner, weights=self.log_p[k][cell], minlength=len(texts))
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        post = total / np.maximum(n, 1) * np.minimum(n, EVIDENCE) + self.prior[:, None]
        post = np.exp(post - post.max(axis=0))
        post /= post.sum(axis=0)
        best = post.argmax(axis=0)
        blank = n == 0
        return ([UNKNOWN if blank[i] else self.langs[b] for i, b in enumerate(best)],
                [0.0 if blank[i] else float(post[b, i]) for i, b in enumerate(best)])


def training_sample(docs: DataFrame, sizes: dict[str, int], per_lang: int) -> DataFrame:
    """About ``per_lang`` rows of each language: those whose hash falls below the language's share."""
    rates = [(k, min(1.0, per_lang / n)) for k, n in sizes.items()]  # at most MAX_LANGS
    rate = docs.sparkSession.createDataFrame(rates, "lang string, rate double")
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return docs.filter("text is not null").join(F.broadcast(rate), "lang").filter(draw < F.col("rate")).select("lang", "text")


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learn from the given rows with a language; ``docs`` has doc_id, text, lang."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches):
            lang = np.array(part.column("lang").to_pylist(), object)
            texts = part.column("text").to_pylist()
            names = sorted(set(lang))
            index = np.searchsorted(names, lang)
            for owner, cell in grams(texts):
                both = np.bincount(index[owner] * BUCKETS + cell, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + both[k]
        for name, sum_ in sums.items():
            cell = np.flatnonzero(sum_)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(sum_[cell])],
                                             names=["lang", "cell", "n"])

    bounded_batches(docs.sparkSession)
    sizes = {r["lang"]: r["n"] for r in docs.filter("lang is not null and text is not null").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    summed = training_sample(docs, sizes, per_lang).mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(langs), BUCKETS))
    got = summed.toArrow()  # at most languages x BUCKETS rows
    at = {name: k for k, name in enumerate(langs)}
    counts[[at[x] for x in got["lang"].to_pylist()], got["cell"].to_numpy()] = got["n"].to_numpy()
    log_p = np.log(counts + SMOOTH) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    share = np.array([sizes[x] for x in langs], float)
    return Model(langs, log_p, np.log(share / share.sum()) if langs else share)


def predict(docs: DataFrame, model: Model, keep: list[str], lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The ``keep`` columns of every row with the language predicted and its score; ``docs`` has text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, lang_pred, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lang, p = shared.value.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.array(lang, pa.string()), pa.array(p, pa.float64())], names=names)

    bounded_batches(docs.sparkSession)
    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from rows that are not held out."""
    out = held_out("doc_id", 4, 2)
    model = fit(docs.filter(~out).select("doc_id", "text", "lang"))
    scored = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told, or, when none could be learned, that could have one: null texts and texts without a letter go."""
    model = fit(docs.filter(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"))
    if not model.langs:  # no language known: any text with a letter stays
        model = Model(["any"], np.zeros((1, BUCKETS)), np.zeros(1))
    told = fresh(docs, "lang_pred")
    return predict(docs, model, docs.columns, told, fresh(docs, "score")).filter(F.col(told) != UNKNOWN).select(*docs.columns)
