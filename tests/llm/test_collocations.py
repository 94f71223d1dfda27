"""Phrase collocations against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, best, share=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 6):
                    if i + k <= len(w):
                        f[lang, tuple(w[i:i + k])] += 1
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = []
    for (lang, p), a in found.items():
        inside = any(l == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (l, q), b in found.items())
        if inside:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranked, at = [], Counter()
    for x in out:
        at[x[0]] += 1
        if at[x[0]] <= best:
            ranked.append((x[0], at[x[0]], *x[1:]))
    return ranked


def texts(seed, n=120):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "été", "a\x01", "a", "b", "ß", "名", "x'y", "1", "|"]
    rows = []
    for _ in range(n):
        parts = [rnd.choice(words) if rnd.random() < 0.6 else rnd.choice(["new york city", "new york", "a b a b", "of the"]) for _ in range(rnd.randint(0, 40))]
        rows.append(("".join(p + rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for p in parts), rnd.choice(["en", "de", None, "und"])))
    rows += [(None, "en"), ("", "en"), (" \t ", "en"), ("...", None), rows[0], rows[0]]
    rows.append((" ".join(["the"] * 3000 + ["of the"] * 2000), "en"))  # one hot phrase, a long text without a break
    rows.append((". ".join(["so it goes on and on"] * 1500), "de"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(t, g, 1, "p", 2) for t, g in rows], "text string, lang string, rank int, phrase string, n int")


@pytest.mark.parametrize("least,best,share,budget,stretch", [(4, 2000, 100, 1 << 20, 1 << 22), (3, 7, 100, 5, 300), (300, 50, 80, 2, 1000)])
def test_collocations(spark, least, best, share, budget, stretch):
    rows = texts(least)
    got = collocations.mine(frame(spark, rows), least=least, best=best, share=share, budget=budget, stretch=stretch)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, least, best, share))


def test_pruning_loses_nothing(spark):
    rows = texts(9)
    few = collocations.frequent_cells(frame(spark, rows).select("lang", "text"), 5, 4)  # 16 cells: nearly all are shared
    assert few.any()
    wide = collocations.frequent_cells(frame(spark, rows).select("lang", "text"), 300, 20)
    assert 0 < wide.sum() < 100


def test_groups_hold_whole_prefixes_within_the_budget(spark):
    rnd = np.random.default_rng(2)
    suffixes = sorted({" ".join("abcd"[i] for i in rnd.integers(0, 4, rnd.integers(2, 6))) for _ in range(900)})
    rows = spark.createDataFrame([("en", s, 1) for s in suffixes], "lang string, suffix string, total long")
    dealt, top = collocations.grouped(rows, 40, 5)
    placed = dealt.collect()
    assert len(placed) == len(suffixes)
    size = Counter(r["group"] for r in placed)
    assert len(size) > 5 and max(size.values()) <= 80
    tree = {(r["phrase"], r["f"]) for r in collocations.nodes(dealt, top, 1, 5).collect()}
    assert 4 <= top.count() < len(suffixes) / 40
    want = Counter(" ".join(s.split()[:k]) for s in suffixes for k in range(2, len(s.split()) + 1))
    assert tree == set(want.items())


def test_large_numbers_are_exact(spark):
    a, n = 3_000_000_001, 9_000_000_000_000_007
    row = spark.sql(f"select cast({a} as decimal(19,0)) a, cast({n} as decimal(19,0)) n").selectExpr(
        "cast(a * n * cast(1000 as decimal(4,0)) as decimal(38,0)) div cast(a * a as decimal(38,0)) as s").first()
    assert row["s"] == 1000 * n * a // (a * a)


def test_empty(spark):
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, [(None, None), ("a b", "en")])).count() == 0
