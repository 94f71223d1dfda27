"""Personal data: the base against the patterns as they are written, what the trees add, and the table of results."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from tidemark.llm import pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def check(kind, span):
    digits = [int(c) for c in span if c.isdigit()]
    if kind == 1:
        return all(int(p) <= 255 for p in span.split("."))
    if kind == 2:
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == 0 or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if check(k, m[0])]


def card(rnd):
    digits = [rnd.randint(1, 9) for _ in range(15)]
    return next(t for t in ("".join(map(str, digits)) + str(x) for x in range(10)) if pii.luhn(t))


def datum(rnd):
    return rnd.choice([
        lambda: f"user.{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.example.com", lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)),
        lambda: card(rnd), lambda: re.sub(r"(....)(?=.)", r"\1 ", card(rnd)),
        lambda: f"+{rnd.randint(1, 49)} ({rnd.randint(100, 999)}) 555-{rnd.randint(1000, 9999)}"])()


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghilmnorstué") for _ in range(rnd.randint(1, 9))) for _ in range(n))


def test_base_is_the_patterns():
    rnd = random.Random(4)
    for _ in range(20000):
        text = "".join(rnd.choice("aZ@..-+ ()0129\n%é ") for _ in range(rnd.randint(0, 24)))
        assert pii.base_spans(text) == brute(text), text
    for _ in range(4000):
        text = "".join(rnd.choice([datum(rnd), card(rnd), " ", "-", ".", "1", "+", "@", "a.b", ", x ", "é", "\n"]) for _ in range(rnd.randint(0, 9)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["1" * 400_000, "a" * 400_000, "a@" * 200_000, "1." * 200_000, "+1 " * 150_000, "1 " * 200_000, "@a." * 150_000, " at a" * 100_000, "(1) " * 100_000])
def test_long_runs_take_linear_time(text):
    start = time.perf_counter()
    pii.base_spans(text)
    found = pii.candidates(text)
    assert time.perf_counter() - start < 15 and len(found) <= 8 * len(text)


def corpus(seed, n=700):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        parts = [words(rnd, rnd.randint(3, 20))]
        for _ in range(rnd.randint(0, 2)):
            parts += [datum(rnd), words(rnd, rnd.randint(2, 15)) + rnd.choice([".", ",", "\n", ""])]
        if i % 5 == 0:  # numbers that are nobody's
            parts += [rnd.choice([str(rnd.randint(10 ** 9, 10 ** 11)), "256.300.1.999", "4111111111111112", f"{rnd.randint(1900, 2030)}-01-02 10:20", "1.2.3"]), words(rnd, 5)]
        rows.append((i, " ".join(parts)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", "k", 3) for i, t in rows], "doc_id long, text string, base string, kind string, spans int")


def test_spans_of_a_table(spark):
    rnd = random.Random(8)
    a, b, phone, ip = card(rnd), card(rnd), "+1 (663) 555-6869", "10.20.30.40"
    planted = {
        5000: (f"so {a} {b} it goes", [(2, 3, 19), (2, 20, 36)]), 5001: (f"call {phone} {ip} now", [(1, 23, 34), (3, 5, 22)]),
        5002: ("write to anna.lee [at] post [dot] example [dot] org today", [(0, 9, 51)]),
        5003: ("nothing to see at home. we met at ten, look at node.js and version 1.2 of 2024 and 12345678 things", []),
        5004: ("", []), 5005: (None, []), 5006: ("x" * 100_000, []), 5007: (f"é名 a@b.c-d.e@f.g {a}", None),
    }
    rows = corpus(1) + [(i, t) for i, (t, _) in planted.items()] + [(None, f"x {a}"), (5000, planted[5000][0])]
    got = pii.digest(pii.find(frame(spark, rows), sample=400))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = got.collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in rows:
        base, r = brute(t or ""), by_id[i]
        counts = [sum(k == kind for kind, _, _ in base) for k in range(4)]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
        assert r["base_sha256"] == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(pii.listed(base).split(",") if base else []) <= set(spans)
        if i is not None and i < 5000:
            assert len(spans) == len(base)  # nothing is added to ordinary texts
    for i, (_, want) in planted.items():
        if want is not None:
            assert by_id[i]["spans"] == pii.listed(want), i
    again = pii.digest(pii.find(frame(spark, rows).repartition(5), sample=400)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_without_examples(spark):
    assert pii.find(frame(spark, [])).count() == 0
    got = pii.digest(pii.find(frame(spark, [(1, "a b"), (2, None)]))).collect()
    assert [(r["n_card"], r["spans"], r["base_sha256"]) for r in got] == [(0, "", hashlib.sha256(b"").hexdigest())] * 2


def test_trees_and_thresholds():
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((3000, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(int)
    trees = pii.fit_trees(x[:2000], y[:2000])
    score = trees.scores(x[2000:])
    assert ((score >= 0.5) == y[2000:]).mean() > 0.97
    one = pii.fit_trees(x[:2000], y[:2000], rounds=1, depth=1, rate=1.0, bins=8)  # the best single cut, by trying all
    edges = {f: np.unique(np.quantile(x[:2000, f], np.linspace(0, 1, 8)[1:-1], method="lower")) for f in range(5)}
    p = y[:2000].mean()
    g, h = y[:2000] - p, np.full(2000, p * (1 - p))
    gain = {(f, c): sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (x[:2000, f] <= c, x[:2000, f] > c)) for f in edges for c in edges[f]}
    best = max(gain, key=gain.get)
    assert (one.feature[0][0], one.cut[0][0]) == best
    assert pii.threshold(np.array([0.9, 0.8, 0.7, 0.6]), np.array([1, 1, 0, 1]), 0.75) == 0.5
    assert pii.threshold(np.array([0.9, 0.9, 0.7]), np.array([1, 0, 0]), 0.9) == 2.0
    assert pii.threshold(np.array([0.9, 0.8, 0.7]), np.array([1, 1, 0]), 0.9) == 0.75


def test_selection_takes_no_overlap():
    base = [(1, 10, 20), (3, 15, 30)]
    found = [(0.9, (2, 28, 40)), (0.8, (2, 30, 40)), (0.95, (2, 39, 45)), (0.7, (0, 0, 10)), (0.2, (0, 50, 60)), (0.9, (3, 12, 14))]
    assert pii.selected(base, found, [0.5] * 4) == [(0, 0, 10), (1, 10, 20), (2, 39, 45), (3, 15, 30)]


def test_every_candidate_is_fitted_on(spark, monkeypatch):
    """More candidates of a kind than once were sampled; held in one process or spread over tasks, the spans are the same."""
    rnd = random.Random(3)
    docs = frame(spark, corpus(4, 300) + [(1000 + i, f"call +{i % 90 + 10} {5550000 + i} or {rnd.choice(['now', 'then'])} 2024-05-{i % 28 + 1:02d} 1{i:04d} {i}") for i in range(2600)])
    found = pii.found_in(docs)
    own = {tuple(r) for r in found.select("kind", "base").collect()}
    assert found.filter("kind = 3 and base").count() > 2600 and (3, False) in own
    facts = pii.facts_of(found)
    assert facts.filter("kind = 3 and label = 1").agg({"n": "sum"}).first()[0] > 2 * 2600  # as written and in another notation
    held = pii.learn(found)
    monkeypatch.setattr(pii, "HELD", 0)
    monkeypatch.setattr(pii, "ROUNDS", 9)  # beyond one rewrite of the margins
    monkeypatch.setattr(pii.fit_spread, "__defaults__", (9, *pii.fit_spread.__defaults__[1:]))
    monkeypatch.setattr(pii, "fit_trees", lambda *a, real=pii.fit_trees, **k: real(*a, rounds=9, **k))
    spread = pii.learn(found)
    assert len(spread.trees.leaf) == 9 and len(held.trees.leaf) == 80
    for a, b in zip(spread.trees.feature, held.trees.feature):
        assert a.tolist() == b.tolist()
    for a, b in zip(spread.trees.leaf, held.trees.leaf):
        assert np.allclose(a, b)
    monkeypatch.setattr(pii, "HELD", 1 << 18)
    assert np.allclose(pii.learn(found).cuts, spread.cuts)
