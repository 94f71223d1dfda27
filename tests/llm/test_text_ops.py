"""Corpus operators over documents against brute force, with nulls, blanks, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from tidemark.llm import decontaminate, langid, mixing, simhash, suffix_lm, tokens, toxicity
from tidemark.plans.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n long, score string, ID string"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); extra columns clash with names the operators use."""
    return spark.createDataFrame([(i, t, lang, s, 0, 7, 8, "x", "y") for i, t, lang, s in rows], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def corpus(n=60, seed=3):
    rnd = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gämma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "Straße", "ñandú", "x1", "2nd"]
    rows = []
    for i in range(n):
        text = " ".join(rnd.choice(vocabulary) + rnd.choice(["", ",", "."]) for _ in range(rnd.choice([1, 3, 12, 40, 90])))
        rows.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None])))
    near = "one two three four five six seven eight nine ten " * 30
    rows += [(100 + k, near + f"tail{k}", "en", "a") for k in range(8)]
    rows += [(200, None, None, "a"), (201, "", "en", None), (202, " \t\n", "en", "b"), (None, near, "en", "b"), (0, rows[0][1], rows[0][2], rows[0][3])]
    rows += [(5, "another text under a used id", "en", "a"), (300, "long " * 30_000, "en", "b")]
    return rows


# ---------------------------------------------------------------- near-duplicates

def brute_fingerprint(text):
    import xxhash

    w = words(text)
    grams = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    count = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if grams and count[b] * 2 > len(grams))


def brute_components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("chunk", [2048, 3])
def test_simhash_matches_brute_force(spark, chunk):
    rows = corpus()
    fps = [brute_fingerprint(r[1]) for r in rows]
    group = brute_components(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted(((r[0] if r[0] is not None else -1), f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, group, strict=True))
    got = simhash.near_duplicates(docs(spark, rows), chunk=chunk).select("doc_id", simhash.hex_digits().alias("f"), "component_id").collect()
    assert sorted(((r[0] if r[0] is not None else -1), r[1], r[2]) for r in got) == want
    assert len(set(group)) < len(rows) - 8


def test_simhash_links_on_planted_fingerprints(spark):
    rnd = np.random.default_rng(5)
    centre = rnd.integers(0, 1 << 64, 12, dtype=np.uint64)
    fps = [int(c) for c in centre]
    for c in centre:
        for k in range(1, 12):  # chains and clouds at distances round the radius
            flips = rnd.choice(64, k % 6, replace=False)
            fps.append(int(c) ^ sum(1 << int(b) for b in flips))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    for chunk in (2048, 2):
        got = {r["node"]: r["component"] for r in components(simhash.links(frame, chunk=chunk)).collect()}
        group = brute_components(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
        members = {}
        for f, g in zip(signed, group, strict=True):
            members.setdefault(g, []).append(f)
        want = {f: min(m) for m in members.values() if len(m) > 1 for f in m}
        assert got == want


def test_pivot_tables_lose_no_pair():
    rnd = np.random.default_rng(1)
    fp = rnd.integers(0, 1 << 64, 40, dtype=np.uint64)
    fp = np.concatenate([fp, fp ^ np.uint64(0b1011), fp ^ (np.uint64(31) << np.uint64(50))])
    group = np.sort(rnd.integers(0, 3, len(fp)))
    rnd.shuffle(fp)
    a, b = simhash.near_pairs(fp, group, simhash.pivot_points(16), 4)
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if group[i] == group[j] and bin(int(fp[i] ^ fp[j])).count("1") <= 4}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_components_of_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(1000, 1000 + i) for i in range(1, 50)]
    frame = spark.createDataFrame([*chain, *hub, (5, 5), (7, None), (3, 2)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first_keeps_one_of_each_group(spark):
    rows = corpus()
    frame = docs(spark, rows)
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids))
    assert set(ids) == {r["component_id"] for r in simhash.near_duplicates(frame).collect()}


# ---------------------------------------------------------------- tokens

@pytest.fixture(scope="module")
def bpe():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts_match_the_library(spark, bpe):
    from tokenizers import Tokenizer

    rnd = random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", "é", "ß", "中", "😀", "12", "'s", "'ll", "!", "<|endoftext|>", "\u3000", "\x85", "\x1c", "aaaa", "the", "\r\n", "\xa0", "Ⅷ", "İ"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(400)] + [r[1] for r in corpus()] + ["a" * 5001, " " * 777]
    library = Tokenizer.from_file(bpe)
    frame = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: tuple(r)[1:] for r in tokens.count_tokens(frame, bpe).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512), t


def test_token_counts_with_a_full_table(bpe, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 5)
    texts = [r[1] for r in corpus()][:30]
    small = tokens.Counts(bpe)(texts)
    monkeypatch.setattr(tokens, "REMEMBER", 1 << 20)
    assert small == tokens.Counts(bpe)(texts)


# ---------------------------------------------------------------- toxicity

def toxic_rows(seed=11, n=400):
    rnd = random.Random(seed)
    clean = ["the", "morning", "river", "walks", "between", "trees", "and", "houses", "quiet", "people", "read", "papers"]
    bad = ["wretched", "numbskull", "vermin"]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(clean) for _ in range(rnd.randint(10, 40))]
        toxic = i % 4 == 0
        if toxic:
            for b in rnd.sample(bad, 2):
                w.insert(rnd.randrange(len(w)), b)
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_and_hidden_words(spark):
    rows, labels = toxic_rows()
    hidden = ["the river wr3tch3d and numb5kull walks", "quiet v e r m i n and n u m b s k u l l people", "read wretccched and verrrrmin papers", "the v.e.r.m.i.n and wr3tched river"]
    rows += [(1000 + k, t, "en", "s") for k, t in enumerate(hidden)]
    rows += [(2000, None, None, None), (2001, "", "en", "s"), (2002, "1234 !!", "en", "s"), (2003, "the morning 2020 river !! e.g. a b c people", "en", "s"), (0, rows[0][1], "en", "s")]
    frame = docs(spark, rows)
    known = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(frame, known).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(by_id[i]["predicted"] == t for i, _, t in labels)
    assert [by_id[1000 + k]["predicted"] for k in range(len(hidden))] == [1] * len(hidden)
    assert [by_id[2000 + k]["predicted"] for k in range(4)] == [0] * 4
    kept = toxicity.keep_clean(frame, known)
    assert kept.columns == frame.columns and kept.count() == sum(1 for r in got if not r["predicted"])


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows, _ = toxic_rows(n=5)
    assert {r["score"] for r in toxicity.classify(docs(spark, rows), none).collect()} == {0.0}
    assert toxicity.classify(docs(spark, []), none).count() == 0


def test_viterbi_finds_the_cheapest_reading():
    from itertools import product

    rnd = random.Random(4)
    cost = (np.random.default_rng(4).random((28, 28, 28)) * 3).tolist()

    def price(parts):
        text, total = "".join(p for p, _ in parts), sum(c for _, c in parts)
        a = b = 0
        for ch in text:
            z = toxicity.symbol(ch)
            if z or b:
                total += cost[a][b][z]
                a, b = b, z
        return total + (cost[a][b][0] if b else 0)

    for _ in range(60):
        lattice = [[(rnd.choice(["a", "b", "", " ", "cc", "é"]), rnd.random()) for _ in range(rnd.randint(1, 3))] for _ in range(rnd.randint(1, 6))]
        best = min(price(p) for p in product(*lattice))
        read = toxicity.decode(lattice, cost)
        assert any(abs(price(p) - best) < 1e-9 and "".join(x for x, _ in p) == read for p in product(*lattice))


def test_letters_are_counted_over_all_texts(spark):
    rows, labels = toxic_rows(n=40)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = docs(spark, rows + [(5000 + k, "zqx " * 50, None, None) for k in range(40)])  # no labels
    z, q, x = (toxicity.symbol(c) for c in "zqx")
    assert toxicity.fit(more, known).costs[z, q, x] < 0.1 < toxicity.fit(docs(spark, rows), known).costs[z, q, x]


def letter_costs(words):
    return toxicity.trigram_costs(toxicity.trigram_counts([" ".join(words)] * 50))


def test_long_stretches_are_read_whole(monkeypatch):
    words = ["moron", "scum", "people"]
    read = toxicity.Restorer(letter_costs(words))
    spaced = " ".join(" ".join(w) for w in words * 200)
    assert len(spaced) > 2000 and read(spaced).split() == words * 200
    joined = "_".join(["m0ron", "scum", "pe0ple"] * 200)
    assert len(joined) > 2000 and read(joined).split("_") == words * 200
    assert read("scu" + "m" * 5000) == "scum"
    with_long_run = read("a" + "_" * 200_000 + "b0")  # must not take quadratic time
    assert with_long_run.startswith("a")
    long = [toxicity._choices(c) if c != " " else [("", 0.7), (" ", 0.0)] for c in spaced]
    whole = toxicity.decode(long, read.cost)
    monkeypatch.setattr(toxicity, "SETTLE", 1)
    assert toxicity.decode(long, read.cost) == whole


def test_spaced_words_at_punctuation_and_wide_spaces():
    read = toxicity.Restorer(letter_costs(["moron", "scum", "people"]))
    for hidden, plain in (("m o r o n, people", "moron, people"), ("s c u m.", "scum."), ("(s c u m)", "(scum)"), ("m  o  r  o  n", "moron"), ("m\to\n r o n", "moron")):
        assert read(hidden) == plain


# ---------------------------------------------------------------- language

def test_language_of_held_out_texts(spark):
    rnd = random.Random(6)
    stems = {"en": ["the", "thing", "with", "house"], "de": ["der", "schön", "über", "haus"], "fr": ["le", "été", "chose", "où"]}
    rows = [(i, " ".join(rnd.choice(stems[lang]) for _ in range(rnd.randint(4, 30))), lang, "s") for i in range(300) for lang in [rnd.choice(list(stems))]]
    blank = [(900, None, "en", None), (901, "", "en", None), (902, "123 !? ...", "de", None), (903, "Der Haus über", None, None), (904, "the " * 40_000, "en", "s"), (0, rows[0][1], rows[0][2], "s")]
    frame = docs(spark, rows + blank)
    got = langid.identify(frame).collect()
    assert len(got) == len(rows) + len(blank)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == lang for i, _, lang, _ in rows)
    assert [by_id[900 + k]["lang_pred"] for k in range(5)] == ["und", "und", "und", "de", "en"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    kept = langid.keep_identified(frame)
    assert kept.columns == frame.columns and kept.count() == len(rows) + len(blank) - 3
    assert {r["lang_pred"] for r in langid.identify(docs(spark, [(1, "text", None, None)])).collect()} == {"und"}
    assert langid.identify(docs(spark, [])).count() == 0


def test_texts_stay_when_no_language_is_known(spark):
    rows = [(1, "some text", None, None), (2, "Ünd", None, None), (3, "12 !", None, None), (4, None, None, None), (5, "", None, None)]
    assert sorted(r["doc_id"] for r in langid.keep_identified(docs(spark, rows)).collect()) == [1, 2]


def test_language_cells_match_a_plain_count():
    got = Counter()
    texts = ["Ab c", None, "ñ"]
    for owner, cell in langid.grams(texts):
        got.update(zip(owner.tolist(), cell.tolist(), strict=True))
    assert sum(n for (o, _), n in got.items() if o == 0) == 3 + 5 + 3  # " ab c ": letters; pairs with a letter; triples round a letter
    assert sum(n for (o, _), n in got.items() if o == 1) == 0
    assert sum(n for (o, _), n in got.items() if o == 2) == 1 + 2 + 1


# ---------------------------------------------------------------- decontamination

def brute_hits(text, items):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        q = cut(t)
        for s in range(max(1, len(q) - 9)) if q else ():
            win = q[s:s + 10]
            for p in range(len(w) - len(win) + 1):
                if w[p:p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(item)
    ids = sorted(str(i) for i in found if i is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination_matches_brute_force(spark, limit):
    rnd = random.Random(8)
    vocabulary = ["common", "common", "common", "Für", "été", "rare1", "rare2", "x", "y", "ÄRGER"] + [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 4, 10, 11, 25])))) for k in range(12)]
    items += [(50, None), (51, "... !!"), (52, items[4][1]), (None, "null item words here"), (3, items[3][1]), (53, "common common common")]
    rows = []
    for i in range(50):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))]
        if i % 2:
            q = (items[i % 12][1] or "").split()
            w[len(w) // 2:len(w) // 2] = q[:rnd.choice([len(q), 10, 9])] * rnd.choice([1, 2])
        rows.append((i, rnd.choice([", ", " ", "-"]).join(w).replace("x", "X"), "en", "s"))
    rows += [(90, None, None, None), (91, "", None, None), (None, "common null item words here", None, None), (1, rows[1][1], None, None), (1, "other text", None, None)]
    frame, bench = docs(spark, rows), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n long")
    got = decontaminate.judge(frame, bench, limit=limit).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], *brute_hits(r[1], items)) for r in rows), key=key)
    kept = decontaminate.keep_clean(frame, bench)
    assert kept.columns == frame.columns and kept.count() == sum(1 for r in got if not r["contaminated"])
    assert decontaminate.judge(docs(spark, []), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.judge(frame, bench.limit(0)).collect())


# ---------------------------------------------------------------- mixing

def brute_targets(sizes, weights, total):
    """sizes by source in order; targets by plain water-filling."""
    cap = [2 * s for s in sizes]
    open_ = set(range(len(sizes)))
    target = [0.0] * len(sizes)
    while open_:
        left = total - sum(cap[k] for k in range(len(sizes)) if k not in open_)
        level = left / sum(weights[k] for k in open_)
        over = {k for k in open_ if level * weights[k] > cap[k]}
        if not over:
            for k in open_:
                target[k] = level * weights[k]
            break
        open_ -= over
        for k in over:
            target[k] = float(cap[k])
    return target


def test_mix_meets_targets(spark):
    rnd = random.Random(9)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 30, 200]), "en", rnd.choice(["a", "a", "a", "a", "b", "ä", "z", "", None])) for i in range(400)]
    rows += [(1000, None, None, "a"), (1001, "one", None, "solo"), (5, rows[5][1], None, rows[5][3]), (1002, "", None, "nothing"), (None, "no id here", None, "b")]
    frame = docs(spark, rows)
    got = mixing.mix(frame).collect()
    again = mixing.mix(frame.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    by_source = {}
    for _, t, _, s in rows:
        by_source[s] = by_source.get(s, 0) + len(words(t))
    order = sorted([s for s in by_source if s is not None], key=lambda s: s.encode()) + [None]
    target = dict(zip(order, brute_targets([by_source[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(by_source.values())), strict=True))
    source_of = {i: s for i, _, _, s in rows}
    source_of[None] = "b"
    taken = Counter()
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == by_source[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.mix(docs(spark, [(1, None, None, None)])).collect()] == [(1, 0, 0, 0.0, 0)]


def test_mix_of_many_sources_in_ranges(spark):
    rows = [(i, "w " * (i % 7), None, f"s{i % 150:03d}") for i in range(600)]
    got = mixing.mix(docs(spark, rows)).collect()
    sizes = Counter()
    for i, t, _, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes)
    target = dict(zip(order, brute_targets([sizes[s] for s in order], [(3, 1, 2)[k % 3] for k in range(150)], 1.5 * sum(sizes.values())), strict=True))
    taken = Counter()
    for r in got:
        taken[f"s{r['doc_id'] % 150:03d}"] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)


# ---------------------------------------------------------------- suffix tree

def brute_tree(texts):
    """The same tree from plain dictionaries over byte strings; contexts nearest symbol last."""
    counts = Counter()
    for t in texts:
        seq = [suffix_lm.END] * suffix_lm.DEPTH + list(t) + [suffix_lm.END]
        for p in range(suffix_lm.DEPTH, len(seq)):
            for d in range(suffix_lm.DEPTH + 1):
                counts[tuple(seq[p - d:p]), seq[p]] += 1
    by_context = {}
    for (c, s), n in counts.items():
        by_context.setdefault(c, {})[s] = n
    total = sum(by_context.get((), {}).values())
    k = suffix_lm.CLASSES
    states = {(): [(by_context.get((), {}).get(s, 0) + 0.5) / (total + 0.5 * k) for s in range(k)]}
    for d in range(1, suffix_lm.DEPTH + 1):
        for c in [c for c in by_context if len(c) == d]:
            own = by_context[c]
            n = sum(own.values())
            up = next(states[c[i:]] for i in range(1, d + 1) if c[i:] in states)
            kl = sum(m / n * math.log(m / n / up[s]) for s, m in own.items())
            if n >= suffix_lm.LEAST * total and n * kl >= suffix_lm.DIVERGENCE:
                states[c] = [(own.get(s, 0) + suffix_lm.PRIOR * up[s]) / (n + suffix_lm.PRIOR) for s in range(k)]
    return states


def test_suffix_tree_and_base_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_lm, "HEAD", 4)  # most words take the shuffled way
    rows = corpus(80)
    train = [t for i, t, _, _ in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in words(t))
    n_all, v = sum(c.values()) + len(train), len(c) + 1
    flat = Counter(b for t in train for b in " ".join(words(t)).encode())
    order = sorted(range(256), key=lambda b: (-flat[b], b))
    classes = {b: min(k, suffix_lm.OTHER) for k, b in enumerate(order)}
    rest = order[suffix_lm.OTHER:]
    in_class = {b: math.log10((flat[b] + 0.5) / (sum(flat[x] for x in rest) + 0.5 * len(rest))) for b in rest}
    states = brute_tree([[classes[b] for b in " ".join(words(t)).encode()] for t in train])
    assert len(states) > 20
    got = {}
    for r in suffix_lm.score_documents(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t, _, _ in rows:
        w = words(t)
        base = sum(math.log10((c[x] + 0.1) / (n_all + 0.1 * (v + 1))) for x in w) + math.log10((len(train) + 0.1) / (n_all + 0.1 * (v + 1)))
        raw = " ".join(w).encode()
        seq = [suffix_lm.END] * 4 + [classes[b] for b in raw] + [suffix_lm.END]
        lm = sum(in_class.get(b, 0.0) for b in raw)
        for p in range(4, len(seq)):
            lm += math.log10(next(states[tuple(seq[p - d:p])] for d in range(4, -1, -1) if tuple(seq[p - d:p]) in states)[seq[p]])
        want = (i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n_all)
        near = [r for r in got[i] if (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want
                and abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and abs(r["score"] - lm) < 1e-6 * max(1, abs(lm))]
        assert near, (i, want, base, lm, got[i])


def test_suffix_tree_without_training_texts(spark):
    assert suffix_lm.score_documents(docs(spark, [])).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = suffix_lm.score_documents(docs(spark, [(held, "some text", None, None)])).first()
    assert (row["n_known"], row["train_tokens"], row["base_score"]) == (0, 0, 0.0) and row["score"] < 0


def test_symbol_probabilities_sum_to_one():
    rnd = np.random.default_rng(3)
    joined = [bytes(rnd.integers(97, 105, 400).astype(np.uint8)) for _ in range(20)]
    classes, own = suffix_lm.byte_classes(np.bincount(np.frombuffer(b"".join(joined), np.uint8), minlength=256).astype(float))
    flat, at, _ = suffix_lm.symbols(joined, classes)
    keys = ((suffix_lm.contexts(flat, at).astype(np.int64) << 6) | flat[at])
    codes, counts = zip(*(np.unique(keys % (1 << 6 * (d + 1)), return_counts=True) for d in range(5)), strict=True)
    tree = suffix_lm.grow(list(codes), list(counts), classes, own)
    assert np.allclose((10 ** tree.log_p).sum(axis=1), 1)
    assert np.isclose((10 ** own[classes == suffix_lm.OTHER]).sum(), 1)
    assert all(a.size >= 0 for a in tree.contexts) and all(x < y for x, y in pairwise(tree.contexts[1].tolist()))


def test_suffix_tree_keeps_a_context_of_any_share(spark):
    """30 occurrences in over 6 million positions, less than a share of 5e-6, each followed by the same rare symbol."""
    rows = [(k, "ab " * 340_000, None, None) for k in range(6)] + [(6, "qz " * 30, None, None)]
    tree = suffix_lm.learn(docs(spark, rows))
    assert int(tree.classes[ord("q")]) in tree.contexts[1].tolist()
    assert np.allclose((10 ** tree.log_p.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_language_posterior_by_hand(spark):
    """Cells, probabilities, tempering and prior worked out n-gram by n-gram in Python's integers."""
    rows = [(1, "ab ba", "x"), (2, "abc abc", "x"), (3, "zz top", "y"), (5, "Top z", "y"), (6, "été", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)

    def cells(text):
        c = [ord(x) if x.isalpha() else 32 for x in " " + text.lower() + " "]
        keys = []
        for i in range(1, len(c)):
            here, before, after = c[i], c[i - 1], c[i + 1] if i + 1 < len(c) else 32
            if here != 32:
                keys += [here * 31, before * 2246822519 + here * 3266489917 + after * 668265263 + 13]
            if here != 32 or before != 32:
                keys.append(before * 65599 + here * 257 + 7)
        return [(((k % 2 ** 32) ^ ((k % 2 ** 32) >> 15)) * 2654435761 % 2 ** 32) >> 17 for k in keys]

    counts = {"x": {}, "y": {}}
    for _, text, lang in rows:
        for cell in cells(text):
            counts[lang][cell] = counts[lang].get(cell, 0) + 1
    size = {k: sum(v.values()) for k, v in counts.items()}
    for text in ("ab", "top", "zab", "été abc " * 200):
        own = cells(text)
        post = {}
        for lang, prior in (("x", 2 / 5), ("y", 3 / 5)):
            logs = [math.log((counts[lang].get(k, 0) + langid.SMOOTH) / (size[lang] + langid.SMOOTH * langid.BUCKETS)) for k in own]
            post[lang] = sum(logs) / len(logs) * min(len(logs), langid.EVIDENCE) + math.log(prior)
        top = max(post.values())
        want = {k: math.exp(v - top) / sum(math.exp(w - top) for w in post.values()) for k, v in post.items()}
        lang, p = model.predict([text])
        assert lang[0] == max(want, key=want.get) and abs(p[0] - want[lang[0]]) < 1e-9
    tie = langid.Model(["a", "b"], np.zeros((2, langid.BUCKETS)), np.zeros(2))
    assert tie.predict(["word"]) == (["a"], [0.5])
