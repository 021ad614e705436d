"""Spelling variants, resampling and SetSketch near-duplicates against brute force; with nulls, empty tables, ties, repeats, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.llm import queries, resample, setsketch, simhash, variants
from signalmill.llm.words import words

ODD = [None, "", " \n\t ", "é👍 ½ ١٢", "x" * 40_000, "the of and " * 6_000, "one two three", "One  two\tthree"]


def frame(spark, texts, ids=None):
    """Clashing and extra columns beside the text."""
    data = [(k if ids is None else ids[k], t, 7, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, n int, weight string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- spelling variants ---


def brute_counts(docs, noise=199):
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % noise == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(docs, noise=199):
    v = brute_counts(docs, noise)
    near, form = defaultdict(set), {}
    for a in v:
        near[a] = {b for b in v if one_edit(a, b)}
        best = min(near[a], key=lambda x: (-v[x], x), default=None)
        if best is not None and v[best] >= 5 * v[a]:
            form[a] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), v[w], len(near[w]), v[form[w]] if w in form else None) for w in v), key=repr)


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    stems = ["aaaaaa", "aaaaaab", "ababab", "bababa", "straße", "ÀÉîõü×÷", "colour", "color", "colours", "banana", "bandana", "bananas", "x" * 3_000, "x" * 3_001]
    texts = []
    for _ in range(120):
        some = []
        for _ in range(60):
            w = list(rng.choice(stems))
            if rng.random() < 0.25:
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["q"], [w[at], "é"]])
            some.append("".join(w).upper() if rng.random() < 0.2 else "".join(w))
        texts.append(rng.choice(" ,-\n").join(some))
    docs = list(enumerate([*texts, *ODD]))
    docs += [docs[0], docs[0], (None, texts[1])]
    got = rows_of(variants.spelling_variants(frame(spark, [t for _, t in docs], [i for i, _ in docs])))
    assert got == brute_variants(docs)
    assert any(r[1] for r in got)


def test_variants_chain_and_tie(spark):
    counts = {"walking": 125, "walkink": 25, "walkinks": 5, "talking": 125, "balking": 25}
    docs = [(0, " ".join(w for w, n in counts.items() for _ in range(n)))]
    rows = {r["word"]: r for r in variants.spelling_variants(frame(spark, [docs[0][1]]), noise=10**9).collect()}
    assert rows["walkinks"]["form"] == "walkink" and rows["walkinks"]["root"] == "walking"
    assert rows["balking"]["form"] == "talking" and rows["balking"]["form_n"] == 125 and rows["balking"]["n_near"] == 2
    assert rows["walking"]["form"] is None and rows["walking"]["root"] == "walking"


def test_variants_split_postings(spark, monkeypatch):
    """Postings of more words than a task compares meet over salts."""
    monkeypatch.setattr(variants, "POSTING", 2)
    rng = random.Random(6)
    docs = [(k, " ".join("common" + rng.choice("abcdefgh") + rng.choice("abcdefgh") for _ in range(400))) for k in range(6)]
    assert rows_of(variants.spelling_variants(frame(spark, [t for _, t in docs]))) == brute_variants(docs)


def test_variants_prefixes_meet(spark):
    """Whatever the edit, two words share one of the kept bigrams at places that the join looks at."""
    rng = random.Random(7)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abAàé".lower()) for _ in range(rng.randrange(6, 12)))
        at = rng.randrange(len(a))
        b = rng.choice([a[:at] + "c" + a[at:], a[:at] + "c" + a[at + 1 :], a[:at] + a[at] + a[at:]])
        pairs.append((a, b))
    vocabulary = sorted({w for p in pairs for w in p})
    df = spark.createDataFrame([(w, 5) for w in vocabulary], "word string, n long")
    got = {(r["a"], r["b"]) for r in variants.near_words(df).collect()}
    assert {tuple(sorted(p)) for p in got} == {(a, b) for a in vocabulary for b in vocabulary if a < b and one_edit(a, b)}


def test_variants_of_nothing(spark):
    assert variants.spelling_variants(frame(spark, [])).collect() == []
    assert variants.spelling_variants(frame(spark, ODD[:3])).columns == ["word", "form", "root", "n", "n_near", "form_n"]


# --- resampling ---


def features(text):
    w = words(text)
    return len(w), [b" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, percent=5):
    s, t, per = Counter(), Counter(), []
    for i, text in docs:
        n, f = features(text)
        b = [zlib.crc32(x) % 10_000 for x in f]
        s.update(b)
        per.append((i, n, b))
    for text in target:
        t.update(zlib.crc32(x) % 10_000 for x in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    out = []
    for i, n, b in per:
        weight = sum(gain[x] for x in b)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for rank, o in enumerate(fit[: percent * len(fit) // 100], 1):
        o[4] = rank
    return sorted((tuple(o[:5]) for o in out), key=repr)


def some_texts(rng, n):
    vocabulary = ["w%d" % k for k in range(300)] + ["É%d" % k for k in range(20)] + ["long" * 30, "Mixed-Case", "a.b"]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 19, 20, 60, 400]))) for _ in range(n)]


def test_resample_equals_brute_force(spark):
    rng = random.Random(8)
    docs = list(enumerate([*some_texts(rng, 200), *ODD]))
    docs += [docs[0], docs[0], (None, docs[3][1])]
    target = [*some_texts(rng, 9), None, ""]
    got = rows_of(resample.resample(frame(spark, [t for _, t in docs], [i for i, _ in docs]), frame(spark, target)))
    assert got == brute_resample(docs, target)


def test_resample_in_many_chunks(spark, monkeypatch):
    """Chunks of a few documents, texts counted some words at a time, buckets dealt over salts."""
    monkeypatch.setattr(resample, "GROUP_ROWS", 3)
    rng = random.Random(9)
    docs = list(enumerate(some_texts(rng, 60)))
    parts = [docs[k::7] for k in range(7)]
    df = frame(spark, [t for p in parts for _, t in p], [i for p in parts for i, _ in p]).repartition(7, "doc_id")
    assert rows_of(resample.resample(df, frame(spark, [docs[1][1]]))) == brute_resample(docs, [docs[1][1]])


def test_chunks_count_whole_texts(monkeypatch):
    monkeypatch.setattr(resample, "RUN_WORDS", 7)
    rng = random.Random(10)
    texts = [*some_texts(rng, 30), "z " * 5_000, None]
    chunk = resample._Chunk()
    for k, t in enumerate(texts):
        chunk.add(k, t)
    held = chunk.rows(0).to_pylist()
    assert held[0]["words"] == [features(t)[0] for t in texts] and held[0]["features"] == [len(features(t)[1]) for t in texts]
    got = Counter()
    for r in held[1:]:
        for d, n in zip(*(x.tolist() for x in resample._unpacked(r["data"], r["postings"]))):
            got[r["bucket"], d] += n
    assert got == Counter((zlib.crc32(f) % 10_000, d) for d, t in enumerate(texts) for f in features(t)[1])
    assert all(r["n"] == sum(n for (b, _), n in got.items() if b == r["bucket"]) for r in held[1:])


def test_postings_of_wide_numbers():
    gaps, counts = np.array([3, 70_000, 1]), np.array([1, 2, 1 << 33])
    doc, n = resample._unpacked(resample._packed(gaps, counts), 3)
    assert doc.tolist() == [3, 70_003, 70_004] and n.tolist() == counts.tolist()


def test_resample_ties_and_nothing(spark):
    """Equal scores go to the smaller doc_id; rows that repeat are drawn each."""
    text = " ".join(["word"] * 20)
    docs = [(7, text)] * 25 + [(3, text)] * 15
    got = resample.resample(frame(spark, [t for _, t in docs], [i for i, _ in docs]), frame(spark, []))
    assert rows_of(got) == brute_resample(docs, [])
    assert resample.resample(frame(spark, []), frame(spark, [text])).collect() == []


# --- SetSketch near-duplicates ---


def brute_components(docs):
    sets = [set(simhash.shingles(t, 4).tolist()) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if docs[a][0] is not None and docs[b][0] is not None and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[x] = y
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)) if i is not None else None, i == least[find(k)] if i is not None else None) for k, (i, _) in enumerate(docs)), key=repr)


def near_texts(rng, families=12, size=10, length=90):
    out = []
    for _ in range(families):
        base = ["t%d" % rng.randrange(2_000) for _ in range(length)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(length)] = "e%d" % rng.randrange(10_000)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def test_setsketch_equals_brute_force(spark):
    rng = random.Random(11)
    docs = list(enumerate([*near_texts(rng), *ODD], 5))
    docs += [docs[0], docs[0], (None, docs[1][1]), (2, docs[2][1].upper()), (None, None)]
    df = frame(spark, [t for _, t in docs], [i for i, _ in docs])
    got = rows_of(setsketch.near_duplicates(df))
    assert got == brute_components(docs)
    assert len({r[2] for r in got}) < len(docs) - 25


def test_setsketch_in_tiles(spark, monkeypatch):
    """A passage that most texts share, so that bands hold many components; tiles of a few rows, and centres that settle little."""
    monkeypatch.setattr(setsketch, "TILE", 4)
    rng = random.Random(12)
    passage = " ".join("p%d" % k for k in range(60))
    texts = [f"{passage} {t}" for t in near_texts(rng, 8, 6, 40)]
    docs = list(enumerate(texts))
    assert rows_of(setsketch.near_duplicates(frame(spark, texts))) == brute_components(docs)


def test_setsketch_beyond_small_sides(spark, monkeypatch):
    """The ways that more pairs and links take than are broadcast or united at once."""
    monkeypatch.setattr(simhash, "SMALL", 0)
    monkeypatch.setattr(setsketch, "TILE", 8)
    rng = random.Random(16)
    texts = [*near_texts(rng, 6, 8, 50), *ODD]
    assert rows_of(setsketch.near_duplicates(frame(spark, texts))) == brute_components(list(enumerate(texts)))


def test_setsketch_levels(spark, monkeypatch):
    """What is taken to link and doesn't is looked at again, pair by pair."""
    monkeypatch.setattr(setsketch, "LEVELS", (0.5, 2.0))
    rng = random.Random(14)
    texts = near_texts(rng, 6, 12, 60)
    assert rows_of(setsketch.near_duplicates(frame(spark, texts))) == brute_components(list(enumerate(texts)))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, 3_000, dtype=np.uint64)
    for similarity in (0.3, 0.6, 0.8, 0.95):
        both = round(2_000 * 2 * similarity / (1 + similarity))
        a, b = codes[:2_000], np.concatenate([codes[:both], rng.integers(0, 1 << 63, 2_000 - both, dtype=np.uint64)])
        x, y = setsketch.registers(a), setsketch.registers(b)
        assert (setsketch.merged(x, y) == setsketch.registers(np.union1d(a, b))).all()
        value, possible = setsketch.estimate(*(np.array([c]) for c in setsketch._compared(x, y)), np.array([2_000]), np.array([2_000]))
        assert abs(value[0] - similarity) < 0.12 and (possible[0] or similarity < 0.75)
    assert (setsketch.registers(codes[:0]) == 0).all()


def test_likelihood_slope():
    n, m = np.array([900.0]), np.array([1_000.0])
    counts = [np.array([c]) for c in (20, 30, 238)]
    at = np.array([0.7])
    up, down = (setsketch.likelihood(at + d, *counts, n, m)[0] for d in (1e-6, -1e-6))
    assert setsketch.likelihood(at, *counts, n, m)[1][0] == pytest.approx((up - down)[0] / 2e-6, rel=1e-4)


def test_share_of_pairs_with_a_band():
    """Pairs at the least similarity: nearly all share a band, and none is ruled out."""
    rng = np.random.default_rng(4)
    shared = possible = 0
    for _ in range(300):
        own = rng.integers(0, 1 << 63, 450, dtype=np.uint64)
        x, y = setsketch.registers(own[:405]), setsketch.registers(own[45:])
        shared += bool((x == y).reshape(-1, setsketch.ROWS).all(axis=1).any())
        possible += bool(setsketch.estimate(*(np.array([c]) for c in setsketch._compared(x, y)), np.array([405]), np.array([405]))[1][0])
    assert shared == 300 and possible == 300


def test_parities_rule_out_no_link():
    """Of sets at and around the least similarity, also of different lengths: those that reach it are possible, those well below are not."""
    rng = np.random.default_rng(5)
    for n in (5, 40, 150, 1_000):
        for lack in range(0, n, max(1, n // 20)):
            pool = rng.integers(0, 1 << 63, n + n // 4 + 1, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[lack:])
            both = len(np.intersect1d(a, b))
            held = setsketch.Parities([setsketch.parities(a), setsketch.parities(b)])
            value, possible = setsketch.by_parity(*held.apart(0, np.array([1])), np.array([len(a) + len(b)]))
            real = both / (len(a) + len(b) - both)
            assert possible[0] or real < 0.8
            assert not possible[0] or real > 0.7 or n < 10
            assert abs(value[0] - real) < 0.1 or n < 10 or real < 0.5


def test_family_that_is_nearly_alike(spark):
    """Edits of one text, most pairs of which are below the least similarity: what is emitted follows the members, not their pairs."""
    rng = random.Random(15)
    base = ["t%d" % k for k in range(140)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.choice([1, 3, 5, 7, 9])):
            copy[rng.randrange(len(copy))] = "e%d" % rng.randrange(10_000)
        texts.append(" ".join(copy))
    assert rows_of(setsketch.near_duplicates(frame(spark, texts))) == brute_components(list(enumerate(texts)))
    sets = [np.unique(simhash.shingles(t, 4)) for t in texts]
    matrix, size = np.array([setsketch.registers(x) for x in sets]), np.array([len(x) for x in sets])
    pairs = sum(len(list(setsketch.tile_pairs(band, True, np.zeros(len(sets)), np.arange(len(sets)), size, matrix, setsketch.Parities([setsketch.parities(x) for x in sets]), 0.8))) for band in range(setsketch.BANDS))
    assert pairs < 12 * len(sets)


def test_setsketch_of_nothing(spark):
    assert setsketch.near_duplicates(frame(spark, [])).collect() == []
    assert rows_of(setsketch.near_duplicates(frame(spark, ODD[:3]))) == [(k, 0, k, True) for k in range(3)]


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_resample", "op13_minhash"])
def test_queries_have_sql(name):
    assert name in queries.queries() and name in queries.oracle_sql()
