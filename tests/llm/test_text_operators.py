"""Operators on texts against brute force, a library or held-out rows; with nulls, empty tables, repeats and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from signalmill.llm import bpe, decontaminate, html_text, language, licenses, queries, secrets
from signalmill.llm.words import words

P = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " \n\t ", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" é👍", "Released under the MIT License. cc by-nc", "x" * 40_000, "the of and " * 6_000, "½ ١٢ \u0085\u00a0\u001c A\u0301"]


def frame(spark, rows=None):
    """Clashing and extra columns beside the text."""
    rows = TEXTS if rows is None else rows
    data = [(k, t, "en", 7, "clash") for k, t in enumerate(rows)]
    return spark.createDataFrame(data + data[:2], "doc_id long, text string, lang string, score int, n_words string")


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_rank_file(P.path(queries.RANKS)), P.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encoding(codec):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.vocabulary.ranks, special_tokens={})


def some_text(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return "".join(chr(rng.randrange(128)) for _ in range(rng.randrange(60)))
    if kind == 1:
        return "".join(rng.choice(["a", "aa", "ab", "  ", "the", "'s", "1", "\n", "ing"]) for _ in range(rng.randrange(60)))
    if kind == 2:
        return "".join(rng.choice(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ab.²½") for _ in range(rng.randrange(60)))
    return "".join(chr(rng.choice([rng.randint(0x80, 0x2FF), rng.randint(0x3000, 0xD000), rng.randint(0x1F300, 0x1F800)])) for _ in range(rng.randrange(40)))


def test_bpe_equals_tiktoken(codec, tiktoken_encoding):
    rng = random.Random(1)
    for text in [some_text(rng) for _ in range(3000)] + [t or "" for t in TEXTS]:
        ids = codec.encode(text)
        assert ids == tiktoken_encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_appends_and_edits(codec):
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice(["ing", "the", "a", "é", "tion", " "]) for _ in range(n)).encode()
    for _ in range(300):
        data, more = some(rng.randrange(60)), some(rng.randrange(9))
        grown = bpe.PrefixEncoder(codec.vocabulary, data)
        grown.append(more)
        assert grown.last == bpe.PrefixEncoder(codec.vocabulary, data + more).last
        at = rng.randint(0, len(data))
        end = rng.randint(at, len(data))
        edited = bpe.PrefixEncoder(codec.vocabulary, data)
        edited.edit(at, end, more)
        fresh = bpe.PrefixEncoder(codec.vocabulary, data[:at] + more + data[end:])
        assert edited.last == fresh.last and edited.tokens() == fresh.tokens()


def test_bpe_edits_of_a_long_piece(codec):
    """Each edit near the start of half a million bytes, with a table that never agrees again for long, stays linear."""
    encoder = bpe.PrefixEncoder(codec.vocabulary, b"ab" * 250_000)
    encoder.edit(1, 2, b"")
    assert len(encoder.last) == 500_000


def test_bpe_edit_stops_where_the_old_table_holds(codec):
    encoder = bpe.PrefixEncoder(codec.vocabulary, b"abcdefgh" * 200)
    assert encoder.edit(800, 801, b"x") < 400


def test_bpe_bounded_tables_change_nothing(codec, tiktoken_encoding):
    small = bpe.Pieces(codec.vocabulary, limit=3, prefix_limit=3, pair_limit=3)
    for piece in ["the", " otherwise", "zzqx", " nñandú", "the"] * 3:
        assert list(small[piece]) == tiktoken_encoding.encode_ordinary(piece)


def test_bpe_frame(spark, tiktoken_encoding):
    out = bpe.encode_decode(frame(spark), P.path(queries.RANKS), P.PATTERN, digests=True, decoded="again").collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        ids = tiktoken_encoding.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["again"] == (r["text"] or "")
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode_decode(frame(spark, []), P.path(queries.RANKS), P.PATTERN).count() == 0


# --- secrets ---


def brute_secrets(text):
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    return sorted((m.start(), k, kind, m.end()) for k, (kind, p, g, n) in enumerate(kinds) for m in p.finditer(text or "") if len(m[g]) >= n)


def secret_texts():
    rng = random.Random(3)
    parts = ["token", "=", " ", '"', "secret", ":", "abc", "api_key", "AKIA", "ABCDEFGH12345678", "0123456789ab", "é", "👍", "\n", "xYz9Q2", "-", "/"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(150)]
    return TEXTS + ["secret=token: abcdefgh", "PASSWD : 'hunter22'", "token=abc", "key ghp16C7e42F292c6912E7710c838347Ae178B4a end", "getElementsByTagNameAndClass2024", "a" * 23 + " " + "b" * 24, "token=abcdef " * 700, *made]


def test_secrets_base_equals_brute_force(spark):
    rows = secrets.find_secrets(frame(spark, secret_texts())).collect()
    assert len(rows) == len(secret_texts()) + 2
    for r in rows:
        assert [tuple(s) for s in r["base_spans"]] == brute_secrets(r["text"])
        assert {tuple(s) for s in r["base_spans"]} <= {tuple(s) for s in r["secret_spans"]}
        added = [s for s in r["secret_spans"] if s["kind"] == secrets.MARKOV]
        candidates = [(m.start(), m.end()) for m in re.finditer(secrets.CANDIDATE, r["text"] or "") if secrets.ratio(m[0]) > secrets.MARGIN * len(m[0])]
        assert [(s["start"], s["end"]) for s in added] == [(a, b) for a, b in candidates if all(e <= a or b <= s for s, _, _, e in brute_secrets(r["text"]))]


def test_markov_model_tells_keys_from_names():
    found = lambda k: secrets.ratio(k) > secrets.MARGIN * len(k)
    assert all(map(found, ("ghp16C7e42F292c6912E7710c838347Ae178B4a", "aGVsbG8gd29ybGQgMTIzNDU2", "d41d8cd98f00b204e9800998ecf8427e", "kQzXwVbNpLtRsGhJdFmYcUoP", "qzxwvkjpbnmtdgfhrlsycwqx")))
    assert not any(map(found, ("getElementsByTagNameAndClass2024", "user_profile_settings_page_2", "content/articles/2024/title-of-it", "-" * 40, "x" * 30, "12345678901234567890", "internationalizationOfStrings", "anticonstitutionnellement")))


def test_markov_model_on_held_out_samples():
    keys, names = secrets.held_out(secrets.random_samples()), secrets.held_out(secrets.ordinary_samples())
    hits = [[secrets.ratio(k) > secrets.MARGIN * len(k) for k in kind] for kind in (keys, names)]
    recall, precision = sum(hits[0]) / len(keys), sum(hits[0]) / max(1, sum(map(sum, hits)))
    assert min(len(keys), len(names)) > 500 and recall >= 0.98 and precision >= 0.98
    assert not set(secrets.learnt(secrets.random_samples())) & set(keys)


def test_planted_keys_become_spans(spark):
    """Keys that no fixed pattern finds, in prose; prose alone gives none."""
    prose = "The report of the committee, with its annexes, was published in the official journal of that year."
    keys = secrets.held_out(secrets.random_samples())[1:60:8]  # of letters and digits in either case
    docs = spark.createDataFrame([(f"{prose} See {k} for more. {prose}",) for k in keys] + [(prose,)], "text string")
    rows = secrets.find_secrets(docs).collect()
    spans = [[r["text"][s["start"] : s["end"]] for s in r["secret_spans"] if s["kind"] == secrets.MARKOV] for r in rows]
    assert len(spans) == len(keys) + 1 and spans == [[k] for k in keys] + [[]]


def test_secrets_of_a_long_mixed_run(spark):
    """The sum of its log-likelihoods is beyond 2**31."""
    rng = random.Random(4)
    run = "".join(rng.choices(secrets.ALPHABET, k=2_000_000))
    assert secrets.ratio(run) > 2**31
    (found,) = secrets.find_secrets(spark.createDataFrame([(f"data {run} end",)], "text string")).select("secret_spans").collect()
    assert [tuple(s) for s in found[0]] == [(5, 3, secrets.MARKOV, 2_000_005)]


def test_secrets_masked(spark):
    df = secrets.find_secrets(spark.createDataFrame([("é token=abcdef0 and 0123456789abcdef0123456789abcdef.",), ("clean",), (None,)], "text string"))
    assert [r[0] for r in df.select(secrets.masked(F.col("text"), F.col("secret_spans"))).collect()] == ["é [SECRET] and [SECRET].", "clean", None]
    assert secrets.find_secrets(frame(spark, [])).count() == 0


# --- licences ---


def test_licenses(spark):
    gpl = "Intro. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. End"
    texts = TEXTS + ["cc by nc CC BY-NC!", "under the mit licenses", gpl, "Apache License, Version 2.0", "general public version license gnu"]
    rows = licenses.find_licenses(frame(spark, texts)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        own = words(r["text"])
        places = {p: [k for k in range(len(own)) if own[k : k + len(p.split())] == p.encode().split()] for p in licenses.PHRASES}
        every = sorted(k for v in places.values() for k in v)
        assert (r["n_words"], r["n_base"]) == (len(own), len(every))
        assert (r["first_word"], r["last_word"]) == ((every[0], every[-1]) if every else (None, None))
        assert r["base_label_list"] == sorted({licenses.PHRASES[p] for p, v in places.items() if v})
        assert set(r["base_label_list"]) <= set(r["label_list"]) and 0 <= r["score"] <= 1
    by = {r["text"]: r for r in rows}
    assert by[gpl]["label_list"] == ["gpl-3"] and by["general public version license gnu"]["label_list"] == []
    assert licenses.find_licenses(frame(spark, [])).count() == 0


def brute_templates(text):
    """Labels of the templates with enough words in place and their keys within, at any start."""
    own, out = words(text), set()
    for label, template, keys in licenses.TEMPLATES:
        t = words(template)
        for start in range(1 - len(t), len(own)):
            low, high = max(0, start), min(len(own), start + len(t))
            same = sum(a == b for a, b in zip(own[low:high], t[low - start :]))
            if same / len(t) >= licenses.LEAST and all(licenses.spaced(k) in b" " + b" ".join(own[low:high]) + b" " for k in keys):
                out.add(label)
    return out


def test_license_scores_equal_brute_force(spark):
    """The largest share of a template's words at their places, over all starts; ties of equal shares too; and repeated words that are rare ones."""
    rng = random.Random(9)
    texts = ["", "version version version license license", "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0."]
    for _ in range(150):
        _, template, _ = rng.choice(licenses.TEMPLATES)
        own = template.split()
        for _ in range(rng.randrange(0, len(own) // 3 + 1)):
            own[rng.randrange(len(own))] = rng.choice(["x", "license", "the", ""])
        cut = rng.randrange(0, 3)
        texts.append(" ".join([*rng.choices(["of", "license", "software", "y"], k=rng.randrange(6)), *own[cut:], "z"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.find_licenses(docs).collect():
        own, best = words(r["text"]), {}
        for label, template, keys in licenses.TEMPLATES:
            t = words(template)
            for start in range(-len(t), len(own)):
                low, high = max(0, start), min(len(own), start + len(t))
                window = b" " + b" ".join(own[low:high]) + b" "
                same = sum(own[p] == t[p - start] for p in range(low, high)) / len(t)
                if same >= licenses.LEAST and all(licenses.spaced(k) in window for k in keys):
                    best[label] = max(best.get(label, 0), same)
        assert set(r["label_list"]) == set(r["base_label_list"]) | set(best)
        assert r["score"] == (1.0 if r["base_label_list"] else round(max(best.values(), default=0.0), 6))


def test_license_cost_does_not_grow_with_templates():
    """Starts that are looked at: as many with 500 templates, whose words a file doesn't have, as with a few."""
    import time

    text = words("some prose without a licence word, " * 20_000 + "Released under the MIT License.")
    took = []
    for n in (0, 500):
        more = [(f"l{k}", f"terms{k} of{k} a{k} licence{k} number{k} that{k} nobody{k} has{k}", [f"terms{k} of{k}"]) for k in range(n)]
        index = licenses.build(licenses.PHRASES, [*licenses.TEMPLATES, *more], {b"the": 9, b"license": 3}, 10)
        best = 9.0
        for _ in range(3):
            at = time.perf_counter()
            assert licenses.template_matches(index, text) == {"mit": 1.0}
            best = min(best, time.perf_counter() - at)
        took.append(best)
    assert took[1] < 2 * took[0]


def test_several_licenses_of_a_file(spark):
    rng, bodies = random.Random(8), [t for _, t, _ in licenses.TEMPLATES]
    texts = [f"{a} {b}" for a in bodies for b in bodies if a is not b] + ["\n".join(bodies), "license " * 3_000 + bodies[6]]
    for body in bodies * 8:  # words changed, the rarest ones too
        texts.append(" ".join(w if rng.random() < 0.8 else rng.choice(["the", "thing", "GNU"]) for w in body.split()) + " end")
    found = {r["text"]: r for r in licenses.find_licenses(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    for t in texts:
        assert set(found[t]["label_list"]) == brute_templates(t) | set(found[t]["base_label_list"])
    assert found["\n".join(bodies)]["label_list"] == sorted({label for label, *_ in licenses.TEMPLATES})
    assert {"gpl-3", "mit"} <= set(found[f"{bodies[6]} {bodies[0]}"]["label_list"])


# --- language ---


def test_language_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def naive_grams(text):
    """Sets of 1 to 3 bytes of lower-cased letters, all else one gap."""
    b = [c if 97 <= c <= 122 or c >= 128 else 0 for c in text.lower().encode()]
    return {tuple(b[k : k + n]) for n in (1, 2, 3) for k in range(len(b) - n + 1)}


def naive_kernel(a, b):
    import numpy as np

    return np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in b] for x in a])


def test_language_equals_naive_kernel_ridge(spark):
    """With every row a landmark the scores are those of kernel ridge regression solved on the whole kernel matrix; with few they agree on 200 rows."""
    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND n_chars < 1500").orderBy("doc_id").select("text", "lang").collect()
    learnt, asked = rows[:160], rows[160:360]
    codes = [language.distinct_codes(r["text"]) for r in learnt]
    grams = np.unique(np.concatenate(codes)).astype("<i4")
    samples = [(r["lang"], np.searchsorted(grams, c)) for r, c in zip(learnt, codes)]
    sets, others = [naive_grams(r["text"]) for r in learnt], [naive_grams(r["text"]) for r in asked]
    seen = set().union(*sets)
    names = sorted({r["lang"] for r in learnt})
    y = np.array([names.index(r["lang"]) for r in learnt])
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (1.0 / np.bincount(y))[y] * len(y) / len(names)
    k, n, ridge = naive_kernel(sets, sets), len(learnt), 0.5
    system = np.block([[weight[:, None] * k + ridge * np.eye(n), weight[:, None]], [weight @ k, weight.sum()]])
    solved = np.linalg.solve(system, np.vstack([weight[:, None] * target, weight @ target]))
    want = naive_kernel([s & seen for s in others], sets) @ solved[:n] + solved[n]
    whole = language.fit(samples, grams, n, ridge)
    got = whole.scores([r["text"] for r in asked])[0]
    assert whole.languages == names and np.abs(got - want).max() < 1e-3
    few = language.fit(samples, grams, 12, ridge).scores([r["text"] for r in asked])[0]
    assert (few.argmax(axis=1) == want.argmax(axis=1)).mean() >= 0.97


def test_languages_of_repeated_rows_are_learnt(spark):
    """However often one row repeats, and whatever its hash: beside many rows of another language, or with few that differ."""
    english = [(k, f"the house and the road of number{k} is here", "en") for k in range(300)]
    for key in range(6):
        german = [(key, "das haus und die straße ist nicht weit von hier", "de")] * 2_000
        french = [(k % 3, f"la maison et la rue {'a' * (k % 3)} sont ici", "fr") for k in range(600)]
        rows = spark.createDataFrame(english + german + french, "doc_id long, text string, lang string")
        model = language.learn(rows, F.lit(True))
        assert model.languages == ["de", "en", "fr"]
    told = language.predict(spark.createDataFrame([("das haus ist weit",), ("la maison et la rue",)], "text string"), model)
    assert [r["lang_pred"] for r in told.collect()] == ["de", "fr"]


def test_language_edges(spark):
    learnt = language.learn(frame(spark, ["the cat and the dog", "le chat et le chien"] * 3).withColumn("lang", F.when(F.contains("text", F.lit("the")), "en").otherwise("fr")), F.lit(True))
    rows = {r["text"]: r for r in language.predict(frame(spark), learnt).collect()}
    assert rows[None]["lang_pred"] == rows[""]["lang_pred"] == rows[" \n\t "]["lang_pred"] == "und"
    assert rows["the of and " * 6_000]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in rows.values())
    assert language.learn(frame(spark, [None, "12"]), F.lit(True)) is None
    assert {r["lang_pred"] for r in language.predict(frame(spark), None).collect()} == {"und"}
    assert language.predict(frame(spark, []), learnt).count() == 0


# --- benchmark passages ---


def brute_passages(items, text, window):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            part = w[a : a + window]
            for k in range(len(own) - len(part) + 1):
                if own[k : k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    found.add(item)
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_passages_equal_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    for _ in range(60):
        voc = ["a", "b", "c", "dé", "x1"][: rng.randint(1, 5)]
        some = lambda n: " ".join(rng.choice(voc) for _ in range(rng.randrange(n)))
        items, docs, window = [(str(k), some(15)) for k in range(rng.randrange(4))], [some(80) if rng.random() < 0.9 else None for _ in range(rng.randrange(6))], rng.randint(1, 6)
        monkeypatch.setattr(decontaminate, "SHARD_SYMBOLS", rng.choice([12, 40, 1 << 20]))
        for (n, spans, found), text in zip(decontaminate.scan(decontaminate.Windows(items, window), docs), docs):
            assert (n, sum(b - a for a, b in spans), sorted(found)) == brute_passages(items, text, window)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_passages_frame(spark, block_bytes):
    passage = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(1, passage, "x"), (10, "short item", "y"), (2, None, "z"), (3, "", "z"), (1, passage, "x"), (None, "the of", "n")], "item_id long, text string, n_hit string")
    texts = TEXTS + [f"start {passage.upper()} end", "a short-item, and two three four five six seven eight nine ten eleven", "short  item short"]
    rows = decontaminate.find_passages(frame(spark, texts), benchmark, block_bytes=block_bytes).collect()
    items = [("1", passage), ("10", "short item"), ("", "the of")]  # the last one's id is null: its words are hit, it isn't listed
    assert len(rows) == len(texts) + 2
    for r in rows:
        n, hit, found = brute_passages(items, r["text"], 10)
        found = [x for x in found if x]
        assert (r["n_words"], r["n_hit"], r["hit_items"], r["contaminated"]) == (n, hit, found, hit > 0)
    assert decontaminate.find_passages(frame(spark, []), benchmark).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.find_passages(frame(spark), benchmark.limit(0)).collect())


def test_passages_of_long_and_repeated_items(spark, monkeypatch):
    """Items beyond a block's bytes are cut with an overlap; repeated ones are one."""
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(300)}" for _ in range(400))
    benchmark = spark.createDataFrame([(1, long), (2, "x y z")] + [(3, "again and again")] * 50 + [(k, None) for k in range(4, 60)], "item_id long, text string")
    own = long.split()
    texts = [" ".join(own[k : k + rng.randint(5, 30)]) + " end" for k in range(0, 380, 13)] + ["and again and again", long]
    docs = spark.createDataFrame([(t, "clash") for t in texts], "text string, hit_spans string")
    monkeypatch.setattr(decontaminate, "CHAINED", 2)
    rows = decontaminate.find_passages(docs, benchmark, block_bytes=1200).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["hit_items"]) == brute_passages([("1", long), ("2", "x y z"), ("3", "again and again")], r["text"], 10)


# --- pages ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="no-sidebar"><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="ad">Buy, now.</div><article><header><h1>Head &amp; line</h1></header><p>First  paragraph,
with <b>bold &lt;text&gt;.<br>More&nbsp;of it.<p>Second &#233; one.</p><div class=comments><p>Nice, I think.</p></div></article><aside>Other</aside><div id="cookie-notice">We use cookies.</div><form>Mail</form><footer>End</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\n\nFirst paragraph, with bold <text>. More of it.\n\nSecond é one."
    assert [html_text.main_text(x) for x in (None, "", "<nav>a</nav>", "<script>x")] == ["", "", "", ""]
    assert html_text.main_text("plain &amp; text") == "plain & text"
    plain = "<div id=menu><a href=x>a</a></div><div class=post><h2>Title</h2><p>Some longer text, with commas, and more. So it goes on.<p>Another, as long as that one; and more of it, too.</div><div class=comments><p>I think, that this is wrong, since it is long.</div>"
    assert html_text.main_text(plain) == "Title\n\nSome longer text, with commas, and more. So it goes on.\n\nAnother, as long as that one; and more of it, too."


def test_main_text_frame(spark):
    rows = html_text.extract(spark.createDataFrame([(1, PAGE, "old"), (2, None, "old"), (2, None, "old")], "page_id long, html string, text string")).collect()
    assert [len(r["text"]) > 0 for r in sorted(rows, key=lambda r: r["page_id"])] == [True, False, False]
    assert html_text.main_text("<p>" + "word, " * 30_000 + "</p>").count("word,") == 30_000


def test_main_text_of_the_pages(spark):
    """The article of every page, by its marks."""
    import html as h

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        parts = re.split(r"</?(?:p|h1)>", re.search("<article>(.*?)</article>", r["html"], re.S)[1])
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts]
        assert html_text.main_text(r["html"]) == "\n\n".join(b for b in blocks if b)


def article_of(page):
    """By its marks."""
    import html as h

    parts = re.split(r"</?(?:p|h1)>", re.search("<article>(.*?)</article>", page, re.S)[1])
    return "\n\n".join(b for b in (" ".join(h.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts) if b)


def test_ratios_choose_the_text(monkeypatch):
    """The same text where the article's tag tells nothing; mostly where no tag or class tells anything; another without the ratios."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()
    want = [article_of(p) for p in pages]
    renamed = [re.sub("<(/?)article", r"<\1div", p) for p in pages]
    bare = [re.sub("<(/?)(?:nav|footer)", r"<\1div", p).replace('<div class="ad"', "<div") for p in renamed]
    assert [html_text.main_text(p) for p in renamed] == want
    assert sum(html_text.main_text(p) == w for p, w in zip(bare, want)) >= 0.9 * len(pages)

    def alike(blocks):
        for b in blocks:
            b.weight = 1.0

    monkeypatch.setattr(html_text, "path_weights", alike)
    assert sum(html_text.main_text(p) != w for p, w in zip(renamed, want)) > 0.05 * len(pages)


def brute_weights(page):
    """(text, weight) of pages whose blocks are p, li and h1 with classes ad or none, in div, nav or article."""
    out, path = [], []
    for m in re.finditer(r"<(/?)(\w+)(?: class=(\w+))?>|([^<]+)", page):
        if m[4]:
            if m[4].strip():
                out.append((m[4].strip(), tuple(path)))
        elif m[1]:
            path.pop()
        else:
            path.append((m[2], m[3] or ""))
    marked = lambda q: any(n == "nav" or c == "ad" for n, c in q)
    key = lambda q: tuple((n, marked(q[: k + 1])) for k, (n, _) in enumerate(q))
    mean = lambda f: [1 + sum(f(t) for t, q in out if key(q) == key(p)) / sum(key(q) == key(p) for _, q in out) for _, p in out]
    near = lambda xs: [sum(xs[max(0, k - 1) : k + 2]) / len(xs[max(0, k - 1) : k + 2]) for k in range(len(xs))]
    x, y = near(mean(len)), near(mean(lambda t: sum(c in ".,;:!?" for c in t)))
    return [(t, 0.0 if marked(q) else a * b * (10 if any(n == "article" for n, _ in q) else 1)) for (t, q), a, b in zip(out, x, y)]


def test_path_weights_equal_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        text = lambda: " ".join(rng.choice(["word", "a,", "longer.", "x"]) for _ in range(rng.randint(1, 30)))
        page = "".join(f"<{box}{mark}>" + "".join(f"<{t}>{text()}</{t}>" for t in rng.choices(["p", "h1", "li"], k=rng.randint(1, 4))) + f"</{box}>" for box, mark in rng.choices([("div", ""), ("div", " class=ad"), ("nav", ""), ("article", "")], k=rng.randint(1, 5)))
        blocks = html_text._Reader(page).blocks
        html_text.path_weights(blocks)
        assert [(b.text, round(b.weight, 6)) for b in blocks] == [(t, round(w, 6)) for t, w in brute_weights(page)]


def test_nothing_else_of_an_article_goes():
    body = "<p>First, a paragraph of some length. And more of it.<p><a href=x>A paragraph that is a link, all of it.</a><p>By <math><mi>x</mi></math> we see, <svg><text>drawn</text></svg>.<ul><li><a href=y>A reference</a></ul>"
    want = "First, a paragraph of some length. And more of it.\n\nA paragraph that is a link, all of it.\n\nBy x we see, drawn.\n\nA reference"
    for tag in ("article", "div", "main", "section"):
        assert html_text.main_text(f"<nav>Menu</nav><{tag}>{body}</{tag}><footer>End</footer>") == want
    assert html_text.main_text(f"<div><h1>Head</h1><div>{body}</div></div>") == f"Head\n\n{want}"
    assert html_text.main_text("<main><p>Before, in main.</p><article><p>One, that is longer than the other.</p></article><article><p>Two.</p></article></main>") == "Before, in main.\n\nOne, that is longer than the other.\n\nTwo."


@pytest.mark.parametrize("page, text", [("<div>" * 100_000 + "x", "x"), ("<ul><li>" + "<blockquote>" * 50_000 + "y", "y"), ("<p>" * 100_000 + "q", "q"), ("</table>" * 100_000 + "<td>a", "a")])
def test_deep_pages(page, text):
    assert html_text.main_text(page) == text


def test_main_text_of_an_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string, TEXT string")).count() == 0


def test_random_strings_of_other_origin():
    """Strings that the samples' generator didn't make: names of the standard library against keys, tokens and UUIDs."""
    import base64
    import importlib
    import uuid

    names = set()
    for module in ("os", "socket", "ssl", "unittest", "logging.handlers", "http.client", "email.message", "asyncio", "multiprocessing", "xml.dom.minidom", "urllib.request", "tkinter.constants", "concurrent.futures", "ctypes", "decimal", "argparse", "typing", "ast", "signal", "errno", "locale"):
        try:
            held = importlib.import_module(module)
        except ImportError:
            continue
        for name in dir(held):
            names |= {name, *dir(getattr(held, name))}
    names = sorted(n for n in names if len(n) >= 20 and not n.startswith("__") and set(n) <= set(secrets.ALPHABET))
    rng = random.Random(20)
    noise = lambda n: rng.getrandbits(8 * n).to_bytes(n, "big")
    keys = [f(k) for k in range(150) for f in (lambda k: base64.urlsafe_b64encode(noise(24)).decode().rstrip("="), lambda k: base64.b32encode(noise(20)).decode(), lambda k: str(uuid.UUID(bytes=noise(16), version=4)), lambda k: base64.b64encode(noise(30)).decode())]
    flagged = lambda some: sum(secrets.ratio(t) > secrets.MARGIN * len(t) for t in some)
    right, wrong = flagged(keys), flagged(names)
    assert len(names) > 100 and right >= 0.9 * len(keys) and right >= 0.9 * (right + wrong)


def test_keys_planted_in_documents(spark):
    """Of keys put at any place of whole texts nearly all are spans, and texts without one have no span of the model's."""
    rng = random.Random(21)
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").collect()]
    rows, planted = [], {}
    for k, text in enumerate(docs):
        if k % 2 == 0:
            key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(rng.randrange(24, 44)))
            at = rng.choice([m.end() for m in re.finditer(r"\s", text)] or [0])
            planted[k] = (at, at + len(key))
            text = f"{text[:at]}{key} {text[at:]}"
        rows.append((k, text))
    found = {r["doc_id"]: r["secret_spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(any(s["start"] <= a and b <= s["end"] for s in found[k]) for k, (a, b) in planted.items())
    assert hit >= 0.9 * len(planted) and len(planted) > 50
    assert not [s for k, spans in found.items() if k not in planted for s in spans if s["kind"] == secrets.MARKOV]
