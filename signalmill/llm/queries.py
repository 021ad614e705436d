"""The registered queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, html_text, language, licenses, resample, secrets, setsketch, simhash, topk, url_rules, variants, warc

#: The rank file; a parameter of the operator.
RANKS = "byte_bpe_multi_50k.tiktoken"
FOLDS = 5

# Verdict, host and path of each rule.
URL_RULES = [url_rules.Rule("allow", "com", "/"), url_rules.Rule("block", "example.com", "/en/"), url_rules.Rule("allow", "www.example.com", "/en/"), url_rules.Rule("block", "net", "/es/"), url_rules.Rule("block", "net", "/fr/")]


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for every row. Learnt from rows of the other folds; a null doc_id is in no fold, so its row is neither learnt from
    nor held out. Null, empty and letterless texts, and all texts where nothing could be learnt, are `und` with score 0; ties go to the
    language that sorts first; texts of any length are read whole; repeated rows are predicted alike; an empty table gives no rows."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    model = language.learn(docs, fold(F.col("doc_id")) != 0)
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null ids, null vectors and ones with a null or non-finite component take no part; only vectors of equal length meet; a finite
    component may be of any size. Ties go to the smaller vec_id. Repeated rows are as many candidates, and one query. An empty
    table gives no rows; other columns aren't read."""
    return topk.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document. The shard trees are built where the shuffle brings a shard instead of being broadcast, which would
    take all fingerprints through the driver; links are exact all the same. Null and blank texts have fingerprint zero; a null doc_id has
    no component; rows that share an id are linked each by its own text; texts of any length are read whole; an empty table gives no rows."""
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document. Null and empty texts have no words, no labels and score 0; texts of any length are read whole; places
    that overlap all count; repeated rows are scanned alike; an empty table gives no rows."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.find_licenses(docs)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_label_list", ",").alias("base_labels"), F.array_join("label_list", ",").alias("labels"), "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document. Null and empty texts have no tokens, and the digests of nothing; texts of any length are encoded whole;
    repeated rows alike; an empty table gives no rows."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids=None, digests=True).drop("text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archive to the shared folder, rebuilds the bytes of its records by joins, and parses these. A row for every page.
    Null and empty pages are empty payloads; a null page_id is smaller than any; rows that repeat the largest page_id of a payload are all
    responses; payloads of any length are kept whole; an empty table gives no rows."""
    path = common.scratch(spark, "warc")
    warc.write_archive(common.table(spark, sf_dir, "pages"), path)
    return warc.parsed(warc.warc_bytes(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every page. Null and empty pages, and such without an article, have an empty text; pages of any length and depth are read
    whole; repeated rows alike; an empty table gives no rows."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document. Null and empty texts have no words; repeated items are one; the words of items without an id are hit, too, but
    such items aren't listed or counted; texts of any length are searched whole; empty tables give no rows, and no hits."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every page. Null urls and ones without `://` have an empty host and path, no rule, and are blocked; other urls that no
    rule fits are allowed; urls of any length are read whole; repeated rows are judged alike; an empty table gives no rows."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document. Null and empty texts have no spans, and the digest of nothing; spans that start together come in the order of
    their kinds; texts of any length are scanned whole; repeated rows alike; an empty table gives no rows."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(kind) for kind, *_ in secrets.PATTERNS), F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"), secrets.joined(F.col("secret_spans")).alias("spans"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every word of the whole table's texts. Null and empty texts have no words, a null doc_id counts as an empty id; repeated rows
    count as often as they come; ties of a form go to the first in code-point order; an empty table gives no rows."""
    return variants.spelling_variants(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document. Null and empty texts have no features and weight 0; a null doc_id draws as an empty id would, and comes
    last of a tie; repeated rows count each; ties go to the smaller doc_id; texts of any length are counted whole; no documents
    give no rows, an empty benchmark counts of 0."""
    docs, benchmark = (common.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return resample.resample(docs, benchmark)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document. Null, empty and blank texts have no shingles and are linked with nothing; a null doc_id has no component and
    null for `kept`; repeated rows have one component; texts of any length are read whole; an empty table gives no rows."""
    return setsketch.near_duplicates(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_exact_topk, op3_simhash, op4_license_scan, op5_bpe, op6_warc, op7_html_text, op8_decontaminate, op9_url_filter, op10_secret_scan, op11_spelling_variants, op12_resample, op13_minhash)}


def _words(text: str) -> str:
    lowered = f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _secret_sql() -> str:
    """Letters of the assignment's names in either case are spelled out, as (?i) has more letters in SQL's engine."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    either = lambda name: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)
    value = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    assign = "(" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + ")" + value
    table = "[" + ", ".join(map(str, secrets.ratios())) + "]"
    kinds = [(kind, assign if kind == "assign" else pattern, group, least) for kind, pattern, group, least in secrets.PATTERNS] + [(secrets.MARKOV, secrets.CANDIDATE, 0, 0)]
    found = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, {k} AS ord, {least} AS least, regexp_extract_all(t, {quote(p)}) AS hits, regexp_extract_all(t, {quote(p)}, {g}) AS vals, string_split_regex(t, {quote(p)}) AS gaps FROM d" for k, (kind, p, g, least) in enumerate(kinds))
    sums = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    place = f"strpos('{secrets.ALPHABET}', h[{{}}])"
    ratio = f"list_sum(list_transform(generate_series(1, length(h)), lambda p: r[{secrets.SIDE} * CASE WHEN p = 1 THEN 0 ELSE {place.format('p - 1')} END + {place.format('p')} + 1]))"
    said = "kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({found}), lr AS (SELECT {table} AS r),
e AS (SELECT doc_id, kind, ord, least, hits, vals, gaps, unnest(generate_series(1, len(hits))) AS i FROM m WHERE len(hits) > 0),
s AS (SELECT doc_id, kind, ord, least, CAST({sums("gaps[1:i]")} + {sums("hits[1:i - 1]")} AS BIGINT) AS a, hits[i] AS h, vals[i] AS v FROM e),
f AS (SELECT doc_id, kind, ord, a, a + length(h) AS b FROM s, lr WHERE CASE WHEN kind <> '{secrets.MARKOV}' THEN length(v) >= least ELSE {ratio} > {secrets.MARGIN} * length(h) END),
g AS (SELECT * FROM f WHERE kind <> '{secrets.MARKOV}' OR NOT EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.kind <> '{secrets.MARKOV}' AND o.a < f.b AND f.a < o.b)),
n AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in secrets.PATTERNS)}, string_agg({said}, ',' ORDER BY a, ord) FILTER (kind <> '{secrets.MARKOV}') AS base, string_agg({said}, ',' ORDER BY a, ord) AS spans FROM g GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in secrets.PATTERNS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n ON d.doc_id = n.doc_id"""


#: (tab): the table of CRC32 by byte, from its polynomial.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], CAST(range(8) AS BIGINT[])),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"""


def _crc(column: str) -> str:
    """CRC32 of a text in UTF-8, next to crc."""
    octets = f"list_transform(range(strlen({column})), lambda k: CAST('0x' || substr(hex(encode({column})), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _variants_sql() -> str:
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
c AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r AS s, r, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({lowered}, '[a-zÀ-ÿ]+')) AS r FROM documents)
  WHERE length(r) >= 6 GROUP BY ALL),
h AS (SELECT r, k, {_crc("s")} AS h FROM c, crc),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
dels AS (SELECT word, substr(word, 1, i - 1) || ' ' || substr(word, i + 1) AS gap, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS near FROM dels a JOIN dels b ON a.gap = b.gap AND a.word <> b.word UNION SELECT dels.word, v.word FROM dels JOIN v ON short = v.word UNION SELECT v.word, dels.word FROM dels JOIN v ON short = v.word),
best AS (SELECT near.word, near.near, v.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, near.near) AS nth FROM near JOIN v ON near.near = v.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best ON v.word = best.word AND nth = 1),
led AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT led.word, f.form, steps + 1 FROM led JOIN f ON led.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, max_by(root, steps) AS root FROM led GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN roots ON f.word = roots.word"""


def _resample_sql() -> str:
    runs = lambda k: f"list_transform(range(1, greatest(0, len(w) - {k - 1}) + 1), lambda p: array_to_string(list_slice(w, p, p + {k - 1}), ' '))"
    listed = f"flatten([{', '.join(runs(k) for k in range(1, resample.ORDERS + 1))}])"
    return f"""
WITH {_CRC_TABLE}, d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents), b AS (SELECT {_words("coalesce(text, '')")} AS w FROM benchmark),
df AS (SELECT doc_id, f, count(*) AS k FROM (SELECT doc_id, unnest({listed}) AS f FROM d) GROUP BY ALL),
bf AS (SELECT f, count(*) AS k FROM (SELECT unnest({listed}) AS f FROM b) GROUP BY f),
codes AS (SELECT f, {_crc("f")} % {resample.BUCKETS} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), crc),
s AS (SELECT bucket, CAST(sum(k) AS DOUBLE) AS s FROM df JOIN codes USING (f) GROUP BY bucket), t AS (SELECT bucket, CAST(sum(k) AS DOUBLE) AS t FROM bf JOIN codes USING (f) GROUP BY bucket),
gains AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + {resample.BUCKETS}) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + {resample.BUCKETS})))) AS BIGINT) AS gain
  FROM s LEFT JOIN t ON s.bucket = t.bucket),
weights AS (SELECT doc_id, CAST(sum(k * gain) AS BIGINT) AS weight FROM df JOIN codes USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(w) AS n_words, CAST({' + '.join(f'greatest(0, len(w) - {k})' for k in range(resample.ORDERS))} AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN weights ON d.doc_id = weights.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS nth, (SELECT count(*) FROM scored WHERE n_words >= 20) AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND nth <= 5 * fit // 100 THEN nth END AS rank FROM ranked"""


def _minhash_sql() -> str:
    """Pairs are looked for by a shared shingle among the rarest of the smaller set, as many as a set of LEAST can lack, and one."""
    lowered = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lowered}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), df AS (SELECT s, count(*) AS df FROM sh GROUP BY s),
o AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS nth FROM sh JOIN df USING (s) JOIN n USING (doc_id)),
pre AS (SELECT * FROM o WHERE nth <= n - CAST(ceil(n * 8 / 10) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM (SELECT a, b, na, nb, count(*) AS c FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.s = x.s GROUP BY ALL) WHERE 100 * c >= 80 * (na + nb - c)),
linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS spot FROM n UNION SELECT reach.doc_id, linked.b FROM reach JOIN linked ON reach.spot = linked.a),
firsts AS (SELECT doc_id, min(spot) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, w.doc_id = coalesce(component_id, w.doc_id) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN firsts ON w.doc_id = firsts.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Those that SQL expresses; the others are tested against brute force, a library or held-out rows."""
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.name}', '{r.verdict}')" for r in URL_RULES)
    return {
        "op10_secret_scan": _secret_sql(),
        "op11_spelling_variants": _variants_sql(),
        "op12_resample": _resample_sql(),
        "op13_minhash": _minhash_sql(),
        "op2_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op6_warc": f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS latest FROM p GROUP BY h)
SELECT p.page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < {warc.REVISIT_BYTES} OR p.page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < {warc.REVISIT_BYTES} OR p.page_id = latest THEN NULL ELSE latest END AS refers_to
FROM p JOIN g ON p.h = g.h""",
        "op8_decontaminate": f"""
WITH dw AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("coalesce(text, '')")} AS w FROM benchmark),
win AS (SELECT DISTINCT item, len(list_slice(w, k, k + 9)) AS n, array_to_string(list_slice(w, k, k + 9), ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, places.n, item FROM places JOIN win ON places.s = win.s AND places.n = win.n),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN spots ON dw.doc_id = spots.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id""",
        "op9_url_filter": f"""
WITH rules(rh, rp, rule, verdict) AS (VALUES {rules}),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
f AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN f ON u.page_id = f.page_id""",
    }
