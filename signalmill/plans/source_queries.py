"""The registered queries of text functions, feed readers, ingestion and the audit log. Texts are sentences whose outcome is stated beside them,
dealt to the documents by id; readers get rows made of the driver's tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions import evaluate, extract, keywords, text
from ..operators import audit
from ..sources import feeds, html
from ..streaming import ingest, jobs
from ..tables import shared_dir
from ..windows import TimeWindow
from .catalog import _HASH, _t, query

# A sentence, whether a trigger is in it, its label and score, the terms that a negator suppresses.
SENTENCES = [
    ("Crocin 650 against a fever, and I ended up with stomach pain, then a bad rash.", True, "adverse", -1.0, ""),
    ("She denies rash and vomiting since the dose.", False, "positive", 1.0, "rash,vomiting"),
    ("On Telma 40 with Ecosprin I keep getting daily dizziness.", True, "adverse", -1.0, ""),
    ("A few painkillers later I feel much better.", False, "positive", 1.0, ""),
    ("Dolo khane ke baad se pet mein dard hai.", True, "adverse", -1.0, ""),
    ("Metformin works well, no side effects so far.", True, "positive", 1.0, "side effects"),
    ("Zantac 150 was recalled over ndma contamination.", True, "adverse", -1.0, ""),
    ("Good relief from headache after taking disprin.", True, "adverse", -0.5, ""),
    ("Weather is nice today.", False, "neutral", 0.0, ""),
    ("My sleep is worse but the cough improved.", False, "neutral", 0.0, ""),
    ("Never had nausea with rosuvastatin, and it is effective.", False, "positive", 1.0, "nausea"),
]
# Sentence, drug as written, its generic name, confidence.
DRUGS = [(0, "Crocin", "paracetamol", 0.9), (2, "Telma 40", "telmisartan", 0.9), (2, "Ecosprin", "aspirin", 0.9), (4, "Dolo", "paracetamol", 0.9), (5, "Metformin", "metformin", 0.85), (6, "Zantac 150", "ranitidine", 0.9), (7, "disprin", "aspirin", 0.9), (10, "rosuvastatin", "rosuvastatin", 0.85)]
# Sentence, symptom as written, its canonical name.
SYMPTOMS = [
    (0, "fever", "fever"), (0, "stomach pain", "stomach pain"), (0, "rash", "rash"), (1, "rash", "rash"), (1, "vomiting", "vomiting"), (2, "dizziness", "dizziness"), (4, "pet mein dard", "stomach pain"),
    (6, "ndma contamination", "ndma contamination"), (7, "headache", "headache"), (9, "cough", "cough"), (10, "nausea", "nausea"),
]
# A sentence, and it redacted.
PERSONAL = [
    ("PAN ABCDE1234F and mail a.b@mail.example now", "PAN <PAN> and mail <EMAIL> now"), ("Call 9876543210 today", "Call <PHONE_IN> today"), ("PIN 560034.", "<ADDRESS>."), ("Born on 12/05/1980, MRN: AB123456.", "Born on <DOB>, <MRN>."),
    ("Seen by Dr. Anil Kumar at Apollo Hospital", "Seen by <NAME> at <HOSPITAL>"), ("Aadhaar 2345 6789 0123 given", "Aadhaar <AADHAAR> given"), ("Nothing here, 12345 or so", "Nothing here, 12345 or so"),
]
# Sentence, kind, hit, confidence.
HITS = [(0, "PAN", "ABCDE1234F", 1.0), (0, "EMAIL", "a.b@mail.example", 1.0), (1, "PHONE_IN", "9876543210", 0.95), (2, "ADDRESS", "PIN 560034", 0.55), (3, "DOB", "12/05/1980", 0.85), (3, "MRN", "MRN: AB123456", 0.9), (4, "NAME", "Dr. Anil Kumar", 0.7), (4, "HOSPITAL", "Apollo Hospital", 0.65), (5, "AADHAAR", "2345 6789 0123", 0.95)]
NOW = datetime(2024, 1, 20, tzinfo=timezone.utc)


def _dealt(spark, sf_dir, texts: list[str]):
    """(doc_id, source, text)."""
    k = (F.col("doc_id") % len(texts) + 1).cast("int")
    return _t(spark, sf_dir, "documents").select("doc_id", "source", F.element_at(F.array(*map(F.lit, texts)), k).alias("text"))


def _sentences(spark, sf_dir):
    return _dealt(spark, sf_dir, [s[0] for s in SENTENCES])


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    said = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows) + ")"


_S = _values("said", "k, t, trigger, label, score, negated", [(k, *s) for k, s in enumerate(SENTENCES)])
_D, _E = _values("drugs", "k, w, name, c", DRUGS), _values("symptoms", "k, w, name", SYMPTOMS)
_P, _H = _values("personal", "k, t, redacted", [(k, *p) for k, p in enumerate(PERSONAL)]), _values("hits", "k, kind, w, c", HITS)
_DOCS = f"doc AS (SELECT doc_id, source, doc_id % {len(SENTENCES)} AS k, t, trigger, label, score, negated FROM documents JOIN said ON doc_id % {len(SENTENCES)} = said.k)"
_PDOCS = f"doc AS (SELECT doc_id, t, k, redacted FROM documents JOIN personal ON doc_id % {len(PERSONAL)} = k)"

# --- text functions ---


@query(f"""WITH {_S}, {_D}, {_E}, {_DOCS} SELECT doc_id, coalesce((SELECT string_agg(name, ',' ORDER BY strpos(doc.t, w)) FROM drugs WHERE drugs.k = doc.k), '') AS drugs, coalesce((SELECT string_agg(lower(w), ',' ORDER BY strpos(doc.t, w)) FROM symptoms WHERE symptoms.k = doc.k), '') AS symptoms,
  coalesce((SELECT string_agg(name, ',' ORDER BY strpos(doc.t, w)) FROM symptoms WHERE symptoms.k = doc.k), '') AS canonical, trigger FROM doc""")
def lexicon_names(spark, sf_dir):
    t, flat = F.col("text"), lambda c, name: F.array_join(c, ",").alias(name)
    return _sentences(spark, sf_dir).select("doc_id", flat(text.drugs(t), "drugs"), flat(text.symptoms(t), "symptoms"), flat(text.symptoms(t, canonical=True), "canonical"), text.has_trigger(t).alias("trigger"))


@query(f"""WITH {_S}, {_D}, {_E}, {_DOCS}, e AS (SELECT k, 'DRUG' AS type, w, name, c FROM drugs UNION ALL SELECT k, 'SYMPTOM', w, lower(w), 0.8 FROM symptoms UNION ALL SELECT k, 'ADR_EVENT', w, lower(w), 0.85 FROM symptoms WHERE k IN (SELECT k FROM drugs) AND k IN (SELECT k FROM said WHERE trigger))
SELECT doc_id, type, w AS text, CAST(strpos(t, w) - 1 AS INTEGER) AS "start", CAST(strpos(t, w) - 1 + length(w) AS INTEGER) AS "end", name AS normalized, CAST(c AS DOUBLE) AS confidence FROM doc JOIN e ON doc.k = e.k""")
def entity_spans(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", F.explode(extract.ner_entities("text")["entities"]).alias("e")).select("doc_id", "e.*").withColumn("confidence", F.round("confidence", 3))


@query(f"WITH {_S}, {_D}, {_E}, {_DOCS} SELECT drugs.name AS drug, lower(symptoms.w) AS event, count(DISTINCT doc_id) AS n, count(DISTINCT source) AS sources FROM doc JOIN drugs ON doc.k = drugs.k JOIN symptoms ON doc.k = symptoms.k GROUP BY ALL")
def drug_event_pairs(spark, sf_dir):
    rows = _sentences(spark, sf_dir).select("doc_id", "source", F.explode(extract.ner_entities("text")["pairs"]).alias("p")).select("doc_id", "source", "p.*")
    return rows.groupBy("drug", "event").agg(F.count_distinct("doc_id").alias("n"), F.count_distinct("source").alias("sources"))


@query(f"WITH {_S}, {_DOCS} SELECT doc_id, label, score, trigger AS has_adr_trigger, negated FROM doc")
def sentiment_labels(spark, sf_dir):
    mood = _sentences(spark, sf_dir).select("doc_id", extract.sentiment_of("text").alias("s"))
    return mood.select("doc_id", "s.label", "s.score", "s.has_adr_trigger", F.array_join(F.array_sort("s.negated"), ",").alias("negated"))


@query(f"WITH {_S}, {_DOCS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'negative' ELSE label END AS label, doc_id % 3 = 0 OR label = 'adverse' AS adverse FROM doc")
def label_fallback(spark, sf_dir):
    rows = _sentences(spark, sf_dir).withColumn("stored", F.when(F.col("doc_id") % 3 == 0, "negative").when(F.col("doc_id") % 3 == 1, ""))
    label = jobs.labels("stored", "text")
    return rows.select("doc_id", label.alias("label"), jobs.adverse_label(label).alias("adverse"))


@query(f"WITH {_S}, {_D}, {_E}, {_DOCS} SELECT doc_id FROM doc WHERE source IN ('src1', 'src3') OR contains(lower(t), 'weather') OR k IN (SELECT k FROM drugs UNION SELECT k FROM symptoms)")
def relevance_gate(spark, sf_dir):
    connector = F.when(F.col("source") == "src1", "rss").when(F.col("source") == "src3", "openfda").otherwise("reddit")
    return _sentences(spark, sf_dir).where(text.relevant(F.col("text"), connector, ["WEATHER"])).select("doc_id")


@query(f"""WITH {_P}, {_H}, {_PDOCS} SELECT doc_id, kind AS type, w AS match, CAST(strpos(t, w) - 1 AS INTEGER) AS "start", CAST(strpos(t, w) - 1 + length(w) AS INTEGER) AS "end", CAST(c AS DOUBLE) AS confidence FROM doc JOIN hits ON doc.k = hits.k""")
def pii_spans(spark, sf_dir):
    return _dealt(spark, sf_dir, [p[0] for p in PERSONAL]).select("doc_id", F.explode(extract.pii_detect("text")).alias("h")).select("doc_id", "h.*")


@query(f"WITH {_P}, {_PDOCS} SELECT doc_id, redacted AS text_redacted FROM doc")
def pii_redacted(spark, sf_dir):
    return _dealt(spark, sf_dir, [p[0] for p in PERSONAL]).select("doc_id", extract.pii_redact("text").alias("text_redacted"))


@query(f"""WITH {_P}, {_H}, {_PDOCS}, want AS (SELECT kind, count(*) AS expected FROM doc JOIN hits ON doc.k = hits.k GROUP BY kind UNION ALL SELECT 'PIN_IN', count(*) FROM doc WHERE k = 6), have AS (SELECT kind, count(*) AS found FROM doc JOIN hits ON doc.k = hits.k GROUP BY kind)
SELECT kind AS type, expected, coalesce(found, 0) AS found, round(least(1.0, coalesce(found, 0) / expected), 3) AS recall FROM want LEFT JOIN have USING (kind)""")
def pii_recall(spark, sf_dir):
    """Recall by kind; of the last sentence a code is expected that isn't one."""
    kinds = [[h[1] for h in HITS if h[0] == k] for k in range(len(PERSONAL) - 1)] + [["PIN_IN"]]
    of = F.element_at(F.array(*(F.array(*map(F.lit, own)) for own in kinds)), (F.col("doc_id") % len(PERSONAL) + 1).cast("int"))
    return evaluate.recall(_dealt(spark, sf_dir, [p[0] for p in PERSONAL]).withColumn("expected", of))


# Keyword, and the terms that it stands for.
_TERMS = [
    ("cough", "user", "cough"), ("cough", "dict", "khansi"), ("cough", "dict", "coughing"), ("Crocin", "user", "Crocin"), ("Crocin", "dict", "paracetamol"), ("telmisartan", "user", "telmisartan"), ("telmisartan", "dict", "telma"), ("telmisartan", "dict", "telma 40"),
    ("khujli", "user", "khujli"), ("khujli", "dict", "rash"), ("khujli", "dict", "daane"), ("khujli", "dict", "skin rash"), ("khujli", "dict", "hives"), ("khujli", "dict", "itching"),
]


@query(f"WITH {_values('terms', 'keyword, source, term', _TERMS)} SELECT term, count(DISTINCT doc_id) AS n FROM terms LEFT JOIN (WITH {_S}, {_DOCS} SELECT * FROM doc) d ON contains(lower(t), lower(term)) GROUP BY term")
def keyword_union(spark, sf_dir):
    """Records by term of an expanded keyword list, terms that none has included."""
    terms = keywords.expand(dict.fromkeys(t[0] for t in _TERMS))
    hits = _sentences(spark, sf_dir).select(F.explode(text.keyword_hits(F.col("text"), terms)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(t,) for t in terms], "term string").join(hits, "term", "left").fillna(0, ["n"])


# Misspelt name, the nearest names.
_NEAR = [("nausae", "nausea"), ("vomitting", "vomiting"), ("headach", "headache"), ("zzz", "")]


@query(f"WITH {_values('near', 'k, term, found', [(k, *n) for k, n in enumerate(_NEAR)])} SELECT doc_id, term, found FROM documents JOIN near ON doc_id % {len(_NEAR)} = k")
def fuzzy_names(spark, sf_dir):
    rows = _dealt(spark, sf_dir, [n[0] for n in _NEAR])
    return rows.select("doc_id", F.col("text").alias("term"), F.coalesce(F.get(extract.fuzzy_neighbours("text"), F.lit(0)), F.lit("")).alias("found"))


# --- readers ---

_AT = "strftime(posted_at, '%Y-%m-%d %H:%M:%S')"


def _read(rows):
    return rows.select("external_id", "url", "text", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"), "author_handle", "language_hint", "source_kind")


def _now():
    return F.lit(NOW)


@query("""SELECT 'wa:' || coalesce(CASE WHEN turn > 0 THEN conv_id || '-' || turn END, substr(sha1(text), 1, 12)) AS external_id, NULL AS url, text, CASE WHEN turn % 2 = 0 THEN '2024-01-01 05:30:00' ELSE '2024-01-20 00:00:00' END AS posted_at, role AS author_handle, 'hi-en' AS language_hint, 'whatsapp' AS source_kind FROM conversations WHERE trim(text) <> ''""")
def whatsapp_rows(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select(F.when(F.col("turn") > 0, F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("id"), F.col("role").alias("from"), F.when(F.col("turn") % 2 == 0, "2024-01-01T05:30:00+00:00").otherwise("none").alias("ts"), F.lit("hi-en").alias("lang"), "text")
    return _read(feeds.whatsapp_records(rows, _now()))


@query("""SELECT 'x:' || doc_id AS external_id, 'https://x.example/' || doc_id AS url, text, '2024-01-02 03:04:05' AS posted_at, source AS author_handle, lang AS language_hint, 'x' AS source_kind FROM documents WHERE doc_id % 5 <> 0""")
def x_rows(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    rows = _t(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 5 != 0, key).alias("id"), F.col("source").alias("author"), F.lit("2024-01-02T03:04:05Z").alias("created_at"), "lang", "text", F.concat(F.lit("https://x.example/"), key).alias("url"))
    return _read(feeds.x_records(rows, _now()))


@query("""SELECT 'faers:' || l_orderkey || '-' || l_linenumber AS external_id, NULL AS url, 'Drug: ' || p_name || chr(10) || 'Reaction: ' || l_returnflag || chr(10) || 'Narrative: ' AS text, CASE WHEN l_linenumber = 2 THEN '2024-01-20 00:00:00' ELSE strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d 00:00:00') END AS posted_at, NULL AS author_handle, NULL AS language_hint, 'faers' AS source_kind
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def faers_rows(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    day = F.when(F.col("l_linenumber") == 1, F.date_format("l_shipdate", "yyyyMMdd")).when(F.col("l_linenumber") == 2, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = items.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("PRIMARYID"), F.col("p_name").alias("drugname"), F.col("l_returnflag").alias("pt"), day.alias("event_dt"))
    return _read(feeds.faers_records(rows, _now()))


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderdate, list(p_name ORDER BY l_linenumber, p_name) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT 'openfda:' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ':2' ELSE '' END AS external_id, NULL AS url, 'Adverse event report (' || CASE WHEN o_orderstatus = 'F' THEN 'serious' ELSE 'non-serious' END || '). Drug: ' || array_to_string(d, ', ') || '. Reaction: RASH.' AS text,
  strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS posted_at, NULL AS author_handle, NULL AS language_hint, 'openfda' AS source_kind FROM r WHERE o_orderstatus <> 'P'""")
def openfda_rows(spark, sf_dir):
    """Reports of orders, with a drug for each item; those of one status have no reaction."""
    items = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    drugs = items.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda x: F.struct(x["p_name"].alias("medicinalproduct"))).alias("drug"))  # items of one order
    o = _t(spark, sf_dir, "orders").join(drugs, F.col("o_orderkey") == F.col("l_orderkey"))
    reaction = F.when(F.col("o_orderstatus") == "P", F.array(F.struct(F.lit("").alias("reactionmeddrapt")))).otherwise(F.array(F.struct(F.lit(" RASH ").alias("reactionmeddrapt"))))
    reports = o.select(F.col("o_orderkey").cast("string").alias("safetyreportid"), F.when(F.col("o_orderkey") % 2 == 0, "2").alias("safetyreportversion"), F.lit(None).cast("string").alias("occurcountry"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("2").alias("serious"), F.date_format("o_orderdate", "yyyyMMdd").alias("receiptdate"), F.lit(None).cast("string").alias("transmissiondate"), F.struct("drug", reaction.alias("reaction")).alias("patient"))
    return _read(feeds.openfda_records(reports, _now()))


@query("""SELECT 'rss:' || item_id AS external_id, 'https://news.example/' || item_id AS url, 'Item ' || item_id || chr(10) || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, CASE WHEN item_id % 2 = 0 THEN '2024-01-02 10:00:00' ELSE '2024-01-03 04:30:00' END AS posted_at, NULL AS author_handle, 'en' AS language_hint, 'rss' AS source_kind FROM benchmark""")
def rss_rows(spark, sf_dir):
    key = F.col("item_id").cast("string")
    rows = _t(spark, sf_dir, "benchmark").select(key.alias("guid"), F.lit(None).cast("string").alias("id"), F.concat(F.lit("Item "), key).alias("title"), F.concat(F.lit("https://news.example/"), key).alias("link"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("description"), F.lit(None).cast("string").alias("summary"), F.when(F.col("item_id") % 2 == 0, "Tue, 2 Jan 2024 10:00:00 GMT").alias("pubDate"), F.lit(None).cast("string").alias("published"), F.when(F.col("item_id") % 2 == 1, "2024-01-03T10:00:00+05:30").alias("updated"), F.lit(None).cast("string").alias("author"))
    return _read(feeds.rss_records(rows, _now(), "en"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) AS nth FROM documents)
SELECT 'reddit:' || doc_id AS external_id, 'https://www.reddit.com/r/' || source || '/' || doc_id AS url, 'Post ' || doc_id || chr(10) || chr(10) || lang AS text, strftime(TIMESTAMP '2024-01-01' + to_seconds(n_chars), '%Y-%m-%d %H:%M:%S') AS posted_at, source AS author_handle, NULL AS language_hint, 'reddit' AS source_kind FROM r WHERE nth <= 100 // (SELECT count(DISTINCT source) FROM documents)""")
def reddit_rows(spark, sf_dir):
    """The newest posts of each of the subreddits that share a total of 100."""
    docs, key = _t(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    rows = docs.select(F.col("source").alias("sub"), key.alias("id"), F.concat(F.lit("Post "), key).alias("title"), F.col("lang").alias("selftext"), F.concat_ws("/", F.lit("/r"), "source", key).alias("permalink"), F.col("source").alias("author"), (F.lit(1_704_067_200) + F.col("n_chars")).cast("double").alias("created_utc"))
    return _read(feeds.reddit_records(rows, docs.agg(F.count_distinct("source")).first()[0], 100))


@query("""SELECT 'reddit:p' || conv_id || ':c:' || turn AS external_id, NULL AS url, text, '2024-01-01 00:00:00' AS posted_at, role AS author_handle, NULL AS language_hint, 'reddit' AS source_kind FROM conversations WHERE turn > 0 AND text <> ''""")
def reddit_comment_rows(spark, sf_dir):
    """Each conversation's turns as a thread of replies, two deep."""
    c = _t(spark, sf_dir, "conversations").where("turn > 0 AND text <> ''")
    node = F.struct(F.lit("t1").alias("kind"), F.struct(F.col("turn").cast("string").alias("id"), F.col("text").alias("body"), F.col("role").alias("author"), F.lit(1_704_067_200).alias("created_utc")).alias("data"))
    by = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", node.alias("n")))).alias("all"))  # turns of one conversation
    top = F.transform("all", lambda x: x["n"])
    return _read(feeds.comment_records(by.select(F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("post_id"), F.to_json(F.struct(F.struct(top.alias("children")).alias("data"))).alias("thread"))))


@query(r"""WITH l AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS href FROM pages)
SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://[^/]*') || href AS link FROM l WHERE starts_with(href, '/')""")
def html_links(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(html.link_column()("url", "html")).alias("link"))


@query("""SELECT d.c_custkey, greatest(TIMESTAMP '1998-07-03', coalesce(mark, TIMESTAMP '1998-07-03')) AS since FROM (SELECT c_custkey, max(o_orderdate) AS mark FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) d""")
def effective_since(spark, sf_dir):
    """Where a window of the last 30 days starts for each source, by its watermark."""
    window, now = TimeWindow(lookback_days=30), datetime(1998, 8, 2, tzinfo=timezone.utc)
    marks = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("timestamp_ntz").alias("mark"))
    return _t(spark, sf_dir, "customer").select("c_custkey").join(marks, "c_custkey", "left").select("c_custkey", window.start(now, F.col("mark")).alias("since"))


# --- ingestion and log ---


@query(f"""WITH b AS (SELECT doc_id, doc_id % 3 = 0 AS first_run, {_HASH} AS h, CAST(doc_id // 2 AS VARCHAR) AS ext FROM documents), one AS (SELECT * FROM b WHERE first_run QUALIFY row_number() OVER (PARTITION BY ext ORDER BY doc_id) = 1), a AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1),
two AS (SELECT * FROM b WHERE NOT first_run QUALIFY row_number() OVER (PARTITION BY ext ORDER BY doc_id) = 1), c AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1),
n AS (SELECT (SELECT count(*) FROM b WHERE first_run) AS f1, (SELECT count(*) FROM a) AS i1, (SELECT count(*) FROM b WHERE NOT first_run) AS f2, (SELECT count(*) FROM c WHERE ext NOT IN (SELECT ext FROM a) AND h NOT IN (SELECT h FROM a)) AS i2)
SELECT 1 AS run, f1 AS fetched, i1 AS inserted, f1 - i1 AS duplicates, i1 AS stored, f1 AS last_fetched FROM n UNION ALL SELECT 2, f2, i2, f2 - i2, i1 + i2, f2 FROM n UNION ALL SELECT 3, f2, 0, f2, i1 + i2, f2 FROM n""")
def ingest_totals(spark, sf_dir):
    """Two batches into a store, and the second again."""
    from ..store import Store

    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.lit(1).cast("long").alias("source_id"), F.expr("CAST(doc_id DIV 2 AS STRING)").alias("external_id"), text.content_hash(F.col("text")).alias("content_hash"), at.alias("posted_at"), F.lit(NOW).alias("ingested_at"), "text")
    from ..schemas import TABLES

    have = {"source_id", "external_id", "content_hash", "posted_at", "ingested_at"}
    rows = docs.select("doc_id", *((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["records"].fields if f.name != "id"))
    out = []
    for run, batch in ((1, rows.where("doc_id % 3 = 0")), (2, rows.where("doc_id % 3 <> 0")), (3, rows.where("doc_id % 3 <> 0"))):
        told = ingest.store_batch(store, batch.drop("doc_id"), 1, NOW)
        out.append((run, told["fetched"], told["inserted"], told["duplicates"], store.table("records").count(), store.table("watermarks").first()["last_fetched"]))
    return spark.createDataFrame(out, "run int, fetched long, inserted long, duplicates long, stored long, last_fetched long")


_EVENTS = [("2024-01-01T00:00:00", "runner", "run.start", "p1", {"sources": 2}), ("2024-01-01T00:00:01", "runner", "source.error", "feed", {"error": "é"}), ("2024-01-01T00:00:02", "signals", "signals.computed", None, {})]
_BODIES = ["2024-01-01T00:00:00|runner|run.start|p1|{\"sources\": 2}", "2024-01-01T00:00:01|runner|source.error|feed|{\"error\": \"é\"}", "2024-01-01T00:00:02|signals|signals.computed||{}"]


@query(f"""WITH a AS (SELECT sha256('|{_BODIES[0]}') AS h1), b AS (SELECT h1, sha256(h1 || '|{_BODIES[1]}') AS h2 FROM a), c AS (SELECT *, sha256(h2 || '|{_BODIES[2]}') AS h3 FROM b)
SELECT 1 AS id, '' AS prev_hash, h1 AS hash, 'run.start' AS action, true AS ok FROM c UNION ALL SELECT 2, h1, h2, 'source.error', true FROM c UNION ALL SELECT 3, h2, h3, 'signals.computed', true FROM c""")
def audit_append(spark, sf_dir):
    """Three events after none, the last after the others; with what verifying says of each."""
    from ..schemas import TABLES

    log = audit.append(spark.createDataFrame([], TABLES["audit_log"]), _EVENTS[:2])
    log = log.unionByName(audit.append(log, _EVENTS[2:]))
    return audit.checked(audit.tail(log, 20)).select(F.col("id").cast("int").alias("id"), F.coalesce("prev_hash", F.lit("")).alias("prev_hash"), "hash", "action", "ok")
