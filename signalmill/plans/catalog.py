"""The registered queries: each applies an operator to whole driver tables in the roles of the domain's, with its SQL twin.

Roles: documents are records (source: connector), lineitem with part the drug-event pairs of records, orders run history, customers
and nations sources, regions projects, events a feed, conversations threads, pages web pages.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, changes, timeline
from ..operators import disproportionality as dp

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import read_queries, source_queries, stream_queries, text_queries  # noqa: F401  (they register theirs)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Stand-ins for drug and symptom names, of words that the test texts have.
DRUGS, EVENTS, KEYWORDS = ["ha", "er", "th", "re"], ["tion", "ing"], ["The", "tion", "êtr", "ung", "zzz"]
NOW = datetime(2024, 1, 20)
_MIX = {"negative": ("error", "refund", "signup"), "neutral": ("view",), "positive": ("purchase",)}

# --- pairs and statistics ---


def brand_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    event = F.concat_ws("-", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    return dp.distinct_pairs(rows.withColumn("event", event), "l_orderkey", "p_brand", "event")


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.concat_ws("-", "l_returnflag", F.col("l_linenumber").cast("string"))
    return dp.distinct_pairs(_t(spark, sf_dir, "lineitem").withColumn("event", event), "l_orderkey", "l_partkey", "event")


_CELLS = """de AS (SELECT drug, event, count(*) AS a FROM pairs GROUP BY drug, event),
dt AS (SELECT drug, count(*) AS dn FROM pairs GROUP BY drug),
et AS (SELECT event, count(*) AS en FROM pairs GROUP BY event),
tot AS (SELECT count(*) AS n FROM pairs),
cell AS (SELECT de.drug, de.event, a, dn - a AS b, en - a AS c, greatest(0, n - dn - en + a) AS d, n FROM de JOIN dt ON de.drug = dt.drug JOIN et ON de.event = et.event CROSS JOIN tot),
adj AS (SELECT *, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS k, CAST(a + b AS DOUBLE) * (a + c) / n AS e FROM cell),
stat AS (SELECT drug, event, a AS n, round(((a + k) / (a + k + b + k)) / ((c + k) / (c + k + d + k)), 3) AS prr, round(power(abs(a - e) - 0.5, 2) / e, 3) AS chi2,
  round(power(greatest(0, abs(a - e) - 0.5), 2) / e, 3) AS chi2_floored, round(log2((a + 0.5) / (e + 0.5)), 3) AS ic, round((a + k) * (d + k) / ((b + k) * (c + k)), 3) AS ror, b, c, d FROM adj WHERE a >= 3)"""
_BRAND = """WITH pairs AS (SELECT DISTINCT l_orderkey AS rec, p_brand AS drug, concat(l_returnflag, '-', l_linestatus, '-', CAST(l_linenumber AS VARCHAR)) AS event FROM lineitem JOIN part ON l_partkey = p_partkey),
""" + _CELLS
_PART = """WITH pairs AS (SELECT DISTINCT l_orderkey AS rec, l_partkey AS drug, concat(l_returnflag, '-', CAST(l_linenumber AS VARCHAR)) AS event FROM lineitem),
""" + _CELLS
_SCORE = "CAST(greatest(20, least(99, round(35 + 12 * ln(greatest(prr, 1.0)) + 8 * ln(greatest(n, 1))))) AS INTEGER)"
_TIER = "CASE WHEN prr >= 3 AND n >= 5 AND chi2 >= 4 THEN {} WHEN prr >= 2 AND n >= 3 AND chi2 >= 4 THEN {} ELSE {} END"


@query(_BRAND + " SELECT drug, event, n, prr, chi2, ic FROM stat")
def disproportionality(spark, sf_dir):
    return dp.compute(brand_pairs(spark, sf_dir)).drop("ror", "is_signal")


@query(_PART + " SELECT drug, event, n, ror, chi2_floored, b, c, d FROM stat")
def ror(spark, sf_dir):
    s = dp.with_statistics(dp.cells(dp.marginals(part_pairs(spark, sf_dir))).where("a >= 3"))
    return s.select("drug", "event", F.col("a").alias("n"), F.round("ror", 3).alias("ror"), F.round("chi2_floored", 3).alias("chi2_floored"), "b", "c", "d")


@query(_PART + f""" SELECT drug, event, n, prr, chi2, {_TIER.format("'STRONG'", "'MODERATE'", "'EXPLORATORY'")} AS tier,
  CASE WHEN prr >= 3 AND n >= 5 THEN 'ESCALATED' WHEN prr >= 2 THEN 'PENDING' WHEN prr < 1 THEN 'DISMISSED' ELSE 'REVIEWED' END AS status,
  CASE WHEN prr >= 3 THEN 'red' WHEN prr >= 2 THEN 'amber' ELSE 'blue' END AS colour, CASE WHEN prr >= 1000 THEN '≥ 1000' WHEN prr <= 0 THEN '0.00' ELSE printf('%.2f', prr) END AS prr_text FROM stat""")
def triage_tiers(spark, sf_dir):
    s, (p, n, x) = dp.compute(part_pairs(spark, sf_dir)), map(F.col, ("prr", "n", "chi2"))
    return s.select("drug", "event", "n", "prr", "chi2", dp.tier(p, n, x).alias("tier"), dp.status(p, n).alias("status"), dp.colour(p).alias("colour"), dp.ratio_text(p).alias("prr_text"))


@query(_PART + f""" SELECT drug, event, n, {_SCORE} AS confidence, {_TIER.format("'HIGH'", "'MEDIUM'", "'LOW'")} AS label,
  CASE WHEN prr >= 3 AND n >= 5 THEN 'High' WHEN prr >= 2 THEN 'Medium' ELSE 'Low' END AS strength,
  CASE WHEN prr >= 3 AND n >= 5 THEN least(99, {_SCORE}) WHEN prr >= 2 THEN least(85, {_SCORE}) ELSE {_SCORE} END AS strength_pct FROM stat""")
def confidence_score(spark, sf_dir):
    s, (p, n, x) = dp.compute(part_pairs(spark, sf_dir)), map(F.col, ("prr", "n", "chi2"))
    score = dp.confidence(p, n)
    label, pct = dp.strength(p, n, score)
    return s.select("drug", "event", "n", score.alias("confidence"), dp.confidence_label(p, n, x).alias("label"), label.alias("strength"), pct.alias("strength_pct"))


@query(_BRAND.rsplit("tot AS", 1)[0] + "tot AS (SELECT count(*) AS n FROM pairs) SELECT de.drug, de.event, a, dn AS drug_total, en AS event_total, n AS total FROM de JOIN dt ON de.drug = dt.drug JOIN et ON de.event = et.event CROSS JOIN tot")
def pair_marginals(spark, sf_dir):
    m = dp.marginals(brand_pairs(spark, sf_dir))
    return m.select("drug", "event", "a", *(F.col(c).cast("long").alias(c) for c in ("drug_total", "event_total", "total")))


@query("""WITH h AS (SELECT o_custkey AS drug, o_orderpriority AS event, year(o_orderdate) AS run, CAST(count(*) AS DOUBLE) AS prr FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS nth, lead(prr) OVER w AS previous, min(run) OVER (PARTITION BY drug, event) AS first_detected FROM h WINDOW w AS (PARTITION BY drug, event ORDER BY run DESC))
SELECT drug, event, run, prr, previous, first_detected, CASE WHEN previous IS NULL THEN 'NEW' WHEN prr > previous * 1.05 THEN 'UP' WHEN prr < previous * 0.95 THEN 'DOWN' ELSE 'STABLE' END AS trend FROM r WHERE nth = 1""")
def signal_trend(spark, sf_dir):
    runs = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("drug"), F.col("o_orderpriority").alias("event"), F.year("o_orderdate").cast("long").alias("run")).agg(F.count("*").cast("double").alias("prr"))
    return dp.trend(runs, ["drug", "event"], order=["run"])


@query(_PART + f""", v AS (SELECT drug, event, n, prr, {_TIER.format("'STRONG'", "'MODERATE'", "'EXPLORATORY'")} AS tier FROM stat)
SELECT drug, event, n, prr, tier FROM v WHERE tier IN ('STRONG', 'MODERATE') AND n >= 5 AND contains(lower(concat_ws(' ', CAST(drug AS VARCHAR), event)), '1') AND contains(lower(concat_ws(' ', CAST(drug AS VARCHAR), event)), 'r-')""")
def triage_filter(spark, sf_dir):
    s = dp.compute(part_pairs(spark, sf_dir)).withColumn("tier", dp.tier(F.col("prr"), F.col("n"), F.col("chi2")))
    return dp.triage_filter(s, "1 R-", ["STRONG", "MODERATE"], 5, ("drug", "event")).select("drug", "event", "n", "prr", "tier")


# --- texts ---

_HASH = r"sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))"


@query(f"SELECT {_HASH} AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return changes.first_writers(docs, "content_hash", ["doc_id"], "copies").select("content_hash", F.col("doc_id").alias("first_id"), "copies")


@query(f"SELECT {_HASH} AS content_hash, count(DISTINCT source) AS n_sources, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_source_dups(spark, sf_dir):
    by = _t(spark, sf_dir, "documents").select(text.content_hash(F.col("text")).alias("content_hash"), "source").groupBy("content_hash", "source").agg(F.count("*").alias("n"))
    return by.groupBy("content_hash").agg(F.count("*").alias("n_sources"), F.sum("n").cast("long").alias("n")).where("n_sources > 1")


_EMAIL = r"[\w.+\-]+@[\w\-]+\.[\w\-.]+\b"


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_EMAIL}')) AS INTEGER) AS n FROM documents WHERE regexp_matches(text, '{_EMAIL}')")
def email_detect_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.count_pii(F.col("text"), "EMAIL").alias("n")).where("n > 0")


@query(rf"SELECT doc_id, regexp_replace(text, '{_EMAIL}', '<EMAIL>', 'g') AS text_redacted FROM documents")
def email_redact(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.redact_kind(F.col("text"), "EMAIL").alias("text_redacted"))


_TOKENS = "SELECT doc_id, source, n_chars, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents"
_IN = lambda names: ", ".join(f"'{x}'" for x in names)


@query(f"SELECT w AS name, count(*) AS mentions FROM ({_TOKENS}) WHERE w IN ({_IN(DRUGS)}) GROUP BY w")
def lexicon_mentions(spark, sf_dir):
    found = _t(spark, sf_dir, "documents").select(F.explode(text.mentions(F.col("text"), {d: d for d in DRUGS})).alias("name"))
    return found.groupBy("name").agg(F.count("*").alias("mentions"))


def document_pairs(spark, sf_dir):
    """(doc_id, source, drug, event), once a record."""
    t = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", "source", F.explode(text.pairs(text.mentions(t, {d: d for d in DRUGS}), text.mentions(t, {e: e for e in EVENTS}))).alias("p")).select("doc_id", "source", "p.drug", "p.event")


_DOC_PAIRS = f"""t AS ({_TOKENS}), pr AS (SELECT DISTINCT a.doc_id, a.source, a.w AS drug, b.w AS event FROM t a JOIN t b ON a.doc_id = b.doc_id WHERE a.w IN ({_IN(DRUGS)}) AND b.w IN ({_IN(EVENTS)}))"""


@query(f"WITH {_DOC_PAIRS} SELECT drug, event, count(*) AS n FROM pr GROUP BY drug, event")
def lexicon_pairs(spark, sf_dir):
    return document_pairs(spark, sf_dir).groupBy("drug", "event").agg(F.count("*").alias("n"))


@query(f"WITH {_DOC_PAIRS} SELECT drug, event, count(DISTINCT source) AS src_count, string_agg(DISTINCT source, ', ' ORDER BY source) AS src_names FROM pr GROUP BY drug, event")
def pair_sources(spark, sf_dir):
    by = document_pairs(spark, sf_dir).select("drug", "event", "source").distinct().groupBy("drug", "event")
    return by.agg(F.count("*").alias("src_count"), F.array_join(F.array_sort(F.collect_list("source")), ", ").alias("src_names"))


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), lower('{k}')) THEN '{k}' END" for k in KEYWORDS) + ") AS matched FROM documents")
def keyword_match(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(text.keyword_hits(F.col("text"), KEYWORDS), ",").alias("matched"))


@query(f"SELECT doc_id, {' + '.join(f'''CAST(len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z]', '  ', 'g') || ' ', ' {w} ')) AS INTEGER)''' for w in ('er', 'on', 'the'))} AS n FROM documents")
def term_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.count_terms(F.col("text"), ["er", "on", "the"]).alias("n"))


# --- feeds, timelines, watermarks ---


@query("SELECT source, count(*) AS n, CAST(round(100 * count(*) / sum(count(*)) OVER ()) AS BIGINT) AS pct, CAST(round(100 * count(*) / max(count(*)) OVER ()) AS BIGINT) AS bar_pct FROM documents GROUP BY source")
def source_breakdown(spark, sf_dir):
    return timeline.shares(_t(spark, sf_dir, "documents"), "source")


_DAYS = """c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL),
e AS (SELECT event_type, min(day) AS a, max(day) AS b, greatest(0, 13 - (max(day) - min(day))) AS pad FROM c GROUP BY event_type),
s AS (SELECT event_type, unnest(generate_series(CAST(a - CAST(pad // 2 AS INTEGER) AS TIMESTAMP), CAST(b + CAST(pad - pad // 2 AS INTEGER) AS TIMESTAMP), INTERVAL 1 DAY)) AS t FROM e),
tl AS (SELECT s.event_type, CAST(t AS DATE) AS day, coalesce(n, 0) AS n FROM s LEFT JOIN c ON s.event_type = c.event_type AND CAST(t AS DATE) = c.day)"""


def event_timeline(spark, sf_dir):
    return timeline.timeline(_t(spark, sf_dir, "events"), F.col("ts"), "event_type")


@query(f"WITH {_DAYS} SELECT event_type, day, n FROM tl")
def daily_timeline_spine(spark, sf_dir):
    return event_timeline(spark, sf_dir)


@query(f"""WITH {_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS nth, count(*) OVER (PARTITION BY event_type) // 2 AS half FROM tl),
m AS (SELECT event_type, coalesce(avg(n) FILTER (nth <= half), 0) AS base_avg, coalesce(avg(n) FILTER (nth > half), 0) AS recent_avg FROM r GROUP BY event_type)
SELECT event_type, base_avg, recent_avg, CAST(CASE WHEN base_avg > 0 THEN round(100 * (recent_avg - base_avg) / base_avg) WHEN recent_avg > 0 THEN 100 ELSE 0 END AS BIGINT) AS growth_pct FROM m""")
def halves_growth(spark, sf_dir):
    return timeline.halves_growth(event_timeline(spark, sf_dir), "event_type")


_GROUP = " ".join(f"WHEN event_type IN ({_IN(of)}) THEN '{name}'" for name, of in _MIX.items())


@query(f"""WITH g AS (SELECT user_id, {', '.join(f"count(*) FILTER (event_type IN ({_IN(of)})) AS {n}" for n, of in _MIX.items())} FROM events GROUP BY user_id)
SELECT *, {', '.join(f"CAST(round(100 * {n} / greatest(1, negative + neutral + positive)) AS BIGINT) AS {n}_pct" for n in _MIX)} FROM g""")
def label_mix(spark, sf_dir):
    return timeline.label_mix(_t(spark, sf_dir, "events"), "event_type", "user_id", mix=_MIX)


@query(f"""WITH {_DAYS.replace('event_type', "'all'").replace("SELECT 'all', CAST(ts", "SELECT 'all' AS k, CAST(ts").replace("GROUP BY 'all'", "GROUP BY k").replace("SELECT 'all', min", "SELECT k, min").replace("SELECT 'all', unnest", "SELECT k, unnest").replace("s.'all'", "s.k").replace("c.'all'", "c.k")},
g AS (SELECT CAST(ts AS DATE) AS day, CASE {_GROUP} ELSE 'neutral' END AS g FROM events)
SELECT tl.day, {', '.join(f"count(*) FILTER (g = '{n}') AS {n}" for n in _MIX)} FROM tl LEFT JOIN g ON tl.day = g.day GROUP BY tl.day""")
def trajectory_pivot(spark, sf_dir):
    return timeline.trajectory(_t(spark, sf_dir, "events"), F.col("ts"), "event_type", mix=_MIX)


@query("SELECT user_id, max(ts) AS last_seen_ts, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS last_seen_id, count(*) AS n FROM events GROUP BY user_id")
def watermark_highwater(spark, sf_dir):
    return changes.high_water(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "last_seen_ts", "last_seen_id", "n")


@query("""WITH old AS (SELECT user_id, max(ts) AS wm FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY user_id)
SELECT e.user_id, count(*) AS n FROM events e LEFT JOIN old ON e.user_id = old.user_id WHERE ts > coalesce(wm, TIMESTAMP '2024-01-01') AND ts <= TIMESTAMP '2024-01-25' GROUP BY e.user_id""")
def incremental_since(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    old = changes.high_water(events.where("ts <= timestamp_ntz'2024-01-15'"), "user_id", "ts", "event_id").select("user_id", F.col("last_seen_ts").alias("wm"))
    fresh = events.join(old, "user_id", "left").where("ts > coalesce(wm, timestamp_ntz'2024-01-01') AND ts <= timestamp_ntz'2024-01-25'")
    return fresh.groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH batch AS (SELECT doc_id, source, 'x' || CAST(doc_id // 2 AS VARCHAR) AS ext, """ + _HASH + """ AS h FROM documents WHERE doc_id % 3 <> 0), stored AS (SELECT 'x' || CAST(doc_id // 2 AS VARCHAR) AS ext, source, """ + _HASH + """ AS h FROM documents WHERE doc_id % 3 = 0),
one AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY source, ext ORDER BY doc_id) = 1),
two AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1)
SELECT doc_id FROM two WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source = two.source AND s.ext = two.ext) AND h NOT IN (SELECT h FROM stored)""")
def anti_new_records(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), F.concat(F.lit("x"), F.expr("CAST(doc_id DIV 2 AS STRING)")).alias("external_id"), text.content_hash(F.col("text")).alias("content_hash"))
    return changes.new_records(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0"), ["doc_id"]).select("doc_id")


@query("""WITH w AS (SELECT o_custkey, max(o_orderdate) AS last_run FROM orders GROUP BY 1)
SELECT c_custkey FROM customer LEFT JOIN w ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE c_acctbal >= 0 AND n_regionkey <> 2 AND (last_run IS NULL OR date_diff('second', last_run, TIMESTAMP '1998-08-03') >= CASE WHEN c_mktsegment = 'BUILDING' THEN 300 WHEN c_mktsegment = 'MACHINERY' THEN 604800 ELSE 86400 END)""")
def due_sources(spark, sf_dir):
    latency = F.when(F.col("c_mktsegment") == "BUILDING", "real_time").when(F.col("c_mktsegment") == "MACHINERY", "weekly").otherwise("daily")
    sources = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"), (F.col("c_acctbal") >= 0).alias("enabled"), latency.alias("latency"))
    projects = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 2, "paused").otherwise("running").alias("status"), F.lit("daily").alias("cadence"))
    marks = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source_id")).agg(F.max("o_orderdate").alias("last_run_at"))
    return changes.due(sources, projects, marks.withColumn("last_run_at", F.col("last_run_at").cast("timestamp")), F.lit("1998-08-03").cast("timestamp")).select(F.col("id").alias("c_custkey"))


_CLASS = "CASE WHEN NOT enabled THEN 'PAUSED' WHEN last_run IS NULL THEN 'PENDING' WHEN last_run < TIMESTAMP '1998-08-01' THEN 'STALE' WHEN stored = 0 THEN 'EMPTY' WHEN inserted = 0 THEN 'IDLE' ELSE 'HEALTHY' END"
_SOURCES = """src AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal >= 0 AS enabled, last_run, coalesce(inserted, 0) AS inserted, coalesce(stored, 0) AS stored FROM customer LEFT JOIN
  (SELECT o_custkey, max(o_orderdate) AS last_run, count(*) FILTER (o_totalprice > 200000) AS inserted, count(*) AS stored FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


def customer_sources(spark, sf_dir):
    runs = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_run"), F.count_if(F.col("o_totalprice") > 200000).alias("inserted"), F.count("*").alias("stored"))
    rows = _t(spark, sf_dir, "customer").withColumn("enabled", F.col("c_acctbal") >= 0).join(runs, "c_custkey", "left")
    now = F.lit("1998-08-02").cast("timestamp_ntz")
    return rows.withColumn("health", changes.health(F.col("enabled"), F.col("last_run").cast("timestamp_ntz"), F.col("inserted"), F.col("stored"), now)).fillna(0, ["inserted", "stored"])


@query(f"WITH {_SOURCES} SELECT c_custkey, stored, {_CLASS} AS health FROM src")
def source_health_classify(spark, sf_dir):
    return customer_sources(spark, sf_dir).select("c_custkey", "stored", "health")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_group(spark, sf_dir):
    last = F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("r")
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(last).select("o_custkey", "r.o_orderkey", "r.o_orderdate")


@query("SELECT c_nationkey, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderpriority QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, o_orderpriority) = 1")
def mode_per_group(spark, sf_dir):
    return timeline.modes(_t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")), "o_orderpriority", "c_nationkey")


@query("SELECT source, string_agg(substr(text, 1, 140), '|' ORDER BY doc_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents) WHERE nth <= 3 GROUP BY source")
def topk_examples(spark, sf_dir):
    return dp.examples(_t(spark, sf_dir, "documents"), ["source"], "doc_id", "text").select("source", F.array_join("examples", "|").alias("examples"))


@query("""SELECT event_id AS id, strftime(ts, '%H:%M:%S') AS time, event_type AS "user", 'EVT-' || lpad(CAST(event_id AS VARCHAR), CAST(greatest(3, length(CAST(event_id AS VARCHAR))) AS INTEGER), '0') AS trace FROM events
WHERE event_type NOT ILIKE 'VIEW%' AND event_type NOT ILIKE '%UP' ORDER BY event_id DESC LIMIT 8""")
def not_like_tail(spark, sf_dir):
    log = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("actor"), F.lit("run.start").alias("action"), F.col("event_type").alias("target"), F.lit("").alias("hash"))
    return audit.listed(log, 8, ("VIEW%", "%UP")).select("id", "time", "user", "trace")


# --- changes ---


@query("""WITH ch AS (SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 10000000 END AS c_custkey, 'new' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_nationkey = 1)
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ch) UNION ALL
SELECT ch.c_custkey, coalesce(c.c_name, ch.c_name), ch.c_acctbal FROM ch LEFT JOIN customer c ON ch.c_custkey = c.c_custkey""")
def upsert_merge(spark, sf_dir):
    target = _t(spark, sf_dir, "customer")
    key = F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(10_000_000)
    new = target.where("c_nationkey = 1").select(key.alias("c_custkey"), F.lit("new").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return changes.upsert(target.select(*new.columns), new, ["c_custkey"], keep=("c_name",))


@query("""WITH gone AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))
SELECT 'projects' AS name, count(*) AS n FROM region WHERE r_regionkey NOT IN (1, 3) UNION ALL SELECT 'sources', count(*) FROM nation WHERE n_regionkey NOT IN (1, 3) UNION ALL
SELECT 'records', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT * FROM gone) UNION ALL SELECT 'watermarks', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT * FROM gone) UNION ALL
SELECT 'signals', count(*) FROM nation WHERE n_regionkey NOT IN (1, 3)""")
def cascade_delete(spark, sf_dir):
    tables = {
        "projects": _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id")), "sources": _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("project_id")), "records": _t(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "source_id"),
        "watermarks": _t(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "source_id"), "signals": _t(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "project_id"),
    }
    left = changes.cascade(tables, tables["projects"].where("id IN (1, 3)"))
    out = None
    for name, df in left.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S'), event_type, 'run.start', '', props) AS body FROM events),
c AS (SELECT user_id, CAST(0 AS BIGINT) AS k, '' AS hash FROM e GROUP BY user_id UNION ALL SELECT c.user_id, e.k, sha256(c.hash || '|' || e.body) FROM c JOIN e ON c.user_id = e.user_id AND e.k = c.k + 1)
SELECT user_id, arg_max(hash, k) AS hash, max(k) AS n FROM c GROUP BY user_id""")
def audit_chain(spark, sf_dir):
    return audit.chain(event_log(spark, sf_dir).withColumn("user_id", F.col("user_id")), "user_id", "id")


def event_log(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("actor"), F.lit("run.start").alias("action"), F.lit("").alias("target"), F.col("props").alias("payload_json"))


@query("""WITH l AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN '' ELSE sha256(CAST(event_id // 10 AS VARCHAR)) END AS prev_hash, concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S'), event_type, 'run.start', '', props) AS body FROM events),
h AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'x' ELSE sha256(prev_hash || '|' || body) END AS hash FROM l),
v AS (SELECT id, prev_hash = lag(hash, 1, '') OVER (ORDER BY id) AND hash = sha256(prev_hash || '|' || body) AS ok FROM h)
SELECT bool_and(ok) AS ok, min(id) FILTER (NOT ok) AS broken_at, count(*) AS total FROM v""")
def audit_chain_verify(spark, sf_dir):
    prev = F.when(F.col("id") % 10 == 0, "").otherwise(F.sha2(F.expr("CAST(id DIV 10 AS STRING)"), 256))
    log = event_log(spark, sf_dir).withColumn("prev_hash", prev)
    return audit.verify(log.withColumn("hash", F.when(F.col("id") % 7 == 0, "x").otherwise(audit.hash_of(F.col("prev_hash")))))


@query("""SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'post' ELSE 'comment' END AS kind, 'reddit:' || CAST(conv_id AS VARCHAR) || CASE WHEN turn = 0 THEN '' ELSE ':c:' || CAST(turn AS VARCHAR) END AS external_id,
CASE WHEN turn = 0 THEN NULL ELSE 'reddit:' || CAST(conv_id AS VARCHAR) || CASE WHEN turn = 1 THEN '' ELSE ':c:' || CAST(turn // 2 AS VARCHAR) END END AS parent_id, CAST(CASE WHEN turn = 0 THEN 0 ELSE floor(log2(turn)) + 1 END AS INTEGER) AS depth FROM conversations""")
def thread_flatten(spark, sf_dir):
    from ..sources import threads

    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn")
    name = lambda t: F.concat(F.lit("reddit:"), F.col("conv_id").cast("string"), F.when(t == 0, "").otherwise(F.concat(F.lit(":c:"), t.cast("string"))))
    edges = rows.select("conv_id", "turn", name(F.col("turn")).alias("external_id"), F.when(F.col("turn") == 0, None).otherwise(name(F.expr("turn DIV 2"))).alias("parent_id"))
    flat = threads.depths(edges, "external_id", "parent_id")
    return flat.select("conv_id", "turn", F.when(F.col("depth") == 0, "post").otherwise("comment").alias("kind"), "external_id", "parent_id", "depth")


_CLEAN = r"""trim(regexp_replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(f"""WITH a AS (SELECT page_id, url, {_CLEAN.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS body FROM pages),
l AS (SELECT page_id, url, title, list_concat([body], list_transform(string_split(body, '<p>')[2:], lambda x: regexp_replace(x, '</p>.*$', '', 's'))) AS parts FROM a),
b AS (SELECT page_id, url, title, generate_subscripts(parts, 1) AS place, unnest(parts) AS x FROM l), c AS (SELECT page_id, url, title, place, {_CLEAN.format("x")} AS t FROM b),
d AS (SELECT * FROM c WHERE length(t) >= 80 QUALIFY row_number() OVER (PARTITION BY page_id, substr(t, 1, 200) ORDER BY place) = 1), e AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS INTEGER) AS nth FROM d)
SELECT page_id, nth, 'html:' || substr(sha1(url || '#' || nth || '#' || substr(t, 1, 80)), 1, 16) AS external_id, CASE WHEN title = '' THEN t ELSE title || chr(10) || chr(10) || t END AS text FROM e""")
def html_block_dedup(spark, sf_dir):
    from ..sources import html

    return html.page_blocks(_t(spark, sf_dir, "pages"), "page_id", "url", "html", unclosed=False).select("page_id", "nth", "external_id", "text")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 100 // (SELECT count(DISTINCT source) FROM documents)")
def emission_cap(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("source", "doc_id")
    return changes.emission_cap(docs, "source", [F.desc("doc_id")], 100, docs.agg(F.count_distinct("source")).first()[0])


@query("SELECT event_id FROM events WHERE ts IS NULL OR ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05' OR ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11'")
def time_window_gate(spark, sf_dir):
    from ..windows import in_any

    bounds = [(datetime(2024, 1, 3), datetime(2024, 1, 5)), (datetime(2024, 1, 10), datetime(2024, 1, 11))]
    return _t(spark, sf_dir, "events").where(in_any(F.col("ts"), bounds)).select("event_id")


# --- further joins, totals and projections ---


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(substr(text, 1, 280), 'tion', '<REDACTED_DRUG>', 'gi'), 'ent', '<u>\0</u>', 'gi') AS snippet FROM documents""")
def evidence_highlight(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.highlight(F.col("text"), F.lit("tion"), F.lit("ent")).alias("snippet"))


@query("SELECT event_type, count(*) AS n, CAST(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS total, max(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type")
def payload_fields(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.coalesce(k, F.lit(0))).alias("total"), F.max(k).alias("most"))


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey <> 3 AND s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'changed' ELSE s_name END FROM supplier WHERE s_nationkey = 3 AND s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'changed' FROM supplier WHERE s_nationkey <> 3 AND s_suppkey % 5 = 0""")
def sync_sources(spark, sf_dir):
    target = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    new = target.where("s_suppkey % 5 = 0").withColumn("s_name", F.lit("changed"))
    return changes.without_missing(changes.upsert(target, new, ["s_suppkey"]), target.where("s_suppkey % 2 = 0").select("s_suppkey"), ["s_suppkey"], F.col("s_nationkey") == 3).drop("s_nationkey")


@query("SELECT n_regionkey, min(o_orderdate) AS window_since, max(o_orderdate) AS window_until, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def window_bounds(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return timeline.bounds(rows, "o_orderdate", "n_regionkey")


@query("""SELECT l_returnflag, s_nationkey, count(*) AS n, max(l_shipdate) AS last_run, CAST(round(100 * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag)) AS BIGINT) AS pct, CAST(round(100 * count(*) / max(count(*)) OVER (PARTITION BY l_returnflag)) AS BIGINT) AS bar_pct
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY l_returnflag, s_nationkey""")
def contributing_sources(spark, sf_dir):
    evidence = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part").where("p_size > 25"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    rows = evidence.join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    last = rows.groupBy("l_returnflag", "s_nationkey").agg(F.max("l_shipdate").alias("last_run"))
    return timeline.shares(rows, "s_nationkey", of=("l_returnflag",)).join(last, ["l_returnflag", "s_nationkey"])

