"""The registered queries of the read API: reporting's functions over the driver's tables in the roles of the stored ones (roles.py)."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..operators import search, timeline
from ..streaming import ingest, jobs
from ..tables import shared_dir
from . import reporting, roles
from .catalog import _CELLS, _SCORE, _TIER, query

_W = f"WITH {roles.SQL}"
_HEALTH = """health AS (SELECT s.*, w.last_run_at, w.last_fetched, w.last_inserted, coalesce(r.n, 0) AS records_stored,
  CASE WHEN NOT enabled THEN 'PAUSED' WHEN last_run_at IS NULL THEN 'PENDING' WHEN last_run_at < TIMESTAMP '1998-08-01 12:00:00' THEN 'STALE' WHEN coalesce(r.n, 0) = 0 THEN 'EMPTY' WHEN coalesce(last_inserted, 0) = 0 THEN 'IDLE' ELSE 'HEALTHY' END AS status
  FROM sources s LEFT JOIN watermarks w ON s.id = w.source_id LEFT JOIN (SELECT source_id, count(*) AS n FROM records GROUP BY 1) r ON s.id = r.source_id)"""
_TEXT = "CASE WHEN {0} >= 1000 THEN '≥ 1000' WHEN {0} <= 0 THEN '0.00' ELSE printf('%.2f', {0}) END"
_SECONDS = "(epoch(TIMESTAMP '1998-08-02 12:00:00') - epoch({0}))"
_AGO = f"CASE WHEN {{0}} IS NULL THEN '—' WHEN {_SECONDS} < 60 THEN 'just now' " + " ".join(f"WHEN {_SECONDS} < {top} THEN CAST(CAST(floor({_SECONDS} / {unit}) AS BIGINT) AS VARCHAR) || '{name} ago'" for top, unit, name in ((3600, 60, "m"), (86400, 3600, "h"), (2592000, 86400, "d"), (31536000, 2592000, "mo"), (10**12, 31536000, "y"))) + " END"
_TYPE = "CASE connector WHEN 'reddit' THEN 'Reddit' WHEN 'openfda' THEN 'openFDA' WHEN 'rss' THEN 'RSS' WHEN 'x' THEN 'X' WHEN 'faers' THEN 'FAERS' END"
_CASES = f"""{_SCORE} AS conf, {_TIER.format("'HIGH'", "'MEDIUM'", "'LOW'")} AS conf_label, {_TIER.format("'STRONG'", "'MODERATE'", "'EXPLORATORY'")} AS tier,
  CASE WHEN prr >= 3 AND n >= 5 THEN 'ESCALATED' WHEN prr >= 2 THEN 'PENDING' WHEN prr < 1 THEN 'DISMISSED' ELSE 'REVIEWED' END AS status"""


def _now():
    return F.lit(roles.AS_OF).cast("timestamp")


def _said(name: str):
    """A time as text: the same in both engines, whatever kind of time it is."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _sql_said(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


@query(f"""{_W}, {_HEALTH}, k AS (SELECT count(*) AS sources_total, count(*) FILTER (enabled) AS sources, {", ".join(f"count(*) FILTER (enabled AND status = '{x.upper()}') AS {x}" for x in ("healthy", "stale", "empty", "idle"))} FROM health),
r AS (SELECT count(*) AS records, count(*) FILTER (tagged) AS entities, count(text_redacted) AS redacted, {", ".join(f"count(*) FILTER (sentiment_label = '{x}') AS sent_{x}" for x in ("adverse", "negative", "positive", "neutral"))}, CAST(sum(pii_hits_count) AS BIGINT) AS pii_total, count(*) FILTER (pii_hits_count > 0) AS pii_records FROM records),
g AS (SELECT bool_or(prr >= 3) AS hot, bool_or(prr < 3) AS warm, max(computed_at) AS last FROM signals WHERE n >= 3 AND prr >= 2 GROUP BY project_id, drug, event),
s AS (SELECT count(*) AS total_signals, count(*) FILTER (hot) AS signals_critical, count(*) FILTER (warm) AS signals_watch, count(*) FILTER (last >= TIMESTAMP '1998-08-01 12:00:00') AS new_signals FROM g),
p AS (SELECT count(*) AS projects, count(*) FILTER (created_at >= TIMESTAMP '1998-07-03 12:00:00') AS projects_new FROM projects)
SELECT *, signals_critical + signals_watch AS flagged_total, sent_adverse + sent_negative AS sent_concerning, printf('%.1f%%', CASE WHEN sources > 0 THEN 100.0 * healthy / sources ELSE 100.0 END) AS uptime_str, format('{{:,}}', records) AS records_str, format('{{:,}}', entities) AS entities_str,
  format('{{:,}}', pii_total) AS pii_total_str, stale AS degraded, 0 AS unhealthy, CASE WHEN projects_new > 0 THEN CAST(projects_new AS VARCHAR) || ' since last month' ELSE 'no change' END AS projects_delta_str, CASE WHEN projects_new > 0 THEN 'up' ELSE 'flat' END AS projects_delta_dir FROM p, k, r, s""")
def kpi_rollup(spark, sf_dir):
    return reporting.system_kpis(roles.tables(spark, sf_dir), _now())


@query(f"""{_W}, {_HEALTH} SELECT h.id, h.name, connector, latency, enabled, project_id, {_sql_said("last_run_at")}, last_fetched, last_inserted, records_stored, h.status, CASE h.status WHEN 'HEALTHY' THEN 'green' WHEN 'STALE' THEN 'amber' WHEN 'PENDING' THEN 'blue' WHEN 'IDLE' THEN 'blue' ELSE 'gray' END AS status_color,
  CASE connector WHEN 'reddit' THEN 'reddit/r/' || h.name WHEN 'rss' THEN substr(replace(feed_url, 'https://', ''), 1, 48) WHEN 'x' THEN 'x.com/' || h.name ELSE 'fda.gov/aers/daily' END AS identifier, p.name AS project_label, {_TYPE} AS type_label, {_AGO.format("h.last_run_at")} AS last_run_ago
  FROM health h JOIN projects p ON h.project_id = p.id ORDER BY enabled DESC, h.last_run_at DESC NULLS LAST, h.id LIMIT 20""")
def source_health_list(spark, sf_dir):
    rows = reporting.source_health(roles.tables(spark, sf_dir), _now())
    return rows.select(*(_said(c) if c == "last_run_at" else c for c in rows.columns))


_COUNTS = """per AS (SELECT project_id, count(*) AS sources_total, count(*) FILTER (enabled) AS sources_active, coalesce(sum(r), 0) AS records, coalesce(sum(e), 0) AS entities, max(last_run_at) AS last_run FROM sources s
  LEFT JOIN (SELECT source_id, count(*) AS r, count(*) FILTER (matched) AS e FROM records GROUP BY 1) x ON s.id = x.source_id LEFT JOIN watermarks w ON s.id = w.source_id GROUP BY project_id),
latest AS (SELECT project_id, max(computed_at) AS latest_signals_ts, count(*) FILTER (prr >= 2 AND n >= 3) AS flagged FROM signals WHERE (project_id, computed_at) IN (SELECT project_id, max(computed_at) FROM signals GROUP BY project_id) GROUP BY project_id),
counts AS (SELECT p.id AS project_id, coalesce(sources_total, 0) AS sources_total, coalesce(sources_active, 0) AS sources_active, CAST(coalesce(records, 0) AS BIGINT) AS records, CAST(coalesce(entities, 0) AS BIGINT) AS entities, last_run, coalesce(flagged, 0) AS flagged, latest_signals_ts
  FROM projects p LEFT JOIN per ON p.id = per.project_id LEFT JOIN latest ON p.id = latest.project_id)"""


@query(f"{_W}, {_COUNTS} SELECT project_id, sources_total, sources_active, records, entities, {_sql_said('last_run')}, flagged, {_sql_said('latest_signals_ts')} FROM counts")
def project_counts(spark, sf_dir):
    rows = reporting.project_counts(roles.tables(spark, sf_dir))
    return rows.select("project_id", "sources_total", "sources_active", "records", "entities", _said("last_run"), "flagged", _said("latest_signals_ts"))


@query(f"""{_W}, {_COUNTS} SELECT project_id, name, keywords AS kw_count, sources_active, sources_total, records, flagged, {_sql_said('last_run')}, coalesce(cadence, 'daily') AS cadence, status AS lifecycle,
  CASE WHEN status = 'closed' THEN 'CLOSED' WHEN status = 'paused' THEN 'PAUSED' WHEN last_run IS NOT NULL THEN 'RUNNING' ELSE 'QUEUED' END AS status, CASE WHEN status = 'closed' THEN 'gray' WHEN status = 'paused' THEN 'amber' WHEN last_run IS NOT NULL THEN 'green' ELSE 'blue' END AS status_color
  FROM projects JOIN counts ON id = project_id""")
def project_rows(spark, sf_dir):
    rows = reporting.project_rows(roles.tables(spark, sf_dir))
    return rows.select(*(_said(c) if c == "last_run" else c for c in rows.columns))


@query(f"""{_W}, m AS (SELECT r.id, ingested_at, unnest([{{'type': 'DRUG', 'name': drug}}, {{'type': 'SYMPTOM', 'name': event}}]) AS e FROM records r JOIN sources s ON r.source_id = s.id WHERE tagged AND project_id = '{roles.PROJECT}')
SELECT e.type AS type, e.name AS name, count(*) AS mentions, count(DISTINCT id) AS records, strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S') AS last_seen FROM m GROUP BY ALL""")
def entity_rollup(spark, sf_dir):
    return reporting.project_entities(roles.tables(spark, sf_dir), roles.PROJECT).select("type", "name", "mentions", "records", _said("last_seen"))


@query(f"""{_W}, m AS (SELECT CAST(coalesce(posted_at, ingested_at) AS DATE) AS day, unnest([{{'type': 'DRUG', 'name': drug}}, {{'type': 'SYMPTOM', 'name': event}}]) AS e FROM records r JOIN sources s ON r.source_id = s.id WHERE tagged AND project_id = '{roles.PROJECT}'),
d AS (SELECT e.type AS type, e.name AS normalized, day, count(*) AS n FROM m GROUP BY ALL) SELECT *, CAST(sum(n) OVER (PARTITION BY type, normalized ORDER BY day) AS BIGINT) AS total FROM d""")
def entity_days(spark, sf_dir):
    return reporting.entity_mentions_per_day(roles.tables(spark, sf_dir), roles.PROJECT)


@query(f"""{_W} SELECT s.id, project_id, p.name AS project_name, drug || ' → ' || event AS title, n, prr, {_CASES.replace(" AS status", " AS signal_status")}, {_TEXT.format("prr")} AS prr_str, computed_at >= TIMESTAMP '1998-08-01 12:00:00' AS is_new
FROM signals s JOIN projects p ON s.project_id = p.id WHERE prr >= 1 ORDER BY computed_at DESC, prr DESC, s.id LIMIT 6""")
def recent_signals(spark, sf_dir):
    rows = reporting.recent_signals(roles.tables(spark, sf_dir), _now())
    return rows.select("id", "project_id", "project_name", "title", "n", "prr", "conf", "conf_label", "tier", F.col("status").alias("signal_status"), "prr_str", "is_new")


_PAIR_SOURCES = """matched_by AS (SELECT DISTINCT project_id, connector, drug, event FROM records r JOIN sources s ON r.source_id = s.id WHERE matched),
named AS (SELECT project_id, drug, event, count(*) AS src_count, array_to_string(list_slice(list_sort(list(connector)), 1, 4), ', ') AS src_names FROM (SELECT DISTINCT project_id, drug, event FROM signals) JOIN matched_by USING (project_id, drug, event) GROUP BY ALL)"""


@query(f"{_W}, {_PAIR_SOURCES} SELECT * FROM named")
def signal_pair_sources(spark, sf_dir):
    return reporting.pair_connectors(roles.tables(spark, sf_dir))


_ALL = f"""{_W}, {_PAIR_SOURCES}, runs AS (SELECT *, row_number() OVER w AS nth, lead(prr) OVER w AS previous, min(computed_at) OVER (PARTITION BY project_id, drug, event) AS first_detected FROM signals WHERE prr >= 2 AND n >= 3 WINDOW w AS (PARTITION BY project_id, drug, event ORDER BY computed_at DESC)),
shown AS (SELECT project_id, drug, event, n, prr, previous, {_sql_said("first_detected")}, CASE WHEN previous IS NULL THEN 'NEW' WHEN prr > previous * 1.05 THEN 'UP' WHEN prr < previous * 0.95 THEN 'DOWN' ELSE 'STABLE' END AS trend, {_CASES.replace(" AS status", " AS signal_status")}, coalesce(src_count, 0) AS src_count, coalesce(src_names, '—') AS src_names, coalesce(cadence, 'daily') AS cadence
  FROM runs LEFT JOIN named USING (project_id, drug, event) LEFT JOIN projects p ON project_id = p.id WHERE nth = 1)"""


def _shown(rows):
    return rows.select("project_id", "drug", "event", "n", "prr", "previous", _said("first_detected"), "trend", "conf", "conf_label", "tier", F.col("status").alias("signal_status"), "src_count", "src_names", "cadence")


@query(f"{_ALL} SELECT * FROM shown")
def all_signals(spark, sf_dir):
    return _shown(reporting.all_signals(roles.tables(spark, sf_dir)))


@query(f"{_ALL} SELECT * FROM shown WHERE project_id = '{roles.PROJECT}' ORDER BY prr DESC, drug, event LIMIT 7")
def project_signals(spark, sf_dir):
    return _shown(reporting.project_signals(roles.tables(spark, sf_dir), roles.PROJECT, 7))


# --- one signal ---


def signal_parts(spark, sf_dir):
    """What the view of the project's first signal reads; pairs are those of the project's tagged records."""
    t = roles.tables(spark, sf_dir)
    own = t("sources").where(F.col("project_id") == roles.PROJECT).select(F.col("id").alias("source_id"))
    name = lambda kind: F.get(F.filter("entities", lambda e: e["type"] == kind), F.lit(0))["normalized"]
    pairs = t("records").join(own, "source_id", "left_semi").where("entities IS NOT NULL").select(F.col("id").alias("record"), "source_id", "posted_at", "ingested_at", "sentiment_label", "text_redacted", name("DRUG").alias("drug"), name("SYMPTOM").alias("event"))
    first = t("signals").where(F.col("project_id") == roles.PROJECT).agg(F.min("id")).first()[0]
    return reporting.signal_detail(t, pairs, first, _now())


_ONE = f"""{_W}, one AS (SELECT * FROM signals WHERE project_id = '{roles.PROJECT}' ORDER BY id LIMIT 1),
pairs AS (SELECT r.*, s.connector, s.name AS source_name, s.latency FROM records r JOIN sources s ON r.source_id = s.id WHERE project_id = '{roles.PROJECT}' AND tagged),
own AS (SELECT pairs.* FROM pairs JOIN one USING (drug, event))"""


@query(f"""{_ONE} SELECT id, drug, event, n, prr, {_SCORE} AS conf, CASE WHEN prr >= 3 AND n >= 5 THEN 'High' WHEN prr >= 2 THEN 'Medium' ELSE 'Low' END AS strength_label, CASE WHEN prr >= 3 AND n >= 5 THEN least(99, {_SCORE}) WHEN prr >= 2 THEN least(85, {_SCORE}) ELSE {_SCORE} END AS strength_pct,
  (SELECT string_agg(DISTINCT connector, ',' ORDER BY connector) FROM own) AS sources_involved, (SELECT count(*) FROM pairs) AS pairs_total, (SELECT strftime(max(last_run_at), '%Y-%m-%d %H:%M:%S') FROM watermarks WHERE source_id IN (SELECT source_id FROM own)) AS last_fetched,
  (SELECT count(*) FROM pairs) < 200 AND EXISTS (SELECT 1 FROM own WHERE connector = 'reddit') AS warned FROM one""")
def signal_head(spark, sf_dir):
    head = signal_parts(spark, sf_dir)["signal"]
    return head.select("id", "drug", "event", "n", "prr", "conf", "strength_label", "strength_pct", F.array_join("sources_involved", ",").alias("sources_involved"), "pairs_total", _said("last_fetched"), F.col("quality_warning").isNotNull().alias("warned"))


@query(f"""{_ONE}, adverse AS (SELECT * FROM pairs WHERE sentiment_label IN ('adverse', 'negative')), cell AS (SELECT (SELECT count(*) FROM adverse JOIN one USING (drug, event)) AS a, (SELECT count(*) FROM adverse WHERE drug = one.drug) AS dn, (SELECT count(*) FROM adverse WHERE event = one.event) AS en, (SELECT count(*) FROM adverse) AS total FROM one),
full_cell AS (SELECT a, dn - a AS b, en - a AS c, total - dn - en + a AS d, total FROM cell), k AS (SELECT *, CASE WHEN a * b * c * d = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS h, CAST(a + b AS DOUBLE) * (a + c) / total AS e FROM full_cell WHERE a > 0),
v AS (SELECT *, ((a + h) / (a + h + b + h)) / ((c + h) / (c + h + d + h)) AS prr, (a + h) * (d + h) / ((b + h) * (c + h)) AS ror, power(greatest(0, abs(a - e) - 0.5), 2) / e AS x FROM k)
SELECT a, b, c, d, total, {_TEXT.format("prr")} AS prr_str, {_TEXT.format("ror")} AS ror_str, {_TEXT.format("x")} AS chi2_floored_str FROM v""")
def signal_contingency(spark, sf_dir):
    cells = signal_parts(spark, sf_dir)["contingency"]
    return cells.select("a", "b", "c", "d", F.col("total").cast("long").alias("total"), "prr_str", "ror_str", "chi2_floored_str")


@query(f"""{_ONE}, n AS (SELECT connector, source_name, count(*) AS n FROM own GROUP BY ALL)
SELECT *, CAST(round(100 * n / sum(n) OVER ()) AS BIGINT) AS pct, CAST(round(100 * n / max(n) OVER ()) AS BIGINT) AS bar_pct FROM n""")
def signal_sources(spark, sf_dir):
    return signal_parts(spark, sf_dir)["source_breakdown"]


@query(f"""{_ONE}, m AS (SELECT {", ".join(f"count(*) FILTER (sentiment_label IN ({of})) AS {n}" for n, of in (("negative", "'negative', 'adverse'"), ("neutral", "'neutral'"), ("positive", "'positive'")))} FROM own)
SELECT *, {", ".join(f"CAST(round(100 * {n} / greatest(1, negative + neutral + positive)) AS BIGINT) AS {n}_pct" for n in ("negative", "neutral", "positive"))} FROM m""")
def signal_sentiment(spark, sf_dir):
    return signal_parts(spark, sf_dir)["sentiment_mix"]


@query(f"""{_ONE}, c AS (SELECT CAST(coalesce(posted_at, ingested_at) AS DATE) AS day, count(*) AS n FROM own GROUP BY 1), e AS (SELECT min(day) AS a, max(day) AS b, greatest(0, 13 - (max(day) - min(day))) AS pad FROM c),
s AS (SELECT unnest(generate_series(CAST(a - CAST(pad // 2 AS INTEGER) AS TIMESTAMP), CAST(b + CAST(pad - pad // 2 AS INTEGER) AS TIMESTAMP), INTERVAL 1 DAY)) AS t FROM e)
SELECT CAST(t AS DATE) AS day, coalesce(n, 0) AS n FROM s LEFT JOIN c ON CAST(t AS DATE) = c.day""")
def signal_timeline(spark, sf_dir):
    return signal_parts(spark, sf_dir)["timeline"]


@query(f"""{_ONE} SELECT id, strftime(coalesce(posted_at, ingested_at), '%Y-%m-%d %H:%M:%S') AS "at", connector, source_name, upper(sentiment_label) AS sentiment, replace(replace(substr(text_redacted, 1, 280), drug, '<REDACTED_DRUG>'), event, '<u>' || event || '</u>') AS snippet, 90 AS drug_conf, 80 AS sym_conf, pii_hits_count, url
FROM own ORDER BY posted_at DESC NULLS LAST, ingested_at DESC, id LIMIT 12""")
def signal_evidence(spark, sf_dir):
    rows = signal_parts(spark, sf_dir)["evidence"]
    return rows.select(*(_said(c) if c == "at" else c for c in rows.columns))


_OWN_DAYS = """c AS (SELECT CAST(coalesce(posted_at, ingested_at) AS DATE) AS day, count(*) AS n, count(*) FILTER (sentiment_label IN ('negative', 'adverse')) AS negative, count(*) FILTER (sentiment_label = 'positive') AS positive FROM own GROUP BY 1),
e AS (SELECT min(day) AS a, max(day) AS b, greatest(0, 13 - (max(day) - min(day))) AS pad FROM c),
s AS (SELECT CAST(unnest(generate_series(CAST(a - CAST(pad // 2 AS INTEGER) AS TIMESTAMP), CAST(b + CAST(pad - pad // 2 AS INTEGER) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM e),
d AS (SELECT s.day, coalesce(n, 0) AS n, coalesce(negative, 0) AS negative, coalesce(positive, 0) AS positive FROM s LEFT JOIN c ON s.day = c.day)"""


@query(f"""{_ONE}, {_OWN_DAYS}, r AS (SELECT *, row_number() OVER (ORDER BY day) AS nth, count(*) OVER () // 2 AS half FROM d),
m AS (SELECT coalesce(avg(n) FILTER (nth <= half), 0) AS base_avg, coalesce(avg(n) FILTER (nth > half), 0) AS recent_avg FROM r)
SELECT *, CAST(CASE WHEN base_avg > 0 THEN round(100 * (recent_avg - base_avg) / base_avg) WHEN recent_avg > 0 THEN 100 ELSE 0 END AS BIGINT) AS growth_pct FROM m""")
def signal_growth(spark, sf_dir):
    return signal_parts(spark, sf_dir)["growth"]


@query(f"""{_ONE}, h AS (SELECT s.* FROM signals s JOIN one ON s.project_id = one.project_id AND s.drug = one.drug AND s.event = one.event AND s.computed_at <= one.computed_at),
r AS (SELECT *, row_number() OVER (ORDER BY computed_at DESC, id DESC) AS nth, lead(prr) OVER (ORDER BY computed_at DESC, id DESC) AS previous, strftime(min(computed_at) OVER (), '%Y-%m-%d %H:%M:%S') AS first_detected FROM h)
SELECT drug, event, prr, previous, first_detected, CASE WHEN previous IS NULL OR previous <= 0 THEN 'Preliminary' WHEN prr > previous * 1.05 THEN 'Rising Signal' WHEN prr < previous * 0.95 THEN 'Declining Signal' ELSE 'Stable Signal' END AS trend_status FROM r WHERE nth = 1""")
def signal_history(spark, sf_dir):
    return signal_parts(spark, sf_dir)["trend"].select("drug", "event", "prr", "previous", _said("first_detected"), "trend_status")


@query(f"""{_W}, m AS (SELECT {", ".join(f"count(*) FILTER (sentiment_label IN ({of})) AS {n}" for n, of in (("negative", "'negative', 'adverse'"), ("neutral", "'neutral'"), ("positive", "'positive'")))} FROM records r JOIN sources s ON r.source_id = s.id WHERE project_id = '{roles.PROJECT}')
SELECT *, {", ".join(f"CAST(round(100 * {n} / greatest(1, negative + neutral + positive)) AS BIGINT) AS {n}_pct" for n in ("negative", "neutral", "positive"))} FROM m""")
def signal_project_mix(spark, sf_dir):
    return signal_parts(spark, sf_dir)["project_sentiment_mix"]


@query(f"{_ONE}, {_OWN_DAYS} SELECT day, negative, n - negative - positive AS neutral, positive FROM d")
def signal_trajectory(spark, sf_dir):
    return signal_parts(spark, sf_dir)["trajectory"]


@query(f"{_ONE} SELECT latency, count(*) AS n FROM own GROUP BY latency ORDER BY n DESC, latency LIMIT 1")
def signal_cadence(spark, sf_dir):
    return signal_parts(spark, sf_dir)["cadence"]


# --- logs, compliance, search, totals ---


@query(f"""{_W} SELECT id, strftime(seen, '%H:%M:%S') AS time, CASE action WHEN 'run.start' THEN 'Run Started' WHEN 'run.end' THEN 'Run Completed' ELSE action END AS action_label, actor AS "user", target, CASE WHEN action LIKE 'signal%' THEN 'SIG' ELSE 'EVT' END || '-' || lpad(CAST(id AS VARCHAR), CAST(greatest(3, length(CAST(id AS VARCHAR))) AS INTEGER), '0') AS trace, substr(hash, 1, 12) AS hash_short
FROM audit_log ORDER BY id DESC LIMIT 8""")
def audit_tail(spark, sf_dir):
    return reporting.audit_tail(roles.tables(spark, sf_dir)).drop("time_full")


@query(f"""{_W}, l AS (SELECT * FROM audit_log WHERE action IN ('run.start', 'run.end', 'source.done', 'signals.computed') ORDER BY id DESC LIMIT 30), q AS (SELECT *, fetched = 0 AND inserted = 0 AS quiet FROM l)
SELECT id, strftime(seen, '%H:%M:%S') AS time, CASE WHEN quiet AND action IN ('source.done', 'run.end') THEN 'muted' WHEN action = 'source.done' THEN 'success' WHEN action = 'run.end' OR flagged > 0 THEN 'ready' ELSE 'info' END AS level,
  CASE WHEN action = 'run.start' THEN 'Run started for ' || target WHEN action = 'source.done' AND quiet THEN target || ': no new records' WHEN action = 'source.done' THEN printf('%s: fetched %d, inserted %d, duplicates %d', target, fetched, inserted, 1)
  WHEN action = 'run.end' AND quiet THEN 'Run of ' || target || ' ended without new records' WHEN action = 'run.end' THEN printf('Run of %s ended: %d new of %d records', target, inserted, fetched) ELSE printf('Signals of %s: %d flagged of %d pairs', target, flagged, n_rows) END AS text FROM q""")
def activity_log(spark, sf_dir):
    return reporting.activity(roles.tables(spark, sf_dir), 30)


@query(f"""{_W} SELECT id, {_AGO.format("ingested_at")} AS ago, {_AGO.format("posted_at")} AS posted_ago FROM records""")
def relative_times(spark, sf_dir):
    t = roles.tables(spark, sf_dir)
    return t("records").select("id", reporting.relative(F.col("ingested_at"), _now()).alias("ago"), reporting.relative(F.col("posted_at"), _now()).alias("posted_ago"))


@query(f"""{_W} SELECT id, strftime(seen, '%H:%M:%S') AS time FROM audit_log WHERE action <> 'source.error' ORDER BY id DESC LIMIT 12""")
def debug_tail(spark, sf_dir):
    return reporting.debug_log(roles.tables(spark, sf_dir)).select("id", "time")


@query(f"""{_W}, traced_of AS (SELECT r.id FROM records r JOIN sources s ON r.source_id = s.id WHERE project_id IN (SELECT target FROM audit_log)),
k AS (SELECT count(*) AS records_total, count(*) FILTER (pii_hits_count > 0) AS pii_records, (SELECT count(*) FROM traced_of) AS traced FROM records)
SELECT *, round(100.0 * pii_records / records_total, 1) AS pii_rate_pct, 100.0 * pii_records / records_total < 10 AS pii_below_thresh, round(100.0 * traced / records_total, 1) AS traceability_pct, 'Email,Phone,Aadhaar,DOB,MRN,PAN' AS pii_types FROM k""")
def semi_exists_traceability(spark, sf_dir):
    return reporting.compliance_kpis(roles.tables(spark, sf_dir)).withColumn("pii_types", F.array_join("pii_types", ","))


@query(f"""{_W}, u AS (SELECT strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS ts, 'DATA_REDACTION' AS action, 'redaction' AS actor, 'Record #' || CAST(r.id AS VARCHAR) || ' (' || {_TYPE} || ')' AS subject, CAST(pii_hits_count AS VARCHAR) || CASE WHEN pii_hits_count = 1 THEN ' PII token' ELSE ' PII tokens' END || ' removed at ingestion.' AS obs, 'neutral' AS tone
  FROM records r JOIN sources s ON r.source_id = s.id WHERE pii_hits_count > 0 UNION ALL
SELECT strftime(seen, '%Y-%m-%d %H:%M:%S'), 'SIGNAL_TRIAGE', 'signal_job', 'Sig-' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') || ' (' || upper(substr(target, 1, 1)) || substr(target, 2) || ')', printf('%d signal(s) flagged of %d pair(s).', flagged, n_rows), 'ok' FROM audit_log WHERE action = 'signals.computed' AND flagged > 0 UNION ALL
SELECT strftime(seen, '%Y-%m-%d %H:%M:%S'), 'CONNECTOR_FAILURE', 'watcher', upper(substr(target, 1, 1)) || substr(target, 2), 'The connector failed.', 'bad' FROM audit_log WHERE action = 'source.error') SELECT * FROM u ORDER BY ts DESC, action, subject LIMIT 40""")
def compliance_union(spark, sf_dir):
    return reporting.compliance_log(roles.tables(spark, sf_dir), 40)


@query(f"""{_W} (SELECT 'signal' AS kind, CAST(id AS VARCHAR) AS id, drug || ' → ' || event AS label FROM signals WHERE contains(lower(drug), 'ra') OR contains(lower(event), 'ra') ORDER BY computed_at DESC, prr DESC, id LIMIT 30) UNION ALL
(SELECT 'project', id, name FROM projects WHERE contains(lower(id), 'ra') OR contains(lower(name), 'ra') ORDER BY id LIMIT 20) UNION ALL (SELECT 'source', CAST(id AS VARCHAR), name FROM sources WHERE contains(lower(name), 'ra') OR contains(lower(connector), 'ra') ORDER BY sources.id LIMIT 20)""")
def search_like(spark, sf_dir):
    return reporting.search(roles.tables(spark, sf_dir), "Ra")


@query(f"""{_W} (SELECT 'signal' AS kind, CAST(id AS VARCHAR) AS id, drug || ' → ' || event AS label FROM signals WHERE contains(lower(drug), 'aceta') OR contains(lower(event), 'aceta')) UNION ALL (SELECT 'signal', CAST(id AS VARCHAR), drug || ' → ' || event FROM signals WHERE contains(lower(drug), 'spiri') OR contains(lower(event), 'spiri')) UNION ALL
(SELECT 'project', id, name FROM projects WHERE false)""")
def search_index(spark, sf_dir):
    """Signals by parts of their names, by an index of trigrams that is written beside them; those of two searches one after another."""
    t, path = roles.tables(spark, sf_dir), f"{shared_dir(spark)}/grams-{uuid.uuid4().hex}"
    search.postings(jobs.names_of(t("signals"))).write.partitionBy("bucket").parquet(path)
    index = spark.read.parquet(path)
    found = [reporting.search(t, q, 1 << 30, 0, 0, index) for q in ("Aceta", "SPIRI")]
    return found[0].unionByName(found[1])


@query(f"{_W} SELECT (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM records) AS records, (SELECT count(*) FROM signals) AS signals, (SELECT count(*) FROM audit_log) AS audit_log")
def about_totals(spark, sf_dir):
    return reporting.about(roles.tables(spark, sf_dir))


@query(f"""{_W} SELECT s.id AS source_id, name, connector, enabled, {_sql_said("last_run_at")}, last_fetched, last_inserted, coalesce(n, 0) AS records_stored FROM sources s LEFT JOIN watermarks w ON s.id = w.source_id LEFT JOIN (SELECT source_id, count(*) AS n FROM records GROUP BY 1) r ON s.id = r.source_id WHERE project_id = '{roles.PROJECT}'""")
def project_summary(spark, sf_dir):
    rows = reporting.project_summary(roles.tables(spark, sf_dir), roles.PROJECT)
    return rows.select("source_id", "name", "connector", "enabled", _said("last_run_at"), "last_fetched", "last_inserted", "records_stored")


@query(f"""{_W} SELECT r.id, s.name AS source, connector, external_id, url, {_sql_said("posted_at")}, {_sql_said("ingested_at")}, sentiment_label, printf('%.3f', sentiment_score) AS sentiment_score, pii_hits_count, CAST(CASE WHEN tagged THEN 2 ELSE 0 END AS INTEGER) AS entities_count, CASE WHEN matched THEN drug || '; ' || event ELSE '' END AS matched_keywords,
  replace(text_redacted, chr(10), ' ') AS text FROM records r JOIN sources s ON r.source_id = s.id WHERE project_id = '{roles.PROJECT}'""")
def csv_export_projection(spark, sf_dir):
    rows = reporting.records_csv(roles.tables(spark, sf_dir), roles.PROJECT)
    return rows.select(*(_said(c) if c.endswith("_at") else c for c in rows.columns))


# --- a store ---


def _store(spark, sf_dir):
    return roles.filled(spark, sf_dir, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


@query(f"""{_W}, pairs AS (SELECT drug, event, posted_at FROM records r JOIN sources s ON r.source_id = s.id WHERE project_id = '{roles.PROJECT}'), {_CELLS}
SELECT drug, event, n, prr, chi2, ic, (SELECT strftime(min(posted_at), '%Y-%m-%d %H:%M:%S') FROM pairs) AS window_since, (SELECT strftime(max(posted_at), '%Y-%m-%d %H:%M:%S') FROM pairs) AS window_until FROM stat""")
def signal_job(spark, sf_dir):
    """What the signal job stores of a project: names found in the records' texts, and statistics of their pairs."""
    store, now = _store(spark, sf_dir), datetime(2030, 1, 1, tzinfo=timezone.utc)
    jobs.compute_signals(store, roles.PROJECT, now)
    rows = store.table("signals").where(F.col("computed_at") == F.lit(now))
    return rows.select("drug", "event", "n", "prr", "chi2", "ic", _said("window_since"), _said("window_until"))


@query(f"""{_W} SELECT CASE WHEN id % 5 = 0 THEN CASE event WHEN 'cough' THEN 'neutral' ELSE 'negative' END ELSE sentiment_label END AS label, count(*) AS n, (SELECT count(*) FROM records WHERE id % 5 = 0) AS enriched,
  CAST(sum(CASE WHEN id % 5 = 0 THEN 2 WHEN tagged THEN 2 ELSE 0 END) AS BIGINT) AS entities FROM records GROUP BY 1""")
def backfilled(spark, sf_dir):
    """Records by label after those without one are enriched from their text; with the number of these, and of entities."""
    store = _store(spark, sf_dir)
    store.replace("records", store.table("records").withColumn("sentiment_label", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("sentiment_label"))))
    n = ingest.backfill(store)
    by = store.table("records").groupBy(F.col("sentiment_label").alias("label")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("entities"), F.lit(0))).alias("entities"))
    return by.select("label", "n", F.lit(n).cast("long").alias("enriched"), "entities")


@query("""WITH RECURSIVE d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1), e AS (SELECT CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS id, CAST(day AS VARCHAR) || '|runner|ingest|events|{"inserted": ' || CAST(n AS VARCHAR) || '}' AS body FROM d),
c AS (SELECT 0 AS id, '' AS prev_hash, '' AS hash UNION ALL SELECT e.id, c.hash, sha256(c.hash || '|' || e.body) FROM c JOIN e ON e.id = c.id + 1) SELECT id, prev_hash, hash, true AS ok FROM c WHERE id > 0""")
def audit_days(spark, sf_dir):
    """An entry in the log for each day of events, in two appends; with what verifying says of each."""
    from ..operators import audit
    from ..schemas import TABLES

    days = timeline.daily_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("ts")).orderBy("day").collect()  # a row a day
    entries = [(str(r["day"]), "runner", "ingest", "events", {"inserted": r["n"]}) for r in days]
    log = audit.append(spark.createDataFrame([], TABLES["audit_log"]), entries[:10])
    log = log.unionByName(audit.append(log, entries[10:]))
    return audit.checked(log).select(F.col("id").cast("int").alias("id"), F.coalesce("prev_hash", F.lit("")).alias("prev_hash"), "hash", "ok")


@query(f"""{_W} SELECT p.id, (SELECT count(*) FROM sources WHERE project_id = p.id) AS n_sources, (SELECT count(*) FROM records r JOIN sources s ON r.source_id = s.id WHERE project_id = p.id) AS n_records, (SELECT count(*) FROM signals WHERE project_id = p.id) AS n_signals FROM projects p""")
def project_list(spark, sf_dir):
    return _store(spark, sf_dir).projects().select("id", "n_sources", "n_records", "n_signals")


@query(f"""{_W}, own AS (SELECT id FROM sources WHERE project_id = '{roles.PROJECT}') SELECT 'records' AS name, (SELECT count(*) FROM records WHERE source_id IN (SELECT id FROM own)) AS gone, (SELECT count(*) FROM records WHERE source_id NOT IN (SELECT id FROM own)) AS n UNION ALL
SELECT 'watermarks', (SELECT count(*) FROM watermarks WHERE source_id IN (SELECT id FROM own)), (SELECT count(*) FROM watermarks WHERE source_id NOT IN (SELECT id FROM own)) UNION ALL
SELECT 'signals', (SELECT count(*) FROM signals WHERE project_id = '{roles.PROJECT}'), (SELECT count(*) FROM signals WHERE project_id <> '{roles.PROJECT}') UNION ALL
SELECT 'projects', 0, (SELECT count(*) FROM projects) UNION ALL SELECT 'sources', 0, (SELECT count(*) FROM sources) UNION ALL SELECT 'audit_log', 0, 1""")
def project_reset(spark, sf_dir):
    """Rows of each table that a reset of a project takes, and rows left."""
    store = _store(spark, sf_dir)
    gone = store.reset_project(roles.PROJECT)
    left = store.diagnostics().where("name <> 'record_keys'")
    return left.join(spark.createDataFrame(list(gone.items()), "name string, gone long"), "name", "left").fillna(0, ["gone"])


@query(f"""{_W} SELECT id, CASE WHEN id = '{roles.PROJECT}' THEN 'paused' ELSE status END AS status, CASE WHEN id = '{roles.PROJECT}' THEN 'weekly' ELSE coalesce(cadence, 'none') END AS cadence, 1 AS entries FROM projects""")
def project_status(spark, sf_dir):
    """Projects after one of them is paused and its cadence changed; with the number of entries of that in the log."""
    store = _store(spark, sf_dir)
    store.set_fields(roles.PROJECT, status="paused", cadence="weekly")
    entries = store.table("audit_log").where("action = 'project.paused'").agg(F.count("*").cast("int").alias("entries"))
    return store.table("projects").select("id", "status", F.coalesce("cadence", F.lit("none")).alias("cadence")).crossJoin(entries)  # one row
