"""The driver's tables in the roles of the stored tables, as frames and as SQL: regions are projects, nations sources with their
watermarks, orders records (of their customer's nation), line items signals, events the audit log."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES
from ..store import Store
from .reporting import Tables

# What each role takes for names. The same text serves both engines.
_DRUG = "CASE {0} % 4 WHEN 0 THEN 'paracetamol' WHEN 1 THEN 'aspirin' WHEN 2 THEN 'ranitidine' ELSE 'metformin' END"
_EVENT = "CASE {0} % 5 WHEN 0 THEN 'rash' WHEN 1 THEN 'nausea' WHEN 2 THEN 'fever' WHEN 3 THEN 'cough' ELSE 'headache' END"
_CONNECTOR = "CASE n_nationkey % 5 WHEN 0 THEN 'reddit' WHEN 1 THEN 'openfda' WHEN 2 THEN 'rss' WHEN 3 THEN 'x' ELSE 'faers' END"
_LATENCY = "CASE n_nationkey % 3 WHEN 0 THEN 'real_time' WHEN 1 THEN 'daily' ELSE 'weekly' END"
_STATUS = "CASE r_regionkey WHEN 2 THEN 'paused' WHEN 4 THEN 'closed' ELSE 'running' END"
_LABEL = "CASE o_orderkey % 4 WHEN 0 THEN 'adverse' WHEN 1 THEN 'negative' WHEN 2 THEN 'positive' ELSE 'neutral' END"
_HITS = "CAST(CASE o_orderkey % 9 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INTEGER)"
_ACTION = "CASE event_type WHEN 'view' THEN 'run.start' WHEN 'purchase' THEN 'run.end' WHEN 'signup' THEN 'signals.computed' WHEN 'refund' THEN 'source.done' ELSE 'source.error' END"
_PAYLOAD = """concat('{"fetched": ', user_id % 9, ', "inserted": ', user_id % 4, ', "duplicates": 1, "flagged": ', user_id % 3, ', "rows": ', user_id % 50, '}')"""
_DRUG_OF_RECORD, _EVENT_OF_RECORD = _DRUG.format("o_custkey"), _EVENT.format("o_orderkey")

#: When the read API is asked; the signal that is looked into is the one with the smallest id of its project.
AS_OF, PROJECT = "1998-08-02 12:00:00", "p1"


def _signals(year: str, at: str) -> str:
    return f"""SELECT min(l_orderkey * 8 + l_linenumber) AS id, concat('p', l_suppkey % 5) AS project_id, {_DRUG.format("l_partkey")} AS drug, {_EVENT.format("l_linenumber")} AS event, count(*) AS n,
  round(sum(l_quantity) / count(*) / (4 * (1 + min(l_linenumber) % 5)), 3) AS prr, round(sum(l_quantity) / count(*) / 5, 3) AS chi2, CAST(1 AS DOUBLE) AS ic, true AS is_signal, {at} AS computed_at
  FROM lineitem GROUP BY concat('p', l_suppkey % 5), {_DRUG.format("l_partkey")}, {_EVENT.format("l_linenumber")}, {year}"""


_SPARK = {
    "projects": f"SELECT concat('p', r_regionkey) AS id, r_name AS name, '' AS description, array('rash', 'ulti') AS keywords, timestampadd(DAY, 10 * r_regionkey, timestamp'1998-06-20') AS created_at, timestampadd(DAY, 10 * r_regionkey, timestamp'1998-06-21') AS updated_at, {_STATUS} AS status, CASE WHEN r_regionkey = 1 THEN 'manual' END AS cadence FROM region",
    "sources": f"SELECT CAST(n_nationkey AS BIGINT) AS id, concat('p', n_regionkey) AS project_id, n_name AS name, {_CONNECTOR} AS connector, map('feed_url', concat('https://feeds.example/', lower(n_name))) AS params, {_LATENCY} AS latency, n_nationkey % 7 <> 3 AS enabled FROM nation",
    "watermarks": "SELECT CAST(n_nationkey AS BIGINT) AS source_id, CAST(NULL AS STRING) AS last_seen_id, CAST(NULL AS TIMESTAMP) AS last_seen_ts, timestampadd(HOUR, -12 * (n_nationkey % 4), timestamp'1998-08-02') AS last_run_at, CAST(3 * n_nationkey AS BIGINT) AS last_fetched, CAST(n_nationkey % 4 AS BIGINT) AS last_inserted FROM nation WHERE n_nationkey % 6 <> 5",
    "records": f"""SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS source_id, concat('r:', o_orderkey) AS external_id, concat('https://r.example/', o_orderkey) AS url, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS posted_at, timestampadd(DAY, 1, CAST(o_orderdate AS TIMESTAMP)) AS ingested_at,
  concat('Took ', {_DRUG_OF_RECORD}, ',\n then ', {_EVENT_OF_RECORD}, '.') AS text_redacted, {_LABEL} AS sentiment_label, (o_orderkey % 1000) / 1000.0D AS sentiment_score, {_HITS} AS pii_hits_count, CASE WHEN o_orderkey % 3 = 0 THEN array() ELSE array({_DRUG_OF_RECORD}, {_EVENT_OF_RECORD}) END AS matched_keywords,
  CASE WHEN o_orderkey % 8 <> 0 THEN array(named_struct('type', 'DRUG', 'text', {_DRUG_OF_RECORD}, 'start', 5, 'end', 9, 'normalized', {_DRUG_OF_RECORD}, 'confidence', 0.9D), named_struct('type', 'SYMPTOM', 'text', {_EVENT_OF_RECORD}, 'start', 9, 'end', 12, 'normalized', {_EVENT_OF_RECORD}, 'confidence', 0.8D)) END AS entities
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "signals": _signals("year(l_shipdate)", "make_timestamp(year(l_shipdate) + 1, 1, 1, 0, 0, 0)"),
    "audit_log": f"SELECT event_id AS id, date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS ts, event_type AS actor, {_ACTION} AS action, concat('p', user_id % 7) AS target, {_PAYLOAD} AS payload_json, sha2(CAST(event_id - 1 AS STRING), 256) AS prev_hash, sha2(CAST(event_id AS STRING), 256) AS hash FROM events",
}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    stored = lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`"
    return lambda name: spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", stored, _SPARK[name]))


def whole(t: Tables, name: str) -> DataFrame:
    """A role with all columns of the stored table, null where it has none."""
    rows = t(name)
    return rows.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name].fields if f.name not in rows.columns))


def filled(spark: SparkSession, sf_dir: str, path: str) -> Store:
    """A store that holds the tables, in one commit."""
    t, store = tables(spark, sf_dir), Store(spark, path)
    store.commit(replaced={name: whole(t, name) for name in _SPARK if name != "audit_log"})
    return store


#: The same as common table expressions.
SQL = f"""projects AS (SELECT concat('p', r_regionkey) AS id, r_name AS name, 2 AS keywords, TIMESTAMP '1998-06-20' + to_days(CAST(10 * r_regionkey AS INTEGER)) AS created_at, TIMESTAMP '1998-06-21' + to_days(CAST(10 * r_regionkey AS INTEGER)) AS updated_at, {_STATUS} AS status, CASE WHEN r_regionkey = 1 THEN 'manual' END AS cadence FROM region),
sources AS (SELECT CAST(n_nationkey AS BIGINT) AS id, concat('p', n_regionkey) AS project_id, n_name AS name, {_CONNECTOR} AS connector, concat('https://feeds.example/', lower(n_name)) AS feed_url, {_LATENCY} AS latency, n_nationkey % 7 <> 3 AS enabled FROM nation),
watermarks AS (SELECT CAST(n_nationkey AS BIGINT) AS source_id, TIMESTAMP '1998-08-02' - to_hours(CAST(12 * (n_nationkey % 4) AS INTEGER)) AS last_run_at, CAST(3 * n_nationkey AS BIGINT) AS last_fetched, CAST(n_nationkey % 4 AS BIGINT) AS last_inserted FROM nation WHERE n_nationkey % 6 <> 5),
records AS (SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS source_id, concat('r:', o_orderkey) AS external_id, concat('https://r.example/', o_orderkey) AS url, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS posted_at, o_orderdate + to_days(1) AS ingested_at,
  {_DRUG_OF_RECORD} AS drug, {_EVENT_OF_RECORD} AS event, concat('Took ', {_DRUG_OF_RECORD}, ',', chr(10), ' then ', {_EVENT_OF_RECORD}, '.') AS text_redacted, {_LABEL} AS sentiment_label, (o_orderkey % 1000) / 1000.0::DOUBLE AS sentiment_score, {_HITS} AS pii_hits_count, o_orderkey % 3 <> 0 AS matched, o_orderkey % 8 <> 0 AS tagged
  FROM orders JOIN customer ON o_custkey = c_custkey),
signals AS ({_signals("year(l_shipdate)", "make_timestamp(year(l_shipdate) + 1, 1, 1, 0, 0, 0)")}),
audit_log AS (SELECT event_id AS id, ts AS seen, event_type AS actor, {_ACTION} AS action, concat('p', user_id % 7) AS target, user_id % 9 AS fetched, user_id % 4 AS inserted, user_id % 3 AS flagged, user_id % 50 AS n_rows, sha256(CAST(event_id AS VARCHAR)) AS hash FROM events)"""
