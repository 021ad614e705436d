"""Schemas of the records that connectors yield and of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TIME_WINDOW = _struct(lookback_days=T.IntegerType(), since=_TS, until=_TS)
ENTITY = _struct(type=_S, text=_S, start=T.IntegerType(), end=T.IntegerType(), normalized=_S, confidence=_D)
PII_HIT = _struct(type=_S, match=_S, start=T.IntegerType(), end=T.IntegerType(), confidence=_D)
PAIR = _struct(drug=_S, event=_S)
SENTIMENT = _struct(label=_S, score=_D, matched_negative=T.ArrayType(_S), matched_positive=T.ArrayType(_S), has_adr_trigger=_B, negated=T.ArrayType(_S))

RAW_RECORD = _struct(external_id=_S, url=_S, text=_S, posted_at=_TS, author_handle=_S, raw_blob=_S, language_hint=_S, source_kind=_S)

TABLES: dict[str, T.StructType] = {
    "projects": _struct(id=_S, name=_S, description=_S, keywords=T.ArrayType(_S), time_window=TIME_WINDOW, time_windows=T.ArrayType(TIME_WINDOW), created_at=_TS, updated_at=_TS, status=_S, cadence=_S, last_started_at=_TS, last_completed_at=_TS),
    "sources": _struct(id=_L, project_id=_S, name=_S, connector=_S, params=T.MapType(_S, _S), latency=_S, time_window=TIME_WINDOW, time_windows=T.ArrayType(TIME_WINDOW), enabled=_B, created_at=_TS, updated_at=_TS),
    "records": _struct(id=_L, source_id=_L, external_id=_S, content_hash=_S, url=_S, posted_at=_TS, text_redacted=_S, author_handle=_S, language_hint=_S, source_kind=_S, matched_keywords=T.ArrayType(_S), ingested_at=_TS, sentiment_score=_D, sentiment_label=_S, pii_hits_count=T.IntegerType(), entities=T.ArrayType(ENTITY)),
    "record_keys": _struct(key=_S, bucket=T.IntegerType()),
    "watermarks": _struct(source_id=_L, last_seen_id=_S, last_seen_ts=_TS, last_run_at=_TS, last_fetched=_L, last_inserted=_L),
    "signals": _struct(id=_L, project_id=_S, drug=_S, event=_S, prr=_D, chi2=_D, ic=_D, n=_L, window_since=_TS, window_until=_TS, computed_at=_TS),
    "audit_log": _struct(id=_L, ts=_S, actor=_S, action=_S, target=_S, payload_json=_S, prev_hash=_S, hash=_S),
}

#: Tables that follow from others and are kept beside them: counts of the records' pairs by source (operators/counters.py), trigrams of the names
#: in signals (operators/search.py).
DERIVED: dict[str, T.StructType] = {
    "pair_counts": _struct(source_id=_L, drug=_S, event=_S, adverse=_B, n=_L, first_at=_TS, last_at=_TS, examples=T.ArrayType(_struct(record=_L, text=_S))),
    "signal_grams": _struct(name=_S, gram=_S, bucket=T.IntegerType()),
}

#: Tables that are written in folders by a column's values.
PARTITIONED = {"record_keys": ("bucket",), "signal_grams": ("bucket",)}

STATUSES, CADENCES = ("running", "paused", "closed"), ("real_time", "daily", "weekly", "manual")
