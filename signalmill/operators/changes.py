"""Mutations of tables as plans: upsert, delete with dependants, first-writer de-duplication, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lexicon import CADENCE_SECONDS


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """target with the rows of changes put in place of those of the same key, or added; columns in `keep` stay those of the old row."""
    new = changes
    if keep:
        old = target.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in keep), F.lit(True).alias("_there"))
        new = changes.join(old, keys, "left").select(*(F.when(F.col("_there"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in changes.columns))
    return target.join(changes, keys, "left_anti").unionByName(new.select(*target.columns))


def without_missing(target: DataFrame, wanted: DataFrame, keys: list[str], scope: Column) -> DataFrame:
    """target without rows in scope whose key isn't wanted."""
    return target.where(~scope).unionByName(target.where(scope).join(wanted, keys, "left_semi"))


def cascade(tables: dict[str, DataFrame], gone: DataFrame, drop_parents: bool = True) -> dict[str, DataFrame]:
    """Removes projects (gone: id) with their sources and signals, and those sources' records and watermarks. drop_parents
    false keeps projects and sources, and empties them."""
    sources = tables["sources"].join(gone.select(F.col("id").alias("project_id")), "project_id", "left_semi").select(F.col("id").alias("source_id"))
    out = dict(tables)
    for t in ("records", "watermarks", "pair_counts"):
        if t not in tables:
            continue
        out[t] = tables[t].join(sources, "source_id", "left_anti")
    out["signals"] = tables["signals"].join(gone.select(F.col("id").alias("project_id")), "project_id", "left_anti")
    if drop_parents:
        out["projects"] = tables["projects"].join(gone.select("id"), "id", "left_anti")
        out["sources"] = tables["sources"].join(gone.select(F.col("id").alias("project_id")), "project_id", "left_anti")
    return out


def first_writers(df: DataFrame, key: str, order: list[str], copies: str | None = None) -> DataFrame:
    """One row of each key: the first in order, with the number of its rows if `copies` names a column for it. Aggregated, so that a
    key with most of the rows meets in few rows a task. The key stays the grouped column, so that a join on it deals no row again."""
    row = F.struct(*(F.col(c).alias(c) for c in df.columns))
    by = df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("_row"), F.count("*").alias("_n"))
    return by.select(*(c if c == key else F.col(f"_row.{c}") for c in df.columns), *([F.col("_n").alias(copies)] if copies else []))


def _first_of_batch(batch: DataFrame, order: list[str]) -> DataFrame:
    unique = batch.withColumn("_key", F.concat_ws("\x1f", F.col("source_id").cast("string"), "external_id"))
    return first_writers(first_writers(unique, "_key", list(order)), "content_hash", list(order)).drop("_key")


def new_records(batch: DataFrame, stored: DataFrame, order: list[str] = ("posted_at", "external_id")) -> DataFrame:
    """Rows of a batch to be inserted: the first of each (source, external id), then of each content hash, that no stored row has."""
    once = _first_of_batch(batch, order)
    return once.join(stored.select("source_id", "external_id"), ["source_id", "external_id"], "left_anti").join(stored.select("content_hash"), "content_hash", "left_anti").select(*batch.columns)


#: Folders that the keys of all records are dealt over.
KEY_BUCKETS = 256


def _source_key() -> Column:
    return F.concat_ws("\x1f", F.lit("s"), F.col("source_id").cast("string"), "external_id")


def _hash_key() -> Column:
    """Null without a hash, which makes no record a duplicate."""
    return F.concat(F.lit("h\x1f"), "content_hash")


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def keys_of(records: DataFrame) -> DataFrame:
    """(key, bucket): what makes a later record a duplicate, two rows a record, one of a record without a hash; dealt by bucket, so that a bucket is
    one file."""
    keys = records.select(F.explode(F.array_compact(F.array(_source_key(), _hash_key()))).alias("key"))
    return keys.withColumn("bucket", _bucket(F.col("key"))).repartition("bucket")


def unknown_records(batch: DataFrame, keys: DataFrame, order: list[str] = ("posted_at", "external_id")) -> DataFrame:
    """As new_records, against stored keys instead of records: of these only the buckets are read that the batch's keys are in. Rows are dealt
    twice, by source key and by hash, each time for the first of the batch and the stored keys at once; so a row whose source key is stored is only
    marked before the firsts of the hashes are found."""
    keyed = batch.withColumn("_key", _source_key())
    buckets = keyed.select(F.explode(F.array(_bucket(F.col("_key")), _bucket(_hash_key()))).alias("b")).distinct().collect()  # KEY_BUCKETS numbers
    known = keys.where(F.col("bucket").isin([r["b"] for r in buckets]))
    sources = known.where(F.startswith("key", F.lit("s\x1f"))).select(F.col("key").alias("_key"), F.lit(True).alias("_known"))
    hashes = known.where(F.startswith("key", F.lit("h\x1f"))).select(F.expr("substring(key, 3)").alias("content_hash"))
    once = first_writers(keyed, "_key", list(order)).join(sources, "_key", "left")
    once = first_writers(once, "content_hash", list(order)).join(hashes, "content_hash", "left_anti")
    return once.where(F.col("_known").isNull()).select(*batch.columns)


def high_water(records: DataFrame, source: str = "source_id", at: str = "posted_at", ident: str = "external_id") -> DataFrame:
    """Each source's latest time with its id; of equal times the largest id."""
    return records.groupBy(source).agg(F.max(at).alias("last_seen_ts"), F.max_by(ident, F.struct(at, ident)).alias("last_seen_id"), F.count("*").alias("n"))


def advance(old: DataFrame, run: DataFrame) -> DataFrame:
    """Watermarks after a run: times never go back, ids stay where the run has none, the counters are the run's."""
    o, n = old.alias("o"), run.alias("n")
    newer = F.coalesce(F.col("n.last_seen_ts") >= F.col("o.last_seen_ts"), F.col("n.last_seen_ts").isNotNull())
    either = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return o.join(n, "source_id", "full").select(
        "source_id", F.when(newer, F.coalesce("n.last_seen_id", "o.last_seen_id")).otherwise(F.coalesce("o.last_seen_id", "n.last_seen_id")).alias("last_seen_id"), F.greatest("o.last_seen_ts", "n.last_seen_ts").alias("last_seen_ts"),
        either("last_run_at"), either("last_fetched"), either("last_inserted"),
    )


def due(sources: DataFrame, projects: DataFrame, watermarks: DataFrame, now: Column) -> DataFrame:
    """Enabled sources of running projects (but manual ones) that never ran or ran a latency ago."""
    seconds = F.create_map(*(F.lit(x) for kv in CADENCE_SECONDS.items() for x in kv))
    p = projects.where((F.col("status") == "running") & (F.coalesce("cadence", F.lit("daily")) != "manual")).select(F.col("id").alias("project_id"))
    waited = F.unix_timestamp(now) - F.unix_timestamp("last_run_at")
    joined = sources.where("enabled").join(p, "project_id", "left_semi").join(watermarks.select(F.col("source_id").alias("id"), "last_run_at"), "id", "left")
    return joined.where(F.col("last_run_at").isNull() | (waited >= F.coalesce(F.try_element_at(seconds, F.col("latency")), F.lit(CADENCE_SECONDS["daily"]))))


def health(enabled: Column, last_run: Column, inserted: Column, stored: Column, now: Column, hours: int = 24) -> Column:
    return F.when(~F.coalesce(enabled, F.lit(False)), "PAUSED").when(last_run.isNull(), "PENDING").when(now - F.make_interval(hours=F.lit(hours)) > last_run, "STALE").when(F.coalesce(stored, F.lit(0)) == 0, "EMPTY").when(F.coalesce(inserted, F.lit(0)) == 0, "IDLE").otherwise("HEALTHY")


def emission_cap(df: DataFrame, key: str, order: list[Column], total: int, groups: int) -> DataFrame:
    """At most total // groups rows of each key, the first in order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_nth") <= max(1, total // max(1, groups))).drop("_nth")
