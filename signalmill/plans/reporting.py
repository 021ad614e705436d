"""Read API over the stored tables: each query is a DataFrame of `tables` (a Store's, or any mapping by name) and an `as_of` time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, changes, timeline
from ..operators import search as trigrams
from ..operators import disproportionality as dp

Tables = Callable[[str], DataFrame]

# Display names of connectors; detectors that every record is screened by.
CONNECTOR_LABELS = {"reddit": "Reddit", "openfda": "openFDA", "rss": "RSS", "html_stealth": "Web", "x": "X", "x_stub": "X", "whatsapp": "WhatsApp", "faers": "FAERS", "html_auto": "Web page", "html_listing": "Web crawl"}
PII_TYPES = ("Email", "Phone", "Aadhaar", "DOB", "MRN", "PAN")


def _cross(*rows: DataFrame) -> DataFrame:
    """Aggregates of one row each, side by side."""
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)
    return out


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def sources_with_health(t: Tables, as_of: Column) -> DataFrame:
    stored = t("records").groupBy("source_id").agg(F.count("*").alias("records_stored"))
    rows = t("sources").join(t("watermarks").select(F.col("source_id").alias("id"), "last_run_at", "last_fetched", "last_inserted"), "id", "left").join(stored.withColumnRenamed("source_id", "id"), "id", "left")
    rows = rows.withColumn("records_stored", F.coalesce("records_stored", F.lit(0).cast("long")))
    return rows.withColumn("status", changes.health(F.col("enabled"), F.col("last_run_at"), F.col("last_inserted"), F.col("records_stored"), as_of))


def relative(at: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit; "—" if never."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(at)
    said = lambda unit, name: F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{name} ago"))
    return (
        F.when(at.isNull(), "—").when(seconds < 60, "just now").when(seconds < 3_600, said(60, "m")).when(seconds < 86_400, said(3_600, "h"))
        .when(seconds < 30 * 86_400, said(86_400, "d")).when(seconds < 365 * 86_400, said(30 * 86_400, "mo")).otherwise(said(365 * 86_400, "y"))
    )


def identifier() -> Column:
    p = lambda k: F.try_element_at(F.col("params"), F.lit(k))
    address = F.substring(F.regexp_replace(F.coalesce(p("feed_url"), p("url"), F.lit("")), "^https?://", ""), 1, 48)
    return (
        F.when(F.col("connector") == "reddit", F.concat(F.lit("reddit/r/"), F.coalesce(p("subreddit"), p("sub"), F.col("name")))).when(F.col("connector").isin("rss", "html", "html_auto", "html_listing", "crawler") & (address != ""), address)
        .when(F.col("connector").isin("openfda", "faers"), "fda.gov/aers/daily").when(F.col("connector").isin("x", "x_stub", "twitter"), F.concat(F.lit("x.com/"), F.coalesce(p("handle"), F.col("name")))).otherwise(F.col("name"))
    )


def source_health(t: Tables, as_of: Column, limit: int = 20) -> DataFrame:
    rows = sources_with_health(t, as_of).join(t("projects").select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")
    colour = F.when(F.col("status") == "HEALTHY", "green").when(F.col("status") == "STALE", "amber").when(F.col("status").isin("PENDING", "IDLE"), "blue").otherwise("gray")
    top = rows.orderBy(F.desc("enabled"), F.desc_nulls_last("last_run_at"), "id").limit(limit)
    return top.select("id", "name", "connector", "latency", "enabled", "project_id", "last_run_at", "last_fetched", "last_inserted", "records_stored", "status", colour.alias("status_color"), identifier().alias("identifier"), F.coalesce("project_name", "project_id").alias("project_label"), relative(F.col("last_run_at"), as_of).alias("last_run_ago"), audit.labelled(F.col("connector"), CONNECTOR_LABELS).alias("type_label"))


def system_kpis(t: Tables, as_of: Column) -> DataFrame:
    """One row. Signals are counted by (project, drug, event)."""
    day, month = as_of - F.expr("INTERVAL 24 HOURS"), as_of - F.expr("INTERVAL 30 DAYS")
    is_ = lambda s: F.count_if(F.col("enabled") & (F.col("status") == s)).alias(s.lower())
    health = sources_with_health(t, as_of).agg(F.count("*").alias("sources_total"), F.count_if("enabled").alias("sources"), *map(is_, ("HEALTHY", "STALE", "EMPTY", "IDLE")))
    label = lambda s: F.count_if(F.col("sentiment_label") == s).alias(f"sent_{s}")
    records = t("records").agg(F.count("*").alias("records"), F.count("entities").alias("entities"), F.count("text_redacted").alias("redacted"), *map(label, ("adverse", "negative", "positive", "neutral")), F.coalesce(F.sum("pii_hits_count"), F.lit(0)).alias("pii_total"), F.count_if(F.col("pii_hits_count") > 0).alias("pii_records"))
    by = t("signals").where("n >= 3 AND prr >= 2").groupBy("project_id", "drug", "event").agg(F.bool_or(F.col("prr") >= 3).alias("hot"), F.bool_or(F.col("prr") < 3).alias("warm"), F.max("computed_at").alias("last"))
    signals = by.agg(F.count("*").alias("total_signals"), F.count_if("hot").alias("signals_critical"), F.count_if("warm").alias("signals_watch"), F.count_if(F.col("last") >= day).alias("new_signals"))
    projects = t("projects").agg(F.count("*").alias("projects"), F.count_if(F.col("created_at") >= month).alias("projects_new"))
    k = _cross(projects, health, records, signals)
    return k.withColumns({
        "flagged_total": F.col("signals_critical") + F.col("signals_watch"), "sent_concerning": F.col("sent_adverse") + F.col("sent_negative"), "uptime_str": F.concat(F.format_number(F.when(F.col("sources") > 0, 100.0 * F.col("healthy") / F.col("sources")).otherwise(100.0), 1), F.lit("%")),
        "records_str": F.format_number("records", 0), "entities_str": F.format_number("entities", 0), "pii_total_str": F.format_number("pii_total", 0), "degraded": F.col("stale"), "unhealthy": F.lit(0),
        "projects_delta_str": F.when(F.col("projects_new") > 0, F.concat(F.col("projects_new").cast("string"), F.lit(" since last month"))).otherwise("no change"), "projects_delta_dir": F.when(F.col("projects_new") > 0, "up").otherwise("flat"),
    })


def project_counts(t: Tables) -> DataFrame:
    sources = t("sources").select(F.col("id").alias("source_id"), "project_id", "enabled")
    per_source = t("records").groupBy("source_id").agg(F.count("*").alias("r"), F.count_if(F.size(F.coalesce("matched_keywords", F.array())) > 0).alias("e"))
    own = sources.join(per_source, "source_id", "left").join(t("watermarks").select("source_id", "last_run_at"), "source_id", "left").groupBy("project_id").agg(F.count("*").alias("sources_total"), F.count_if("enabled").alias("sources_active"), F.sum("r").alias("records"), F.sum("e").alias("entities"), F.max("last_run_at").alias("last_run"))
    latest = t("signals").groupBy("project_id").agg(F.max("computed_at").alias("computed_at"))
    flagged = t("signals").join(latest, ["project_id", "computed_at"]).groupBy("project_id").agg(F.count_if((F.col("prr") >= 2) & (F.col("n") >= 3)).alias("flagged"), F.max("computed_at").alias("latest_signals_ts"))
    out = t("projects").select(F.col("id").alias("project_id")).join(own, "project_id", "left").join(flagged, "project_id", "left")
    return out.fillna(0, ["sources_total", "sources_active", "records", "entities", "flagged"])


def project_rows(t: Tables) -> DataFrame:
    p = t("projects").select(F.col("id").alias("project_id"), "name", "keywords", "cadence", "updated_at", F.lower(F.coalesce("status", F.lit("running"))).alias("lifecycle"))
    label = F.when(F.col("lifecycle") == "closed", "CLOSED").when(F.col("lifecycle") == "paused", "PAUSED").when(F.col("last_run").isNotNull(), "RUNNING").otherwise("QUEUED")
    colour = F.when(F.col("lifecycle") == "closed", "gray").when(F.col("lifecycle") == "paused", "amber").when(F.col("last_run").isNotNull(), "green").otherwise("blue")
    rows = p.join(project_counts(t), "project_id").orderBy(F.desc("updated_at"), "project_id")
    return rows.select("project_id", "name", F.size(F.coalesce("keywords", F.array())).alias("kw_count"), "sources_active", "sources_total", "records", "flagged", "last_run", F.coalesce("cadence", F.lit("daily")).alias("cadence"), "lifecycle", label.alias("status"), colour.alias("status_color"))


def project_entities(t: Tables, project_id: str, limit: int = 50) -> DataFrame:
    own = t("sources").where(F.col("project_id") == project_id).select(F.col("id").alias("source_id"))
    rows = t("records").join(own, "source_id", "left_semi").select("id", "ingested_at", F.explode("entities").alias("e"))
    name = F.lower(F.trim(F.coalesce("e.normalized", "e.text", F.lit(""))))
    once = rows.select("id", "ingested_at", F.upper(F.coalesce("e.type", F.lit("OTHER"))).alias("type"), name.alias("name")).where("name <> ''").groupBy("type", "name", "id").agg(F.count("*").alias("m"), F.max("ingested_at").alias("at"))
    return once.groupBy("type", "name").agg(F.sum("m").alias("mentions"), F.count("*").alias("records"), F.max("at").alias("last_seen")).orderBy(F.desc("mentions"), "name", "type").limit(limit)


def decorated(signals: DataFrame) -> DataFrame:
    p, n, x = map(F.col, ("prr", "n", "chi2"))
    return signals.withColumns({"conf": dp.confidence(p, n), "conf_label": dp.confidence_label(p, n, x), "tier": dp.tier(p, n, x), "status": dp.status(p, n), "prr_color": dp.colour(p), "prr_str": dp.ratio_text(p), "chi_str": dp.ratio_text(x)})


def recent_signals(t: Tables, as_of: Column, limit: int = 6) -> DataFrame:
    rows = t("signals").where("prr >= 1.0").join(t("projects").select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")
    top = decorated(rows).orderBy(F.desc("computed_at"), F.desc("prr"), "id").limit(limit)
    return top.withColumns({"title": F.concat_ws(" → ", "drug", "event"), "is_new": F.col("computed_at") >= as_of - F.expr("INTERVAL 24 HOURS")})


def pair_connectors(t: Tables) -> DataFrame:
    """(project_id, drug, event, src_count, src_names): connectors of the project's own records that matched both as keywords."""
    keys = F.array_distinct(F.transform("matched_keywords", lambda k: F.lower(k)))
    rows = t("records").join(t("sources").select(F.col("id").alias("source_id"), "project_id", "connector"), "source_id").select("project_id", "connector", keys.alias("k"))
    # Both keywords of a record are in its own row; what is shuffled is one row for each pair of keywords and connector, not its records.
    both = rows.select("project_id", "connector", F.explode("k").alias("_d"), "k").select("project_id", "connector", "_d", F.explode("k").alias("_e")).distinct()
    pairs = t("signals").select("project_id", "drug", "event").distinct().withColumns({"_d": F.lower("drug"), "_e": F.lower("event")})
    by = pairs.join(both, ["project_id", "_d", "_e"]).select("project_id", "drug", "event", "connector").distinct().groupBy("project_id", "drug", "event")
    return by.agg(F.count("*").alias("src_count"), F.array_join(F.slice(F.array_sort(F.collect_list("connector")), 1, 4), ", ").alias("src_names"))


def all_signals(t: Tables, limit: int | None = None) -> DataFrame:
    """The latest of each flagged pair with its trend over the whole history and its sources, PRR descending."""
    keys = ["project_id", "drug", "event"]
    latest = dp.trend(t("signals").where("prr >= 2.0 AND n >= 3"), keys)
    rows = decorated(latest).join(pair_connectors(t), keys, "left").join(t("projects").select(F.col("id").alias("project_id"), F.coalesce("cadence", F.lit("daily")).alias("cadence")), "project_id", "left")
    rows = rows.withColumns({"src_count": F.coalesce("src_count", F.lit(0).cast("long")), "src_names": F.coalesce("src_names", F.lit("—"))}).orderBy(F.desc("prr"), *keys)
    return rows.limit(limit) if limit else rows


def project_signals(t: Tables, project_id: str, limit: int | None = None) -> DataFrame:
    rows = all_signals(t).where(F.col("project_id") == project_id)
    return rows.limit(limit) if limit else rows


def signal_detail(t: Tables, pairs: DataFrame, signal_id: int, as_of: Column) -> dict[str, DataFrame]:
    """What the investigation view reads. pairs: record_pairs of the signal's project, written once and read by all parts."""
    signal = decorated(t("signals").where(F.col("id") == signal_id))
    row = signal.first()
    if row is None:
        return {}
    own = pairs.where((F.lower("drug") == row["drug"].lower()) & (F.lower("event") == row["event"].lower()))
    adverse = pairs.where(F.col("sentiment_label").isin("adverse", "negative"))
    cells = dp.with_statistics(dp.cells(dp.marginals(adverse))).where((F.col("drug") == row["drug"]) & (F.col("event") == row["event"]))
    sources = t("sources").select(F.col("id").alias("source_id"), "connector", F.col("name").alias("source_name"), "latency")
    mine = own.join(sources, "source_id")
    at = F.coalesce("posted_at", "ingested_at")
    days = timeline.timeline(own, at)
    history = t("signals").where((F.col("project_id") == row["project_id"]) & (F.col("drug") == row["drug"]) & (F.col("event") == row["event"]) & (F.col("computed_at") <= F.lit(row["computed_at"])))
    trend = dp.trend(history, ["drug", "event"], order=["computed_at", "id"])
    named = F.when(F.coalesce("previous", F.lit(0.0)) <= 0, "Preliminary").when(F.col("trend") == "UP", "Rising Signal").when(F.col("trend") == "DOWN", "Declining Signal").otherwise("Stable Signal")
    evidence = t("records").join(own.select(F.col("record").alias("id")).distinct(), "id", "left_semi").join(sources, "source_id").orderBy(F.desc_nulls_last("posted_at"), F.desc("ingested_at"), "id").limit(12)
    sure = lambda kinds: F.coalesce(F.get(F.filter("entities", lambda e: e["type"].isin(*kinds)), F.lit(0))["confidence"], F.lit(0.0))
    percent = lambda c: F.round(100 * c).cast("int")
    label, pct = dp.strength(F.col("prr"), F.col("n"), F.col("conf"))
    connectors = mine.agg(F.array_sort(F.collect_set("connector")).alias("sources_involved"))  # as many as there are connectors
    total = pairs.agg(F.count("*").alias("pairs_total"))
    runs = t("watermarks").join(mine.select("source_id").distinct(), "source_id", "left_semi").agg(F.max("last_run_at").alias("last_fetched"))
    head = _cross(signal.withColumns({"strength_label": label, "strength_pct": pct}), connectors, total, runs)
    return {
        "signal": head.withColumn("quality_warning", dp.quality_warning(F.col("sources_involved"), F.col("pairs_total"))),
        "contingency": cells.withColumns({f"{c}_str": dp.ratio_text(F.col(c)) for c in ("prr", "ror", "chi2_floored")}),
        "source_breakdown": timeline.shares(mine, "connector", "source_name").orderBy(F.desc("n"), "connector", "source_name"),
        "timeline": days.orderBy("day"), "growth": timeline.halves_growth(days), "trend": trend.withColumn("trend_status", named),
        "sentiment_mix": timeline.label_mix(own, "sentiment_label"), "project_sentiment_mix": timeline.label_mix(t("records").join(t("sources").where(F.col("project_id") == row["project_id"]).select(F.col("id").alias("source_id")), "source_id", "left_semi"), "sentiment_label"),
        "trajectory": timeline.trajectory(own, at, "sentiment_label").orderBy("day"), "cadence": timeline.modes(mine, "latency"),
        "evidence": evidence.select("id", at.alias("at"), "connector", "source_name", F.upper(F.coalesce("sentiment_label", F.lit("neutral"))).alias("sentiment"), text.highlight(F.col("text_redacted"), F.lit(row["drug"]), F.lit(row["event"])).alias("snippet"), percent(sure(["DRUG"])).alias("drug_conf"), percent(sure(["SYMPTOM", "ADR_EVENT"])).alias("sym_conf"), "pii_hits_count", "url"),
    }


def audit_tail(t: Tables, limit: int = 8) -> DataFrame:
    return audit.listed(t("audit_log"), limit)


def activity(t: Tables, limit: int = 8) -> DataFrame:
    """(time, level, text) of the last runs, from their payloads."""
    body = F.from_json("payload_json", "fetched long, inserted long, duplicates long, flagged long, rows long")
    rows = t("audit_log").where(F.col("action").isin("run.start", "run.end", "source.done", "signals.computed", "ingest", "redact")).orderBy(F.desc("id")).limit(limit).withColumn("p", body)
    n = lambda k: F.coalesce(F.col(f"p.{k}"), F.lit(0).cast("long"))
    at = F.coalesce("target", F.lit("—"))
    quiet = (n("fetched") == 0) & (n("inserted") == 0)
    said = (
        F.when(F.col("action") == "run.start", F.format_string("Run started for %s", at)).when((F.col("action") == "source.done") & quiet, F.format_string("%s: no new records", at)).when(F.col("action") == "source.done", F.format_string("%s: fetched %d, inserted %d, duplicates %d", at, n("fetched"), n("inserted"), n("duplicates")))
        .when((F.col("action") == "run.end") & quiet, F.format_string("Run of %s ended without new records", at)).when(F.col("action") == "run.end", F.format_string("Run of %s ended: %d new of %d records", at, n("inserted"), n("fetched")))
        .when(F.col("action") == "signals.computed", F.format_string("Signals of %s: %d flagged of %d pairs", at, n("flagged"), n("rows"))).otherwise(F.concat_ws(" ", "action", at))
    )
    level = F.when(quiet & F.col("action").isin("source.done", "run.end"), "muted").when(F.col("action") == "source.done", "success").when((F.col("action") == "run.end") | (n("flagged") > 0), "ready").otherwise("info")
    return rows.select("id", F.date_format(F.try_to_timestamp("ts"), "HH:mm:ss").alias("time"), level.alias("level"), said.alias("text"))


def debug_log(t: Tables, limit: int = 12) -> DataFrame:
    return activity(t, limit)


def compliance_kpis(t: Tables) -> DataFrame:
    records = t("records").agg(F.count("*").alias("records_total"), F.count_if(F.col("pii_hits_count") > 0).alias("pii_records"))
    traced = t("sources").join(t("audit_log").select(F.col("target").alias("project_id")).distinct(), "project_id", "left_semi").select(F.col("id").alias("source_id"))
    k = _cross(records, _count(t("records").join(traced, "source_id", "left_semi"), "traced"))
    share = lambda c, empty: F.when(F.col("records_total") > 0, 100.0 * F.col(c) / F.col("records_total")).otherwise(empty)
    return k.withColumns({"pii_rate_pct": F.round(share("pii_records", 0.0), 1), "pii_below_thresh": share("pii_records", 0.0) < 10.0, "traceability_pct": F.round(share("traced", 100.0), 1), "pii_types": F.array(*map(F.lit, PII_TYPES))})


def compliance_log(t: Tables, limit: int = 12) -> DataFrame:
    """Redactions, signal runs that flagged something, and failures of sources, latest first."""
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    row = lambda df, ts, action, actor, subject, obs, tone: df.select(ts.alias("ts"), F.lit(action).alias("action"), F.lit(actor).alias("actor"), subject.alias("subject"), obs.alias("obs"), F.lit(tone).alias("tone"))
    redacted = t("records").where("pii_hits_count > 0").join(t("sources").select(F.col("id").alias("source_id"), "connector"), "source_id")
    a = row(redacted, when("ingested_at"), "DATA_REDACTION", "redaction", F.concat(F.lit("Record #"), F.col("id").cast("string"), F.lit(" ("), audit.labelled(F.col("connector"), CONNECTOR_LABELS), F.lit(")")), F.concat(F.col("pii_hits_count").cast("string"), F.when(F.col("pii_hits_count") == 1, " PII token").otherwise(" PII tokens"), F.lit(" removed at ingestion.")), "neutral")
    log = t("audit_log").withColumn("p", F.from_json("payload_json", "flagged long, rows long, error string"))
    at = when(F.try_to_timestamp("ts"))
    target = lambda empty: F.initcap(F.coalesce(F.nullif("target", F.lit("")), F.lit(empty)))
    number = F.lpad((F.col("id") % 1000).cast("string"), 3, "0")
    b = row(log.where("action = 'signals.computed' AND p.flagged > 0"), at, "SIGNAL_TRIAGE", "signal_job", F.concat(F.lit("Sig-"), number, F.lit(" ("), target("project"), F.lit(")")), F.format_string("%d signal(s) flagged of %d pair(s).", F.col("p.flagged"), F.coalesce("p.rows", F.lit(0).cast("long"))), "ok")
    c = row(log.where("action = 'source.error'"), at, "CONNECTOR_FAILURE", "watcher", target("source"), F.substring(F.coalesce("p.error", F.lit("The connector failed.")), 1, 160), "bad")
    return a.unionByName(b).unionByName(c).orderBy(F.desc("ts"), "action", "subject").limit(limit)


def search(t: Tables, query: str, signals: int = 30, projects: int = 20, sources: int = 20, index: DataFrame | None = None) -> DataFrame:
    """(kind, id, label): pairs, projects and sources that have the query in a name; its % and _ are wild, nothing else in it is. index: of
    the names in signals (operators/search.py); with it, patterns are held against the names that can match only."""
    pattern = F.lit(f"%{query.lower()}%".replace("\\", "\\\\"))
    like = lambda *cs: reduce(Column.__or__, (F.like(F.lower(c), pattern) for c in cs))
    hit = lambda df, cond, kind, ident, label, order, most: df.where(cond).orderBy(*order).limit(most).select(F.lit(kind).alias("kind"), ident.cast("string").alias("id"), label.alias("label"))
    rows, cond = t("signals"), like("drug", "event")
    if index is not None:
        names = trigrams.candidates(index, query).where(like("name"))
        of = lambda c: names.select(F.col("name").alias(c))
        rows, cond = rows.join(of("drug"), "drug", "left_semi").unionByName(rows.join(of("event"), "event", "left_semi").join(of("drug"), "drug", "left_anti").select(*rows.columns)), F.lit(True)
    a = hit(rows, cond, "signal", F.col("id"), F.concat_ws(" → ", "drug", "event"), (F.desc("computed_at"), F.desc("prr"), "id"), signals)
    b = hit(t("projects"), like("id", "name"), "project", F.col("id"), F.col("name"), ("id",), projects)
    return a.unionByName(b).unionByName(hit(t("sources"), like("name", "connector"), "source", F.col("id"), F.col("name"), ("id",), sources))


def about(t: Tables) -> DataFrame:
    return _cross(*(_count(t(name), name) for name in ("projects", "sources", "records", "signals", "audit_log")))


def project_summary(t: Tables, project_id: str) -> DataFrame:
    """Its sources with their watermarks and stored records."""
    stored = t("records").groupBy("source_id").agg(F.count("*").alias("records_stored"))
    own = t("sources").where(F.col("project_id") == project_id).select(F.col("id").alias("source_id"), "name", "connector", "enabled")
    return own.join(t("watermarks"), "source_id", "left").join(stored, "source_id", "left").fillna(0, ["records_stored"]).orderBy("source_id")


def records_csv(t: Tables, project_id: str) -> DataFrame:
    own = t("sources").where(F.col("project_id") == project_id).select(F.col("id").alias("source_id"), F.col("name").alias("source"), "connector")
    rows = t("records").join(own, "source_id").orderBy(F.desc("ingested_at"), "id")
    joined = F.array_join(F.coalesce("matched_keywords", F.array()), "; ")
    return rows.select("id", "source", "connector", "external_id", "url", "posted_at", "ingested_at", "sentiment_label", F.format_string("%.3f", "sentiment_score").alias("sentiment_score"), "pii_hits_count", F.coalesce(F.size("entities"), F.lit(0)).alias("entities_count"), joined.alias("matched_keywords"), F.regexp_replace("text_redacted", r"[\r\n]", " ").alias("text"))


def verification(t: Tables) -> DataFrame:
    return audit.verify(t("audit_log"))


def entity_mentions_per_day(t: Tables, project_id: str) -> DataFrame:
    """Mentions of each entity by day, with the running total of each."""
    own = t("sources").where(F.col("project_id") == project_id).select(F.col("id").alias("source_id"))
    rows = t("records").join(own, "source_id", "left_semi").select(F.to_date(F.coalesce("posted_at", "ingested_at")).alias("day"), F.explode("entities").alias("e")).groupBy("e.type", "e.normalized", "day").agg(F.count("*").alias("n"))
    return rows.withColumn("total", F.sum("n").over(Window.partitionBy("type", "normalized").orderBy("day")))
