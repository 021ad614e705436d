"""Counts that batches add to, event-time state, days of a stream, commits of several writers, models in ingestion."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from signalmill import store as stores
from signalmill.errors import ConflictError
from signalmill.functions import extract
from signalmill.operators import changes, counters, timeline
from signalmill.operators import disproportionality as dp
from signalmill.plans import reporting
from signalmill.project import Project
from signalmill.sources import feeds, registry
from signalmill.store import Store
from signalmill.streaming import events, ingest, jobs, scoring

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)
TEXTS = ["Dolo gave me rash", "crocin, then nausea and rash", "severe side effect: dolo and fever", "metformin is fine", "no rash from crocin", "weather", "dolo and nausea and dizziness", ""]


def raw_rows(spark, ids, start=datetime(2024, 5, 1, tzinfo=timezone.utc)):
    rows = [(f"e{k}", f"{TEXTS[k % len(TEXTS)]} {k}", start + timedelta(minutes=k)) for k in ids]
    return feeds.shaped(spark.createDataFrame(rows, "external_id string, text string, posted_at timestamp"))


def stored(spark, store, ids, source_id=1, **more):
    rows = ingest.enriched(raw_rows(spark, ids).withColumn("matched_keywords", F.array(F.lit("dolo"))), source_id, NOW)
    return ingest.store_batch(store, rows, source_id, NOW, **more)


def project(*names, **source):
    return Project.from_dict({"id": "p", "name": "P", "keywords": ["dolo"], "time_window": {"since": "2024-01-01"}, "sources": [{"name": n, "connector": "wa", "params": {"path": "x", **source}} for n in names]})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- counts kept up to date ---


@pytest.mark.parametrize("adverse", [False, True])
def test_counts_of_batches_equal_a_recount(spark, tmp_path, adverse):
    """Three batches with repeats in them, of two sources: statistics as of all records at once, examples and window too."""
    store = Store(spark, str(tmp_path / "tables"))
    store.save_project(project("a", "b"), NOW)
    stored(spark, store, range(0, 40))
    stored(spark, store, range(30, 60), 2)
    stored(spark, store, range(50, 90))
    got = jobs.compute_signals(store, "p", NOW, adverse, min_n=1)
    pairs = jobs.record_pairs(store, "p", adverse)
    full = dp.compute(pairs, min_n=1)
    stored_rows = store.table("signals").select("drug", "event", "n", "prr", "chi2", "ic")
    assert rows_of(stored_rows) == rows_of(full.select("drug", "event", "n", "prr", "chi2", "ic")) and got["rows"] == full.count() > 3
    window = timeline.bounds(pairs, "posted_at").first()
    kept = store.table("signals").select("window_since", "window_until").distinct().collect()
    assert [tuple(r) for r in kept] == [(window["window_since"], window["window_until"])] and got["pairs"] == window["n"]
    examples = {(r["drug"], r["event"]): r["examples"] for r in dp.examples(pairs, ["drug", "event"], "record", "text_redacted").collect()}
    assert all(r["examples"] == examples[r["drug"], r["event"]] for r in got["top"])


def test_signals_read_no_record(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "tables"))
    store.save_project(project("a"), NOW)
    stored(spark, store, range(20))
    read, asked = Store._read, []
    monkeypatch.setattr(Store, "_read", lambda self, name, folders: asked.append(name) or read(self, name, folders))
    jobs.compute_signals(store, "p", NOW, min_n=1)
    assert "records" not in asked and "pair_counts" in asked


def test_counts_follow_changes_of_records(spark, tmp_path):
    """Records that are replaced are counted again; a reset takes the project's counts and leaves others'."""
    store = Store(spark, str(tmp_path / "tables"))
    store.save_project(project("a"), NOW)
    stored(spark, store, range(20))
    stored(spark, store, range(100, 110), 7)
    store.replace("records", store.table("records").where("external_id <> 'e0'"))
    assert not store.snapshot().has("pair_counts")
    stored(spark, store, range(200, 202))  # counts aren't begun in the middle
    assert not store.snapshot().has("pair_counts")
    jobs.compute_signals(store, "p", NOW, min_n=1)
    assert rows_of(store.table("signals").select("drug", "event", "n")) == rows_of(dp.compute(jobs.record_pairs(store, "p"), min_n=1).select("drug", "event", "n"))
    store.reset_project("p")
    assert {r["source_id"] for r in store.table("pair_counts").collect()} == {7} == {r["source_id"] for r in store.table("records").collect()}


def test_deltas_add_up_in_any_order(spark):
    rows = [(k, 1 + k % 2, datetime(2024, 1, 1) + timedelta(hours=k), f"text {k}", "d" if k % 3 else "x", "e", k % 4 == 0) for k in range(30)]
    pairs = spark.createDataFrame(rows, "record long, source_id long, posted_at timestamp, text_redacted string, drug string, event string, adverse boolean")
    parts = [counters.deltas(pairs.where(F.col("record") % 3 == k)) for k in (2, 0, 1)]
    added = counters.merged(counters.merged(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    assert rows_of(added.select(*counters.KEYS, "n", "first_at", "last_at", "examples")) == rows_of(counters.deltas(pairs).select(*counters.KEYS, "n", "first_at", "last_at", "examples"))
    assert all(len(r["examples"]) <= counters.EXAMPLES for r in added.collect())


def test_small_folders_of_counts_are_added_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_FOLDERS", 3)
    store = Store(spark, str(tmp_path / "tables"))
    for k in range(5):
        stored(spark, store, range(8 * k, 8 * k + 8))
    assert len(store._state()["tables"]["pair_counts"]) <= 3
    whole = scoring._counted(store.table("records"))
    assert rows_of(counters.merged(store.table("pair_counts"))) == rows_of(counters.merged(whole))
    assert store.table("pair_counts").groupBy(*counters.KEYS).count().where("count > 3").isEmpty()


def test_pairs_alone_are_those_of_entities(spark):
    texts = [*TEXTS, "Dolo DOLO and rash, Rash", "paracetamol or dolo: RASH", "aspirin", "rash", None, "Dolo gave me rash"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = rows.select("id", extract.ner_pairs("t").alias("alone"), extract.ner_entities("t")["pairs"].alias("whole")).orderBy("id").collect()
    assert [r["alone"] for r in got] == [r["whole"] for r in got] and sum(map(len, (r["alone"] for r in got))) > 8
    labels = rows.select("id", F.when(F.col("id") % 2 == 0, F.lit("kept")).alias("sentiment_label"), F.col("t").alias("text_redacted")).select("id", scoring.labels().alias("l")).orderBy("id")
    assert [r["l"] for r in labels.collect()] == ["kept" if k % 2 == 0 else extract.sentiment(t)["label"] for k, t in enumerate(texts)]


def test_a_batch_is_dealt_by_each_key_once(spark, tmp_path):
    """For its repeats and for the stored keys at once, with what new_records gives: a row of a stored source key is still the first of its hash."""
    store = Store(spark, str(tmp_path / "tables"))
    stored(spark, store, range(20))
    seventh = store.table("records").where("external_id = 'e7'").first()["content_hash"]
    at = datetime(2024, 5, 2, tzinfo=timezone.utc)
    rows = [(1, "e5", "new", at), (1, "e90", "new", at + timedelta(1)), (1, "e91", seventh, at), (1, "e92", "a", at), (1, "e92", "b", at + timedelta(1)), (2, "e92", "b", at), (2, "e5", "c", at), (2, "e6", "c", at + timedelta(1))]
    batch = spark.createDataFrame(rows, "source_id long, external_id string, content_hash string, posted_at timestamp")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = changes.unknown_records(batch, store.table("record_keys"))
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert rows_of(new) == rows_of(changes.new_records(batch, store.table("records"))) and sorted(r["content_hash"] for r in new.collect()) == ["a", "b", "c"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert plan.count("Exchange hashpartitioning(") == 4  # the batch twice, the stored keys twice


def test_records_without_a_hash_share_no_key(spark, tmp_path):
    """Else half of all keys would meet in one task, and any later record without a hash would be held to be known."""
    schema = "source_id long, external_id string, content_hash string, posted_at timestamp"
    at = datetime(2024, 5, 2, tzinfo=timezone.utc)
    kept = spark.createDataFrame([(1, f"e{k}", None, at) for k in range(500)] + [(1, "e500", "a", at)], schema)
    keys = changes.keys_of(kept)
    assert keys.count() == 502 and keys.groupBy("bucket").count().agg(F.max("count")).first()[0] < 20
    batch = spark.createDataFrame([(1, "e3", None, at), (1, "e600", "a", at), (1, "e601", "b", at)], schema)
    assert rows_of(changes.unknown_records(batch, keys)) == rows_of(changes.new_records(batch, kept))
    later = spark.createDataFrame([(1, "e602", None, at)], schema)
    assert [r["external_id"] for r in changes.unknown_records(later, keys).collect()] == ["e602"]


# --- event time ---


def replay(spark, path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_unique_within_a_watermark(spark, tmp_path):
    """Repeats within the delay are dropped as exactly as by all that was ever read; rows behind the watermark are dropped and counted."""
    at = lambda day, hour=0: datetime(2024, 1, day, hour)
    batches = [[("a", at(1)), ("b", at(2)), ("a", at(1, 5))], [("b", at(2, 3)), ("c", at(4))], [("d", at(9)), ("c", at(8))], [("old", at(1)), ("e", at(9, 5))], [("f", at(10)), ("older", at(3))]]
    progress = events.Progress().attach(spark)
    stream = events.unique_within(replay(spark, tmp_path / "in", batches, "external_id string, posted_at timestamp"), "3 days", ["external_id"])
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.streams.removeListener(progress)
    got = sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("external_id").collect())
    assert got == ["a", "b", "c", "c", "d", "e", "f"] or got == ["a", "b", "c", "d", "e", "f"]
    late = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    assert late == 2
    told = progress.told(q.id)
    assert told["late"] in (0, late) and told["rows"] in (0, sum(map(len, batches)))  # listeners hear of a batch some time after it


def test_bounded_stream_stores_what_the_exact_one_does(spark, tmp_path):
    """Inside the delay, the same records with state of bounded size as without."""
    source, made = project("a").sources[0], []
    for delay in (None, "30 days"):
        base = tmp_path / str(delay)
        rows = lambda ids: [tuple(r) for r in raw_rows(spark, ids).collect()]
        raw = replay(spark, base / "in", [rows(range(0, 12)), rows(range(6, 20)), rows(range(0, 25))], raw_rows(spark, []).schema)
        store = Store(spark, str(base / "tables"))
        ingest.stream_records(store, source, 1, ["dolo"], raw, str(base / "check"), NOW, delay=delay).awaitTermination()
        made.append(rows_of(store.table("records").select("external_id", "content_hash", "posted_at")))
    assert made[0] == made[1] and len(made[0]) > 10


def test_days_of_a_stream(spark, tmp_path):
    at = lambda day, hour: datetime(2024, 1, day, hour)
    batches = [[("x", at(d, h)) for d in (1, 2) for h in (0, 23)] + [("y", at(1, 5)), ("y", None)], [("x", at(2, 12)), ("x", at(3, 1)), ("y", at(4, 0))], [("x", at(6, 0)), ("y", at(6, 23))]]
    stream = replay(spark, tmp_path / "in", batches, "kind string, ts timestamp")
    path, check = str(tmp_path / "out"), str(tmp_path / "check")
    events.write_days(stream, "ts", "2 hours", path, check, "kind").awaitTermination()
    every = spark.createDataFrame([r for b in batches for r in b], "kind string, ts timestamp")
    want = rows_of(timeline.daily_counts(every, F.col("ts"), "kind").select("kind", "day", "n"))
    assert rows_of(events.days_so_far(spark, path, check, "kind")) == want
    told = rows_of(spark.read.parquet(path).select("kind", "day", "n"))
    assert set(told) < set(want) and len(told) >= 4
    more = [[("x", at(9, 0))]]
    stream = replay(spark, tmp_path / "in", more, "kind string, ts timestamp")
    events.write_days(stream, "ts", "2 hours", path, check, "kind").awaitTermination()
    assert set(told) < set(rows_of(spark.read.parquet(path).select("kind", "day", "n")))


# --- commits ---


def test_two_writers(spark, tmp_path):
    """Each makes its change anew on what the other committed; a change of what is no longer last is told."""
    a, b = Store(spark, str(tmp_path / "t")), Store(spark, str(tmp_path / "t"))
    a.save_project(project("a"), NOW)
    base, calls = a.snapshot(), []

    def change(at):
        calls.append(at.number)
        if len(calls) == 1:
            b.set_fields("p", cadence="weekly")
        return {"replaced": {"projects": at.table("projects").withColumn("description", F.lit("changed"))}}

    assert a.transact(change) and len(calls) == 2
    row = a.table("projects").first()
    assert (row["cadence"], row["description"]) == ("weekly", "changed")
    with pytest.raises(ConflictError):
        b.commit(replaced={"projects": base.table("projects")}, base=base)
    a.append_audit("x", "run.start")
    b.append_audit("y", "run.end")
    assert a.table("audit_log").count() == 3 and reporting.verification(a.table).first()["ok"]


def test_a_batch_beside_another_writer(spark, tmp_path, monkeypatch):
    """Two writers that store the same rows: those are stored once, with one entry of each in the counts."""
    a, b = Store(spark, str(tmp_path / "t")), Store(spark, str(tmp_path / "t"))
    commit, raced = Store._commit, []

    def racing(self, number, state):
        if self is a and not raced:
            raced.append(stored(spark, b, range(5, 15))["inserted"])
        return commit(self, number, state)

    monkeypatch.setattr(Store, "_commit", racing)
    told = stored(spark, a, range(10))
    assert raced == [10] and (told["fetched"], told["inserted"], told["duplicates"]) == (10, 5, 5)
    assert a.table("records").count() == 15 == a.table("records").select("external_id").distinct().count()
    assert rows_of(counters.merged(a.table("pair_counts"))) == rows_of(counters.merged(scoring._counted(a.table("records"))))


def test_a_project_is_saved_whole_or_not(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "t"))
    store.save_project(project("a"), NOW)
    for at in range(1, 4):  # lost after each write that a save takes
        calls, write = [], Store._write

        def failing(self, name, df, at=at, calls=calls, write=write):
            calls.append(name)
            if len(calls) == at:
                raise OSError("lost")
            return write(self, name, df)

        monkeypatch.setattr(Store, "_write", failing)
        with pytest.raises(OSError):
            store.save_project(project("b", "c"), NOW)
        monkeypatch.setattr(Store, "_write", write)
        assert [s.name for s in store.load_project("p").sources] == ["a"] and store.table("audit_log").count() == 1
    number = store.snapshot().number
    store.save_project(project("b", "c"), NOW)
    assert [s.name for s in store.load_project("p").sources] == ["b", "c"] and store.snapshot().number == number + 1


def test_what_is_written_again_is_bounded(spark, tmp_path, monkeypatch):
    """Folders above the bound stay; the small ones are put together."""
    monkeypatch.setattr(stores, "MOST_FOLDERS", 2)
    store = Store(spark, str(tmp_path / "t"))
    big = spark.range(20_000).select(F.col("id"), F.lit("2024").alias("ts"), F.sha2(F.col("id").cast("string"), 256).alias("hash"), *(F.lit(None).cast("string").alias(c) for c in ("actor", "action", "target", "payload_json", "prev_hash")))
    store.append("audit_log", big)
    large = store._state()["tables"]["audit_log"][0]
    monkeypatch.setattr(stores, "SMALL_BYTES", store._bytes("audit_log", large))
    for k in range(5):
        store.append("audit_log", big.limit(2).coalesce(1))
    folders = store._state()["tables"]["audit_log"]
    assert large in folders and len(folders) <= 3 and store.table("audit_log").count() == 20_010


def test_one_tick_over_processes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    store.save_project(project("a"), NOW)
    assert store.lease("tick", "another process", 60) and not store.lease("tick", "us", 60)
    assert jobs.Scheduler(store).tick(NOW) == {"skipped": True}
    assert store.lease("tick", "another process", 0)
    assert jobs.Scheduler(store).tick(NOW)["projects"] == 1
    assert store.lease("tick", "us", 0.0)


# --- models ---


def stub():
    def find(text):
        at = text.find("newmab")
        return [("DRUG", at, at + 6, "NewMab")] if at >= 0 else []

    return extract.Model("stub", lambda: find)


def test_a_models_names_are_stored(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "t"))
    p = project("a")
    store.save_project(p, NOW)
    rows = spark.createDataFrame([("1", "newmab and rash, dolo", NOW), ("2", "plain dolo", NOW)], "external_id string, text string, posted_at timestamp")
    monkeypatch.setattr(registry, "read", lambda *a, **k: feeds.shaped(rows))
    ingest.run_source(store, p, p.sources[0], 1, ["dolo"], NOW, stub())
    got = {r["external_id"]: {(e["type"], e["normalized"], e["confidence"]) for e in r["entities"]} for r in store.table("records").collect()}
    assert ("DRUG", "newmab", 0.75) in got["1"] and {e[1] for e in got["2"]} == {"paracetamol"}


def test_a_model_is_loaded_once(monkeypatch):
    loads = []
    monkeypatch.setattr(extract, "_models", {})
    model = extract.Model("m", lambda: loads.append(1) or (lambda t: []))
    assert extract._loaded(model) is extract._loaded(model) and loads == [1]
    assert extract.named_model(None) is None and extract.named_model("no-such-model").load() is None
    assert extract.ner_of(None) is extract.ner_entities


# --- names ---


def test_trie_finds_what_the_alternation_does(spark):
    """Leftmost and longest, whole runs, any letter case; names with spaces, signs and other letters; against a scan by regular expression."""
    import random
    import re

    from signalmill import lexicon
    from signalmill.functions.names import NameTrie

    rng = random.Random(3)
    lists = [[*lexicon.BRAND_TO_GENERIC, *lexicon.GENERIC_DRUGS], list(lexicon.SYMPTOMS), ["a", "a b", "a b c", "b c d", "b-", "-b", "é a", "a  b", "++", "a+", "c 1", "1 c 1", "aB"]]
    documents = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for names in lists:
        pattern = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(map(re.escape, sorted(set(names), key=lambda n: (-len(n), n))))})(?![A-Za-z0-9])", re.I)
        parts = [p for n in names for p in re.findall(r"\w+|\W", n)]
        made = ["".join(rng.choice([*parts, " ", " ", "-", "x", "É", "İ", "ſ", "K"]) for _ in range(rng.randrange(40))) for _ in range(1_500)]
        trie = NameTrie(names)
        for text in [*made, *documents, "", "a" * 5_000, "a b " * 2_000]:
            assert list(trie.find(text)) == [m.span() for m in pattern.finditer(text)], text[:200]
    assert list(NameTrie(["", "x"]).find("x y")) == [(0, 1)] and list(NameTrie([]).find("x")) == []


def test_trie_cost_is_flat():
    """Look-ups of a text are as many for 30,000 names as for 300."""
    import time

    from signalmill.functions.names import NameTrie

    text, took = "some words that are no name of anything here " * 2_000, []
    for n in (300, 30_000):
        trie = NameTrie([f"name{k} of thing{k % 7}" for k in range(n)])
        best = min(_timed(lambda: list(trie.find(text)), time) for _ in range(3))
        took.append(best)
    assert took[1] < 4 * took[0]


def _timed(f, time):
    at = time.perf_counter()
    f()
    return time.perf_counter() - at


def test_mentions_of_a_large_list(spark):
    from signalmill.functions.names import mentions_of

    names = {f"Drug{k} forte": f"generic{k}" for k in range(5_000)}
    df = spark.createDataFrame([("took drug17 FORTE and DRUG4999 forte, drug17 forte2",), (None,), ("",)], "t string")
    got = [r["m"] for r in df.select(mentions_of(names)("t").alias("m")).collect()]
    assert [(m["start"], m["end"], m["name"]) for m in got[0]] == [(5, 17, "generic17"), (22, 36, "generic4999")] and got[1:] == [[], []]


def test_near_names_equal_brute_force(spark):
    import difflib
    import random

    from signalmill.functions.near import near_names

    rng = random.Random(4)
    names = ["nausea", "vomiting", "headache", "stomach pain", "burning sensation", "rash", "itch", "a", "ab", "abab", "ababab", *("".join(rng.choice("abc") for _ in range(rng.randrange(3, 18))) for _ in range(60))]
    terms = ["nausae", "vomitting", "headach", "zzz", "stomac pain", "", None, "burningsensation", *names[:5]]
    for n in names * 4:
        t = list(n)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = rng.choice(["", "a", "x", "bc"])
        terms.append("".join(t))
    got = near_names(spark.createDataFrame([(t,) for t in terms * 2], "term string"), spark.createDataFrame([(n,) for n in names * 2], "name string"))
    mine = {}
    for r in got.orderBy("term", "nth").collect():
        mine.setdefault(r["term"], []).append(r["name"])
    want = {t: difflib.get_close_matches(t, sorted(set(names)), n=8, cutoff=0.82) for t in set(terms) if t}
    assert mine == {t: n for t, n in want.items() if n} and len(mine) > 60


# --- streams that are kept running ---


def inbox(path, ids):
    import json

    path.mkdir(exist_ok=True)
    (path / f"{min(ids)}.json").write_text(json.dumps([{"id": f"m{k}", "from": "u", "ts": f"2024-05-01T00:{k:02d}:00Z", "lang": "en", "text": f"{TEXTS[k % 5]} {k}"} for k in ids]))


def test_streams_follow_the_status(spark, tmp_path):
    """A project's stream runs while the project does: paused, it ends; resumed, it goes on where it was; a second supervisor leaves it alone."""
    from signalmill.streaming.supervise import Supervisor, start_source

    inbox(tmp_path / "in", range(0, 5))
    store = Store(spark, str(tmp_path / "t"))
    p = project("inbox", path=str(tmp_path / "in"))
    p.sources.append(type(p.sources[0])("page", "html", {"url": "x"}))
    store.save_project(p, NOW)
    start = lambda *a: start_source(*a, now=lambda: NOW, delay="30 days", processingTime="0 seconds")
    mine, other = Supervisor(store, start), Supervisor(store, start)
    try:
        assert mine.look()["started"] == ["p:1"] and "skipped" in other.look() and not other.queries
        mine.queries["p:1"].processAllAvailable()
        assert store.table("records").count() == 5
        first = mine.queries["p:1"]
        assert mine.look() == {"started": [], "stopped": [], "failed": []}
        store.set_fields("p", status="paused")
        assert mine.look()["stopped"] == ["p:1"] and not first.isActive
        inbox(tmp_path / "in", range(5, 8))
        assert mine.look() == {"started": [], "stopped": [], "failed": []} and store.table("records").count() == 5
        store.set_fields("p", status="running")
        assert mine.look()["started"] == ["p:1"]
        mine.queries["p:1"].processAllAvailable()
        assert store.table("records").count() == 8 and store.table("watermarks").first()["last_fetched"] == 3
        assert {"stream.started", "stream.stopped"} <= {r["action"] for r in store.table("audit_log").collect()}
    finally:
        mine.stop()
        other.stop()
    assert not [q for q in spark.streams.active if q.name == "p:1"] and store.lease("streams", "us", 0)


def test_a_failing_stream_is_told_and_started_again(spark, tmp_path):
    from signalmill.streaming.supervise import Supervisor, start_source

    inbox(tmp_path / "in", range(0, 3))
    store, tries = Store(spark, str(tmp_path / "t")), []
    store.save_project(project("inbox", path=str(tmp_path / "in")), NOW)

    def start(*a):
        tries.append(1)
        if len(tries) == 1:
            raise ValueError("no such path")
        return start_source(*a, now=lambda: NOW, processingTime="0 seconds")

    s = Supervisor(store, start)
    try:
        assert s.look()["failed"] == ["p:1"] and s.look()["started"] == ["p:1"]
        s.queries["p:1"].processAllAvailable()
        assert store.table("records").count() == 3
    finally:
        s.stop()


def test_listings_go_on_at_their_cursors(spark, tmp_path):
    """A page of each subreddit a batch; started again, a query reads on at the cursors that its checkpoint holds."""
    import json

    from signalmill.project import SourceConfig

    post = lambda k: {"data": {"id": k, "title": "T", "selftext": "dolo", "permalink": f"/{k}", "author": "a", "created_utc": 1.7e9}}
    page = lambda name, after, ids, then: (tmp_path / f"{name}-{after}.json").write_text(json.dumps({"data": {"after": then, "children": [post(i) for i in ids]}}))
    page("a", "", ["a1", "a2"], "x")
    page("a", "x", ["a3"], "y")
    page("b", "", ["b1"], None)
    source = SourceConfig("r", "reddit", {"subreddits": ["a", "b"], "listing_url": f"file://{tmp_path}/{{name}}-{{after}}.json", "pages": 9})

    def run():
        from signalmill.sources import registry

        q = registry.read_stream(spark, source, F.lit(NOW)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("external_id").collect())

    assert run() == ["reddit:a1", "reddit:a2", "reddit:a3", "reddit:b1"]
    for old in ("a-", "a-x", "b-"):  # what was read isn't asked for again
        (tmp_path / f"{old}.json").unlink()
    page("a", "y", ["a4"], None)
    assert run() == ["reddit:a1", "reddit:a2", "reddit:a3", "reddit:a4", "reddit:b1"]


# --- pages and feeds ---


def test_text_at_any_depth():
    """Nothing under however many open elements is lost."""
    from signalmill.sources import html

    body = "words of a block " * 6
    for depth in (300, 500, 20_000):
        page = "<div>" * depth + f"<p>{body}</p><a href='/in'>x</a>" + "</div>" * depth + f"<p>after {body}</p>"
        assert html.blocks(page)[1] == [body.strip(), f"after {body}".strip()] and html.links("http://h/", page) == ["http://h/in"]
    assert html.blocks("</div></p>" * 50 + f"<span><p>{body}</span>")[1] == [body.strip()]


def test_atom_and_feed_languages(spark, tmp_path):
    from signalmill.project import SourceConfig

    entry = "<entry><id>u:1</id><title type='text'>One</title><link rel='self' href='http://a/self'/><link href='http://a/1'/><summary>S &lt;b&gt;x&lt;/b&gt;</summary><updated>2024-01-03T10:00:00+05:30</updated><author><name>Ann</name></author></entry>"
    (tmp_path / "atom.xml").write_text(f"<feed xmlns='http://www.w3.org/2005/Atom' xml:lang='fr'>{entry}<entry><id>u:2</id><title>Two</title><content>C</content></entry></feed>")
    for params in ({"feed_url": f"file://{tmp_path}/atom.xml", "row_tag": "entry"}, {"path": str(tmp_path / "atom.xml"), "row_tag": "entry", "language": "fr"}):
        rows = {r["external_id"]: r for r in registry.read(spark, SourceConfig("f", "rss", params), F.lit(NOW)).collect()}
        one = rows["rss:u:1"]
        assert (one["url"], one["text"], one["author_handle"], one["language_hint"]) == ("http://a/1", "One\n\nS x", "Ann", "fr") and one["posted_at"] == datetime(2024, 1, 3, 4, 30)
        assert rows["rss:u:2"]["text"] == "Two\n\nC" and rows["rss:u:2"]["url"] is None
    (tmp_path / "rss.xml").write_text("<rss><channel><language> en-gb </language><item><guid>1</guid><title>T</title><link>http://b/1</link></item></channel></rss>")
    row = registry.read(spark, SourceConfig("f", "rss", {"feed_url": f"file://{tmp_path}/rss.xml"}), F.lit(NOW)).first()
    assert (row["language_hint"], row["url"]) == ("en-gb", "http://b/1")


def test_starts_of_windows_as_a_column(spark):
    from signalmill.windows import TimeWindow

    marks = [None, datetime(2024, 5, 1), datetime(2024, 5, 30, 12)]
    df = spark.createDataFrame([(m,) for m in marks], "m timestamp_ntz")
    for window in (TimeWindow(), TimeWindow(30), TimeWindow(3, datetime(2024, 4, 1, tzinfo=timezone.utc)), TimeWindow(None)):
        want = [window.effective(NOW, m and m.replace(tzinfo=timezone.utc))[0].replace(tzinfo=None) for m in marks]
        assert [r[0] for r in df.select(window.start(NOW, F.col("m"))).collect()] == want


# --- search ---


def test_search_by_trigrams(spark, tmp_path):
    """The same hits as by a scan; only the folders of the query's trigrams are read; kept with the commits of signals, and made anew where not."""
    from signalmill.operators import search

    store = Store(spark, str(tmp_path / "t"))
    store.save_project(project("a"), NOW)
    stored(spark, store, range(40))
    jobs.compute_signals(store, "p", NOW, min_n=1)
    assert store.snapshot().has("signal_grams")
    for query in ("rash", "RASH", "par_cet%ol", "a", "%", "et", "mol", "x_%", "zzz", "a\\b", "'", "naus%a"):
        by_scan = rows_of(reporting.search(store.table, query))
        assert rows_of(reporting.search(store.table, query, index=jobs.name_index(store))) == by_scan, query
    plan = search.candidates(store.table("signal_grams"), "rash")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    asked = store.table("signal_grams").where(F.col("bucket").isin([search._bucket(F.lit(g)) for g in search.wanted("rash")]))
    folders = {r[0].rsplit("/", 2)[1] for r in asked.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(folders) <= len(search.wanted("rash"))
    store.replace("signals", store.table("signals").where("drug <> 'paracetamol'"))
    assert not store.snapshot().has("signal_grams")
    assert rows_of(reporting.search(store.table, "aspi", index=jobs.name_index(store))) == rows_of(reporting.search(store.table, "aspi"))
    assert store.snapshot().has("signal_grams")


def test_trigrams(spark):
    from signalmill.operators import search

    assert search.wanted("Rash") == ["ras", "ash"] and search.wanted("ab%cd_efg") == ["efg"] and search.wanted("") == []
    names = spark.createDataFrame([(n,) for n in ("abcabc", "ab", "", None, "ABC", "xabcd")], "name string")
    index = search.postings(names)
    assert {r["gram"] for r in index.where("name = 'abcabc'").collect()} == {"abc", "bca", "cab"}
    assert {r[0] for r in search.candidates(index, "abc").collect()} == {"abcabc", "ABC", "xabcd"} and {r[0] for r in search.candidates(index, "b").collect()} == {"abcabc", "ab", "", "ABC", "xabcd"}


# --- live back-ends, from captured answers ---


def test_posts_by_search(spark, tmp_path):
    import json

    from signalmill.project import SourceConfig

    tweets = [{"id": "7", "text": "dolo rash", "createdAt": "Tue Dec 10 07:00:30 +0000 2024", "lang": "en", "author": {"userName": "ann"}}, {"id": "8", "text": "later", "createdAt": None}, {"id": None, "text": "no id"}, {"id": "9", "text": "beyond"}]
    (tmp_path / "search.json").write_text(json.dumps({"tweets": tweets}))
    (tmp_path / "old.json").write_text(json.dumps([{"id": "1", "author": "b", "created_at": "2024-01-05T00:00:00Z", "lang": "en", "text": "captured"}]))
    read = lambda **p: {r["external_id"]: r for r in registry.read(spark, SourceConfig("s", "x", p), F.lit(NOW)).collect()}
    live = read(api_key="k", query="dolo", search_url=f"file://{tmp_path}/search.json", max_results=3)
    assert set(live) == {"x:7", "x:8"} and live["x:7"]["posted_at"] == datetime(2024, 12, 10, 7, 0, 30) and live["x:7"]["author_handle"] == "ann" and live["x:7"]["url"] == "https://x.com/i/status/7"
    assert live["x:8"]["posted_at"] == NOW.replace(tzinfo=None)
    assert set(read(api_key="k", query="dolo", search_url=f"file://{tmp_path}/away.json", path=str(tmp_path / "old.json"))) == {"x:1"} == set(read(path=str(tmp_path / "old.json")))


def test_terms_of_a_server(tmp_path, capsys):
    import http.server
    import json
    import threading

    from signalmill import cli
    from signalmill.functions import keywords

    said = ['Here: ["loose motion", " dast ", 3, ""] done', "no list", '{"a": [1}']
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            answer = json.dumps({"response": said[min(len(asked), len(said)) - 1]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/generate"
    try:
        ask = keywords.server_terms(url, "m")
        assert ask("diarrhea") == ["loose motion", "dast"] and ask("x") == ask("x") == [] and asked[0]["model"] == "m" and "diarrhea" in asked[0]["prompt"]
        del asked[:]
        for _ in range(2):
            assert cli.main(["expand", "diarrhea", "--ask", url, "--cache", str(tmp_path / "c.json")]) == 0
        assert "loose motion" in capsys.readouterr().out and len(asked) == 1
    finally:
        server.shutdown()
    assert keywords.server_terms("http://127.0.0.1:9/", "m", timeout=1)("x") == []


def test_letters_differ_by_no_more_than_edits():
    from signalmill.functions import near

    for a, b, edits in (("telmisartan", "telmisartn", 1), ("aaaa", "aa", 2), ("", "é", 1), ("abcabc", "cbacba", 0), ("ondansetron", "ondansteron", 0)):
        assert ((near.letters(a) ^ near.letters(b)) & (1 << 64) - 1).bit_count() <= edits


def syllables(rng, n, of=("th", "er", "ing", "on", "tion", "en", "sch", "é", "que", "ou", "ß", "ía")):
    return list(dict.fromkeys("".join(rng.choice(of) for _ in range(rng.randrange(3, 8))) for _ in range(n)))


def test_near_names_of_many_words_end_in_time(spark):
    """30,000 terms by 1,500 names of few syllables: nearly all share a segment of two letters with many."""
    import random
    import time

    from signalmill.functions.near import near_names, ratio

    rng = random.Random(7)
    terms, names = syllables(rng, 31_000)[:30_000], syllables(rng, 1_600)[:1_500]
    frames = spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(n,) for n in names], "name string")
    near_names(*(df.limit(10) for df in frames)).count()
    began = time.perf_counter()
    got = near_names(*frames).collect()
    assert time.perf_counter() - began < 12
    mine = {t: [(r["name"], r["ratio"]) for r in sorted(got, key=lambda r: r["nth"]) if r["term"] == t] for t in terms[:40]}
    for t, of in mine.items():
        want = sorted(((ratio(n, t), n) for n in names), reverse=True)[:8]
        assert of == [(n, r) for r, n in want if r >= 0.82]


@pytest.mark.parametrize("cutoff", [0.5, 0.82, 1.0])
def test_near_names_of_odd_texts(spark, monkeypatch, cutoff):
    """Long ones, of many characters, outside the first plane, in more than one block; terms all of one letter."""
    import random

    from signalmill.functions import near

    monkeypatch.setattr(near, "NAMES", 40)
    rng = random.Random(3)
    names = ["x" * n for n in (1, 2, 62, 63, 64, 65, 66, 130, 250)] + ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randrange(2, 70))) for _ in range(90)] + ["😀😃a", "a\0", "\0a", "é", "e\u0301", " "]
    terms = ["x" * n for n in (1, 3, 60, 64, 65, 70, 200)] + [*names[9:40], "😀😄a", "a", "a\0\0", ""] + [n[: len(n) // 2] + "xy" + n[len(n) // 2 + 1 :] for n in names]
    got = near.near_names(spark.createDataFrame([(t,) for t in [*terms, None]], "term string"), spark.createDataFrame([(n,) for n in [*names, *names, None, ""]], "name string"), cutoff, 3)
    want = {(t, n, r, k) for t in set(terms) - {""} for k, (r, n) in enumerate(sorted(((near.ratio(n, t), n) for n in set(names)), reverse=True)[:3], 1) if r >= cutoff}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_near_names_of_empty_tables(spark):
    from signalmill.functions.near import near_names

    some, none = spark.createDataFrame([("abcdef",)], "x string"), spark.createDataFrame([], "x string")
    assert not near_names(some.toDF("term"), none.toDF("name")).collect() and not near_names(none.toDF("term"), some.toDF("name")).collect()


def test_bits_of_many_texts_are_those_of_each():
    from signalmill.functions import near

    for texts in (["nausea", "banana", "aaaaaa", "éß😀abc"], ["x" * 64, "ab" * 32], ["y" * 65]):
        assert near._groups(texts)[0].bits.tolist() == [near.letters(t) for t in texts]


def test_chunks_hold_each_text_once(monkeypatch):
    import pyarrow as pa

    from signalmill.functions import near

    monkeypatch.setattr(near, "TERMS", 30)
    monkeypatch.setattr(near, "CHARS", 100)
    texts = ["x" * 300, *map(str, range(200)), "y" * 99, "zz"]
    got = [b.column(0)[0].as_py() for b in near._chunks(pa.RecordBatch.from_arrays([pa.array(texts[k : k + 64])], ["t"]) for k in range(0, len(texts), 64))]
    assert sum(got, []) == texts and max(map(len, got)) == 30 and all(len(c) == 1 or sum(map(len, c)) <= 100 for c in got)
    assert list(near._chunks(iter([]))) == []
