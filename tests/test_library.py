"""The library's own operators: hand-derived expectations, properties, and the catalog against DuckDB."""

import json
import math
import os
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from signalmill import lexicon
from signalmill.errors import DuplicateError, NotFoundError, ValidationError, with_retry
from signalmill.functions import extract, keywords, text
from signalmill.operators import audit, changes, timeline
from signalmill.operators import disproportionality as dp
from signalmill.plans import catalog, reporting
from signalmill.project import Project, SourceConfig, from_form
from signalmill.sources import api, feeds, html, registry, threads
from signalmill.store import Store
from signalmill.streaming import ingest, jobs
from signalmill.windows import TimeWindow

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


# --- the catalog ---


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_catalog_equals_its_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    df = catalog.queries()[name](spark, sf_dir)
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])
    assert order(df.select(*names).collect()) == order(found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_of_the_other_queries(spark, sf_dir):
    assert catalog.queries()["sentiment_labels"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert catalog.queries()["html_block_dedup"](spark, sf_dir).count() > 0
    catalog.queries()["pii_spans"](spark, sf_dir).collect()
    catalog.queries()["entity_spans"](spark, sf_dir).collect()


# --- texts ---

NER = [
    ("Took Crocin 650 for fever, ended up with bad stomach pain and rash.", ["paracetamol"], ["fever", "stomach pain", "rash"], True),
    ("Dolo lene ke baad pet mein dard ho raha hai.", ["paracetamol"], ["pet mein dard"], True),
    ("Telma 40 + Ecosprin combo getting daily dizziness.", ["telmisartan", "aspirin"], ["dizziness"], True),
    ("Just took some painkillers and feeling much better.", [], [], False),
]


@pytest.mark.parametrize("body,drugs,symptoms,trigger", NER)
def test_entities(spark, body, drugs, symptoms, trigger):
    got = extract.entities(body)
    of = lambda kind: [e["normalized"] for e in got["entities"] if e["type"] == kind]
    assert (of("DRUG"), of("SYMPTOM"), got["trigger"], len(got["pairs"])) == (drugs, symptoms, trigger, len(drugs) * len(symptoms))
    assert all(body[e["start"] : e["end"]] == e["text"] for e in got["entities"])
    row = spark.createDataFrame([(body,)], "t string").select(text.drugs(F.col("t")).alias("d"), text.symptoms(F.col("t")).alias("s"), text.has_trigger(F.col("t")).alias("g"), F.size(text.pairs(text.drugs(F.col("t")), text.symptoms(F.col("t")))).alias("p")).first()
    assert (row["d"], row["s"], row["g"], row["p"]) == (drugs, symptoms, trigger, len(got["pairs"]))


def test_sentiment():
    assert extract.sentiment("")["label"] == "neutral" and extract.sentiment("")["score"] == 0.0
    denied = extract.sentiment("Patient denies any rash or vomiting after the dose.")
    assert (denied["label"], denied["score"], denied["negated"]) == ("positive", 1.0, ["vomiting", "rash"]) or sorted(denied["negated"]) == ["rash", "vomiting"]
    adverse = extract.sentiment("Side effect: severe rash")
    assert adverse["label"] == "adverse" and adverse["score"] <= -0.5


def test_personal_data():
    assert [(h["type"], h["match"].strip(" .")) for h in extract.pii_hits("PIN 560034.")] == [("ADDRESS", "PIN 560034")]
    assert extract.redact("PAN ABCDE1234F") == "PAN <PAN>"
    body = "Mail a.b@c.example, call 9876543210, MRN: AB1234, born 01/02/1990, Dr. Rao at Apollo"
    kinds = {h["type"] for h in extract.pii_hits(body)}
    assert {"EMAIL", "PHONE_IN", "MRN", "DOB", "NAME", "HOSPITAL"} <= kinds
    assert not {h["type"] for h in extract.pii_hits(extract.redact(body))} & {"EMAIL", "PHONE_IN", "DOB"}
    assert extract.redact(None) is None and extract.pii_hits("word " * 20_000) == []


def test_recall_of_detectors(spark):
    from signalmill.functions.evaluate import posts, recall

    got = {r["type"]: r["recall"] for r in recall(posts(spark, 60)).collect()}
    assert len(got) == 9 and all(v >= 0.95 for v in got.values())


def test_commands(capsys):
    from signalmill import cli

    assert cli.main(["pii", "PAN ABCDE1234F"]) == 0 and "<PAN>" in capsys.readouterr().out
    assert cli.main(["ner", "Crocin and rash"]) == cli.main(["sentiment", "fine"]) == cli.main(["expand", "crocin"]) == 0


def test_content_hash(spark):
    rows = spark.createDataFrame([("A  b\nC",), ("a b c",), (" a b c ",), (None,)], "t string").select(text.content_hash(F.col("t"))).collect()
    assert rows[0] == rows[1] == rows[2] and rows[3][0] is None


def test_lexicon_sizes():
    assert (len(lexicon.BRAND_TO_GENERIC), len(lexicon.GENERIC_DRUGS), len(lexicon.SYMPTOMS), len(lexicon.ADR_TRIGGERS), len(lexicon.NEGATIVE), len(lexicon.POSITIVE)) == (33, 73, 136, 42, 59, 13)


def test_keywords():
    assert keywords.expand(["vomiting"])[:2] == ["vomiting", "ulti"] and "paracetamol" in keywords.expand(["Crocin"]) and "crocin" in keywords.expand(["paracetamol"])
    terms, rows = keywords.expand_layered(["nausea", "Nausea"], ask=lambda k: ["llm term"])
    assert len(terms) == len({t.lower() for t in terms}) and rows[0] == ("nausea", "nausea", "user", 1.0) and ("nausea", "llm term", "llm", 0.7) in rows
    assert keywords.morphological("itching")[-2:] == ["itch", "itched"] and "headache" in extract.fuzzy("headach")


def test_term_cache(tmp_path):
    path, asked = str(tmp_path / "c.json"), []
    ask = lambda t: asked.append(t) or ["a ", "", 3]
    assert keywords.TermCache(path).get("x", "T", ask) == ["a"] == keywords.TermCache(path).get("x", "t", ask) and asked == ["T"]


# --- statistics ---


def test_two_by_two(spark):
    pairs = spark.createDataFrame([("d", "e")] * 4 + [("x", "y")] * 6, "drug string, event string")
    row = dp.compute(pairs).where("drug = 'd'").first()
    assert (row["n"], row["prr"], row["chi2"], row["ic"], row["is_signal"]) == (4, 12.6, 2.256, 1.1, False)


def test_labels(spark):
    rows = spark.createDataFrame([(3.0, 5, 4.0), (2.0, 3, 4.0), (0.5, 9, 9.0), (1000.0, 1, 0.0), (None, 1, 0.0)], "prr double, n int, chi2 double")
    p, n, x = map(F.col, ("prr", "n", "chi2"))
    got = rows.select(dp.tier(p, n, x), dp.status(p, n), dp.colour(p), dp.ratio_text(p)).collect()
    assert [tuple(r) for r in got[:3]] == [("STRONG", "ESCALATED", "red", "3.00"), ("MODERATE", "PENDING", "amber", "2.00"), ("EXPLORATORY", "DISMISSED", "blue", "0.50")]
    assert got[3][3] == "≥ 1000" and got[4][3] == "—"


def test_timeline_is_padded(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 5),), (datetime(2024, 1, 6),), (None,)], "at timestamp")
    days = timeline.timeline(rows, F.col("at")).orderBy("day").collect()
    assert len(days) == 14 and str(days[0]["day"]) == "2023-12-30" and sum(r["n"] for r in days) == 2


# --- audit and changes ---


def events(n):
    return [(f"2024-01-01T00:00:{k:02d}", "a", "run.start", None if k % 2 else "p", {"k": k, "é": "ü"}) for k in range(n)]


@pytest.mark.parametrize("chunk", [100_000, 3])
def test_chain(spark, chunk):
    log = audit.append(spark.createDataFrame([], "id long, ts string, actor string, action string, target string, payload_json string, prev_hash string, hash string"), events(5))
    log = log.unionByName(audit.append(log, events(4)))
    assert all(r["ok"] for r in audit.checked(log, chunk).collect())
    assert tuple(audit.verify(log).first()) == (True, None, 9)
    for column in ("ts", "actor", "action", "payload_json", "prev_hash", "hash"):
        broken = log.withColumn(column, F.when(F.col("id") == 4, F.lit("x")).otherwise(F.col(column)))
        assert min(r["id"] for r in audit.checked(broken, chunk).collect() if not r["ok"]) == 4
        assert audit.verify(broken).first()["broken_at"] == 4
    assert tuple(audit.verify(log.limit(0)).first()) == (True, None, 0)


def test_watermarks_never_go_back(spark):
    schema = "source_id long, last_seen_id string, last_seen_ts timestamp, last_run_at timestamp, last_fetched long, last_inserted long"
    at = lambda d: datetime(2024, 1, d)
    old = spark.createDataFrame([(1, "b", at(5), at(6), 9, 9), (2, "x", at(5), at(6), 1, 1)], schema)
    run = spark.createDataFrame([(1, "a", at(3), at(7), 2, 0), (2, None, None, at(7), 0, 0), (3, "n", at(1), at(7), 4, 4)], schema)
    got = {r["source_id"]: (r["last_seen_id"], r["last_seen_ts"], r["last_run_at"], r["last_fetched"]) for r in changes.advance(old, run).collect()}
    assert got == {1: ("b", at(5), at(7), 2), 2: ("x", at(5), at(7), 0), 3: ("n", at(1), at(7), 4)}


def test_windows():
    late = datetime(2024, 5, 30, tzinfo=timezone.utc)
    assert TimeWindow().effective(NOW, late) == (late, NOW) and TimeWindow(3).resolve(NOW)[0] == NOW - timedelta(days=3)
    since = TimeWindow.from_dict({"lookback_days": 3, "since": "2024-01-01"})
    assert since.effective(NOW, late) == (datetime(2024, 1, 1, tzinfo=timezone.utc), NOW)
    assert TimeWindow(None, None, late).resolve(NOW) == (NOW - timedelta(days=7), NOW)


def test_retries():
    calls = []

    def once():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 5

    assert with_retry(once, sleep=lambda s: None) == 5
    with pytest.raises(OSError):
        with_retry(lambda: (_ for _ in ()).throw(OSError()), retries=1, sleep=lambda s: None)


# --- configuration, sources ---


def test_projects(tmp_path):
    d = {"id": "p", "name": "P", "keywords": ["a"], "time_window": {"lookback_days": 3, "since": None, "until": None}, "sources": [{"name": "s", "connector": "reddit", "params": {"subreddits": ["x", "y"]}, "latency": "weekly", "time_windows": [{"lookback_days": 1}]}]}
    p = Project.from_dict(d)
    for name in ("p.yaml", "p.json"):
        if name == "p.yaml":
            pytest.importorskip("yaml") if False else None
        try:
            p.save(str(tmp_path / name))
        except ImportError:
            continue
        assert Project.load(str(tmp_path / name)) == p
    assert p.sources[0].reader_params() == {"subreddits": ["x", "y"], "limit": 100} and p.windows(p.sources[0])[0].lookback_days == 1
    made = from_form({"name": "My Project!", "keywords": "a, b", "cadence": "hourly", "sources": [{"name": "r", "connector": "reddit", "params": {"subreddits": "r/x, /r/y"}}]})
    assert (made.id, made.keywords, made.sources[0].latency, made.sources[0].params) == ("my-project", ["a", "b"], "real_time", {"subreddits": ["x", "y"]})
    with pytest.raises(ValidationError):
        from_form({"name": "x", "keywords": "", "sources": []})


def test_feeds(spark, tmp_path):
    now = F.lit(NOW)
    (tmp_path / "f.xml").write_text('<rss><channel><item><guid>1</guid><title>T</title><description>&lt;p&gt;Body  text&lt;/p&gt;</description><link>http://a</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item><item><guid>2</guid><title>U</title></item></channel></rss>')
    rows = {r["external_id"]: r for r in feeds.rss(spark, str(tmp_path / "f.xml"), now).collect()}
    assert rows["rss:1"]["text"] == "T\n\nBody text" and rows["rss:1"]["posted_at"] == datetime(2024, 1, 1, 10) and rows["rss:2"]["posted_at"] == NOW.replace(tzinfo=None)
    (tmp_path / "faers.txt").write_bytes("primaryid$drugname$pt$event_dt$narrative\n9$Dolo$Rash$2024-01-02$café\n".encode("latin-1"))
    r = feeds.faers(spark, str(tmp_path / "faers.txt"), now).first()
    assert (r["external_id"], r["text"], r["posted_at"]) == ("faers:9", "Drug: Dolo\nReaction: Rash\nNarrative: café", datetime(2024, 1, 2))
    page = {"results": [{"safetyreportid": "7", "safetyreportversion": "1", "serious": "1", "occurcountry": "IN", "receiptdate": "20240103", "patient": {"drug": [{"medicinalproduct": "DOLO"}], "reaction": [{"reactionmeddrapt": "Rash"}]}}, {"safetyreportid": "8", "patient": {"drug": [], "reaction": []}}]}
    (tmp_path / "fda.json").write_text(json.dumps(page))
    got = feeds.openfda(spark, str(tmp_path / "fda.json"), now).collect()
    assert [(r["external_id"], r["posted_at"]) for r in got] == [("openfda:7:1", datetime(2024, 1, 3))] and "DOLO" in got[0]["text"]
    (tmp_path / "wa.json").write_text(json.dumps([{"id": "1", "from": "x", "ts": "2024-01-04T00:00:00Z", "lang": "en", "text": "hi"}, {"from": "y", "text": "no id"}, {"id": "3", "text": "  "}]))
    assert "wa:1" in {r["external_id"] for r in feeds.whatsapp(spark, str(tmp_path / "wa.json"), now).collect()} and feeds.whatsapp(spark, str(tmp_path / "wa.json"), now).count() == 2
    (tmp_path / "x.json").write_text(json.dumps([{"id": "5", "author": "a", "created_at": "2024-01-05T00:00:00Z", "lang": "en", "text": "t"}]))
    assert feeds.x_posts(spark, str(tmp_path / "x.json"), now).first()["external_id"] == "x:5"
    posts = [{"data": {"id": f"p{k}", "title": "T", "selftext": "B", "permalink": "/r/x", "author": "a", "created_utc": 1.7e9 + k}} for k in range(6)]
    (tmp_path / "reddit.json").write_text(json.dumps({"data": {"after": None, "children": posts}}))
    assert sorted(r["external_id"] for r in feeds.reddit_listing(spark, str(tmp_path / "reddit.json"), 2, 6).collect()) == ["reddit:p3", "reddit:p4", "reddit:p5"]


def test_comments_breadth_first():
    leaf = lambda i, *r: {"kind": "t1", "data": {"id": i, "body": i, "replies": {"data": {"children": list(r)}} if r else ""}}
    tree = {"data": {"children": [leaf("a", leaf("c", leaf("e"))), {"kind": "more"}, leaf("b", leaf("d"))]}}
    assert [c["text"] for c in feeds.comments(tree, "p")] == list("abcde") and len(feeds.comments(tree, "p", 3)) == 3


def test_comment_column(spark):
    thread = json.dumps({"data": {"children": [{"kind": "t1", "data": {"id": "a", "body": "b", "created_utc": 5}}]}})
    got = spark.createDataFrame([("p", thread), ("q", None)], "post string, thread string").select(feeds.comment_column()("post", "thread").alias("c")).collect()
    assert [[c["external_id"] for c in r["c"]] for r in got] == [["reddit:p:c:a"], []]


def test_depths(spark):
    """Replies of any depth; what hangs on nothing, or on a circle, stays without a depth."""
    chain = [(f"c{k}", f"c{k - 1}" if k else "p") for k in range(300)]
    edges = spark.createDataFrame([("p", None), ("a", "p"), ("b", "a"), ("lost", "gone"), ("below", "lost"), ("x", "y"), ("y", "x"), ("z", "y"), (None, "p"), *chain], "id string, up string")
    got = threads.depths(edges, "id", "up").collect()
    assert len(got) == edges.count()
    want = {"p": 0, "a": 1, "b": 2, "lost": None, "below": None, "x": None, "y": None, "z": None, None: None, **{f"c{k}": k + 1 for k in range(300)}}
    assert {r["id"]: r["depth"] for r in got} == want
    assert threads.depths(edges.limit(0), "id", "up").count() == 0


def test_search_takes_quotes_and_backslashes(spark):
    from signalmill.plans import reporting, roles

    t = roles.tables(spark, "/root/testdata/sf0.001")
    for odd in ("\\'", "' OR 1=1 --", "a\\", '"', "\\%"):
        assert reporting.search(t, odd).count() == 0
    assert reporting.search(t, "a%a").count() > 0


def test_feeds_from_text_and_archives(spark, tmp_path):
    import zipfile

    xml = "<rss><channel><item><guid>1</guid><title>One</title><link>http://a/1</link><description>&lt;p&gt;Body&lt;/p&gt;</description><pubDate>Tue, 2 Jan 2024 10:00:00 GMT</pubDate></item><item><guid>2</guid><title>Two</title></item></channel></rss>"
    (tmp_path / "feed.xml").write_text(xml)
    source = SourceConfig("feed", "rss", {"feed_url": f"file://{tmp_path}/feed.xml"})
    rows = {r["external_id"]: r for r in registry.read(spark, source, F.lit(NOW)).collect()}
    assert set(rows) == {"rss:1", "rss:2"} and rows["rss:1"]["text"] == "One\n\nBody" and rows["rss:1"]["posted_at"].isoformat() == "2024-01-02T10:00:00"
    after = registry.read(spark, source, F.lit(NOW), datetime(2024, 1, 2, 10, tzinfo=timezone.utc)).collect()
    assert [r["external_id"] for r in after] == ["rss:2"]  # the lower bound itself is left out
    with zipfile.ZipFile(tmp_path / "faers.zip", "w") as z:
        z.writestr("DEMO.TXT", "primaryid$drugname$pt$event_dt$narrative\n7$X$Rash$2024-01-05$told\n8$Y$Fever$20240106$\n".encode("latin-1"))
        z.writestr("readme.pdf", "no")
    rows = {r["external_id"]: r["text"] for r in registry.read(spark, SourceConfig("f", "faers", {"path": str(tmp_path / "faers.zip")}), F.lit(NOW)).collect()}
    assert rows == {"faers:7": "Drug: X\nReaction: Rash\nNarrative: told", "faers:8": "Drug: Y\nReaction: Fever\nNarrative: "}


def test_reddit_with_comments(spark, tmp_path):
    """Two pages of a listing by cursor, and the thread of each post, from files in place of the site."""
    import json

    post = lambda k: {"data": {"id": f"p{k}", "title": f"T{k}", "selftext": "S", "permalink": f"/r/a/p{k}", "author": "u", "created_utc": 1_700_000_000.0 + k}}
    (tmp_path / "listing.json").write_text(json.dumps({"data": {"after": None, "children": [post(1), post(2)]}}))
    tree = {"data": {"children": [{"kind": "t1", "data": {"id": "c1", "body": "reply", "author": "v", "created_utc": 1_700_000_100, "replies": {"data": {"children": [{"kind": "t1", "data": {"id": "c2", "body": "deeper", "replies": ""}}]}}}}]}}
    (tmp_path / "threads").mkdir()
    (tmp_path / "threads" / "p1.json").write_text(json.dumps(tree))
    source = SourceConfig("r", "reddit", {"path": str(tmp_path / "listing.json"), "comments_path": str(tmp_path / "threads")})
    rows = {r["external_id"]: r["text"] for r in registry.read(spark, source, F.lit(NOW)).collect()}
    assert rows == {"reddit:p1": "T1\n\nS", "reddit:p2": "T2\n\nS", "reddit:p1:c:c1": "reply", "reddit:p1:c:c2": "deeper"}


def test_table_functions(spark):
    from signalmill.functions import extract

    extract.register(spark)
    page = "<nav><a href=/x>x</a></nav><p>" + "word " * 30 + "</p>"
    spark.createDataFrame([("http://a/", page)], "url string, html string").createOrReplaceTempView("one_page")
    assert [tuple(r) for r in spark.sql("SELECT l.* FROM one_page, LATERAL html_links(url, html) l").collect()] == [(0, "http://a/x")]
    assert spark.sql("SELECT b.text FROM one_page, LATERAL html_blocks(url, html) b").first()[0] == ("word " * 30).strip()
    thread = '{"data": {"children": [{"kind": "t1", "data": {"id": "c", "body": "b"}}]}}'
    assert spark.sql(f"SELECT external_id FROM comment_tree('p', '{thread}')").first()[0] == "reddit:p:c:c"


def test_selectors():
    page = html.parse('<div id=a class="x y"><p class=t lang=en-GB>one</p><section><p data-k="v w">two</p></section></div><p>three</p>')
    found = lambda css: [n.text() for n in html.select(page, css)]
    assert found("div > p") == ["one"] and found("div p") == ["one", "two"] and found(".x.y > section p[data-k]") == ["two"] and found("*[lang|=en], section > p") == ["one", "two"]
    assert found('p[data-k~="w"]') == found("[data-k^=v]") == found("[data-k$='w']") == found('p[data-k*=" "]') == ["two"] and found("p.t#no") == []
    with pytest.raises(ValueError):
        html.select(page, "p:first")


def test_a_model_adds_names():
    model = lambda t: [("DRUG", t.index("newdrug"), t.index("newdrug") + 7, "NewDrug"), ("SYMPTOM", 0, 4, "Rash")]
    got = extract.entities("Rash from newdrug", model)
    assert [(e["type"], e["normalized"], e["confidence"]) for e in got["entities"]] == [("DRUG", "newdrug", 0.75), ("SYMPTOM", "rash", 0.8)] and got["pairs"] == [{"drug": "newdrug", "event": "rash"}]
    assert extract.spacy_model("no-such-model") is None


def test_a_busy_site_is_tried_again():
    said = iter([(503, ""), (429, ""), (200, "text")])
    got = api.fetch("http://a/", rungs=(("plain", lambda u, t: next(said)),), waits=(0, 0))
    assert got.ok and got.text == "text" and len(got.attempts) == 1


def test_html():
    page = "<html><title> T </title><nav><p>" + "n" * 90 + "</p></nav><article><p>" + "a" * 90 + "<p>" + "b" * 90 + "</p><li>short</li></article><p>" + "a" * 90 + "</p><a href='/x/1'>1</a><a href='http://other/x'>2</a><a href='/y'>3</a></html>"
    title, found = html.blocks(page)
    assert title == "T" and found == ["a" * 90 + " " + "b" * 90 + " short", "a" * 90, "b" * 90]
    assert html.links("http://h/i", page, "^/x") == ["http://h/x/1"] and html.links("http://h/i", page, None, False) == ["http://h/x/1", "http://other/x", "http://h/y"]
    assert html.sitemap("<urlset><url><loc> http://h/1 </loc></url><url><loc>http://g/2</loc></url></urlset>", "h") == ["http://h/1"]
    rows = html.items("http://h/", "<div class='c'><h2>A</h2><p class=b>B</p><a href=/l>l</a></div><div class=c></div>", ".c", "h2", "p.b")
    assert [(r["url"], r["text"]) for r in rows] == [("http://h/l", "A\n\nB")] and len(html.items("http://h/", "<div class='c'></div>", ".c", hashed=False)) == 1


def test_registry(spark, tmp_path):
    from signalmill.errors import ConnectorError
    from signalmill.project import SourceConfig

    body = "words of a block, " * 8
    (tmp_path / "seed.html").write_text(f"<a href='a.html'>a</a><a href='b.html'>b</a><a href='http://other/c.html'>c</a>")
    for name in "ab":
        (tmp_path / f"{name}.html").write_text(f"<title>{name}</title><nav>{body}</nav><p>{name} {body}</p><p>short</p><div class=i><h2>T{name}</h2><a href=x>l</a></div>")
    now, at = F.lit(NOW), f"file://{tmp_path}"
    get = lambda connector, **params: registry.read(spark, SourceConfig("s", connector, params), now)
    rows = get("crawler", url=f"{at}/seed.html", link_pattern="[ab].html$").collect()
    assert sorted(r["text"][:5] for r in rows) == ["a\n\na ", "b\n\nb "] and all(r["posted_at"] == NOW.replace(tzinfo=None) for r in rows)
    assert [r["external_id"] for r in get("html", url=f"{at}/a.html").collect()] == [r["external_id"] for r in rows if r["text"].startswith("a")]
    assert get("html_stealth", url=f"{at}/a.html", list_selector="div.i", title_selector="h2").first()["text"] == "Ta"
    assert get("generic_html", url=f"{at}/a.html", list_selector="div.i", title_selector="h2").first()["external_id"] == f"html:{at}/a.html#0"
    assert get("html", urls=[f"{at}/missing.html"]).count() == 0
    for unknown in ("synthetic", "nothing"):
        with pytest.raises(ConnectorError):
            get(unknown)


def test_ladder():
    def missing(url, timeout):
        raise ImportError

    got = api.fetch("u", rungs=(("a", lambda u, t: (500, "")), ("b", missing), ("c", lambda u, t: (200, "x")), ("d", lambda u, t: (200, "y"))))
    assert got.ok and got.rung == "c" and [a["rung"] for a in got.attempts] == ["a", "c"]
    assert not api.fetch("u", rungs=(("a", lambda u, t: 1 / 0),)).ok


def test_paged_api(spark, tmp_path):
    api.register(spark)
    for skip in (0, 2):
        (tmp_path / f"{skip}.json").write_text(json.dumps({"results": [{"k": skip}, {"k": skip + 1}]}))
    df = spark.read.format("json_api").option("path", f"file://{tmp_path}/{{skip}}.json").option("pagesize", "2").option("limit", "6").load()
    assert sorted(json.loads(r[0])["k"] for r in df.collect()) == [0, 1, 2, 3]
    (tmp_path / "l.json").write_text(json.dumps({"data": {"after": "m", "children": [{"data": {"id": "1"}}]}}))
    (tmp_path / "lm.json").write_text(json.dumps({"data": {"after": None, "children": [{"data": {"id": "2"}}]}}))
    stream = spark.readStream.format("json_api").option("path", f"file://{tmp_path}/l{{after}}.json").load()
    q = stream.writeStream.format("memory").queryName("cursor").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(json.loads(r[0])["id"] for r in spark.table("cursor").collect()) == ["1", "2"]


# --- the store, ingestion and reports ---

MESSAGES = [
    {"id": str(k), "from": "u", "ts": f"2024-05-{20 + k % 10:02d}T00:00:00Z", "lang": "en", "text": t}
    for k, t in enumerate(["After taking Crocin I had severe rash", "After taking crocin severe RASH", "Dolo caused me rash and nausea", "crocin and rash again, mail a@b.example", "Metformin ok, no nausea", "weather is fine", "Brufen and fever", "Brufen, fever, side effect"] * 2)
]


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("store")
    (base / "wa").mkdir()
    (base / "wa" / "1.json").write_text(json.dumps(MESSAGES))
    store = Store(spark, str(base / "tables"))
    project = Project.from_dict({"id": "pv", "name": "PV", "keywords": ["crocin", "rash"], "time_window": {"lookback_days": 60}, "sources": [{"name": "inbox", "connector": "wa", "params": {"path": str(base / "wa")}}, {"name": "none", "connector": "synthetic"}]})
    store.save_project(project, NOW, create=True)
    first = ingest.run_project(store, "pv", NOW)
    return store, project, first, base


def test_ingestion(filled):
    store, project, first, base = filled
    assert (first["fetched"], first["inserted"]) == (16, 8) and "error" in first["sources"][1]
    records = store.table("records").collect()
    assert {r["pii_hits_count"] for r in records} == {0, 1} and not any("a@b" in r["text_redacted"] for r in records)
    with pytest.raises(DuplicateError):
        store.save_project(project, NOW, create=True)
    with pytest.raises(NotFoundError):
        store.load_project("nobody")
    assert store.load_project("pv").keywords == ["crocin", "rash"]
    mark = store.table("watermarks").first()
    assert mark["last_seen_ts"] == datetime(2024, 5, 29) and mark["last_inserted"] == 8
    again = ingest.run_project(store, "pv", NOW)
    assert again["inserted"] == 0 and store.table("watermarks").first()["last_seen_ts"] == mark["last_seen_ts"]


def test_signals_and_reports(filled):
    store, *_ = filled
    done = jobs.compute_signals(store, "pv", NOW, min_n=1)
    assert done["rows"] == store.table("signals").count() > 0
    jobs.compute_signals(store, "pv", NOW, min_n=1)
    assert store.table("signals").count() == done["rows"]
    t, as_of = store.table, F.lit(NOW)
    k = reporting.system_kpis(t, as_of).first()
    assert k["records"] == 8 and k["sources"] == 2 and k["projects"] == 1 and k["uptime_str"].endswith("%")
    assert {r["name"]: r["status"] for r in reporting.source_health(t, as_of).collect()}["none"] == "PENDING"
    assert reporting.project_rows(t).first()["status"] == "RUNNING"
    assert reporting.project_entities(t, "pv").first()["mentions"] >= 1
    assert reporting.verification(t).first()["ok"] and reporting.compliance_kpis(t).first()["traceability_pct"] == 100.0
    assert {r["action"] for r in reporting.compliance_log(t).collect()} >= {"DATA_REDACTION", "CONNECTOR_FAILURE"}
    assert {r["kind"] for r in reporting.search(t, "p").collect()} >= {"project"}
    assert reporting.records_csv(t, "pv").count() == 8 and reporting.about(t).first()["records"] == 8 and reporting.activity(t).count() > 0 and reporting.audit_tail(t).count() == 8
    reporting.recent_signals(t, as_of).collect()
    reporting.all_signals(t).collect()
    reporting.project_summary(t, "pv").collect()
    reporting.entity_mentions_per_day(t, "pv").collect()
    detail = reporting.signal_detail(t, jobs.record_pairs(store, "pv"), store.table("signals").first()["id"], as_of)
    assert all(df.collect() is not None for df in detail.values()) and detail["timeline"].count() >= 14
    assert reporting.signal_detail(t, jobs.record_pairs(store, "pv"), -1, as_of) == {}


def test_stream_equals_batch(spark, filled, tmp_path):
    store, project, first, base = filled
    other = Store(spark, str(tmp_path / "tables"))
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(MESSAGES[k * 8 : k * 8 + 8]))
    raw = feeds.whatsapp_records(spark.readStream.schema(feeds.INBOX).option("multiLine", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), F.lit(NOW))
    words = keywords.expand_layered(project.keywords)[0]
    query = ingest.stream_records(other, project.sources[0], 1, words, raw, str(tmp_path / "check"), NOW)
    query.awaitTermination()
    hashes = lambda s: sorted(r[0] for r in s.table("records").select("content_hash").collect())
    assert hashes(other) == hashes(store)


def raw_rows(spark, ids, day=1):
    rows = [(f"e{k}", f"text {k} of dolo", datetime(2024, 5, day, tzinfo=timezone.utc) + timedelta(minutes=k)) for k in ids]
    return feeds.shaped(spark.createDataFrame(rows, "external_id string, text string, posted_at timestamp"))


def stored(spark, store, ids, day=1, **more):
    rows = ingest.enriched(raw_rows(spark, ids, day).withColumn("matched_keywords", F.array(F.lit("dolo"))), 1, NOW)
    return ingest.store_batch(store, rows, 1, NOW, **more)


def test_a_batch_is_one_commit(spark, tmp_path, monkeypatch):
    """Failing between the writes of records and of watermarks leaves the store as it was; trying again stores the batch once."""
    store = Store(spark, str(tmp_path / "tables"))
    assert stored(spark, store, range(5))["inserted"] == 5
    write, calls = store._write, []

    def failing(name, df):
        calls.append(name)
        if len(calls) == 2:
            raise OSError("executor lost")
        return write(name, df)

    monkeypatch.setattr(store, "_write", failing)
    with pytest.raises(OSError):
        stored(spark, store, range(3, 9), 2)
    monkeypatch.undo()
    assert store.table("records").count() == 5 and store.table("watermarks").first()["last_fetched"] == 5 and store.table("record_keys").count() == 10
    told = stored(spark, store, range(3, 9), 2, batch_id=("stream", "7"))
    assert (told["inserted"], told["duplicates"], told["late"]) == (4, 2, 0) and store.table("records").count() == 9
    again = stored(spark, store, range(20, 22), 2, batch_id=("stream", "7"))
    assert again["inserted"] == 0 and store.table("records").count() == 9
    assert stored(spark, store, range(30, 32), 1)["late"] == 2


def test_a_batch_reads_its_buckets_of_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"))
    stored(spark, store, range(300))
    rows = ingest.enriched(raw_rows(spark, [5, 900]).withColumn("matched_keywords", F.array()), 1, NOW)
    left = changes.unknown_records(rows, store.table("record_keys"))
    assert [r["external_id"] for r in left.collect()] == ["e900"]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN", plan) or re.search(r"PartitionFilters: \[[^\]]*bucket#", plan)
    by_both = changes.new_records(rows, store.table("records"))
    assert [r["external_id"] for r in by_both.collect()] == ["e900"]


def test_folders_are_put_together(spark, tmp_path, monkeypatch):
    from signalmill import store as stores

    monkeypatch.setattr(stores, "MOST_FOLDERS", 3)
    store = Store(spark, str(tmp_path / "tables"))
    for k in range(6):
        store.append_audit("a", "run.start", f"p{k}", ts=f"2024-01-01T00:00:0{k}")
    assert store.table("audit_log").count() == 6 and len(store._state()["tables"]["audit_log"]) <= 3 and reporting.verification(store.table).first()["ok"]


def test_a_window_that_fails_does_not_stop_the_others(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "tables"))
    windows = [{"since": "2024-05-01", "until": "2024-05-02"}, {"since": "2024-05-03", "until": "2024-05-04"}]
    project = Project.from_dict({"id": "p", "name": "P", "keywords": ["dolo"], "sources": [{"name": "s", "connector": "wa", "params": {"path": "x"}, "time_windows": windows}]})

    def read(spark_, source, now, after=None):
        if after.day == 3:
            raise OSError("gone")
        return raw_rows(spark, range(4))

    monkeypatch.setattr(registry, "read", read)
    told = ingest.run_source(store, project, project.sources[0], 1, ["dolo"], NOW)
    assert told["inserted"] == 4 and [e["error"] for e in told["errors"]] == ["OSError: gone"] and store.table("records").count() == 4


def test_backfill_and_scheduler(filled):
    store, _, _, base = filled
    store.replace("records", store.table("records").withColumn("sentiment_label", F.when(F.col("pii_hits_count") > 0, None).otherwise(F.col("sentiment_label"))))
    assert ingest.backfill(store) == 1 and ingest.backfill(store) == 0
    later = NOW + timedelta(days=2)
    ticked = jobs.Scheduler(store).tick(later)
    assert ticked["projects"] == 1 and ticked["inserted"] == 0
    scheduler = jobs.Scheduler(store)
    scheduler.start(3_600, lambda: later)
    while store.table("audit_log").where("action = 'tick.run'").count() < 2:
        assert scheduler.thread.is_alive()
    scheduler.stop()
    assert not scheduler.thread.is_alive() and json.loads((base / "tables" / "runs" / "pv" / "20240601T000000.json").read_text())["project"] == "pv"
    store.set_fields("pv", status="paused")
    assert jobs.Scheduler(store).tick(later + timedelta(days=2))["projects"] == 0
    with pytest.raises(ValidationError):
        store.set_fields("pv", status="odd")
    counts = store.reset_project("pv")
    assert counts["records"] == 8 and counts["sources"] == 0 and store.table("records").count() == 0
    assert store.delete_project("pv")["sources"] == 2 and store.diagnostics().where("name = 'projects'").first()["n"] == 0
    assert reporting.verification(store.table).first()["ok"]


def test_synthetic(spark):
    df = feeds.synthetic(spark)
    assert df.count() == 150 and df.where(F.contains("text", F.lit("dermacult")) & F.contains("text", F.lit("angioedema"))).count() >= 18
    assert feeds.healthy(df) and not feeds.healthy(df.limit(0)) and "synthetic" not in registry.READERS


def test_references_without_a_semicolon_stay_if_asked(spark):
    body = "word " * 20
    page = f"<title>A&amp;&amp</title><article><p>{body}&amp;&lt;&am &#38;</p></article>"
    rows = spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")
    texts = lambda **how: [r["text"] for r in html.page_blocks(rows, **how).collect()]
    assert texts(unclosed=False) == [f"A&&amp\n\n{body}&<&am &"] and texts() == [f"A&&\n\n{body}&<&am &"]


def test_personal_data_of_documents_is_that_of_the_sql(spark, tmp_path):
    """Numbers in a document's own text: the SQL of whole_pii and whole_redacted looks for its mail addresses only, every_pii for all."""
    rows = [(0, "Key 12ab838394cd, a@b.example\n560034"), (1, "9225426587 é x.y@z.example"), (2, None), (3, "")]
    spark.createDataFrame([(k, "src1", t) for k, t in rows], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.queries()
    hits = {(r["doc_id"], r["type"], r["match"]) for r in found["whole_pii"](spark, str(tmp_path)).collect()}
    assert {h for h in hits if h[0] < 2} == {(0, "EMAIL", "a@b.example"), (0, "EMAIL", "a.b@mail.example"), (0, "PAN", "ABCDE1234F"), (1, "EMAIL", "x.y@z.example"), (1, "PHONE_IN", "9876543210")}
    red = {r["doc_id"]: (r["text_redacted"], r["hits"]) for r in found["whole_redacted"](spark, str(tmp_path)).collect()}
    assert red[0] == ("Key 12ab838394cd, <EMAIL>\n560034 \n;PAN <PAN> and mail <EMAIL> now", 3) and red[2] == (" \n;<ADDRESS>.", 1)
    every = {(r["doc_id"], r["type"], r["match"], r["start"]) for r in found["every_pii"](spark, str(tmp_path)).collect()}
    assert {(0, "PIN_IN", "838394", 8), (1, "PHONE_IN", "9225426587", 0)} <= every and {h[:3] for h in every} > hits


def test_addresses_are_those_of_the_whole_text():
    import random

    rng, address, code = random.Random(5), *extract._address()
    parts = ["flat no. 560034", "h.no 12", "H.No. 560034", "near", "é", ".", ";", ":", " ", "\n", "560034", "1234567", "-", ",", "x560034"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        want = [m.span() for m in address.finditer(t) if code.search(m.group())]
        assert [(h["start"], h["end"]) for h in extract.pii_hits(t, ["ADDRESS"])] == want


def test_terms_and_triggers_are_those_of_the_patterns(spark):
    """Against a pattern for each term, all triggers as one pattern, and all names as one list, in texts of their parts; at a fraction of the patterns' cost."""
    import random
    import time

    rng = random.Random(8)
    every = re.compile("|".join(f"(?:{p})" for p in lexicon.ADR_TRIGGERS), re.I)
    parts = [*lexicon.NEGATIVE, *lexicon.POSITIVE, *lexicon.NEGATORS, *list(text.DRUG_NAMES)[:30], *lexicon.SYMPTOMS[:30], "years on", "adr", "adrs", "reſtarted", "reaKtion", "caused\nme", "RİSK OF", "BLOOD work", "hospitalized", "é", "ß", "Σ", "0", "x"]
    texts = ["".join(x for _ in range(rng.randint(1, 9)) for x in (rng.choice([str.upper, str.lower, str.title])(rng.choice(parts)), rng.choice(["", " ", " ", "-", "."]))) for _ in range(600)]
    names = lambda table, t: [m.group().lower() for m in re.finditer(rf"(?<![A-Za-z0-9])(?:{'|'.join(map(re.escape, sorted(table, key=len, reverse=True)))})(?![A-Za-z0-9])", t, re.I)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.has_trigger(F.col("t")).alias("g"), text.drugs(F.col("t")).alias("d"), text.symptoms(F.col("t")).alias("s")).collect()
    for r in rows:
        t, told = r["t"], extract.sentiment(r["t"])
        assert told["has_adr_trigger"] == r["g"] == bool(every.search(t)), t
        count = lambda terms: sum(len(re.findall(rf"(?<![a-z]){re.escape(x)}(?![a-z])", t.lower())) for x in terms)
        assert len(told["matched_negative"]) + len(told["negated"]) == count(lexicon.NEGATIVE) and len(told["matched_positive"]) - len(told["negated"]) == count(lexicon.POSITIVE)
        assert r["d"] == [text.DRUG_NAMES[n] for n in names(text.DRUG_NAMES, t)] and r["s"] == names(text.SYMPTOM_NAMES, t), t
    long = "thonereat inggoth andly. " * 20_000
    began = time.process_time()
    extract.sentiment(long)
    ours, began = time.process_time() - began, time.process_time()
    every.search(long)
    assert ours < time.process_time() - began


def test_blocks_of_a_page_are_whole(spark):
    said = [f"{k} {'word ' * 20}".strip() for k in range(450)]
    rows = spark.createDataFrame([(1, "http://h/", "".join(f"<p>{t}</p>" for t in said + said[:9]))], "page_id long, url string, html string")
    assert html.blocks("".join(f"<li>{t}</li>" for t in said))[1] == said
    for how in (True, False):
        assert [(r["nth"], r["text"]) for r in html.page_blocks(rows, unclosed=how).orderBy("nth").collect()] == list(enumerate(said))


def test_blocks_of_long_pages_equal_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    page = lambda k, n: f"<html><head><title>T{k} &amp; more</title></head><body><article>" + "".join(f"<p>{j % (n - 3)} {'word ' * 20}</p>" for j in range(n)) + "</article></body></html>"
    rows = [(k, f"http://h/{k}", page(k, n)) for k, n in enumerate([5, 199, 200, 201, 202, 203, 253, 1200])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["html_block_dedup"]).fetchall()
    assert sorted(map(tuple, catalog.queries()["html_block_dedup"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == sum(1 + n - 3 for n in (5, 199, 200, 201, 202, 203, 253, 1200))
