"""Readers of files that feeds and APIs give, each to records of schemas.RAW_RECORD. Whole files in Spark's own readers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import emission_cap
from ..schemas import RAW_RECORD


def shaped(df: DataFrame) -> DataFrame:
    """The columns of a raw record, null where df has none."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_RECORD.fields))


def since(df: DataFrame, at) -> DataFrame:
    """Records after `at`, and undated ones."""
    return df.where(F.col("posted_at").isNull() | (F.col("posted_at") > F.lit(at))) if at is not None else df


def dated(value: Column, fallback: Column, *formats: str) -> Column:
    """The first format that reads the value, else the fallback: a time no later than the run's end, so that no gate drops it."""
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in formats), F.try_to_timestamp(value), fallback)


def _plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


RSS = "guid string, id string, title string, link string, description string, summary string, pubDate string, published string, updated string, author string"


#: Of Atom, links are elements with an address and a relation.
ATOM = "id string, title string, summary string, content string, published string, updated string, author struct<name:string>, link array<struct<_href:string,_rel:string>>"


def _items(rows: DataFrame, row_tag: str) -> DataFrame:
    """Rows as RSS has them: of Atom's links the one to the entry itself."""
    if row_tag != "entry":
        return rows
    own = F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    return rows.withColumns({"link": own, "summary": F.coalesce("summary", "content"), "author": F.col("author.name"), **{c: F.lit(None).cast("string") for c in ("guid", "description", "pubDate")}})


def rss(spark: SparkSession, path: str, now: Column, row_tag: str = "item", most: int = 25, language: str | None = None) -> DataFrame:
    """Items of an RSS feed (row_tag "entry": Atom), the first `most` of each file."""
    schema = ATOM if row_tag == "entry" else RSS
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).withColumn("_file", F.input_file_name()).withColumn("_nth", F.monotonically_increasing_id())
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_file").orderBy("_nth"))).where(F.col("_k") <= most)
    return rss_records(_items(rows, row_tag), now, F.lit(language))


def rss_texts(texts: DataFrame, now: Column, row_tag: str = "item", most: int = 25, language: str | None = None) -> DataFrame:
    """Items of feeds fetched as text (url, text); the language is the feed's own, where it names one."""
    items = F.slice(F.regexp_extract_all("text", F.lit(rf"(?s)<{row_tag}[ >].*?</{row_tag}>"), F.lit(0)), 1, most)
    told = F.coalesce(*(F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in (r"<language>\s*([\w-]+)\s*</language>", r"<feed\b[^>]*\bxml:lang=[\"']([\w-]+)")), F.lit(language))
    rows = texts.select(told.alias("_language"), F.explode(items).alias("x")).select("_language", F.from_xml("x", ATOM if row_tag == "entry" else RSS).alias("i")).select("_language", "i.*")
    return rss_records(_items(rows, row_tag), now, F.col("_language"))


def rss_records(rows: DataFrame, now: Column, language: Column | str | None = None) -> DataFrame:
    """Rows of RSS, one an item."""
    language = language if isinstance(language, Column) else F.lit(language)
    # Weekdays and zone names of mail dates aren't read by Spark's patterns.
    told = F.regexp_replace(F.regexp_replace(F.coalesce("published", "pubDate", "updated"), "^[A-Za-z]{3},\\s*", ""), "(GMT|UTC|UT)$", "+0000")
    at = dated(told, now, "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX")
    body = _plain(F.coalesce("summary", "description", F.lit("")))
    return shaped(rows.select(F.concat(F.lit("rss:"), F.coalesce("id", "guid", "link")).alias("external_id"), F.col("link").alias("url"), F.trim(F.concat_ws("\n\n", "title", body)).alias("text"), at.alias("posted_at"), F.col("author").alias("author_handle"), language.alias("language_hint"), F.lit("rss").alias("source_kind")))


def faers(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """`$`-separated Latin-1 rows with a header: primaryid, drugname, pt, event_dt, narrative; from text files, or from those in
    ZIP archives, each of which is unpacked where it is read."""
    if path.lower().endswith(".zip"):
        return faers_records(_unzipped(spark, path), now)
    return faers_records(spark.read.csv(path, sep="$", encoding="ISO-8859-1", header=True), now)


FAERS = "primaryid string, drugname string, pt string, event_dt string, narrative string"


def _unzipped(spark: SparkSession, path: str) -> DataFrame:
    names = [f.split()[0] for f in FAERS.split(", ")]

    def rows(batches):
        import csv
        import io
        import zipfile

        for batch in batches:
            for data in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".txt")):
                        with z.open(name) as f:
                            lines = csv.DictReader(io.TextIOWrapper(f, "ISO-8859-1", newline=""), delimiter="$")
                            lines.fieldnames = [x.strip().lower() for x in lines.fieldnames or []]
                            held = []
                            for line in lines:
                                held.append([line.get(n) for n in names])
                                if len(held) == 4096:
                                    yield pd.DataFrame(held, columns=names)
                                    held = []
                            yield pd.DataFrame(held, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, FAERS)


def faers_records(rows: DataFrame, now: Column) -> DataFrame:
    have = {c.lower(): c for c in rows.columns}
    get = lambda c: F.col(have[c]) if c in have else F.lit(None).cast("string")
    empty = lambda c: F.coalesce(get(c), F.lit(""))
    text = F.concat(F.lit("Drug: "), empty("drugname"), F.lit("\nReaction: "), empty("pt"), F.lit("\nNarrative: "), empty("narrative"))
    return shaped(rows.select(F.concat(F.lit("faers:"), get("primaryid")).alias("external_id"), text.alias("text"), dated(get("event_dt"), now, "yyyy-MM-dd", "yyyyMMdd").alias("posted_at"), F.lit("faers").alias("source_kind")))


OPENFDA = "safetyreportid string, safetyreportversion string, occurcountry string, serious string, receiptdate string, transmissiondate string, patient struct<drug array<struct<medicinalproduct string>>, reaction array<struct<reactionmeddrapt string>>>"


def openfda_records(reports: DataFrame, now: Column) -> DataFrame:
    """Reports with an id, a drug and a reaction as narratives."""
    names = lambda arr, f: F.filter(F.transform(F.coalesce(F.col(arr), F.array()), lambda x: F.trim(x[f])), lambda x: F.coalesce(F.length(x), F.lit(0)) > 0)
    rows = reports.withColumns({"_drugs": names("patient.drug", "medicinalproduct"), "_events": names("patient.reaction", "reactionmeddrapt")}).where("safetyreportid IS NOT NULL AND size(_drugs) > 0 AND size(_events) > 0")
    serious = F.when(F.col("serious") == "1", "serious").otherwise("non-serious")
    text = F.concat(F.lit("Adverse event report ("), serious, F.lit("). Drug: "), F.array_join("_drugs", ", "), F.lit(". Reaction: "), F.array_join("_events", ", "), F.coalesce(F.concat(F.lit(". Country: "), F.col("occurcountry")), F.lit("")), F.lit("."))
    at = dated(F.coalesce("receiptdate", "transmissiondate"), now, "yyyyMMdd")
    ident = F.concat_ws(":", F.lit("openfda"), "safetyreportid", "safetyreportversion")
    return shaped(rows.select(ident.alias("external_id"), text.alias("text"), at.alias("posted_at"), F.to_json(F.struct(*reports.columns)).alias("raw_blob"), F.lit("openfda").alias("source_kind")))


def openfda(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Captured pages: {"results": [report, ...]}."""
    pages = spark.read.json(path, schema=f"results array<struct<{OPENFDA}>>", multiLine=True)
    return openfda_records(pages.select(F.explode("results").alias("r")).select("r.*"), now)


INBOX = "id string, `from` string, ts string, lang string, text string"


def whatsapp_records(rows: DataFrame, now: Column) -> DataFrame:
    ident = F.concat(F.lit("wa:"), F.coalesce("id", F.substring(F.sha1("text"), 1, 12)))
    return shaped(rows.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(ident.alias("external_id"), "text", dated(F.col("ts"), now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("posted_at"), F.col("from").alias("author_handle"), F.col("lang").alias("language_hint"), F.lit("whatsapp").alias("source_kind")))


def whatsapp(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """JSON arrays of messages; with readStream, whatsapp_records takes the same rows as they arrive."""
    return whatsapp_records(spark.read.json(path, schema=INBOX, multiLine=True), now)


POSTS = "id string, author string, created_at string, lang string, text string, url string"


def x_posts(spark: SparkSession, path: str, now: Column) -> DataFrame:
    return x_records(spark.read.json(path, schema=POSTS, multiLine=True), now)


def x_records(rows: DataFrame, now: Column) -> DataFrame:
    return shaped(rows.where("id IS NOT NULL").select(F.concat(F.lit("x:"), F.col("id")).alias("external_id"), "url", "text", dated(F.col("created_at"), now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("posted_at"), F.col("author").alias("author_handle"), F.col("lang").alias("language_hint"), F.lit("x").alias("source_kind")))


SEARCHED = "tweets array<struct<id:string,text:string,createdAt:string,lang:string,author:struct<userName:string>>>"


def searched_records(rows: DataFrame, now: Column) -> DataFrame:
    """Rows of a search's answer; its times name the weekday, which Spark's patterns don't read."""
    told = F.regexp_replace(F.col("createdAt"), "^[A-Za-z]{3}\\s+", "")
    at = dated(told, now, "MMM d HH:mm:ss Z yyyy", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return shaped(rows.where("id IS NOT NULL").select(F.concat(F.lit("x:"), F.col("id")).alias("external_id"), F.concat(F.lit("https://x.com/i/status/"), F.col("id")).alias("url"), F.coalesce("text", F.lit("")).alias("text"), at.alias("posted_at"), F.col("author.userName").alias("author_handle"), F.col("lang").alias("language_hint"), F.lit("x").alias("source_kind")))


_POST = "id:string,title:string,selftext:string,permalink:string,author:string,created_utc:double"
POST = f"struct<{_POST}>"
LISTING = f"data struct<after:string,children:array<struct<data:struct<{_POST}>>>>"


def reddit_listing(spark: SparkSession, path: str, subreddits: int = 1, total: int = 1000) -> DataFrame:
    """Captured listings; of each file (a subreddit) the newest total // subreddits posts."""
    posts = spark.read.json(path, schema=LISTING, multiLine=True).select(F.input_file_name().alias("sub"), F.explode("data.children.data").alias("p")).select("sub", "p.*")
    return reddit_records(posts, subreddits, total)


def reddit_records(posts: DataFrame, subreddits: int = 1, total: int = 1000) -> DataFrame:
    """Posts with their subreddit as `sub`; of each the newest total // subreddits."""
    return post_records(emission_cap(posts.where("id IS NOT NULL"), "sub", [F.desc("created_utc"), F.col("id")], total, subreddits))


def post_records(posts: DataFrame) -> DataFrame:
    text = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("selftext", F.lit(""))))
    return shaped(posts.where("id IS NOT NULL").select(F.concat(F.lit("reddit:"), F.col("id")).alias("external_id"), F.concat(F.lit("https://www.reddit.com"), "permalink").alias("url"), text.alias("text"), F.timestamp_seconds(F.coalesce("created_utc", F.lit(0.0))).alias("posted_at"), F.col("author").alias("author_handle"), F.lit("reddit").alias("source_kind")))


def comments(thread: dict, post_id: str, most: int = 100) -> list[dict]:
    """Comments of one thread, breadth first; a comment without id or text is left out with its replies."""
    queue, out = list((thread.get("data") or {}).get("children") or []), []
    while queue and len(out) < most:
        node = queue.pop(0)
        d = node.get("data") or {}
        if node.get("kind") != "t1" or not d.get("id") or not d.get("body"):
            continue
        out.append({"external_id": f"reddit:{post_id}:c:{d['id']}", "text": d["body"], "author_handle": d.get("author"), "parent_id": d.get("parent_id"), "created_utc": d.get("created_utc") or 0})
        if isinstance(d.get("replies"), dict):
            queue += (d["replies"].get("data") or {}).get("children") or []
    return out


def comment_records(threads: DataFrame, most: int = 100) -> DataFrame:
    """Records of the comments of (post_id, thread: JSON of its comment listing)."""
    rows = threads.select(F.explode(comment_column(most)("post_id", "thread")).alias("c")).select("c.*")
    return shaped(rows.withColumns({"posted_at": F.timestamp_seconds("created_utc"), "source_kind": F.lit("reddit")}))


COMMENT = T.ArrayType(T.StructType([T.StructField("external_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("author_handle", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("created_utc", T.DoubleType())]))


def comment_column(most: int = 100):
    """Column function of (post id, JSON of the thread's comment listing)."""
    import json

    @F.pandas_udf(COMMENT)
    def flat(post: pd.Series, thread: pd.Series) -> pd.Series:
        return pd.Series([[{**c, "created_utc": float(c["created_utc"])} for c in comments(json.loads(t), p, most)] if t else [] for p, t in zip(post, thread)])

    return flat


def register(spark: SparkSession) -> None:
    """A table function for SQL: comment_tree(post_id, thread)."""
    import json

    @F.udtf(returnType="external_id string, text string, author_handle string, parent_id string, created_utc double")
    class CommentTree:
        def eval(self, post: str, thread: str):
            for c in comments(json.loads(thread), post) if thread else ():
                yield c["external_id"], c["text"], c["author_handle"], c["parent_id"], float(c["created_utc"])

    spark.udtf.register("comment_tree", CommentTree)


# Sentences of made-up posts, with the shares of pairs, lone drugs, lone events and background.
_PAIR_TEXTS = ("Took {d} and ended up with {e}.", "After taking {d} I have {e} every day.", "{d} caused me {e}, had to stop.")
_OTHER_TEXTS = ("Started {d} last week, fine so far.", "Is {e} common in this weather?", "Long day, nothing to report.")


def synthetic(spark: SparkSession, n: int = 150, seed: int = 7, pairs: tuple[tuple[str, str, int], ...] = (("dermacult", "angioedema", 18), ("somnifert-x", "severe insomnia", 14), ("metformin", "lactic acidosis", 12), ("ranitidine", "ndma contamination", 16))) -> DataFrame:
    """n made-up posts, the same for a seed: so many of each pair, the rest without one. For tests and demonstrations."""
    bounds, total = [], 0
    for d, e, k in pairs:
        total += k
        bounds.append((total, d, e))
    rows = spark.range(n).withColumn("h", F.abs(F.xxhash64(F.col("id"), F.lit(seed))))
    pick = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (F.col("h") % len(texts) + 1).cast("int"))
    which = F.element_at(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(e).alias("e")) for d, e, _ in pairs)), (F.floor(F.col("h") / 7) % len(pairs) + 1).cast("int"))
    chosen, text = which, pick(_OTHER_TEXTS)
    for k, d, e in reversed(bounds):
        chosen = F.when(F.col("id") < k, F.struct(F.lit(d).alias("d"), F.lit(e).alias("e"))).otherwise(chosen)
    text = F.when(F.col("id") < total, pick(_PAIR_TEXTS)).otherwise(text)
    body = F.concat(F.replace(F.replace(text, F.lit("{d}"), chosen["d"]), F.lit("{e}"), chosen["e"]), F.lit(" #"), F.col("id").cast("string"))
    return shaped(rows.select(F.concat(F.lit("syn:"), F.col("id").cast("string")).alias("external_id"), body.alias("text"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("posted_at"), F.lit("synthetic").alias("source_kind")))


def healthy(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()
