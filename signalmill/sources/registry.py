"""Readers by the connector names of configurations."""

from __future__ import annotations

import urllib.parse
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConnectorError
from ..project import SourceConfig
from ..tables import settled
from . import api, feeds, html

Reader = Callable[[SparkSession, dict, F.Column], DataFrame]


def _fetched(spark: SparkSession, urls: list[str], headers: dict[str, str] | None = None) -> DataFrame:
    """(page_id, url, html): configuration-sized lists of pages, fetched where they are read."""
    @F.pandas_udf("string")
    def load(url: pd.Series) -> pd.Series:
        return url.map(lambda u: (lambda r: r.text if r.ok else None)(api.fetch_as(u, headers) if headers else api.fetch(u)))

    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(max(1, len(urls)))
    return rows.withColumn("html", load("url")).where("html IS NOT NULL")


def _pages(spark, p) -> DataFrame:
    return spark.read.parquet(p["path"]) if p.get("path") else _fetched(spark, p.get("urls") or [p["url"]])


def _blocks(spark, p, now) -> DataFrame:
    return feeds.shaped(html.page_blocks(_pages(spark, p)).select("external_id", "url", "text", now.alias("posted_at"), F.lit("html").alias("source_kind")))


def _listing(spark, p, now) -> DataFrame:
    found = html.link_column(p.get("link_pattern"), p.get("same_host_only", True), int(p.get("max_urls", 50)))
    pages = _pages(spark, p).select("page_id", F.posexplode(found("url", "html")).alias("nth", "u"))
    first = pages.groupBy("u").agg(F.min(F.struct("page_id", "nth")).alias("at")).orderBy("at").limit(int(p.get("max_urls", 50)))
    urls = [r["u"] for r in first.collect()]  # max_urls rows, in the pages' order
    return _blocks(spark, {"urls": urls}, now)


def _items(spark, p, now, hashed) -> DataFrame:
    keys = {"listing": p.get("list_selector", "article"), "title": p.get("title_selector"), "body": p.get("body_selector"), "link": p.get("link_selector"), "date": p.get("date_selector"), "most": int(p.get("max_items", 100 if hashed else 10)), "hashed": hashed}

    @F.pandas_udf("array<struct<external_id:string,url:string,text:string,date:string>>")
    def pick(url: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([html.items(u, h, **keys) for u, h in zip(url, page)])

    rows = _pages(spark, p).select(F.explode(pick("url", "html")).alias("i")).select("i.*")
    return feeds.shaped(rows.withColumns({"posted_at": feeds.dated(F.col("date"), now), "source_kind": F.lit("html")}))


def _rss(spark, p, now) -> DataFrame:
    tag, most = p.get("row_tag", "item"), int(p.get("max_items", 25))
    if p.get("path"):
        return feeds.rss(spark, p["path"], now, tag, most, p.get("language"))
    return feeds.rss_texts(_fetched(spark, [p["feed_url"]]).select("url", F.col("html").alias("text")), now, tag, most, p.get("language"))


def _reddit(spark, p, now) -> DataFrame:
    """Captured listings (path), or listings page by page from the site; with comments, if asked for, of the kept posts."""
    subs, total = p.get("subreddits") or ["all"], int(p.get("limit", 1000))
    if p.get("path"):
        posts = feeds.reddit_listing(spark, p["path"], len(subs), total)
        threads = spark.read.text(p["comments_path"], wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("post_id"), F.col("value").alias("thread")) if p.get("comments_path") else None
        return posts if threads is None else posts.unionByName(feeds.comment_records(threads, int(p.get("max_comments", 100))))
    base, pages = p.get("base_url", "https://www.reddit.com"), int(p.get("pages", 5))

    @F.pandas_udf("array<string>")
    def listing(sub: pd.Series) -> pd.Series:
        return sub.map(lambda s: api.listing_pages(f"{base}/r/{s}/new.json?limit=100&after={{after}}", pages))

    rows = spark.createDataFrame([(s,) for s in subs], "sub string").repartition(len(subs))  # a task for each subreddit
    found = rows.select("sub", F.explode(listing("sub")).alias("x")).select("sub", F.from_json("x", feeds.LISTING).alias("l")).select("sub", F.explode("l.data.children.data").alias("p")).select("sub", "p.*")
    posts = feeds.reddit_records(found, len(subs), total)
    if not p.get("include_comments"):
        return posts
    posts = settled(posts)

    @F.pandas_udf("string")
    def thread(url: pd.Series) -> pd.Series:
        return url.map(lambda u: api.second_listing(f"{u.rstrip('/')}.json"))

    told = posts.select(F.substring("external_id", 8, 1 << 20).alias("post_id"), thread("url").alias("thread")).where("thread IS NOT NULL")
    return posts.unionByName(feeds.comment_records(told, int(p.get("max_comments", 100))))


def _x(spark, p, now) -> DataFrame:
    """With a key and a query the site's search, newest first; without, or where it can't be had, captured posts (path)."""
    if p.get("api_key") and p.get("query"):
        url = p.get("search_url", "https://api.twitterapi.io/twitter/tweet/advanced_search")
        asked = urllib.parse.urlencode({"query": p["query"], "queryType": "Latest"})
        pages = settled(_fetched(spark, [f"{url}?{asked}" if not url.startswith("file:") else url], {"X-API-Key": p["api_key"]}))
        if not p.get("path") or not pages.isEmpty():
            found = pages.select(F.from_json("html", feeds.SEARCHED).alias("r")).select(F.posexplode("r.tweets").alias("nth", "t")).where(F.col("nth") < int(p.get("max_results", 50)))
            return feeds.searched_records(found.select("t.*"), now)
    return feeds.x_posts(spark, p["path"], now)


READERS: dict[str, Reader] = {
    "reddit": _reddit,
    "rss": _rss,
    "faers": lambda s, p, now: feeds.faers(s, p["path"], now),
    "openfda": lambda s, p, now: feeds.openfda(s, p["path"], now) if p.get("path") else feeds.openfda_records(s.read.format("json_api").options(**{k: str(v) for k, v in {"path": "https://api.fda.gov/drug/event.json", **p}.items()}).load().select(F.from_json("value", feeds.OPENFDA).alias("r")).select("r.*"), now),
    "whatsapp": lambda s, p, now: feeds.whatsapp(s, p.get("path") or p["fixture"], now),
    "x": _x,
    "html_auto": _blocks,
    "html_listing": _listing,
    "html_stealth": lambda s, p, now: _items(s, p, now, True),
    "generic_html": lambda s, p, now: _items(s, p, now, False),
}


def read(spark: SparkSession, source: SourceConfig, now: F.Column, after=None) -> DataFrame:
    """The source's records, those dated after `after` if given. Made-up posts are no connector of configurations."""
    if source.reader not in READERS:
        raise ConnectorError(f"unknown connector: {source.connector}")
    if source.reader == "openfda":
        api.register(spark)
    return feeds.since(READERS[source.reader](spark, source.reader_params(), now), after)


def _reddit_stream(spark, p, now) -> DataFrame:
    """Posts of each subreddit page by page: a stream for each, with a cursor of its own in the query's checkpoint."""
    api.register(spark)
    subs, base = p.get("subreddits") or [p.get("subreddit", "all")], p.get("base_url", "https://www.reddit.com")
    path = p.get("listing_url") or f"{base}/r/{{name}}/new.json?limit=100&after={{after}}"
    pages = lambda sub: spark.readStream.format("json_api").options(path=path.replace("{name}", sub), pages=str(p.get("pages", 5))).load()
    rows = reduce(DataFrame.union, map(pages, subs))
    return feeds.post_records(rows.select(F.from_json("value", feeds.POST).alias("p")).select("p.*"))


def _json_stream(spark, path, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("multiLine", True).json(path)


#: Readers of what arrives, for connectors that have one.
STREAMS: dict[str, Reader] = {
    "reddit": _reddit_stream,
    "whatsapp": lambda s, p, now: feeds.whatsapp_records(_json_stream(s, p.get("path") or p["fixture"], feeds.INBOX), now),
    "x": lambda s, p, now: feeds.x_records(_json_stream(s, p["path"], feeds.POSTS), now),
}


def read_stream(spark: SparkSession, source: SourceConfig, now: F.Column) -> DataFrame:
    """The source's records as they arrive."""
    if source.reader not in STREAMS:
        raise ConnectorError(f"{source.connector} doesn't stream")
    return STREAMS[source.reader](spark, source.reader_params(), now)
