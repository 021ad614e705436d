"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256, which is checked again when they are read; the exact header bytes
of each record are stored apart with that address. Joining the two gives the original records back, which are then parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Smaller payloads are always responses; a record of a larger one revisits that with the largest id.
REVISIT_BYTES = 1000
CRLF = "\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line; none for null. Control characters, which would end it, become spaces."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", " "), F.lit(CRLF)))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


#: Addresses of several records up to which their list is broadcast.
SMALL = 100_000


def write_archive(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes `path`/payloads (address, payload) and `path`/records (head, address), one record a row of df.

    The payload is the html in UTF-8 (null: empty), of any length. Of records with equal payloads of at least REVISIT_BYTES bytes, those with the
    largest page_id are responses, the others revisit it; a null page_id is smaller than any. Rows that repeat that page_id
    are all responses; their payload is stored once all the same. Other columns aren't read; an empty table gives an empty archive.

    Addresses are counted first, without payloads. Payloads of one record are written where they are read; the others' copies meet first where
    they are read, so that a payload with very many copies is shuffled once a task.
    """
    spark = df.sparkSession
    payload = F.coalesce(df[html], F.lit("")).cast("binary")
    rows = df.select(df[page_id].cast("long").alias("page_id"), df[url].alias("url"), payload.alias("payload")).withColumn("address", F.sha2("payload", 256))
    facts = rows.select("page_id", "url", "address", F.octet_length("payload").alias("size"), F.sha1("payload").alias("sha1"))
    facts = common.materialise(spark, facts, "warc-facts")
    known = common.materialise(spark, facts.groupBy("address").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")), "warc-addresses")
    several = known.where("n > 1").select("address")
    stored = rows.select("address", "payload")
    if several.count() <= SMALL:
        again = stored.join(F.broadcast(several), "address", "left_semi").groupBy("address").agg(F.first("payload").alias("payload"))
        once = stored.join(F.broadcast(several), "address", "left_anti").unionByName(again)
    else:
        once = stored.groupBy("address").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size"), F.lit(CRLF + CRLF))
    joined = common.salted_join(facts, known, "address", "n").withColumn("http", http)
    response = (F.col("size") < REVISIT_BYTES) | F.col("page_id").eqNullSafe(F.col("latest"))
    block = F.octet_length("http") + F.when(response, F.col("size")).otherwise(0)
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.when(response, "response").otherwise("revisit")), _line("WARC-Record-ID", _urn(F.col("page_id"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Refers-To", F.when(~response, _urn(F.col("latest")))), _line("WARC-Profile", F.when(~response, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", block), F.lit(CRLF), F.col("http"),
    )
    joined.select(head.alias("head"), "address").write.parquet(f"{path}/records")


def _field(head: Column, name: str) -> Column:
    """A field of a WARC header (without the empty line that ends it); null if it isn't there."""
    value = F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def _warc_head(text: Column) -> Column:
    return F.substring_index(text, CRLF + CRLF, 1)


def _told(head: Column) -> dict[str, Column]:
    """What a record's WARC header tells."""
    urn = lambda name: F.regexp_extract(F.coalesce(_field(head, name), F.lit("")), r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    return {"page_id": number(urn("WARC-Record-ID")), "url": _field(head, "WARC-Target-URI"), "record_type": _field(head, "WARC-Type"), "refers_to": number(urn("WARC-Refers-To")), "digest": F.regexp_extract(_field(head, "WARC-Payload-Digest"), "^sha1:([0-9a-f]{40})$", 1)}


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, head, address): each record as its own header tells."""
    records = spark.read.parquet(f"{path}/records")
    return records.select(*(c.alias(n) for n, c in _told(_warc_head(F.col("head"))).items()), "head", "address")


def stored_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(address, payload): reading a payload raises if it isn't what its address says."""
    sound = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))))
    return spark.read.parquet(f"{path}/payloads").select("address", sound.alias("payload"))


def _with_payloads(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """A payload that very many of the records have is dealt, with them, over several tasks."""
    counts = records.groupBy("address").agg(F.count("*").alias("n"))
    return common.salted_join(records, stored_payloads(spark, path), "address", "n", "inner", counts)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """read_archive with each record's payload: that of a revisit is the one that it refers to. Raises where a payload is damaged."""
    return _with_payloads(spark, path, read_archive(spark, path))


def warc_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(record): the bytes of each record as a WARC file has them; a revisit has no payload, so only responses' are read."""
    end = F.lit(CRLF + CRLF).cast("binary")
    records = spark.read.parquet(f"{path}/records").withColumn("type", _field(_warc_head(F.col("head")), "WARC-Type"))
    full = _with_payloads(spark, path, records.where("type = 'response'").drop("type"))
    return full.select(F.concat(F.col("head").cast("binary"), "payload", end).alias("record")).unionByName(records.where("type <> 'response'").select(F.concat(F.col("head").cast("binary"), end).alias("record")))


def parsed(records: DataFrame, record: str = "record") -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of the bytes of WARC records, payload null for revisits;
    raises where a record's block or payload isn't what its headers say."""
    text = F.col(record).cast("string")
    parts = records.select(record, _warc_head(text).alias("_head"))
    parts = parts.withColumns({"_start": F.octet_length("_head") + 4, "_http": F.substring_index(F.substring_index(text, CRLF + CRLF, 2), CRLF + CRLF, -1)})
    parts = parts.select(record, "_head", *(c.alias(n) for n, c in _told(F.col("_head")).items()), "_start", F.regexp_extract("_http", r"Content-Length: (\d+)$", 1).cast("long").alias("payload_bytes"), (F.col("_start") + F.octet_length("_http") + 4).alias("_body"))
    block = _field(F.col("_head"), "Content-Length").cast("long")
    body = F.substring(F.col(record), F.col("_body") + 1, F.octet_length(record) - F.col("_body") - 4)
    whole = parts.withColumns({"_body_bytes": body, "_block": block})
    response = F.col("record_type") == "response"
    agrees = (F.octet_length(record) - F.col("_start") - 4 == F.col("_block")) & F.when(response, (F.octet_length("_body_bytes") == F.col("payload_bytes")) & (F.sha1("_body_bytes") == F.col("digest"))).otherwise(F.octet_length("_body_bytes") == 0)
    digest = F.when(agrees, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("a record disagrees with its headers: "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")))))
    return whole.select("page_id", "url", "record_type", "refers_to", "payload_bytes", digest.alias("payload_digest"), F.when(response, F.col("_body_bytes")).alias("payload"))
