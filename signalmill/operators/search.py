"""Search for parts of names by an index of trigrams: candidates have every trigram of the query, `like` verifies them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that the trigrams are dealt over; a search reads those of its own trigrams.
BUCKETS = 64


def grams(text: Column) -> Column:
    """Each run of three characters, in lower case, once."""
    low = F.lower(text)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 2)), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_distinct(runs)).otherwise(F.array(low))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def postings(names: DataFrame) -> DataFrame:
    """(name, gram, bucket) of names (name), dealt by bucket. A name of less than three characters is its own trigram."""
    rows = names.where("name IS NOT NULL").distinct().select("name", F.explode(grams(F.col("name"))).alias("gram"))
    return rows.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket")


def wanted(query: str) -> list[str]:
    """The trigrams that a name must have: of the query's parts between its wild characters."""
    parts = re.split("[%_]", query.lower())
    return list(dict.fromkeys(p[k : k + 3] for p in parts for k in range(len(p) - 2)))


def candidates(index: DataFrame, query: str) -> DataFrame:
    """(name) that can match, of an index with or without repeats; all of them for a query without a trigram."""
    asked = wanted(query)
    if not asked:
        return index.select("name").distinct()
    own = index.where(F.col("bucket").isin([_bucket(F.lit(g)) for g in asked]) & F.col("gram").isin(asked))
    return own.select("name", "gram").distinct().groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") == len(asked)).select("name")
