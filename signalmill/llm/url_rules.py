"""URL filters by a sort-merge range join. DataFrame functions only.

A host with its labels reversed and each followed by a dot turns "this host and all subdomains" into
an interval of keys. The intervals nest, so a sweep over the rules' interval ends keeps a stack of active
rules; between two ends the stack is constant. Urls and interval ends are then sorted together, and each
url takes the stack of the last end before it and of that stack the longest rule whose path starts its own.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Interval ends above which a bucket of keys is cut; and how many of them an expression compares with.
MOST_BUCKETS = 256
#: Urls of a part at least.
PART_ROWS = 1000


def key_of(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split(".")))


def sweep(rules: list[Rule]) -> list[tuple[str, list[Rule]]]:
    """(key, stack) at each key where the stack of active rules changes; a stack has its longest rule first, of
    equally long ones a blocking one."""
    by_host: dict[str, list[Rule]] = {}
    for r in dict.fromkeys(rules):
        by_host.setdefault(key_of(r.host), []).append(r)
    events = sorted([(k, 1, k) for k in by_host] + [(k[:-1] + "/", 0, k) for k in by_host], key=lambda e: (e[0].encode(), e[1]))
    active: list[str] = []
    out: dict[str, list[Rule]] = {}
    for at, opens, key in events:
        if opens:
            active.append(key)
        else:
            active.remove(key)
        stack = [r for k in active for r in by_host[k]]
        out[at] = sorted(stack, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    return list(out.items())


_STACK = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(text, pattern, 2)


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", nowhere: str = "block") -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict. Urls that no rule fits get `default`, those
    without a host `nowhere`.

    Null urls and ones without `://` have an empty host and path. Every row is kept, repeated ones too; columns of df
    with the name of a new one are replaced. Urls of any length are read whole, an empty table gives an empty one; of equally
    long rules that fit a blocking one wins. Urls are counted by bucket of interval ends; a bucket with many is dealt over
    as many parts as it takes, by the rows' places, so that a host with most of the rows spreads, whatever repeats. Each part gets the
    interval ends of its bucket, and the bucket's first end carries the stack that holds at its start.
    """
    spark = df.sparkSession
    key, kind, stack, bucket, salt, found = common.fresh(df, "_key", "_kind", "_stack", "_bucket", "_salt", "_found")
    new = ["host", "path", "rule", "verdict"]
    host, path = split_url(df[url])
    (raw,) = common.fresh(df, "_host")
    (own_path,) = common.fresh(df, "_path")
    rows = df.withColumns({raw: host, own_path: path}).drop(*(c for c in df.columns if c.lower() in new))
    ends = sweep(rules)
    step = -(-len(ends) // MOST_BUCKETS) or 1
    splitters = [k for k, _ in ends[::step]]
    of_key = F.size(F.filter(F.array(*map(F.lit, splitters)).cast("array<string>"), lambda s: s <= F.col(key)))
    left = rows.withColumn(key, F.concat(F.array_join(F.reverse(F.split(raw, r"\.")), "."), F.lit(".")))
    left = left.withColumn(bucket, of_key)
    counts = {r[0]: r[1] for r in left.groupBy(bucket).count().collect()}  # MOST_BUCKETS rows and one
    part = max(PART_ROWS, -(-sum(counts.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    parts = F.get(F.array(*(F.lit(-(-counts.get(k, 1) // part)) for k in range(len(splitters) + 1))), F.col(bucket))
    left = left.withColumns({salt: F.pmod(F.monotonically_increasing_id(), parts).cast("int"), kind: F.lit(1), stack: F.lit(None).cast(_STACK)})
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(stack, _STACK)])
    marks = spark.createDataFrame([(k, [(r.path, r.name, r.verdict) for r in rs]) for k, rs in ends], schema)
    marks = marks.withColumns({bucket: of_key, kind: F.lit(0)}).withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1)))
    merged = left.unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy(bucket, salt).orderBy(key, kind).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = merged.withColumn(stack, F.last(stack, ignorenulls=True).over(before)).where(F.col(kind) == 1)
    fits = F.get(F.filter(stack, lambda r: F.startswith(F.col(own_path), r["path"])), F.lit(0))
    judged = swept.withColumn(found, fits)
    other = F.when(F.col(raw) == "", F.lit(nowhere)).otherwise(F.lit(default))
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (raw, own_path)]
    return judged.select(*kept, F.col(raw).alias("host"), F.col(own_path).alias("path"), F.col(found)["rule"].alias("rule"), F.coalesce(F.col(found)["verdict"], other).alias("verdict"))
