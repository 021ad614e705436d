"""Importance resampling: documents are drawn by how much likelier their word n-grams are in a target corpus.

Features (runs of one to three words) are hashed into buckets. A corpus becomes postings by bucket: of each chunk of documents,
the documents that hold a bucket's features and how often. Postings are shuffled to their bucket, where the totals of both corpora
meet and give its gain; what a bucket contributes goes back to the chunk, where it is summed by document.

A posting is the gap to the document before and a count, in the fewest bytes that hold a row's numbers, so that each of the three
passes over the postings (writing, dealing by bucket, dealing back) takes about a byte and a half for each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, words

BUCKETS, ORDERS = 10_000, 3
#: Words after which a chunk of documents is closed; words that are Python objects at once.
CHUNK_WORDS, RUN_WORDS = 500_000, 200_000
#: Rows of postings of a bucket (of as many chunks) that meet in one group; a bucket that has more is dealt over salts.
GROUP_ROWS = 10_000
#: Bytes of a word up to which its CRC is appended by tables.
SHORT = 64

_POSTINGS = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("postings", T.IntegerType()), T.StructField("data", T.BinaryType()),
    *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("doc_ids", "words", "features")),
])
_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("postings", pa.int32()), ("data", pa.binary()), *((c, pa.list_(pa.int64())) for c in ("doc_ids", "words", "features"))])


@cache
def _moved() -> np.ndarray:
    """What a length of zero bytes makes of each byte of a CRC: (length, byte's place, byte)."""
    out = np.empty((SHORT + 1, 4, 256), dtype=np.uint32)
    for n in range(SHORT + 1):
        none = zlib.crc32(bytes(n), 0)
        for k in range(4):
            out[n, k] = [zlib.crc32(bytes(n), v << 8 * k) ^ none for v in range(256)]
    return out


def _joined(before: np.ndarray, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts followed by others of known CRC and length (of SHORT bytes at most)."""
    table = _moved()
    out = crc.copy()
    for k in range(4):
        out ^= table[length, k, (before >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def feature_codes(run: list[bytes], doc: np.ndarray, fresh: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(crc, doc) of every run of up to ORDERS words of one document that ends at word `fresh` or later."""
    index = _Vocabulary()
    at = np.fromiter(map(index.__getitem__, run), dtype=np.int64, count=len(run))
    own = np.array([zlib.crc32(w) for w in index], dtype=np.uint32)[at]
    spaced = [b" " + w for w in index]
    after = np.array([zlib.crc32(w) for w in spaced], dtype=np.uint32)[at]
    length = np.array([len(w) for w in spaced], dtype=np.int64)[at]
    codes, docs, last = [own[fresh:]], [doc[fresh:]], own
    for order in range(1, ORDERS):
        before, ends = last[:-1], np.arange(order, len(run))
        if not len(ends):
            break
        last = _joined(before, after[ends], np.minimum(length[ends], SHORT))
        for k in np.flatnonzero(length[ends] > SHORT).tolist():
            last[k] = zlib.crc32(b" " + run[ends[k]], int(before[k]))
        kept = (doc[ends] == doc[ends - order]) & (ends >= fresh)
        codes.append(last[kept])
        docs.append(doc[ends][kept])
    return np.concatenate(codes), np.concatenate(docs)


def _pieces(text: str | None, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, of some of it at a time."""
    data = words.spaced(text)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + most)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _packed(gaps: np.ndarray, counts: np.ndarray) -> bytes:
    most = max(int(gaps.max()), int(counts.max()))
    kind = next(k for k, top in (("u1", 1 << 8), ("<u2", 1 << 16), ("<u4", 1 << 32), ("<u8", 1 << 64)) if most < top)
    return gaps.astype(kind).tobytes() + counts.astype(kind).tobytes()


def _unpacked(data: bytes, postings: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(data, dtype=f"<u{len(data) // (2 * postings)}").astype(np.int64)
    return np.cumsum(numbers[:postings]), numbers[postings:]


class _Chunk:
    """Documents under way: words that aren't counted yet, and counts by (bucket, document)."""

    def __init__(self):
        self.ids, self.words, self.counts = [], [], []
        self.run, self.doc, self.fresh = [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        k, n = len(self.ids), 0
        for piece in _pieces(text):
            self.run.extend(piece)
            self.doc.append((k, len(piece)))
            n += len(piece)
            if len(self.run) >= RUN_WORDS:
                self.count(k)
        self.ids.append(doc_id)
        self.words.append(n)

    def count(self, open_doc: int | None = None) -> None:
        """Counts the run; its last words stay where a document goes on."""
        doc = np.repeat(*(np.array(x, dtype=np.int64) for x in zip(*self.doc))) if self.doc else np.empty(0, dtype=np.int64)
        if len(self.run) > self.fresh:
            crc, of = feature_codes(self.run, doc, self.fresh)
            self.counts.append(np.unique((crc % np.uint32(BUCKETS)).astype(np.int64) << 32 | of, return_counts=True))
            if len(self.counts) > 8:
                self.counts = [self.merged()]
        tail = 0 if open_doc is None else min(ORDERS - 1, int((doc[-(ORDERS - 1) :] == open_doc).sum()))
        self.run, self.doc, self.fresh = (self.run[-tail:], [(open_doc, tail)], tail) if tail else ([], [], 0)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in self.counts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in self.counts])).astype(np.int64)

    def rows(self, chunk: int) -> pa.RecordBatch:
        """A row for the documents (bucket -1), and one for each bucket."""
        self.count()
        keys, counts = self.counts[0] if len(self.counts) == 1 else self.merged() if self.counts else (np.empty(0, dtype=np.int64),) * 2
        buckets, doc = keys >> 32, keys & 0xFFFFFFFF
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = doc[starts]
        ends = np.r_[starts[1:], len(keys)].tolist() if len(keys) else []
        data = [_packed(gaps[a:b], counts[a:b]) for a, b in zip(starts.tolist(), ends)]
        sums = np.add.reduceat(counts, starts).tolist() if len(keys) else []
        features = [sum(max(0, n - k) for k in range(ORDERS)) for n in self.words]
        blank = [None] * len(data)
        columns = [[chunk] * (len(data) + 1), [-1, *buckets[starts].tolist()], [0, *sums], [0, *(b - a for a, b in zip(starts.tolist(), ends))], [b"", *data], [self.ids, *blank], [self.words, *blank], [features, *blank]]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def postings(df: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """(chunk, bucket, n, postings, data): what documents of a chunk hold of a bucket, n features in all; and a row of bucket -1 for
    each chunk, with its documents' ids and numbers of words and features."""
    common.ship(df.sparkSession)
    common.bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held(None, lambda: None)
        base, made, held, size = TaskContext.get().partitionId() << 33, 0, _Chunk(), 0
        for batch in batches:
            for part in common.slices(batch, ["text"]):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.add(i, t)
                    size += held.words[-1] + 1
                    if size >= CHUNK_WORDS:
                        yield held.rows(base + made)
                        made, held, size = made + 1, _Chunk(), 0
        if held.ids:
            yield held.rows(base + made)
        common.release()

    return df.select(doc_id.cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, _POSTINGS)


def bucket_totals(stored: DataFrame, name: str) -> DataFrame:
    """(bucket, name): BUCKETS rows at most."""
    return stored.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of the totals (bucket, s) and (bucket, t) of two corpora, which meet by bucket."""
    number = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    whole = source.agg(F.sum("s").alias("all_s")).crossJoin(target.agg(F.sum("t").alias("all_t")))  # one row each
    both = source.join(target, "bucket", "full").crossJoin(F.broadcast(whole))
    ratio = (number(F.col("t")) + 1) * (number(F.col("all_s")) + BUCKETS) / ((number(F.col("s")) + 1) * (number(F.col("all_t")) + BUCKETS))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


_WEIGHTS = T.StructType([T.StructField(c, T.LongType()) for c in ("chunk", "place", "doc_id", "n_words", "n_features", "weight")])


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (chunk, bucket): sums of the contributions, by document."""
    chunk, about, sums = None, None, None

    def close() -> pa.RecordBatch:
        ids, n_words, n_features = about
        columns = [[chunk] * len(ids), range(len(ids)), ids, n_words, n_features, sums.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=_WEIGHTS.names)

    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 12):
            for k, _, gain, n, data, *docs in zip(*(c.to_pylist() for c in batch.slice(at, 1 << 12).columns)):
                if k != chunk:
                    if chunk is not None:
                        yield close()
                    chunk, about, sums = k, docs, np.zeros(len(docs[0]), dtype=np.int64)
                if n:
                    doc, counts = _unpacked(data, n)
                    sums[doc] += gain * counts
    if chunk is not None:
        yield close()


def weights(stored: DataFrame, gain: DataFrame) -> DataFrame:
    """(chunk, place, doc_id, n_words, n_features, weight) of every document of stored postings. They are dealt by bucket, which the salt splits
    where a bucket has rows of many chunks, to meet the bucket's gain; contributions are dealt by chunk."""
    chunks = stored.where("bucket = -1").count()
    salts = max(1, -(-chunks // GROUP_ROWS))
    each = gain.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    by_bucket = stored.where("bucket >= 0").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))
    docs = ["doc_ids", "words", "features"]
    said = by_bucket.join(each, ["bucket", "salt"]).select("chunk", "bucket", "gain", "postings", "data", *docs)
    heads = stored.where("bucket = -1").select("chunk", "bucket", F.lit(0).cast("long").alias("gain"), "postings", "data", *docs)
    common.bound_batches(stored.sparkSession)
    return said.unionByName(heads).repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(_weigh, _WEIGHTS)


def noise(doc_id: Column, seed: int = 42) -> Column:
    """The draw's Gumbel number in thousandths, of the seed and the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resample(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of df, all long. weight: the sum of the gains of the document's features, whose
    buckets' counts are of all of df and of all of target's texts; score: weight and noise; rank: from 1, of the floor(percent * N / 100) best
    of the N documents with least_words and more, ties to the smaller doc_id; null for the others.

    Null and empty texts have no words, and weight 0. A null doc_id draws its noise as an empty id would, and comes after others in a tie. Repeated
    rows count each, weigh alike and are drawn each. Texts of any length are counted whole, some words at a time. Empty tables: no rows of df
    give none; an empty target leaves all counts of it at 0. Other columns aren't read. A drawn document's rank comes of one
    sort of all scores by range, so that no task holds more than its share."""
    spark = df.sparkSession
    stored = common.materialise(spark, postings(df, df[doc_id], df[text]), "resample-postings")
    totals = bucket_totals(stored, "s")
    wanted = bucket_totals(postings(target, F.lit(None), target[text]), "t")
    gain = common.materialise(spark, gains(totals, wanted), "resample-gains")
    scored = weights(stored, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = common.materialise(spark, scored, "resample-scored")
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("chunk"), F.asc("place")]
    placed = scored.where(fit).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed = common.materialise(spark, placed, "resample-sorted")
    before, heads = 0, []
    for r in placed.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        heads.append((r["part"], before))
        before += r["count"]
    offsets = F.broadcast(spark.createDataFrame(heads, "part int, before long"))
    nth = F.col("before") + F.col("at") + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.join(offsets, "part").select(*columns, F.when(nth <= drawn, nth).alias("rank"))
    return ranked.unionByName(scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))
