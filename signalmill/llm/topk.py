"""Exact top-k search by inner product: tiled matrix products of queries and shards, selection in each tile, tree merging."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Cells (rows x components) of a tile of candidates and of a block of queries; rows of either; tiles that a task holds at once.
TILE_CELLS, BLOCK_CELLS, MOST_TILE, MOST_BLOCK, SHARD_TILES = 1 << 19, 1 << 18, 4096, 2048, 16
#: Lists merged at once.
FAN_IN = 32
_LONG = 2**63 - 1


def quantised(x: float) -> int:
    """floor(256 * x) of a finite x, also where 256 * x is beyond a double."""
    return 256 * int(x) if abs(x) >= 2**53 else math.floor(256 * x)


def products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Exact integer products of quantised vectors, as int64; beyond its range the nearest of its values (but for its smallest
    one). Vectors whose products may pass 53 bits are multiplied as integers of any size."""
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = np.floor(256.0 * queries), np.floor(256.0 * tile)
    most = math.isqrt(2**53 // max(1, queries.shape[1]))
    small = [np.abs(x).max(axis=1, initial=0.0) < most for x in (a, b)]
    a[~small[0]], b[~small[1]] = 0, 0
    out = (a @ b.T).astype(np.int64)
    whole = lambda x: list(map(quantised, x.tolist()))
    if not (small[0].all() and small[1].all()):
        left, right = [None] * len(queries), [None] * len(tile)
        for i, j in zip(*np.nonzero(~(small[0][:, None] & small[1][None, :]))):
            left[i], right[j] = left[i] or whole(queries[i]), right[j] or whole(tile[j])
            out[i, j] = max(-_LONG, min(_LONG, sum(map(int.__mul__, left[i], right[j]))))
    return out


def best(query_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k highest scores, ties to smaller ids, of all but its own id: (scores, ids, taken). ids: ascending, or
    a row for each query."""
    own = ids[None, :] == query_ids[:, None] if ids.ndim == 1 else ids == query_ids[:, None]
    n = scores.shape[1]
    if ids.ndim == 1 and n > 4 * k and n <= MOST_TILE and np.abs(scores).max(initial=0) < 1 << 50:
        keys = scores * MOST_TILE + (MOST_TILE - 1 - np.arange(n))
        keys[own] = -_LONG
        part = np.argpartition(keys, n - k, axis=1)[:, n - k :]
        order = np.take_along_axis(part, np.argsort(-np.take_along_axis(keys, part, 1), axis=1), 1)
    else:
        wide = np.broadcast_to(ids, scores.shape)
        order = np.lexsort((wide, -scores, own))[:, :k]
    take = lambda x: np.take_along_axis(np.broadcast_to(x, scores.shape), order, 1)
    return take(scores), take(ids), ~take(own)


def _pack(table: pa.Table) -> pa.Table:
    """One row of a group's vectors, by ascending id."""
    ids = table.column("vec_id").to_numpy()
    dim = table.column("dim")[0].as_py()
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    head = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("dim", "part")]
    return pa.table([*head, pa.array([ids[order].astype("<i8").tobytes()]), pa.array([flat.reshape(len(ids), dim)[order].astype("<f8").tobytes()])], names=["dim", "part", "ids", "data"])


_PACKED = "dim int, part int, ids binary, data binary"
_LIST = T.ArrayType(T.StructType([T.StructField("neg", T.LongType()), T.StructField("vec_id", T.LongType())]))
_LISTS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("top", _LIST)])


def _searcher(k: int):
    """Over (dim, shard, block, ids, data) sorted by the first three: a shard's tiles, block -1, come first and are held; each
    block of queries that follows is multiplied with all of them."""
    kind = pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tiles = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                dim, shard, block = (batch.column(c)[r].as_py() for c in ("dim", "shard", "block"))
                ids = np.frombuffer(batch.column("ids")[r].as_py(), dtype="<i8")
                vectors = np.frombuffer(batch.column("data")[r].as_py(), dtype="<f8").reshape(len(ids), dim)
                if key != (dim, shard):
                    key, tiles = (dim, shard), []
                if block < 0:
                    tiles.append((ids, vectors))
                    continue
                held = None
                for own, tile in tiles:
                    new = best(ids, products(vectors, tile), own, k)
                    if held is not None:
                        s, f, t = (np.concatenate(x, axis=1) for x in zip(held, new))
                        order = np.lexsort((f, -s, ~t))[:, :k]
                        new = tuple(np.take_along_axis(x, order, 1) for x in (s, f, t))
                    held = new
                if held is not None:
                    rows = [[{"neg": -s, "vec_id": v} for s, v, t in zip(a, b, c) if t] for a, b, c in zip(*(x.tolist() for x in held))]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([shard] * len(ids), pa.int32()), pa.array(rows, kind)], names=["query_id", "part", "top"])

    return run


def _valid(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def search(df: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of df that `queries` picks, the k highest integer products of
    its vector, each component x made floor(256 * x), with the vectors of all rows of another vec_id; ties go to the smaller vec_id;
    fewer rows if there are fewer candidates.

    Rows with a null id take no part, nor do null vectors and such with a null or non-finite component; an empty table gives
    an empty one. Only vectors of equal length meet, those without components with a score of 0. Repeated rows are as many
    candidates; of queries with one vec_id and length the first vector in order of components is searched. Products beyond 64 bits
    count as the nearest 64-bit value. Vectors are of any length of which some thousand fit a task; other columns aren't read.

    Candidates are dealt by their place in the table into tiles of bounded size, however often an id repeats, and SHARD_TILES tiles make a shard;
    queries are dealt into blocks. A shard's tiles go to one task, once; each block of queries is sent to each shard, meets the tiles in
    one matrix product each, and its lists over these tiles are merged there; the rest is merged over groups of FAN_IN lists.
    """
    spark = df.sparkSession
    common.ship(spark)
    common.bound_batches(spark)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & _valid(F.col("vector"))).withColumn("dim", F.size("vector"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max("dim").alias("dim")).first()
    dim = max(1, size["dim"] or 1)
    tiles = -(-size["n"] // max(64, min(MOST_TILE // 2, TILE_CELLS // dim))) or 1
    blocks = -(-size["q"] // max(16, min(MOST_BLOCK // 2, BLOCK_CELLS // dim))) or 1
    shards = -(-tiles // SHARD_TILES)
    place = F.pmod(F.monotonically_increasing_id(), F.lit(tiles)).cast("int")
    packed = rows.select("vec_id", "vector", "dim", place.alias("part")).groupBy("dim", "part").applyInArrow(_pack, _PACKED)
    once = rows.where("asks").groupBy("vec_id", "dim").agg(F.min("vector").alias("vector"))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asked = once.select("vec_id", "vector", "dim", block.alias("part")).groupBy("dim", "part").applyInArrow(_pack, _PACKED)
    sent = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("part").alias("block"), "ids", "data")
    held = packed.select("dim", F.expr(f"CAST(part DIV {SHARD_TILES} AS INT)").alias("shard"), F.lit(-1).alias("block"), "ids", "data")
    dealt = held.unionByName(sent).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "block")
    lists = dealt.mapInArrow(_searcher(k), _LISTS)
    width = shards
    while True:
        width = -(-width // FAN_IN)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        lists = lists.groupBy("query_id", F.expr(f"CAST(part DIV {FAN_IN} AS INT)").alias("part")).agg(merged.alias("top"))
        if width == 1:
            break
    return lists.select("query_id", F.posexplode("top").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.neg")).alias("score"))
