"""Near-duplicates by SetSketch: registers of exponentially spaced, truncated minima.

A register keeps, on a logarithmic scale of base BASE and cut to 16 bits, the least of the exponential numbers that a hash gives the
set's elements. Registers of a union are the larger ones (merged), and two sets' registers agree the oftener the more alike the sets
are. Texts with a band of equal registers are candidates; how many of two texts' registers are larger, smaller and equal gives the
likelihood of each similarity, by which hopeless candidates go; the others are verified, on parities first and then on the whole sets.

Equal sets are one node. Nodes of a band are first paired with one of them, the star's centre, which links families in as many pairs as
they have members. Then bands whose nodes are of several components are searched for pairs across these, in tiles of bounded size. A
family's members may be as many pairs that are nearly similar enough; what a tile gives is a pair for any two of its groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, simhash

#: Words of a shingle; the least Jaccard similarity of linked texts, in hundredths.
SHINGLE, LEAST = 4, 80
#: Rate and base of the registers; base 1.001 tells minima apart that differ by a thousandth.
RATE, BASE, TOP = 20, 1.001, (1 << 16) - 1
#: Bands and registers of each. Sets of similarity s share a band with 1 - (1 - s**6)**48, which at 0.8 leaves 5 in 10 million pairs out.
BANDS, ROWS = 48, 6
SIZE = BANDS * ROWS
#: Orders by which bands choose their centres.
CENTRES = 4
#: Nodes of a tile.
TILE = 500
#: Twice the log-likelihood ratio by which an estimate below LEAST must be likelier than LEAST to drop a pair: five standard errors.
DOUBT = 25.0
#: Bits of parity for each element, and of any set. A pair that is just not similar enough mostly has too many bits that differ.
PARITY, LEAST_BITS = 8, 1 << 10
#: Similarities by parity from which a pair is taken to link, so that one such pair of two groups of a tile is enough; the next value is tried
#: where one of them doesn't link, the last one asks for every pair that parities leave.
LEVELS = (0.82, 2.0)

_FACTORS = np.random.default_rng(13).integers(0, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(codes: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes; of an empty one zeros."""
    if not len(codes):
        return np.zeros(SIZE, dtype="<u2")
    least = np.full(SIZE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(codes), 512):
        np.minimum(least, (codes[at : at + 512, None] * _FACTORS).min(axis=0), out=least)
    exponential = -np.log1p(-np.minimum((least + 0.5) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, TOP).astype("<u2")


def merged(*of: np.ndarray) -> np.ndarray:
    """The registers of the union of sets."""
    return np.maximum.reduce(of)


def likelihood(similarity: np.ndarray, larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-likelihood of a Jaccard similarity of sets of n and m elements, of whose registers so many are larger, smaller and equal,
    and its derivative."""
    share, other = n / (n + m), m / (n + m)
    step, scale = (BASE - 1) / BASE, math.log(BASE)

    def chance(x):
        x = np.maximum(x, 1e-12)
        return -np.log1p(-x * step) / scale, step / (scale * (1 - x * step))

    up, up_slope = chance(share - other * similarity)
    down, down_slope = chance(other - share * similarity)
    same = np.maximum(1 - up - down, 1e-12)
    value = larger * np.log(up) + smaller * np.log(down) + equal * np.log(same)
    slope = -larger * other * up_slope / up - smaller * share * down_slope / down + equal * (other * up_slope + share * down_slope) / same
    return value, slope


def estimate(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, possible): the likeliest similarity, by halving where the slope changes sign (the likelihood is concave), and whether LEAST
    can't be ruled out."""
    n, m = np.asarray(n, dtype=float), np.asarray(m, dtype=float)
    top = np.minimum(n, m) / np.maximum(n, m)
    low, high = np.zeros_like(top), top.copy()
    for _ in range(14):
        middle = (low + high) / 2
        rising = likelihood(middle, larger, smaller, equal, n, m)[1] > 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    likeliest, asked = (low + high) / 2, np.minimum(LEAST / 100, top)
    gain = likelihood(likeliest, larger, smaller, equal, n, m)[0] - likelihood(asked, larger, smaller, equal, n, m)[0]
    fits = 100 * np.minimum(n, m) >= LEAST * np.maximum(n, m)
    return likeliest, fits & ((likeliest >= asked) | (2 * gain <= DOUBT))


def alike(a: int, b: int, both: int) -> bool:
    """Whether sets of a and b elements with `both` in common reach LEAST."""
    return 100 * both >= LEAST * (a + b - both)


def parities(codes: np.ndarray) -> bytes:
    """For each of a power of two of bits, PARITY an element at least, whether an odd number of elements falls on it."""
    bits = max(LEAST_BITS, 1 << (PARITY * len(codes)).bit_length())
    odd = np.bincount((codes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """Parities of the members of a tile, by their lengths."""

    def __init__(self, of: list[bytes]):
        self.width = np.array([len(x) for x in of])
        self.place = np.zeros(len(of), dtype=np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.rows[w] = np.frombuffer(b"".join(of[k] for k in at.tolist()), dtype="<u8").reshape(len(at), -1)

    def _folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        """As they are with fewer bits."""
        while rows.shape[1] * 8 > width:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        return rows

    def apart(self, k: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits that differ between member k and others, and bits that are compared."""
        count, bits = np.zeros(len(other), dtype=np.int64), np.zeros(len(other), dtype=np.int64)
        own, mine = int(self.width[k]), self.rows[int(self.width[k])][self.place[k]][None, :]
        for w in np.unique(self.width[other]).tolist():
            at, least = np.flatnonzero(self.width[other] == w), min(w, own)
            theirs = self._folded(self.rows[w][self.place[other[at]]], least)
            count[at] = np.bitwise_count(theirs ^ self._folded(mine, least)).sum(axis=1)
            bits[at] = 8 * least
        return count, bits


def by_parity(apart: np.ndarray, bits: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, possible) of pairs of so many elements in all: what the bits that differ let expect, and whether LEAST can be reached: each such bit
    takes an element that only one of the two has."""
    differ = -bits / 2 * np.log1p(-2 * np.minimum(apart, 0.49 * bits) / bits)
    return np.maximum(0.0, (total - differ) / (total + differ)), (100 + LEAST) * apart <= (100 - LEAST) * total


_NODE = [("code", T.BinaryType()), ("size", T.LongType()), ("registers", T.BinaryType()), ("parity", T.BinaryType())]


def sketches(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rows (with text) and code (a digest of the set; null of an empty one), size, registers and parity."""

    def make():
        def work(columns):
            out: list[list] = [[] for _ in _NODE]
            for text in columns[0]:
                codes = np.unique(simhash.shingles(text, shingle))
                some = (xxhash.xxh3_128_digest(codes.tobytes()), len(codes), registers(codes).tobytes(), parities(codes)) if len(codes) else (None, 0, None, None)
                for x, y in zip(out, some):
                    x.append(y)
            return out

        return work

    return common.map_rows(rows, ["text"], _NODE, make)


def _both(pairs: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    """(a, b, x, y): pairs with the rows of their two nodes, as structures. Few pairs are broadcast; of more, a node of many is dealt over tasks.
    The two rows of a pair meet by the pair, so that no node's do."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    row = F.struct(*(c for c in right.columns if c != "node"))
    if few:
        met = right.join(F.broadcast(ends), "node")
    else:
        met = common.salted_join(ends, right, "node", "times", "inner", ends.groupBy("node").agg(F.count("*").alias("times")))
    side = lambda x: F.first(F.when(F.col("node") == F.col(x), row), ignorenulls=True)
    return met.groupBy("a", "b").agg(side("a").alias("x"), side("b").alias("y"))


def _compared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of registers that are larger, smaller and equal in a."""
    larger, equal = (a > b).sum(axis=-1), (a == b).sum(axis=-1)
    return larger, SIZE - larger - equal, equal


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored pairs (a, b) that their registers don't rule out."""
    both = _both(pairs, nodes.select("node", "size", "registers"), pairs.count() <= simhash.SMALL)
    flat = both.select("a", "b", F.col("x.size").alias("n"), F.col("y.size").alias("m"), F.col("x.registers").alias("p"), F.col("y.registers").alias("q"))

    def make():
        def work(columns):
            n, m = (np.array(c, dtype=float) for c in columns[:2])
            if not len(n):
                return [[]]
            a, b = (np.frombuffer(b"".join(c), dtype="<u2").reshape(-1, SIZE) for c in columns[2:])
            return [estimate(*_compared(a, b), n, m)[1].tolist()]

        return work

    return common.map_rows(flat, ["n", "m", "p", "q"], [("likely", T.BooleanType())], make).where("likely").select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """Stored pairs (a, b) with `link`: whether the whole sets reach LEAST. Sets are made again from the texts, of the nodes in pairs only."""
    few = pairs.count() <= simhash.SMALL // 2
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    places = nodes.select("node", "doc_id", "place")
    asked = F.broadcast(places.join(F.broadcast(named), "node")) if few else places.join(named, "node")
    texts = rows.join(asked, ["doc_id", "place"]).select("node", "text")
    codes = common.map_rows(texts, ["text"], [("codes", T.BinaryType())], lambda: lambda columns: [[np.unique(simhash.shingles(t, shingle)).tobytes() for t in columns[0]]])
    sets = codes.groupBy("node").agg(F.first("codes").alias("codes"))
    if not few:
        sets = common.materialise(pairs.sparkSession, sets, "setsketch-sets")
    flat = _both(pairs, sets, few).select("a", "b", F.col("x.codes").alias("p"), F.col("y.codes").alias("q"))

    def make():
        def work(columns):
            out = []
            for x, y in zip(*columns):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                out.append(alike(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            return [out]

        return work

    found = common.map_rows(flat, ["p", "q"], [("link", T.BooleanType())], make)
    return common.materialise(pairs.sparkSession, found.drop("p", "q"), "setsketch-links")


_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("sure", T.BooleanType())])


def tile_pairs(band: int, whole: bool, side: np.ndarray, component: np.ndarray, size: np.ndarray, matrix: np.ndarray, parity: Parities, level: float) -> Iterator[tuple[int, int, bool]]:
    """Pairs of places in a tile (of all of it, or across its sides) that are of different components, have this band as the first that they
    share, and may be LEAST alike by their registers and by parity. Of pairs that reach `level` by parity, one for each two groups, the
    likest first; of the others all between different groups."""
    found: list[tuple[float, int, int]] = []
    order = np.arange(len(side))
    for k in range(len(side)):
        other = order[k + 1 :] if whole else order[side == 1] if side[k] == 0 else order[:0]
        fit = (component[other] != component[k]) & (100 * np.minimum(size[other], size[k]) >= LEAST * np.maximum(size[other], size[k]))
        other = other[fit]
        if not len(other):
            continue
        equal = matrix[other] == matrix[k]
        first = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        other, equal = other[first], equal[first].sum(axis=1)
        if not len(other):
            continue
        larger = (matrix[k] > matrix[other]).sum(axis=1)
        possible = estimate(larger, SIZE - larger - equal, equal, np.full(len(other), size[k]), size[other])[1]
        other = other[possible]
        value, possible = by_parity(*parity.apart(k, other), size[k] + size[other])
        found.extend((-v, k, j) for v, j in zip(value[possible].tolist(), other[possible].tolist()))
    names = np.unique(component, return_inverse=True)[1].tolist()
    groups = simhash.Groups(len(names))
    for value, k, j in sorted(found):
        x, y = names[k], names[j]
        if groups.find(x) != groups.find(y):
            sure = -value >= level
            if sure:
                groups.unite(x, y)
            yield k, j, sure


def _across(level: float):
    """Over (key, kind, x, y, band, side, node, component, size, registers, parity) sorted by the first four."""

    def tile(rows: list[tuple]) -> Iterator[tuple]:
        (_, kind, x, y, band, *_), n = rows[0], len(rows)
        side, node, component, size, raw, parity = zip(*(r[5:] for r in rows))
        matrix = np.frombuffer(b"".join(raw), dtype="<u2").reshape(n, SIZE)
        for k, j, sure in tile_pairs(band, kind == 0 or kind == 1 and x == y, np.array(side), np.array(component), np.array(size), matrix, Parities(parity), level):
            yield min(node[k], node[j]), max(node[k], node[j]), sure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held(None, lambda: None)
        out: list[tuple] = []
        held: list[tuple] = []

        def table() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[], [], []]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()))], names=_PAIR.names)
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:4] != row[:4]:
                    out.extend(tile(held) if len(held) > 1 else ())
                    held = []
                    if len(out) >= 1 << 14:
                        yield table()
                held.append(row)
        out.extend(tile(held) if len(held) > 1 else ())
        yield table()

    return run


def _tiles(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of bands that hold several components, dealt over tiles so that any two of different components meet once. Of a large band the
    rows of its largest component, which needn't meet one another, go to a column of tiles of their own; the others to tiles that meet
    these and one another."""
    spark = known.sparkSession
    counts = known.groupBy("key", "component").agg(F.count("*").alias("n"))
    per = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("parts")).where("parts > 1")
    per = common.materialise(spark, per.select("key", "largest", "total", F.ceil(F.col("most") / TILE).cast("int").alias("big"), F.ceil((F.col("total") - F.col("most")) / TILE).cast("int").alias("rest")), "setsketch-bands")
    few = per.count() <= simhash.SMALL
    rows = known.join(F.broadcast(per), "key") if few else common.salted_join(known, per, "key", "total", "inner", per.select("key", "total"))
    small, own = F.col("total") <= TILE, F.col("component") == F.col("largest")
    tile = F.pmod(F.xxhash64("node"), F.when(own, F.col("big")).otherwise(F.col("rest"))).cast("int")
    spot = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))
    zero, one = F.lit(0), F.lit(1)
    of_rest = F.transform(F.sequence(zero, F.col("rest") - 1), lambda t: spot(1, F.least(t, F.col("tile")), F.greatest(t, F.col("tile")), (F.col("tile") > t).cast("int")))
    to_big = F.transform(F.sequence(zero, F.col("big") - 1), lambda t: spot(2, F.col("tile"), t, zero))
    of_big = F.transform(F.sequence(zero, F.col("rest") - 1), lambda t: spot(2, t, F.col("tile"), one))
    spots = F.when(small, F.array(spot(0, zero, zero, zero))).when(own, of_big).otherwise(F.concat(of_rest, to_big))
    dealt = rows.withColumn("tile", tile).select("key", "band", "node", "component", F.explode(spots).alias("s"))
    held = dealt.join(nodes.select("node", "size", "registers", "parity"), "node")
    return held.select("key", "s.kind", "s.x", "s.y", "band", "s.side", "node", "component", "size", "registers", "parity")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of df: documents whose sets of shingles have a Jaccard similarity of LEAST and more
    are linked, component_id is the smallest doc_id that links reach, kept says that it is the row's own.

    Null, empty and blank texts have no shingles and are linked with nothing, each its own component. Rows with a null doc_id are linked with
    nothing either, and have null for the last two columns. Repeated rows are returned as often as they come; rows that share a doc_id but not
    the text are linked each by its own text. Texts are read whole; an empty table gives no rows; other columns aren't read. No link
    is wrong; of pairs at just LEAST 5 in 10 million share no band."""
    spark = df.sparkSession
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).withColumn("place", F.xxhash64("text"))
    made = common.materialise(spark, sketches(rows, shingle).drop("text"), "setsketch-docs")
    mine = made.where("code IS NOT NULL AND doc_id IS NOT NULL")
    one = F.min(F.struct("doc_id", "place")).alias("r")
    nodes = mine.groupBy("code").agg(one, F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("size", "registers", "parity")))
    nodes = common.materialise(spark, nodes.select(F.monotonically_increasing_id().alias("node"), "code", "r.doc_id", "r.place", "copies", "size", "registers", "parity"), "setsketch-nodes")
    rows = rows.where("doc_id IS NOT NULL")
    wide = 2 * ROWS
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("registers", k * wide + 1, wide)) for k in range(BANDS)))
    entries = nodes.select("node", F.posexplode(keys).alias("band", "key"))
    centre = F.min_by("node", F.xxhash64("node", F.col("band") % CENTRES)).alias("centre")
    bands = common.materialise(spark, entries.groupBy("key").agg(F.count("*").alias("times"), centre).where("times > 1"), "setsketch-bands")
    shared = common.materialise(spark, common.salted_join(entries, bands.select("key", "centre"), "key", "times", "inner", bands.select("key", "times")), "setsketch-shared")
    pair = shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    stars = common.materialise(spark, pair, "setsketch-stars")
    stars = common.materialise(spark, _likely(stars, nodes), "setsketch-likely")
    linked = lambda found: found.where("link").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    links = linked(_verified(stars, nodes, rows, shingle))
    for level in LEVELS:
        roots = simhash.components(spark, links)
        known = shared.select("key", "band", "node").join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
        tiles = _tiles(common.materialise(spark, known, "setsketch-known"), nodes)
        common.bound_batches(spark)
        place = ["key", "kind", "x", "y"]
        pairs = tiles.repartition(*place).sortWithinPartitions(*place).mapInArrow(_across(level), _PAIR)
        pairs = common.materialise(spark, pairs, "setsketch-pairs")
        if pairs.isEmpty():
            break
        found = _verified(pairs.select("a", "b"), nodes, rows, shingle)
        links = links.unionByName(linked(found))
        wrong = found.where("NOT link").join(pairs.where("sure"), ["a", "b"], "left_semi")
        if wrong.isEmpty():
            roots = simhash.components(spark, links)
            break
    ends = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    least = ends.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"))
    least = common.materialise(spark, least, "setsketch-least")
    led = common.salted_join(roots, least.select(F.col("root"), "least"), "root", "times", "inner", least.select("root", "times")).select("node", "least")
    led = led.unionByName(least.select(F.col("root").alias("node"), "least"))
    classes = nodes.join(led, "node", "left").select("code", F.coalesce("least", "doc_id").alias("component_id"), "copies")
    classes = common.materialise(spark, classes, "setsketch-classes")
    grouped = common.salted_join(mine.select("doc_id", "code", "size"), classes, "code", "copies", "inner").select("doc_id", "size", "component_id")
    alone = made.where("code IS NULL OR doc_id IS NULL").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).select("doc_id", F.col("size").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
