"""SimHash near-duplicates, with BK-trees over shards of fingerprints.

Each shard is a BK-tree (children keyed by their Hamming distance to the parent), searched along edges within the
radius. A shard's tree is built where the shuffle brings the shard, not broadcast: that would take all fingerprints through
the driver. Two ways to deal fingerprints into shards:

- near_duplicates (a radius of few bits, exact): two fingerprints that differ in at most r of 64 bits agree on all but r of
  any b blocks of their bits. For each choice of b - r blocks, fingerprints with equal bits there form a shard; every link
  lies within a shard.
- near_copies (texts of a similarity, some ten bits apart): blocks that all such pairs share would be too short, so
  texts with a band of equal shingle minima form a shard. What its tree finds is held against the texts' whole
  sets of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS = 64
_ALL = (1 << BITS) - 1


def shingles(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """Hashes of the runs of `size` words joined by single spaces, repeats included (with fewer words: of the whole
    sequence; without any: none). A-Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    runs = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) > size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), dtype="<u8")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The bits that are set in over half of the shingles' hashes. No words: 0."""
    return majority(shingles(text, shingle, seed))


def majority(hashes: np.ndarray) -> int:
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


class BKTree:
    """Integers under Hamming distance. Entries can be taken out; emptied subtrees are skipped."""

    def __init__(self):
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        self.alive: list[int] = []
        self.present: list[bool] = []

    def add(self, value: int) -> int:
        at, new, up = 0, len(self.value), -1
        if new:
            while True:
                self.alive[at] += 1
                d = (self.value[at] ^ value).bit_count()
                up = at
                at = self.children[up].get(d, -1)
                if at < 0:
                    self.children[up][d] = new
                    break
        self.value.append(value)
        self.children.append({})
        self.parent.append(up)
        self.alive.append(1)
        self.present.append(True)
        return new

    def remove(self, node: int) -> None:
        self.present[node] = False
        while node >= 0:
            self.alive[node] -= 1
            node = self.parent[node]

    def within(self, value: int, radius: int) -> list[int]:
        out, stack = [], [0] if self.value else []
        while stack:
            at = stack.pop()
            if not self.alive[at]:
                continue
            d = (self.value[at] ^ value).bit_count()
            if d <= radius and self.present[at]:
                out.append(at)
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                stack.extend(c for k, c in children.items() if d - radius <= k <= d + radius)
            else:
                stack.extend(children[k] for k in range(d - radius, d + radius + 1) if k in children)
        return out


def shard_groups(values: list[int], radius: int) -> list[list[int]]:
    """Connected groups (of two and more) among distinct values. An entry leaves the tree when it is
    reached, so that dense shards take few visits."""
    tree = BKTree()
    for v in values:
        tree.add(v)
    out = []
    for start in range(len(values)):
        if not tree.present[start]:
            continue
        tree.remove(start)
        group = [start]
        for member in group:  # grows meanwhile
            for found in tree.within(values[member], radius):
                tree.remove(found)
                group.append(found)
        if len(group) > 1:
            out.append(group)
    return out


def block_masks(blocks: int, radius: int) -> list[int]:
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


#: Links up to which one task unites them, and rows of the smaller side up to which a join is a broadcast.
SMALL = 200_000


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


#: A shard with more distinct fingerprints is dealt again by FINE_BLOCKS blocks: 8 choose 6 shards fix 48 bits,
#: so that none can hold over 2**16 distinct fingerprints.
SHARD_LIMIT, FINE_BLOCKS = 20_000, 8


def _scan(radius: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by shard: a star of links for each group (hot false), or the members of a
    shard above the limit (hot true)."""
    names = ["node", "root", "fp", "hot"]

    def close(nodes: list, fps: list) -> tuple[list, list]:
        out_n, out_r = [], []
        for group in shard_groups([x & _ALL for x in fps], radius):
            ids = [nodes[k] for k in group]
            root = min(ids)
            out_n.extend(x for x in ids if x != root)
            out_r.extend(root for x in ids if x != root)
        return out_n, out_r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, fps, hot = None, [], [], False

        def flush(links: list, roots: list) -> None:
            if not hot and len(nodes) > 1:
                a, b = close(nodes, fps)
                links.extend(a)
                roots.extend(b)

        def as_batch(links, roots, values, is_hot):
            n = len(links)
            return pa.RecordBatch.from_arrays([pa.array(links, pa.int64()), pa.array(roots, pa.int64()), pa.array(values, pa.int64()), pa.array([is_hot] * n, pa.bool_())], names=names)

        for batch in batches:
            combo, masked = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("combo", "masked"))
            node, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("node", "fp"))
            n = len(node)
            if not n:
                continue
            starts = np.flatnonzero(np.r_[True, (combo[1:] != combo[:-1]) | (masked[1:] != masked[:-1])])
            ends = np.r_[starts[1:], n]
            links, roots = [], []
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                this = (int(combo[a]), int(masked[a]))
                if this != key:
                    flush(links, roots)
                    if b - a == 1 and k < len(starts) - 1:
                        key, nodes, fps, hot = this, [], [], False
                        continue
                    key, nodes, fps, hot = this, [], [], False
                nodes.extend(node[a:b].tolist())
                fps.extend(fp[a:b].tolist())
                if hot or len(nodes) > limit:
                    hot = True
                    yield as_batch(nodes, nodes, fps, True)
                    nodes, fps = [], []
            if links:
                yield as_batch(links, roots, [0] * len(links), False)
        links, roots = [], []
        flush(links, roots)
        yield as_batch(links, roots, [0] * len(links), False)

    return run


_LINKS = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("hot", T.BooleanType())])


def _shard_links(spark: SparkSession, fps: DataFrame, blocks: int, radius: int, limit: int) -> DataFrame:
    masks = block_masks(blocks, radius)
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("masked")) for k, m in enumerate(masks))))
    keyed = fps.select("node", "fp", keys.alias("key")).select("node", "fp", "key.combo", "key.masked")
    dealt = keyed.repartition("combo", "masked").sortWithinPartitions("combo", "masked")
    return common.materialise(spark, dealt.mapInArrow(_scan(radius, limit), _LINKS), "simhash-links")


def _turn(star: DataFrame) -> DataFrame:
    both = star.union(star.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(small, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small).distinct()


def connected(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root): each linked node but the smallest of its component, with that smallest one. By
    turns of large and small stars, each written to the shared folder, until a turn changes nothing; a turn is joins
    and sums on the links alone."""
    star = common.materialise(spark, links.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u > v").distinct(), "star")
    before = None
    while True:
        sign = star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == before or not sign["n"]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, star = sign, common.materialise(spark, _turn(_turn(star)), "star")


class Groups:
    """Disjoint sets of numbers below n."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def unite(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


_STAR = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over all of a bounded number of links (node, root): each linked node but its component's smallest, with that one."""
    names: dict[int, int] = {}
    pairs = [(x, y) for batch in batches for x, y in zip(*(c.to_pylist() for c in batch.columns))]
    for x in sorted({n for p in pairs for n in p}):
        names[x] = len(names)
    groups, of = Groups(len(names)), list(names)
    for x, y in pairs:
        groups.unite(names[x], names[y])
    rows = [(of[k], of[groups.find(k)]) for k in range(len(of))]
    rows = [r for r in rows if r[0] != r[1]]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=_STAR.names)


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) of stored links: as connected(), which takes turns of joins; up to SMALL links are united in one task at once."""
    if links.count() > SMALL:
        return connected(spark, links)
    return common.materialise(spark, links.select("node", "root").coalesce(1).mapInArrow(_united, _STAR), "roots")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null texts have no words."""
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    return common.map_rows(rows, ["text"], [("fp", T.LongType())], lambda: lambda columns: [[_signed(fingerprint(t, shingle)) for t in columns[0]]]).select("doc_id", "fp")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of df: fingerprints of at most `radius`
    differing bits are linked, component_id is the smallest doc_id that links reach.

    Null and blank texts have fingerprint zero and are linked like any other. Rows with a null
    doc_id link nothing and have a null component_id. Repeated rows are returned as often as they come, rows that share a
    doc_id but not the text are linked each by its own text. Texts are read whole, an empty table gives an empty one.
    Other columns are not read. Copies are brought together before any search, so that a group of
    copies of any size is one entry; dense shards are dealt again by shorter blocks. Where documents get their class,
    those of a large group of copies are dealt over several tasks.
    """
    spark = df.sparkSession
    docs = common.materialise(spark, fingerprints(df, doc_id, text, shingle), "simhash-docs")
    fps = common.materialise(spark, docs.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "simhash-fps")
    known = fps.where("node IS NOT NULL").select("fp", "node")
    distinct = known.count()
    # The fewest shards a fingerprint that keep chance company in a shard rare; all choices are exact.
    blocks = next(b for b, most in ((radius + 1, 1 << 22), (radius + 2, 1 << 34), (radius + 3, 1 << 63)) if distinct < most)
    found = _shard_links(spark, known, blocks, radius, SHARD_LIMIT)
    links = found.where("NOT hot").select("node", "root")
    hot = found.where("hot").select("node", "fp").distinct()
    if not hot.isEmpty():
        links = links.union(_shard_links(spark, hot, FINE_BLOCKS, radius, 1 << (BITS * radius // FINE_BLOCKS)).select("node", "root"))
    roots = components(spark, links)
    classes = fps.join(roots, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("component_id"))
    joined = common.salted_join(docs, classes, "fp", "n")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# --- texts of a similarity ---

#: Words of a shingle, and the least Jaccard similarity of two texts' sets of them, as numerator and denominator.
SHINGLE, LEAST = 5, (4, 5)
#: Bits within which a shard's tree is searched: for the first links, and for all. Of 63,000 pairs of check_h that are 0.8 and more alike, none is
#: over 19 bits apart; sets of that similarity are 10 bits apart on average with a deviation of 3, small ones 12.
CLOSE, RADIUS = 10, 26
#: Shards a text is in, and minima that share one. Two texts of similarity s share one of them with 1 - (1 - s**4)**16, which is 0.9998 at
#: the least similarity.
BANDS, ROWS = 16, 4
#: Texts of a shard that is searched in runs for the first links, and dealt again by rare shingles for the others.
SHARD_TEXTS = 2_000
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(codes: np.ndarray) -> list[int]:
    """A hash for each band: of the minima of as many rehashings of a set."""
    least = np.full(len(_FACTORS), _ALL, dtype=np.uint64)
    for at in range(0, len(codes), 1 << 11):
        least = np.minimum(least, (codes[at : at + (1 << 11), None] * _FACTORS).min(axis=0))
    return [_signed(xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k)) for k in range(BANDS)]


def alike(a: int, b: int, both: int) -> bool:
    """Whether sets of a and b shingles with `both` in common reach LEAST."""
    return LEAST[1] * both >= LEAST[0] * (a + b - both)


def sketch(codes: np.ndarray) -> bytes:
    """For each of a power of two of bits, at least two a shingle, the parity of the shingles that fall on it."""
    bits = max(64, 1 << (2 * len(codes) - 1).bit_length())
    odd = np.bincount((codes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(own: bytes, length: int) -> int:
    """The sketch as it is with fewer bits."""
    value = int.from_bytes(own, "little")
    while (size := len(own)) > length:
        value = (value >> (4 * size)) ^ (value & ((1 << (4 * size)) - 1))
        own = own[: size // 2]
    return value


def may_be_alike(n: int, own: bytes, m: int, other: bytes) -> bool:
    """False only of sets (of n and m shingles) below LEAST: each bit that differs takes a shingle that only one of them has."""
    length = min(len(own), len(other))
    apart = (folded(own, length) ^ folded(other, length)).bit_count()
    return (LEAST[0] + LEAST[1]) * apart <= (LEAST[1] - LEAST[0]) * (n + m)


def _shards(batches: Iterator[pa.RecordBatch], keep: Callable[[list], bool]) -> Iterator[list[tuple]]:
    """Runs of rows of equal first column, which rows are sorted by, of two rows at least; one run's rows are held only as long
    as keep() of them says so: then the rest of the run follows as runs of its own."""
    held: list[tuple] = []
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
        ends = np.r_[starts[1:], len(key)]
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            this = int(key[a])
            if held and held[0][0] != this or held and not keep(held):
                if len(held) > 1:
                    yield held
                held = []
            if b - a == 1 and not held and k < len(starts) - 1:
                continue
            held = [*held, *zip([this] * (b - a), *(c[a:b].tolist() for c in columns))]
    if len(held) > 1:
        yield held


_MEMBER = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "node", "fp", "mate")])
_PAIR = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b")])


def _table(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=schema.names)


def _batched(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 1 << 14:
            yield _table(held, schema)
            held = []
    yield _table(held, schema)


def _members(limit: int):
    """Over (key, node, fp) sorted by key: the rows of shards of two texts and more, each with the member from which it is reached
    first (itself: no other). Members that are near leave the tree when they are reached, so that dense shards take few
    visits; the links that this leaves out are looked for once these are known. A shard is searched in runs of so many rows."""

    def rows(batches):
        common.held(None, lambda: None)
        for shard in _shards(batches, lambda held: len(held) < limit):
            nodes = list({r[1]: r for r in shard}.values())
            tree, mate = BKTree(), [r[1] for r in nodes]
            for r in nodes:
                tree.add(r[2] & _ALL)
            for start in range(len(nodes)):
                if tree.present[start]:
                    tree.remove(start)
                    group = [start]
                    for member in group:  # grows meanwhile
                        for found in tree.within(nodes[member][2] & _ALL, CLOSE):
                            tree.remove(found)
                            mate[found] = nodes[member][1]
                            group.append(found)
            yield from ((key, node, fp, m) for (key, node, fp), m in zip(nodes, mate))

    return lambda batches: _batched(rows(batches), _MEMBER)


def _across(batches):
    """Over (key, size, component, node, fp, n, sketch) sorted by the first three: pairs of different components within the radius
    that sketches leave; each once a task, as far as held. A component's rows are added to the tree when another follows, so that
    the largest, which is the last, is not held."""

    def rows():
        common.held(None, lambda: None)
        key, component, tree, nodes, waiting, seen = None, None, BKTree(), [], [], set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                for k, _, c, node, fp, n, own in zip(*(x.to_pylist() for x in batch.slice(at, 1 << 12).columns)):
                    if k != key:
                        key, component, tree, nodes, waiting = k, c, BKTree(), [], []
                    elif c != component:
                        for row in waiting:
                            tree.add(row[1])
                            nodes.append(row)
                        component, waiting = c, []
                    fp &= _ALL
                    waiting.append((node, fp, n, own))
                    for found in tree.within(fp, RADIUS):
                        other, _, m, their = nodes[found]
                        pair = (min(node, other), max(node, other))
                        if pair not in seen and may_be_alike(n, own, m, their):
                            if len(seen) >= 1 << 16:
                                seen.clear()
                            seen.add(pair)
                            yield pair

    return _batched(rows(), _PAIR)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(node, root) of the pairs that reach LEAST; sets are made again from the texts, of the sets in pairs only."""
    spark = pairs.sparkSession
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = common.materialise(spark, nodes.select("node", "doc_id", "place").join(named, "node"), "simhash-asked")
    texts = rows.join(_small(asked), ["doc_id", "place"]).select("node", "text")
    codes = common.map_rows(texts, ["text"], [("codes", T.BinaryType())], lambda: lambda columns: [[np.unique(shingles(t, shingle)).tobytes() for t in columns[0]]])
    sets = common.materialise(spark, codes.select("node", "codes").groupBy("node").agg(F.first("codes").alias("codes")), "simhash-sets")
    sizes = sets.select("node", F.octet_length("codes").alias("n"))
    fit = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").where(LEAST[1] * F.least("na", "nb") >= LEAST[0] * F.greatest("na", "nb"))
    both = fit.select("a", "b").join(sets.toDF("a", "ca"), "a").join(sets.toDF("b", "cb"), "b")

    def make():
        def work(columns):
            out = []
            for x, y in zip(*columns):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                out.append(alike(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            return [out]

        return work

    found = common.map_rows(both, ["ca", "cb"], [("link", T.BooleanType())], make).where("link")
    return common.materialise(spark, found.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")), "simhash-links")


def _prefixes(spark: SparkSession, large: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(key, node): the texts of shards that are too large to compare all with all, dealt again by their rarest shingles. Sets that reach LEAST
    have that share of each in common; so, of shingles in any one order, those of each set that come first, one more than it can lack,
    hold a common one: no link is lost. The rarer come first, so that what is common to many texts deals few of them."""
    asked = common.materialise(spark, nodes.join(large, "node", "left_semi").select("node", "doc_id", "place"), "simhash-asked")
    texts = rows.join(_small(asked), ["doc_id", "place"]).select("node", "text")
    codes = common.map_rows(texts, ["text"], [("codes", T.ArrayType(T.LongType()))], lambda: lambda columns: [[np.unique(shingles(t, shingle)).view("<i8").tolist() for t in columns[0]]])
    sets = codes.select("node", "codes").groupBy("node").agg(F.first("codes").alias("codes"))
    each = common.materialise(spark, sets.select("node", F.size("codes").alias("size"), F.explode("codes").alias("code")), "simhash-codes")
    counts = each.groupBy("code").agg(F.count("*").alias("n"), F.count("*").alias("rows"))
    counted = common.salted_join(each, common.materialise(spark, counts, "simhash-counts"), "code", "rows")
    ordered = counted.groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "code"))).alias("codes"))
    lacked = F.floor(F.col("size") * (LEAST[1] - LEAST[0]) / LEAST[1]).cast("int")
    first = ordered.select("node", F.explode(F.slice("codes", F.lit(1), lacked + 1)).alias("c"))
    return first.where("c.n > 1").select(F.xxhash64("c.code").alias("key"), "node")


def _mixed(known: DataFrame) -> DataFrame:
    """(key, texts) of the shards of more than one component."""
    return known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("texts")).where("x <> y").select("key", "texts")


def _to_search(spark: SparkSession, known: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """The rows of known of shards of more than one component, where those of over SHARD_TEXTS texts are dealt again by _prefixes."""
    mixed = common.materialise(spark, _mixed(known), "simhash-mixed")
    small = known.join(mixed.where(F.col("texts") <= SHARD_TEXTS), "key", "left_semi")
    large = known.join(mixed.where(F.col("texts") > SHARD_TEXTS), "key", "left_semi").select("node", "size", "component", "fp").distinct()
    if mixed.where(F.col("texts") > SHARD_TEXTS).isEmpty():
        return small
    large = common.materialise(spark, large, "simhash-large")
    again = common.materialise(spark, _prefixes(spark, large, nodes, rows, shingle).join(large, "node").select(*known.columns), "simhash-known")
    return small.unionByName(again.join(_mixed(again), "key", "left_semi"))


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, place, component) for every row with a doc_id: place is the hash of the text, rows whose shingle sets are
    at least LEAST alike, directly or by others, have the same component. Links are looked for in BK-trees of the texts' fingerprints
    and hold only if the whole sets reach LEAST: none is wrong, and over 98 of 100 are found (tests, README).

    Texts without a word are copies of one another. Texts are read whole; an empty table gives an empty one. Copies (equal
    sets) are one entry before any search. A family of near copies of any size is first linked along stars; then, once its
    components are known, only shards of more than one are searched again, for all pairs of different components."""
    spark = df.sparkSession
    rows = df.where(df[doc_id].isNotNull()).select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).withColumn("place", F.xxhash64("text"))

    def make():
        def work(columns):
            out: list[list] = [[] for _ in added]
            for t in columns[0]:
                hashes = shingles(t, shingle)
                codes = np.unique(hashes)
                keys = band_keys(codes) if len(codes) else []
                for x, y in zip(out, (_signed(xxhash.xxh64_intdigest(codes.tobytes(), 7)), _signed(majority(hashes)), keys, len(codes), sketch(codes) if len(codes) else b"")):
                    x.append(y)
            return out

        return work

    longs = T.ArrayType(T.LongType())
    added = [("node", T.LongType()), ("fp", T.LongType()), ("bands", longs), ("size", T.LongType()), ("sketch", T.BinaryType())]
    made = common.materialise(spark, common.map_rows(rows, ["text"], added, make).drop("text"), "simhash-docs")
    first = F.min(F.struct("doc_id", "place", "fp", "bands", "size", "sketch")).alias("r")
    nodes = common.materialise(spark, made.groupBy("node").agg(first, F.count("*").alias("n")).select("node", "n", "r.*"), "simhash-nodes")
    keyed = nodes.select(F.explode("bands").alias("key"), "node", "fp")
    common.bound_batches(spark)
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    members = common.materialise(spark, dealt.mapInArrow(_members(SHARD_TEXTS), _MEMBER), "simhash-members")
    pairs = common.materialise(spark, members.where("mate <> node").select(F.least("node", "mate").alias("a"), F.greatest("node", "mate").alias("b")).distinct(), "simhash-pairs")
    links = _verified(pairs, nodes, rows, shingle)
    roots = components(spark, links)
    sizes = roots.groupBy("root").agg(F.count("*").alias("size")).select(F.col("root").alias("component"), "size")
    of = members.select("key", "node", "fp").join(roots, "node", "left").select("key", "node", "fp", F.coalesce("root", "node").alias("component"))
    known = common.materialise(spark, of.join(sizes, "component", "left").select("key", F.coalesce("size", F.lit(0).cast("long")).alias("size"), "component", "node", "fp"), "simhash-known")
    sketches = nodes.select("node", F.col("size").alias("n"), "sketch")
    again = _to_search(spark, known, nodes, rows, shingle).join(sketches, "node").select(*known.columns, "n", "sketch").repartition("key").sortWithinPartitions("key", "size", "component")
    more = common.materialise(spark, again.mapInArrow(_across, _PAIR).distinct().join(pairs, ["a", "b"], "left_anti"), "simhash-pairs")
    roots = components(spark, links.unionByName(_verified(more, nodes, rows, shingle)))
    classes = nodes.select("node", "n").join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("component"))
    return common.salted_join(made.select("doc_id", "place", "node"), classes, "node", "n").select("doc_id", "place", "component")


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of df but those that have an earlier near copy in their component (near_copies): the smallest doc_id stays, of
    texts that share it the one with the smallest hash, and of rows that repeat both the one with the smallest hash. Rows with a null
    doc_id, which nothing can tell apart, stay all. Texts aren't shuffled unless more than SMALL rows go."""
    spark = df.sparkSession
    classes = common.materialise(spark, near_copies(df, doc_id, text, shingle), "simhash-classes")
    key = F.struct("doc_id", "place")
    one = classes.groupBy("component").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first", "n")
    every = common.salted_join(classes, one, "component", "n")
    gone = every.groupBy("doc_id", "place", (key != F.col("first")).alias("surplus")).agg(F.count("*").alias("times")).where("surplus OR times > 1")
    id_, place = common.fresh(df, "_gone_id", "_gone_place")
    gone = common.materialise(spark, gone.select(F.col("doc_id").alias(id_), F.col("place").alias(place), "surplus"), "simhash-gone")
    named = gone.drop("surplus")
    same = (df[doc_id].cast("long") == F.col(id_)) & (F.xxhash64(df[text]) == F.col(place))
    kept = df.join(_small(named), same, "left_anti")
    repeated = gone.where("NOT surplus").drop("surplus")
    if repeated.isEmpty():
        return kept
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    rows = df.join(_small(repeated), same).select(id_, place, whole.alias(id_ + "_row"))
    once = rows.groupBy(id_, place).agg(F.min_by(id_ + "_row", F.xxhash64(id_ + "_row")).alias("r")).select("r.*")
    return kept.unionByName(once)
