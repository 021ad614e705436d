"""Benchmark decontamination: an FM-index for each shard of the documents, searched backward.

A shard's text is first cut to the stretches in which every two neighbouring words are neighbours in
some benchmark item and which are as long as the shortest window; no occurrence can lie elsewhere. The
index holds the wavelet matrix of the Burrows-Wheeler transform and every few suffix positions.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import words

WINDOW = 10
#: Symbols of one index; longer shards are cut, with an overlap of a window less one word.
SHARD_SYMBOLS = 1 << 20
SAMPLE = 8


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in reversed(range(max(1, int(size - 1).bit_length()))):
            ones = (symbols >> bit) & 1
            ranks = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(ones, out=ranks[1:])
            zeros = len(symbols) - int(ranks[-1])
            self.levels.append((bit, ranks, zeros))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each place."""
        low, high = np.zeros_like(at), at
        for bit, ranks, zeros in self.levels:
            one = ((symbols >> bit) & 1).astype(bool)
            a, b = ranks[low], ranks[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """By prefix doubling. Each 0 is a sign of its own, ordered by place, so that comparing ends there."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends), text + int(ends.sum()) + 1).astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while True:
        ranked = rank[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]]) if n else 0
        if n == 0 or new[order[-1]] == n:
            return order
        # The step after a 0 is never looked at: the 0 itself differs from all else.
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = new[step:]
        rank = new * (n + 1) + second
        order = np.argsort(rank, kind="stable")
        step *= 2


class FMIndex:
    """Over symbols 1 to size - 1; 0 ends a stretch and is never searched."""

    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE):
        order = suffix_order(text)
        self.bwt = text[order - 1]  # before the first symbol stands the last, a 0
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.wavelet = WaveletMatrix(self.bwt, size)
        # Also places after a 0, so that no walk to a sampled place crosses one.
        self.sampled = (order % sample == 0) | (self.bwt == 0)
        self.nth = np.cumsum(self.sampled) - 1
        self.places = order[self.sampled]
        self.n = len(text)

    def back(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbols] + self.wavelet.rank(symbols, at)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row interval of each pattern (rows of equal length), from its last symbol to its first."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            symbols = patterns[alive, k]
            low[alive], high[alive] = self.back(symbols, low[alive]), self.back(symbols, high[alive])
            high[np.setdiff1d(np.arange(len(patterns)), alive)] = 0
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, out = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows[open_]]
            ended = open_[done]
            out[ended] = self.places[self.nth[rows[ended]]] + steps[ended]
            open_ = open_[~done]
            rows[open_] = self.back(self.bwt[rows[open_]], rows[open_])
            steps[open_] += 1
        return out


class Windows:
    """The distinct windows of benchmark items, as arrays of word numbers, by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = defaultdict(set)
        pairs: set[tuple[int, int]] = set()
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            pairs.update(zip(ids, ids[1:]))
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                found[tuple(ids[at : at + window])].add(item)
        self.size = len(self.vocabulary) + 1
        self.pairs = np.sort(np.array([a * self.size + b for a, b in pairs], dtype=np.int64))
        self.by_length = {}
        for n in sorted({len(w) for w in found}):
            own = [w for w in found if len(w) == n]
            self.by_length[n] = (np.array(own, dtype=np.int64), [found[w] for w in own])
        self.shortest, self.longest = min(self.by_length, default=0), max(self.by_length, default=0)

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Starts and ends of the stretches that can hold a window."""
        if not self.shortest or not len(ids):
            return []
        keys = ids[:-1] * self.size + ids[1:]
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        linked = np.zeros(len(ids) + 1, dtype=bool)  # linked[k]: word k goes on from word k - 1
        if len(self.pairs):
            where = np.searchsorted(self.pairs, keys[both])
            linked[both[self.pairs[np.minimum(where, len(self.pairs) - 1)] == keys[both]] + 1] = True
        starts = np.flatnonzero((ids > 0) & ~linked[:-1])
        ends = np.flatnonzero((ids > 0) & ~linked[1:]) + 1
        long = ends - starts >= self.shortest
        return list(zip(starts[long].tolist(), ends[long].tolist()))

    def occurrences(self, ids: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """(start, length, items) of each window's each occurrence in a shard."""
        pieces, shards, size = [], [], 0
        for a, b in self.stretches(ids):
            while a < b:
                end = min(b, a + SHARD_SYMBOLS)
                pieces.append((a, end))
                size += end - a + 1
                if size >= SHARD_SYMBOLS:
                    shards.append(pieces)
                    pieces, size = [], 0
                if end == b:
                    break
                a = end - self.longest + 1
        out = []
        for pieces in [*shards, pieces]:
            if not pieces:
                continue
            lengths = np.array([b - a + 1 for a, b in pieces])
            origin = np.repeat(np.array([a for a, _ in pieces]) - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
            place = np.arange(lengths.sum()) + origin
            text = np.where(np.isin(np.arange(lengths.sum()), np.cumsum(lengths) - 1), 0, ids[np.minimum(place, len(ids) - 1)])
            index = FMIndex(text, self.size)
            for n, (patterns, owners) in self.by_length.items():
                low, high = index.search(patterns)
                hit = np.flatnonzero(high > low)
                counts = (high - low)[hit]
                rows = np.repeat(low[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                which = np.repeat(hit, counts)
                for at, k in zip(place[index.locate(rows)].tolist() if len(rows) else [], which.tolist()):
                    out.append((at, n, owners[k]))
        return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(windows: Windows, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: its words, merged spans of words inside an occurrence, and items found."""
    split = [words(t) for t in texts]
    starts = np.r_[0, np.cumsum([len(w) + 1 for w in split])].astype(np.int64)
    get = windows.vocabulary.get
    ids = np.fromiter(chain.from_iterable(chain(map(get, w, repeat(0)), (0,)) for w in split), dtype=np.int64, count=int(starts[-1]))
    spans: list[list] = [[] for _ in split]
    items: list[set] = [set() for _ in split]
    for at, n, owners in windows.occurrences(ids):
        k = int(np.searchsorted(starts, at, side="right")) - 1
        spans[k].append((at - int(starts[k]), at - int(starts[k]) + n))
        items[k] |= owners
    return [(len(w), merge(s), i) for w, s, i in zip(split, spans, items)]


#: The benchmark is searched in blocks of at most so many bytes of text; each block is broadcast and takes one pass.
BLOCK_BYTES = 8 << 20
#: Bytes of text that are indexed at once.
SLICE_BYTES = 3 << 20
#: Passes that run in one stage, each in a worker of its own; then the rows are written.
CHAINED = 4


def pieces_of(benchmark: DataFrame, item_id: str, text: str, window: int, limit: int) -> DataFrame:
    """(item, words), each once: the words of each text, joined by spaces. Longer texts than half the limit come in pieces that
    overlap by a window less one word, so that each window is whole in one of them."""

    def make():
        def work(columns):
            out = []
            for t in columns[0]:
                own = words(t)
                step = max(1, len(own) * limit // (2 * max(1, sum(map(len, own)) + len(own))) - window) if own else 1
                out.append([b" ".join(own[at : at + step + window - 1]).decode() for at in range(0, max(1, len(own) - window + 1), step)] if own else [])
            return [out]

        return work

    rows = benchmark.select(benchmark[item_id].cast("string").alias("item"), benchmark[text].alias("text"))
    parts = common.map_rows(rows, ["text"], [("parts", T.ArrayType(T.StringType()))], make)
    return parts.select("item", F.explode("parts").alias("words")).distinct()


def blocks_of(pieces: DataFrame, limit: int) -> list[DataFrame]:
    """The pieces in blocks by hash, so many that none is above the limit (or is one piece)."""
    n = -(-(pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // limit) or 1
    while True:
        block = F.pmod(F.xxhash64("item", "words"), F.lit(n))
        sizes = pieces.groupBy(block.alias("b")).agg(F.sum(F.octet_length("words")).alias("size"), F.count("*").alias("m"))
        if sizes.where((F.col("size") > limit) & (F.col("m") > 1)).isEmpty():
            return [pieces.where(block == k) for k in range(n)]
        n *= 2


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_passages(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df with n_words, n_hit, hit_spans (merged [start, end) of words), hit_items (sorted as
    strings) and contaminated.

    A window is `window` consecutive words of an item, or the whole of a shorter one. Null texts
    have no words, items without words have no windows; repeated items count once. Items with a null id have windows like others,
    but aren't listed in hit_items. Whole texts are searched, of any length; rows are kept as they come, repeated ones alike, and an
    empty table gives an empty one. Columns of df with the name of a new one are replaced.
    A larger benchmark is searched block by block, each in one more pass over the rows and without
    a shuffle; the rows are written after every CHAINED passes.
    """
    spark = df.sparkSession
    new = ["n_words", "n_hit", "hit_spans", "hit_items", "contaminated"]
    words_, spans_, items_, source = common.fresh(df, "_hit_words", "_hit_spans", "_hit_items", "_hit_text")
    rows = df.withColumn(source, df[text]).select(*(f"`{c}`" for c in df.columns if c.lower() not in new), source)
    out = rows
    pieces = common.materialise(spark, pieces_of(benchmark, item_id, item_text, window, block_bytes), "benchmark-pieces")
    for number, block in enumerate(blocks_of(pieces, block_bytes)):
        items = spark.sparkContext.broadcast([(r["item"], r["words"]) for r in block.collect()])  # bounded by block_bytes
        key = ("windows", uuid.uuid4().hex)

        def make(items=items, number=number, key=key):
            windows = common.held(key, lambda: Windows(items.value, window))

            def work(columns):
                found = scan(windows, columns[0])
                before = zip(columns[1], columns[2]) if number else repeat((None, None))
                spans, hits = [], []
                for (_, own, ids), (old_spans, old_items) in zip(found, before):
                    spans.append([{"start": a, "end": b} for a, b in merge(own + [(s["start"], s["end"]) for s in old_spans or []])])
                    hits.append(sorted((ids - {None}) | set(old_items or [])))
                return [[n for n, _, _ in found], spans, hits]

            return work

        names = [f"{c}{number}" for c in (words_, spans_, items_)]
        last = [f"{c}{number - 1}" for c in (spans_, items_)] if number else []
        out = common.map_rows(out, [source, *last], [(names[0], T.LongType()), (names[1], SPANS), (names[2], T.ArrayType(T.StringType()))], make, SLICE_BYTES)
        out = out.drop(*last, *([f"{words_}{number - 1}"] if number else []))
        if number % CHAINED == CHAINED - 1:
            out = common.materialise(spark, out, "passages")
    n_hit = F.aggregate(names[1], F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select(*(f"`{c}`" for c in rows.columns if c != source), F.col(names[0]).alias("n_words"), n_hit.alias("n_hit"), F.col(names[1]).alias("hit_spans"), F.col(names[2]).alias("hit_items"), (n_hit > 0).alias("contaminated"))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
