"""Names that are nearly a term: chunks of terms held against blocks of names, in arrays.

Where a name and a term have a ratio of `cutoff`, few insertions and deletions make one of the other. So 64 bits of their letters differ in few
places, which is asked of any two of lengths that fit, and they have a common subsequence of nearly all their letters, which is asked of those
that are left, a step of all pairs at a time. Both only rule out what can't reach the cutoff; the ratio is taken of the rest.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: As many names of a term, of this ratio and more.
MOST, CUTOFF = 8, 0.82
#: Terms of a chunk, as many and of as many characters at most (but one at least); terms whose names
#: are gathered at once; names of a block, about; pairs that are held against each other at once.
TERMS, CHARS, SLICE, NAMES, AT_ONCE = 16384, 1 << 21, 1024, 16384, 1 << 17
#: The longest text that is read in arrays: a bit for each of its characters.
WORD = 64


def edits(name: int, term: int, cutoff: float = CUTOFF) -> int:
    """Insertions and deletions, at most, between a name and a term of these lengths and of the ratio `cutoff`; -1 if there can't be any such."""
    total = name + term
    most = int((1 - cutoff) * total + 1e-9)
    most -= (total - most) % 2
    return most if most >= abs(name - term) else -1


def ratio(name: str, term: str) -> float:
    return difflib.SequenceMatcher(None, name, term).ratio()


def letters(text: str) -> int:
    """64 bits, one of which each character turns (the first, second, ... of its kind another one): of two texts no more differ than insertions
    and deletions make one of the other."""
    seen: dict[str, int] = {}
    bits = 0
    for c in text:
        seen[c] = seen.get(c, 0) + 1
        bits ^= 1 << ((ord(c) * 0x9E3779B1 + seen[c] * 0x85EBCA6B & 0xFFFFFFFF) >> 26)
    return bits


def _letters(codes: np.ndarray) -> np.ndarray:
    """letters() of each row."""
    bits = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        seen = (codes[:, :k] == codes[:, k : k + 1]).sum(1, dtype=np.uint32) + np.uint32(1)
        bits ^= np.uint64(1) << ((codes[:, k] * np.uint32(0x9E3779B1) + seen * np.uint32(0x85EBCA6B)) >> np.uint32(26)).astype(np.uint64)
    return bits


class _Group:
    """Texts of one length: their places, characters (of short ones only) and bits."""

    def __init__(self, length: int, places: list[int], texts: list[str]):
        self.length, self.places = length, np.array(places, np.int64)
        own = [texts[k] for k in places]
        if length > WORD:
            self.codes, self.bits = None, np.array([letters(t) for t in own], np.uint64)
        else:
            self.codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), length)
            self.bits = _letters(self.codes)


def _groups(texts: list[str]) -> list[_Group]:
    by: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        by.setdefault(len(t), []).append(k)
    return [_Group(n, places, texts) for n, places in by.items()]


class Index:
    """Names by length. Of short names, where each character stands, as bits (masks: of a name and the character's number); characters
    beyond 255 share numbers, which can only let more pairs through."""

    def __init__(self, names: list[str]):
        self.names, self.groups = names, _groups(names)
        short = [g for g in self.groups if g.codes is not None]
        self.alphabet = np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.unique(g.codes) for g in short)]))
        self.masks = np.zeros((len(names), 256), np.uint64)
        for g in short:
            numbers = self.numbers(g.codes)
            for k in range(g.length):
                self.masks[g.places, numbers[:, k]] |= np.uint64(1 << k)

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """0 to 254; 255 for characters of no name."""
        if not len(self.alphabet):
            return np.full(codes.shape, 255, np.uint8)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at % 255, 255).astype(np.uint8)

    def common(self, names: np.ndarray, length: int, numbers: np.ndarray) -> np.ndarray:
        """The longest common subsequence of each name (of this length) with the characters in the same row, at least."""
        v = np.full(len(names), (1 << length) - 1, np.uint64)
        for k in range(numbers.shape[1]):
            u = v & self.masks[names, numbers[:, k]]
            v = (v + u) | (v - u)
        return length - np.bitwise_count(v & np.uint64((1 << length) - 1)).astype(np.int64)

    def candidates(self, length: int, bits: np.ndarray, numbers: np.ndarray | None, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows of terms, places of names) of terms of this length: all pairs that can reach the cutoff, and few others."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n in self.groups:
            most, step = edits(n.length, length, cutoff), max(1, AT_ONCE // len(n.bits))
            for a in range(0, len(bits) if most >= 0 else 0, step):
                i, j = np.nonzero(np.bitwise_count(bits[a : a + step, None] ^ n.bits) <= most)
                i, j = i + a, n.places[j]
                if n.codes is not None and numbers is not None:
                    fits = 2 * self.common(j, n.length, numbers[i]) >= n.length + length - most
                    i, j = i[fits], j[fits]
                out.append((i, j))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def near(self, terms: list[str], cutoff: float, most: int) -> Iterator[tuple[str, str, float]]:
        """(term, name, ratio) of the `most` nearest names of each term, in no order."""
        match = difflib.SequenceMatcher()
        for t in _groups(terms):
            numbers = None if t.codes is None else self.numbers(t.codes)
            for a in range(0, len(t.places), SLICE):
                i, j = self.candidates(t.length, t.bits[a : a + SLICE], None if numbers is None else numbers[a : a + SLICE], cutoff)
                found: dict[int, list[tuple[float, str]]] = {}
                order = np.argsort(i, kind="stable")
                for x, name in zip(i[order].tolist(), j[order].tolist()):
                    if x not in found:
                        found[x] = []
                        match.set_seq2(terms[t.places[a + x]])  # what is known of it serves all its names
                    match.set_seq1(self.names[name])
                    if (r := match.ratio()) >= cutoff:
                        found[x].append((r, self.names[name]))
                for x, of in found.items():
                    yield from ((terms[t.places[a + x]], name, r) for r, name in sorted(of, reverse=True)[:most])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a task, many in a row."""
    own: list[str] = []
    size = 0
    row = lambda: pa.RecordBatch.from_arrays([pa.array([own], pa.list_(pa.string()))], ["terms"])
    for t in chain.from_iterable(b.column(0).to_pylist() for b in batches):
        if own and (len(own) >= TERMS or size + len(t) > CHARS):
            yield row()
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield row()


def near_names(terms: DataFrame, names: DataFrame, cutoff: float = CUTOFF, most: int = MOST) -> DataFrame:
    """(term, name, ratio, nth) of the `most` nearest names of each term, of texts in lower case (term; name); of equal ratios the later name in
    order comes first. Null and empty texts are near nothing; repeats count once. The names are counted when this is called, and go to all tasks in
    blocks; terms can be any number."""
    terms, names = (df.select(c).where(F.length(c) > 0).distinct() for df, c in ((terms, "term"), (names, "name")))
    count = -(-names.count() // NAMES) or 1
    blocks = names.groupBy(F.pmod(F.xxhash64("name"), F.lit(count)).alias("block")).agg(F.collect_list("name").alias("names")).select("names")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of = None, None
        for b in batches:
            for k in range(b.num_rows):
                block = b.column(1)[k].as_py()
                if block != of:
                    index, of = Index(block), block
                rows = list(index.near(b.column(0)[k].as_py(), cutoff, most))
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["term", "name", "ratio"]), pa.schema([("term", pa.string()), ("name", pa.string()), ("ratio", pa.float64())]), preserve_index=False)

    close = terms.mapInArrow(_chunks, "terms array<string>").crossJoin(F.broadcast(blocks)).mapInArrow(pairs, "term string, name string, ratio double")
    nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("ratio"), F.desc("name")))
    return close.withColumn("nth", nth).where(F.col("nth") <= most)
