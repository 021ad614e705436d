"""Names of a list in texts, leftmost and longest, by a trie of words: the cost of a text doesn't grow with the list.

A name is a row of runs of ASCII letters and digits and of single other characters. Since a mention neither begins nor ends inside a run, its
runs are whole runs of the text, so that one look-up tells for each run of a text whether a name can begin there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import functions as F

_LOW_RUN = re.compile(r"[a-z0-9]+")
_RUN, _PART = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
#: Characters that are the same as an ASCII letter but for letter case.
_SAME = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "K": "k"})
_ODD = re.compile(f"[{''.join(map(chr, _SAME))}]")
_END = ""


def plain(text: str) -> str:
    """The text with these as ASCII letters; of the same length, also in lower case."""
    return text.translate(_SAME) if _ODD.search(text) else text


class NameTrie:
    def __init__(self, names: Iterable[str]):
        self.root: dict = {}
        for name in names:
            node = self.root
            for part in _PART.findall(name.translate(_SAME)):
                node = node.setdefault(part.lower(), {})
            node[_END] = True
        self.root.pop(_END, None)  # an empty name is nowhere
        self.odd = [k for k in self.root if not _RUN.match(k)]
        self.runs = self.root.keys() - set(self.odd)

    def _starts(self, low: str) -> list[tuple[int, str]]:
        """Where a first part of a name stands, in order, of a text in lower case."""
        out = []
        for part in [*self.runs.intersection(_LOW_RUN.findall(low)), *self.odd]:
            at = low.find(part)
            while at >= 0:
                end = at + len(part)
                if not (at and _LOW_RUN.match(low, at - 1, at)) and (part in self.odd or not _LOW_RUN.match(low, end)):
                    out.append((at, part))
                at = low.find(part, end)
        return sorted(out)

    def _longest(self, text: str, at: int, node: dict) -> int:
        """The end of the longest name that goes on from `at` (-1: none)."""
        end = -1
        while True:
            m = _RUN.match(text, at)
            if _END in node and m is None:
                end = at
            part = m.group() if m else text[at : at + 1]
            if not part or (after := node.get(part.lower())) is None:
                # A run that follows a run is a part of it, so that a name can end before a run only after another character.
                return end
            node, at = after, at + len(part)

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of each mention."""
        low = plain(text).lower()
        free = 0
        for at, part in self._starts(low):
            if at < free:
                continue
            end = self._longest(low, at + len(part), self.root[part])
            if end >= 0:
                yield at, end
                free = end


_tries: dict[str, NameTrie] = {}


def trie_of(names: Mapping[str, str], key: str | None = None) -> NameTrie:
    """The trie of a list, built once in a worker, which outlives its tasks."""
    key = key or digest(names)
    if key not in _tries:
        _tries.clear()
        _tries[key] = NameTrie(names)
    return _tries[key]


def digest(names: Mapping[str, str]) -> str:
    return hashlib.sha256("\0".join(sorted(names)).encode()).hexdigest()


def mentions_of(names: Mapping[str, str]):
    """A column function from texts to (start, end, name) of their mentions; names maps what is written to what it stands for. A list of any
    size that a worker can hold."""
    key, table = digest(names), {k.lower(): v for k, v in names.items()}

    @F.pandas_udf("array<struct<start:int,end:int,name:string>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = trie_of(names, key)
        for texts in batches:
            yield texts.map(lambda t: [{"start": a, "end": b, "name": table.get(t[a:b].lower(), t[a:b].lower())} for a, b in trie.find(t)] if t else [])

    return found
