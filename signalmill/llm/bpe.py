"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For a fixed rank table, every byte prefix of a piece has one BPE encoding, and thus one last token.
``last[i]`` holds the token that ends prefix ``i``; the encoding of a prefix is read off by walking
back. A token ``t`` ends prefix ``i`` iff it is a suffix of it and the pair (``last[i - len(t)]``,
``t``) survives merging, which depends on these two tokens only. Appending a byte therefore adds one
entry and changes none, and after an edit only entries from the edit on are computed again, until
they agree with the old ones over the length of the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Callable, Iterable
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and decimal rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Vocabulary:
    """Ranks with, for each token, the two tokens of its last merge.

    A piece that is itself a token is that token. Tokens that merging never yields ("unreachable")
    take no part otherwise.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.longest = max(self.sizes.values(), default=1)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._endings: dict = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The parts of the last merge; None for a single byte; (-1, -1) if merging never yields it."""
        if token not in self._halves:
            data = self.token_bytes[token]
            self._halves[token] = None if len(data) == 1 else self._last_merge(data)
        return self._halves[token]

    def _last_merge(self, data: bytes) -> tuple[int, int]:
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            best = min(((ranks[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)
            if best is None:
                return -1, -1
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if any(p not in ranks for p in parts):
            return -1, -1
        return ranks[parts[0]], ranks[parts[1]]

    def survives(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens ends with just these two.

        Merges are undone from the latest back; between two undone merges, the parts that then met
        at the border must not have had a merge of their own that came first (of equal ranks, the
        leftmost comes first).
        """
        ranks, data, halves, before = self.ranks, self.token_bytes, self._halves, sys.maxsize
        while True:
            merged = ranks.get(data[left] + data[right])
            if merged is not None and merged < before:
                return False
            a = halves[left] if left in halves else self.halves(left)
            b = halves[right] if right in halves else self.halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]

    def endings(self) -> dict:
        """The reachable tokens by their bytes from the last to the first: a node maps a byte to the
        next node, and -1 to a token."""
        if not self._endings:
            for data, token in self.ranks.items():
                if self.halves(token) != (-1, -1):
                    node = self._endings
                    for byte in reversed(data):
                        node = node.setdefault(byte, {})
                    node[-1] = token
        return self._endings


def extend(v: Vocabulary, data: bytes, last: list[int], pairs: dict[int, bool], end: int | None = None) -> None:
    """Fills last[len(last)] to last[end], or last[len(data)]. pairs: answers of `survives` found before."""
    endings, survives = v.endings(), v.survives
    for i in range(len(last), (len(data) if end is None else end) + 1):
        node, j, found = endings, i, []
        while j:
            node = node.get(data[j - 1])
            if node is None:
                break
            j -= 1
            if -1 in node:
                found.append((j, node[-1]))
        for j, token in reversed(found):  # the longest is mostly the one
            if j == 0:
                break
            left = last[j]
            fits = pairs.get(key := left << 32 | token)
            if fits is None:
                fits = pairs[key] = survives(left, token)
            if fits:
                break
        else:
            raise ValueError("the ranks lack a byte of the text")
        last.append(token)


def walk_back(v: Vocabulary, data: bytes, last: list[int]) -> list[int]:
    whole = v.ranks.get(data)
    if whole is not None:
        return [whole]
    out, i, sizes = [], len(data), v.sizes
    while i:
        token = last[i]
        out.append(token)
        i -= sizes[token]
    return out[::-1]


class PrefixEncoder:
    """The prefix table of one piece, with exact appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.pairs: dict[int, bool] = {}
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        extend(self.vocabulary, self.data, self.last, self.pairs)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces data[start:end]; returns how many prefixes were computed again.

        Once as many entries in a row as the longest token has bytes denote the same tokens as
        before, over bytes that the edit left alone, all later ones do too, as they depend on
        nothing else.
        """
        reach, old, shift = self.vocabulary.longest, self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, same, i = old[: start + 1], 0, start
        while i < len(self.data):
            i += 1
            extend(self.vocabulary, self.data, self.last, self.pairs, i)
            was = i - shift
            same = same + 1 if was > end + reach and old[was] == self.last[i] else 0
            if same >= reach:
                self.last.extend(old[was + 1 :])
                break
        return i - start

    def tokens(self) -> list[int]:
        return walk_back(self.vocabulary, self.data, self.last)


#: Code points below this are classified one by one, for a pattern that the faster re module runs.
PLAIN = 0x250


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall of the pattern. Texts of only Latin code points take an equivalent pattern for re,
    in which \\p{L}, \\p{N}, \\s and \\S are spelled out as the code points that have them."""
    slow = regex.compile(pattern).findall
    sets = {p: "".join(f"\\u{c:04x}" for c in range(PLAIN) if regex.match(p, chr(c))) for p in (r"\p{L}", r"\p{N}", r"\s")}
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(sets.values())}]").replace(r"\S", f"[^{sets[chr(92) + 's']}]")
    for name, chars in sets.items():
        plain = plain.replace(name, f"[{chars}]")
    if re.search(r"\\[a-zA-Z]", re.sub(r"\\u[0-9a-f]{4}", "", plain)):
        return slow  # a pattern with other classes
    fast, odd = re.compile(plain).findall, re.compile(f"[^\\x00-\\u{PLAIN - 1:04x}]").search
    return lambda text: slow(text) if odd(text) else fast(text)


class Pieces(dict):
    """Token ids of each piece, computed when first asked for. Pieces share the entries of their
    common prefixes of up to `shared` bytes. Bounded: whichever of the three tables is full is
    emptied; long pieces aren't held."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 200_000, longest: int = 48, shared: int = 8, prefix_limit: int = 100_000, pair_limit: int = 250_000):
        self.vocabulary, self.limit, self.longest, self.shared, self.prefix_limit, self.pair_limit = vocabulary, limit, longest, shared, prefix_limit, pair_limit
        self.prefixes: dict[bytes, int] = {}
        self.pairs: dict[int, bool] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self._encode(piece.encode("utf-8")))
        if len(piece) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids

    def _encode(self, data: bytes) -> list[int]:
        v, prefixes = self.vocabulary, self.prefixes
        whole = v.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(prefixes) > self.prefix_limit:
            prefixes.clear()
        if len(self.pairs) > self.pair_limit:
            self.pairs.clear()
        last = [-1]
        for i in range(1, min(len(data), self.shared) + 1):
            token = prefixes.get(data[:i])
            if token is None:
                break
            last.append(token)
        known = len(last)
        extend(v, data, last, self.pairs)
        for i in range(known, min(len(data), self.shared) + 1):
            prefixes[data[:i]] = last[i]
        return walk_back(v, data, last)


class Codec:
    def __init__(self, rank_data: bytes, pattern: str):
        self.vocabulary = Vocabulary(read_ranks(rank_data))
        self.split, self.pieces = splitter(pattern), Pieces(self.vocabulary)
        size = max(self.vocabulary.token_bytes, default=-1) + 1
        self.names = [str(i) for i in range(size)]
        self.bytes = [self.vocabulary.token_bytes.get(i, b"") for i in range(size)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def codec_for(rank_data: bytes, pattern: str) -> Codec:
    """One for each Python worker, which serves many tasks."""
    return common.held(("codec", hashlib.sha256(rank_data).hexdigest(), pattern), lambda: Codec(rank_data, pattern))


#: A rank file above this isn't broadcast.
MAX_RANK_BYTES = 64 << 20


def load_rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has more than {MAX_RANK_BYTES} bytes")
    return data


def encode_decode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str | None = "ids", digests: bool = False, decoded: str | None = None) -> DataFrame:
    """df with the token ids of every whole text (null counts as empty) in column `ids`, the decoded
    text in column `decoded` if asked for, and with digests n_tokens, ids_sha256 (of the decimal
    ids, joined by commas) and decoded_sha256 (of the bytes decoded from the ids).

    Rows keep their order, repeated rows are encoded alike, an empty table gives an empty table.
    Columns of df that have the name of a new one are replaced. Texts of any length are taken whole:
    the time is linear in a piece's bytes. The rank file is read by the driver and broadcast (its
    size is checked); no special tokens are made.
    """
    data = df.sparkSession.sparkContext.broadcast(load_rank_file(rank_path))
    added: list[tuple[str, T.DataType]] = []
    if ids:
        added.append((ids, T.ArrayType(T.IntegerType())))
    if decoded:
        added.append((decoded, T.StringType()))
    if digests:
        added += [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    (source,) = common.fresh(df, "_bpe_text")
    new = {n.lower() for n, _ in added}
    rows = df.withColumn(source, df[text]).select(*(f"`{c}`" for c in df.columns if c.lower() not in new), source)

    def make():
        codec = codec_for(data.value, pattern)
        names, sha = codec.names, common.sha256_hex

        def work(columns):
            out = []
            for t in columns[0]:
                tokens = codec.encode(t or "")
                row: list = [tokens] if ids else []
                if decoded or digests:
                    back = codec.decode(tokens)
                    row += [back.decode("utf-8")] if decoded else []
                    row += [len(tokens), sha(",".join(map(names.__getitem__, tokens)).encode()), sha(back)] if digests else []
                out.append(row)
            return [list(c) for c in zip(*out)] if out else [[] for _ in added]

        return work

    return common.map_rows(rows, [source], added, make).drop(source)
