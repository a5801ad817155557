"""Byte-level BPE by rank files: encoding with a hierarchical-bitmap rank queue, and decoding.

A pre-token's bytes are a linked list. Each adjacent pair that is a known token is
entered, at its position, in the bucket of its rank; two levels of bit words, as wide as
the root of the number of ranks, say which buckets hold anything, so the least rank is
found by find-first-set on one word of each level. A popped position whose pair has changed meanwhile is stale and is
skipped. Of equal ranks the leftmost comes first. Each merge costs a constant number
of queue operations, however long the pre-token.

Whole texts are cut where pre-tokens can't reach across: before each run of white
space. Known pre-tokens are kept in a bounded cache, so each distinct one is merged once
in a while, not at each place; most cuts are one pre-token, and are looked up as such.

Defined results: a null or empty text has no ids; repeated rows get equal results; a
text of any length is encoded whole; other columns are not looked at.
"""

from __future__ import annotations

import array
import base64
import hashlib
import re
import sys
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts, worker_cache

#: Unicode white space as the rank files' regular expressions see it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CUT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Pre-tokens in each of the two generations of their cache, cuts of several pre-tokens kept, and the longest of either.
KEPT, KEPT_MIXED, KEPT_CHARS = 280_000, 100_000, 40


class RankQueue:
    """A priority queue of (rank, position), empty again after each use.

    A word of ``low`` has a bit for each of ``1 << shift`` ranks, ``top`` a bit for each
    word of ``low``. The loop of ``merge`` does the same on these fields in place.
    """

    def __init__(self, ranks: int):
        self.shift = (ranks.bit_length() + 1) // 2
        self.mask = (1 << self.shift) - 1
        self.low = [0] * ((ranks >> self.shift) + 1)
        self.top = 0
        self.bit = [1 << k for k in range(1 << self.shift)]
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        heappush(self.buckets.setdefault(rank, []), position)
        self.low[rank >> self.shift] |= self.bit[rank & self.mask]
        self.top |= self.bit[rank >> self.shift]

    def pop(self) -> tuple[int, int]:
        high = (self.top & -self.top).bit_length() - 1
        first = self.low[high] & -self.low[high]
        rank = high << self.shift | first.bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[high] ^= first
            if not self.low[high]:
                self.top ^= self.bit[high]
        return rank, position


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # The white space of the pattern is Unicode's, which Python's differs from in four control characters.
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.queue = RankQueue(len(self.tokens))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.mixed: dict[str, bytes] = {}
        #: The rank of each two bytes, -1 where they are no token.
        self.two = [self.ranks.get(bytes(divmod(k, 256)), -1) for k in range(1 << 16)]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        # The queue's operations stand in the loop itself: calls would take half of the time.
        get, queue, two = ranks.get, self.queue, self.two
        low, bit, shift, mask, buckets = queue.low, queue.bit, queue.shift, queue.mask, queue.buckets
        n, top = len(piece), 0
        after = list(range(1, n + 2))  # where the next part starts
        before = list(range(-1, n))
        pair = [two[x << 8 | y] for x, y in zip(piece, piece[1:])]  # rank of the part here joined with the next; -1: none, or no part starts here
        for i, rank in enumerate(pair):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)  # ascending positions are a heap
                else:
                    buckets[rank] = [i]
                    high = rank >> shift
                    low[high] |= bit[rank & mask]
                    top |= bit[high]
        pair += (-1, -1)
        while top:
            high = (top & -top).bit_length() - 1
            word = low[high]
            first = word & -word
            least = high << shift | first.bit_length() - 1
            bucket = buckets[least]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[least]
                low[high] = word = word ^ first
                if not word:
                    top ^= bit[high]
            if pair[i] != least:
                continue
            j = after[i]
            after[i] = k = after[j]
            pair[j] = -1
            if k < n and (rank := get(piece[i : after[k]])) is not None:
                pair[i] = rank
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    high = rank >> shift
                    low[high] |= bit[rank & mask]
                    top |= bit[high]
            else:
                pair[i] = -1
            before[k] = i
            if i:
                h = before[i]
                if (rank := get(piece[h:k])) is not None:
                    pair[h] = rank
                    if rank in buckets:
                        heappush(buckets[rank], h)
                    else:
                        buckets[rank] = [h]
                        high = rank >> shift
                        low[high] |= bit[rank & mask]
                        top |= bit[high]
                else:
                    pair[h] = -1
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _word(self, word: str) -> bytes:
        """The ids of a pre-token that the younger generation lacks."""
        ids = self.old.get(word)
        if ids is None:
            ids = _as_bytes(self.merge(word.encode()))
        if len(word) <= KEPT_CHARS:
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def _cut(self, cut: str) -> bytes:
        """The ids of a cut that is no pre-token of the younger generation."""
        ids = self.mixed.get(cut)
        if ids is None:
            words = self.pattern.findall(cut)
            if len(words) == 1:
                return self._word(words[0])
            ids = b"".join([self.young.get(word) or self._word(word) for word in words])
            if len(cut) <= KEPT_CHARS:
                if len(self.mixed) >= KEPT_MIXED:
                    self.mixed.clear()
                self.mixed[cut] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        cuts = CUT.findall(text)
        ids = list(map(self.young.get, cuts))  # most cuts are one pre-token
        if None in ids:
            ids = [i if i is not None else self._cut(c) for c, i in zip(cuts, ids)]
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        a = array.array("I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return b"".join(map(self.tokens.__getitem__, a))


def _as_bytes(ids: list[int]) -> bytes:
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def coder(path: str, pattern: str) -> ByteBpe:
    """One for each worker process and file."""
    own = worker_cache("byte_bpe")
    if (path, pattern) not in own:
        own[path, pattern] = ByteBpe(path, pattern)
    return own[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit) of each text."""
    t = texts(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(x) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and the ``decoded`` bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([c.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids", "decoded"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def sha256(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
