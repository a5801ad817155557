"""Token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch (words behind the space mark) are put in a trie.
A node stands for a prefix, and holds the best unigram score of any segmentation of
it and the number of tokens of that segmentation; both follow from its ancestors, so
each shared prefix is computed once. Where a pre-token ends, its count is stored.
A character that no piece covers costs its bytes. Of equal scores the segmentation
with fewer tokens counts.

Defined results: a null or empty text has no words and no tokens; repeated rows get
equal counts; whole texts of any length are counted; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, texts, worker_cache
from .unigram import SPACE, Vocabulary, vocabulary

WORDS = re.compile(WORD)
#: Words in a generation of the cache, the longest that is kept, characters put in one trie.
KEPT, KEPT_CHARS, TRIE_CHARS = 300_000, 40, 1_000_000


class CountTrie:
    """Scores and counts of prefixes; the root is the space mark's parent."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.scores = {p: v.log_p[k] for p, k in v.index.items()}
        self.children: dict[tuple[int, str], int] = {}
        self.best = [0.0]
        self.count = [0]
        self.terminal: dict[str, int] = {}

    def _bytes(self, c: str) -> tuple[float, int]:
        raw = c.encode()
        return sum(self.v.log_p[self.v.bytes[b]] for b in raw), len(raw)

    def insert(self, word: str) -> int:
        """The number of tokens of ``word``, and a node for each of its prefixes."""
        s = SPACE + word
        scores, children, best, count, longest = self.scores, self.children, self.best, self.count, self.v.longest
        path = [0]
        for i in range(1, len(s) + 1):
            at = (path[-1], s[i - 1])
            node = children.get(at)
            if node is None:
                node = children[at] = len(best)
                top, n = self._bytes(s[i - 1]) if s[i - 1] not in scores else (scores[s[i - 1]], 1)
                top, n = best[path[-1]] + top, count[path[-1]] + n
                for j in range(max(0, i - longest), i - 1):
                    score = scores.get(s[j:i])
                    if score is not None:
                        parent = path[j]
                        x = best[parent] + score
                        if x > top or x == top and count[parent] + 1 < n:
                            top, n = x, count[parent] + 1
                best.append(top)
                count.append(n)
            path.append(node)
        self.terminal[word] = count[path[-1]]
        return count[path[-1]]


class TokenCounter:
    """Counts by word, kept in two generations; tries live for a lot of new words."""

    def __init__(self, v: Vocabulary):
        self.v, self.young, self.old = v, {}, {}

    def _learn(self, missing: Iterable[str]) -> dict[str, int]:
        found: dict[str, int] = {}
        trie, size = CountTrie(self.v), 0
        for w in sorted(missing):
            n = self.old.get(w)
            if n is None:
                n = trie.insert(w)
                size += len(w)
                if size > TRIE_CHARS:
                    trie, size = CountTrie(self.v), 0
            found[w] = n
        if len(self.young) + len(found) > KEPT:
            self.old, self.young = self.young, {}
        self.young.update((w, n) for w, n in found.items() if len(w) <= KEPT_CHARS)
        return found

    def count_all(self, texts_: Iterable[str | None]) -> list[tuple[int, int]]:
        """``(words, tokens)`` of each text."""
        out: list[tuple[int, int]] = []
        open_: list[tuple[int, list[str], list[int | None]]] = []
        missing: set[str] = set()

        def put() -> None:
            found = self._learn(missing)
            for k, words, ns in open_:
                out[k] = len(words), sum([found[w] if n is None else n for w, n in zip(words, ns)])
            open_.clear()
            missing.clear()

        for t in texts_:
            words = WORDS.findall(t or "")
            ns = list(map(self.young.get, words))
            if None in ns:
                open_.append((len(out), words, ns))
                missing.update([w for w, n in zip(words, ns) if n is None])
                out.append((0, 0))
                if len(missing) > KEPT // 3:
                    put()
            else:
                out.append((len(words), sum(ns)))
        put()
        return out


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of each document. Nothing is shuffled."""
    t = texts(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_cache("token_counts")
        if vocabulary_path not in own:
            own[vocabulary_path] = TokenCounter(vocabulary(vocabulary_path))
        c = own[vocabulary_path]
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                rows = b.slice(k, 2000)
                got = c.count_all(rows.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)]], names=["doc_id", "n_words", "n_tokens"])

    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
