"""Ids of a word-level BPE file by the tokenizers library, in batches.

The library's pre-tokenizer never lets a token cross white space, and its normalizer
(canonical composition, case) never looks across ASCII white space. So a text's ids
are those of its white-space-free chunks, one after another, and each distinct chunk
needs the library but once. Letters followed by punctuation are two pre-tokens, so
such a chunk's ids are those of its two parts. Settings are the library's own: the string
of an added token in a text is that token.
"""

from __future__ import annotations

import array
import os
import re
import sys
from collections.abc import Iterable

from .common import worker_cache

CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
#: Python's split() takes these for white space as well; the library does not.
SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Below this, lower() works on each character by itself, as the library does, and nothing is composed.
BEYOND_LATIN = re.compile(r"[^\x00-ɏ]")
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Chunks in a generation of the cache (there are two), and the longest that is kept: some 90 MB each.
KEPT, KEPT_CHARS = 400_000, 40
#: Characters handed to the library at once.
AT_ONCE = 500_000

#: The names that byte-level vocabularies give to bytes: printable ones their own character, the rest in order from U+0100.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: chr(b) for b in _OWN} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _OWN)}


class ChunkEncoder:
    """Encodes texts to bytes of little-endian unsigned 32-bit ids.

    Known chunks are kept in two generations: when the younger is full it becomes the
    older, whose entries come back as they are met. Memory is bounded, and frequent
    chunks stay.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The library takes an added token's string in a text for that token; a chunk that holds one goes to it as it stands.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """The white-space-free chunks, in lower case where that is all the library would do to a letter, and where it makes no
        added token's string of another one's."""
        if text.isascii() or not BEYOND_LATIN.search(text):
            low = text.lower()
            if self.added is None or not self.added.search(low):
                text = low
        return CHUNK.findall(text) if SEPARATORS.search(text) else text.split()

    def _library(self, chunks: Iterable[str], into: dict[str, bytes]) -> None:
        """Ask the library. For plain lower-case Latin letters, normalizer and pre-tokenizer
        change nothing but the bytes' names, so its model is asked directly."""
        lot: list[str] = []
        size = 0

        def put() -> None:
            for x, e in zip(lot, self.tokenizer.encode_batch_fast(lot, add_special_tokens=False)):
                into[x] = as_bytes(e.ids)

        tokenize, named = self.tokenizer.model.tokenize, BYTE_NAMES.__getitem__
        for c in chunks:
            if c.isalpha() and c.islower():
                if c.isascii():
                    into[c] = as_bytes([t.id for t in tokenize(c)])
                    continue
                if not BEYOND_LATIN.search(c) and c == c.lower():
                    into[c] = as_bytes([t.id for t in tokenize("".join(map(named, c.encode())))])
                    continue
            lot.append(c)
            size += len(c)
            if size >= AT_ONCE or len(lot) == 20_000:
                put()
                lot, size = [], 0
        if lot:
            put()

    def _learn(self, missing: Iterable[str]) -> dict[str, bytes]:
        """Ids of chunks that the younger generation lacks; what is short enough is kept."""
        found: dict[str, bytes] = {}
        parts: list[tuple[str, str, str]] = []
        ask: set[str] = set()
        young, old = self.young, self.old
        for c in missing:
            if (ids := old.get(c)) is not None:
                found[c] = ids
                continue
            core = c.rstrip(PUNCTUATION)
            n = len(core)
            if n == len(c) or not core.isalpha() or not (core.isascii() or _stay_letters(core)):
                ask.add(c)
                continue
            rest = c[n:]
            parts.append((c, core, rest))
            for x in (core, rest):
                if x not in found:
                    if (ids := young.get(x) or old.get(x)) is not None:
                        found[x] = ids
                    else:
                        ask.add(x)
        self._library(ask, found)
        for c, core, rest in parts:
            found[c] = found[core] + found[rest]
        if len(young) + len(found) > KEPT:
            self.old, self.young = young, {}
        self.young.update(found if max(map(len, found), default=0) <= KEPT_CHARS else {c: ids for c, ids in found.items() if len(c) <= KEPT_CHARS})
        return found

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text of a batch; null: none. What is new in the batch goes to the library together."""
        out: list[bytes] = []
        open_: list[tuple[int, list[bytes | None], list[int], list[str]]] = []
        missing: set[str] = set()

        def put() -> None:
            found = self._learn(missing)
            for k, ids, places, names in open_:
                for i, c in zip(places, names):
                    ids[i] = found[c]
                out[k] = b"".join(ids)
            open_.clear()
            missing.clear()

        for t in texts:
            chunks = self.chunks(t or "")
            ids = list(map(self.young.get, chunks))
            places = nones(ids)
            if places:
                names = [chunks[i] for i in places]
                open_.append((len(out), ids, places, names))
                missing.update(names)
                out.append(b"")
                if len(missing) > KEPT // 5:
                    put()
            else:
                out.append(b"".join(ids))
        put()
        return out


def nones(x: list) -> list[int]:
    """Places of None."""
    out: list[int] = []
    at = -1
    try:
        while True:
            at = x.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


def _stay_letters(core: str) -> bool:
    """Whether letters remain so when normalized: some beyond ASCII become a letter and a mark."""
    return not BEYOND_LATIN.search(core) and core.lower().isalpha()


def as_bytes(ids: list[int]) -> bytes:
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def encoder(path: str) -> ChunkEncoder:
    """One for each worker process and file."""
    own = worker_cache("word_bpe")
    if path not in own:
        own[path] = ChunkEncoder(path)
    return own[path]
