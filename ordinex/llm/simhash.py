"""SimHash near-duplicates by an inverted index of byte positions with count filtering.

Two fingerprints of eight bytes that differ in at most ``k`` = 3 bits share at least
8 - 3 = 5 bytes at their positions, the guaranteed minimum. Lists of single positional
bytes hold a 256th of all fingerprints each, and tallying pairs over them grows with the
square of the corpus, so a term of the index is a choice of four positions with their
bytes (70 to a fingerprint), one fewer than the minimum: every pair that reaches it
meets under a term. There the shared positional bytes of pairs are tallied, pairs below the
minimum dropped, and the others verified by their differing bits. Other ``k`` up to 7
work alike, with 7 - k positions in a term (one for the last two).

Equal fingerprints are one node, so copies add nothing. A list is searched breadth
first: what is linked leaves the members yet to be reached, so a dense group is left
in a few steps, and only a spanning forest leaves the list. A list so long that this
could cost more looks up each member's neighbours at up to ``k`` flipped bits instead.
Components are found by minimum labels with pointer jumping, on the executors.

Defined results: a null text or one without words has fingerprint zero; texts with
fewer words than a shingle are one shingle; null ids rank above all others as
component ids; repeated rows are linked like copies; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hex64, materialize, texts

BITS, SEED = 3, 42
#: Lists up to this long are searched; beyond it, whichever way has the lesser bound.
SEARCHED = 2048


def digests(text: str | None, shingle: int = 3) -> bytes:
    """The XXH64 of each shingle of a text, eight bytes each, most significant first."""
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return b""
    lot = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*[w[k:] for k in range(shingle)]))
    digest = xxhash.xxh64_digest
    return b"".join([digest(s, SEED) for s in lot])


def majority(raw: bytes) -> int:
    """The bits that are set in over half of the digests; zero where there are none."""
    counts, step = np.zeros(64, np.int64), 65536
    for k in range(0, len(raw), 8 * step):
        counts += np.unpackbits(np.frombuffer(raw[k : k + 8 * step], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(raw) // 8).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned SimHash of one text."""
    return majority(digests(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit integer."""
    t = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, fp long")


def _byte(p: int) -> int:
    """Shift of the byte at position ``p``."""
    return 8 * (7 - p)


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked(values: np.ndarray, k: int = BITS) -> list[tuple[int, int]]:
    """Links (index, index) that span the components of ``values``, distinct unsigned integers that
    share the bytes of a term, at up to ``k`` differing bits."""
    n = len(values)
    moving = int(np.bitwise_or.reduce(values ^ values[0]))
    bits = [b for b in range(64) if moving >> b & 1]
    lookups = sum(comb(len(bits), d) for d in range(1, k + 1))
    return _searched(values, k) if n <= SEARCHED or n < 2 * lookups else _looked_up(values, k, bits)


def _near(diff: np.ndarray, k: int) -> np.ndarray:
    """Shared positional bytes are tallied first; then the bits of those that have enough are verified."""
    near = (np.ascontiguousarray(diff).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - k
    near[near] = np.bitwise_count(diff[near]) <= k
    return near


def _searched(values: np.ndarray, k: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    rest = np.arange(len(values))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _near(values[rest] ^ values[x], k)
            hits = rest[near]
            out += [(int(x), int(h)) for h in hits]
            queue.extend(hits)
            rest = rest[~near]
    return out


def _looked_up(values: np.ndarray, k: int, bits: list[int]) -> list[tuple[int, int]]:
    n = len(values)
    parent = np.arange(n)
    out: list[tuple[int, int]] = []
    packed = np.zeros(n, np.int64)  # the bits that differ in the list, packed to the right
    for at, b in enumerate(bits):
        packed |= ((values >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << at
    order = np.argsort(packed)
    ordered = packed[order]
    for d in range(1, k + 1):
        for flips in combinations(range(len(bits)), d):
            other = packed ^ sum(1 << f for f in flips)
            at = np.minimum(np.searchsorted(ordered, other), n - 1)
            for i in np.flatnonzero((ordered[at] == other) & (packed < other)):
                a, b = _find(parent, int(i)), _find(parent, int(order[at[i]]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(i), int(order[at[i]])))
    return out


def links(nodes: DataFrame, k: int = BITS) -> DataFrame:
    """``(a, b)`` that span all links between distinct fingerprints ``fp`` of ``nodes``."""
    if not 0 < k < 8:
        raise ValueError("k from 1 to 7: a pair must share a byte")
    masks = [sum(0xFF << _byte(p) for p in t) for t in combinations(range(8), max(1, 7 - k))]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks])).alias("term", "part"))
    lists = keyed.repartition("term", "part").sortWithinPartitions("term", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.empty(0, np.int64)] * 3

        def forest(cols: list[np.ndarray]) -> pa.RecordBatch:
            fp, term, part = cols
            new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (part[1:] != part[:-1])]))
            sizes = np.diff(np.concatenate([new, [len(fp)]]))
            a, b = [], []
            # Lists of two, most of all that aren't single, are told at once.
            two = new[sizes == 2]
            x, y = fp[two], fp[two + 1]
            near = _near(x.view(np.uint64) ^ y.view(np.uint64), k)
            a.append(x[near])
            b.append(y[near])
            for s, n in zip(new[sizes > 2], sizes[sizes > 2]):
                own = np.unique(fp[s : s + n].view(np.uint64))
                if pairs := np.array(linked(own, k), dtype=np.int64).reshape(-1, 2).tolist():
                    i, j = zip(*pairs)
                    a.append(own[list(i)].view(np.int64))
                    b.append(own[list(j)].view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate([t, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for t, c in zip(tail, batch.columns)]
            fp, term, part = cols
            if not len(fp):
                continue
            # The last list may go on in the next batch.
            last = (term == term[-1]) & (part == part[-1])
            cut = int(np.argmax(last))
            if cut:
                yield forest([c[:cut] for c in cols])
            tail = [c[cut:] for c in cols]
        if len(tail[0]):
            yield forest(tail)

    return lists.select("fp", "term", "part").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the least node of each component, for the nodes of ``edges`` (a, b).

    Each round takes the least label of all neighbours, then the label of the label,
    until no label changes; labels are written in the shared folder.
    """
    both = materialize(edges.union(edges.select("b", "a")).distinct().toDF("a", "b"), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        over = step.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        jumped = step.join(over, step["label"] == over["n2"], "left").select("node", F.least("label", F.coalesce("l2", "label")).alias("label"), "old")
        jumped = materialize(jumped, "labels")
        changed = jumped.filter("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, shingle: int = 3, k: int = BITS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the least id reachable by links."""
    fps = materialize(fingerprints(docs, shingle), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    labels = components(links(nodes, k))
    # Of a component: the least id of any of its fingerprints.
    j = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = j.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialize(j.select("fp", "label").join(least, "label").select(F.col("fp").alias("ox_fp"), "component_id"), "simhash-components")
    return fps.join(named, fps["fp"] == named["ox_fp"]).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
