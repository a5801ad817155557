"""Near copies: all pairs of texts whose word shingles have a Jaccard similarity of 0.8 or more.

Candidates come first from the SimHash index (:func:`ordinex.llm.simhash.links`): pairs
whose fingerprints differ in a few bits. No number of bits that the index can serve
reaches every pair of that similarity, so an exact way follows for the rest: two sets
of such a similarity share four fifths of the larger one at least, so if all shingles stand
in one order, the first n // 5 + 1 of the n of each set, its prefix, have one in common.
The order is that of the shingles' hashes: a fifth of all shingles is sent, nothing is
counted. Where the first shingle that two sets share stands at the i-th and j-th place, i + j
shingles differ already, and a ninth of both sizes may: a list keeps the members that have a
partner of such a place and size.

A shingle that more than ``HOT`` prefixes hold makes no list. The sets that hold one in their
prefix are compared among themselves by a second index instead, over all of their shingles,
ordered by the number of these sets that hold them, so that what many hold comes last. A pair
of which one set holds no such shingle shares one of a short list, so every pair that
reaches the similarity meets; nothing is sampled, capped or estimated. What many sets of one
part of the input hold is told there: of it no more than ``HOT`` + 1 entries a part are sent.

Equal sets are one node, so copies add nothing. From each list its least member is
compared with all others first, if they meet often; then each member with the nearest one
of another component; of what is then linked, only pairs of different components are left to
compare. Sizes and a bitmap of parities, as long as its
set is large (its differing bits are no more than the differing shingles), tell most apart.
All that is left, SimHash's candidates as well, is verified by sets, which go to one task for
each pivot and salt. Lists too long for one task are compared in blocks.

Defined results: texts with fewer words than a shingle are one shingle; null texts
and those without words are copies of one another; shingles are compared by XXH64.
Of a component one row stays, that of the least id (null ids last, then the least hash of
the text); rows that repeat an id are told apart by their place. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small, worker_cache
from .simhash import components, digests, links, majority

#: Least bits of a bitmap of parities; members that a list may have; the rank of shingles that more hold.
PARITIES, HOT, LAST = 1024, 4096, 1 << 62
#: Shingles in a part of the input, rows of a block of a long list, sets verified in a task with their pivot's, rows sent at once;
#: a pair that meets in fewer lists than this part of its sizes is not verified before components are known.
PART, BLOCK, SALTED, ROWS, SELDOM = 4_000_000, 4096, 1000, 500, 32


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(_numbers(digests(text, size)))


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def parities(own: np.ndarray) -> np.ndarray:
    """Whether each residue of the hashes occurs an odd number of times, as words of bits; three quarters as many residues as hashes at least."""
    size = PARITIES
    while 4 * size < 3 * len(own):
        size *= 2
    return np.packbits(np.bincount((own % np.uint64(size)).astype(np.int64), minlength=size) & 1, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, length: int) -> np.ndarray:
    """Parities (rows) as of fewer residues."""
    while words.shape[-1] > length:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 4/5 or more."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def _addressed(docs: DataFrame) -> DataFrame:
    """``docs`` with a lasting address of each row, ``ox_file`` and ``ox_pos``: its place in its
    Parquet file where ``docs`` is read from files, else in a copy written for this."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns:
        try:
            return docs.select(*[docs[c] for c in docs.columns], F.xxhash64("_metadata.file_path").alias("ox_file"), F.col("_metadata.row_index").alias("ox_pos"))
        except AnalysisException:
            pass  # files of another format
    return materialize(docs.withColumns({"ox_file": F.lit(0).cast("long"), "ox_pos": F.monotonically_increasing_id()}), "near-rows")


def _texts(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.select("ox_file", "ox_pos", F.col(text_col).alias("text"))


def _sketches(rows: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Of each row its address, id and text's hash, and its set's digest (``node``), size, parities, prefix and SimHash."""
    sent = rows.select("ox_file", "ox_pos", F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        worker_cache("near_copies")
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                b = batch.slice(k, ROWS)
                nodes, sizes, bits, fps, heads = [], [], [], [], []
                for x in b.column(4).to_pylist():
                    raw = digests(x, size)
                    own = np.unique(_numbers(raw))
                    nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                    sizes.append(len(own))
                    bits.append(parities(own).tobytes())
                    fps.append(majority(raw))
                    heads.append(own[: len(own) // 5 + 1])
                digest, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps))
                at = np.concatenate([[0], np.cumsum([len(x) for x in heads])])
                prefix = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate(heads).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], digest, pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), fp, prefix], names=["ox_file", "ox_pos", "id", "hash", "node", "n", "bits", "fp", "prefix"])

    kind = sent.schema["id"].dataType.simpleString()
    return materialize(sent.mapInArrow(run, f"ox_file long, ox_pos long, id {kind}, hash long, node long, n int, bits binary, fp long, prefix array<long>"), "near-sketches")


def _parts(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Of (h, node, at) in any order, by parts of the input: rows (h, node, at, 0), but of a shingle that more than ``hot`` rows
    of the part hold ``hot`` + 1 alone, and all of them as (node, h, 0, 1): what is known to be frequent goes by its node."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        h, node, at = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
        held.clear()
        order = np.argsort(h, kind="stable")
        starts, sizes = _bounds(h[order])
        if not (sizes > hot).any():
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(node), pa.array(at), pa.array(np.zeros(len(h), np.int8))], names=NAMES)
            return
        h, node, at = h[order], node[order], at[order]
        many = np.repeat(sizes > hot, sizes)
        sent = ~many | (np.arange(len(h)) - np.repeat(starts, sizes) <= hot)
        for key, own, place, frequent in ((h[sent], node[sent], at[sent], 0), (node[many], h[many], np.zeros(many.sum(), np.int64), 1)):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(place), pa.array(np.full(len(key), frequent, np.int8))], names=NAMES)

    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= PART:
            yield from out()
            rows = 0
    if rows:
        yield from out()


NAMES = ["k", "v", "at", "frequent"]


def _bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal values."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return new, np.diff(np.concatenate([new, [len(x)]]))


def _runs(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of whole runs of the first column, which is sorted, and False; or of a part of a run of more than ``most``
    distinct values of the second column, and True."""
    tail: list[list[np.ndarray]] = []
    held, long = 0, None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if long is not None:  # what goes on of a run that is known to be long
            cut = int(np.searchsorted(cols[0], long, side="right"))
            if cut:
                yield [c[:cut] for c in cols], True
            cols = [c[cut:] for c in cols]
        if not len(cols[0]):
            continue
        long = None
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut or (tail and tail[0][0][0] != cols[0][0]):
            # What went on from earlier batches ends here.
            yield [np.concatenate(c) for c in zip(*tail, [c[:cut] for c in cols])], False
            tail, held = [], 0
        tail.append([c[cut:] for c in cols])
        held += len(tail[-1][0])
        if most is not None and held > 8 * most:
            own = [np.concatenate(c) for c in zip(*tail)]
            if len(np.unique(own[1])) > most:
                yield own, True
                tail, held, long = [], 0, own[0][0]
    if tail:
        yield [np.concatenate(c) for c in zip(*tail)], False


def _plain(batches: Iterator[pa.RecordBatch], rest: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that come before the first ``frequent`` one; what else was read goes to ``rest``."""
    for b in batches:
        n = int(b.column(3).to_numpy().sum())
        yield b.slice(0, b.num_rows - n).select(NAMES[:3])
        if n:
            rest.append(b.slice(b.num_rows - n))
            return


def _near_places(n: np.ndarray, i: np.ndarray, m: np.ndarray | int, j: np.ndarray | int) -> np.ndarray:
    """Whether sets of these sizes may have the similarity if the first shingle they share is at these places."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * (i + j) <= n + m)


def _short(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Of (h, node, at) in order: the members of lists that have a partner, with their list's pivot (or themselves, where it
    is none) and ``at``; and as (null, node, null, null) those of a shingle that more than ``hot`` nodes hold. ``at``: size, then place."""
    rest: list[pa.RecordBatch] = []

    def told(node: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(node), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(node), none, none], names=["h", "node", "pivot", "at"])

    for (h, node, at), long in _runs(_plain(batches, rest), hot):
        if long:
            yield told(np.unique(node))
            continue
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
        h, node, at = h[first], node[first], at[first]
        n, place = at >> 32, at & 0xFFFFFFFF
        starts, sizes = _bounds(h)
        kept, pivot = np.zeros(len(h), bool), node.copy()
        two = starts[sizes == 2]  # most lists
        near = _near_places(n[two], place[two], n[two + 1], place[two + 1])
        kept[two[near]] = kept[two[near] + 1] = True
        pivot[two[near] + 1] = node[two[near]]
        for s, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            if size > hot:
                yield told(node[s : s + size])
                continue
            own = slice(s, s + size)
            least = s + int(np.lexsort((node[own], n[own]))[0])
            linked = _near_places(n[own], place[own], n[least], place[least])
            linked[least - s] = False
            kept[own] = linked
            kept[least] = linked.any()
            pivot[own][linked] = node[least]
            for x in np.flatnonzero(~kept[own]):
                kept[s + x] = _near_places(n[own], place[own], n[s + x], place[s + x]).sum() > int(9 * place[s + x] <= n[s + x])
        yield pa.RecordBatch.from_arrays([pa.array(h[kept]), pa.array(node[kept]), pa.array(pivot[kept]), pa.array(at[kept])], names=["h", "node", "pivot", "at"])
    for b in chain(rest, batches):
        yield told(b.column(0).to_numpy())


def _shared(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Of (h, node, at) in order: (h, node, df) of shingles that more than one node holds; ``df`` is LAST for more than ``hot``."""
    rest: list[pa.RecordBatch] = []
    for (h, node, _), long in _runs(_plain(batches, rest), hot):
        if not long:
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
            h, node = h[first], node[first]
        held = np.repeat(*[_bounds(h)[1]] * 2)
        some = (held > 1) | long
        held[(held > hot) | long] = LAST
        yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(node[some]), pa.array(held[some].astype(np.int64))], names=["h", "node", "df"])
    for b in chain(rest, batches):
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(np.full(b.num_rows, LAST))], names=["h", "node", "df"])


def _gathered(rows: DataFrame, entries: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], hot: int) -> DataFrame:
    """The ``entries`` (h, node, at) of rows by shingle, in order, what is frequent by node behind them. One worker makes and parts them."""
    return rows.mapInArrow(lambda b: _parts(entries(b), hot), "k long, v long, at long, frequent byte").repartition("k").sortWithinPartitions("frequent", "k", "v")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, n, prefix): (h, node, at), once for each node of a task."""
    seen: set[int] = set()
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            b = batch.slice(k, ROWS)
            new = []
            for i, x in enumerate(b.column(0).to_pylist()):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            own = b.take(pa.array(new, pa.int64()))
            sizes = np.diff(own.column(2).offsets.to_numpy())
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.repeat(own.column(1).to_numpy().astype(np.int64) << 32, sizes) | place
            yield pa.RecordBatch.from_arrays([own.column(2).flatten(), pa.array(np.repeat(own.column(0).to_numpy(), sizes)), pa.array(at)], names=["h", "node", "at"])


def _lists(sketches: DataFrame, nodes: DataFrame, rows: DataFrame, text_col: str, size: int, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """The lists (h, node, pivot) of up to ``hot`` members, and those of the second index, of any length; two nodes of
    the similarity have one in common. None: no shingle is as frequent."""
    found = materialize(_gathered(sketches.select("node", "n", "prefix"), _heads, hot).mapInArrow(lambda b: _short(b, hot), "h long, node long, pivot long, at long"), "near-lists")
    short, busy = found.filter("h IS NOT NULL"), found.filter("h IS NULL").select("node")
    if not busy.limit(1).count():
        return short, None
    busy = materialize(busy.distinct().join(nodes, "node").select("node", "n", "ox_file", "ox_pos"), "near-busy")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = shingles(text, size).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), node)), pa.array(np.zeros(len(own), np.int64))], names=["h", "node", "at"])

    whole = _texts(rows, text_col).join(small(busy.drop("n")), ["ox_file", "ox_pos"]).select("node", "text")
    counted = _gathered(whole, emit, hot).mapInArrow(lambda b: _shared(b, hot), "h long, node long, df long")
    ranked = counted.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("s"))
    # The prefix, without the shingles that no other of these sets holds: these come first.
    length = F.floor(F.col("n") / 5).cast("int") + 1 - (F.col("n") - F.size("s"))
    index = ranked.join(busy, "node").withColumn("length", length).filter("length > 0")
    index = materialize(index.select(F.explode(F.slice("s", F.lit(1), F.col("length"))).alias("t"), "node", "n").select("t.h", "node", "n"), "near-long")
    least = index.groupBy("h").agg(F.min(F.struct("n", "node")).alias("p")).select("h", F.col("p.node").alias("pivot"), F.col("p.n").alias("least"))
    return short, index.join(least, "h").select("h", "node", F.when(5 * F.col("least") >= 4 * F.col("n"), F.col("pivot")).otherwise(F.col("node")).alias("pivot"))


def _words(bits: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Parities by their length in words: places and rows of words."""
    by: dict[int, list[int]] = {}
    for k, x in enumerate(bits):
        by.setdefault(len(x) // 8, []).append(k)
    return {w: (np.array(at), np.frombuffer(b"".join([bits[k] for k in at]), np.uint64).reshape(len(at), w)) for w, at in by.items()}


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (h, label, node, at) in order: the members of lists that have a partner of another label, as their places and sizes go."""
    for (h, label, node, at), _ in _runs(batches):
        n, place = at >> 32, at & 0xFFFFFFFF
        kept = np.zeros(len(h), bool)
        starts, sizes = _bounds(h)
        two = starts[sizes == 2]
        near = (label[two] != label[two + 1]) & _near_places(n[two], place[two], n[two + 1], place[two + 1])
        kept[two[near]] = kept[two[near] + 1] = True
        for s, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            own = slice(s, s + size)
            if label[s] != label[s + size - 1]:
                for x in range(s, s + size):
                    kept[x] = (_near_places(n[own], place[own], n[x], place[x]) & (label[own] != label[x])).any()
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (h, label, node)], names=["h", "label", "node"])


def _left(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a list whose labels differ, and whose sizes and parities allow the similarity; with ``nearest``, of each member
    outside the largest component the one of fewest differing bits. Rows: h, label, node, n, bits."""
    for (h, label, node, n, bits), _ in _runs(batches):
        for s, size in zip(*_bounds(h)):
            starts, sizes = _bounds(label[s : s + size])
            if len(sizes) < 2:
                continue
            # The largest component last, so that its members are not compared among themselves one by one.
            by_size = np.argsort(sizes, kind="stable")
            order = s + np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in by_size])
            ends = np.repeat(np.cumsum(sizes[by_size])[:-1], sizes[by_size][:-1])
            ids, ns, own = node[order], n[order].astype(np.int64), [bits[k] for k in order]
            words = _words(own)
            short = {(w, v): folded(rows, v) for w, (_, rows) in words.items() for v in words if v <= w}
            a, b = [], []
            for x, end in enumerate(ends):
                mine = np.frombuffer(own[x], np.uint64)
                found, spare = [], []
                for w, (at, rows) in words.items():
                    v = min(w, len(mine))
                    rest = at[at >= end]
                    some = 5 * np.minimum(ns[rest], ns[x]) >= 4 * np.maximum(ns[rest], ns[x])
                    if some.any():
                        rest = rest[some]
                        differ = np.bitwise_count(short[w, v][np.searchsorted(at, rest)] ^ folded(mine, v)).sum(axis=1, dtype=np.int64)
                        left = ns[rest] + ns[x] - 9 * differ
                        found.append(rest[left >= 0])
                        spare.append(left[left >= 0] / (ns[found[-1]] + ns[x]))
                if found and (other := np.concatenate(found)).size:
                    other = other[[np.concatenate(spare).argmax()]] if nearest else other
                    a.append(np.minimum(ids[other], ids[x]))
                    b.append(np.maximum(ids[other], ids[x]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _sifted(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (a, b, c) that met in ``c`` lists, (a, b) of those that meet often and may have the similarity by sizes and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, n, m = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3, 4))
            near = (c >= np.minimum(n, m) // SELDOM) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
            for k in np.flatnonzero(near):
                x, y = (np.frombuffer(b.column(q)[k].as_py(), np.uint64) for q in (5, 6))
                v = min(len(x), len(y))
                near[k] = 9 * int(np.bitwise_count(folded(x, v) ^ folded(y, v)).sum(dtype=np.int64)) <= n[k] + m[k]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    one, two = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
    known = pairs.join(one, "a").join(two, "b").select("a", "b", "c", "na", "nb", "bitsa", "bitsb")
    return materialize(known.mapInArrow(run, "a long, b long"), "near-pairs")


def _verified(near: DataFrame, nodes: DataFrame, rows: DataFrame, text_col: str, size: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity. Each node's text is read where it lies; its set goes to its pivots ``a``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, text, to in zip(*(c.to_pylist() for c in b.columns)):
                own = shingles(text, size).tobytes()
                cols = [[x["a"] for x in to], [x["salt"] for x in to], [int(x["a"] != node) for x in to], [node] * len(to)]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], pa.array([own] * len(to), pa.binary())], names=["a", "salt", "member", "b", "s"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k in range(batch.num_rows):
                a, salt, member, b = (batch.column(c)[k].as_py() for c in range(4))
                if not member:
                    at, own = (a, salt), np.frombuffer(batch.column(4)[k].as_py(), np.uint64)
                elif at == (a, salt) and alike(own, np.frombuffer(batch.column(4)[k].as_buffer(), np.uint64)):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    pivots = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALTED).cast("int").alias("salts"))
    member = near.join(pivots, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    to = pivots.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).union(member)
    asked = to.groupBy("node").agg(F.collect_list(F.struct("a", "salt")).alias("to")).join(nodes, "node").select("node", "ox_file", "ox_pos", "to")
    asked = materialize(asked, "near-asked")
    sent = _texts(rows, text_col).join(small(asked), ["ox_file", "ox_pos"]).select("node", "text", "to").mapInArrow(sets, "a long, salt int, member int, b long, s binary")
    return materialize(sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "member").mapInArrow(check, "a long, b long"), "near-links")


def _by_fingerprint(fps: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of nodes that the SimHash index links. ``fps``: node, fp."""
    least = materialize(fps.groupBy("fp").agg(F.min("node").alias("node")), "near-fingerprints")
    found = links(least.select("fp"), k)
    one, two = least.toDF("a", "na"), least.toDF("b", "nb")
    equal = fps.join(least.toDF("fp", "na"), "fp").select("na", "node")
    return found.join(one, "a").join(two, "b").select("na", "nb").union(equal).select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))


def survivors(docs: DataFrame, shingle: int = 5, k: int = 3, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of near copies one. ``k``: the bits of the SimHash index;
    ``hot``: the members that a list may have; neither changes the result."""
    rows = _addressed(docs)
    sketches = _sketches(rows, shingle, id_col, text_col)
    first = F.min(F.struct("ox_file", "ox_pos", "n", "bits")).alias("x")
    nodes = materialize(sketches.groupBy("node").agg(first).select("node", "x.*"), "near-nodes")
    short, long = _lists(sketches, nodes, rows, text_col, shingle, hot)
    star = [x.filter("pivot <> node").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"), F.lit(1).alias("c")) for x in (short, long) if x is not None]
    hashed = _by_fingerprint(sketches.select("node", "fp").distinct(), k).filter("a <> b").withColumn("c", F.lit(1 << 30))
    met = reduce(DataFrame.union, [*star, hashed]).groupBy("a", "b").agg(F.sum("c").alias("c"))
    edges = _verified(_sifted(met, nodes), nodes, rows, text_col, shingle)
    named = lambda x, labels: x.join(small(labels.withColumnRenamed("node", "at_node")), F.col("node") == F.col("at_node"), "left")
    # Each member's nearest first: what it links needs no further pairs. Then all that is left.
    for nearest in (True, False):
        labels = components(edges)
        told = named(short, labels).select("h", F.coalesce("label", "node").alias("label"), "node", "at")
        dealt = told.repartition("h").sortWithinPartitions("h", "label").mapInArrow(_cross, "h long, label long, node long")
        if long is not None:
            sizes = long.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
            own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
            blocks = named(long.select("h", "node"), labels).join(sizes, "h").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            key = F.when(F.col("blocks") == 1, F.col("h")).otherwise(F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")))
            dealt = dealt.union(blocks.select(key.alias("h"), F.coalesce("label", "node").alias("label"), "node"))
        dealt = dealt.join(nodes.select("node", "n", "bits"), "node").select("h", "label", "node", "n", "bits")
        more = dealt.repartition("h").sortWithinPartitions("h", "label").mapInArrow(lambda b, nearest=nearest: _left(b, nearest), "a long, b long")
        near = materialize(more.distinct(), "near-pairs")
        edges = edges.union(_verified(near, nodes, rows, text_col, shingle))
    labels = components(edges)
    # An order of whole rows: rows that share an id are told apart by their text's hash, and copies by their place.
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("hash"), F.col("ox_file"), F.col("ox_pos"))
    kept = named(sketches, labels).withColumn("label", F.coalesce("label", "node")).groupBy("label").agg(F.min(order).alias("o")).select("o.ox_file", "o.ox_pos")
    gone = materialize(sketches.select("ox_file", "ox_pos").join(kept, ["ox_file", "ox_pos"], "left_anti"), "near-gone")
    return rows.join(small(gone), ["ox_file", "ox_pos"], "left_anti").select(*docs.columns)
