"""Best-fit packing by patterns: a plan over the histogram of lengths, then one place for each piece.

The histogram of piece lengths is all that the plan needs, and it has as many rows
as a sequence has tokens. On a coarse histogram, patterns of up to four lengths that
fill a sequence are enumerated and their repeat counts fitted by non-negative least
squares (Lawson and Hanson's active sets); counts are rounded down to what exact
lengths allow, and what is left is packed best-fit, longest first, into the room
that patterns leave and then into new sequences. A plan is a bounded list of blocks:
``count`` pieces of one length, from the ``ord``-th on, go to as many consecutive
sequences at one offset.

Pieces then find their block by length and ordinal. Ordinals are dealt within salted
groups of a length, so a length that a third of all pieces have is no single group.

Defined results: a null text is empty and has the end id alone; pieces of null or
zero length or beyond the capacity get no place (null); repeated rows are pieces of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, texts
from .word_bpe import encoder

#: Steps of the coarse histogram, parts of a pattern, rows in a salted group, most salts of a length.
COARSE, PARTS, GROUP_ROWS, MAX_SALTS = 128, 4, 2000, 4096


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int | None = 1, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, on demand, ``ids`` (little-endian
    unsigned 32-bit) of each piece of at most ``max_tokens`` ids of each document."""
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    t = texts(docs)
    id_type = t.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            at = []
            for k, ids in enumerate(enc.encode_all(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, max(n, 1), max_tokens)):
                    cut = ids[4 * start : 4 * (start + max_tokens)]
                    at.append(k)
                    for out, x in zip(rows, (piece, start, len(cut) // 4, zlib.crc32(cut), cut)):
                        out.append(x)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 if with_ids else 4]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(x, k) for x, k in zip(rows, kinds)]], names=NAMES[: 6 if with_ids else 5])

    return t.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]


def nnls(a: np.ndarray, b: np.ndarray, most: int = 2000) -> np.ndarray:
    """The non-negative ``x`` of least squares of ``a x - b``, by active sets."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    limit = 1e-9 * max(1.0, np.abs(w).max(initial=0))
    for _ in range(most):
        free = np.where(passive, -np.inf, w)
        j = int(free.argmax())
        if free[j] <= limit:
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, p], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[p] = s
                break
            bad = s <= 0
            old = x[p]
            step = np.min(old[bad] / np.maximum(old[bad] - s[bad], 1e-300))
            x[p] = old + step * (s - old)
            drop = p[(x[p] <= 1e-12) & bad]
            if not len(drop):
                drop = p[bad][:1]
            passive[drop] = False
            x[drop] = 0
            if drop[0] == j and len(drop) == 1 and step == 0:
                w = w.copy()
                w[j] = 0
        w_new = a.T @ (b - a[:, passive] @ x[passive])
        w = w_new
    return x


def patterns(units: int, parts: int = PARTS) -> list[tuple[int, ...]]:
    """All descending tuples of up to ``parts`` positive numbers that add up to ``units``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
            return
        room = parts - len(head)
        for x in range(min(left, most), 0, -1):
            if x * room < left:
                break
            grow((*head, x), left - x, x)

    grow((), units, units)
    return out


class Plan:
    """Blocks ``(length, ord, count, sequence, offset)`` over a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {k: int(v) for k, v in histogram.items() if v > 0}
        self.dealt = dict.fromkeys(self.left, 0)
        self.blocks: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        #: By room left: groups of consecutive sequences, (first, count). Bit r of ``rooms``: there are some.
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0
        self._fit()
        self._best_fit()

    def _place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.blocks.append((length, self.dealt[length], count, sequence, offset))
        self.dealt[length] += count
        self.left[length] -= count

    def _leave(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.open[room].append((first, count))
            self.rooms |= 1 << room

    def _new(self, count: int) -> int:
        first = self.sequences
        self.sequences += count
        return first

    def _fit(self) -> None:
        units = min(COARSE, self.capacity)
        width = -(-self.capacity // units)
        units = -(-self.capacity // width)
        step = lambda n: -(-n // width)
        have = np.zeros(units + 1)
        for n, c in self.left.items():
            have[step(n)] += c
        if have.sum() == 0:
            return
        # The last step may be narrower than the others: a pattern's lengths are checked when it is filled.
        all_ = [p for p in patterns(units) if all(have[u] for u in p)]
        if not all_:
            return
        a = np.zeros((units, len(all_)))
        for j, p in enumerate(all_):
            for u in p:
                a[u - 1, j] += 1
        scale = have.max()
        x = nnls(a, have[1:] / scale) * scale
        lengths = {u: sorted((n for n in self.left if step(n) == u), reverse=True) for u in range(1, units + 1)}
        for j in np.argsort(-x, kind="stable"):
            p = all_[j]
            repeat = int(min(np.floor(x[j] + 1e-6), *(sum(self.left[n] for n in lengths[u]) // p.count(u) for u in p)))
            if repeat < 1:
                continue
            first = self._new(repeat)
            groups = [(first, repeat, 0)]
            for k, u in enumerate(p):
                after = []
                for f, count, fill in groups:
                    # The last part takes the longest piece that fits, so that nothing or little stays free.
                    room = self.capacity - fill
                    for n in range(room, 0, -1) if k == len(p) - 1 else lengths[u]:
                        if count == 0:
                            break
                        c = min(count, self.left.get(n, 0)) if n <= room else 0
                        if c:
                            self._place(n, c, f, fill)
                            after.append((f, c, fill + n))
                            f, count = f + c, count - c
                    if count:
                        after.append((f, count, fill))
                groups = after
            for f, count, fill in groups:
                self._leave(self.capacity - fill, f, count)

    def _best_fit(self) -> None:
        for n in sorted(self.left, reverse=True):
            while (want := self.left[n]) > 0:
                if fits := self.rooms >> n:
                    room = n + (fits & -fits).bit_length() - 1
                    first, count = self.open[room].pop()
                    if not self.open[room]:
                        self.rooms &= ~(1 << room)
                    c = min(count, want)
                    self._place(n, c, first, self.capacity - room)
                    self._leave(room - n, first, c)
                    self._leave(room, first + c, count - c)
                    continue
                each = self.capacity // n
                full = want // each
                count, copies = (full, each) if full else (1, want)
                first = self._new(count)
                for k in range(copies):
                    self._place(n, count, first, k * n)
                self._leave(self.capacity - copies * n, first, count)


def pack(pieces: DataFrame, capacity: int = 4096, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with ``length``) with ``sequence_id`` and ``offset``: its place, gapless
    from 0 in each sequence of at most ``capacity``. ``pieces`` is read three times: give a written table.
    """
    spark = pieces.sparkSession
    fits = F.col("length").between(1, capacity)
    hist = {r["length"]: r["n"] for r in pieces.filter(fits).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    plan = Plan(hist, capacity)
    blocks = np.array(plan.blocks or [(0, 0, 0, 0, 0)], dtype=np.int64).reshape(-1, 5)
    code = blocks[:, 0] * (1 << 40) + blocks[:, 1]
    order = np.argsort(code)
    starts, seqs, offsets = code[order], blocks[order, 3], blocks[order, 4]
    shared = spark.sparkContext.broadcast((starts, seqs, offsets))  # a few blocks for each length
    salts = int(min(MAX_SALTS, max(1, sum(hist.values()) // GROUP_ROWS)))
    rest = [c for c in pieces.columns]
    salted = pieces.withColumn("ox_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    sizes = salted.filter(fits).groupBy("length", "ox_salt").agg(F.count(F.lit(1)).alias("ox_n"))
    before = sizes.withColumn("ox_before", F.sum("ox_n").over(W.partitionBy("length").orderBy("ox_salt")) - F.col("ox_n")).drop("ox_n")
    before = materialize(before.select(F.col("length").alias("ox_l"), F.col("ox_salt").alias("ox_s"), "ox_before"), "pack-offsets")
    ranked = salted.withColumn("ox_rank", F.row_number().over(W.partitionBy("length", "ox_salt").orderBy(*keys)) - 1)
    numbered = ranked.join(before, (ranked["length"] == before["ox_l"]) & (ranked["ox_salt"] == before["ox_s"]), "left")
    numbered = numbered.select(*rest, F.when(fits, F.col("length") * F.lit(1 << 40) + F.col("ox_before") + F.col("ox_rank")).alias("ox_code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, seqs, offsets = shared.value
        for b in batches:
            c = b.column(len(rest))
            code = c.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.maximum(np.searchsorted(starts, code, side="right") - 1, 0)
            none = c.is_null().to_numpy(zero_copy_only=False)
            seq = pa.array(seqs[at] + (code - starts[at]), pa.int64(), mask=none)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], seq, pa.array(offsets[at], pa.int64(), mask=none)], names=[*rest, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return numbered.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenize, cut and pack ``docs``: a row for each piece."""
    return pack(materialize(token_pieces(docs, tokenizer_path, capacity, end_id), "token-pieces"), capacity)
