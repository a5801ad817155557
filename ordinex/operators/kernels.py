"""Suppression, association and outcomes of many probes at once, in Arrow batches.

The same rules as the column expressions of :mod:`..functions.geometry` and :mod:`.outcome`, on arrays whose
last axis is the probe. Rows of like lengths share a block, padded to its longest list; a block has a fixed number
of numbers, so a task's memory doesn't grow with the input. A list that is missing counts as empty; a missing
coordinate or score is NaN, and its candidate comes last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contract import OutputContract
from .outcome import assign

#: Outcomes by code, in the order of the failure classes; :data:`NONE` stands for an ineligible probe.
CLASSES = ("stable", "winner_missing", "competitor_missing", "threatening_birth", "ranking_reversal")
STABLE, WINNER, COMPETITOR, BIRTH, REVERSAL = range(5)
NONE = -1
#: Numbers in a block's largest array, and the most tracked candidates for which all their subsets are states.
CELLS, SUBSETS = 1 << 17, 8


@dataclass
class Ranked:
    """Lists by score, one behind another: where each starts and its length."""

    boxes: list[np.ndarray]
    score: np.ndarray
    start: np.ndarray
    n: np.ndarray

    def padded(self, rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Boxes (four arrays), scores and which are real, (place, row)."""
        n = self.n[rows]
        place = np.arange(int(n.max(initial=0)))[:, None]
        real = place < n
        at = np.where(real, self.start[rows] + place, 0)
        take = (lambda x: x[at]) if len(self.score) else (lambda x: np.zeros(at.shape))
        return [take(x) for x in self.boxes], take(self.score), real


def ranked(column: pa.Array) -> Ranked:
    """Candidates of each list by score, highest first; equal scores by ``ord``, then by box."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    x1, y1, x2, y2, score, order = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x1", "y1", "x2", "y2", "score", "ord"))
    row = np.repeat(np.arange(len(n)), n)
    by = np.lexsort((order, -score, row))
    same = (row[by][1:] == row[by][:-1]) & (score[by][1:] == score[by][:-1]) & (order[by][1:] == order[by][:-1])
    if same.any():
        by = np.lexsort((y2, x2, y1, x1, order, -score, row))
    return Ranked([x[by] for x in (x1, y1, x2, y2)], score[by], np.cumsum(n) - n, n)


def blocks(*lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of like lengths, a bounded number of pairs of places at a time."""
    longest = np.maximum.reduce(lengths)
    by = np.lexsort((*lengths, longest))
    at = 0
    while at < len(by):
        size = max(1, CELLS // 64)
        while size > 1 and size * max(1, int(longest[by[min(at + size, len(by)) - 1]])) ** 2 > CELLS:
            size //= 2
        yield by[at : at + size]
        at += size


def _area(b: list[np.ndarray]) -> np.ndarray:
    return np.maximum(0.0, b[2] - b[0]) * np.maximum(0.0, b[3] - b[1])


def iou(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Intersection over union; 0 where the union is empty."""
    both = np.maximum(0.0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * np.maximum(0.0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))
    union = _area(a) + _area(b) - both
    return np.divide(both, union, out=np.zeros(union.shape), where=union > 0)


def kept(boxes: list[np.ndarray], real: np.ndarray, most: int, limits: list[float]) -> list[np.ndarray]:
    """Which candidates greedy suppression keeps, for each limit of the overlap."""
    out = [np.zeros(real.shape, bool) for _ in limits]
    count = [np.zeros(real.shape[1], int) for _ in limits]
    for c in range(len(real)):
        over = iou([x[:c] for x in boxes], [x[c] for x in boxes])
        for k, n, limit in zip(out, count, limits):
            k[c] = real[c] & (n < most) & ~(k[:c] & ~(over < limit)).any(axis=0)
            n += k[c]
    return out


def distinct(lists: Ranked, rows: np.ndarray, most: int, limit: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Boxes, scores and numbers of the candidates that suppression keeps."""
    boxes, score, real = lists.padded(rows)
    (k,) = kept(boxes, real, most, [limit])
    n = k.sum(axis=0)
    at = np.argsort(~k, axis=0, kind="stable")[: int(n.max(initial=0))]
    take = lambda x: np.take_along_axis(x, at, 0)
    return [take(x) for x in boxes], take(score), n


def matched(v: np.ndarray, lt: np.ndarray, le: np.ndarray) -> np.ndarray:
    """For each row the places of its best one-to-one mapping, as :func:`.outcome.assign` finds it; ``v``: overlaps (tracked, exposed, row).

    Sets of tracked candidates are states, a step for each exposed one. A gain has the overlap in billionths above
    the mapping's digits, so the greatest gain tells the mapping.
    """
    n, m, rows = v.shape
    if n > SUBSETS or rows and n * 1.1e9 * float(m + 1) ** n > 2**62:
        out = np.full((n, rows), -1)
        for r in range(rows):
            out[: lt[r], r] = assign(v[: lt[r], : le[r], r]) if le[r] else -1
        return out
    base = le + 1
    never = np.int64(-(2**62))
    digit = np.stack([base ** np.maximum(lt - 1 - i, 0) for i in range(n)])  # (tracked, row)
    scale = base**lt
    best = np.full((1 << n, rows), never)
    best[0] = 0
    masks = np.arange(1 << n)
    for j in range(m):
        gain = np.rint(v[:, j] * 1e9).astype(np.int64) * scale + (le - j) * digit
        gain[(np.arange(n)[:, None] >= lt) | (j >= le)] = never
        after = best.copy()
        for i in range(n):
            without = masks[(masks >> i) & 1 == 0]
            to = without | (1 << i)
            after[to] = np.maximum(after[to], np.where((best[without] >= 0) & (gain[i] >= 0), best[without] + gain[i], never))
        best = after
    digits = best.max(axis=0) % scale
    told = np.stack([digits // digit[i] % base for i in range(n)])
    return np.where((told > 0) & (np.arange(n)[:, None] < lt), le - told, -1)


def associated(v: np.ndarray, lt: np.ndarray, le: np.ndarray, least_match: float) -> np.ndarray:
    """The exposed candidate of each tracked one or -1, by the rules of :func:`.outcome.associated`."""
    n, m, rows = v.shape
    if not m:
        return np.full((n, rows), -1)
    here = (np.arange(n)[:, None] < lt)[:, None, :] & (np.arange(m)[:, None] < le)[None]
    v = np.where(here, v, 0.0)
    best = np.where(v.max(axis=1) > 0, v.argmax(axis=1), -1)
    hard = np.zeros(rows, bool)
    for i in range(n):
        for k in range(i):
            hard |= (best[i] == best[k]) & (best[i] >= 0)
    if least_match <= 0:
        hard |= ((best < 0) & (np.arange(n)[:, None] < lt)).any(axis=0)
    at = np.flatnonzero(hard)
    if len(at):
        best[:, at] = matched(v[:, :, at], lt[at], le[at])
    return best


def judged(boxes: list[np.ndarray], score: np.ndarray, lt: np.ndarray, le: np.ndarray, v: np.ndarray, match: list[float], birth: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (match, birth, row) and the place of the first least gap (match, row), from 1, where the order is reversed. ``boxes, score``: of exposed candidates."""
    n, m, rows = v.shape
    codes = np.empty((len(match), len(birth), rows), np.int8)
    culprit = np.zeros((len(match), rows), np.int8)
    to = associated(v, lt, le, min(match))
    at = np.maximum(to, 0)
    here = np.arange(n)[:, None] < lt
    if m:
        own = np.take_along_axis(v, at[:, None, :], 1)[:, 0]
        scores = np.take_along_axis(score, at, 0)
    else:
        own = scores = np.zeros((n, rows))
    gap = np.where(here[1:], scores[:1] - scores[1:], np.inf)
    least = gap.min(axis=0) if n > 1 else np.full(rows, -np.inf)
    first = gap.argmin(axis=0) + 1 if n > 1 else np.zeros(rows, int)
    least = np.where(lt > 1, least, -np.inf)
    for k, limit in enumerate(match):
        found = (to >= 0) & (own >= limit)
        code = np.where(~found[0], WINNER, np.where((here & ~found).any(axis=0), COMPETITOR, np.where(least > 0, STABLE, REVERSAL))).astype(np.int8)
        culprit[k] = np.where((code == REVERSAL) & (lt > 1), first, 0)
        codes[k] = code
        whole = np.flatnonzero((code == STABLE) | (code == REVERSAL))  # all are found: births decide
        new = (score[:, whole] >= scores[0, whole]) & (np.arange(m)[:, None] < le[whole])
        for i in range(n):
            new &= ~((np.arange(m)[:, None] == to[i, whole]) & here[i, whole])
        some = new.any(axis=0)
        whole, new = whole[some], new[:, some]
        if len(whole):
            near = np.zeros(new.shape)
            cand = [x[:, whole] for x in boxes]
            for i in range(n):
                near = np.maximum(near, np.where(here[i, whole], iou([x[at[i, whole], whole] for x in boxes], cand), 0.0))
            for b, most in enumerate(birth):
                codes[k, b, whole[(new & ~(near >= most)).any(axis=0)]] = BIRTH
    return codes, culprit


def outcomes(clean: Ranked, perturbed: Ranked, rows: np.ndarray, tracked: list[int], exposed: list[int], match: list[float], birth: list[float], duplicate: float):  # noqa: ANN201
    """``codes`` (tracked, exposed, match, birth, row), ``culprit`` (tracked, exposed, match, row) and the numbers of tracked and exposed candidates
    at the largest counts. Counts beyond a list's length give the same lists, so each is judged once for each pair of lengths."""
    t_boxes, _, n_t = distinct(clean, rows, max(tracked), duplicate)
    e_boxes, e_score, n_e = distinct(perturbed, rows, max(exposed), duplicate)
    codes = np.full((len(tracked), len(exposed), len(match), len(birth), len(rows)), NONE, np.int8)
    culprit = np.zeros((len(tracked), len(exposed), len(match), len(rows)), np.int8)
    v = iou([x[:, None] for x in t_boxes], [x[None] for x in e_boxes])
    before = None
    for i in np.argsort(tracked, kind="stable"):
        lt = np.minimum(tracked[i], n_t)
        left = None
        for j in np.argsort(exposed, kind="stable"):
            le = np.minimum(exposed[j], n_e)
            todo = n_t >= 2
            for other in (before and (before[0], j, before[1], le), left and (i, left[0], lt, left[1])):
                if other:
                    same = todo & (other[2] == lt) & (other[3] == le)
                    codes[i, j][..., same], culprit[i, j][..., same] = codes[other[0], other[1]][..., same], culprit[other[0], other[1]][..., same]
                    todo = todo & ~same
            at = np.flatnonzero(todo)
            if len(at):
                t, e = int(lt[at].max()), int(le[at].max())
                codes[i, j][..., at], culprit[i, j][..., at] = judged([x[:e, at] for x in e_boxes], e_score[:e, at], lt[at], le[at], v[:t, :e, at], match, birth)
            left = (j, le)
        before = (i, lt)
    return codes, culprit, n_t, n_e


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def grouped(batch: pa.RecordBatch, by: list[str]) -> tuple[list[tuple], np.ndarray]:
    """The distinct values of ``by`` and the place of each row's."""
    codes, values = np.zeros(batch.num_rows, np.int64), [()]
    for c in by:
        d = column(batch, c).dictionary_encode(null_encoding="encode")
        own = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes, own = np.unique(codes * len(d.dictionary) + own, return_inverse=True)
        values = [(*values[x // len(d.dictionary)], d.dictionary[int(x % len(d.dictionary))].as_py()) for x in codes.tolist()]
        codes = own
    return values, codes


def judgements(pairs: DataFrame, contract: OutputContract | None = None, keys: tuple[str, ...] = ("ref_id", "r")) -> DataFrame:
    """The scalars of :func:`.outcome.evaluated`: ``keys, clean_eligible, exposed`` (a number), ``coverage, rank_stable, operational_stable, primary_failure, culprit_clean_index``."""
    c = contract or OutputContract()
    data = pairs.select(*keys, "clean_candidates", "perturbed_candidates")
    found = [T.StructField(x, T.ByteType(), False) for x in ("ox_code", "ox_culprit")] + [T.StructField(x, T.IntegerType(), False) for x in ("n_t", "n_e")]
    schema = T.StructType([*[data.schema[k] for k in keys], *found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, perturbed = ranked(column(batch, "clean_candidates")), ranked(column(batch, "perturbed_candidates"))
            out = [np.zeros(batch.num_rows, t) for t in (np.int8, np.int8, np.int32, np.int32)]
            for rows in blocks(clean.n, perturbed.n):
                codes, culprit, n_t, n_e = outcomes(clean, perturbed, rows, [c.tracked_candidate_count], [c.exposed_candidate_count], [c.match_iou_threshold], [c.birth_duplicate_iou_threshold], c.duplicate_iou_threshold)
                for o, x in zip(out, (codes[0, 0, 0, 0], culprit[0, 0, 0], n_t, n_e)):
                    o[rows] = x
            yield pa.RecordBatch.from_arrays([*[column(batch, k) for k in keys], *map(pa.array, out)], names=[*keys, *[f.name for f in found]])

    a = data.mapInArrow(run, schema)
    eligible, code = F.col("n_t") >= 2, F.col("ox_code").cast("int")
    judged_, covered = code != NONE, (code == STABLE) | (code == REVERSAL)
    return a.select(
        *keys, eligible.cast("int").alias("clean_eligible"), F.when(eligible, F.col("n_e")).otherwise(F.lit(0)).alias("exposed"), F.when(judged_, covered.cast("int")).alias("coverage"),
        F.when(covered, (code == STABLE).cast("int")).alias("rank_stable"), F.when(judged_, (code == STABLE).cast("int")).alias("operational_stable"),
        F.when(judged_, F.get(F.array(*map(F.lit, CLASSES)), code)).alias("primary_failure"), F.when((code == REVERSAL) & (F.col("ox_culprit") > 0), F.col("ox_culprit").cast("int")).alias("culprit_clean_index"),
    )


def distinct_counts(lists: DataFrame, name: str, most: int, limits: list[float], by: list[str], sizes: tuple[str, ...] = ()) -> DataFrame:
    """``by``, the lengths of the lists ``sizes`` (-1: missing), ``kept`` (how many candidates of ``name`` suppression keeps at each limit) and ``rows``, how many lists that
    holds for: each task counts its own."""
    data = lists.select(*by, name, *[F.coalesce(F.size(c), F.lit(-1)).alias(f"n_{c}") for c in sizes])
    schema = T.StructType([*[data.schema[c] for c in by], *[T.StructField(f"n_{c}", T.IntegerType()) for c in sizes], T.StructField("kept", T.ArrayType(T.IntegerType())), T.StructField("rows", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            arrays = [pa.array([k[i] for k in keys], type=types[c]) for i, c in enumerate(by)]
            arrays += [pa.array([k[len(by) + i] for k in keys], type=pa.int32()) for i in range(len(sizes))]
            arrays += [pa.array([list(k[len(by) + len(sizes) :]) for k in keys], type=pa.list_(pa.int32())), pa.array(list(held.values()), type=pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        types: dict[str, pa.DataType] = {}
        for batch in batches:
            types = {c: column(batch, c).type for c in by}
            values, group = grouped(batch, by)
            own = ranked(column(batch, name))
            lengths = [column(batch, f"n_{c}").to_numpy() for c in sizes]
            n = np.zeros((len(limits), batch.num_rows), np.int64)
            for rows in blocks(own.n):
                boxes, _, real = own.padded(rows)
                n[:, rows] = [k.sum(axis=0) for k in kept(boxes, real, most, limits)]
            found, times = np.unique(np.stack([group, *lengths, *n]), axis=1, return_counts=True)
            for x, k in zip(found.T.tolist(), times.tolist()):
                key = (*values[x[0]], *x[1:])
                held[key] = held.get(key, 0) + k
            if len(held) > CELLS:
                yield out()
        if held:
            yield out()

    return data.mapInArrow(run, schema)
