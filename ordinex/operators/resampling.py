"""Seeded resampling on the executors, repeatable by arithmetic alone.

Draws are whole-number arithmetic on a unit's key, the repetition, a slot and a seed
(:func:`uniform`), so another engine can repeat them digit by digit, results don't depend
on how rows are dealt, and groups that share keys are paired. A unit's weight in a
repetition is Poisson(1), by which no task needs all units of a group; a second stage
draws each of a unit's trials anew (:func:`trials`). Each task adds up its units' shares of
all repetitions before anything is sent: what is shuffled are sums of groups and repetitions.

Defined results: units with a null key count as key 0; nulls in a value count as 0; an empty
table gives no rows; a repetition whose weights are all 0 has the value 0 for a ratio.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import column, grouped
from .shared import materialize
from .statistics import spearman

#: The modulus, multipliers and shifts of the draws.
MODULUS, FACTORS, SHIFTS = 1 << 31, (569420461, 1935289751), (16, 15, 15)
SEED_STEP, REP_STEP, SLOT_STEP = 747796405, 1013904223, 668265263
#: Cumulative probabilities of Poisson(1), as far as the modulus tells them apart.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
#: Numbers in a block of units and repetitions (few, so that they stay near the processor), and in what a task holds.
CELLS, HELD = 1 << 17, 1 << 21

#: Of units' columns: the share of each copy of a unit by name; which units' trials have to be drawn instead, and how: of
#: their columns, weights and states to a share (units, repetitions) for each name.
Drawn = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], dict[str, np.ndarray]]
Shares = Callable[[dict[str, np.ndarray]], tuple[dict[str, np.ndarray], np.ndarray | None, Drawn | None]]


def _mixed(x: np.ndarray) -> np.ndarray:
    """In place, on 32-bit numbers: what they lose above lies above the modulus."""
    x ^= x >> SHIFTS[0]
    for factor, shift in zip(FACTORS, SHIFTS[1:]):
        x *= np.uint32(factor)
        x &= np.uint32(MODULUS - 1)
        x ^= x >> shift
    return x


def states(key: np.ndarray, rep: np.ndarray, seed: int) -> np.ndarray:
    """What the draws of each key (rows) and repetition (columns) start from."""
    x = _mixed(((key.astype(np.int64) % MODULUS + seed * SEED_STEP) % MODULUS).astype(np.uint32))[:, None]
    x = x + (rep.astype(np.int64) * REP_STEP % MODULUS).astype(np.uint32)[None, :]
    x &= np.uint32(MODULUS - 1)
    return _mixed(x)


def numbers(state: np.ndarray, slot: np.ndarray | int) -> np.ndarray:
    """A whole number below the modulus for each state and slot."""
    x = state + (np.asarray(slot, np.int64) * SLOT_STEP % MODULUS).astype(np.uint32)
    x &= np.uint32(MODULUS - 1)
    return _mixed(x)


def drawn(state: np.ndarray, slot: np.ndarray | int) -> np.ndarray:
    """A number above 0 and below 1 for each state and slot."""
    return (numbers(state, slot) + 0.5) / MODULUS


def limits(p: np.ndarray) -> np.ndarray:
    """How many of the whole numbers are drawn as below each probability."""
    return np.ceil(np.clip(p, 0, 1) * MODULUS - 0.5).astype(np.uint32)


def weights(state: np.ndarray) -> np.ndarray:
    """Each unit's weight in each repetition: how many cumulative probabilities its draw is above."""
    x, w = numbers(state, 0), np.zeros(state.shape, np.uint8)
    for above in (np.floor(POISSON * MODULUS - 0.5) + 1).astype(np.int64).tolist():
        if above < MODULUS:
            w += x >= np.uint32(above)
    return w


def uniform(key: np.ndarray, rep: np.ndarray, slot: int, seed: int) -> np.ndarray:
    """A number above 0 and below 1 for each key (rows) and repetition (columns)."""
    return drawn(states(key, rep, seed), slot)


def uniform_sql(source: str, key: str, seed: int, repetitions: int, slots: str = "0", weighted: str | None = None, where: str = "true") -> str:
    """The same draws in SQL: a query for ``source``'s columns with ``rep``, ``slot`` and ``u``; ``slots`` lists slot numbers, of which
    ``where`` keeps some. ``weighted``: instead of ``source`` a query of its columns, ``rep`` and more, to draw for its rows alone."""

    def mixed(inner: str, keep: str) -> str:
        q = f"SELECT {keep}, xor(x, x >> {SHIFTS[0]}) AS x FROM ({inner})"
        for factor, shift in zip(FACTORS, SHIFTS[1:]):
            q = f"SELECT {keep}, xor(x, x >> {shift}) AS x FROM (SELECT {keep}, x * {factor} % {MODULUS} AS x FROM ({q}))"
        return q

    reps = weighted or f"(SELECT * FROM {source}, range({repetitions}) r(rep))"
    one = mixed(f"SELECT *, (({key})::BIGINT % {MODULUS} + {seed * SEED_STEP}) % {MODULUS} AS x FROM {reps}", "* EXCLUDE (x)")
    two = mixed(f"SELECT * EXCLUDE (x), (x + rep * {REP_STEP}) % {MODULUS} AS x FROM ({one})", "* EXCLUDE (x)")
    three = mixed(f"SELECT * EXCLUDE (x), (x + slot * {SLOT_STEP}) % {MODULUS} AS x FROM ({two}), (SELECT unnest([{slots}])::BIGINT AS slot) WHERE {where}", "* EXCLUDE (x)")
    return f"SELECT * EXCLUDE (x), (x + 0.5::DOUBLE) / {MODULUS} AS u FROM ({three})"


def weight_sql(u: str = "u") -> str:
    """A unit's weight of its draw, in SQL."""
    return "(" + " + ".join(f"({u} > {c!r}::DOUBLE)::INT" for c in POISSON.tolist()) + ")"


Copies = Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]


def copies(n: np.ndarray, p: list[np.ndarray], weight: np.ndarray, state: np.ndarray) -> Copies:
    """Of each copy of a unit (as many as its weight) ``n`` trials drawn anew: places (unit, repetition), and how many trials are
    below each of the unit's probabilities ``p`` (nested events)."""
    n, most = n.astype(np.int64), [limits(x) for x in p]
    for c in range(int(weight.max(initial=0))):
        rows, cols = np.nonzero((weight > c) & (n > 0)[:, None])
        size, hits = n[rows], [np.zeros(len(rows)) for _ in p]
        start = state[rows, cols]
        for i in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > i)
            u = numbers(start[on], 1 + c * size[on] + i)
            for h, x in zip(hits, most):
                h[on] += u < x[rows[on]]
        yield rows, cols, hits


def trials(n: np.ndarray, p: list[np.ndarray], state: np.ndarray) -> list[np.ndarray]:
    """The hits of each unit's one copy, (units, repetitions)."""
    n, most = n.astype(np.int64), [limits(x)[:, None] for x in p]
    out = [np.zeros(state.shape) for _ in p]
    for i in range(int(n.max(initial=0))):
        on = np.flatnonzero(n > i)
        u = numbers(state[on], 1 + i)
        for o, x in zip(out, most):
            o[on] += u < x[on]
    return out


def resampled(units: DataFrame, by: list[str], key: str, columns: list[str], shares: Shares, names: list[str], repetitions: int, seed: int) -> DataFrame:
    """``by, rep`` and the sums of ``names`` over units. Units are dealt and sorted by key, so that those which share draws meet:
    a key's weights are drawn once for all its units, and the sums of shares that don't depend on trials are one product of
    matrices in a block. Only units whose trials can come out in more than one way draw them."""
    data = units.select(*by, F.coalesce(F.col(key), F.lit(0)).cast("long").alias("ox_key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"ox_{c}") for c in columns])
    schema = T.StructType([*[data.schema[c] for c in by], T.StructField("rep", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    reps = np.arange(repetitions)
    block = max(1, CELLS // max(repetitions, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def out() -> Iterator[pa.RecordBatch]:
            for group, sums in totals.items():
                same = [pa.array([v] * repetitions, type=t) for v, t in zip(group, types)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(reps), *map(pa.array, sums)], names=schema.names)
            totals.clear()

        def add(groups: np.ndarray, sums: np.ndarray, values: list[tuple]) -> None:
            for g, x in zip(groups.tolist(), sums):
                totals[values[g]] = totals[values[g]] + x if values[g] in totals else x

        for batch in batches:
            types = [column(batch, c).type for c in by]
            values, group = grouped(batch, by)
            keys, unit = np.unique(column(batch, "ox_key").to_numpy(), return_inverse=True)
            order = np.argsort(unit, kind="stable")
            unit, group = unit[order], group[order]
            cols = {c: column(batch, f"ox_{c}").to_numpy()[order] for c in columns}
            fixed, todo, draw = shares(cols)
            fixed = np.stack([np.broadcast_to(np.asarray(fixed.get(n, 0.0), float), len(unit)) for n in names])
            for at in range(0, len(keys), block):
                rows = slice(*np.searchsorted(unit, [at, at + block]))
                here, own = np.unique(group[rows], return_inverse=True)
                state = states(keys[at : at + block], reps, seed)
                w = weights(state)
                a = np.zeros((len(here), len(names), len(state)))
                np.add.at(a, (own[None, :], np.arange(len(names))[:, None], unit[rows][None, :] - at), fixed[:, rows])
                sums = (a.reshape(-1, len(state)) @ w.astype(float)).reshape(len(here), len(names), repetitions)
                some = np.flatnonzero(todo[rows]) if todo is not None else ()
                for k in range(0, len(some), block):
                    part = some[k : k + block]
                    of = unit[rows][part] - at
                    found = draw({c: x[rows][part] for c, x in cols.items()}, w[of], state[of])
                    for g in np.unique(own[part]).tolist():
                        for n, x in found.items():
                            sums[g, names.index(n)] += x[own[part] == g].sum(axis=0)
                add(here, sums, values)
            if len(totals) * repetitions * len(names) > HELD:
                yield from out()
        yield from out()

    dealt = data.repartition("ox_key").sortWithinPartitions("ox_key")
    return dealt.mapInArrow(run, schema).groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in names])


def intervals(draws: DataFrame, by: list[str], value: str) -> DataFrame:
    """Percentile interval (95 %), median and spread of the repetitions' values; values that are not finite are dropped."""
    v = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    g = draws.groupBy(*by).agg(F.percentile(v, [0.025, 0.5, 0.975]).alias("q"), F.stddev_samp(v).alias("se"), F.avg(v).alias("mean"))
    return g.select(*by, F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("upper"), "mean", "se")


def stacked(draws: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """A row for each repetition and statistic: ``by, rep, statistic, value``."""
    return draws.select(*by, "rep", F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), v.cast("double").alias("value")) for n, v in values.items()])).alias("s")).select(*by, "rep", "s.statistic", "s.value")


def _over(n: str, d: str, none: float | None = 0.0) -> Column:
    return F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(none))


def _weighted(*columns: str) -> Shares:
    return lambda c: ({**{n: c[n] for n in columns}, "w": 1.0}, None, None)


def _rate(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.divide(k, n, out=np.zeros_like(k), where=n > 0)


def _open(p: np.ndarray) -> np.ndarray:
    """Where a trial may hit or miss."""
    return (p > 0) & (p < 1)


def bootstrap_ratios(units: DataFrame, by: list[str], numerator: str, denominator: str | None = None, key: str = "ref_id", repetitions: int = 2000, seed: int = 0) -> DataFrame:
    """Intervals of a ratio of sums over units (the mean, without a denominator)."""
    columns = [numerator] + ([denominator] if denominator else [])
    draws = resampled(units, by, key, columns, _weighted(*columns), [*columns, "w"], repetitions, seed)
    return intervals(draws.withColumn("m", _over(numerator, denominator or "w")), by, "m")


def bootstrap_means(units: DataFrame, by: list[str], value: str, key: str = "ref_id", repetitions: int = 2000, seed: int = 0) -> DataFrame:
    return bootstrap_ratios(units, by, value, None, key, repetitions, seed)


def bootstrap_deltas(units: DataFrame, group: str, value: str, key: str = "ref_id", repetitions: int = 2000, seed: int = 0) -> DataFrame:
    """Intervals of the difference of means for each pair of groups. Groups with common keys are paired; without, independent."""
    m = resampled(units, [group], key, [value], _weighted(value), [value, "w"], repetitions, seed).select(group, "rep", _over(value, "w").alias("m"))
    return intervals(_pairs(m, group, ["rep"], "m"), ["group_a", "group_b"], "gap")


def _pairs(values: DataFrame, group: str, on: list[str], value: str) -> DataFrame:
    a, b = values.select(F.col(group).alias("group_a"), *on, F.col(value).alias("ma")), values.select(F.col(group).alias("group_b"), *on, F.col(value).alias("mb"))
    return a.join(b, on).filter("group_a < group_b").withColumn("gap", F.col("ma") - F.col("mb"))


def bootstrap_minimum_gaps(values: DataFrame, group: str, setting: str, value: str, key: str = "ref_id", repetitions: int = 2000, seed: int = 0) -> DataFrame:
    """Intervals of the least gap over all settings, taken inside each repetition, for each pair of groups."""
    m = resampled(values, [group, setting], key, [value], _weighted(value), [value, "w"], repetitions, seed).select(group, setting, "rep", _over(value, "w").alias("m"))
    least = _pairs(m, group, [setting, "rep"], "m").groupBy("group_a", "group_b", "rep").agg(F.min("gap").alias("gap"))
    return intervals(least, ["group_a", "group_b"], "gap")


def hierarchical(units: DataFrame, group: str, by: list[str], n: str, k: str, key: str = "ref_id", repetitions: int = 2000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Units and, within each, its trials drawn anew: intervals of the mean of units' means by group, and of the gaps of
    groups, which share draws. A unit drawn several times has one draw of trials. ``k`` of ``n`` trials succeeded; a unit without
    trials has the mean 0."""

    def draw(c: dict, w: np.ndarray, state: np.ndarray) -> dict:
        (hits,) = trials(c[n], [_rate(c[k], c[n])], state)
        return {"m": w * hits / np.maximum(c[n], 1)[:, None]}

    def shares(c: dict) -> tuple:
        p = _rate(c[k], c[n])
        return {"m": (p >= 1).astype(float), "w": 1.0}, _open(p), draw

    m = resampled(units, [group, *by], key, [n, k], shares, ["m", "w"], repetitions, seed).select(group, *by, "rep", _over("m", "w").alias("m"))
    return intervals(m, [group, *by], "m"), intervals(_pairs(m, group, [*by, "rep"], "m"), ["group_a", "group_b", *by], "gap")


def nested(units: DataFrame, by: list[str], key: str = "ref_id", repetitions: int = 2000, seed: int = 0) -> DataFrame:
    """Intervals of eight statistics of two nested events: units (``eligible, n, n_covered, n_stable``) and the trials of each copy drawn anew.
    Samples that are not eligible have as many trials in the full manifest as the mean eligible one."""

    def draw(c: dict, w: np.ndarray, state: np.ndarray) -> dict:
        covered, stable = np.zeros(state.shape), np.zeros(state.shape)
        for rows, cols, (a, b) in copies(c["n"] * c["eligible"], [_rate(c[x], c["n"]) for x in ("n_covered", "n_stable")], w, state):
            covered[rows, cols] += a
            stable[rows, cols] += b
        return {"c": covered, "s": stable}

    def shares(c: dict) -> tuple:
        n = c["n"] * c["eligible"]
        p, q = (_rate(c[x], c["n"]) for x in ("n_covered", "n_stable"))
        todo = (n > 0) & (_open(p) | _open(q))
        sure = lambda x: np.where(~todo & (x >= 1), n, 0.0)
        return {"w": 1.0, "e": c["eligible"], "t": n, "c": sure(p), "s": sure(q)}, todo, draw

    d = resampled(units, by, key, ["eligible", "n", "n_covered", "n_stable"], shares, ["w", "e", "t", "c", "s"], repetitions, seed)
    gamma, cov, cc, op = _over("e", "w", None), _over("c", "t", None), _over("s", "c", None), _over("s", "t", None)
    full = gamma * op
    values = {"clean_eligibility": gamma, "coverage": cov, "complete_case": cc, "eligible_operational": op, "full_operational": full, "coverage_optimism": cc - op, "eligibility_optimism": op - full, "total_optimism": cc - full}
    return intervals(stacked(d, by, values), [*by, "statistic"], "value")


def predictor_differences(pairs: DataFrame, by: list[str], one: str, two: str, target: str, key: str = "ref_id", repetitions: int = 2000, seed: int = 0) -> DataFrame:
    """Intervals of what predictor ``one`` is worse than ``two`` by: mean absolute error, Brier score, absolute bias. Rows without ``one`` don't count."""

    def shares(c: dict) -> tuple:
        out = {"w": 1.0}
        for name, p in (("1", c[one]), ("2", c[two])):
            t = c[target]
            out |= {"a" + name: np.abs(p - t), "b" + name: p * p - 2 * p * t + t, "e" + name: p - t}
        return out, None, None

    names = ["w", *[a + b for a in "abe" for b in "12"]]
    d = resampled(pairs.filter(F.col(one).isNotNull()), by, key, [one, two, target], shares, names, repetitions, seed)
    m = {n: _over(n, "w") for n in names[1:]}
    values = {"mae_advantage": m["a1"] - m["a2"], "brier_advantage": m["b1"] - m["b2"], "absolute_bias_advantage": F.abs(m["e1"]) - F.abs(m["e2"])}
    return intervals(stacked(d, by, values), [*by, "statistic"], "value")


def severity_curves(cells: DataFrame, samples: DataFrame, group: str, by: list[str], key: str = "ref_id", repetitions: int = 2000, seed: int = 0) -> DataFrame:
    """Intervals of stability by severity over the full manifest: resampled eligibility times resampled success. ``cells``:
    ``group, by, key, trials, stable`` of eligible samples; ``samples``: ``group, key, eligible``. Both share draws."""
    e = resampled(samples, [group], key, ["eligible"], _weighted("eligible"), ["eligible", "w"], repetitions, seed).select(group, "rep", _over("eligible", "w").alias("e"))
    r = resampled(cells, [group, *by], key, ["stable", "trials"], lambda c: ({n: c[n] for n in ("stable", "trials")}, None, None), ["stable", "trials"], repetitions, seed)
    return intervals(r.join(e, [group, "rep"]).withColumn("m", F.col("e") * _over("stable", "trials")), [group, *by], "m")


def component_intervals(units: DataFrame, by: list[str], n: str, k: str, key: str = "ref_id", repetitions: int = 2000, seed: int = 0) -> DataFrame:
    """Intervals of the estimand and its variance components, units and the trials of each copy drawn anew; units of two trials or more."""

    def draw(c: dict, w: np.ndarray, state: np.ndarray) -> dict:
        out = {x: np.zeros(state.shape) for x in "mqvz"}
        for rows, cols, (hits,) in copies(c[n], [c[k] / c[n]], w, state):
            r = c[n][rows]
            m = hits / r
            v = r / (r - 1) * m * (1 - m)
            for x, share in (("m", m), ("q", m * m), ("v", v), ("z", v / r)):
                out[x][rows, cols] += share
        return out

    def shares(c: dict) -> tuple:
        p = c[k] / c[n]
        sure = (p >= 1).astype(float)  # all or none hit: no spread
        return {"w": 1.0, "r": c[n], "m": sure, "q": sure}, _open(p), draw

    d = resampled(units.filter(F.col(n) >= 2), by, key, [n, k], shares, ["w", "m", "q", "v", "z", "r"], repetitions, seed).filter("w > 1")
    theta, within, w = F.col("m") / F.col("w"), F.col("v") / F.col("w"), F.col("w")
    between = F.greatest(F.lit(0.0), (F.col("q") - F.col("m") * theta) / (w - 1) - F.col("z") / w)
    values = {
        "theta": theta, "between": between, "within": within, "icc": F.when(between + within > 0, between / (between + within)).otherwise(F.lit(0.0)),
        "crossover": F.when(between > 0, within / between), "standard_error": F.sqrt(between / w + within / F.col("r")),
    }
    return intervals(stacked(d, by, values), [*by, "statistic"], "value")


def split_halves(units: DataFrame, by: list[str], family: str, n: str, k: str, eligible: str, key: str = "ref_id", repetitions: int = 200, seed: int = 0) -> DataFrame:
    """Random halves of each unit's trials, balanced by family: ``by, scope, rep`` and how many units have ``left`` and ``right``.

    A family's half is drawn from its trials without putting back, one by one. ``units``: ``by, key, eligible`` and ``cells``: a
    list of (n, k) in the order of families, each ``n`` even; an odd one is an error. An ineligible unit's halves are 0.
    """
    cells = F.transform(F.array_sort(F.collect_list(F.struct(F.col(family).alias("f"), F.col(n).cast("long").alias("n"), F.col(k).cast("long").alias("k")))), lambda x: F.struct(x["n"], x["k"]))
    odd = F.when(F.col(n) % 2 != 0, F.raise_error(F.lit("a family has an odd number of probes")).cast("long")).otherwise(F.col(n))
    data = units.withColumn(n, odd).groupBy(*by, key).agg(F.coalesce(F.max(eligible), F.lit(0)).cast("int").alias("ox_e"), cells.alias("ox_cells"))
    data = data.select(*by, F.coalesce(F.col(key), F.lit(0)).cast("long").alias("ox_key"), "ox_e", "ox_cells")
    counts = [T.StructField("scope", T.StringType()), T.StructField("rep", T.LongType()), T.StructField("left", T.DoubleType()), T.StructField("right", T.DoubleType()), T.StructField("units", T.LongType())]
    schema = T.StructType([*[data.schema[c] for c in by], *counts])
    reps = np.arange(repetitions)
    block = max(1, CELLS // repetitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}  # of (group, eligible, halves, good): units by hits on the left and repetition
        types: list[pa.DataType] = []

        def out() -> Iterator[pa.RecordBatch]:
            for (group, ok, half, good), x in held.items():
                hits, rep = np.nonzero(x)
                for scope in ("full_manifest", "clean_eligible")[: 1 + ok]:
                    same = [pa.array([v] * len(rep), type=t) for v, t in zip((*group, scope), [*types, pa.string()])]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(rep.astype(np.int64)), pa.array(hits / half), pa.array((good - hits) / half), pa.array(x[hits, rep])], names=schema.names)
            held.clear()

        for batch in batches:
            types = [column(batch, c).type for c in by]
            values, group = grouped(batch, by)
            lists = column(batch, "ox_cells")
            length = pc.list_value_length(lists).to_numpy()
            size, good = (lists.flatten().field(c).to_numpy() for c in ("n", "k"))
            unit = np.repeat(np.arange(len(length)), length)
            ok = column(batch, "ox_e").to_numpy() != 0
            half = size // 2
            sums = lambda x: np.bincount(unit, x * ok[unit], len(length)).astype(np.int64)  # noqa: E731, B023
            all_half, all_good, sure = np.maximum(sums(half), 1), sums(good), sums(np.where(good >= size, half, 0))
            # A unit's slots are its own: a family's follow those of the families before.
            slot = 1 + np.cumsum(half) - half
            slot -= (slot[(np.cumsum(length) - length)[length > 0]] - 1).repeat(length[length > 0])
            kinds, kind = np.unique(np.stack([group, ok, np.where(ok, all_half, 1), all_good]), axis=1, return_inverse=True)
            kinds, kind = kinds.T.tolist(), kind.reshape(-1)
            tables = []
            for g, e, h, t in kinds:
                tables.append(held.setdefault((values[g], e, h, t), np.zeros((h + 1, repetitions), np.int64)))
            todo = np.flatnonzero((good > 0) & (good < size) & ok[unit])
            open_ = np.zeros(len(length), bool)
            open_[unit[todo]] = True
            pairs, times = np.unique(np.stack([kind, sure])[:, ~open_], axis=1, return_counts=True)
            for (c, hits), m in zip(pairs.T.tolist(), times.tolist()):
                tables[c][hits] += m
            first = np.array([0, *np.cumsum([h + 1 for _, _, h, _ in kinds])])
            keys, drawing = column(batch, "ox_key").to_numpy(), np.flatnonzero(open_)
            for at in range(0, len(drawing), block):
                rows = drawing[at : at + block]
                cells_ = todo[slice(*np.searchsorted(unit[todo], [rows[0], rows[-1] + 1]))]
                state = states(keys[rows], reps, seed)
                here = np.repeat(sure[rows][:, None], repetitions, 1)
                place = np.searchsorted(rows, unit[cells_])
                turn = np.arange(len(place)) - np.searchsorted(place, place)  # which open family of its unit
                for t in range(int(turn.max()) + 1):
                    some = cells_[turn == t]
                    of = place[turn == t]
                    rest, won = np.repeat(good[some][:, None], repetitions, 1).astype(float), np.zeros((len(some), repetitions), np.int64)
                    for j in range(int(half[some].max())):
                        on = np.flatnonzero(half[some] > j)
                        hit = drawn(state[of[on]], (slot[some[on]] + j)[:, None]) * (size[some[on]] - j)[:, None] < rest[on]
                        won[on] += hit
                        rest[on] -= hit
                    here[of] += won
                found = np.bincount(((first[kind[rows]][:, None] + here) * repetitions + reps).ravel(), minlength=first[-1] * repetitions).reshape(-1, repetitions)
                for c in np.unique(kind[rows]).tolist():
                    tables[c] += found[first[c] : first[c + 1]]
            if sum(x.size for x in held.values()) > HELD:
                yield from out()
        yield from out()

    return data.mapInArrow(run, schema).groupBy(*by, "scope", "rep", "left", "right").agg(F.sum("units").alias("units"))


def paired_metrics(cells: DataFrame, by: list[str], left: str = "left", right: str = "right", units: str | None = None) -> DataFrame:
    """Seven measures of two values of the same units: both means, signed and absolute difference of the means, mean absolute
    and root mean square difference, rank correlation. ``units``: how many units a row stands for."""
    u = F.col(units) if units else F.lit(1)
    c = cells.select(*by, F.col(left).alias("left"), F.col(right).alias("right"), u.alias("units")).groupBy(*by, "left", "right").agg(F.sum("units").alias("units"))
    c = materialize(c, "paired-values")  # few rows, named four times
    d, n = F.col("left") - F.col("right"), F.col("units")
    mean = lambda x: F.sum(n * x) / F.sum(n)
    g = c.groupBy(*by).agg(mean(F.col("left")).alias("mean_left"), mean(F.col("right")).alias("mean_right"), mean(d).alias("signed_difference"), F.abs(mean(d)).alias("absolute_difference"), mean(F.abs(d)).alias("sample_mae"), F.sqrt(mean(d * d)).alias("sample_rmse"))
    return g.join(spearman(c, by, "left", "right", "units").drop("n").withColumnRenamed("spearman", "sample_spearman"), by)


def split_half_summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, 2.5, 97.5 and 95 % points of each measure over the repetitions; missing values are dropped."""
    names = ("absolute_difference", "sample_mae", "sample_rmse", "sample_spearman")
    long = metrics.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("s")).select(*by, "s.metric", "s.v").filter("v IS NOT NULL")
    g = long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.percentile("v", [0.5, 0.025, 0.975, 0.95]).alias("q"), F.count("v").alias("repetitions"))
    return g.select(*by, "metric", "mean", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("median", "lower", "upper", "p95"))], "repetitions")


def nested_validation(units: DataFrame, by: list[str], n: str, k: str, unit_grid: list[int], probe_grid: list[int], repetitions: int = 1000, seed: int = 0) -> DataFrame:
    """The variance formula against resampling: units and probes drawn anew from the observed rates, at each number of both (and
    all units), beside the formula with plug-in components. A group's rates are few distinct numbers; what goes to one task are these."""
    p = F.col(k) / F.col(n)
    cells = units.filter(F.col(n) > 0).groupBy(*by, p.alias("p")).agg(F.count(F.lit(1)).alias("units"))
    kind = {f.name: f.dataType.simpleString() for f in units.schema.fields}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("p")
        share, rate, total = g["units"].to_numpy() / g["units"].sum(), g["p"].to_numpy(), int(g["units"].sum())
        theta, within = float(share @ rate), float(share @ (rate * (1 - rate)))
        between = float(share @ (rate - theta) ** 2)
        rng = np.random.default_rng([seed, *[int.from_bytes(str(g[c].iloc[0]).encode(), "little") for c in by]])
        rows = []
        for units_ in sorted({x for x in (*unit_grid, total) if x <= total}):
            for probes in probe_grid:
                drawn = rng.multinomial(units_, share, size=repetitions)
                estimates = rng.binomial(drawn * probes, rate).sum(axis=1) / (units_ * probes)
                predicted = between / units_ + within / (units_ * probes)
                found = float(estimates.var(ddof=1))
                rows.append((*[g[c].iloc[0] for c in by], units_, probes, theta, between, within, float(estimates.mean() - theta), found, predicted, found / predicted if predicted > 0 else None))
        return pd.DataFrame(rows, columns=[*by, "units", "probes", "theta", "between", "within", "bias", "empirical_variance", "predicted_variance", "variance_ratio"])

    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in by), "units long, probes long, theta double, between double, within double, bias double, empirical_variance double, predicted_variance double, variance_ratio double"])
    return cells.groupBy(*by).applyInPandas(run, schema)
