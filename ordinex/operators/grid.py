"""Contract grids: each probe is judged once for each pair of list lengths, then thresholds.

Suppression is prefix-closed, so lists are reduced once at the largest counts and sliced. Counts beyond a list's
length give the same lists, so each probe is associated once for each distinct pair of lengths; association doesn't depend
on the thresholds. A settings' table never holds rows of probes and settings: tasks count them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import FAILURES, ratio
from .kernels import CLASSES, NONE, REVERSAL, STABLE, blocks, column, distinct_counts, grouped, outcomes, ranked
from .shared import materialize

#: The factors of a setting, in the order of their nesting.
FACTORS = ["kt", "ke", "match", "birth"]
#: The most settings and groups whose counts a task holds.
HELD = 1 << 17


def _weighted(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``pairs`` with ``weight``, a probe's share of its sample; a table that has the column keeps it."""
    if "weight" in pairs.columns:
        return pairs
    return pairs.join(pairs.groupBy(*keys[:-1]).agg((1 / F.count(F.lit(1))).alias("weight")), list(keys[:-1]))


def _factors(index: Column, tracked: list[int], exposed: list[int], match: list[float], birth: list[float]) -> list[Column]:
    """``setting_index`` and the four factors of a setting."""
    values = [F.struct(F.lit(t).alias("kt"), F.lit(e).alias("ke"), F.lit(float(m)).alias("match"), F.lit(float(b)).alias("birth")) for t, e, m, b in product(tracked, exposed, match, birth)]
    s = F.get(F.array(*values), index)
    return [index.cast("int").alias("setting_index"), *[s[f].alias(f) for f in FACTORS]]


def replay(pairs: DataFrame, tracked: list[int], exposed: list[int], match: list[float], birth: list[float], duplicate: float = 0.7, keys: tuple[str, ...] = ("ref_id", "r")) -> DataFrame:
    """``keys``, the setting's columns and ``setting_index``, and the outcome under each setting: ``eligible, coverage, rank_stable,
    stable, failure`` (null where not eligible), ``exposed``, the exposed candidates at the largest count, and ``weight``, a probe's share
    of its sample: all keys but the last name a sample. ``pairs`` may have ``weight`` already."""
    data = _weighted(pairs, keys).select(*keys, F.col("weight").cast("double").alias("weight"), "clean_candidates", "perturbed_candidates")
    found = [T.StructField("n_t", T.IntegerType()), T.StructField("n_e", T.IntegerType()), T.StructField("codes", T.ArrayType(T.ByteType()))]
    kept = [*keys, "weight"]
    schema = T.StructType([*[data.schema[k] for k in kept], *found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, perturbed = ranked(column(batch, "clean_candidates")), ranked(column(batch, "perturbed_candidates"))
            for rows in blocks(clean.n, perturbed.n):
                codes, _, n_t, n_e = outcomes(clean, perturbed, rows, tracked, exposed, match, birth, duplicate)
                codes = codes.reshape(-1, len(rows)).T
                lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * codes.shape[1], codes.ravel())
                own = [column(batch, k).take(pa.array(rows)) for k in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_t.astype(np.int32)), pa.array(n_e.astype(np.int32)), lists], names=schema.names)

    a = data.mapInArrow(run, schema).select(*kept, "n_t", "n_e", F.posexplode("codes").alias("at", "code"))
    code = F.col("code").cast("int")
    covered = (code == STABLE) | (code == REVERSAL)
    return a.select(
        *keys, *_factors(F.col("at"), tracked, exposed, match, birth), (F.col("n_t") >= 2).cast("int").alias("eligible"), covered.cast("int").alias("coverage"), F.when(covered, (code == STABLE).cast("int")).alias("rank_stable"),
        (code == STABLE).cast("int").alias("stable"), F.when(code != NONE, F.get(F.array(*map(F.lit, CLASSES)), code)).alias("failure"), F.col("n_e").alias("exposed"), "weight",
    )


def settings(replayed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each setting's table row: samples, eligibility, probes of eligible samples, coverage, conditional order, stability over all
    and over eligible samples (means of samples' means, 0 for the ineligible), and the shares of failure classes. One aggregation: a
    sample's probes carry their shares of it."""
    by, keys = by or [], ["setting_index", *FACTORS]
    e, w = F.col("eligible"), F.col("weight")
    causes = [F.sum(e * (F.col("failure") == c).cast("int")).alias(c) for c in FAILURES]
    g = replayed.groupBy(*by, *keys).agg(
        F.round(F.sum(w)).cast("long").alias("samples"), F.round(F.sum(w * e)).cast("long").alias("eligible"), F.sum(e).alias("probes"), F.sum(e * F.col("coverage")).alias("covered"),
        F.sum(e * F.col("stable")).alias("stable"), F.sum(w * e * F.col("stable")).alias("total"), *causes,
    )
    return _rates(g, by)


def _rates(sums: DataFrame, by: list[str]) -> DataFrame:
    failures = sum((F.col(c) for c in FAILURES), F.lit(0))
    return sums.select(
        *by, "setting_index", *FACTORS, "samples", "eligible", (F.col("eligible") / F.col("samples")).alias("eligibility"), "probes",
        F.coalesce(ratio(F.col("covered"), F.col("probes")), F.lit(0.0)).alias("coverage"), ratio(F.col("stable"), F.col("covered")).alias("conditional"),
        (F.col("total") / F.col("samples")).alias("theta"), F.coalesce(ratio(F.col("total"), F.col("eligible")), F.lit(0.0)).alias("eligible_theta"),
        *[F.coalesce(ratio(F.col(c), failures), F.lit(0.0)).alias(f"{c}_share") for c in FAILURES],
    )


def table(pairs: DataFrame, tracked: list[int], exposed: list[int], match: list[float], birth: list[float], duplicate: float = 0.7, keys: tuple[str, ...] = ("ref_id", "r"), by: list[str] | None = None) -> DataFrame:
    """:func:`settings` of :func:`replay`, without a row for each probe and setting: a task adds up its probes' outcomes."""
    by, n = by or [], len(tracked) * len(exposed) * len(match) * len(birth)
    data = _weighted(pairs, keys).select(*by, F.col("weight").cast("double").alias("weight"), "clean_candidates", "perturbed_candidates")
    names = ["w", "we", "total", "probes", *CLASSES]
    schema = T.StructType([*[data.schema[c] for c in by], T.StructField("at", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def out() -> Iterator[pa.RecordBatch]:
            for group, sums in held.items():
                same = [pa.array([v] * n, type=t) for v, t in zip(group, types)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, sums)], names=schema.names)
            held.clear()

        for batch in batches:
            types = [column(batch, c).type for c in by]
            values, group = grouped(batch, by)
            weight = column(batch, "weight").to_numpy(zero_copy_only=False)
            clean, perturbed = ranked(column(batch, "clean_candidates")), ranked(column(batch, "perturbed_candidates"))
            for rows in blocks(clean.n, perturbed.n):
                codes, _, n_t, _ = outcomes(clean, perturbed, rows, tracked, exposed, match, birth, duplicate)
                codes = codes.reshape(n, len(rows))
                for g in np.unique(group[rows]).tolist():
                    at = np.flatnonzero(group[rows] == g)
                    own, w, e = codes[:, at], weight[rows[at]], n_t[at] >= 2
                    same = [np.full(n, x) for x in (w.sum(), (w * e).sum())]
                    counts = [np.count_nonzero(own == k, axis=1).astype(float) for k in range(len(CLASSES))]
                    total = w[0] * counts[STABLE] if (w == w[0]).all() else (own == STABLE) @ w
                    sums = np.stack([*same, total, np.full(n, float(e.sum())), *counts])
                    held[values[g]] = held[values[g]] + sums if values[g] in held else sums
            if len(held) * n > HELD:
                yield from out()
        yield from out()

    long = lambda c: F.round(F.sum(c)).cast("long")
    g = data.mapInArrow(run, schema).groupBy(*by, "at").agg(
        long("w").alias("samples"), long("we").alias("eligible"), long("probes").alias("probes"), long(F.col("stable") + F.col("ranking_reversal")).alias("covered"),
        long("stable").alias("ox_stable"), F.sum("total").alias("total"), *[long(c).alias(f"ox_{c}") for c in FAILURES],
    )
    g = g.select(*by, *_factors(F.col("at"), tracked, exposed, match, birth), "samples", "eligible", "probes", "covered", F.col("ox_stable").alias("stable"), "total", *[F.col(f"ox_{c}").alias(c) for c in FAILURES])
    return _rates(g, by)


def saturation(pairs: DataFrame, by: list[str], cap: int = 20, duplicate: float = 0.7) -> DataFrame:
    """How often lists reach the cap: of clean lists as they come, of perturbed ones after suppression, and the median of the latter."""
    a = distinct_counts(pairs, "perturbed_candidates", cap, [duplicate], by, ("clean_candidates",))
    n, k = F.get("kept", F.lit(0)), F.col("rows")
    a = a.select(*by, n.alias("n"), (k * (F.col("n_clean_candidates") >= cap).cast("int")).alias("c"), (k * (n >= cap).cast("int")).alias("p"), k.alias("k"))
    return a.groupBy(*by).agg(F.sum("k").alias("probes"), (F.sum("c") / F.sum("k")).alias("clean_cap_fraction"), (F.sum("p") / F.sum("k")).alias("probe_cap_fraction"), F.percentile("n", F.lit(0.5), F.col("k")).alias("median_exposed"))


def duplicate_eligibility(lists: DataFrame, thresholds: list[float], maximum: int = 5) -> DataFrame:
    """Eligibility and mean number of tracked candidates at each suppression threshold, over clean lists alone."""
    a = distinct_counts(lists, "clean_candidates", maximum, thresholds, [])
    each = F.explode(F.arrays_zip(F.array(*[F.lit(float(x)) for x in thresholds]).alias("duplicate"), F.col("kept").alias("n"))).alias("x")
    a = a.select("rows", each).select("x.duplicate", "x.n", F.col("rows").alias("k"))
    return a.groupBy("duplicate").agg(F.sum("k").alias("samples"), (F.sum(F.col("k") * (F.col("n") >= 2).cast("int")) / F.sum("k")).alias("eligibility"), (F.sum(F.col("k") * F.col("n")) / F.sum("k")).alias("mean_tracked"))


def optimism(table: DataFrame, by: list[str]) -> DataFrame:
    """Of a table of settings (:func:`settings`): coverage and complete-case stability from the shares of failure
    classes alone, the optimism against the full manifest, and the identity's residual."""
    risk = 1 - F.col("eligible_theta")
    lost = risk * (F.col("winner_missing_share") + F.col("competitor_missing_share") + F.col("threatening_birth_share"))
    a = table.select(*by, "setting_index", *FACTORS, "eligibility", "eligible_theta", "theta", (1 - lost).alias("coverage"), (risk * F.col("ranking_reversal_share")).alias("ranking_risk"))
    a = a.withColumn("complete_case", 1 - F.col("ranking_risk") / F.nullif(F.col("coverage"), F.lit(0.0)))
    a = a.withColumn("total_optimism", F.col("complete_case") - F.col("theta"))
    return a.withColumn("residual", F.abs(F.col("total_optimism") - F.col("complete_case") * (1 - F.col("eligibility") * F.col("coverage")))).drop("ranking_risk")


def optimism_ranges(values: DataFrame, by: list[str]) -> DataFrame:
    columns = ("complete_case", "theta", "total_optimism")
    return values.groupBy(*by).agg(F.count(F.lit(1)).alias("settings"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def envelope(values: DataFrame, by: list[str], value: str = "theta", index: str = "setting_index", default: int = 0) -> DataFrame:
    """Least, greatest and default value over settings; width; greatest departure; first index of each end."""
    d = F.max(F.when(F.col(index) == default, F.col(value)))
    g = values.groupBy(*by).agg(
        F.min(F.struct(value, index)).alias("lo"), F.max(F.struct(F.col(value).alias("v"), (-F.col(index)).alias("i"))).alias("hi"), d.alias("at_default")
    )
    return g.select(*by, F.col(f"lo.{value}").alias("minimum"), F.col("hi.v").alias("maximum"), (F.col("hi.v") - F.col(f"lo.{value}")).alias("width"), F.greatest(F.abs(F.col("hi.v") - F.col("at_default")), F.abs(F.col(f"lo.{value}") - F.col("at_default"))).alias("max_departure"), F.col(f"lo.{index}").alias("minimum_index"), (-F.col("hi.i")).alias("maximum_index"))


def pair_gaps(values: DataFrame, group: str = "model", value: str = "theta", index: str = "setting_index") -> DataFrame:
    """For each pair of models the least and greatest gap at the same setting, the first setting of the least one, whether the
    order never changes, and whether one's worst beats the other's best. A setting that one model lacks is an error."""
    values = materialize(values.select(group, index, value), "settings")  # named four times, worked out once
    a = values.select(F.col(group).alias("model_a"), index, F.col(value).alias("va"))
    b = values.select(F.col(group).alias("model_b"), F.col(index).alias("index_b"), F.col(value).alias("vb"))
    gap = F.col("va") - F.col("vb")
    models = values.select(group).distinct()
    pairs = models.select(F.col(group).alias("model_a")).join(models.select(F.col(group).alias("model_b")), F.col("model_a") < F.col("model_b"))  # a row for each pair of models
    j = pairs.join(a, "model_a").join(b.withColumnRenamed("model_b", "model_c"), (F.col("model_b") == F.col("model_c")) & (F.col(index) == F.col("index_b")), "left")
    g = j.groupBy("model_a", "model_b").agg(
        F.min(gap).alias("min_gap"), F.max(gap).alias("max_gap"), (F.min("va") - F.max("vb")).alias("strong_gap"), F.min(F.struct(gap.alias("g"), F.col(index))).alias("worst"), F.count(F.when(F.col("index_b").isNull(), 1)).alias("lacking")
    )
    worst = F.when(F.col("lacking") == 0, F.col(f"worst.{index}")).otherwise(F.raise_error(F.lit("models don't have the same settings")).cast("int"))
    return g.select("model_a", "model_b", "min_gap", "max_gap", "strong_gap", worst.alias("worst_index"), ((F.col("min_gap") > 0) | (F.col("max_gap") < 0)).alias("invariant"), (F.col("strong_gap") > 0).alias("strong"))


def one_factor(values: DataFrame, by: list[str], defaults: dict[str, float], value: str = "theta") -> DataFrame:
    """For each factor, with the others at their defaults: tested values, least, greatest and default value, and the range.

    One pass: a setting counts for a factor if all others are at their defaults.
    """
    off = {c: (F.col(c) != v).cast("int") for c, v in defaults.items()}
    counts = [F.when(sum((off[o] for o in defaults if o != c), F.lit(0)) == 0, F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("at"), (F.col(c) == v).alias("is_default"))) for c, v in defaults.items()]
    a = values.withColumn("f", F.explode(F.filter(F.array(*counts), lambda x: x.isNotNull())))
    g = a.groupBy(*by, "f.factor").agg(F.sort_array(F.collect_list("f.at")).alias("at"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.max(F.when(F.col("f.is_default"), F.col(value))).alias("at_default"))
    return g.select(*by, "factor", F.array_join(F.transform("at", lambda x: F.format_string("%.2f", x)), ";").alias("tested"), F.size("at").alias("levels"), "minimum", "maximum", (F.col("maximum") - F.col("minimum")).alias("range"), "at_default")
