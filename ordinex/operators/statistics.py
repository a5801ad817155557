"""Rank correlation, risk curves, exact intervals, variance components, adequacy and probe registries."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import crossover, design_effect, effective_trials, hoeffding_radius, intraclass, optimal_probes, probe_share, probes_for_share, required_units, variance_of_mean
from .joins import one_to_one


def spearman(df: DataFrame, by: list[str], a: str, b: str, units: str | None = None) -> DataFrame:
    """Rank correlation with average ranks; null below three rows or where a side is constant. ``units``: how many
    rows a row stands for.

    Rows are first counted by their pair of values, so equal values meet in an aggregation; running
    sums and joins are over distinct values and pairs alone.
    """
    k = F.col(units) if units else F.lit(1)
    cells = df.select(*by, F.col(a).alias("ox_a"), F.col(b).alias("ox_b"), k.alias("k")).groupBy(*by, "ox_a", "ox_b").agg(F.sum("k").alias("k"))

    def ranks(c: str) -> DataFrame:
        n = cells.groupBy(*by, c).agg(F.sum("k").alias("m"))
        w = W.partitionBy(*by)
        total = F.sum("m").over(w)
        return n.select(*by, c, (F.sum("m").over(w.orderBy(c)) - (F.col("m") - 1) / 2 - (total + 1) / 2).alias(f"r{c}"))  # less the mean rank

    j = cells.join(ranks("ox_a"), [*by, "ox_a"]).join(ranks("ox_b"), [*by, "ox_b"])
    x, y, n = F.col("rox_a"), F.col("rox_b"), F.col("k")
    g = j.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(n * x * y).alias("cov"), F.sqrt(F.sum(n * x * x) * F.sum(n * y * y)).alias("scale"))
    return g.select(*by, "n", F.when((F.col("n") >= 3) & (F.col("scale") > 0), F.col("cov") / F.col("scale")).alias("spearman"))


def risk_curve(df: DataFrame, by: list[str], score: str = "diagnostic", target: str = "reference") -> DataFrame:
    """Coverage and retained risk at each distinct score, ties together."""
    g = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("k"), F.sum(1 - F.col(target)).alias("r"))
    w = W.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("k").over(W.partitionBy(*by))
    return g.select(*by, F.col(score).alias("threshold"), (F.sum("k").over(w) / total).alias("retained"), (F.sum("r").over(w) / F.sum("k").over(w)).alias("risk"))


def aurc(df: DataFrame, by: list[str], score: str = "diagnostic", target: str = "reference") -> DataFrame:
    """Area under the risk curve by trapezoids from (0, first risk); of one threshold, its risk."""
    c = risk_curve(df, by, score, target)
    w = W.partitionBy(*by).orderBy(F.desc("threshold"))
    step = (F.col("retained") - F.lag("retained", 1, 0.0).over(w)) * (F.col("risk") + F.coalesce(F.lag("risk").over(w), F.col("risk"))) / 2
    return c.withColumn("step", step).groupBy(*by).agg(F.sum("step").alias("aurc"))


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """The exact interval of ``k`` successes in ``n`` trials, for any ``n``: quantiles of beta distributions by halving."""
    if not 0 < n or not 0 <= k <= n or not 0 < confidence < 1:
        raise ValueError("0 <= k <= n, n > 0 and a confidence between 0 and 1")
    alpha = (1 - confidence) / 2

    def quantile(p: float, a: float, b: float) -> float:
        lo, hi = 0.0, 1.0
        while hi - lo > 1e-15 and hi - lo > 1e-13 * hi:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
        return (lo + hi) / 2

    # Closed at the ends.
    lower = 0.0 if k == 0 else alpha ** (1 / n) if k == n else quantile(alpha, k, n - k + 1)
    upper = 1.0 if k == n else 1 - alpha ** (1 / n) if k == 0 else quantile(1 - alpha, k + 1, n - k)
    return lower, upper


@lru_cache(1 << 14)
def _interval(k: int, n: int, confidence: float) -> tuple[float, float]:
    return clopper_pearson(k, n, confidence)


def wilson_width(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Width of the score interval; null without trials."""
    p, zz = k / n, z * z
    return F.when(n > 0, 2 * z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n))


def with_intervals(df: DataFrame, k: str, n: str, confidence: float = 0.95, lower: str = "lower", upper: str = "upper") -> DataFrame:
    """``df`` with ``lower, upper``: exact intervals, null without trials. Rows stay where they are: a task works out each distinct (k, n) of a
    batch once, and keeps the latest ones for the next."""

    @F.pandas_udf("lower double, upper double")
    def both(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = np.full((len(n), 2), np.nan)
        some = np.flatnonzero(n.notna() & k.notna() & (n > 0))
        cells, at = np.unique(np.stack([k.iloc[some], n.iloc[some]]).astype(np.int64), axis=1, return_inverse=True)
        if len(some):
            out[some] = np.array([_interval(int(a), int(b), confidence) for a, b in cells.T])[at.reshape(-1)]
        return pd.DataFrame({"lower": out[:, 0], "upper": out[:, 1]}).astype(object).where(~np.isnan(out), None)

    a = df.withColumn("ox_interval", both(F.col(k).cast("long"), F.col(n).cast("long")))
    return a.select(*df.columns, F.col("ox_interval.lower").alias(lower), F.col("ox_interval.upper").alias(upper))


def variance_components(stats: DataFrame, by: list[str], probes: str = "n", successes: str = "n_stable") -> DataFrame:
    """Two-stage components: within B, between A (moments, cut at 0; the raw value stays), and what follows from them.

    For units with different numbers of probes, B / R takes each unit's own R.
    """
    p = F.col(successes) / F.col(probes)
    u = stats.filter(F.col(probes) >= 2).select(*by, p.alias("p"), (F.col(probes) / (F.col(probes) - 1.0) * p * (1 - p)).alias("v"), F.col(probes).alias("r"))
    g = u.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.avg("p").alias("theta"), F.avg("v").alias("within"), F.var_samp("p").alias("mean_variance"), F.avg(F.col("v") / F.col("r")).alias("noise"), F.avg("r").alias("mean_probes"))
    g = g.withColumn("between_raw", F.col("mean_variance") - F.col("noise")).withColumn("between", F.greatest(F.lit(0.0), F.col("between_raw")))
    a, b, n, r = (F.col(c) for c in ("between", "within", "units", "mean_probes"))
    cluster, naive = F.sqrt(variance_of_mean(a, b, n, r)), F.sqrt(F.col("theta") * (1 - F.col("theta")) / (n * r))
    return g.select(*by, "units", "theta", "within", "between_raw", "between", cluster.alias("cluster_se"), naive.alias("naive_se"), F.when(naive > 0, cluster / naive).alias("se_ratio"), intraclass(a, b).alias("icc"), design_effect(a, b, r).alias("design_effect"), effective_trials(a, b, n, r).alias("effective_trials"), probe_share(a, b, r).alias("probe_share"), crossover(a, b).alias("crossover"), hoeffding_radius(n, r, 0.05).alias("hoeffding_radius"))


def variance_budgets(components: DataFrame, by: list[str], budgets: list[int]) -> DataFrame:
    """Variance of the mean at each number of probes, with the reduction against the number before."""
    a = components.withColumn("probes", F.explode(F.array(*[F.lit(x) for x in budgets])))
    a = a.withColumn("variance", variance_of_mean(F.col("between"), F.col("within"), F.col("units"), F.col("probes")))
    prev = F.lag("variance").over(W.partitionBy(*by).orderBy("probes"))
    return a.select(*by, "probes", "variance", F.when(prev > 0, 1 - F.col("variance") / prev).alias("reduction"))


def planning(components: DataFrame, by: list[str], half_widths: list[float], budgets: list[int]) -> DataFrame:
    """Units needed for each half-width and number of probes."""
    a = components.withColumn("half_width", F.explode(F.array(*[F.lit(x) for x in half_widths]))).withColumn("probes", F.explode(F.array(*[F.lit(x) for x in budgets])))
    return a.select(*by, "half_width", "probes", required_units(F.col("between"), F.col("within"), F.col("probes"), F.col("half_width")).alias("units_needed"))


def allocation(components: DataFrame, by: list[str], cost_ratios: list[float], low: int = 1, high: int = 80) -> DataFrame:
    """The best number of probes for each ratio of unit to probe cost, and the probes that keep their share of variance at 10 %."""
    a = components.withColumn("cost_ratio", F.explode(F.array(*[F.lit(float(x)) for x in cost_ratios])))
    x, y = F.col("between"), F.col("within")
    return a.select(*by, "cost_ratio", optimal_probes(x, y, F.col("cost_ratio"), F.lit(1.0), low, high).alias("probes"), probes_for_share(x, y, 0.1).alias("probes_for_tenth"))


def truncation_audit(components: DataFrame, by: list[str]) -> DataFrame:
    """Where the between-variance was cut at zero, and by how much."""
    return components.select(*by, "between_raw", "between", (F.col("between_raw") < 0).alias("truncated"), (F.col("between") - F.col("between_raw")).alias("adjustment"))


def plugin_components(stats: DataFrame, by: list[str], probes: str = "n", successes: str = "n_stable") -> DataFrame:
    """Plug-in components: the population variance of units' rates and their mean Bernoulli variance."""
    p = F.col(successes) / F.col(probes)
    return stats.filter(F.col(probes) > 0).groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.avg(p).alias("theta"), F.var_pop(p).alias("between"), F.avg(p * (1 - p)).alias("within"))


def interval_summary(units: DataFrame, by: list[str], lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Widths of units' intervals: mean, median, 90 and 95 % points, greatest, and the shares up to 0.1 and 0.2."""
    w = F.col(upper) - F.col(lower)
    g = units.select(*by, w.alias("w")).groupBy(*by).agg(F.count("w").alias("units"), F.avg("w").alias("mean"), F.percentile("w", [0.5, 0.9, 0.95]).alias("q"), F.max("w").alias("max"), *[F.avg((F.col("w") <= x).cast("double")).alias(n) for x, n in ((0.1, "within_tenth"), (0.2, "within_fifth"))])
    return g.select(*by, "units", "mean", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("median", "p90", "p95"))], "max", "within_tenth", "within_fifth")


def registry_comparison(metrics: DataFrame, within: DataFrame, by: list[str], probes: tuple[int, int] = (40, 80)) -> DataFrame:
    """Measures of two independent registries (:func:`ordinex.operators.resampling.paired_metrics` by ``scope``) beside the root mean square
    difference that sampling alone predicts. ``within``: ``by, within, eligibility``; eligible units alone share the within-variance."""
    own = F.when(F.col("scope") == "full_manifest", F.col("within")).otherwise(F.col("within") / F.col("eligibility"))
    predicted = F.sqrt(own * (1 / probes[0] + 1 / probes[1]))
    j = metrics.join(within, by)
    return j.select(*metrics.columns, predicted.alias("predicted_rmse"), F.when(predicted > 0, F.col("sample_rmse") / predicted).alias("rmse_ratio"))


def adequacy(components: DataFrame, split_halves: DataFrame, intervals: DataFrame, by: list[str], probes: int = 80, share_limit: float = 0.05, split_limit: float = 0.01, rmse_limit: float = 0.05) -> DataFrame:
    """Whether a number of probes is enough for each group: standard errors at it, at twice it and without probe noise, the
    eligible samples' error, and the criteria. ``components``: ``units, theta, between, within``; ``split_halves``: ``p95`` of the
    absolute difference; ``intervals``: ``eligible``, eligible units. Each has one row for a group; a second is an error."""
    j = one_to_one(one_to_one(components, split_halves.select(*by, "p95"), by), intervals.select(*by, "eligible"), by)
    a, b, n = F.col("between"), F.col("within"), F.col("units")
    se, twice, floor = (F.sqrt(x) for x in (variance_of_mean(a, b, n, F.lit(probes)), variance_of_mean(a, b, n, F.lit(2 * probes)), a / n))
    share, rate = probe_share(a, b, F.lit(probes)), F.col("eligible") / n
    rmse = F.sqrt(b / (rate * probes))
    enough, halves = share <= share_limit, F.col("p95") <= split_limit
    return j.select(
        *by, "units", "theta", share.alias("probe_share"), probes_for_share(a, b, share_limit).alias("probes_needed"), se.alias("se"), twice.alias("se_twice"), floor.alias("se_floor"),
        F.when(se > 0, (se - twice) / se).alias("reduction"), F.when(floor > 0, se / floor - 1).alias("excess"), rate.alias("eligibility"), rmse.alias("sample_rmse"), "p95",
        enough.alias("share_pass"), halves.alias("split_pass"), (rmse <= rmse_limit).alias("sample_pass"), (enough & halves).alias("adequate"),
    )


def matrix_violations(trials: DataFrame, by: list[str], unit: str, value: str) -> DataFrame:
    """What keeps trials from being a binary matrix of units and probes: too few units or probes, units of unequal length, values
    that are missing, not finite or neither 0 nor 1. A row for each group and rule that is broken, with how often."""
    v = F.col(value).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    u = trials.groupBy(*by, unit).agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("bad"), F.sum((~bad & ~v.isin(0.0, 1.0)).cast("long")).alias("other"))
    g = u.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("bad").alias("bad"), F.sum("other").alias("other"))
    rules = {"fewer_than_two_units": (F.col("units") < 2).cast("long"), "fewer_than_two_probes": (F.col("least") < 2).cast("long"), "unequal_units": (F.col("least") != F.col("most")).cast("long"), "not_finite": F.col("bad"), "not_binary": F.col("other")}
    return g.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), x.alias("n")) for k, x in rules.items()])).alias("r")).select(*by, "r.rule", "r.n").filter("n > 0")


Law = list[tuple[str, float, float, float]]


def checked_law(law: Law) -> Law:
    """The law, or an error: no family, a weight below zero, no weight at all, an interval that ends before it begins."""
    if not law or any(w < 0 for _, w, _, _ in law) or sum(w for _, w, _, _ in law) <= 0:
        raise ValueError("families with weights of zero or more, not all zero")
    for family, _, low, high in law:
        if low > high:
            raise ValueError(f"{family}: the interval of severities is empty")
    return law


def balanced_budgets(budgets: list[int], diagnostic: int, families: int) -> list[int]:
    """Budgets that are whole blocks of families and no more than there are diagnostic probes, or an error."""
    if not budgets or max(budgets) > diagnostic or any(b <= 0 or b % families for b in budgets):
        raise ValueError("budgets are multiples of the number of families, up to the number of diagnostic probes")
    return budgets


def generator(base_seed: int, image_id: int, ref_id: int) -> np.random.Generator:
    """One stream of draws for a sample, the same for all models."""
    return np.random.default_rng(np.random.SeedSequence([base_seed, image_id, ref_id]))


def mixture_probe(rng: np.random.Generator, law: Law) -> tuple[str, float, int]:
    """One probe of the mixture: a family by weight, a severity in its interval, a seed."""
    weights = np.array([w for _, w, _, _ in checked_law(law)], dtype=float)
    family, _, low, high = law[int(rng.choice(len(law), p=weights / weights.sum()))]
    return family, float(rng.uniform(low, high)), int(rng.integers(0, 2**31 - 1))


def stratified_probes(rng: np.random.Generator, per_family: int, law: Law) -> list[tuple[str, float, int]]:
    """A registry of probes for a sample: every run of as many probes as families holds each once."""
    if per_family < 1:
        raise ValueError("a probe of each family at least")
    checked_law(law)
    drawn = {f: [(f, float(rng.uniform(lo, hi)), int(rng.integers(0, 2**31 - 1))) for _ in range(per_family)] for f, _, lo, hi in law}
    return [drawn[law[k][0]][b] for b in range(per_family) for k in rng.permutation(len(law))]


def probe_registry(keys: DataFrame, diagnostic: int, reference: int, base_seed: int, law: Law) -> DataFrame:
    """``image_id, ref_id, split, ord, family, severity, seed`` for each key: diagnostic probes first, then reference probes
    of the same stream, as many of each family as asked. Narrow, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, r in zip(f["image_id"], f["ref_id"]):
                rng = generator(base_seed, int(i), int(r))
                for split, n in (("diagnostic", diagnostic), ("reference", reference)):
                    rows += [(i, r, split, k, *p) for k, p in enumerate(stratified_probes(rng, n, law))]
            yield pd.DataFrame(rows, columns=["image_id", "ref_id", "split", "ord", "family", "severity", "seed"])

    return keys.select("image_id", "ref_id").mapInPandas(run, "image_id long, ref_id long, split string, ord int, family string, severity double, seed int")
