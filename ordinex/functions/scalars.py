"""Scalar rules: ratios, bins, probe strengths and two-stage sampling theory."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The probe law (family, weight, low, high), in its order.
PROBE_LAW = [
    ("blur", 1.0, 0.3, 2.5),
    ("brightness", 1.0, 0.7, 1.3),
    ("jpeg", 1.0, 40.0, 95.0),
    ("resolution", 1.0, 0.5, 1.0),
    ("gaussian_noise", 1.0, 0.0, 0.04),
]
FAMILIES = [f for f, *_ in PROBE_LAW]
#: Failure classes in order of precedence behind "stable".
FAILURES = ["winner_missing", "competitor_missing", "threatening_birth", "ranking_reversal"]


def ratio(n: Column, d: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(d > 0, n / d)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def strength(family: Column, severity: Column) -> Column:
    """Severity as a strength from 0 to 1, by what the family does at its ends; an unknown family is an error."""
    ends = {f: (low, high) for f, _, low, high in PROBE_LAW}
    up = lambda f: (severity - ends[f][0]) / (ends[f][1] - ends[f][0])
    down = lambda f: (ends[f][1] - severity) / (ends[f][1] - ends[f][0])
    mid = sum(ends["brightness"]) / 2
    value = F.when(family == "blur", up("blur")).when(family == "gaussian_noise", up("gaussian_noise"))
    value = value.when(family == "jpeg", down("jpeg")).when(family == "resolution", down("resolution"))
    value = value.when(family == "brightness", F.abs(severity - mid) / (ends["brightness"][1] - mid))
    value = value.otherwise(F.raise_error(F.concat(F.lit("unknown family "), F.coalesce(family, F.lit("null")))).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def severity_bin(s: Column, bins: int = 5) -> Column:
    return F.least(F.lit(bins - 1), F.floor(s * bins)).cast("int")


def calibration_bin(p: Column, bins: int = 10) -> Column:
    return F.least((p * bins).cast("int"), F.lit(bins - 1))


def length_bin(words: Column) -> Column:
    """Right-closed bins of query length."""
    return F.when(words <= 18, "short").when(words <= 29, "medium").otherwise("long")


def scale_stratum(box_area: Column) -> Column:
    side = F.sqrt(box_area)
    return F.when(side < 32, "small").when(side <= 96, "medium").otherwise("large")


def variance_of_mean(a: Column, b: Column, n: Column, r: Column) -> Column:
    return a / n + b / (n * r)


def intraclass(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, a / (a + b)).otherwise(F.lit(0.0))


def design_effect(a: Column, b: Column, r: Column) -> Column:
    return 1 + (r - 1) * intraclass(a, b)


def effective_trials(a: Column, b: Column, n: Column, r: Column) -> Column:
    return n * r / design_effect(a, b, r)


def probe_share(a: Column, b: Column, r: Column) -> Column:
    total = a + b / r
    return F.when(total > 0, b / r / total).otherwise(F.lit(0.0))


def crossover(a: Column, b: Column) -> Column:
    return F.when(a > 0, b / a).otherwise(F.lit(float("inf")))


def probes_for_share(a: Column, b: Column, share: float) -> Column:
    return F.when(b == 0, F.lit(1.0)).when(a == 0, F.lit(float("inf"))).otherwise(F.greatest(F.lit(1.0), F.ceil(F.round(b * (1 - share) / (a * share), 9)).cast("double")))


def required_units(a: Column, b: Column, r: Column, half_width: Column, z: float = 1.959963984540054) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(z * z * (a + b / r) / (half_width * half_width)))


def optimal_probes(a: Column, b: Column, unit_cost: Column, probe_cost: Column, low: int, high: int) -> Column:
    """The integer in [low, high] of least variance at equal cost; ties to the smaller. Without between-variance: ``high``."""
    x = F.sqrt(b * unit_cost / (a * probe_cost))
    near = [F.floor(x), F.ceil(x), F.lit(low).cast("long"), F.lit(high).cast("long")]
    options = F.transform(F.array(*near), lambda r: F.least(F.lit(high).cast("long"), F.greatest(F.lit(low).cast("long"), r)))
    best = F.array_min(F.transform(options, lambda r: F.struct(((unit_cost + probe_cost * r) * (a + b / r)).alias("v"), r.alias("r"))))
    return F.when(a == 0, F.lit(high).cast("long")).otherwise(best["r"])


def hoeffding_radius(n: Column, r: Column, delta: float) -> Column:
    if not 0 < delta < 1:
        raise ValueError("delta must be between 0 and 1")
    half = math.log(4 / delta) / 2
    return F.sqrt(half / n) + F.sqrt(half / (n * r))
