"""Rules that artifacts keep, as counts of violations: a clean table gives no rows.

Each function returns the rule and how often it is broken (with its key, where a key is
named), so a run's check is one small table; :func:`require` makes an error of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import valid


def _rules(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """For each key and rule in how many rows the rule is broken; a rule that can't be told is broken."""
    counted = df.groupBy(*keys).agg(*[F.sum(F.coalesce(broken, F.lit(True)).cast("long")).alias(name) for name, broken in rules.items()])
    return _stacked(counted, keys, list(rules))


def _stacked(counted: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n")) for n in names])
    return counted.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.rule", "r.n").filter("n > 0")


def outcome_rules(probes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Probes of eligible samples: stable is covered and in order; what isn't covered has no order."""
    e = probes.filter("eligible = 1")
    return _rules(e, keys or [], {
        "coverage_and_order": F.col("stable") != F.col("coverage") * F.coalesce("rank_stable", F.lit(0)),
        "order_without_coverage": (F.col("coverage") == 0) & F.col("rank_stable").isNotNull(),
    })


def trace_rules(trace: DataFrame, tracked_most: int, exposed_most: int, keys: list[str] | None = None) -> DataFrame:
    """Sample traces: tracked and exposed candidates within their limits, ineligible samples without probes, eligible ones with two
    tracked candidates or more, mappings as long as these, no score for what is missing."""
    p, n = F.col("probes"), F.size(F.coalesce("tracked_clean_candidates", F.array()))
    ok = F.col("clean_eligible") == 1
    any_ = lambda test: F.exists(F.coalesce(p, F.array()), test)
    imputed = lambda x: F.exists(x["outcome"]["missing_clean_indices"], lambda i: F.get(x["outcome"]["matched_scores"], i).isNotNull())
    return _rules(trace, keys or [], {
        "too_many_tracked": n > tracked_most,
        "ineligible_with_probes": ~ok & (F.size(F.coalesce(p, F.array())) > 0),
        "eligible_with_fewer_than_two": ok & (n < 2),
        "too_many_exposed": any_(lambda x: F.size(x["candidates"]) > exposed_most),
        "mapping_length": ok & any_(lambda x: F.size(x["outcome"]["mapping"]) != n),
        "imputed_score": any_(imputed),
    })


def registry_rules(probes: DataFrame, per_family: dict[str, int], families: list[str], keys: tuple[str, ...] = ("model", "ref_id")) -> DataFrame:
    """Samples whose probes of a split are not as many of each family as registered: ``keys, rule, n``, by how many."""
    here = [F.sum(((F.col("split") == s) & (F.col("family") == f)).cast("long")).alias(f"ox_{s}_{f}") for s in per_family for f in families]
    g = probes.groupBy(*keys).agg(*here)
    off = {f"unbalanced_{s}": sum((F.abs(F.col(f"ox_{s}_{f}") - n) for f in families), F.lit(0)) for s, n in per_family.items()}
    return _stacked(g.select(*keys, *[c.alias(n) for n, c in off.items()]), list(keys), list(off))


def summary_rules(summary: DataFrame, budgets: list[int], keys: tuple[str, ...] = ("model", "image_id", "ref_id")) -> DataFrame:
    """Samples of a summary that don't have each registered budget once: ``keys, rule, n``."""
    g = summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.collect_set("diagnostic_budget").alias("b"))
    wanted = F.array(*map(F.lit, budgets))
    own = F.transform("b", lambda x: x.cast("int"))
    missing, other = F.size(F.array_except(wanted, own)), F.size(F.array_except(own, wanted))
    return _stacked(g.select(*keys, missing.alias("budget_missing"), other.alias("budget_unknown"), (F.col("rows") - F.size("b")).alias("budget_twice")), list(keys), ["budget_missing", "budget_unknown", "budget_twice"])


def compact_rules(probes: DataFrame, counts: dict[str, int], keys: tuple[str, ...] = ("model", "image_id", "ref_id")) -> DataFrame:
    """Compact traces: as many probes of each split as registered for eligible samples, and none that is stable without coverage."""
    e = probes.filter("eligible = 1")
    here = [F.abs(F.sum((F.col("split") == s).cast("long")) - n).alias(f"count_{s}") for s, n in counts.items()]
    g = e.groupBy(*keys).agg(*here, F.sum((F.col("stable") > F.col("coverage")).cast("long")).alias("stable_without_coverage"))
    return _stacked(g, list(keys), [*[f"count_{s}" for s in counts], "stable_without_coverage"])


def agreement_rules(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], slack: float = 1e-12) -> DataFrame:
    """Two tables of the same keys: keys of one side alone, and columns that differ by more than ``slack``: ``rule, n``."""
    a = left.select(*keys, *[F.col(c).alias(f"ox_a_{c}") for c in columns], F.lit(1).alias("ox_a"))
    b = right.select(*keys, *[F.col(c).alias(f"ox_b_{c}") for c in columns], F.lit(1).alias("ox_b"))
    j = a.join(b, keys, "full")
    both = F.col("ox_a").isNotNull() & F.col("ox_b").isNotNull()
    differ = lambda c: both & ~F.coalesce(F.abs(F.col(f"ox_a_{c}") - F.col(f"ox_b_{c}")) <= slack, F.col(f"ox_a_{c}").isNull() & F.col(f"ox_b_{c}").isNull())
    return _rules(j, [], {"left_only": F.col("ox_b").isNull(), "right_only": F.col("ox_a").isNull(), **{f"{c}_differs": differ(c) for c in columns}})


def manifest_rules(manifest: DataFrame, unique: list[str], counts: dict[str, int] | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Manifests: unique keys, boxes within their images, queries with words, registered numbers of rows by source, no excluded image."""
    b = F.struct(*[F.get("target_box", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    inside = valid(b) & (b["x1"] >= 0) & (b["y1"] >= 0) & (b["x2"] <= F.col("image_width")) & (b["y2"] <= F.col("image_height"))
    parts = [_rules(manifest, [], {"box_outside": ~F.coalesce(inside, F.lit(False)), "empty_query": F.trim(F.coalesce("query", F.lit(""))) == ""})]
    for c in unique:
        parts.append(manifest.agg((F.count(F.lit(1)) - F.countDistinct(c)).alias("n")).filter("n > 0").select(F.lit(f"repeated_{c}").alias("rule"), "n"))
    if counts:
        n = [F.abs(F.coalesce(F.sum((F.col("source_split") == s).cast("long")), F.lit(0)) - k).alias(f"count_{s}") for s, k in counts.items()]
        parts.append(_stacked(manifest.agg(*n), [], [f"count_{s}" for s in counts]))
    if excluded is not None:
        parts.append(manifest.join(excluded.select("image_id").distinct(), "image_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("excluded_image").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, parts)


def ragged(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts; what a part lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def require(violations: DataFrame, most: int = 20) -> None:
    """An error that names broken rules, the first ``most`` of them."""
    found = violations.limit(most).collect()
    if found:
        raise AssertionError("; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in found))
