"""Key-set operations: last record wins, violations, resume, exclusion, dense ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key. By aggregation, so copies of a hot key meet in the map tasks."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("ox_record")).select(*keys, "ox_record.*")


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side alone, with the side that has them; a key with a null is never the other side's. One aggregation
    of both sides' keys: a task holds one table of its keys."""
    of = lambda df, side: df.select(*keys, *[F.lit(side == x).alias(f"ox_{x}") for x in ("left", "right")])
    g = of(left, "left").unionByName(of(right, "right")).groupBy(*keys).agg(*[F.max(f"ox_{x}").alias(f"ox_{x}") for x in ("left", "right")])
    alone = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]) | (F.col("ox_left") != F.col("ox_right"))
    sides = F.array(*[F.when(F.col(f"ox_{x}") & alone, F.lit(x)) for x in ("left", "right")])
    return g.select(*keys, F.explode(F.array_compact(sides)).alias("side"))


def pending(manifest: DataFrame, summary: DataFrame, trace: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has yet to do: keys that are not in both the summary and the trace."""
    done = summary.select(*keys).intersect(trace.select(*keys))
    return manifest.join(done, keys, "left_anti")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, or an error at run time if a key occurs twice. Keys are counted by aggregation, so whole rows don't move for it."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("ox_n")).filter("ox_n > 1").agg(F.count(F.lit(1)).alias("ox_n"))
    checked = n.select(F.assert_true(F.col("ox_n") == 0, "keys are not unique").alias("ox_ok"))
    return df.join(F.broadcast(checked), F.col("ox_ok").isNull()).drop("ox_ok")  # one row, beside each


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose keys are unique on both sides, or an error at run time."""
    return unique(left, keys).join(unique(right, keys), keys, how)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose keys are unique on the right, or an error at run time."""
    return left.join(unique(right, keys), keys, how)


def required(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of ``left`` with its one row of ``right``; a row without one is an error at run time."""
    found = left.join(unique(right, keys).withColumn("ox_found", F.lit(1)), keys, "left")
    message = F.concat(F.lit("no row for "), F.to_json(F.struct(*keys)))
    return found.withColumn("ox_found", F.assert_true(F.col("ox_found").isNotNull(), message)).filter("ox_found IS NULL").drop("ox_found")


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows repeat a key that came before: a row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def overlaps(sets: dict[str, DataFrame], column: str) -> DataFrame:
    """How many distinct values each pair of sets shares: ``left, right, shared``."""
    names = sorted(sets)
    rows = [df.select(F.lit(n).alias("of"), F.col(column).alias("v")).distinct() for n, df in sets.items()]
    held = reduce(DataFrame.union, rows).groupBy("v").agg(F.collect_set("of").alias("of"))
    pairs = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for i, a in enumerate(names) for b in names[i + 1 :]])
    both = held.select(F.explode(pairs).alias("p"), "of").select("p.left", "p.right", (F.array_contains("of", F.col("p.left")) & F.array_contains("of", F.col("p.right"))).cast("long").alias("n"))
    return both.groupBy("left", "right").agg(F.sum("n").alias("shared"))


def shared_probe_violations(probes: DataFrame, keys: list[str], spec: list[str]) -> DataFrame:
    """Keys whose probe specification differs between models."""
    return probes.groupBy(*keys).agg(F.min(F.struct(*spec)).alias("lo"), F.max(F.struct(*spec)).alias("hi")).filter("lo <> hi").select(*keys)


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with ids 1..n in order. Values are few: they are a dimension."""
    d = df.select(column).distinct()
    return d.select(column, F.dense_rank().over(W.orderBy(column)).alias("dense_id"))
