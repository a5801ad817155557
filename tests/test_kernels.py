"""Outcomes of many probes at once: the same as those of the column expressions, on lists with hard assignments, births, ties and none at all."""

import random

import numpy as np
from pyspark.sql import functions as F

from ordinex.functions import geometry
from ordinex.operators import grid, kernels
from ordinex.operators.contract import OutputContract
from ordinex.operators.outcome import assign, evaluated

COLUMNS = f"model int, ref_id int, r int, clean_candidates array<{geometry.CANDIDATE}>, perturbed_candidates array<{geometry.CANDIDATE}>"
FACTORS = ([2, 5, 3], [6, 4, 9], [0.0, 0.25], [0.5, 0.0, 0.8])


def lists(seed, n):
    rng = random.Random(seed)

    def drawn(most):
        out = []
        for k in range(rng.randint(0, most)):
            x, y = rng.randint(0, 12), rng.randint(0, 12)
            out.append((float(x), float(y), float(x + rng.randint(1, 12)), float(y + rng.randint(1, 12)), rng.randint(0, 6) / 4, "", k))
        return out

    rows = []
    for k in range(n):
        clean = drawn(8)
        rows.append((k % 2, k // 4, k // 2 % 2, clean, drawn(9) if k % 3 else [(a + rng.randint(-1, 1), b, c + 2, d, s + rng.randint(-1, 1) / 8, t, o) for a, b, c, d, s, t, o in clean]))
    return [*rows, (1, 10**6, 0, [], drawn(9)), (1, 10**6, 1, drawn(8), [])]


def test_scalars_are_those_of_the_column_expressions(spark):
    df = spark.createDataFrame(lists(1, 400), COLUMNS)
    for contract in (OutputContract(), OutputContract(3, 4, 0.5, 0.0, 0.3)):
        e = evaluated(df, contract).select("model", "ref_id", "r", "clean_eligible", F.size("exposed").alias("exposed"), *[f"outcome.{c}" for c in ("coverage", "rank_stable", "operational_stable", "primary_failure", "culprit_clean_index")])
        own = kernels.judgements(df, contract, ("model", "ref_id", "r"))
        assert own.dtypes == e.dtypes and sorted(map(str, own.collect())) == sorted(map(str, e.collect()))
        assert {r["primary_failure"] for r in own.collect()} == {None, *kernels.CLASSES}


def test_table_counts_what_replay_lists(spark):
    df = spark.createDataFrame(lists(2, 300), COLUMNS).filter("ref_id % 5 > 0 OR r = 0")  # samples of one, two and four probes
    keys = ("model", "ref_id", "r")
    want = grid.settings(grid.replay(df, *FACTORS, keys=keys), ["model"])
    own = grid.table(df, *FACTORS, keys=keys, by=["model"])
    assert own.columns == want.columns and "Generate" not in own._jdf.queryExecution().optimizedPlan().toString()
    a, b = ({(r["model"], r["setting_index"]): [round(x, 9) if isinstance(x, float) else x for x in r] for r in t.collect()} for t in (own, want))
    assert a == b and len(a) == 2 * 54
    assert [r["samples"] for r in grid.table(df.withColumn("model", F.lit(None).cast("int")).withColumn("weight", F.lit(0.5)), *FACTORS, by=["model"]).collect()] == [round(df.count() / 2)] * 54
    assert grid.table(df.limit(0), *FACTORS, by=["model"]).count() == 0


def test_settings_are_worked_out_once_for_all_pairs(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def theta(x):
        seen.add(1)
        return float(x)

    df = spark.range(12).select((F.col("id") % 3).alias("model"), F.floor(F.col("id") / 3).alias("setting_index"), theta("id").alias("theta"))
    assert grid.pair_gaps(df).count() == 3 and seen.value == 12


def test_matching_by_sets_is_the_exact_assignment():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 2), (5, 9), (2, 0), (9, 3)):
        v = rng.integers(0, 4, (n, m, 60)) / 4
        lt, le = rng.integers(1, n + 1, 60), rng.integers(0, m + 1, 60)
        own = kernels.matched(v, lt, le)
        for r in range(60):
            assert own[: lt[r], r].tolist() == (assign(v[: lt[r], : le[r], r]) if le[r] else [-1] * lt[r])


def test_kept_candidates_are_counted_for_all_limits(spark):
    df = spark.createDataFrame(lists(3, 200), COLUMNS)
    limits = [0.2, 0.5, 0.8]
    got = {(r["model"], r["n_clean_candidates"], *r["kept"]): r["rows"] for r in kernels.distinct_counts(df, "perturbed_candidates", 4, limits, ["model"], ("clean_candidates",)).groupBy("model", "n_clean_candidates", "kept").agg(F.sum("rows").alias("rows")).collect()}
    sizes = [F.size(geometry.spatially_distinct(F.col("perturbed_candidates"), 4, x)).alias(f"k{i}") for i, x in enumerate(limits)]
    want = {tuple(r)[:-1]: r["count"] for r in df.select("model", F.size("clean_candidates").alias("n"), *sizes).groupBy("model", "n", "k0", "k1", "k2").count().collect()}
    assert got == want


def test_blocks_are_bounded_and_hold_each_row_once():
    n = np.array([3] * 5000 + [400] * 7 + [0] * 10)
    found = list(kernels.blocks(n))
    assert sorted(np.concatenate(found).tolist()) == list(range(len(n)))
    assert all(len(b) == 1 or len(b) * int(n[b].max()) ** 2 <= kernels.CELLS for b in found)


def test_first_candidate_is_found_once(spark):
    df = spark.createDataFrame(lists(4, 60), COLUMNS)
    truth = F.array(F.struct(*[F.lit(v).alias(n) for v, n in ((2.0, "x1"), (2.0, "y1"), (9.0, "x2"), (9.0, "y2"))]))
    flag, best = geometry.top1(F.col("clean_candidates"), truth)
    first = F.get(geometry.ranked(F.col("clean_candidates")), 0)
    a = df.select(best.alias("best"), flag.alias("flag"), F.coalesce(geometry.iou(first, F.get(truth, 0)), F.lit(0.0)).alias("want"))
    assert all(r["best"] == r["want"] and r["flag"] == (r["best"] >= 0.5) for r in a.collect())
    assert df.select(best.alias("best"))._jdf.queryExecution().optimizedPlan().toString().count("array_min") == 1
