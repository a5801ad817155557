"""Theory, intervals, curves, estimands and resampling against closed forms and plain code, on drawn numbers."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ordinex.functions import scalars
from ordinex.operators import estimands as E
from ordinex.operators import grid, joins
from ordinex.operators import resampling as R
from ordinex.operators import statistics as S


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize(("a", "b"), [(0.013, 0.21), (0.09, 0.07), (0.0007, 0.19)])
def test_planning_rules_are_the_least_numbers_that_do(spark, a, b):
    x, y = F.lit(a), F.lit(b)
    cost = 37.0
    r = one(spark, cross=scalars.crossover(x, y), share=scalars.probe_share(x, y, F.lit(7)), some=scalars.probes_for_share(x, y, 0.2), best=scalars.optimal_probes(x, y, F.lit(cost), F.lit(1.0), 1, 60), units=scalars.required_units(x, y, F.lit(6), F.lit(0.02)))
    assert r["cross"] == pytest.approx(b / a) and r["share"] == pytest.approx((b / 7) / (a + b / 7))
    share = lambda n: (b / n) / (a + b / n)
    assert share(r["some"]) <= 0.2 + 1e-9 and (r["some"] == 1 or share(r["some"] - 1) > 0.2)
    assert r["best"] == min(range(1, 61), key=lambda n: ((cost + n) * (a + b / n), n))
    half = lambda n: 1.959963984540054 * math.sqrt(a / n + b / (6 * n))
    assert half(r["units"]) <= 0.02 < half(r["units"] - 1)


def test_planning_rules_at_their_ends(spark):
    zero, b = F.lit(0.0), F.lit(0.3)
    r = one(spark, none=scalars.probes_for_share(zero, b, 0.1), free=scalars.probes_for_share(b, zero, 0.1), cross=scalars.crossover(zero, b), best=scalars.optimal_probes(zero, b, F.lit(9.0), F.lit(1.0), 2, 33), icc=scalars.intraclass(zero, zero))
    assert (r["none"], r["free"], r["cross"], r["best"], r["icc"]) == (math.inf, 1.0, math.inf, 33, 0.0)


def test_strengths_run_from_nothing_to_all(spark):
    for family, _, low, high in scalars.PROBE_LAW:
        steps = np.linspace(low, high, 9)
        s = [one(spark, s=scalars.strength(F.lit(family), F.lit(float(x))))["s"] for x in steps]
        if family == "brightness":
            assert s == pytest.approx([abs(x - (low + high) / 2) / ((high - low) / 2) for x in steps])
        else:
            assert s in (pytest.approx(list(np.linspace(0, 1, 9))), pytest.approx(list(np.linspace(1, 0, 9))))
    with pytest.raises(Exception, match="unknown family"):
        one(spark, s=scalars.strength(F.lit("fog"), F.lit(1.0)))


def test_finite_and_bins(spark):
    df = spark.createDataFrame([(x,) for x in (None, float("nan"), float("inf"), -float("inf"), 0.0, -2.5)], "x double")
    assert [r["f"] for r in df.select(scalars.finite(F.col("x")).alias("f")).collect()] == [False, False, False, False, True, True]
    r = one(spark, **{f"b{k}": scalars.severity_bin(F.lit(x)) for k, x in enumerate((0.0, 0.2, 0.999, 1.0))}, c=scalars.calibration_bin(F.lit(1.0)), w=S.wilson_width(F.lit(30), F.lit(100)), none=S.wilson_width(F.lit(0), F.lit(0)))
    assert (r["b0"], r["b1"], r["b2"], r["b3"], r["c"], r["none"]) == (0, 1, 4, 4, 9, None)
    z, p = 1.959963984540054, 0.3
    ends = [(p + z * z / 200 + s * z * math.sqrt(p * (1 - p) / 100 + z * z / 40000)) / (1 + z * z / 100) for s in (-1, 1)]
    assert r["w"] == pytest.approx(ends[1] - ends[0])


def tail(k, n, p):
    """P(X >= k), in logs."""
    if p <= 0 or p >= 1:
        return float(p >= 1 or k <= 0)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    return math.fsum(math.exp(x) for x in logs)


@pytest.mark.parametrize(("k", "n"), [(3, 7), (1, 2), (77, 80), (550, 1100), (1, 1100), (34000, 40000), (79990, 80000), (12, 80000)])
def test_exact_intervals_leave_a_fortieth_on_each_side(k, n):
    lower, upper = S.clopper_pearson(k, n)
    assert 0 < lower < k / n < upper < 1
    assert tail(k, n, lower) == pytest.approx(0.025, rel=1e-6) and 1 - tail(k + 1, n, upper) == pytest.approx(0.025, rel=1e-6)


@pytest.mark.parametrize("n", [1, 6, 1500, 80000])
def test_exact_intervals_at_the_ends(n):
    assert S.clopper_pearson(0, n) == (0.0, pytest.approx(1 - 0.025 ** (1 / n)))
    assert S.clopper_pearson(n, n) == (pytest.approx(0.025 ** (1 / n)), 1.0)
    for bad in ((-1, n), (n + 1, n), (0, 0)):
        with pytest.raises(ValueError):
            S.clopper_pearson(*bad)


def test_intervals_of_a_table(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 3, 9), (3, 3, 9), (4, None, None)], "i int, k int, n int")
    got = {r["i"]: (r["lower"], r["upper"]) for r in S.with_intervals(df, "k", "n").collect()}
    assert got[1] == got[4] == (None, None) and got[2] == got[3] == S.clopper_pearson(3, 9)


def test_variance_components_of_a_matrix(spark):
    m = (np.random.default_rng(8).random((30, 6)) < np.linspace(0.1, 0.9, 30)[:, None]).astype(int)
    stats = spark.createDataFrame([("g", int(r.size), int(r.sum())) for r in m], "g string, n int, n_stable int")
    r = S.variance_components(stats, ["g"]).first()
    within = m.var(axis=1, ddof=1).mean()
    raw = m.mean(axis=1).var(ddof=1) - within / 6
    assert (r["theta"], r["within"], r["between_raw"]) == (pytest.approx(m.mean()), pytest.approx(within), pytest.approx(raw))
    assert r["cluster_se"] ** 2 == pytest.approx(m.mean(axis=1).var(ddof=1) / 30) and r["se_ratio"] == pytest.approx(r["cluster_se"] / r["naive_se"])
    p = S.plugin_components(stats, ["g"]).first()
    rates = m.mean(axis=1)
    assert (p["between"], p["within"]) == (pytest.approx(rates.var()), pytest.approx((rates * (1 - rates)).mean()))
    cut = S.truncation_audit(spark.createDataFrame([("g", -0.02, 0.0)], "g string, between_raw double, between double"), ["g"]).first()
    assert cut["truncated"] and cut["adjustment"] == pytest.approx(0.02)


def test_matrix_violations(spark):
    rows = [("a", u, v) for u in range(3) for v in (0.0, 1.0)] + [("b", 0, 1.0), ("c", 0, 0.5), ("c", 0, 1.0), ("c", 1, None), ("c", 1, float("inf")), ("c", 1, 1.0)]
    got = {(r["g"], r["rule"]): r["n"] for r in S.matrix_violations(spark.createDataFrame(rows, "g string, u int, v double"), ["g"], "u", "v").collect()}
    assert got == {("b", "fewer_than_two_units"): 1, ("b", "fewer_than_two_probes"): 1, ("c", "unequal_units"): 1, ("c", "not_finite"): 2, ("c", "not_binary"): 1}


def test_spearman_and_risk_area(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"g": "x", "diagnostic": rng.integers(0, 5, 200) / 4, "reference": rng.integers(0, 9, 200) / 8})
    df = spark.createDataFrame(p)
    want = p.diagnostic.rank().corr(p.reference.rank())
    assert S.spearman(df, ["g"], "diagnostic", "reference").first()["spearman"] == pytest.approx(want)
    counted = spark.createDataFrame([("x", *k, n) for k, n in Counter(zip(p.diagnostic.tolist(), p.reference.tolist())).items()], "g string, diagnostic double, reference double, n int")
    r = S.spearman(counted, ["g"], "diagnostic", "reference", "n").first()
    assert (r["n"], r["spearman"]) == (200, pytest.approx(want))
    points = [((s := p[p.diagnostic >= t]).shape[0] / 200, (1 - s.reference).mean()) for t in sorted(p.diagnostic.unique(), reverse=True)]
    xs, ys = [0, *[a for a, _ in points]], [points[0][1], *[b for _, b in points]]
    assert S.aurc(df, ["g"]).first()["aurc"] == pytest.approx(sum((xs[i + 1] - xs[i]) * (ys[i + 1] + ys[i]) / 2 for i in range(len(points))))
    constant = spark.createDataFrame([("x", 0.5, 0.2)] * 4, "g string, diagnostic double, reference double")
    assert S.spearman(constant, ["g"], "diagnostic", "reference").first()["spearman"] is None
    assert S.aurc(constant, ["g"]).first()["aurc"] == pytest.approx(0.8)


# Estimands

FACT = "model int, ref_id int, split string, ord int, family string, severity double, coverage int, rank_stable int, stable int, failure string, culprit int, eligible int, correct int"


def drawn_facts(seed=2, samples=30):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(samples):
        ok, right = int(rng.random() > 0.2), int(rng.random() > 0.4)
        for split, n in (("diagnostic", 4), ("reference", 6)):
            for o in range(n):
                f = str(rng.choice(["stable", "stable", *scalars.FAILURES]))
                cov = int(f in ("stable", "ranking_reversal"))
                rows.append((0, s, split, o, scalars.FAMILIES[o % 2], 0.0, cov, int(f == "stable") if cov else None, int(f == "stable"), f, int(rng.integers(1, 4)) if f == "ranking_reversal" else None, ok, right))
    return rows


def test_profiles_of_samples(spark):
    rows = drawn_facts()
    got = {(r["ref_id"], r["split"]): r for r in E.profiles(spark.createDataFrame(rows, FACT)).collect()}
    by = {}
    for r in rows:
        if r[11]:
            by.setdefault((r[1], r[2]), []).append(r)
    assert set(got) == set(by)
    for k, own in by.items():
        r, n = got[k], len(own)
        cov, st = sum(x[6] for x in own), sum(x[8] for x in own)
        assert (r["probes"], r["covered"], r["stable"]) == (n, cov, st)
        assert (r["operational_lower"], r["operational_upper"]) == S.clopper_pearson(st, n)
        assert (r["conditional"], r["conditional_lower"]) == ((st / cov, S.clopper_pearson(st, cov)[0]) if cov else (None, None))
        failures = Counter(x[9] for x in own if x[9] != "stable")
        assert r["failures"] == dict(failures) and r["failure_shares"] == pytest.approx({f: c / sum(failures.values()) for f, c in failures.items()})
        culprits = Counter(str(x[10]) for x in own if x[10] is not None)
        assert r["culprits"] == dict(culprits) and r["residual"] < 1e-12
        lost = Counter(x[4] for x in own if not x[8])
        assert r["family_shares"] == pytest.approx({f: c / (n - st) for f, c in lost.items()})
    flat = E.flattened(E.profiles(spark.createDataFrame(rows, FACT)), "ref", ["ref_id"])
    assert len(flat.columns) == 14 and all(c.startswith("ref_") for c in flat.columns)


def test_no_failures_have_zero_shares(spark):
    rows = [(0, 1, "reference", o, "blur", 0.0, 1, 1, 1, "stable", None, 1, 1) for o in range(3)]
    f = spark.createDataFrame(rows, FACT)
    assert {r["share"] for r in E.failure_causes(f, ["model"]).collect()} == {0.0} and E.family_risk(f, ["model"]).first()["share"] == 0.0
    assert E.culprits(f, ["model"]).count() == 0


def test_sample_table_in_one_pass(spark):
    rows = drawn_facts(5)
    plan = E.sample_table(spark.createDataFrame(rows, FACT), [1, 3])
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
    got = {(r["ref_id"], r["budget"]): r for r in plan.collect()}
    for s in range(30):
        for b in (1, 3):
            d = [x for x in rows if x[1] == s and x[2] == "diagnostic" and x[3] < b and x[11]]
            assert (got[s, b]["d_n"], got[s, b]["d_k"]) == (len(d), sum(x[8] for x in d))


def test_re_runs_at_more_exposures(spark):
    outcome = lambda *s: [(e, int(x == "stable"), x) for e, x in zip((20, 30), s)]
    rows = [(0, 1, "stable", 1, outcome("stable", "winner_missing")), (0, 0, "winner_missing", 0, outcome("competitor_missing", "stable")), (0, 0, "winner_missing", 1, outcome("winner_missing", "stable"))]
    df = spark.createDataFrame(rows, "model int, old_stable int, old_failure string, same_prefix int, outcomes array<struct<exposure:int,stable:int,failure:string>>")
    got = {r["exposure"]: r for r in E.exposure_deltas(df, ["model"], trials=100).collect()}
    assert (got[30]["net_changes"], got[30]["fail_to_stable"], got[30]["stable_to_fail"], got[30]["delta"]) == (1, 2, 1, 0.01)
    assert (got[20]["stability_agreement"], got[20]["label_agreement"], got[20]["prefix_mismatches"]) == (1.0, pytest.approx(2 / 3), 1)


def test_cap_hits_in_order(spark):
    rows = [(2, 5, "reference", 0, "blur", 1.5, 9, 1, 20), (1, 4, "reference", 1, "jpeg", 50.0, 8, 1, 21), (1, 4, "reference", 0, "blur", 0.5, 7, 1, 25), (1, 4, "reference", 2, "blur", 0.5, 7, 1, 19), (1, 4, "diagnostic", 2, "blur", 0.5, 7, 1, 25), (3, 3, "reference", 2, "blur", 0.5, 7, 0, 25)]
    df = spark.createDataFrame(rows, "image_id int, ref_id int, split string, ord int, family string, severity double, seed int, eligible int, exposed int")
    import hashlib

    got = E.cap_hits(df, 20, ["reference"], limit=2).collect()
    assert [(r["image_id"], r["ord"]) for r in got] == [(1, 0), (1, 1)]
    assert got[0]["probe_id"] == hashlib.sha256(b'[1,4,"reference","blur",0.5,7]').hexdigest()[:20]


def test_first_examples_pivots_and_largest_budgets(spark):
    f = spark.createDataFrame(drawn_facts(7), FACT)
    first = {r["failure"]: (r["ref_id"], r["split"], r["ord"]) for r in E.first_examples(f, ["model"], ["ref_id", "split", "ord"]).collect()}
    rows = [r for r in drawn_facts(7) if r[11]]
    assert first == {c: min((r[1], r[2], r[3]) for r in rows if r[9] == c) for c in {r[9] for r in rows}}
    wide = E.pivoted(spark.createDataFrame([("a", "x", 2)], "g string, c string, v int"), ["g"], "c", ["x", "y"], "v").first()
    assert (wide["x"], wide["y"]) == (2, 0)
    t = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", 2)], "g string, budget int")
    assert sorted(map(tuple, E.largest_budget(t, ["g"]).collect())) == [("a", 3), ("a", 3), ("b", 2)]


# Resampling


def test_draws_are_uniform_and_apart():
    u = R.uniform(np.arange(3000), np.arange(200), 0, 5)
    assert 0 < u.min() and u.max() < 1
    assert np.histogram(u, 20, (0, 1))[0] / u.size == pytest.approx(np.full(20, 0.05), abs=0.001)
    other = R.uniform(np.arange(3000), np.arange(200), 1, 5)
    for a, b in ((u[:-1], u[1:]), (u[:, :-1], u[:, 1:]), (u, other), (u, R.uniform(np.arange(3000), np.arange(200), 0, 6))):
        assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.01
    w = np.searchsorted(R.POISSON, u, side="left")
    assert (w.mean(), w.var()) == (pytest.approx(1, abs=0.01), pytest.approx(1, abs=0.02))


def test_bootstrap_is_near_the_analytic_error_however_rows_are_dealt(spark):
    v = np.random.default_rng(1).random(400)
    df = spark.createDataFrame([("g", k, float(x)) for k, x in enumerate(v)], "g string, ref_id int, v double")
    a = R.bootstrap_means(df, ["g"], "v", repetitions=400, seed=3).first()
    b = R.bootstrap_means(df.repartition(7), ["g"], "v", repetitions=400, seed=3).first()
    assert a["lower"] == pytest.approx(b["lower"]) and a["lower"] < v.mean() < a["upper"]
    assert a["se"] == pytest.approx(v.std() / 20, rel=0.2)
    assert R.bootstrap_means(df.limit(0), ["g"], "v", repetitions=5).count() == 0
    odd = spark.createDataFrame([("g", None, 1.0), ("g", 1, None), (None, 2, 0.5)], "g string, ref_id int, v double")
    assert R.bootstrap_means(odd, ["g"], "v", repetitions=20).count() == 2


def test_two_stages_are_wider_than_one(spark):
    k = np.random.default_rng(2).binomial(4, 0.6, 500)
    df = spark.createDataFrame([(0, i, 4, int(x), float(x / 4), 1) for i, x in enumerate(k)], "model int, ref_id int, n int, k int, v double, budget int")
    one_ = R.bootstrap_means(df, ["model"], "v", repetitions=600, seed=1).first()["se"]
    two = R.hierarchical(df, "model", ["budget"], "n", "k", repetitions=600, seed=1)[0].first()["se"]
    p = k / 4
    between, within = p.var() / 500, (p * (1 - p)).mean() / 2000
    assert one_**2 == pytest.approx(between, rel=0.2) and two**2 == pytest.approx(between + 2 * within, rel=0.2)  # copies share their trials
    units = df.select("model", "ref_id", F.lit(1).alias("eligible"), "n", F.col("n").alias("n_covered"), F.col("k").alias("n_stable"))
    own = {r["statistic"]: r["se"] for r in R.nested(units, ["model"], repetitions=600, seed=1).collect()}
    assert own["full_operational"] ** 2 == pytest.approx(between + within, rel=0.2) and own["coverage"] == 0  # copies have their own


def test_trials_are_nested_binomials():
    n = np.array([0, 3, 10])
    p, q = np.array([0.5, 0.6, 0.7]), np.array([0.2, 0.6, 0.1])
    a, b = R.trials(n.astype(float), [p, q], R.states(np.arange(3), np.arange(4000), 9))
    assert (b <= a).all() and a.mean(axis=1) == pytest.approx(n * p, abs=0.15) and b.mean(axis=1) == pytest.approx(n * q, abs=0.15)
    assert a[2].var() == pytest.approx(10 * 0.7 * 0.3, rel=0.1)


def test_draws_of_whole_numbers_are_those_of_fractions():
    state = R.states(np.arange(-3, 500) * 7919, np.arange(64), 9)
    u = R.drawn(state, 0)
    assert state.dtype == np.uint32 and R.CELLS * state.itemsize <= 1 << 20  # a block's array stays near the processor
    assert (R.weights(state) == np.searchsorted(R.POISSON, u, side="left")).all()
    p = np.array([0.0, 1e-12, 0.5, 1 / 3, 1 - 1e-12, 1.0, float(u[7, 0]), np.nextafter(u[7, 0], 2)])
    assert ((R.numbers(state, 0)[..., None] < R.limits(p)) == (u[..., None] < p)).all()


def test_sums_are_those_of_each_unit_drawn_by_itself(spark):
    rows = [(g, i % 40, n, k) for i in range(90) for g, n, k in (("a", i % 4, min(i % 3, i % 4)), (None, 3, i % 4))] + [("a", None, 2, 1)]
    df = spark.createDataFrame(rows, "g string, i long, n int, k int")
    want = {}
    for g, i, n, k in rows:
        state = R.states(np.array([i or 0]), np.arange(50), 6)
        w = np.searchsorted(R.POISSON, R.drawn(state, 0), side="left")[0]
        hits = sum((R.drawn(state, 1 + t)[0] < k / n).astype(int) for t in range(n)) if n else np.zeros(50)
        want[g] = want.get(g, 0) + np.stack([w * hits / max(n, 1), w])
    for parts in (1, 7):
        got = {r["g"]: r for r in R.hierarchical(df.repartition(parts), "g", [], "n", "k", "i", repetitions=50, seed=6)[0].collect()}
        assert {g: r["mean"] for g, r in got.items()} == {g: pytest.approx((m / w).mean()) for g, (m, w) in want.items()}


def test_split_halves_dont_depend_on_how_units_are_dealt(spark):
    rows = [("m", i, f, n, k, int(i % 5 > 0)) for i in range(200) for f, n, k in (("a", 2 + 2 * (i % 3), 1 + i % 2), ("b", 4, i % 5), ("c", 2 * (i % 2), 0), ("d", 2, 1))]
    df = spark.createDataFrame(rows, "model string, ref_id long, family string, n int, k int, eligible int")
    halves = lambda x: sorted(map(tuple, R.split_halves(x, ["model"], "family", "n", "k", "eligible", repetitions=9, seed=4).collect()))
    whole = halves(df)
    parts = {}
    for at in range(0, 200, 40):
        for *key, units in halves(df.filter(f"ref_id >= {at} AND ref_id < {at + 40}")):
            parts[tuple(key)] = parts.get(tuple(key), 0) + units
    assert whole == sorted((*k, n) for k, n in parts.items())


def test_split_halves_are_hypergeometric(spark):
    rows = [(0, i, f, n, k, 1) for i in range(300) for f, n, k in (("a", 4, 3), ("b", 6, 2))] + [(0, 999, "a", 2, 2, 0)]
    df = spark.createDataFrame(rows, "model int, ref_id int, family string, n int, k int, eligible int")
    cells = R.split_halves(df, ["model"], "family", "n", "k", "eligible", repetitions=20, seed=4).toPandas()
    full, ok = (cells[cells.scope == s] for s in ("full_manifest", "clean_eligible"))
    assert full.groupby("rep").units.sum().eq(301).all() and ok.groupby("rep").units.sum().eq(300).all()
    hyper = lambda k, good, total, half: math.comb(good, k) * math.comb(total - good, half - k) / math.comb(total, half)
    want = Counter()
    for a in range(3):
        for b in range(3):
            want[(a + b) / 5] += hyper(a, 3, 4, 2) * hyper(b, 2, 6, 3)
    seen = ok.groupby("left").units.sum() / ok.units.sum()
    assert {x: seen.get(x, 0) for x in want if want[x]} == pytest.approx({x: w for x, w in want.items() if w}, abs=0.02)
    assert (ok.left + ok.right).round(9).eq(1.0).all()
    with pytest.raises(Exception, match="odd number"):
        R.split_halves(df.withColumn("n", F.lit(3)), ["model"], "family", "n", "k", "eligible", repetitions=2).count()


def test_paired_metrics_and_their_summary(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 6, 80) / 5, rng.integers(0, 6, 80) / 5
    r = R.paired_metrics(spark.createDataFrame([(0, float(x), float(y)) for x, y in zip(a, b)], "g int, left double, right double"), ["g"]).first()
    d = a - b
    assert (r["mean_left"], r["mean_right"], r["signed_difference"], r["absolute_difference"]) == tuple(pytest.approx(x) for x in (a.mean(), b.mean(), d.mean(), abs(d.mean())))
    assert (r["sample_mae"], r["sample_rmse"]) == (pytest.approx(np.abs(d).mean()), pytest.approx(math.sqrt((d * d).mean())))
    assert r["sample_spearman"] == pytest.approx(pd.Series(a).rank().corr(pd.Series(b).rank()))
    m = spark.createDataFrame([("s", float(x), 1.0, 2.0, None if i else 0.5) for i, x in enumerate(a)], "scope string, absolute_difference double, sample_mae double, sample_rmse double, sample_spearman double")
    s = {x["metric"]: x for x in R.split_half_summary(m, ["scope"]).collect()}
    assert s["absolute_difference"]["p95"] == pytest.approx(np.quantile(a, 0.95)) and s["sample_spearman"]["repetitions"] == 1


def test_adequacy(spark):
    c = spark.createDataFrame([("x", 400, 0.6, 0.05, 0.1), ("y", 400, 0.6, 0.001, 0.2)], "model string, units int, theta double, between double, within double")
    h = spark.createDataFrame([("x", 0.004), ("y", 0.02)], "model string, p95 double")
    e = spark.createDataFrame([("x", 380), ("y", 200)], "model string, eligible int")
    got = {r["model"]: r for r in S.adequacy(c, h, e, ["model"], probes=40).collect()}
    assert got["x"]["adequate"] and not got["y"]["adequate"] and not got["y"]["split_pass"]
    assert got["x"]["se"] == pytest.approx(math.sqrt(0.05 / 400 + 0.1 / 16000)) and got["y"]["sample_rmse"] == pytest.approx(math.sqrt(0.2 / (0.5 * 40)))
    assert got["x"]["excess"] == pytest.approx(got["x"]["se"] / math.sqrt(0.05 / 400) - 1)
    with pytest.raises(Exception, match="not unique"):
        S.adequacy(c, h.union(h), e, ["model"]).collect()


def test_nested_resampling_finds_the_formula(spark):
    k = np.random.default_rng(6).binomial(8, 0.7, 300)
    df = spark.createDataFrame([("m", 8, int(x)) for x in k], "model string, n int, n_stable int")
    rows = R.nested_validation(df, ["model"], "n", "n_stable", [50, 1000], [1, 20], repetitions=3000).collect()
    assert {(r["units"], r["probes"]) for r in rows} == {(50, 1), (50, 20), (300, 1), (300, 20)}
    assert all(r["variance_ratio"] == pytest.approx(1, abs=0.12) and abs(r["bias"]) < 0.01 for r in rows)


# Registries, grids and keys


def test_probe_registry_is_balanced_and_shared(spark):
    draw = lambda r: (lambda g: [S.stratified_probes(g, n, scalars.PROBE_LAW) for n in (2, 4)])(S.generator(1, 2, r))
    assert draw(3) == draw(3) != draw(4)
    for own in draw(3):
        for k in range(0, len(own), 5):
            assert sorted(p[0] for p in own[k : k + 5]) == sorted(scalars.FAMILIES)
    got = S.probe_registry(spark.createDataFrame([(2, 3)], "image_id long, ref_id long"), 2, 4, 1, scalars.PROBE_LAW).collect()
    assert [tuple(r)[4:] for r in got] == [p for own in draw(3) for p in own]
    assert [(r["split"], r["ord"]) for r in got] == [("diagnostic", k) for k in range(10)] + [("reference", k) for k in range(20)]


def test_mixture_probes_follow_the_weights():
    law = [("a", 3.0, 0.0, 1.0), ("b", 1.0, 5.0, 5.0), ("c", 0.0, 0.0, 1.0)]
    rng = np.random.default_rng(0)
    seen = [S.mixture_probe(rng, law) for _ in range(2000)]
    n = Counter(x[0] for x in seen)
    assert n["c"] == 0 and n["a"] / 2000 == pytest.approx(0.75, abs=0.04) and all(0 <= x[2] < 2**31 - 1 for x in seen)
    assert all(x[1] == 5 for x in seen if x[0] == "b")
    for bad in ([], [("a", -1.0, 0, 1), ("b", 2.0, 0, 1)], [("a", 0.0, 0, 1)], [("a", 1.0, 2, 1)]):
        with pytest.raises(ValueError):
            S.mixture_probe(rng, bad)


def test_budgets_are_whole_blocks():
    assert S.balanced_budgets([5, 20, 40], 40, 5) == [5, 20, 40]
    for bad in ([5, 45], [7], [], [0, 5]):
        with pytest.raises(ValueError):
            S.balanced_budgets(bad, 40, 5)


def test_envelopes_gaps_and_factors(spark):
    rng = np.random.default_rng(4)
    v = {m: rng.random(6).round(3) for m in "abc"}
    df = spark.createDataFrame([(m, k, float(x)) for m, xs in v.items() for k, x in enumerate(xs)], "model string, setting_index int, theta double")
    for r in grid.envelope(df, ["model"], default=3).collect():
        x = v[r["model"]]
        assert (r["width"], r["max_departure"], r["minimum_index"], r["maximum_index"]) == (pytest.approx(np.ptp(x)), pytest.approx(np.abs(x - x[3]).max()), x.argmin(), x.argmax())
    for r in grid.pair_gaps(df).collect():
        a, b = v[r["model_a"]], v[r["model_b"]]
        assert (r["min_gap"], r["max_gap"], r["strong_gap"], r["worst_index"]) == (pytest.approx((a - b).min()), pytest.approx((a - b).max()), pytest.approx(a.min() - b.max()), (a - b).argmin())
        assert r["invariant"] == ((a > b).all() or (a < b).all())
    with pytest.raises(Exception, match="same settings"):
        grid.pair_gaps(df.filter("NOT (model = 'b' AND setting_index = 2)")).collect()
    cells = spark.createDataFrame([(x, y, float(10 * x + y)) for x in (1, 2, 3) for y in (5, 6)], "x int, y int, theta double")
    got = {r["factor"]: (r["tested"], r["range"], r["at_default"]) for r in grid.one_factor(cells, [], {"x": 2, "y": 6}).collect()}
    assert got == {"x": ("1.00;2.00;3.00", 20.0, 26.0), "y": ("5.00;6.00", 1.0, 26.0)}


def test_optimism_from_shares_is_that_of_outcomes(spark):
    # 10 samples, 8 eligible with 5 probes each: 40 trials, of which 6, 4, 2 not covered and 3 reversed.
    t = spark.createDataFrame([("m", 0, 5, 20, 0.1, 0.7, 0.8, 25 / 50, 25 / 40, 6 / 15, 4 / 15, 2 / 15, 3 / 15)], "model string, setting_index int, kt int, ke int, match double, birth double, eligibility double, theta double, eligible_theta double, winner_missing_share double, competitor_missing_share double, threatening_birth_share double, ranking_reversal_share double")
    r = grid.optimism(t, ["model"]).first()
    assert (r["coverage"], r["complete_case"], r["total_optimism"]) == (pytest.approx(28 / 40), pytest.approx(25 / 28), pytest.approx(25 / 28 - 0.5)) and r["residual"] < 1e-12


def test_keys_of_one_side_take_one_aggregation(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (2, 5), (None, 3), (4, None)], "i int, r int")
    b = spark.createDataFrame([(2, 5), (3, 0), (3, 0), (None, 3)], "i int, r int")
    m = joins.missing_keys(a, b, ["i", "r"])
    assert sorted(map(str, map(tuple, m.collect()))) == sorted(map(str, [(1, 1, "left"), (None, 3, "left"), (4, None, "left"), (3, 0, "right"), (None, 3, "right")]))
    assert "Join" not in m._jdf.queryExecution().optimizedPlan().toString() and joins.missing_keys(a.limit(0), a.limit(0), ["i"]).count() == 0


def test_profiles_and_intervals_need_no_join(spark):
    df = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate([(0, 4), (3, 3), (2, 7), (2, 7), (0, 0), (None, 2), (1, None)])], "i int, k int, n int")
    a = S.with_intervals(df, "k", "n")
    got = {r["i"]: (r["lower"], r["upper"]) for r in a.collect()}
    assert got == {i: S.clopper_pearson(k, n) if k is not None and n else (None, None) for i, k, n in map(tuple, df.collect())}
    with pytest.raises(Exception, match="0 <= k <= n"):
        S.with_intervals(df.filter("i = 0").withColumn("k", F.lit(9)), "k", "n").collect()
    facts = spark.createDataFrame([], FACT)
    assert "Join" not in E.profiles(facts)._jdf.queryExecution().optimizedPlan().toString() + a._jdf.queryExecution().optimizedPlan().toString()


def test_key_operations(spark):
    log = spark.createDataFrame([(1, 10, "old", 0), (2, 20, "only", 1), (1, 10, "new", 2)], "i int, r int, v string, n int")
    assert {x["v"] for x in joins.latest(log, ["i", "r"], "n").collect()} == {"only", "new"}
    keys = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "i int, r int")
    trace = keys.filter("i = 1")
    assert {x["i"] for x in joins.pending(keys, keys.filter("i < 3"), trace, ["i", "r"]).collect()} == {2, 3}
    for join in (joins.one_to_one, joins.many_to_one):
        with pytest.raises(Exception, match="not unique"):
            join(keys, log, ["i", "r"]).collect()
    assert joins.many_to_one(log, keys, ["i", "r"]).count() == 3 and joins.one_to_one(keys, keys, ["i", "r"]).count() == 3
    assert joins.required(log, keys, ["i", "r"]).count() == 3
    with pytest.raises(Exception, match="no row for"):
        joins.required(keys, log.filter("n > 0"), ["i", "r"]).collect()
    assert joins.duplicate_count(log, ["i", "r"]).first()[0] == 1 and joins.duplicate_count(log.limit(0), ["i"]).first()[0] == 0
    shared = {(r["left"], r["right"]): r["shared"] for r in joins.overlaps({"k": keys, "l": log, "n": keys.limit(0)}, "i").collect()}
    assert shared == {("k", "l"): 2, ("k", "n"): 0, ("l", "n"): 0}
