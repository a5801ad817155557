"""Profiles with intervals, budget and adequacy tables, resampling, violation counts and manifests over derived tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import estimands as E
from ..operators import joins, manifests, validators
from ..operators import resampling as R
from ..operators import statistics as S
from .fixtures import FACTS_SQL, facts
from .queries import BUDGETS, COMP, FP, STRENGTH, optimism_sql
from .registry import add, on_facts

#: Repetitions of the bootstraps of units, and of those that draw trials as well.
UNITS_DRAWN, TRIALS_DRAWN = 2000, 200


def interval_sql(source: str, name: str = "cp") -> str:
    """CTE of exact intervals of all (k, n) of ``source``, by halving; for ``WITH RECURSIVE``."""
    tail = "list_sum(list_transform(range((k + side)::BIGINT, n + 1), lambda i: factorial(n::INT) / (factorial(i::INT) * factorial((n - i)::INT))::DOUBLE * pow((lo + hi) / 2, i) * pow(1 - (lo + hi) / 2, n - i)))"
    return f"""{name}_h AS (SELECT k, n, side, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM (SELECT DISTINCT k::BIGINT AS k, n::BIGINT AS n FROM {source} WHERE n > 0), (VALUES (0), (1)) s(side)
  UNION ALL SELECT k, n, side, CASE WHEN coalesce({tail}, 0) < CASE side WHEN 0 THEN 0.025 ELSE 0.975 END THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN coalesce({tail}, 0) < CASE side WHEN 0 THEN 0.025 ELSE 0.975 END THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM {name}_h WHERE step < 60),
{name} AS (SELECT k, n, CASE WHEN k = 0 THEN 0.0 ELSE max(CASE WHEN side = 0 THEN lo END) END AS lower, CASE WHEN k = n THEN 1.0 ELSE max(CASE WHEN side = 1 THEN hi END) END AS upper FROM {name}_h WHERE step = 60 GROUP BY k, n)"""


# Profiles

PROFILE = """pf AS (SELECT model, ref_id, split, count(*) AS probes, sum(coverage) AS covered, sum(stable) AS stable, count(*) FILTER (WHERE failure <> 'stable') AS failures,
  count(*) FILTER (WHERE failure = 'winner_missing') AS wm, count(*) FILTER (WHERE culprit = 1) AS c1, count(culprit) AS cs, count(*) FILTER (WHERE family = 'blur' AND stable = 0) AS blur FROM f WHERE eligible = 1 GROUP BY ALL),
kn AS (SELECT covered AS k, probes AS n FROM pf UNION SELECT stable, covered FROM pf UNION SELECT stable, probes FROM pf)"""
_flat = ["probe_count"] + [f"{o}{e}" for o in ("coverage", "conditional_ranking", "operational") for e in ("", "_lower", "_upper")] + ["coverage_risk", "ranking_risk", "risk_decomposition_error"]


def _profiles(f: DataFrame) -> DataFrame:
    p = E.profiles(f)
    keys = ["model", "ref_id", "split"]
    pick = lambda m, k: F.coalesce(F.element_at(m, F.lit(k)), F.lit(0.0))
    extra = {"winner_missing_share": pick("failure_shares", "winner_missing"), "first_culprit_share": pick("culprit_shares", "1"), "blur_share": pick("family_shares", "blur"), "culprit_kinds": F.size(F.map_keys("culprits"))}
    flat = E.flattened(p.withColumns(extra), "own", [*keys, *extra])  # in one row: no join
    return flat.select(*keys, *[c for c in flat.columns if c not in keys and c not in extra], *extra)


add(
    "sample_profiles",
    on_facts(_profiles),
    f"""SELECT model, ref_id, split, probes AS own_probe_count, covered / probes::DOUBLE AS own_coverage, a.lower AS own_coverage_lower, a.upper AS own_coverage_upper,
        stable / nullif(covered, 0)::DOUBLE AS own_conditional_ranking, b.lower AS own_conditional_ranking_lower, b.upper AS own_conditional_ranking_upper,
        stable / probes::DOUBLE AS own_operational, c.lower AS own_operational_lower, c.upper AS own_operational_upper, 1 - covered / probes::DOUBLE AS own_coverage_risk,
        covered / probes::DOUBLE * (1 - coalesce(stable / nullif(covered, 0)::DOUBLE, 0)) AS own_ranking_risk, 0.0::DOUBLE AS own_risk_decomposition_error,
        coalesce(wm / nullif(failures, 0)::DOUBLE, 0) AS winner_missing_share, coalesce(c1 / nullif(cs, 0)::DOUBLE, 0) AS first_culprit_share, coalesce(blur / nullif(failures, 0)::DOUBLE, 0) AS blur_share, kinds AS culprit_kinds
        FROM pf JOIN (SELECT model, ref_id, split, count(DISTINCT culprit) AS kinds FROM f WHERE eligible = 1 GROUP BY ALL) USING (model, ref_id, split)
        LEFT JOIN cp a ON a.k = covered AND a.n = probes LEFT JOIN cp b ON b.k = stable AND b.n = covered LEFT JOIN cp c ON c.k = stable AND c.n = probes""",
    f"RECURSIVE {FACTS_SQL}, {PROFILE}, {interval_sql('kn')}",
    " ".join(f"own_{c}" for c in _flat[1:]) + " winner_missing_share first_culprit_share blur_share",
    "model ref_id own_probe_count culprit_kinds",
)
REFERENCE = "rs AS (SELECT model, ref_id, count(*) AS n, sum(stable) AS k, sum(coverage) AS c FROM f WHERE eligible = 1 AND split = 'reference' GROUP BY ALL)"
_reference = lambda f: E.sample_stats(f).filter("split = 'reference'")
add(
    "interval_width_quantiles",
    on_facts(lambda f: S.interval_summary(S.with_intervals(_reference(f), "n_stable", "n"), ["model"])),
    """SELECT model, count(*) AS units, avg(w) AS mean, quantile_cont(w, 0.5) AS median, quantile_cont(w, 0.9) AS p90, quantile_cont(w, 0.95) AS p95, max(w) AS max, avg((w <= 0.1)::INT) AS within_tenth, avg((w <= 0.2)::INT) AS within_fifth
       FROM (SELECT model, upper - lower AS w FROM rs JOIN cp USING (k, n)) GROUP BY model""",
    f"RECURSIVE {FACTS_SQL}, {REFERENCE}, {interval_sql('rs')}",
    "mean median p90 p95 max within_tenth within_fifth",
    "model units",
)

# Budgets

_vals = ", ".join(f"({b})" for b in BUDGETS)
TABLE = f"""{REFERENCE}, sa AS (SELECT model, ref_id, max(eligible) AS eligible, max(correct) AS correct FROM f GROUP BY ALL),
db AS (SELECT model, ref_id, budget, count(*) AS dn, sum(coverage) AS dc, sum(stable) AS dk FROM f, (VALUES {_vals}) b(budget) WHERE eligible = 1 AND split = 'diagnostic' AND ord < budget GROUP BY ALL),
es AS (SELECT sa.*, b.budget, dn, dc, dk, CASE WHEN eligible = 1 THEN dk / dn::DOUBLE ELSE 0 END AS d, CASE WHEN eligible = 1 THEN rs.k / rs.n::DOUBLE ELSE 0 END AS r, dk / nullif(dc, 0)::DOUBLE AS direct
  FROM sa CROSS JOIN (VALUES {_vals}) b(budget) LEFT JOIN db ON sa.model = db.model AND sa.ref_id = db.ref_id AND b.budget = db.budget LEFT JOIN rs ON sa.model = rs.model AND sa.ref_id = rs.ref_id
  WHERE eligible = 0 OR (dn > 0 AND rs.n > 0))"""


def rank_sql(source: str, by: str, a: str, b: str) -> str:
    """Rank correlation of two columns by group: ``by, rho``; null below three rows."""
    r = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"
    return f"(SELECT {by}, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS rho FROM (SELECT {by}, {r(a)} AS x, {r(b)} AS y FROM {source}) GROUP BY ALL)"


add(
    "budget_table",
    on_facts(lambda f: E.budget_table(f, BUDGETS)),
    f"""SELECT g.*, x.rho AS spearman, y.rho AS spearman_eligible FROM (SELECT model, budget, count(*) AS samples, sum(eligible) AS eligible, avg(eligible) AS eligibility, avg(d) AS diagnostic_mean, avg(r) AS reference_mean,
        avg(d) FILTER (WHERE eligible = 1) AS diagnostic_eligible_mean, avg(r) FILTER (WHERE eligible = 1) AS reference_eligible_mean, avg(abs(d - r)) AS mae, sqrt(avg((d - r) * (d - r))) AS rmse, avg(d - r) AS bias,
        avg(abs(d - r)) FILTER (WHERE eligible = 1) AS mae_eligible, avg((r >= lower AND r <= upper)::INT) FILTER (WHERE eligible = 1) AS inside_interval, avg(upper - lower) AS mean_width
        FROM es LEFT JOIN cp ON es.dk = cp.k AND es.dn = cp.n GROUP BY model, budget) g
        LEFT JOIN {rank_sql("es", "model, budget", "d", "r")} x ON g.model = x.model AND g.budget = x.budget
        LEFT JOIN {rank_sql("(SELECT * FROM es WHERE eligible = 1)", "model, budget", "d", "r")} y ON g.model = y.model AND g.budget = y.budget""",
    f"RECURSIVE {FACTS_SQL}, {TABLE}, {interval_sql('(SELECT dk AS k, dn AS n FROM db)')}",
    "eligibility diagnostic_mean reference_mean diagnostic_eligible_mean reference_eligible_mean mae rmse bias mae_eligible inside_interval mean_width spearman spearman_eligible",
    "model budget samples eligible",
)
PRED = """pt AS (SELECT model, budget, 'full_manifest' AS scope, 'operational' AS predictor, d AS p, r FROM es UNION ALL SELECT model, budget, 'paired_complete_cases', 'operational', CASE WHEN direct IS NOT NULL THEN d END, r FROM es
  UNION ALL SELECT model, budget, 'paired_complete_cases', 'complete_case', direct, r FROM es)"""
add(
    "predictor_table",
    on_facts(lambda f: E.predictive_tables(f, BUDGETS)[0]),
    "SELECT model, budget, scope, predictor, count(p) / count(*)::DOUBLE AS availability, count(p) AS n, avg(p - r) AS bias, avg(abs(p - r)) AS mae, sqrt(avg((p - r) * (p - r))) AS rmse, avg(p * p - 2 * p * r + r) FILTER (WHERE p IS NOT NULL) AS brier FROM pt GROUP BY ALL",
    f"{FACTS_SQL}, {TABLE}, {PRED}",
    "availability bias mae rmse brier",
    "model budget n",
)
add(
    "predictor_calibration",
    on_facts(lambda f: E.predictive_tables(f, BUDGETS)[1]),
    "SELECT model, budget, predictor, least(trunc(p * 10), 9) AS bin, count(*) AS n, avg(p) AS predicted, avg(r) AS observed, avg(p) - avg(r) AS gap FROM pt WHERE scope = 'paired_complete_cases' AND p IS NOT NULL GROUP BY ALL",
    f"{FACTS_SQL}, {TABLE}, {PRED}",
    "predicted observed gap",
    "model budget bin n",
)
add(
    "finite_probe_by_scope",
    on_facts(lambda f: E.finite_probe_by_scope(f, F.concat(F.lit("split_"), (F.col("ref_id") % 2).cast("string")), BUDGETS)),
    f"""SELECT g.*, x.rho AS spearman_eligible FROM (SELECT scope, budget, count(*) AS samples, sum(eligible) AS eligible, avg(d - r) AS bias, avg(abs(d - r)) FILTER (WHERE eligible = 1) AS mae_eligible FROM sc GROUP BY ALL) g
        LEFT JOIN {rank_sql("(SELECT * FROM sc WHERE eligible = 1)", "scope, budget", "d", "r")} x ON g.scope = x.scope AND g.budget = x.budget""",
    f"{FACTS_SQL}, {TABLE}, sc AS (SELECT *, 'split_' || (ref_id % 2) AS scope FROM es)",
    "bias mae_eligible spearman_eligible",
    "budget samples eligible",
)
add(
    "largest_budget_rows",
    on_facts(lambda f: E.largest_budget(E.sample_table(f, BUDGETS), ["model"]).select("model", "ref_id", "budget", "d_n", "d_k", "r_n", "r_k")),
    f"""SELECT sa.model, sa.ref_id, {max(BUDGETS)} AS budget, coalesce(dn, 0) AS d_n, coalesce(dk, 0) AS d_k, coalesce(n, 0) AS r_n, coalesce(k, 0) AS r_k
        FROM sa LEFT JOIN (SELECT * FROM db WHERE budget = {max(BUDGETS)}) d ON sa.model = d.model AND sa.ref_id = d.ref_id LEFT JOIN rs ON sa.model = rs.model AND sa.ref_id = rs.ref_id""",
    f"{FACTS_SQL}, {TABLE}",
    ints="model ref_id budget d_n d_k r_n r_k",
)
add(
    "family_budget_shift",
    on_facts(lambda f: E.budget_against_reference(f, BUDGETS)),
    f"""SELECT x.*, reference_risk, risk - reference_risk AS shift FROM (SELECT model, budget, family, count(*) AS n, 1 - avg(stable) AS risk FROM f, (VALUES {_vals}) b(budget) WHERE eligible = 1 AND split = 'diagnostic' AND ord < budget GROUP BY ALL) x
        JOIN (SELECT model, family, 1 - avg(stable) AS reference_risk FROM f WHERE eligible = 1 AND split = 'reference' GROUP BY ALL) y ON x.model = y.model AND x.family = y.family""",
    doubles="risk reference_risk shift",
    ints="model budget n",
)
F_SQL = optimism_sql("""SELECT model, family, samples, eligible_samples, eligible_trials, eligible_samples / samples::DOUBLE AS eligibility, covered / nullif(eligible_trials, 0)::DOUBLE AS coverage, stable / nullif(covered, 0)::DOUBLE AS complete_case,
  stable / nullif(eligible_trials, 0)::DOUBLE AS eligible_operational, stable / (samples * (eligible_trials / nullif(eligible_samples, 0)::DOUBLE)) AS full_operational
  FROM (SELECT model, family, sum(eligible) AS eligible_trials, sum(eligible * coverage) AS covered, sum(eligible * stable) AS stable FROM f GROUP BY ALL)
  JOIN (SELECT model, count(*) AS samples, sum(e) AS eligible_samples FROM (SELECT model, ref_id, max(eligible) AS e FROM f GROUP BY ALL) GROUP BY model) USING (model)""")
add(
    "family_estimands",
    on_facts(lambda f: E.family_estimands(f, ["model"])),
    F_SQL,
    doubles="eligibility coverage complete_case eligible_operational full_operational optimism optimism_coverage optimism_eligibility residual residual_coverage residual_eligibility",
    ints="model samples eligible_samples eligible_trials",
)

# Components and adequacy

_comp = lambda f: S.variance_components(_reference(f), ["model"])
add("truncation_audit", on_facts(lambda f: S.truncation_audit(_comp(f), ["model"])), 'SELECT model, between_raw, between_ AS "between", between_raw < 0 AS truncated, between_ - between_raw AS adjustment FROM c0', f"{FACTS_SQL}, {COMP}", 'between_raw "between" adjustment', "model")
add(
    "plugin_components",
    on_facts(lambda f: S.plugin_components(_reference(f), ["model"])),
    'SELECT model, count(*) AS units, avg(k / n::DOUBLE) AS theta, var_pop(k / n::DOUBLE) AS "between", avg(k / n::DOUBLE * (1 - k / n::DOUBLE)) AS within FROM rs GROUP BY model',
    f"{FACTS_SQL}, {REFERENCE}",
    'theta "between" within',
    "model units",
)
add(
    "matrix_violations",
    on_facts(lambda f: S.matrix_violations(f.filter("eligible = 1 AND split = 'reference'").withColumn("v", F.when(F.col("ord") == 3, F.lit(None)).otherwise(F.col("stable") + (F.col("ord") == 2).cast("int"))), ["model"], "ref_id", "v")),
    """SELECT model, rule, n FROM (SELECT model, unnest([{'rule': 'fewer_than_two_units', 'n': (units < 2)::BIGINT}, {'rule': 'fewer_than_two_probes', 'n': (lo < 2)::BIGINT}, {'rule': 'unequal_units', 'n': (lo <> hi)::BIGINT},
       {'rule': 'not_finite', 'n': bad::BIGINT}, {'rule': 'not_binary', 'n': other::BIGINT}], recursive := true) FROM (SELECT model, count(*) AS units, min(n) AS lo, max(n) AS hi, sum(bad) AS bad, sum(other) AS other FROM (
         SELECT model, ref_id, count(*) AS n, count(*) FILTER (WHERE ord = 3) AS bad, count(*) FILTER (WHERE ord <> 3 AND stable + (ord = 2)::INT > 1) AS other FROM f WHERE eligible = 1 AND split = 'reference' GROUP BY ALL) GROUP BY model)) WHERE n > 0""",
    ints="model n",
)


def _halves(f: DataFrame) -> DataFrame:
    """Units with an even number of probes of each family, by repeating each probe's outcome once."""
    n = f.groupBy("model", "ref_id", "family").agg((2 * F.count(F.lit(1))).alias("n"), F.sum(F.col("stable") + F.col("rank_stable").isNotNull().cast("int")).alias("k"), F.max("eligible").alias("eligible"))
    return R.split_halves(n, ["model"], "family", "n", "k", "eligible", repetitions=TRIALS_DRAWN, seed=3)


def _half_metrics(f: DataFrame) -> DataFrame:
    return R.paired_metrics(_halves(f), ["model", "scope", "rep"], units="units")


add("split_half_summary", on_facts(lambda f: R.split_half_summary(_half_metrics(f), ["model", "scope"])))


def _adequacy(f: DataFrame) -> DataFrame:
    halves = R.split_half_summary(_half_metrics(f), ["model", "scope"]).filter("scope = 'full_manifest' AND metric = 'absolute_difference'")
    eligible = E.samples(f).groupBy("model").agg(F.sum("eligible").alias("eligible"))
    return S.adequacy(_comp(f), halves, eligible, ["model"])


add("adequacy_table", on_facts(_adequacy))
SCOPES = "SELECT model, 'full_manifest' AS scope, diagnostic, reference FROM pr UNION ALL SELECT model, 'clean_eligible', diagnostic, reference FROM pr WHERE eligible = 1"


def _registries(f: DataFrame) -> DataFrame:
    a = E.paired_profiles(f).withColumn("scope", F.explode(F.when(F.col("eligible") == 1, F.array(F.lit("full_manifest"), F.lit("clean_eligible"))).otherwise(F.array(F.lit("full_manifest")))))
    rate = E.samples(f).groupBy("model").agg(F.avg("eligible").alias("eligibility"))
    return S.registry_comparison(R.paired_metrics(a, ["model", "scope"], "diagnostic", "reference"), _comp(f).select("model", "within").join(rate, "model"), ["model"])


add(
    "registry_comparison",
    on_facts(_registries),
    f"""SELECT m.*, rho AS sample_spearman, sqrt(w) AS predicted_rmse, sample_rmse / sqrt(w) AS rmse_ratio FROM (SELECT model, scope, avg(diagnostic) AS mean_left, avg(reference) AS mean_right, avg(diagnostic - reference) AS signed_difference,
        abs(avg(diagnostic - reference)) AS absolute_difference, avg(abs(diagnostic - reference)) AS sample_mae, sqrt(avg((diagnostic - reference) * (diagnostic - reference))) AS sample_rmse FROM sp GROUP BY ALL) m
        JOIN {rank_sql("sp", "model, scope", "diagnostic", "reference")} x ON m.model = x.model AND m.scope = x.scope
        JOIN (SELECT c0.model, scope, CASE WHEN scope = 'full_manifest' THEN within ELSE within / el END * (1 / 40.0::DOUBLE + 1 / 80.0::DOUBLE) AS w FROM c0 JOIN (SELECT model, avg(eligible) AS el FROM sm GROUP BY ALL) e ON c0.model = e.model,
              (VALUES ('full_manifest'), ('clean_eligible')) s(scope)) y ON m.model = y.model AND m.scope = y.scope""",
    f"{FP}, {COMP}, sp AS ({SCOPES})",
    "mean_left mean_right signed_difference absolute_difference sample_mae sample_rmse sample_spearman predicted_rmse rmse_ratio",
    "model",
)

# Resampling

Q = "quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.5) AS median, quantile_cont(m, 0.975) AS upper, avg(m) AS mean, stddev_samp(m) AS se"
Q_D = "lower median upper mean se"


def drawn_sql(source: str, seed: int, repetitions: int, sums: str, by: str) -> str:
    """Sums of weighted units of each repetition: ``by, rep`` and ``sums``, which name the weight ``w``."""
    return f"(SELECT {by}, rep, {sums} FROM (SELECT * EXCLUDE (u), {R.weight_sql()} AS w FROM ({R.uniform_sql(source, 'ref_id', seed, repetitions)})) GROUP BY ALL)"


add(
    "bootstrap_full_operational",
    on_facts(lambda f: R.bootstrap_means(E.paired_profiles(f), ["model"], "reference", repetitions=UNITS_DRAWN, seed=7)),
    f"SELECT model, {Q} FROM (SELECT model, n / d AS m FROM {drawn_sql('(SELECT model, ref_id, reference FROM pr)', 7, UNITS_DRAWN, 'sum(w * reference) AS n, sum(w) AS d', 'model')}) GROUP BY model",
    FP,
    Q_D,
    "model",
)
add(
    "bootstrap_ratio_coverage",
    on_facts(lambda f: R.bootstrap_ratios(_reference(f), ["model"], "n_stable", "n_covered", repetitions=UNITS_DRAWN, seed=11)),
    f"SELECT model, {Q} FROM (SELECT model, n / d::DOUBLE AS m FROM {drawn_sql('rs', 11, UNITS_DRAWN, 'sum(w * k) AS n, sum(w * c) AS d', 'model')}) GROUP BY model",
    f"{FACTS_SQL}, {REFERENCE}",
    Q_D,
    "model",
)
_paired = lambda values, seed: f"SELECT a.model AS group_a, b.model AS group_b, {Q} FROM (SELECT model, rep, n / d AS m FROM {values}) a, b"
add(
    "bootstrap_model_deltas",
    on_facts(lambda f: R.bootstrap_deltas(E.paired_profiles(f), "model", "reference", repetitions=UNITS_DRAWN, seed=5)),
    f"SELECT group_a, group_b, {Q} FROM (SELECT a.model AS group_a, b.model AS group_b, a.m - b.m AS m FROM mv a JOIN mv b ON a.rep = b.rep AND a.model < b.model) GROUP BY ALL",
    f"{FP}, mv AS (SELECT model, rep, n / d AS m FROM {drawn_sql('(SELECT model, ref_id, reference FROM pr)', 5, UNITS_DRAWN, 'sum(w * reference) AS n, sum(w) AS d', 'model')})",
    Q_D,
    "group_a group_b",
)


def _by_quality(f: DataFrame) -> DataFrame:
    """Samples' stability if probes of a quality below a limit are lost, for three limits."""
    t = F.explode(F.array(*[F.struct(F.lit(k).alias("setting_index"), F.lit(q).alias("q")) for k, q in enumerate((0.5, 0.7, 0.9))])).alias("s")
    a = f.select("model", "ref_id", "eligible", "stable", "quality", t)
    return a.groupBy("model", "ref_id", "s.setting_index").agg(F.avg((F.col("eligible") * F.col("stable") * (F.col("quality") >= F.col("s.q")).cast("int")).cast("double")).alias("v"))


add(
    "bootstrap_minimum_gap",
    on_facts(lambda f: R.bootstrap_minimum_gaps(_by_quality(f), "model", "setting_index", "v", repetitions=UNITS_DRAWN, seed=5)),
    f"""SELECT group_a, group_b, {Q} FROM (SELECT a.model AS group_a, b.model AS group_b, a.rep, min(a.m - b.m) AS m FROM mv a JOIN mv b ON a.rep = b.rep AND a.setting_index = b.setting_index AND a.model < b.model GROUP BY ALL) GROUP BY ALL""",
    f"""{FACTS_SQL}, qv AS (SELECT model, ref_id, setting_index, avg(eligible * stable * (quality >= q::DOUBLE)::INT) AS v FROM f, (VALUES (0, 0.5), (1, 0.7), (2, 0.9)) s(setting_index, q) GROUP BY ALL),
        mv AS (SELECT model, setting_index, rep, n / d AS m FROM {drawn_sql('qv', 5, UNITS_DRAWN, 'sum(w * v) AS n, sum(w) AS d', 'model, setting_index')})""",
    Q_D,
    "group_a group_b",
)
#: The most trials of a sample and split in the derived facts.
MOST = 8


def trials_sql(source: str, n: str, p: dict[str, str], seed: int, columns: str) -> str:
    """Units with ``w`` and, for each name of ``p``, how many of the ``n`` trials drawn anew are below it; one draw for all copies."""
    slots = ", ".join(map(str, range(MOST + 1)))
    hits = ", ".join(f"count(*) FILTER (WHERE slot BETWEEN 1 AND {n} AND u < {x}) AS {name}" for name, x in p.items())
    weight = f"sum(CASE WHEN slot = 0 THEN {R.weight_sql()} ELSE 0 END) AS w"
    return f"(SELECT {columns}, rep, {weight}, {hits} FROM ({R.uniform_sql(source, 'ref_id', seed, TRIALS_DRAWN, slots)}) GROUP BY ALL)"


def copies_sql(source: str, n: str, p: dict[str, str], seed: int, columns: str) -> str:
    """Copies of units with ``w`` = 1 and the hits of trials drawn anew for each copy; units without a copy or a trial have one row with ``w`` as it is and no hits."""
    own = f"(SELECT * EXCLUDE (u, slot), {R.weight_sql()} AS w0 FROM ({R.uniform_sql(source, 'ref_id', seed, TRIALS_DRAWN)}))"
    slots = ", ".join(map(str, range(11 * MOST + 1)))
    hits = ", ".join(f"count(*) FILTER (WHERE u < {x}) AS {name}" for name, x in p.items())
    some = f"(SELECT {columns}, rep, (slot - 1) // {n} AS copy, 1 AS w, {hits} FROM ({R.uniform_sql(source, 'ref_id', seed, TRIALS_DRAWN, slots, own, f'slot BETWEEN 1 AND w0 * {n}')}) GROUP BY ALL)"
    none = ", ".join(f"0 AS {name}" for name in p)
    return f"(SELECT * EXCLUDE (copy) FROM {some} UNION ALL SELECT {columns}, rep, w0 AS w, {none} FROM {own} WHERE w0 = 0 OR {n} = 0)"


def _hierarchical(f: DataFrame, part: int) -> DataFrame:
    t = E.sample_table(f, BUDGETS).withColumns({"d_n": F.when(F.col("eligible") == 1, F.col("d_n")).otherwise(0), "d_k": F.when(F.col("eligible") == 1, F.col("d_k")).otherwise(0)})
    return R.hierarchical(t, "model", ["budget"], "d_n", "d_k", repetitions=TRIALS_DRAWN, seed=13)[part]


HIER = f"""hu AS (SELECT sa.model, sa.ref_id, b.budget, coalesce(dn, 0) AS n, coalesce(dk, 0) AS k FROM sa CROSS JOIN (VALUES {_vals}) b(budget) LEFT JOIN db ON sa.model = db.model AND sa.ref_id = db.ref_id AND b.budget = db.budget),
hm AS (SELECT model, budget, rep, sum(w * hits / greatest(n, 1)::DOUBLE) / sum(w) AS m FROM {trials_sql("hu", "n", {"hits": "k / greatest(n, 1)::DOUBLE"}, 13, "model, ref_id, budget, n")} GROUP BY ALL)"""
add("bootstrap_hierarchical", on_facts(lambda f: _hierarchical(f, 0)), f"SELECT model, budget, {Q} FROM hm GROUP BY ALL", f"{FACTS_SQL}, {TABLE}, {HIER}", Q_D, "model budget")
add(
    "bootstrap_hierarchical_gaps",
    on_facts(lambda f: _hierarchical(f, 1)),
    f"SELECT group_a, group_b, budget, {Q} FROM (SELECT a.model AS group_a, b.model AS group_b, a.budget, a.m - b.m AS m FROM hm a JOIN hm b ON a.rep = b.rep AND a.budget = b.budget AND a.model < b.model) GROUP BY ALL",
    f"{FACTS_SQL}, {TABLE}, {HIER}",
    Q_D,
    "group_a group_b budget",
)


def _nested(f: DataFrame) -> DataFrame:
    t = E.sample_table(f).select("model", "ref_id", "eligible", F.col("r_n").alias("n"), F.col("r_c").alias("n_covered"), F.col("r_k").alias("n_stable"))
    return R.nested(t, ["model"], repetitions=TRIALS_DRAWN, seed=17)


add(
    "bootstrap_nested",
    on_facts(_nested),
    f"""SELECT model, statistic, {Q} FROM (SELECT model, unnest([{{'statistic': 'clean_eligibility', 'm': g}}, {{'statistic': 'coverage', 'm': cov}}, {{'statistic': 'complete_case', 'm': cc}}, {{'statistic': 'eligible_operational', 'm': op}},
          {{'statistic': 'full_operational', 'm': g * op}}, {{'statistic': 'coverage_optimism', 'm': cc - op}}, {{'statistic': 'eligibility_optimism', 'm': op - g * op}}, {{'statistic': 'total_optimism', 'm': cc - g * op}}], recursive := true)
        FROM (SELECT model, e / w::DOUBLE AS g, c / nullif(t, 0)::DOUBLE AS cov, s / nullif(c, 0)::DOUBLE AS cc, s / nullif(t, 0)::DOUBLE AS op FROM (
          SELECT model, rep, sum(w) AS w, sum(w * eligible) AS e, sum(w * n) AS t, sum(w * hc) AS c, sum(w * hs) AS s FROM {copies_sql("nu", "n", {"hc": "c / greatest(n, 1)::DOUBLE", "hs": "k / greatest(n, 1)::DOUBLE"}, 17, "model, ref_id, eligible, n")} GROUP BY ALL))) GROUP BY ALL""",
    f"{FACTS_SQL}, {TABLE}, nu AS (SELECT sa.model, sa.ref_id, eligible, coalesce(n, 0) AS n, coalesce(c, 0) AS c, coalesce(k, 0) AS k FROM sa LEFT JOIN rs ON sa.model = rs.model AND sa.ref_id = rs.ref_id)",
    Q_D,
    "model",
)
add(
    "bootstrap_predictors",
    on_facts(lambda f: R.predictor_differences(E.estimates(E.sample_table(f)), ["model"], "direct", "diagnostic", "reference", repetitions=TRIALS_DRAWN, seed=19)),
    f"""SELECT model, statistic, {Q} FROM (SELECT model, unnest([{{'statistic': 'mae_advantage', 'm': (a1 - a2) / w}}, {{'statistic': 'brier_advantage', 'm': (b1 - b2) / w}}, {{'statistic': 'absolute_bias_advantage', 'm': abs(e1 / w) - abs(e2 / w)}}], recursive := true)
        FROM {drawn_sql("pu", 19, TRIALS_DRAWN, "sum(w) AS w, sum(w * abs(direct - r)) AS a1, sum(w * abs(d - r)) AS a2, sum(w * (direct * direct - 2 * direct * r + r)) AS b1, sum(w * (d * d - 2 * d * r + r)) AS b2, sum(w * (direct - r)) AS e1, sum(w * (d - r)) AS e2", "model")}) GROUP BY ALL""",
    f"""{FP}, dc AS (SELECT model, ref_id, sum(stable) / nullif(sum(coverage), 0)::DOUBLE AS direct FROM f WHERE eligible = 1 AND split = 'diagnostic' GROUP BY ALL),
        pu AS (SELECT pr.model, pr.ref_id, direct, diagnostic AS d, reference AS r FROM pr JOIN dc ON pr.model = dc.model AND pr.ref_id = dc.ref_id WHERE direct IS NOT NULL)""",
    Q_D,
    "model",
)


def _severity(f: DataFrame) -> DataFrame:
    b = scalars.severity_bin(scalars.strength(F.col("family"), F.col("severity")))
    cells = f.filter("eligible = 1 AND split = 'reference'").groupBy("model", "family", b.alias("bin"), "ref_id").agg(F.count(F.lit(1)).alias("trials"), F.sum("stable").alias("stable"))
    return R.severity_curves(cells, E.samples(f), "model", ["family", "bin"], repetitions=TRIALS_DRAWN, seed=23)


add(
    "bootstrap_severity",
    on_facts(_severity),
    f"""SELECT model, family, bin, {Q} FROM (SELECT x.model, family, bin, e * CASE WHEN t > 0 THEN s / t::DOUBLE ELSE 0 END AS m FROM {drawn_sql("sv", 23, TRIALS_DRAWN, "sum(w * trials) AS t, sum(w * stable) AS s", "model, family, bin")} x
        JOIN (SELECT model, rep, e / w::DOUBLE AS e FROM {drawn_sql("sm", 23, TRIALS_DRAWN, "sum(w * eligible) AS e, sum(w) AS w", "model")}) y ON x.model = y.model AND x.rep = y.rep) GROUP BY ALL""",
    f"{FP}, sv AS (SELECT model, family, least(4, floor({STRENGTH} * 5))::INT AS bin, ref_id, count(*) AS trials, sum(stable) AS stable FROM f WHERE eligible = 1 AND split = 'reference' GROUP BY ALL)",
    Q_D,
    "model bin",
)
add(
    "bootstrap_components",
    on_facts(lambda f: R.component_intervals(_reference(f), ["model"], "n", "n_stable", repetitions=TRIALS_DRAWN, seed=29)),
    f"""SELECT model, statistic, {Q} FROM (SELECT model, unnest([{{'statistic': 'theta', 'm': theta}}, {{'statistic': 'between', 'm': a}}, {{'statistic': 'within', 'm': b}}, {{'statistic': 'icc', 'm': CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END}},
          {{'statistic': 'crossover', 'm': CASE WHEN a > 0 THEN b / a END}}, {{'statistic': 'standard_error', 'm': sqrt(a / w + b / r)}}], recursive := true)
        FROM (SELECT *, m / w AS theta, v / w AS b, greatest(0, (q - m * m / w) / (w - 1) - z / w) AS a FROM (SELECT model, rep, sum(w)::DOUBLE AS w, sum(w * p) AS m, sum(w * p * p) AS q, sum(w * n / (n - 1.0::DOUBLE) * p * (1 - p)) AS v,
          sum(w / (n - 1.0::DOUBLE) * p * (1 - p)) AS z, sum(w * n) AS r FROM (SELECT *, h / n::DOUBLE AS p FROM {copies_sql("(SELECT * FROM rs WHERE n >= 2)", "n", {"h": "k / n::DOUBLE"}, 29, "model, ref_id, n")}) GROUP BY ALL))) GROUP BY ALL""",
    f"{FACTS_SQL}, {REFERENCE}",
    Q_D,
    "model",
)
add("nested_validation", on_facts(lambda f: R.nested_validation(_reference(f), ["model"], "n", "n_stable", [50, 100, 250, 500], [1, 2, 5, 10, 20, 40, 80])))

# Re-runs at more exposures


def _runs(f: DataFrame) -> DataFrame:
    """Probes as if run again at four exposures: quality decides from which one on a probe is stable."""
    at = lambda c: F.struct(F.lit(c).alias("exposure"), (F.col("stable") * (F.col("q") <= c).cast("int")).alias("stable"), F.when(F.col("q") <= c, F.col("failure")).otherwise("competitor_missing").alias("failure"))
    return f.filter("eligible = 1 AND q >= 10").select("model", F.col("stable").alias("old_stable"), F.col("failure").alias("old_failure"), (F.col("q") % 7 != 0).cast("int").alias("same_prefix"), F.array(*map(at, (20, 30, 40, 50))).alias("outcomes"))


_at = lambda x: f"stable * (q <= {x})::INT"
add(
    "exposure_deltas",
    on_facts(lambda f: E.exposure_deltas(_runs(f), ["model"])),
    f"""SELECT *, net_changes / probes::DOUBLE AS delta FROM (SELECT model, exposure, count(*) AS probes, avg({_at("exposure")}) AS stable_fraction, sum({_at("exposure")} - {_at(20)}) AS net_changes,
        sum(({_at(20)} = 0 AND {_at("exposure")} = 1)::INT) AS fail_to_stable, sum(({_at(20)} = 1 AND {_at("exposure")} = 0)::INT) AS stable_to_fail, avg(({_at(20)} = stable)::INT) AS stability_agreement,
        avg((CASE WHEN q <= 20 THEN failure ELSE 'competitor_missing' END = failure)::INT) AS label_agreement, sum((q % 7 = 0)::INT) AS prefix_mismatches
        FROM (SELECT *, l_quantity::INT AS q FROM f), (VALUES (20), (30), (40), (50)) e(exposure) WHERE eligible = 1 AND q >= 10 GROUP BY ALL)""",
    FACTS_SQL.replace("FROM f0)", ", l_quantity FROM f0)"),
    "stable_fraction stability_agreement label_agreement delta",
    "model exposure probes net_changes fail_to_stable stable_to_fail prefix_mismatches",
)
add(
    "cap_hit_probes",
    on_facts(lambda f: E.cap_hits(f.withColumns({"image_id": F.col("ref_id") % 1000, "exposed": F.col("q"), "seed": F.col("l_partkey"), "severity": F.col("l_suppkey")}), 48, ["reference"]).select("model", "ref_id", "split", "ord", "probe_id")),
    """SELECT model, ref_id, split, ord, substr(sha256('[' || (ref_id % 1000) || ',' || ref_id || ',"' || split || '","' || family || '",' || l_suppkey || ',' || l_partkey || ']'), 1, 20) AS probe_id
       FROM f WHERE eligible = 1 AND split = 'reference' AND l_quantity::INT >= 48""",
    FACTS_SQL.replace("FROM f0)", ", l_quantity, l_partkey, l_suppkey FROM f0)"),
    ints="model ref_id ord",
)
add(
    "first_failure_examples",
    on_facts(lambda f: E.first_examples(f.filter("failure <> 'stable'"), ["model"], ["ref_id", "split", "ord"])),
    "SELECT model, failure, ref_id, split, ord FROM f WHERE eligible = 1 AND failure <> 'stable' QUALIFY row_number() OVER (PARTITION BY model, failure ORDER BY ref_id, split, ord) = 1",
    ints="model ref_id ord",
)
_causes = ", ".join(f"count(*) FILTER (WHERE failure = '{c}') AS {c}" for c in scalars.FAILURES)
add("failure_pivot", on_facts(lambda f: E.pivoted(f.filter("eligible = 1").withColumn("one", F.lit(1)), ["model", "family"], "failure", scalars.FAILURES, "one")), f"SELECT model, family, {_causes} FROM f WHERE eligible = 1 GROUP BY ALL", ints="model " + " ".join(scalars.FAILURES))

# Joins, violations and manifests


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet")


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifests.manifest(_orders(spark, d).select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("ref_id"), F.concat(F.lit("  "), "o_orderstatus", F.lit(" of  order. ")).alias("query"), F.array(*[F.lit(0.0), F.lit(0.0), (F.col("o_custkey") % 120 + 1).cast("double"), (F.col("o_custkey") % 90 + 1).cast("double")]).alias("target_box")))


add(
    "manifest_lookup",
    lambda s, d: joins.required(facts(s, d).select("ref_id", "ord", "model", "split"), _manifest(s, d).select("image_id", "ref_id"), ["ref_id"]).groupBy("image_id").agg(F.count(F.lit(1)).alias("probes")),
    "SELECT o_custkey AS image_id, count(*) AS probes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "one AS (SELECT 1)",
    ints="image_id probes",
)
add(
    "manifest_statistics",
    lambda s, d: manifests.statistics(_manifest(s, d), []),
    """SELECT count(*) AS rows, count(DISTINCT o_custkey) AS images, min(3) AS words_min, 3.0::DOUBLE AS words_median, 3.0::DOUBLE AS words_mean, max(3) AS words_max, min(a) AS area_min, quantile_cont(a, 0.5) AS area_median, avg(a) AS area_mean, max(a) AS area_max
       FROM (SELECT o_custkey, ((o_custkey % 120 + 1) * (o_custkey % 90 + 1))::DOUBLE AS a FROM orders)""",
    "one AS (SELECT 1)",
    "words_median words_mean area_min area_median area_mean area_max",
    "rows images words_min words_max",
)
add(
    "one_row_per_image",
    lambda s, d: manifests.one_per_image(_manifest(s, d).select("image_id", "ref_id"), seed=5),
    f"SELECT image_id, ref_id FROM (SELECT o_custkey AS image_id, ref_id, u FROM ({R.uniform_sql('(SELECT o_custkey, o_orderkey AS ref_id FROM orders)', 'ref_id', 5, 1)})) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY u, ref_id) = 1",
    "one AS (SELECT 1)",
    ints="image_id ref_id",
)
add(
    "manifest_slice",
    lambda s, d: manifests.sliced(_manifest(s, d).select("image_id", "ref_id"), ["ref_id"], 100, 250),
    "SELECT o_custkey AS image_id, o_orderkey AS ref_id FROM orders ORDER BY o_orderkey LIMIT 150 OFFSET 100",
    "one AS (SELECT 1)",
    ints="image_id ref_id",
)
add(
    "shuffled_manifest",
    lambda s, d: manifests.shuffled(_manifest(s, d).select("image_id", "ref_id"), "ref_id", seed=9, most=200),
    f"SELECT o_custkey AS image_id, ref_id, row_number() OVER (ORDER BY u, ref_id) - 1 AS position FROM ({R.uniform_sql('(SELECT o_custkey, o_orderkey AS ref_id FROM orders)', 'ref_id', 9, 1)}) QUALIFY position < 200",
    "one AS (SELECT 1)",
    ints="image_id ref_id position",
)
add(
    "set_overlaps",
    lambda s, d: joins.overlaps({n: facts(s, d).filter(f"eligible = 1 AND model = {m}").select("ref_id") for m, n in enumerate(("a", "b", "c"))}, "ref_id"),
    "SELECT x.n AS left, y.n AS right, count(*) FILTER (WHERE x.ref_id = y.ref_id) AS shared FROM s x, s y WHERE x.n < y.n AND x.ref_id = y.ref_id GROUP BY ALL",
    f"{FACTS_SQL}, s AS (SELECT DISTINCT ref_id, chr(97 + model) AS n FROM f WHERE eligible = 1)",
    ints="shared",
)
add(
    "duplicate_records",
    lambda s, d: joins.duplicate_count(facts(s, d), ["model", "ref_id", "split"]),
    "SELECT sum(n - 1) AS duplicates FROM (SELECT count(*) AS n FROM f GROUP BY model, ref_id, split)",
    ints="duplicates",
)
add(
    "distinct_counts",
    on_facts(lambda f: f.groupBy("model").agg(F.countDistinct("ref_id").alias("samples"), F.countDistinct("family", "split").alias("cells"))),
    "SELECT model, count(DISTINCT ref_id) AS samples, count(DISTINCT (family, split)) AS cells FROM f GROUP BY model",
    ints="model samples cells",
)
add(
    "ragged_union",
    on_facts(lambda f: validators.ragged([f.filter("eligible = 1").select("model", "ref_id", "split", "stable"), f.filter("eligible = 0").select("model", "ref_id", F.lit("too_few").alias("reason"))]).groupBy("model", "split", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("stable").alias("stable"))),
    "SELECT model, CASE WHEN eligible = 1 THEN split END AS split, CASE WHEN eligible = 0 THEN 'too_few' END AS reason, count(*) AS n, sum(CASE WHEN eligible = 1 THEN stable END) AS stable FROM f GROUP BY ALL",
    ints="model n stable",
)
_V = """SELECT 'coverage_and_order' AS rule, count(*) FILTER (WHERE stable <> coverage * coalesce(rank_stable, 0)) AS n FROM f WHERE eligible = 1 UNION ALL SELECT 'order_without_coverage', count(*) FILTER (WHERE coverage = 0 AND rank_stable IS NOT NULL) FROM f WHERE eligible = 1"""
add(
    "outcome_violations",
    on_facts(lambda f: validators.outcome_rules(f.withColumn("stable", F.when(F.col("q") % 11 == 0, 1 - F.col("stable")).otherwise(F.col("stable"))).withColumn("rank_stable", F.when(F.col("q") % 13 == 0, F.lit(1)).otherwise(F.col("rank_stable"))))),
    _V,
    FACTS_SQL.replace("FROM f0)", ", l_quantity FROM f0)").replace("f AS (", "f_ AS (")
    + ", f AS (SELECT * REPLACE (CASE WHEN l_quantity::INT % 11 = 0 THEN 1 - stable ELSE stable END AS stable, CASE WHEN l_quantity::INT % 13 = 0 THEN 1 ELSE rank_stable END AS rank_stable) FROM f_)",
    ints="n",
)
_fam = ", ".join(f"('{f}')" for f in scalars.FAMILIES)
add(
    "registry_violations",
    on_facts(lambda f: validators.registry_rules(f.filter("eligible = 1"), {"diagnostic": 1, "reference": 2}, scalars.FAMILIES).groupBy("rule").agg(F.count(F.lit(1)).alias("samples"), F.sum("n").alias("n"))),
    f"""SELECT 'unbalanced_' || split AS rule, count(*) AS samples, sum(off) AS n FROM (SELECT k.model, k.ref_id, s.split, sum(abs(coalesce(n, 0) - per)) AS off FROM (SELECT DISTINCT model, ref_id FROM f WHERE eligible = 1) k, (VALUES ('diagnostic', 1), ('reference', 2)) s(split, per), (VALUES {_fam}) a(family)
        LEFT JOIN (SELECT model, ref_id, split, family, count(*) AS n FROM f WHERE eligible = 1 GROUP BY ALL) c ON c.model = k.model AND c.ref_id = k.ref_id AND c.split = s.split AND c.family = a.family GROUP BY ALL) WHERE off > 0 GROUP BY split""",
    ints="samples n",
)
