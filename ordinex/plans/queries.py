"""The operators bound to the derived tables, each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..operators import estimands as E
from ..operators import joins
from ..operators import statistics as S
from .fixtures import BOXES_SQL, FACTS_SQL, boxes, candidate_lists, facts
from .registry import ORACLES, QUERIES, add, on_facts

__all__ = ["ORACLES", "QUERIES"]

BUDGETS = [1, 2, 3]
#: Probes, half-widths and cost ratios of the planning tables.
BUDGET_GRID, HALF_WIDTHS, COST_RATIOS = [1, 2, 5, 10, 20, 40, 80], [0.01, 0.02, 0.03, 0.05], [5, 10, 25, 50, 100, 250, 500, 1000]

CNT = "count(*) AS trials, sum(eligible) AS eligible_trials, sum(eligible * coverage) AS covered, sum(eligible * stable) AS stable"


def optimism_sql(body: str) -> str:
    """Optimism, its parts and residuals behind the columns of ``body``."""
    return f"""SELECT *, abs(optimism - complete_case * (1 - eligibility * coverage)) AS residual, abs(optimism_coverage - complete_case * (1 - coverage)) AS residual_coverage,
      abs(optimism_eligibility - (1 - eligibility) * coverage * complete_case) AS residual_eligibility FROM (SELECT *, complete_case - full_operational AS optimism, complete_case - eligible_operational AS optimism_coverage,
      eligible_operational - full_operational AS optimism_eligibility FROM ({body}))"""


def _pooled_sql(source: str, by: str) -> str:
    return optimism_sql(f"""SELECT {by}, trials, eligible_trials, covered, stable, eligible_trials / trials::DOUBLE AS eligibility,
      covered / nullif(eligible_trials, 0)::DOUBLE AS coverage, stable / nullif(covered, 0)::DOUBLE AS complete_case,
      stable / nullif(eligible_trials, 0)::DOUBLE AS eligible_operational, stable / trials::DOUBLE AS full_operational
      FROM (SELECT {by}, {CNT} FROM {source} GROUP BY {by})""")


P_D = "eligibility coverage complete_case eligible_operational full_operational optimism optimism_coverage optimism_eligibility residual residual_coverage residual_eligibility"
P_I = "trials eligible_trials covered stable"
add("pooled_estimands", on_facts(lambda f: E.pooled(f, ["model"])), _pooled_sql("f", "model"), doubles=P_D, ints=P_I + " model")
add("optimism_by_family", on_facts(lambda f: E.pooled(f, ["model", "family"])), _pooled_sql("f", "model, family"), doubles=P_D, ints=P_I + " model")
add("correctness_strata", on_facts(lambda f: E.strata(f, ["model"])), _pooled_sql("f", "model, correct"), doubles=P_D, ints=P_I + " model correct")
add(
    "common_support_composition",
    on_facts(lambda f: E.common_support(f, 3)),
    _pooled_sql("(SELECT * FROM f WHERE ref_id IN (SELECT ref_id FROM (SELECT model, ref_id, max(eligible) e FROM f GROUP BY ALL) WHERE e = 1 GROUP BY ref_id HAVING count(*) = 3))", "model"),
    doubles=P_D,
    ints=P_I + " model",
)
add(
    "risk_decomposition",
    on_facts(lambda f: E.risk_decomposition(f, ["model"])),
    """SELECT model, 1 - avg(stable) AS risk, 1 - avg(coverage) AS coverage_risk, avg(coverage) * (1 - sum(stable) / sum(coverage)::DOUBLE) AS ranking_risk,
       abs(1 - avg(stable) - (1 - avg(coverage)) - avg(coverage) * (1 - sum(stable) / sum(coverage)::DOUBLE)) AS residual FROM f WHERE eligible = 1 GROUP BY model""",
    doubles="risk coverage_risk ranking_risk residual",
    ints="model",
)
add(
    "family_risk_share",
    on_facts(lambda f: E.family_risk(f, ["model"])),
    """SELECT model, family, weight, risk, weight * risk AS contribution, weight * risk / sum(weight * risk) OVER (PARTITION BY model) AS share
       FROM (SELECT model, family, count(*) / sum(count(*)) OVER (PARTITION BY model)::DOUBLE AS weight, 1 - avg(stable) AS risk FROM f WHERE eligible = 1 GROUP BY model, family)""",
    doubles="weight risk contribution share",
    ints="model",
)
_causes = ", ".join(f"('{x}')" for x in scalars.FAILURES)
add(
    "failure_causes_zero_filled",
    on_facts(lambda f: E.failure_causes(f, ["model"])),
    f"""SELECT model, failure, n, n / nullif(sum(n) OVER (PARTITION BY model), 0)::DOUBLE AS share FROM (
        SELECT g.model, g.failure, count(f.model) AS n FROM (SELECT DISTINCT model, failure FROM (SELECT model FROM f) CROSS JOIN (VALUES {_causes}) v(failure)) g
        LEFT JOIN (SELECT * FROM f WHERE eligible = 1) f ON f.model = g.model AND f.failure = g.failure GROUP BY g.model, g.failure)""",
    doubles="share",
    ints="model n",
)
add("ranking_culprits", on_facts(lambda f: E.culprits(f, ["model"])), "SELECT model, culprit + 1 AS culprit_rank, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY model)::DOUBLE AS share FROM f WHERE eligible = 1 AND failure = 'ranking_reversal' GROUP BY model, culprit", doubles="share", ints="model culprit_rank n")
add(
    "association_quality",
    on_facts(lambda f: f.filter("coverage = 1").groupBy("model").agg(F.avg("quality").alias("mean_iou"), F.percentile("quality", F.lit(0.5)).alias("median_iou"), F.min("quality").alias("min_iou"))),
    "SELECT model, avg(quality) AS mean_iou, quantile_cont(quality, 0.5) AS median_iou, min(quality) AS min_iou FROM f WHERE coverage = 1 GROUP BY model",
    doubles="mean_iou median_iou min_iou",
    ints="model",
)
PAIRS = """d AS (SELECT model, ref_id, avg(stable) AS diagnostic FROM f WHERE eligible = 1 AND split = 'diagnostic' GROUP BY ALL),
rr AS (SELECT model, ref_id, avg(stable) AS reference FROM f WHERE eligible = 1 AND split = 'reference' GROUP BY ALL),
sm AS (SELECT model, ref_id, max(eligible) AS eligible, max(correct) AS correct FROM f GROUP BY ALL),
pr AS (SELECT sm.*, coalesce(diagnostic, 0) AS diagnostic, coalesce(reference, 0) AS reference FROM sm LEFT JOIN d USING (model, ref_id) LEFT JOIN rr USING (model, ref_id)
       WHERE eligible = 0 OR (diagnostic IS NOT NULL AND reference IS NOT NULL))"""
FP = f"{FACTS_SQL}, {PAIRS}"
METRICS = "count(*) AS n, avg(p - t) AS bias, avg(abs(p - t)) AS mae, sqrt(avg((p - t) * (p - t))) AS rmse, avg(p * p - 2 * p * t + t) AS brier"
add("predictive_metrics", on_facts(lambda f: E.prediction_metrics(E.paired_profiles(f), ["model"])), f"SELECT model, {METRICS} FROM (SELECT model, diagnostic AS p, reference AS t FROM pr) GROUP BY model", FP, "bias mae rmse brier", "model n")
_vals = ", ".join(f"({b})" for b in BUDGETS)
add(
    "budget_metrics",
    on_facts(lambda f: E.budget_metrics(f, BUDGETS)),
    f"""SELECT model, budget, {METRICS} FROM (SELECT x.model, budget, p, reference AS t FROM
        (SELECT model, ref_id, budget, avg(stable) AS p FROM f, (VALUES {_vals}) b(budget) WHERE eligible = 1 AND split = 'diagnostic' AND ord < budget GROUP BY ALL) x
        JOIN rr ON rr.model = x.model AND rr.ref_id = x.ref_id) GROUP BY model, budget""",
    FP,
    "bias mae rmse brier",
    "model budget n",
)
add(
    "family_profile_by_budget",
    on_facts(lambda f: E.family_by_budget(f, BUDGETS)),
    f"SELECT model, budget, family, count(*) AS n, 1 - avg(stable) AS risk FROM f, (VALUES {_vals}) b(budget) WHERE eligible = 1 AND split = 'diagnostic' AND ord < budget GROUP BY ALL",
    doubles="risk",
    ints="model budget n",
)
CURVE = """cv AS (SELECT model, diagnostic AS threshold, sum(k) OVER w / sum(k) OVER (PARTITION BY model)::DOUBLE AS retained, sum(r) OVER w / sum(k) OVER w AS risk
FROM (SELECT model, diagnostic, count(*)::DOUBLE AS k, sum(1 - reference) AS r FROM pr GROUP BY ALL) WINDOW w AS (PARTITION BY model ORDER BY diagnostic DESC ROWS UNBOUNDED PRECEDING))"""
add("selective_risk_curve", on_facts(lambda f: S.risk_curve(E.paired_profiles(f), ["model"])), "SELECT * FROM cv", f"{FP}, {CURVE}", "threshold retained risk", "model")
add(
    "selective_risk_aurc",
    on_facts(lambda f: S.aurc(E.paired_profiles(f), ["model"])),
    """SELECT model, sum((retained - coalesce(rp, 0)) * (risk + coalesce(kp, risk)) / 2) AS aurc FROM (
       SELECT *, lag(retained) OVER w AS rp, lag(risk) OVER w AS kp FROM cv WINDOW w AS (PARTITION BY model ORDER BY threshold DESC)) GROUP BY model""",
    f"{FP}, {CURVE}",
    "aurc",
    "model",
)
add(
    "spearman_rank_correlation",
    on_facts(lambda f: S.spearman(E.paired_profiles(f), ["model"], "diagnostic", "reference")),
    """SELECT model, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(a, b) END AS spearman FROM (
       SELECT model, rank() OVER (PARTITION BY model ORDER BY diagnostic) + (count(*) OVER (PARTITION BY model, diagnostic) - 1) / 2.0 AS a,
              rank() OVER (PARTITION BY model ORDER BY reference) + (count(*) OVER (PARTITION BY model, reference) - 1) / 2.0 AS b FROM pr) GROUP BY model""",
    FP,
    "spearman",
    "model n",
)
add(
    "calibration_bins",
    on_facts(lambda f: E.calibration(E.paired_profiles(f), ["model"])),
    "SELECT model, least(trunc(diagnostic * 10), 9) AS bin, count(*) AS n, avg(diagnostic) AS predicted, avg(reference) AS observed FROM pr GROUP BY ALL",
    FP,
    "predicted observed",
    "model bin n",
)
_ends = {f: (lo, hi) for f, _, lo, hi in scalars.PROBE_LAW}
_st = lambda f, e: f"WHEN '{f}' THEN {e}"
STRENGTH = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE family " + " ".join(
    [
        *[_st(f, f"(severity - {_ends[f][0]}::DOUBLE) / ({_ends[f][1]}::DOUBLE - {_ends[f][0]}::DOUBLE)") for f in ("blur", "gaussian_noise")],
        *[_st(f, f"({_ends[f][1]}::DOUBLE - severity) / ({_ends[f][1]}::DOUBLE - {_ends[f][0]}::DOUBLE)") for f in ("jpeg", "resolution")],
        _st("brightness", "abs(severity - 1.0::DOUBLE) / (1.3::DOUBLE - 1.0::DOUBLE)"),
    ]
) + " END))"
add(
    "severity_curve_points",
    on_facts(lambda f: E.severity_curve(f, ["model"])),
    f"SELECT model, family, least(4, floor({STRENGTH} * 5)) AS bin, {CNT}, sum(eligible * stable) / count(*)::DOUBLE AS full_operational FROM f GROUP BY ALL",
    doubles="full_operational",
    ints=P_I + " model bin",
)
add(
    "full_manifest_failure_risk",
    on_facts(lambda f: E.full_failure_risk(f, ["model"])),
    "SELECT model, CASE WHEN eligible = 0 THEN 'ineligible' ELSE failure END AS outcome, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY model)::DOUBLE AS share FROM f GROUP BY 1, 2",
    doubles="share",
    ints="model n",
)
add(
    "mixture_gap_summary",
    on_facts(E.mixture_gaps),
    """SELECT a.model AS model_a, b.model AS model_b, avg(a.t - b.t) AS equal_weight_gap, min(a.t - b.t) AS min_gap, max(a.t - b.t) AS max_gap
       FROM (SELECT model, family, sum(eligible * stable) / count(*)::DOUBLE AS t FROM f GROUP BY ALL) a
       JOIN (SELECT model, family, sum(eligible * stable) / count(*)::DOUBLE AS t FROM f GROUP BY ALL) b ON a.family = b.family AND a.model < b.model GROUP BY ALL""",
    doubles="equal_weight_gap min_gap max_gap",
    ints="model_a model_b",
)
add(
    "failure_transitions",
    on_facts(E.transitions),
    "SELECT a.failure AS old, b.failure AS new, count(*) AS n FROM f a JOIN f b ON a.model = b.model AND a.ref_id = b.ref_id AND a.ord = b.ord AND a.split = 'diagnostic' AND b.split = 'reference' GROUP BY ALL",
    ints="n",
)
_share = lambda split: f"(SELECT model, family, coalesce(w / nullif(sum(w) OVER (PARTITION BY model), 0), 0) AS s FROM (SELECT model, family, sum(1 - stable)::DOUBLE AS w FROM f WHERE eligible = 1 AND split = '{split}' GROUP BY ALL))"
add(
    "family_transfer_cosine",
    on_facts(E.family_transfer),
    f"""SELECT model, count(*) AS families, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS cosine, avg(abs(a - b)) AS mean_abs_shift, CASE WHEN count(*) >= 3 THEN corr(ra, rb) END AS spearman FROM (
        SELECT *, rank() OVER (PARTITION BY model ORDER BY a) + (count(*) OVER (PARTITION BY model, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY model ORDER BY b) + (count(*) OVER (PARTITION BY model, b) - 1) / 2.0 AS rb
        FROM (SELECT x.model, x.s AS a, y.s AS b FROM {_share("diagnostic")} x JOIN {_share("reference")} y ON x.model = y.model AND x.family = y.family)) GROUP BY model""",
    doubles="cosine mean_abs_shift spearman",
    ints="model families",
)
STATS = "st AS (SELECT model, ref_id, count(*) AS n, sum(coverage) AS c, sum(stable) AS s FROM f WHERE eligible = 1 AND split = 'reference' GROUP BY ALL)"
add(
    "transfer_estimands",
    on_facts(E.transfer),
    """SELECT sm.model, count(*) AS samples, avg(eligible) AS eligibility, avg(c / n::DOUBLE) AS coverage, avg(s / n::DOUBLE) AS eligible_operational, avg(coalesce(s / n::DOUBLE, 0)) AS full_operational
       FROM sm LEFT JOIN st USING (model, ref_id) GROUP BY sm.model""",
    f"{FP}, {STATS}",
    "eligibility coverage eligible_operational full_operational",
    "model samples",
)
COMP = f"""{STATS}, u AS (SELECT model, s / n::DOUBLE AS p, n / (n - 1.0::DOUBLE) * (s / n::DOUBLE) * (1 - s / n::DOUBLE) AS v, n::DOUBLE AS r FROM st WHERE n >= 2),
c0 AS (SELECT model, count(*) AS units, avg(p) AS theta, avg(v) AS within, var_samp(p) - avg(v / r) AS between_raw, greatest(0, var_samp(p) - avg(v / r)) AS between_, avg(r) AS mr FROM u GROUP BY model)"""


def _components(f: DataFrame) -> DataFrame:
    return S.variance_components(E.sample_stats(f).filter("split = 'reference'"), ["model"])


add(
    "variance_components",
    on_facts(_components),
    """SELECT model, units, theta, within, between_raw, between_ AS "between", sqrt(between_ / units + within / (units * mr)) AS cluster_se, sqrt(theta * (1 - theta) / (units * mr)) AS naive_se,
       sqrt(between_ / units + within / (units * mr)) / sqrt(theta * (1 - theta) / (units * mr)) AS se_ratio, between_ / (between_ + within) AS icc, 1 + (mr - 1) * between_ / (between_ + within) AS design_effect,
       units * mr / (1 + (mr - 1) * between_ / (between_ + within)) AS effective_trials, within / mr / (between_ + within / mr) AS probe_share,
       CASE WHEN between_ > 0 THEN within / between_ ELSE 'infinity'::DOUBLE END AS crossover, sqrt(ln(4 / 0.05) / 2 / units) + sqrt(ln(4 / 0.05) / 2 / (units * mr)) AS hoeffding_radius FROM c0""",
    f"{FACTS_SQL}, {COMP}",
    'theta within between_raw "between" cluster_se naive_se se_ratio icc design_effect effective_trials probe_share crossover hoeffding_radius',
    "model units",
)
add(
    "variance_budget_lag",
    on_facts(lambda f: S.variance_budgets(_components(f), ["model"], BUDGET_GRID)),
    "SELECT model, probes, variance, 1 - variance / lag(variance) OVER (PARTITION BY model ORDER BY probes) AS reduction FROM (SELECT model, probes, between_ / units + within / (units * probes) AS variance FROM c0, (VALUES (1), (2), (5), (10), (20), (40), (80)) b(probes))",
    f"{FACTS_SQL}, {COMP}",
    "variance reduction",
    "model probes",
)
add(
    "sample_size_planning",
    on_facts(lambda f: S.planning(_components(f), ["model"], HALF_WIDTHS, BUDGET_GRID)),
    "SELECT model, half_width::DOUBLE AS half_width, probes, greatest(1, ceil(1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE * (between_ + within / probes) / (half_width::DOUBLE * half_width::DOUBLE))) AS units_needed FROM c0, (VALUES (0.01), (0.02), (0.03), (0.05)) h(half_width), (VALUES (1), (2), (5), (10), (20), (40), (80)) b(probes)",
    f"{FACTS_SQL}, {COMP}",
    "half_width",
    "model probes units_needed",
)
_costs = ", ".join(f"({x}::DOUBLE)" for x in COST_RATIOS)
add(
    "probe_allocation",
    on_facts(lambda f: S.allocation(_components(f), ["model"], COST_RATIOS)),
    f"""SELECT model, cost_ratio, CASE WHEN between_ = 0 THEN 80 ELSE arg_min(r, {{'v': (cost_ratio + r) * (between_ + within / r), 'r': r}}) END AS probes,
        CASE WHEN within = 0 THEN 1 WHEN between_ = 0 THEN 'infinity'::DOUBLE ELSE greatest(1, ceil(round(within * 0.9 / (between_ * 0.1), 9))) END AS probes_for_tenth
        FROM c0, (VALUES {_costs}) q(cost_ratio), range(1, 81) p(r) GROUP BY model, cost_ratio, between_, within""",
    f"{FACTS_SQL}, {COMP}",
    "cost_ratio probes_for_tenth",
    "model probes",
)
add(
    "latest_trace_record",
    lambda s, d: joins.latest(
        facts(s, d).select("model", "ref_id", "split", "stable", "quality", (F.col("ord") * 1000 + F.col("l_linenumber")).alias("line_no")), ["model", "ref_id", "split"], "line_no"
    ).select("model", "ref_id", "split", "line_no"),
    "SELECT model, ref_id, split, max(ord * 1000 + l_linenumber) AS line_no FROM (SELECT (l_suppkey % 3)::INT AS model, l_orderkey AS ref_id, CASE WHEN l_linenumber % 3 = 0 THEN 'diagnostic' ELSE 'reference' END AS split, l_linenumber, row_number() OVER (PARTITION BY l_suppkey % 3, l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN 'diagnostic' ELSE 'reference' END ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity::INT, l_extendedprice::DOUBLE) - 1 AS ord FROM lineitem) GROUP BY ALL",
    ints="model ref_id line_no",
)
add(
    "shared_probe_violations",
    on_facts(lambda f: joins.shared_probe_violations(f, ["ref_id", "ord", "split"], ["family", "severity"])),
    "SELECT ref_id, ord, split FROM f GROUP BY ALL HAVING count(DISTINCT (family, severity)) > 1",
    ints="ref_id ord",
)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet")


add(
    "key_set_violations",
    lambda s, d: joins.missing_keys(_orders(s, d).select(F.col("o_orderkey").alias("ref_id")), boxes(s, d), ["ref_id"]),
    "SELECT o_orderkey AS ref_id, 'left' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'right' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    BOXES_SQL,
    ints="ref_id",
)
add(
    "resume_pending",
    lambda s, d: joins.pending(
        _orders(s, d).select(F.col("o_orderkey").alias("ref_id")), facts(s, d).filter("split = 'reference'").select("ref_id"), facts(s, d).filter("split = 'diagnostic'").select("ref_id"), ["ref_id"]
    ),
    "SELECT o_orderkey AS ref_id FROM orders WHERE o_orderkey NOT IN (SELECT ref_id FROM f WHERE split = 'reference' INTERSECT SELECT ref_id FROM f WHERE split = 'diagnostic')",
    ints="ref_id",
)
add(
    "exclusion_antijoin",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("image_id")).join(_orders(s, d).filter("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("image_id")), "image_id", "left_anti"),
    "SELECT c_custkey AS image_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)",
    BOXES_SQL,
    ints="image_id",
)
add(
    "dense_category_ids",
    lambda s, d: joins.dense_ids(s.read.parquet(f"{d}/part.parquet"), "p_brand"),
    "SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) AS dense_id FROM (SELECT DISTINCT p_brand FROM part)",
    BOXES_SQL,
    ints="dense_id",
)
add(
    "manifest_strata",
    lambda s, d: _orders(s, d).select(scalars.length_bin(F.col("o_orderkey") % 40 + 3).alias("length_bin"), scalars.scale_stratum(((F.col("o_custkey") % 120) * (F.col("o_custkey") % 120)).cast("double")).alias("scale")).groupBy("length_bin", "scale").agg(F.count(F.lit(1)).alias("n")),
    """SELECT CASE WHEN o_orderkey % 40 + 3 <= 18 THEN 'short' WHEN o_orderkey % 40 + 3 <= 29 THEN 'medium' ELSE 'long' END AS length_bin,
       CASE WHEN o_custkey % 120 < 32 THEN 'small' WHEN o_custkey % 120 <= 96 THEN 'medium' ELSE 'large' END AS scale, count(*) AS n FROM orders GROUP BY ALL""",
    BOXES_SQL,
    ints="n",
)
IOU = "CASE WHEN u > 0 THEN i / u ELSE 0 END"
PAIR_SQL = """pi AS (SELECT a.ref_id, a.ord AS a, b.ord AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
(a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM bx a JOIN bx b ON a.ref_id = b.ref_id AND a.ord < b.ord)"""


def _iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = candidate_lists(spark, d).select("ref_id", F.explode(F.flatten(F.transform("clean_candidates", lambda x: F.transform(F.filter("clean_candidates", lambda y: x["ord"] < y["ord"]), lambda y: F.struct(x["ord"].alias("a"), y["ord"].alias("b"), geometry.iou(x, y).alias("iou")))))).alias("p"))
    return a.select("ref_id", "p.a", "p.b", "p.iou")


add("iou_pairs", _iou_pairs, "SELECT ref_id, a, b, CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END AS iou FROM pi", f"{BOXES_SQL}, {PAIR_SQL}", "iou", "ref_id a b")
# Greedy suppression in SQL: candidates in order, each against the kept ones so far, a step for each place.
NMS_SQL = f"""{BOXES_SQL}, {PAIR_SQL}, bad AS (SELECT ref_id, a, b FROM pi WHERE CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END >= 0.7),
hit AS (SELECT ref_id, b, list(a) AS against FROM bad GROUP BY ALL),
step AS (SELECT bx.ref_id, ord, coalesce(against, []) AS against FROM bx LEFT JOIN hit ON hit.ref_id = bx.ref_id AND hit.b = bx.ord),
kept AS (SELECT ref_id, ord AS pos, [ord] AS held FROM step WHERE ord = 0
  UNION ALL SELECT k.ref_id, s.ord, CASE WHEN len(held) < 5 AND NOT list_has_any(held, s.against) THEN list_append(held, s.ord) ELSE held END FROM kept k JOIN step s ON s.ref_id = k.ref_id AND s.ord = k.pos + 1),
fin AS (SELECT ref_id, arg_max(held, pos) AS held FROM kept GROUP BY ref_id)"""


def _nms(spark: SparkSession, d: str) -> DataFrame:
    return candidate_lists(spark, d).select("ref_id", geometry.spatially_distinct(F.col("clean_candidates"), 5, 0.7).alias("t"))


add("nms_tracked", lambda s, d: _nms(s, d).select("ref_id", F.explode("t").alias("t")).select("ref_id", "t.ord"), "SELECT ref_id, unnest(held) AS ord FROM fin", f"RECURSIVE {NMS_SQL}", ints="ref_id ord")
add("clean_eligibility", lambda s, d: _nms(s, d).select("ref_id", F.size("t").alias("tracked"), (F.size("t") >= 2).cast("int").alias("eligible")), "SELECT ref_id, len(held) AS tracked, (len(held) >= 2)::INT AS eligible FROM fin", f"RECURSIVE {NMS_SQL}", ints="ref_id tracked eligible")
add("top_k_candidates", lambda s, d: candidate_lists(s, d).select("ref_id", F.explode(geometry.top_k(F.col("clean_candidates"), 3)).alias("c")).select("ref_id", "c.ord", "c.score"), "SELECT ref_id, ord, score FROM bx WHERE ord < 3", BOXES_SQL, "score", "ref_id ord")


def _top1(spark: SparkSession, d: str) -> DataFrame:
    truth = F.array(F.struct(*[F.lit(v).alias(n) for v, n in ((12.0, "x1"), (12.0, "y1"), (26.0, "x2"), (24.0, "y2"))]))
    flag, best = geometry.top1(F.col("clean_candidates"), truth)
    return candidate_lists(spark, d).select("ref_id", flag.alias("correct"), best.alias("best_iou"))


add(
    "top1_correct",
    _top1,
    """SELECT ref_id, CASE WHEN i / (s - i) >= 0.5 THEN 1 ELSE 0 END AS correct, i / (s - i) AS best_iou FROM (
       SELECT ref_id, greatest(0, least(x2, 26) - greatest(x1, 12)) * greatest(0, least(y2, 24) - greatest(y1, 12)) AS i, (x2 - x1) * (y2 - y1) + 14.0::DOUBLE * 12 AS s FROM bx WHERE ord = 0)""",
    BOXES_SQL,
    "best_iou",
    "ref_id correct",
)


def probe_registry(spark: SparkSession, d: str) -> DataFrame:
    keys = _orders(spark, d).select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("ref_id"))
    return S.probe_registry(keys, 1, 2, 2026, scalars.PROBE_LAW)


add("probe_registry", probe_registry)


add(
    "cap_truncation",
    on_facts(lambda f: E.cap_truncation(f, "q", 45)),
    """SELECT model, avg((l_quantity::INT >= 45)::INT) AS cap_fraction, avg(eligible * stable) AS theta, avg(eligible * stable * (l_quantity::INT < 45)::INT) AS pessimistic,
       avg(eligible * stable) - avg(eligible * stable * (l_quantity::INT < 45)::INT) AS correction FROM f GROUP BY model""",
    FACTS_SQL.replace("FROM f0)", ", l_quantity FROM f0)"),
    "cap_fraction theta pessimistic correction",
    "model",
)
add(
    "strata_estimands",
    on_facts(lambda f: E.pooled(f.withColumn("stratum", scalars.length_bin(F.col("ref_id") % 40 + 3)), ["model", "stratum"])),
    _pooled_sql("(SELECT *, CASE WHEN ref_id % 40 + 3 <= 18 THEN 'short' WHEN ref_id % 40 + 3 <= 29 THEN 'medium' ELSE 'long' END AS stratum FROM f)", "model, stratum"),
    doubles=P_D,
    ints=P_I + " model",
)
# The other tables register themselves.
from . import replays, tables  # noqa: E402, F401
