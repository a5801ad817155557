"""Probe outcomes and contract grids over derived candidate lists, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import grid, kernels
from ..operators.contract import GRID, OutputContract
from .fixtures import candidate_lists, outcomes_sql, probe_pairs, replay_sql
from .registry import add

#: The second registered grid, the thresholds of suppression of the clean-only grid.
SMALL_GRID = {"tracked": [2, 3, 5], "exposed": [20], "match": [0.1, 0.15, 0.25], "birth": [0.5, 0.7, 0.85]}
DUPLICATES = [0.5, 0.6, 0.7, 0.8, 0.85]
MODELS = 3
DEFAULT = OutputContract()
DEFAULTS = {"kt": DEFAULT.tracked_candidate_count, "ke": DEFAULT.exposed_candidate_count, "match": DEFAULT.match_iou_threshold, "birth": DEFAULT.birth_duplicate_iou_threshold}


def probe_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return kernels.judgements(probe_pairs(spark, d))


ONE = f"{replay_sql(2, 1, 5, 20)}, {outcomes_sql('SELECT model, ref_id, r, nt AS t, ne AS e FROM pb WHERE nt >= 2', [0.15], [0.7])}"
add(
    "probe_outcomes",
    probe_outcomes,
    """SELECT pb.ref_id, pb.r, (nt >= 2)::INT AS clean_eligible, CASE WHEN nt >= 2 THEN ne ELSE 0 END AS exposed, coverage, CASE WHEN coverage = 1 THEN (failure = 'stable')::INT END AS rank_stable,
       (failure = 'stable')::INT AS operational_stable, failure AS primary_failure, CASE WHEN failure = 'ranking_reversal' THEN culprit END AS culprit_clean_index
       FROM pb LEFT JOIN oc ON pb.ref_id = oc.ref_id AND pb.r = oc.r""",
    f"RECURSIVE {ONE}",
    ints="ref_id r clean_eligible exposed coverage rank_stable operational_stable culprit_clean_index",
)


def _lists(x: list) -> str:
    return ", ".join(f"({k}, {v}{'::DOUBLE' if isinstance(v, float) else ''})" for k, v in enumerate(x))


def _grid_sql(g: dict) -> str:
    """Outcomes for each probe's distinct lengths, then the settings' table ``gt`` by model."""
    lengths = f"SELECT DISTINCT model, ref_id, r, least(k, nt) AS t, least(x, ne) AS e FROM pb, (VALUES {', '.join(f'({k})' for k in g['tracked'])}) a(k), (VALUES {', '.join(f'({k})' for k in g['exposed'])}) b(x) WHERE nt >= 2"
    causes = ", ".join(f"count(*) FILTER (WHERE failure = '{c}') AS {c}" for c in ("winner_missing", "competitor_missing", "threatening_birth", "ranking_reversal"))
    share = ", ".join(f"coalesce({c} / nullif(winner_missing + competitor_missing + threatening_birth + ranking_reversal, 0)::DOUBLE, 0) AS {c}_share" for c in ("winner_missing", "competitor_missing", "threatening_birth", "ranking_reversal"))
    n = [len(g[k]) for k in ("exposed", "match", "birth")]
    return f"""{replay_sql(1, MODELS, max(g["tracked"]), max(g["exposed"]))}, {outcomes_sql(lengths, g["match"], g["birth"])},
st AS (SELECT ((a.i * {n[0]} + b.i) * {n[1]} + c.i) * {n[2]} + d.i AS setting_index, kt, ke, match, birth FROM (VALUES {_lists(g["tracked"])}) a(i, kt), (VALUES {_lists(g["exposed"])}) b(i, ke), (VALUES {_lists(g["match"])}) c(i, match), (VALUES {_lists(g["birth"])}) d(i, birth)),
gs AS (SELECT pb.model, st.*, pb.ref_id, nt >= 2 AS ok, oc.coverage, oc.failure FROM pb CROSS JOIN st LEFT JOIN oc ON pb.model = oc.model AND pb.ref_id = oc.ref_id AND pb.r = oc.r
  AND oc.t = least(st.kt, nt) AND oc.e = least(st.ke, ne) AND oc.match = st.match AND oc.birth = st.birth),
gt AS (SELECT *, {share} FROM (SELECT model, setting_index, kt, ke, match, birth, count(*) AS samples, count(*) FILTER (WHERE ok) AS eligible, avg(ok::INT) AS eligibility, count(*) FILTER (WHERE ok) AS probes,
  coalesce(avg(coverage) FILTER (WHERE ok), 0) AS coverage, count(*) FILTER (WHERE failure = 'stable') / nullif(sum(coverage), 0)::DOUBLE AS conditional,
  avg(coalesce(failure = 'stable', false)::INT) AS theta, coalesce(avg((failure = 'stable')::INT) FILTER (WHERE ok), 0) AS eligible_theta, {causes} FROM gs GROUP BY ALL))"""


GRID_SQL, SMALL_SQL = f"RECURSIVE {_grid_sql(GRID)}", f"RECURSIVE {_grid_sql(SMALL_GRID)}"
SHARES = "winner_missing_share competitor_missing_share threatening_birth_share ranking_reversal_share"


def _table(g: dict):  # noqa: ANN202
    def table(spark: SparkSession, d: str) -> DataFrame:
        return grid.table(probe_pairs(spark, d, 1, MODELS), *g.values(), keys=("model", "ref_id", "r"), by=["model"])

    return table


full, small = _table(GRID), _table(SMALL_GRID)
T_SQL = "SELECT * EXCLUDE (winner_missing, competitor_missing, threatening_birth, ranking_reversal) FROM gt"
T_D, T_I = f"match birth eligibility coverage conditional theta eligible_theta {SHARES}", "model setting_index kt ke samples eligible probes"
add("contract_grid", full, T_SQL, GRID_SQL, T_D, T_I)
add("contract_sensitivity", small, T_SQL, SMALL_SQL, T_D, T_I)
add(
    "contract_grid_envelope",
    lambda s, d: grid.envelope(full(s, d), ["model"], default=_default(GRID)),
    f"""SELECT model, min(theta) AS minimum, max(theta) AS maximum, max(theta) - min(theta) AS width, greatest(abs(max(theta) - any_value(def)), abs(min(theta) - any_value(def))) AS max_departure,
       min(setting_index) FILTER (WHERE theta = lo) AS minimum_index, min(setting_index) FILTER (WHERE theta = hi) AS maximum_index
       FROM (SELECT *, min(theta) OVER w AS lo, max(theta) OVER w AS hi, max(theta) FILTER (WHERE kt = {DEFAULTS["kt"]} AND ke = {DEFAULTS["ke"]} AND match = {DEFAULTS["match"]}::DOUBLE AND birth = {DEFAULTS["birth"]}::DOUBLE) OVER w AS def
             FROM gt WINDOW w AS (PARTITION BY model)) GROUP BY model""",
    GRID_SQL,
    "minimum maximum width max_departure",
    "model minimum_index maximum_index",
)


def _default(g: dict) -> int:
    at = [g[k].index(v) for k, v in zip(("tracked", "exposed", "match", "birth"), DEFAULTS.values())]
    index = 0
    for k, i in zip(("tracked", "exposed", "match", "birth"), at):
        index = index * len(g[k]) + i
    return index


add(
    "model_pair_min_gap",
    lambda s, d: grid.pair_gaps(full(s, d)),
    """SELECT *, min_gap > 0 OR max_gap < 0 AS invariant, strong_gap > 0 AS strong FROM (SELECT a.model AS model_a, b.model AS model_b, min(a.theta - b.theta) AS min_gap, max(a.theta - b.theta) AS max_gap,
       min(a.theta) - max(b.theta) AS strong_gap, min({'g': a.theta - b.theta, 'i': a.setting_index}).i AS worst_index FROM gt a JOIN gt b ON a.setting_index = b.setting_index AND a.model < b.model GROUP BY ALL)""",
    GRID_SQL,
    "min_gap max_gap strong_gap",
    "model_a model_b worst_index",
)
_fixed = {c: " AND ".join(f"{o} = {v}{'::DOUBLE' if isinstance(v, float) else ''}" for o, v in DEFAULTS.items() if o != c) for c in DEFAULTS}
add(
    "one_factor_range",
    lambda s, d: grid.one_factor(full(s, d), ["model"], DEFAULTS),
    " UNION ALL ".join(
        f"""SELECT model, '{c}' AS factor, string_agg(printf('%.2f', {c}::DOUBLE), ';' ORDER BY {c}) AS tested, count(*) AS levels, min(theta) AS minimum, max(theta) AS maximum,
        max(theta) - min(theta) AS range, max(theta) FILTER (WHERE {c} = {DEFAULTS[c]}{'::DOUBLE' if isinstance(DEFAULTS[c], float) else ''}) AS at_default FROM gt WHERE {_fixed[c]} GROUP BY model"""
        for c in DEFAULTS
    ),
    GRID_SQL,
    "minimum maximum range at_default",
    "model levels",
)
add(
    "grid_saturation",
    lambda s, d: grid.saturation(probe_pairs(s, d, 1, MODELS), ["model"], cap=6),
    "SELECT model, count(*) AS probes, avg((nc >= 6)::INT) AS clean_cap_fraction, avg((least(ne, 6) >= 6)::INT) AS probe_cap_fraction, quantile_cont(least(ne, 6), 0.5) AS median_exposed FROM pb JOIN (SELECT ref_id, count(*) AS nc FROM bx GROUP BY ALL) USING (ref_id) GROUP BY model",
    f"RECURSIVE {replay_sql(1, MODELS, 5, 20)}",
    "clean_cap_fraction probe_cap_fraction median_exposed",
    "model probes",
)
add(
    "duplicate_eligibility",
    lambda s, d: grid.duplicate_eligibility(candidate_lists(s, d), DUPLICATES),
    " UNION ALL ".join(
        f"(WITH RECURSIVE {replay_sql(1, 1, 5, 20, x)} SELECT {x}::DOUBLE AS duplicate, count(*) AS samples, avg((n >= 2)::INT) AS eligibility, avg(n) AS mean_tracked FROM (SELECT ref_id, count(*) AS n FROM tr GROUP BY ALL))" for x in DUPLICATES
    ),
    "one AS (SELECT 1)",
    "duplicate eligibility mean_tracked",
    "samples",
)
O_SQL = """op AS (SELECT *, complete_case - theta AS total_optimism, abs(complete_case - theta - complete_case * (1 - eligibility * coverage)) AS residual FROM (
  SELECT model, setting_index, kt, ke, match, birth, eligibility, eligible_theta, theta, 1 - (1 - eligible_theta) * (1 - ranking_reversal_share) * (eligible_theta < 1)::INT AS coverage,
    1 - (1 - eligible_theta) * ranking_reversal_share / nullif(1 - (1 - eligible_theta) * (1 - ranking_reversal_share) * (eligible_theta < 1)::INT, 0) AS complete_case FROM gt))"""
add(
    "contract_optimism",
    lambda s, d: grid.optimism(small(s, d), ["model"]),
    "SELECT * FROM op",
    f"{SMALL_SQL}, {O_SQL}",
    "match birth eligibility eligible_theta theta coverage complete_case total_optimism residual",
    "model setting_index kt ke",
)
add(
    "contract_optimism_ranges",
    lambda s, d: grid.optimism_ranges(grid.optimism(small(s, d), ["model"]), ["model"]),
    "SELECT model, count(*) AS settings, " + ", ".join(f"{f}({c}) AS {f}_{c}" for c in ("complete_case", "theta", "total_optimism") for f in ("min", "max")) + " FROM op GROUP BY model",
    f"{SMALL_SQL}, {O_SQL}",
    " ".join(f"{f}_{c}" for c in ("complete_case", "theta", "total_optimism") for f in ("min", "max")),
    "model settings",
)
