"""Coverage-aware estimands over a probe fact table, with ineligible trials in every denominator.

Facts: ``model, ref_id, split, ord, family, severity, coverage, rank_stable, stable,
failure, culprit, eligible, correct``. Everything starts from counts that partial
aggregation makes before the one shuffle on the grouping keys; a sample that a
split or budget has no probe of stays with zero by the outer join on all samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import FAILURES, calibration_bin, ratio, severity_bin, strength
from .joins import many_to_one, one_to_one
from .statistics import spearman, with_intervals


def counts(eligible_only: bool = True) -> list[Column]:
    e = F.col("eligible") if eligible_only else F.lit(1)
    return [
        F.count(F.lit(1)).alias("trials"),
        F.sum(e).alias("eligible_trials"),
        F.sum(e * F.col("coverage")).alias("covered"),
        F.sum(e * F.col("stable")).alias("stable"),
    ]


def pooled(facts: DataFrame, by: list[str]) -> DataFrame:
    """Γ (eligibility), coverage, complete-case stability, full-manifest stability, optimism, its two parts, and the residuals of
    the identities that give each from Γ, coverage and complete-case stability."""
    a = facts.groupBy(*by).agg(*counts())
    gamma, cov = F.col("eligible_trials") / F.col("trials"), ratio(F.col("covered"), F.col("eligible_trials"))
    cc, op, full = ratio(F.col("stable"), F.col("covered")), ratio(F.col("stable"), F.col("eligible_trials")), F.col("stable") / F.col("trials")
    a = a.select(*by, "trials", "eligible_trials", "covered", "stable", gamma.alias("eligibility"), cov.alias("coverage"), cc.alias("complete_case"), op.alias("eligible_operational"), full.alias("full_operational"))
    return with_optimism(a)


def with_optimism(a: DataFrame) -> DataFrame:
    gamma, cov, cc, op, full = (F.col(c) for c in ("eligibility", "coverage", "complete_case", "eligible_operational", "full_operational"))
    a = a.withColumns({"optimism": cc - full, "optimism_coverage": cc - op, "optimism_eligibility": op - full})
    return a.withColumns(
        {
            "residual": F.abs(F.col("optimism") - cc * (1 - gamma * cov)),
            "residual_coverage": F.abs(F.col("optimism_coverage") - cc * (1 - cov)),
            "residual_eligibility": F.abs(F.col("optimism_eligibility") - (1 - gamma) * cov * cc),
        }
    )


def family_estimands(facts: DataFrame, by: list[str]) -> DataFrame:
    """Estimands by family, where ineligible samples have no trials: the full manifest has as many trials a sample as the eligible ones.
    Null where nobody is eligible."""
    s = facts.groupBy(*by, "ref_id").agg(F.max("eligible").alias("e")).groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.sum("e").alias("eligible_samples"))
    a = facts.groupBy(*by, "family").agg(*counts()).drop("trials").join(s, by)
    gamma, cov, cc, op = F.col("eligible_samples") / F.col("samples"), ratio(F.col("covered"), F.col("eligible_trials")), ratio(F.col("stable"), F.col("covered")), ratio(F.col("stable"), F.col("eligible_trials"))
    full = ratio(F.col("stable"), F.col("samples") * ratio(F.col("eligible_trials"), F.col("eligible_samples")))
    a = a.select(*by, "family", "samples", "eligible_samples", "eligible_trials", gamma.alias("eligibility"), cov.alias("coverage"), cc.alias("complete_case"), op.alias("eligible_operational"), full.alias("full_operational"))
    return with_optimism(a)


def risk_decomposition(facts: DataFrame, by: list[str]) -> DataFrame:
    """Failure risk as coverage risk and ranking risk, with the identity's residual."""
    a = facts.filter("eligible = 1").groupBy(*by).agg(*counts())
    cov, op = F.col("covered") / F.col("eligible_trials"), F.col("stable") / F.col("eligible_trials")
    rank = F.coalesce(ratio(F.col("stable"), F.col("covered")), F.lit(0.0))
    a = a.select(*by, (1 - op).alias("risk"), (1 - cov).alias("coverage_risk"), (cov * (1 - rank)).alias("ranking_risk"))
    return a.withColumn("residual", F.abs(F.col("risk") - F.col("coverage_risk") - F.col("ranking_risk")))


def family_risk(facts: DataFrame, by: list[str]) -> DataFrame:
    """Law of total probability over families: weight, conditional risk, contribution and share of all risk."""
    a = facts.filter("eligible = 1").groupBy(*by, "family").agg(*counts())
    w = W.partitionBy(*by)
    weight = F.col("eligible_trials") / F.sum("eligible_trials").over(w)
    risk = 1 - F.col("stable") / F.col("eligible_trials")
    a = a.select(*by, "family", weight.alias("weight"), risk.alias("risk"), (weight * risk).alias("contribution"))
    return a.withColumn("share", F.coalesce(ratio(F.col("contribution"), F.sum("contribution").over(w)), F.lit(0.0)))


def failure_causes(facts: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each failure class, with zero rows for classes that don't occur."""
    found = facts.filter("eligible = 1 AND failure <> 'stable'").groupBy(*by, "failure").agg(F.count(F.lit(1)).alias("n"))
    groups = facts.select(*by).distinct().withColumn("failure", F.explode(F.array(*[F.lit(x) for x in FAILURES])))
    a = groups.join(found, [*by, "failure"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return a.withColumn("share", F.coalesce(ratio(F.col("n"), F.sum("n").over(W.partitionBy(*by))), F.lit(0.0)))


def culprits(facts: DataFrame, by: list[str]) -> DataFrame:
    """Ranks (clean index and one) of the candidates that reversed the order, as observed, and their shares."""
    n = facts.filter("eligible = 1 AND failure = 'ranking_reversal'").groupBy(*by, (F.col("culprit") + 1).alias("culprit_rank")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def samples(facts: DataFrame) -> DataFrame:
    """A row for each model and sample, eligible or not."""
    return facts.groupBy("model", "ref_id").agg(F.max("eligible").alias("eligible"), F.max("correct").alias("correct"))


def sample_stats(facts: DataFrame, budget: int | None = None) -> DataFrame:
    """``model, ref_id, split, n, n_covered, n_stable`` over the first ``budget`` probes of a split."""
    a = facts.filter("eligible = 1")
    a = a if budget is None else a.filter(F.col("ord") < budget)
    return a.groupBy("model", "ref_id", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("coverage").alias("n_covered"), F.sum("stable").alias("n_stable"))


def sample_table(facts: DataFrame, budgets: list[int] | None = None) -> DataFrame:
    """A row for each model, sample and budget of diagnostic probes (null: all of them): ``eligible, correct`` and counts of
    eligible trials, ``d_n, d_c, d_k`` of diagnostic probes within the budget and ``r_n, r_c, r_k`` of reference probes: trials, covered,
    stable. One aggregation for all budgets and both splits."""

    def sums(name: str, where: Column) -> list[Column]:
        hit = (where & (F.col("eligible") == 1)).cast("long")
        return [F.sum(hit).alias(f"{name}_n"), F.sum(hit * F.col("coverage")).alias(f"{name}_c"), F.sum(hit * F.col("stable")).alias(f"{name}_k")]

    limits = budgets or [None]
    diagnostic = [sums(f"d{i}", (F.col("split") == "diagnostic") & (F.lit(True) if b is None else F.col("ord") < b)) for i, b in enumerate(limits)]
    g = facts.groupBy("model", "ref_id").agg(F.max("eligible").alias("eligible"), F.max("correct").alias("correct"), *sums("r", F.col("split") == "reference"), *[c for x in diagnostic for c in x])
    each = [F.struct(F.lit(b).cast("int").alias("budget"), *[F.col(f"d{i}_{x}").alias(f"d_{x}") for x in "nck"]) for i, b in enumerate(limits)]
    return g.select("model", "ref_id", "eligible", "correct", "r_n", "r_c", "r_k", F.explode(F.array(*each)).alias("x")).select("model", "ref_id", "eligible", "correct", "x.*", "r_n", "r_c", "r_k")


def estimates(table: DataFrame) -> DataFrame:
    """Of :func:`sample_table` the ineligible samples, with 0 for both estimates, and those with probes of both splits."""
    rate = lambda x, y: F.coalesce(ratio(F.col(x), F.col(y)), F.lit(0.0))
    a = table.filter("eligible = 0 OR (d_n > 0 AND r_n > 0)")
    return a.withColumns({"diagnostic": rate("d_k", "d_n"), "reference": rate("r_k", "r_n"), "direct": ratio(F.col("d_k"), F.col("d_c"))})


def paired_profiles(facts: DataFrame, budget: int | None = None) -> DataFrame:
    """Per sample: diagnostic estimate (first ``budget`` probes) beside the reference estimate; ineligible ones are 0."""
    return estimates(sample_table(facts, None if budget is None else [budget])).select("model", "ref_id", "eligible", "correct", "diagnostic", "reference")


def prediction_metrics(pairs: DataFrame, by: list[str], predicted: str = "diagnostic", target: str = "reference") -> DataFrame:
    """Bias, MAE, RMSE and Brier score of a predictor."""
    e, p, t = F.col(predicted) - F.col(target), F.col(predicted), F.col(target)
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(p * p - 2 * p * t + t).alias("brier"))


def budget_table(facts: DataFrame, budgets: list[int], by: str = "model", confidence: float = 0.95) -> DataFrame:
    """Fifteen measures for each group and budget of diagnostic probes: counts, means over all and over eligible samples, errors
    against the reference, rank correlations, how often the exact interval holds the reference, and its mean width."""
    a = estimates(sample_table(facts, budgets)).withColumnRenamed(by, "ox_by").select(F.col("ox_by").alias(by), "budget", "ref_id", "eligible", "d_n", "d_k", "diagnostic", "reference")
    a = with_intervals(a, "d_k", "d_n", confidence)
    e, ok = F.col("diagnostic") - F.col("reference"), F.col("eligible") == 1
    inside = (F.col("reference") >= F.col("lower")) & (F.col("reference") <= F.col("upper"))
    of = lambda x: F.avg(F.when(ok, x))
    g = a.groupBy(by, "budget").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("eligible").alias("eligible"), F.avg("eligible").alias("eligibility"), F.avg("diagnostic").alias("diagnostic_mean"), F.avg("reference").alias("reference_mean"),
        of(F.col("diagnostic")).alias("diagnostic_eligible_mean"), of(F.col("reference")).alias("reference_eligible_mean"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        of(F.abs(e)).alias("mae_eligible"), of(inside.cast("double")).alias("inside_interval"), F.avg(F.col("upper") - F.col("lower")).alias("mean_width"),
    )
    rank = lambda x, out: spearman(x, [by, "budget"], "diagnostic", "reference").select(by, "budget", F.col("spearman").alias(out))
    return g.join(rank(a, "spearman"), [by, "budget"]).join(rank(a.filter("eligible = 1"), "spearman_eligible"), [by, "budget"], "left")


def finite_probe_by_scope(facts: DataFrame, scope: Column, budgets: list[int]) -> DataFrame:
    """For each scope (a column of samples) and budget: counts, bias over all samples, error and rank correlation over eligible ones."""
    a = estimates(sample_table(facts, budgets)).withColumn("scope", scope)
    e, ok = F.col("diagnostic") - F.col("reference"), F.col("eligible") == 1
    g = a.groupBy("scope", "budget").agg(F.count(F.lit(1)).alias("samples"), F.sum("eligible").alias("eligible"), F.avg(e).alias("bias"), F.avg(F.when(ok, F.abs(e))).alias("mae_eligible"))
    return g.join(spearman(a.filter(ok), ["scope", "budget"], "diagnostic", "reference").drop("n"), ["scope", "budget"], "left").withColumnRenamed("spearman", "spearman_eligible")


def predictive_tables(facts: DataFrame, budgets: list[int]) -> tuple[DataFrame, DataFrame]:
    """Predictors of the reference, by model and budget: the operational estimate over the full manifest, and it and complete-case
    persistence over the samples that have the latter, each with its measures and availability; and calibration of the last two."""
    a = estimates(sample_table(facts, budgets))
    row = lambda scope, predictor, p: F.struct(F.lit(scope).alias("scope"), F.lit(predictor).alias("predictor"), p.alias("p"))
    rows = F.array(
        row("full_manifest", "operational", F.when(F.col("diagnostic").isNotNull(), F.col("diagnostic"))),
        row("paired_complete_cases", "operational", F.when(F.col("direct").isNotNull(), F.col("diagnostic"))),
        row("paired_complete_cases", "complete_case", F.when(F.col("direct").isNotNull(), F.col("direct"))),
    )
    long = a.select("model", "budget", F.explode(rows).alias("x"), "reference").select("model", "budget", "x.scope", "x.predictor", "x.p", "reference")
    keys = ["model", "budget", "scope", "predictor"]
    all_ = long.groupBy(*keys).agg((F.count("p") / F.count(F.lit(1))).alias("availability"))
    some = long.filter("p IS NOT NULL")
    metrics = prediction_metrics(some, keys, "p").join(all_, keys)
    paired = some.filter("scope = 'paired_complete_cases'").select("model", "budget", "predictor", F.col("p").alias("diagnostic"), "reference")
    return metrics, calibration(paired, ["model", "budget", "predictor"]).withColumn("gap", F.col("predicted") - F.col("observed"))


def budget_metrics(facts: DataFrame, budgets: list[int]) -> DataFrame:
    """Prediction metrics of eligible samples at each budget of diagnostic probes."""
    return prediction_metrics(estimates(sample_table(facts, budgets)).filter("eligible = 1"), ["model", "budget"])


def family_by_budget(facts: DataFrame, budgets: list[int]) -> DataFrame:
    """Family risks over the first probes of the diagnostic split at each budget."""
    grid = F.explode(F.filter(F.array(*[F.lit(b) for b in budgets]), lambda b: F.col("ord") < b))
    a = facts.filter("eligible = 1 AND split = 'diagnostic'").select("model", "family", "stable", grid.alias("budget"))
    return a.groupBy("model", "budget", "family").agg(F.count(F.lit(1)).alias("n"), (1 - F.avg("stable")).alias("risk"))


def strata(facts: DataFrame, by: list[str]) -> DataFrame:
    return pooled(facts, [*by, "correct"])


def calibration(pairs: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    a = pairs.withColumn("bin", calibration_bin(F.col("diagnostic"), bins))
    return a.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("diagnostic").alias("predicted"), F.avg("reference").alias("observed"))


def severity_curve(facts: DataFrame, by: list[str], bins: int = 5) -> DataFrame:
    """Stability by bins of probe strength, ineligible trials as failures."""
    a = facts.withColumn("bin", severity_bin(strength(F.col("family"), F.col("severity")), bins))
    return a.groupBy(*by, "family", "bin").agg(*counts()).withColumn("full_operational", F.col("stable") / F.col("trials"))


def full_failure_risk(facts: DataFrame, by: list[str]) -> DataFrame:
    """All trials by what became of them: six classes with ineligibility, shares of the full manifest."""
    kind = F.when(F.col("eligible") == 0, "ineligible").otherwise(F.col("failure"))
    a = facts.groupBy(*by, kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return a.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def common_support(facts: DataFrame, models: int) -> DataFrame:
    """Estimands of each model over the samples that are eligible under all models."""
    common = samples(facts).filter("eligible = 1").groupBy("ref_id").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") == models)
    return pooled(facts.join(common.select("ref_id"), "ref_id", "left_semi"), ["model"])


def mixture_gaps(facts: DataFrame) -> DataFrame:
    """Pairs of models under equal family weights: least and greatest gap over families."""
    f = facts.groupBy("model", "family").agg((F.sum(F.col("eligible") * F.col("stable")) / F.count(F.lit(1))).alias("theta"))
    a, b = f.select(F.col("model").alias("model_a"), "family", F.col("theta").alias("ta")), f.select(F.col("model").alias("model_b"), "family", F.col("theta").alias("tb"))
    j = a.join(b, "family").filter("model_a < model_b")  # a row for each family and model: as small as their numbers
    return j.groupBy("model_a", "model_b").agg(F.avg(F.col("ta") - F.col("tb")).alias("equal_weight_gap"), F.min(F.col("ta") - F.col("tb")).alias("min_gap"), F.max(F.col("ta") - F.col("tb")).alias("max_gap"))


def transitions(facts: DataFrame) -> DataFrame:
    """Failure classes of diagnostic against reference probes of the same sample and place."""
    d = facts.filter("split = 'diagnostic'").select("model", "ref_id", "ord", F.col("failure").alias("old"))
    r = facts.filter("split = 'reference'").select("model", "ref_id", "ord", F.col("failure").alias("new"))
    return d.join(r, ["model", "ref_id", "ord"]).groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))


def family_transfer(facts: DataFrame) -> DataFrame:
    """Shares of risk by family, diagnostic probes against reference probes: rank correlation, cosine and mean absolute shift."""
    f = family_risk(facts, ["model", "split"])
    s = f.filter("split = 'diagnostic'").select("model", "family", F.col("share").alias("a"))
    t = f.filter("split = 'reference'").select("model", "family", F.col("share").alias("b"))
    j = one_to_one(s, t, ["model", "family"])
    norm = F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))
    g = j.groupBy("model").agg(F.count(F.lit(1)).alias("families"), (F.sum(F.col("a") * F.col("b")) / F.nullif(norm, F.lit(0.0))).alias("cosine"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_shift"))
    return g.join(spearman(j, ["model"], "a", "b").drop("n"), "model")


def budget_against_reference(facts: DataFrame, budgets: list[int]) -> DataFrame:
    """Family risks over the first diagnostic probes at each budget beside those of the reference, and the shift."""
    r = facts.filter("eligible = 1 AND split = 'reference'").groupBy("model", "family").agg((1 - F.avg("stable")).alias("reference_risk"))
    return many_to_one(family_by_budget(facts, budgets), r, ["model", "family"]).withColumn("shift", F.col("risk") - F.col("reference_risk"))


def largest_budget(table: DataFrame, by: list[str], budget: str = "budget") -> DataFrame:
    """The rows of each group's largest budget. The largest is aggregated first: rows don't move for it but by their join."""
    top = table.groupBy(*by).agg(F.max(budget).alias("ox_top"))
    return table.join(top, by).filter(F.col(budget) == F.col("ox_top")).drop("ox_top")


def transfer(facts: DataFrame) -> DataFrame:
    """Means of per-sample means over the reference split; samples without eligible probes count 0 in the full mean."""
    s = sample_stats(facts).filter("split = 'reference'")
    a = samples(facts).join(s, ["model", "ref_id"], "left")
    op = F.col("n_stable") / F.col("n")
    return a.groupBy("model").agg(
        F.count(F.lit(1)).alias("samples"), F.avg(F.col("eligible").cast("double")).alias("eligibility"), F.avg(F.col("n_covered") / F.col("n")).alias("coverage"), F.avg(op).alias("eligible_operational"), F.avg(F.coalesce(op, F.lit(0.0))).alias("full_operational")
    )


def profiles(facts: DataFrame, confidence: float = 0.95) -> DataFrame:
    """The profile of each sample and split: counts, estimates with exact intervals, risks with the identity's residual, and shares
    of families, failures and culprits as maps. One aggregation: all counts come from the numbers of (family, failure, culprit)."""
    keys = ["model", "ref_id", "split"]
    cell = F.struct("family", "failure", F.col("culprit").cast("string").alias("culprit"), "coverage", "stable")
    n = facts.filter("eligible = 1").groupBy(*keys, cell.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    sums = {"probes": F.col("n"), "covered": F.col("n") * F.col("c.coverage"), "stable": F.col("n") * F.col("c.stable")}
    a = n.groupBy(*keys).agg(*[F.sum(x).alias(c) for c, x in sums.items()], F.collect_list(F.struct("c", "n")).alias("cells"))

    def tally(key, where) -> Column:  # noqa: ANN001
        own = F.filter("cells", where)
        names = F.array_sort(F.array_distinct(F.transform(own, lambda x: key(x["c"]))))
        total = lambda k: F.aggregate(F.filter(own, lambda x: key(x["c"]) == k), F.lit(0).cast("long"), lambda s, x: s + x["n"])
        return F.map_from_entries(F.transform(names, lambda k: F.struct(k, total(k))))

    a = a.withColumns(
        {
            "families": tally(lambda c: c["family"], lambda x: F.lit(True)),
            "family_failures": tally(lambda c: c["family"], lambda x: x["c"]["stable"] == 0),
            "failures": tally(lambda c: c["failure"], lambda x: x["c"]["failure"] != "stable"),
            "culprits": tally(lambda c: c["culprit"], lambda x: x["c"]["culprit"].isNotNull()),
        }
    ).drop("cells")
    cov, op, rank = F.col("covered") / F.col("probes"), F.col("stable") / F.col("probes"), ratio(F.col("stable"), F.col("covered"))
    a = a.withColumns({"coverage": cov, "conditional": rank, "operational": op, "risk": 1 - op, "coverage_risk": 1 - cov, "ranking_risk": cov * (1 - F.coalesce(rank, F.lit(0.0)))})
    a = a.withColumn("residual", F.abs(F.col("risk") - F.col("coverage_risk") - F.col("ranking_risk")))
    shares = lambda m, d: F.transform_values(m, lambda k, v: F.coalesce(ratio(v, d), F.lit(0.0)))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, x: s + x)
    # A family's contribution to the risk is its failures among all probes; its share, among all failures.
    a = a.withColumns({"family_shares": shares("family_failures", F.col("probes") - F.col("stable")), "failure_shares": shares("failures", total("failures")), "culprit_shares": shares("culprits", total("culprits"))})
    for k, n_, name in (("covered", "probes", "coverage"), ("stable", "covered", "conditional"), ("stable", "probes", "operational")):
        a = with_intervals(a, k, n_, confidence, f"{name}_lower", f"{name}_upper")
    return a


def flattened(profile: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """The thirteen columns of a profile's row in a table, each behind a prefix."""
    columns = {"probe_count": "probes"} | {f"{o}{e}": f"{c}{e}" for o, c in (("coverage", "coverage"), ("conditional_ranking", "conditional"), ("operational", "operational")) for e in ("", "_lower", "_upper")}
    columns |= {"coverage_risk": "coverage_risk", "ranking_risk": "ranking_risk", "risk_decomposition_error": "residual"}
    return profile.select(*keys, *[F.col(c).alias(f"{prefix}_{n}") for n, c in columns.items()])


def first_examples(facts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first probe of each failure class in the order of its key. By aggregation: one row of a task and class moves."""
    e = facts.filter("eligible = 1").groupBy(*by, "failure").agg(F.min(F.struct(*order)).alias("f"))
    return e.select(*by, "failure", "f.*")


def pivoted(table: DataFrame, by: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """Long to wide over known values, with 0 where there is no row."""
    return table.groupBy(*by).pivot(column, values).agg(F.sum(value)).na.fill(0, values)


def cap_hits(probes: DataFrame, cap: int, splits: list[str], limit: int | None = None) -> DataFrame:
    """The probes of eligible samples whose exposed candidates reach the cap, to be run again with more: in the order of their keys, the
    first ``limit`` of them, with an id that is the hash of what tells a probe from another."""
    a = probes.filter((F.col("eligible") == 1) & F.col("split").isin(splits) & (F.col("exposed") >= cap))
    a = a.withColumn("probe_id", probe_id(*[F.col(c) for c in ("image_id", "ref_id", "split", "family", "severity", "seed")]))
    return a if limit is None else a.orderBy("image_id", "ref_id", "ord").limit(limit)


def probe_id(image_id: Column, ref_id: Column, split: Column, family: Column, severity: Column, seed: Column) -> Column:
    """Twenty hex digits of the SHA-256 of the key as a JSON list."""
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    parts = [image_id.cast("string"), ref_id.cast("string"), text(split), text(family), severity.cast("string"), seed.cast("string")]
    return F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")).cast("binary"), 256), 1, 20)


def cap_truncation(facts: DataFrame, exposed: str, cap: int) -> DataFrame:
    """Share of probes at the exposure cap, stability, and its pessimistic bound with those counted as failures."""
    hit = (F.col(exposed) >= cap).cast("int")
    ok = F.col("eligible") * F.col("stable")
    a = facts.groupBy("model").agg(F.avg(hit.cast("double")).alias("cap_fraction"), F.avg(ok.cast("double")).alias("theta"), F.avg((ok * (1 - hit)).cast("double")).alias("pessimistic"))
    return a.withColumn("correction", F.col("theta") - F.col("pessimistic"))


def exposure_deltas(runs: DataFrame, by: list[str], trials: int | None = None) -> DataFrame:
    """Re-runs at several exposures, by exposure against the first: net change, both directions of flips, the change over ``trials``
    (all of the manifest; without, the probes re-run), agreement of the first exposure's re-run with the old run in stability and
    class, and probes whose clean prefix differs. ``runs``: ``by, old_stable, old_failure, same_prefix`` and ``outcomes``, a list of
    (exposure, stable, failure) of which the first is the reference."""
    a = runs.select(*by, "old_stable", "old_failure", "same_prefix", F.get("outcomes", F.lit(0)).alias("f"), F.explode("outcomes").alias("x"))
    new, old = F.col("x.stable"), F.col("f.stable")
    g = a.groupBy(*by, "x.exposure").agg(
        F.count(F.lit(1)).alias("probes"), F.avg(new.cast("double")).alias("stable_fraction"), F.sum((new - old).cast("long")).alias("net_changes"),
        F.sum(((old == 0) & (new == 1)).cast("long")).alias("fail_to_stable"), F.sum(((old == 1) & (new == 0)).cast("long")).alias("stable_to_fail"),
        F.avg((old == F.col("old_stable")).cast("double")).alias("stability_agreement"), F.avg((F.col("f.failure") == F.col("old_failure")).cast("double")).alias("label_agreement"),
        F.sum((F.col("same_prefix") == 0).cast("long")).alias("prefix_mismatches"),
    )
    return g.withColumn("delta", F.col("net_changes") / (F.lit(trials) if trials else F.col("probes")))
