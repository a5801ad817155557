"""From candidate lists to probe outcomes: association, births, order, failure class.

The plan is narrow: lists stay in their row. Association maximises the summed IoU
one to one before any threshold. Where each tracked candidate that overlaps anything
has a best target of its own, these targets are the optimum, found in the JVM; the
other rows go to an exact assignment in Arrow batches, polynomial in the lists' lengths.
At a match threshold of zero pairs without overlap count as well, so there a row is
only settled in the JVM if each tracked candidate overlaps something.

Totals are compared in billionths; of equal totals the lexicographically least mapping
counts, in which "none" comes last.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import CANDIDATE, iou, spatially_distinct
from .contract import OutputContract

#: Fixed value: why a pair has no outcome.
INELIGIBLE = "fewer_than_two_spatially_distinct_clean_candidates"


def assign(ious: np.ndarray) -> list[int]:
    """For each row a column or -1: pairs of greatest total, as many as fit, by shortest augmenting paths.

    Gains are whole numbers: the IoU in billionths, above digits of the column's place, so
    that of equal totals the least mapping wins without another search.
    """
    n, m = ious.shape
    base, scale = m + 1, (m + 1) ** n
    gain = [[round(float(x) * 1e9) * scale + (m - j) * base ** (n - 1 - i) for j, x in enumerate(row)] for i, row in enumerate(ious)]
    if n > m:  # more rows than columns: columns look for rows
        to_row = _matched([[-gain[i][j] for i in range(n)] for j in range(m)])
        out = [-1] * n
        for j, i in enumerate(to_row):
            out[i] = j
        return out
    return _matched([[-x for x in row] for row in gain])


def _matched(cost: list[list[int]]) -> list[int]:
    """The column of each row in the matching of least cost; rows are not more than columns."""
    n, m = len(cost), len(cost[0]) if cost else 0
    of_row, of_column = [0] * n, [0] * m  # prices
    row_at = [-1] * m
    for start in range(n):
        shortest: list[int | None] = [None] * m
        came, done = [-1] * m, [False] * m
        row, column, length = start, -1, 0
        while True:
            best, nearest = -1, None
            for j in range(m):
                if not done[j]:
                    to = length + cost[row][j] - of_row[row] - of_column[j]
                    if shortest[j] is None or to < shortest[j]:
                        shortest[j], came[j] = to, column
                    if nearest is None or shortest[j] < nearest:
                        best, nearest = j, shortest[j]
            column, length = best, nearest
            done[column] = True
            if row_at[column] < 0:
                break
            row = row_at[column]
        of_row[start] += length
        for j in range(m):
            if done[j] and j != column:
                of_row[row_at[j]] += length - shortest[j]
                of_column[j] -= length - shortest[j]
        while column >= 0:  # along the path back to the start
            before = came[column]
            row_at[column] = row_at[before] if before >= 0 else start
            column = before
    out = [-1] * n
    for j, i in enumerate(row_at):
        if i >= 0:
            out[i] = j
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _assign_hard(ious: pd.Series) -> pd.Series:
    return ious.map(lambda m: None if m is None else assign(np.array([np.asarray(r, dtype=float) for r in m])) if len(m[0]) else [-1] * len(m))


def associated(df: DataFrame, tracked: str = "tracked", exposed: str = "exposed", out: str = "assignment", least_match: float = 0.1) -> DataFrame:
    """``df`` with the best one-to-one target of each tracked candidate (``out``: -1 for none) and ``out``_iou.

    ``least_match`` is the least match threshold to come: above 0, pairs without overlap needn't be told.
    """
    m = F.transform(F.col(tracked), lambda c: F.transform(F.col(exposed), lambda p: iou(c, p)))
    a = df.withColumn("ox_iou", m)
    best = F.transform(F.col("ox_iou"), lambda r: F.when(F.coalesce(F.array_max(r), F.lit(0.0)) > 0, (F.array_position(r, F.array_max(r)) - 1).cast("int")).otherwise(F.lit(-1)))
    a = a.withColumn("ox_best", best)
    real = F.filter(F.col("ox_best"), lambda x: x >= 0)
    own = F.size(F.array_distinct(real)) == F.size(real)
    a = a.withColumn("ox_easy", own if least_match > 0 else own & (F.size(real) == F.size("ox_best")))
    a = a.withColumn("ox_hard", _assign_hard(F.when(~F.col("ox_easy"), F.col("ox_iou"))))
    a = a.withColumn(out, F.when(F.col("ox_easy"), F.col("ox_best")).otherwise(F.col("ox_hard")))
    a = a.withColumn(f"{out}_iou", F.transform(F.col(out), lambda j, i: F.when(j >= 0, F.get(F.get(F.col("ox_iou"), i), j)).otherwise(F.lit(0.0))))
    return a.drop("ox_iou", "ox_best", "ox_easy", "ox_hard")


def _box(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(c["x1"], c["y1"], c["x2"], c["y2"]))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def outcome(tracked: Column, exposed: Column, assignment: Column, ious: Column, match: Column, birth: Column) -> Column:
    """The outcome of one probe as a struct; null-safe for empty exposed lists."""
    mapping = F.zip_with(assignment, ious, lambda j, x: F.when((j >= 0) & (x >= match), j))

    def found(m: Column) -> Column:
        at = F.transform(m, lambda j: F.get(exposed, j))
        return F.struct(m.alias("m"), at.alias("at"), F.filter(m, lambda j: j.isNotNull()).alias("used"), F.filter(F.sequence(F.lit(0), F.size(tracked) - 1), lambda i: F.get(m, i).isNull()).alias("missing"))

    def births(f: Column) -> Column:
        winner = F.get(f["at"], F.lit(0))
        # Candidates by score first: most are told by it alone.
        places = F.filter(F.sequence(F.lit(0), F.size(exposed) - 1), lambda j: (F.get(exposed, j)["score"] >= winner["score"]) & ~F.array_contains(f["used"], j))
        near = lambda j: F.exists(f["at"], lambda t: t.isNotNull() & (iou(t, F.get(exposed, j)) >= birth))
        none = F.array().cast("array<int>")
        new = F.when(winner.isNotNull() & (F.size(exposed) > 0), F.filter(places, lambda j: ~near(j))).otherwise(none)
        return F.struct(*[f[c].alias(c) for c in ("m", "at", "missing")], new.alias("births"))

    def ordered(f: Column) -> Column:
        covered = (F.size(f["missing"]) == 0) & (F.size(f["births"]) == 0)
        first = F.get(f["at"], F.lit(0))["score"]
        gaps = F.when(covered, F.transform(F.slice(f["at"], F.lit(2), F.size(f["at"])), lambda c: first - c["score"]))
        return F.struct(*[f[c].alias(c) for c in ("m", "at", "missing", "births")], gaps.alias("gaps"), F.array_min(gaps).alias("least"))

    def named(f: Column) -> Column:
        covered, stable = f["gaps"].isNotNull(), F.coalesce(f["least"] > 0, F.lit(False))
        failure = (
            F.when(covered & stable, "stable")
            .when(F.get(f["m"], F.lit(0)).isNull(), "winner_missing")
            .when(F.size(f["missing"]) > 0, "competitor_missing")
            .when(F.size(f["births"]) > 0, "threatening_birth")
            .otherwise("ranking_reversal")
        )
        return F.struct(
            covered.cast("int").alias("coverage"),
            F.when(covered, stable.cast("int")).alias("rank_stable"),
            (covered & stable).cast("int").alias("operational_stable"),
            failure.alias("primary_failure"),
            F.when(covered & ~stable, F.array_position(f["gaps"], f["least"]).cast("int")).alias("culprit_clean_index"),
            f["m"].alias("mapping"),
            F.zip_with(f["m"], ious, lambda j, x: F.when(j.isNotNull(), x)).alias("matched_ious"),
            F.transform(f["at"], lambda c: c["score"]).alias("matched_scores"),
            F.transform(f["at"], _box).alias("matched_boxes"),
            f["gaps"].alias("gaps"),
            f["missing"].alias("missing_clean_indices"),
            f["births"].alias("threatening_birth_indices"),
            F.transform(f["births"], lambda j: F.get(exposed, j)["score"]).alias("threatening_birth_scores"),
            F.size(exposed).alias("perturbed_candidate_count"),
        )

    return _let(mapping, lambda m: _let(found(m), lambda f: _let(births(f), lambda g: _let(ordered(g), named))))


def evaluated(pairs: DataFrame, contract: OutputContract | None = None, clean: str = "clean_candidates", perturbed: str = "perturbed_candidates") -> DataFrame:
    """``pairs`` with ``tracked``, ``exposed``, ``clean_eligible``, ``outcome`` and ``ineligible_reason``; lists are in columnar form.
    An ineligible pair exposes nothing and has no outcome."""
    c = contract or OutputContract()
    a = pairs.withColumn("tracked", spatially_distinct(F.col(clean), c.tracked_candidate_count, c.duplicate_iou_threshold))
    a = a.withColumn("clean_eligible", (F.size("tracked") >= 2).cast("int"))
    none = F.array().cast(f"array<{CANDIDATE}>")
    a = a.withColumn("exposed", F.when(F.col("clean_eligible") == 1, spatially_distinct(F.coalesce(F.col(perturbed), F.array()), c.exposed_candidate_count, c.duplicate_iou_threshold)).otherwise(none))
    a = associated(a, least_match=c.match_iou_threshold)
    found = outcome(F.col("tracked"), F.col("exposed"), F.col("assignment"), F.col("assignment_iou"), F.lit(c.match_iou_threshold), F.lit(c.birth_duplicate_iou_threshold))
    eligible = F.col("clean_eligible") == 1
    return a.withColumn("outcome", F.when(eligible, found)).withColumn("ineligible_reason", F.when(~eligible, F.lit(INELIGIBLE))).drop("assignment", "assignment_iou")
