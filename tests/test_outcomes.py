"""Suppression, association, outcomes and grids against a plain evaluator on drawn lists; the command end to end."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinex.functions import geometry
from ordinex.operators import grid as G
from ordinex.operators.contract import GRID, OutputContract, grid
from ordinex.operators.outcome import INELIGIBLE, assign, evaluated
from ordinex.plans.evaluate import evaluate, main
from ordinex.sources.files import PAIR, read_pairs

COLUMNS = f"k int, clean_candidates array<{geometry.CANDIDATE}>, perturbed_candidates array<{geometry.CANDIDATE}>"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(0.0, w) * max(0.0, h)
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u > 0 else 0.0


def thin(boxes, most, limit):
    kept = []
    for b in sorted(boxes, key=lambda b: -b[4]):  # stable
        if len(kept) < most and all(overlap(b, k) < limit for k in kept):
            kept.append(b)
    return kept


def best_mapping(rows, columns):
    """Of all ways to join as many as fit, that of the greatest total in billionths, then the least mapping."""
    n, m = len(rows), len(columns)
    options = [list(p) for p in itertools.permutations([*range(m), *[m] * max(0, n - m)], n)] if m else [[m] * n]
    return min(options, key=lambda p: (-sum(round(overlap(rows[i], columns[j]) * 1e9) for i, j in enumerate(p) if j < m), p))


def judged(clean, perturbed, c):
    """(class, culprit, mapping, births) of one probe, word for word as the rules read; None if not eligible."""
    t = thin(clean, c.tracked_candidate_count, c.duplicate_iou_threshold)
    if len(t) < 2:
        return None
    e = thin(perturbed, c.exposed_candidate_count, c.duplicate_iou_threshold)
    mapping = [j if j < len(e) and overlap(t[i], e[j]) >= c.match_iou_threshold else None for i, j in enumerate(best_mapping(t, e))]
    used = [j for j in mapping if j is not None]
    births = []
    if mapping[0] is not None:
        births = [j for j in range(len(e)) if j not in used and e[j][4] >= e[mapping[0]][4] and all(overlap(e[q], e[j]) < c.birth_duplicate_iou_threshold for q in used)]
    if mapping[0] is None:
        return "winner_missing", None, mapping, births
    if None in mapping:
        return "competitor_missing", None, mapping, births
    if births:
        return "threatening_birth", None, mapping, births
    gaps = [e[mapping[0]][4] - e[j][4] for j in mapping[1:]]
    return ("stable", None, mapping, births) if min(gaps) > 0 else ("ranking_reversal", gaps.index(min(gaps)) + 1, mapping, births)


def drawn(seed, n=150):
    """Lists on a coarse raster with scores in tenths, so that ties and overlaps of all kinds occur."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        clean = [((x := rnd.randrange(0, 36, 4)), (y := rnd.randrange(0, 20, 5)), x + rnd.choice((8, 10)), y + 10, rnd.randrange(1, 10) / 10) for _ in range(rnd.randint(0, 5))]
        moved = [((x := b[0] + rnd.randint(-3, 3)), b[1], x + b[2] - b[0], b[3] + rnd.randint(0, 2), max(0.0, b[4] + rnd.randint(-2, 2) / 10)) for b in clean if rnd.random() < 0.93]
        born = [(60.0, 60.0, 70.0, 75.0, rnd.random())] * (rnd.random() < 0.2)
        out.append(([tuple(map(float, b)) for b in clean], [tuple(map(float, b)) for b in moved + born]))
    return out


def frame(spark, lists):
    shaped = lambda x: [(*b, "", o) for o, b in enumerate(x)]
    return spark.createDataFrame([(k, shaped(a), shaped(b)) for k, (a, b) in enumerate(lists)], COLUMNS)


CONTRACTS = [OutputContract(), OutputContract(3, 4, 0.5, 0.3, 0.4), OutputContract(2, 2, 0.8, 0.0, 0.0), OutputContract(4, 6, 0.6, 0.0, 0.9)]


@pytest.mark.parametrize("contract", CONTRACTS, ids=lambda c: c.setting_id())
def test_outcomes_against_the_rules(spark, contract):
    lists = drawn(11)
    classes = set()
    for r in evaluated(frame(spark, lists), contract).collect():
        want = judged(*lists[r["k"]], contract)
        o = r["outcome"]
        if want is None:
            assert (o, r["clean_eligible"], r["exposed"], r["ineligible_reason"]) == (None, 0, [], INELIGIBLE)
            continue
        assert (o["primary_failure"], o["culprit_clean_index"], o["mapping"], o["threatening_birth_indices"]) == want, r["k"]
        classes.add(want[0])
        e = thin(lists[r["k"]][1], contract.exposed_candidate_count, contract.duplicate_iou_threshold)
        assert o["matched_boxes"] == [None if j is None else list(e[j][:4]) for j in want[2]]
        assert o["matched_scores"] == [None if j is None else e[j][4] for j in want[2]]
        assert o["missing_clean_indices"] == [i for i, j in enumerate(want[2]) if j is None]
        assert o["perturbed_candidate_count"] == len(e) == len(r["exposed"])
        covered = want[0] in ("stable", "ranking_reversal")
        assert (o["coverage"], o["rank_stable"], o["operational_stable"]) == (int(covered), int(want[0] == "stable") if covered else None, int(want[0] == "stable"))
        assert (o["gaps"] is not None) == covered
    assert contract.match_iou_threshold == 0 or len(classes) == 5


def test_order_of_scores_is_all_that_counts(spark):
    lists = drawn(12, 60)
    bent = [([(*b[:4], b[4] ** 2 * 3 - 7) for b in a], [(*b[:4], b[4] ** 2 * 3 - 7) for b in p]) for a, p in lists]
    one, two = ({r["k"]: r["outcome"] and r["outcome"]["primary_failure"] for r in evaluated(frame(spark, x)).collect()} for x in (lists, bent))
    assert one == two


def test_long_lists_keep_all_gaps(spark):
    n = 1100
    row = [(20.0 * k, 0.0, 20.0 * k + 10, 10.0, 2000.0 - k) for k in range(n)]
    late = [(*b[:4], 3000.0 if k == n - 1 else b[4]) for k, b in enumerate(row)]
    r = evaluated(frame(spark, [(row, late)]), OutputContract(n, n, 0.7, 0.2, 0.7)).first()["outcome"]
    assert r["primary_failure"] == "ranking_reversal" and r["culprit_clean_index"] == n - 1 and len(r["gaps"]) == n - 1


def test_association_is_the_best_of_all_assignments():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, m = int(rng.integers(1, 6)), int(rng.integers(1, 6))
        x = np.round(rng.random((n, m)) * (rng.random((n, m)) > 0.4), 1)
        options = [p for p in itertools.permutations([*range(m), *[m] * max(0, n - m)], n)]
        want = min(options, key=lambda p: (-sum(round(x[i, j] * 1e9) for i, j in enumerate(p) if j < m), p))
        assert assign(x) == [j if j < m else -1 for j in want]


def test_association_of_many_takes_no_exponential_time():
    x = np.random.default_rng(1).random((40, 60))
    got = assign(x)
    assert len(set(got)) == 40 and sum(x[i, j] for i, j in enumerate(got)) > 0.95 * x.max(axis=1).sum()


def test_suppression_against_a_plain_loop(spark):
    lists = drawn(3)
    got = {r["k"]: [tuple(c)[:5] for c in r["t"]] for r in frame(spark, lists).select("k", geometry.spatially_distinct(F.col("clean_candidates"), 3, 0.4).alias("t")).collect()}
    assert got == {k: thin(a, 3, 0.4) for k, (a, _) in enumerate(lists)}


def test_grid_replay_equals_direct_evaluation(spark):
    lists = drawn(9, 40)
    df = frame(spark, lists).withColumnRenamed("k", "ref_id").withColumn("r", F.lit(0))
    factors = ([2, 4], [4, 5], [0.0, 0.25], [0.5, 0.7])
    rows = G.replay(df, *factors).collect()
    assert len(rows) == 16 * len(lists)
    got = {(r["ref_id"], r["setting_index"]): (r["kt"], r["ke"], r["match"], r["birth"], r["eligible"], r["stable"], r["failure"]) for r in rows}
    for at, s in enumerate(grid(*factors)):
        setting = (s.tracked_candidate_count, s.exposed_candidate_count, s.match_iou_threshold, s.birth_duplicate_iou_threshold)
        for k, (a, p) in enumerate(lists):
            want = judged(a, p, s)
            assert got[k, at] == (*setting, int(want is not None), int(want is not None and want[0] == "stable"), want and want[0])


def test_contract_rules(spark):
    assert len(grid(*GRID.values())) == 108
    assert OutputContract(2, 7, 0.5, 0.125, 1.0).setting_id() == "kt2_ke7_match0.12_birth1.00_dup0.50"
    for bad in ({"tracked_candidate_count": 1}, {"exposed_candidate_count": 4}, {"match_iou_threshold": 1.5}):
        with pytest.raises(ValueError):
            OutputContract(**bad)
    with pytest.raises(TypeError):
        OutputContract.of({"output_contract": {"unknown": 1}})
    from ordinex.operators.contract import grid_frame

    assert [r["setting_id"] for r in grid_frame(spark, grid([2], [3, 4], [0.1], [0.5])).collect()] == ["kt2_ke3_match0.10_birth0.50_dup0.70", "kt2_ke4_match0.10_birth0.50_dup0.70"]


def wire(x):
    return [{"box": list(b[:4]), "score": b[4], "label": None} for b in x]


def test_command_reads_and_writes_json_lines(spark, tmp_path):
    lists = [x for x in drawn(21, 30)]
    p = tmp_path / "pairs.jsonl"
    p.write_text("\n\n".join(json.dumps({"id": f"p{k}", "clean_candidates": wire(a), "perturbed_candidates": wire(b)}) for k, (a, b) in enumerate(lists)) + "\n")
    assert read_pairs(spark, str(p)).count() == 30
    main([str(p), str(tmp_path / "deep" / "out")])
    rows = {r["id"]: r for f in (tmp_path / "deep" / "out").glob("part-*") for r in map(json.loads, f.read_text().splitlines())}
    assert len(rows) == 30
    for k, (a, b) in enumerate(lists):
        r, want = rows[f"p{k}"], judged(a, b, OutputContract())
        assert set(r) == {"id", "clean_eligible", "tracked_clean_candidates", "exposed_perturbed_candidates", "outcome", "ineligible_reason"}
        assert (r["outcome"] and r["outcome"]["primary_failure"]) == (want and want[0])
        assert r["ineligible_reason"] == (None if want else INELIGIBLE)
        if want is None:
            assert r["exposed_perturbed_candidates"] == []


@pytest.mark.parametrize(
    ("candidate", "message"),
    [
        ({"box": [3.0, 4.0, 3.0, 9.0], "score": 0.1, "label": ""}, "positive width"),
        ({"box": [3.0, 4.0, 5.0], "score": 0.1, "label": ""}, "four coordinates"),
        ({"box": [3.0, 4.0, 5.0, 6.0, 7.0], "score": 0.1, "label": ""}, "four coordinates"),
        ({"box": None, "score": 0.1, "label": ""}, "four coordinates"),
        ({"box": [3.0, 4.0, 5.0, 6.0], "score": None, "label": ""}, "score"),
    ],
)
def test_bad_candidates_are_errors(spark, candidate, message):
    df = spark.createDataFrame([("x", wire([(0.0, 0.0, 1.0, 1.0, 0.5)]), [candidate])], PAIR)
    with pytest.raises(Exception, match=message):
        evaluate(df).collect()


def test_a_missing_list_is_an_error(spark):
    df = spark.createDataFrame([("x", None, [])], PAIR)
    with pytest.raises(Exception, match="missing"):
        evaluate(df).collect()


def test_model_output_is_clipped_and_cut(spark):
    rnd = random.Random(4)
    lists = [[(rnd.uniform(-9, 30), rnd.uniform(-9, 30), rnd.uniform(-9, 40), rnd.uniform(-9, 40), rnd.random(), rnd.choice([None, "", "own"]), o) for o in range(8)] for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(lists)), f"k int, c array<{geometry.CANDIDATE}>")
    for r in df.select("k", geometry.clipped(F.col("c"), F.lit(25.0), F.lit(20.0), F.lit("asked"), 3).alias("c")).collect():
        inside = [(min(max(a, 0.0), 25.0), min(max(b, 0.0), 20.0), min(max(c, 0.0), 25.0), min(max(d, 0.0), 20.0), s, x or "asked") for a, b, c, d, s, x, _ in lists[r["k"]]]
        want = sorted([x for x in inside if x[2] > x[0] and x[3] > x[1]], key=lambda x: -x[4])[:3]
        assert [tuple(c)[:6] for c in r["c"]] == want


def test_boxes_from_corners_and_sizes(spark):
    row = lambda *x: spark.createDataFrame([x], "x double, y double, w double, h double").select(geometry.xywh_to_xyxy(*map(F.col, "xywh")).alias("b")).first()["b"]
    assert row(2.0, 3.0, 4.0, 5.0) == [2, 3, 6, 8]
    assert row(2.0, 3.0, 0.0, 5.0) is None and row(2.0, 3.0, 4.0, -1.0) is None and row(None, 3.0, 4.0, 5.0) is None
    boxes = [(0.0, 0.0, 10.0, 10.0), (-0.0005, 0.0, 10.0005, 10.0), (-0.1, 0.0, 10.0, 10.0), (0.0, 0.0, 11.0, 10.0), (5.0, 5.0, 5.0, 6.0)]
    df = spark.createDataFrame([(k, (*b, 1.0, "", 0)) for k, b in enumerate(boxes)], f"k int, b {geometry.CANDIDATE}")
    assert [r["v"] for r in df.orderBy("k").select(geometry.within_image(F.col("b"), F.lit(10.0), F.lit(10.0)).alias("v")).collect()] == [True, True, False, False, False]


def test_same_prefix(spark):
    base = [(0.0, 0.0, 10.0, 10.0, 0.5), (20.0, 0.0, 30.0, 10.0, 0.4)]
    near, far, short = [(*base[0][:4], 0.5005), base[1]], [base[0], (20.5, 0.0, 30.5, 10.0, 0.4)], base[:1]
    df = frame(spark, [(base, x) for x in (base, near, far, short)])
    assert [r["s"] for r in df.orderBy("k").select(geometry.same_prefix(F.col("clean_candidates"), F.col("perturbed_candidates")).alias("s")).collect()] == [True, True, False, False]
