"""Candidate and probe tables derived from the star schema by integer arithmetic, for Spark and for SQL.

A candidate is a line of an order; a sample is an order under one of three models; a
probe outcome is a line as its numbers say. Lines repeat, so ties are broken by all
columns in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import CANDIDATE
from ..functions.scalars import PROBE_LAW

TIE = ["l_extendedprice desc", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return a.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_extendedprice").cast("double").alias("price"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ref_id, x1..y2, score, ord``: the clean candidates."""
    w = W.partitionBy("l_orderkey").orderBy(F.desc("price"), "l_partkey", "l_suppkey", "l_linenumber", "q")
    x, y = (F.col("l_partkey") % 7) * 12, (F.col("l_suppkey") % 5) * 12
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("ref_id"),
        x.cast("double").alias("x1"),
        y.cast("double").alias("y1"),
        (x + 10 + F.col("q") % 8).cast("double").alias("x2"),
        (y + 10 + F.col("l_linenumber") % 5).cast("double").alias("y2"),
        (F.col("price") / 110000.0).alias("score"),
        (F.row_number().over(w) - 1).cast("int").alias("ord"),
    )


BOXES_SQL = """bx AS (
  SELECT l_orderkey AS ref_id, ((l_partkey % 7) * 12)::DOUBLE AS x1, ((l_suppkey % 5) * 12)::DOUBLE AS y1,
         ((l_partkey % 7) * 12 + 10 + l_quantity::INT % 8)::DOUBLE AS x2, ((l_suppkey % 5) * 12 + 10 + l_linenumber % 5)::DOUBLE AS y2,
         l_extendedprice::DOUBLE / 110000.0 AS score,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity::INT) - 1 AS ord
  FROM lineitem)"""


def candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ref_id, clean_candidates``: one list for each order."""
    s = F.struct("x1", "y1", "x2", "y2", "score", F.lit("").alias("label"), "ord")
    return boxes(spark, sf_dir).groupBy("ref_id").agg(F.collect_list(s).alias("clean_candidates"))


def probe_pairs(spark: SparkSession, sf_dir: str, probes: int = 2, models: int = 1) -> DataFrame:
    """``model, ref_id, r, weight, clean_candidates, perturbed_candidates``: each order with jittered copies of its list, other ones for each model,
    and a probe's share of its sample. Lists are made once, then jittered where they lie."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lists = candidate_lists(spark, sf_dir).withColumn("r", each(probes)).withColumn("model", each(models))
    rr = F.col("r") + 100 * F.col("model")

    def moved(c: Column) -> Column:
        k = c["ord"] + F.col("ref_id")
        dx, dy = (k * 31 + rr * 17) % 5 - 2, (k * 13 + rr * 11) % 5 - 2
        score = c["score"] + ((k * 13 + rr * 29) % 11 - 5) / 50.0
        return F.struct((c["x1"] + dx).alias("x1"), (c["y1"] + dy).alias("y1"), (c["x2"] + dx).alias("x2"), (c["y2"] + dy).alias("y2"), score.alias("score"), F.lit("").alias("label"), c["ord"].alias("ord"))

    jittered = F.transform(F.filter("clean_candidates", lambda c: (c["ord"] + F.col("ref_id") + rr * 7) % 19 != 0), moved)
    birth = F.struct(*[F.lit(v).alias(n) for v, n in ((200.0, "x1"), (200.0, "y1"), (215.0, "x2"), (215.0, "y2"), (2.0, "score"), ("", "label"), (1000, "ord"))])
    births = F.when((F.col("ref_id") + rr) % 23 == 0, F.array(birth)).otherwise(F.array().cast(f"array<{CANDIDATE}>"))
    return lists.select("model", "ref_id", "r", F.lit(1.0 / probes).alias("weight"), "clean_candidates", F.concat(jittered, births).alias("perturbed_candidates"))


def replay_sql(probes: int, models: int, tracked: int, exposed: int, duplicate: float = 0.7) -> str:
    """The CTEs of suppression in SQL: ``tr`` (ref_id, i, box, score) of the clean lists, ``ex`` (model, ref_id, r, j, box, score) of the
    perturbed ones, ``pb`` (model, ref_id, r, nt, ne) of all probes, and ``v`` (.., i, j, iou). For ``WITH RECURSIVE``."""
    i = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
    s = "(a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)"

    def kept(source: str, key: str, most: int, name: str) -> str:
        on = " AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))
        a_key = ", ".join(f"a.{k}" for k in key.split(", "))
        return f"""{name}o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, ord) - 1 AS pos FROM {source}),
{name}h AS (SELECT {a_key}, b.pos, list(a.pos) AS against FROM {name}o a JOIN {name}o b ON {on} AND a.pos < b.pos WHERE {i} / ({s} - {i}) >= {duplicate} GROUP BY ALL),
{name}s AS (SELECT a.*, coalesce(b.against, []) AS against FROM {name}o a LEFT JOIN {name}h b ON {on} AND a.pos = b.pos),
{name}k AS (SELECT {key}, 0::BIGINT AS pos, [0::BIGINT] AS held FROM {name}s WHERE pos = 0
  UNION ALL SELECT {a_key}, b.pos, CASE WHEN len(held) < {most} AND NOT list_has_any(held, b.against) THEN list_append(held, b.pos) ELSE held END FROM {name}k a JOIN {name}s b ON {on} AND b.pos = a.pos + 1),
{name}f AS (SELECT {key}, unnest(held) AS pos, generate_subscripts(held, 1) - 1 AS place FROM (SELECT {key}, arg_max(held, pos) AS held FROM {name}k GROUP BY ALL)),
{name} AS (SELECT {a_key}, b.place, x1, y1, x2, y2, score FROM {name}o a JOIN {name}f b ON {on} AND a.pos = b.pos)"""

    jitter = "SELECT model, ref_id, r, ord, x1 + dx AS x1, y1 + dy AS y1, x2 + dx AS x2, y2 + dy AS y2, score + ((k * 13 + rr * 29) % 11 - 5) / 50.0::DOUBLE AS score FROM jt WHERE (k + rr * 7) % 19 <> 0"
    birth = "SELECT DISTINCT model, ref_id, r, 1000, 200.0, 200.0, 215.0, 215.0, 2.0 FROM jt WHERE (ref_id + rr) % 23 = 0"
    return f"""{BOXES_SQL}, j0 AS (SELECT *, ord + ref_id AS k, r + 100 * model AS rr FROM bx, range({probes}) p(r), range({models}) m(model)),
jt AS (SELECT *, (k * 31 + rr * 17) % 5 - 2 AS dx, (k * 13 + rr * 11) % 5 - 2 AS dy FROM j0), pt AS ({jitter} UNION ALL {birth}),
{kept("bx", "ref_id", tracked, "tr")}, {kept("pt", "model, ref_id, r", exposed, "ex")},
pb AS (SELECT p.*, nt, coalesce(ne, 0) AS ne FROM (SELECT DISTINCT model, ref_id, r FROM jt) p JOIN (SELECT ref_id, count(*) AS nt FROM tr GROUP BY ALL) t ON p.ref_id = t.ref_id
  LEFT JOIN (SELECT model, ref_id, r, count(*) AS ne FROM ex GROUP BY ALL) e ON p.model = e.model AND p.ref_id = e.ref_id AND p.r = e.r),
v AS (SELECT b.model, b.ref_id, b.r, a.place AS i, b.place AS j, {i} / ({s} - {i}) AS iou FROM tr a JOIN ex b ON a.ref_id = b.ref_id)"""


def outcomes_sql(lengths: str, match: list[float], birth: list[float]) -> str:
    """The CTEs behind :func:`replay_sql`: ``lt`` (model, ref_id, r, t, e): lengths of lists to associate, as ``lengths`` selects them from ``pb``;
    ``oc``: each one's outcome at each match and birth threshold. Association: sets of columns are states, a step for each row."""
    steps = ["s0 AS (SELECT model, ref_id, r, t, e, 0 AS mask, 0::HUGEINT AS total, []::BIGINT[] AS map FROM lt)"]
    for i in range(5):
        steps.append(f"""s{i + 1} AS (SELECT model, ref_id, r, t, e, mask, -(best.total) AS total, best.map AS map FROM (
  SELECT model, ref_id, r, t, e, mask, min({{'total': -total, 'map': map}}) AS best FROM (
    SELECT s.model, s.ref_id, s.r, t, e, mask | (1 << v.j) AS mask, total + round(iou * 1e9)::HUGEINT AS total, list_append(map, v.j) AS map FROM s{i} s
      JOIN v ON s.model = v.model AND s.ref_id = v.ref_id AND s.r = v.r AND v.i = {i} AND v.j < e AND mask & (1 << v.j) = 0 WHERE t > {i}
    UNION ALL SELECT model, ref_id, r, t, e, mask, total, CASE WHEN t > {i} THEN list_append(map, 1000) ELSE map END FROM s{i}) GROUP BY ALL))""")
    m, b = (", ".join(f"({x}::DOUBLE)" for x in xs) for xs in (match, birth))
    p = "model, ref_id, r, t, e"
    on = lambda x, y, c=("model", "ref_id", "r", "t", "e"): " AND ".join(f"{x}.{k} = {y}.{k}" for k in c)
    probe = ("model", "ref_id", "r")
    i = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
    s = "(a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)"
    return f"""lt AS ({lengths}), {", ".join(steps)},
an AS (SELECT {p}, min({{'total': -total, 'map': map}}).map AS map FROM s5 WHERE bit_count(mask) = least(t, e) GROUP BY ALL),
pl AS (SELECT {p}, unnest(map) AS j, generate_subscripts(map, 1) - 1 AS i FROM an),
mp AS (SELECT pl.model, pl.ref_id, pl.r, t, e, pl.i, v.j, iou, ex.score FROM pl LEFT JOIN v ON {on("pl", "v", probe)} AND pl.i = v.i AND pl.j = v.j LEFT JOIN ex ON {on("pl", "ex", probe)} AND pl.j = ex.place),
mm AS (SELECT {p}, match, i, CASE WHEN iou >= match THEN j END AS j, CASE WHEN iou >= match THEN score END AS score FROM mp, (VALUES {m}) m(match)),
ws AS (SELECT {p}, match, count(*) FILTER (WHERE j IS NULL) AS missing, max(score) FILTER (WHERE i = 0) AS winner, max(j) FILTER (WHERE i = 0) AS wj,
  min(CASE WHEN i > 0 THEN score END) AS least_other, list(j) FILTER (WHERE j IS NOT NULL) AS used, list(score ORDER BY i) AS scores FROM mm GROUP BY ALL),
ee AS (SELECT a.model, a.ref_id, a.r, a.place AS j, b.place AS q, {i} / ({s} - {i}) AS iou FROM ex a JOIN ex b ON a.model = b.model AND a.ref_id = b.ref_id AND a.r = b.r AND a.place <> b.place),
cd AS (SELECT w.model, w.ref_id, w.r, w.t, w.e, match, ex.place AS q, max(ee.iou) AS near FROM ws w JOIN ex ON {on("w", "ex", probe)} AND ex.place < w.e AND ex.score >= w.winner AND NOT list_contains(used, ex.place)
  JOIN ee ON {on("ee", "ex", probe)} AND ee.q = ex.place AND list_contains(used, ee.j) WHERE wj IS NOT NULL GROUP BY ALL),
bt AS (SELECT {p}, match, birth, count(*) AS births FROM cd, (VALUES {b}) b(birth) WHERE near < birth GROUP BY ALL),
oc AS (SELECT *, CASE WHEN missing = 0 AND births = 0 AND culprit IS NULL THEN 'stable' WHEN wj IS NULL THEN 'winner_missing' WHEN missing > 0 THEN 'competitor_missing'
    WHEN births > 0 THEN 'threatening_birth' ELSE 'ranking_reversal' END AS failure, (missing = 0 AND births = 0)::INT AS coverage FROM (
  SELECT w.model, w.ref_id, w.r, w.t, w.e, w.match, b.birth, w.missing, w.wj, coalesce(x.births, 0) AS births,
    CASE WHEN w.missing = 0 AND coalesce(x.births, 0) = 0 AND winner - list_max(scores[2:]) <= 0 THEN list_position(list_transform(scores[2:], lambda z: winner - z), winner - list_max(scores[2:])) END AS culprit
  FROM ws w CROSS JOIN (VALUES {b}) b(birth) LEFT JOIN bt x ON {on("w", "x")} AND w.match = x.match AND b.birth = x.birth))"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe fact table: ``model, ref_id, split, ord, family, severity, coverage, rank_stable, stable, failure, culprit, quality, eligible, correct``."""
    a = lines(spark, sf_dir)
    code = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber") * 31 + F.col("q")) % 100
    f = F.col("l_linenumber") % 5
    unit = ((F.col("l_orderkey") * 7 + F.col("l_partkey") * 13) % 101) / 100.0
    pick = lambda k: F.get(F.array(*[F.lit(p[k]) for p in PROBE_LAW]), f.cast("int"))
    eligible = (F.col("l_orderkey") + F.col("l_suppkey") % 3) % 13 != 0
    failure = F.when(code < 60, "stable").when(code < 70, "winner_missing").when(code < 80, "competitor_missing").when(code < 88, "threatening_birth").otherwise("ranking_reversal")
    covered = ((code < 60) | (code >= 88)).cast("int")
    a = a.select(
        (F.col("l_suppkey") % 3).cast("int").alias("model"),
        F.col("l_orderkey").alias("ref_id"),
        F.when(F.col("l_linenumber") % 3 == 0, "diagnostic").otherwise("reference").alias("split"),
        pick(0).alias("family"),
        (pick(2) + (pick(3) - pick(2)) * unit).alias("severity"),
        covered.alias("coverage"),
        F.when(covered == 1, (code < 60).cast("int")).alias("rank_stable"),
        (code < 60).cast("int").alias("stable"),
        failure.alias("failure"),
        F.when(code >= 88, (1 + code % 4).cast("int")).alias("culprit"),
        ((F.col("l_partkey") % 50 + 50) / 100.0).alias("quality"),
        eligible.cast("int").alias("eligible"),
        (F.col("l_orderkey") % 4 != 0).cast("int").alias("correct"),
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "q",
        "price",
    )
    w = W.partitionBy("model", "ref_id", "split").orderBy("l_partkey", "l_suppkey", "l_linenumber", "q", "price")
    return a.withColumn("ord", F.row_number().over(w) - 1)




def _law(k: int) -> str:
    kind = "" if k == 0 else "::DOUBLE"
    return "CASE l_linenumber % 5 " + " ".join(f"WHEN {i} THEN {p[k]!r}{kind}" for i, p in enumerate(PROBE_LAW)) + " END"


FACTS_SQL = f"""f0 AS (
  SELECT *, (l_partkey * 7 + l_suppkey * 13 + l_linenumber * 31 + l_quantity::INT) % 100 AS code,
         {_law(2)} AS lo, {_law(3)} AS hi FROM lineitem
), f AS (
  SELECT (l_suppkey % 3)::INT AS model, l_orderkey AS ref_id,
         CASE WHEN l_linenumber % 3 = 0 THEN 'diagnostic' ELSE 'reference' END AS split,
         {_law(0)} AS family, lo + (hi - lo) * (((l_orderkey * 7 + l_partkey * 13) % 101) / 100.0::DOUBLE) AS severity,
         (code < 60 OR code >= 88)::INT AS coverage, CASE WHEN code < 60 OR code >= 88 THEN (code < 60)::INT END AS rank_stable,
         (code < 60)::INT AS stable,
         CASE WHEN code < 60 THEN 'stable' WHEN code < 70 THEN 'winner_missing' WHEN code < 80 THEN 'competitor_missing'
              WHEN code < 88 THEN 'threatening_birth' ELSE 'ranking_reversal' END AS failure,
         CASE WHEN code >= 88 THEN (1 + code % 4)::INT END AS culprit, (l_partkey % 50 + 50) / 100.0::DOUBLE AS quality,
         ((l_orderkey + l_suppkey % 3) % 13 <> 0)::INT AS eligible, (l_orderkey % 4 <> 0)::INT AS correct,
         row_number() OVER (PARTITION BY l_suppkey % 3, l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN 'diagnostic' ELSE 'reference' END
                            ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity::INT, l_extendedprice::DOUBLE) - 1 AS ord
  FROM f0)"""
