"""Boxes, ranked candidate lists and their scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CANDIDATE = "struct<x1:double,y1:double,x2:double,y2:double,score:double,label:string,ord:int>"


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def ranked(candidates: Column) -> Column:
    """By score, highest first; equal scores keep their order (``ord``)."""
    keyed = F.array_sort(F.transform(candidates, lambda c: F.struct((-c["score"]).alias("k"), c["ord"].alias("o"), c.alias("c"))))
    return F.transform(keyed, lambda x: x["c"])


def top_k(candidates: Column, k: int) -> Column:
    return F.slice(ranked(candidates), 1, k)


def spatially_distinct(candidates: Column, maximum: Column | int, threshold: Column | float) -> Column:
    """Greedy suppression: a candidate stays if its IoU with all kept ones is below
    ``threshold``, until ``maximum`` are kept."""
    most = maximum if isinstance(maximum, Column) else F.lit(maximum)
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.aggregate(
        ranked(candidates),
        F.array().cast(f"array<{CANDIDATE}>"),
        lambda kept, c: F.when((F.size(kept) < most) & F.forall(kept, lambda k: iou(k, c) < limit), F.concat(kept, F.array(c))).otherwise(kept),
    )


def top1(candidates: Column, truths: Column, threshold: float = 0.5) -> tuple[Column, Column]:
    """(flag, best IoU) of the first highest-scored candidate against true boxes; (0, 0.0) for an empty list."""
    key = F.array_min(F.transform(candidates, lambda c: F.struct((-c["score"]).alias("k"), c["ord"].alias("o"), c.alias("c"))))
    # Bound to a name: an expression that names the first candidate would else find it anew for each name.
    best = F.get(F.transform(F.array(key), lambda x: F.array_max(F.transform(truths, lambda t: iou(x["c"], t)))), 0)
    best = F.when(F.size(candidates) > 0, F.coalesce(best, F.lit(0.0))).otherwise(F.lit(0.0))
    return (best >= threshold).cast("int"), best


def valid(c: Column) -> Column:
    return (c["x2"] > c["x1"]) & (c["y2"] > c["y1"])


def validated(candidates: Column) -> Column:
    """The list, or an error that names the first degenerate box."""
    bad = F.filter(candidates, lambda c: ~F.coalesce(valid(c), F.lit(False)))
    message = F.concat(F.lit("candidate boxes must have positive width and height: "), F.to_json(F.get(bad, 0)))
    return F.when(F.size(bad) == 0, candidates).otherwise(F.raise_error(message).cast(f"array<{CANDIDATE}>"))


def from_wire(candidates: Column) -> Column:
    """Wire form (box array, score, label) to the columnar form; the label may be missing. A list that is
    missing, a box without exactly four coordinates and a missing score are errors."""
    checked = F.transform(
        candidates,
        lambda c, i: F.when(F.coalesce(F.size(c["box"]), F.lit(-1)) != 4, F.raise_error(F.lit("candidate boxes must have four coordinates")).cast(CANDIDATE))
        .when(c["score"].isNull(), F.raise_error(F.lit("candidates must have a score")).cast(CANDIDATE))
        .otherwise(F.struct(*[F.get(c["box"], k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], c["score"].alias("score"), F.coalesce(c["label"], F.lit("")).alias("label"), i.cast("int").alias("ord"))),
    )
    return F.when(candidates.isNull(), F.raise_error(F.lit("a candidate list is missing")).cast(f"array<{CANDIDATE}>")).otherwise(checked)


def to_wire(candidates: Column) -> Column:
    return F.transform(candidates, lambda c: F.struct(F.array(c["x1"], c["y1"], c["x2"], c["y2"]).alias("box"), c["score"].alias("score"), c["label"].alias("label")))


def clipped(candidates: Column, width: Column, height: Column, query: Column, k: int) -> Column:
    """Model output made a candidate list: clipped to the image, degenerate boxes gone, empty labels as the query, the top ``k``."""
    zero = F.lit(0.0)
    inside = F.transform(
        candidates,
        lambda c: F.struct(
            F.greatest(zero, F.least(c["x1"], width)).alias("x1"),
            F.greatest(zero, F.least(c["y1"], height)).alias("y1"),
            F.greatest(zero, F.least(c["x2"], width)).alias("x2"),
            F.greatest(zero, F.least(c["y2"], height)).alias("y2"),
            c["score"].alias("score"),
            F.when(F.coalesce(c["label"], F.lit("")) == "", query).otherwise(c["label"]).alias("label"),
            c["ord"].alias("ord"),
        ),
    )
    return top_k(F.filter(inside, valid), k)


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corners of a box given by a corner and its size; null where a value is missing or the size isn't positive."""
    return F.when((w > 0) & (h > 0) & x.isNotNull() & y.isNotNull(), F.array(x, y, x + w, y + h))


def within_image(b: Column, width: Column, height: Column, slack: float = 1e-3) -> Column:
    return valid(b) & (b["x1"] >= -slack) & (b["y1"] >= -slack) & (b["x2"] <= width + slack) & (b["y2"] <= height + slack)


def same_prefix(a: Column, b: Column, score_slack: float = 1e-3, least_iou: float = 0.999) -> Column:
    """Equal length, and each position with nearly the score and the box."""
    close = F.zip_with(a, b, lambda x, y: (F.abs(x["score"] - y["score"]) <= score_slack) & (iou(x, y) >= least_iou))
    return (F.size(a) == F.size(b)) & F.forall(close, lambda x: F.coalesce(x, F.lit(False)))
