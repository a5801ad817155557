"""URL filters: rules by host and path, and gradient-boosted trees on lexical features.

Rules judge the urls they fit, and those urls with the rules' verdicts are the labelled
urls that the trees learn from: length, depth, digit ratio, entropy, counts of
parameters, and statistics of the host's suffix (its last label) over all labelled
urls. A labelled url's own statistics are those of the other folds of urls, so the trees
don't read its label; equal urls are in one fold. Trees are fitted on a bounded sample of
labelled urls, chosen by hash (``sample`` rows, a parameter), of which numbers alone go to
the driver; suffix statistics are taken from all of them; every url is judged where
it lies.

Defined results: a null url or one without ``://`` has empty host and path and fits no
rule; ties of rules of equal length go to the alphabetically first; repeated rows are
judged alike; without labelled urls, or with one kind only, the trees are a constant
("allow" where there is none); an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, small

#: Verdict, host, path.
Rule = tuple[str, str, str]
SAMPLE, TREES, DEPTH, RATE, BINS, LEAST = 20_000, 60, 3, 0.2, 64, 20
#: Pseudo-counts of the suffix statistics.
SMOOTH = 2.0
#: Folds of urls.
FOLDS = 5


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path, without a verdict) and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last that fits wins: shortest first.
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))[::-1]:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


FEATURES = ("length", "host_length", "path_length", "depth", "host_depth", "digit_ratio", "entropy", "parameters", "has_fragment", "suffix_rate", "suffix_log_count")


def lexical(url: str, host: str, path: str) -> list[float]:
    """The features that need the url alone."""
    n = len(url)
    counts = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    query = url.partition("#")[0].partition("?")[2]
    return [
        float(n),
        float(len(host)),
        float(len(path)),
        float(sum(1 for x in path.split("/") if x)),
        float(host.count(".")),
        sum(c.isdigit() for c in url) / n if n else 0.0,
        entropy,
        float(sum(1 for x in query.split("&") if x)),
        float("#" in url),
    ]


@dataclass
class Trees:
    """Boosted regression trees of equal depth: heaps of (feature, threshold), and leaf values."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def decision(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > t[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosting with logistic loss; splits by Newton gain at quantiles of each feature."""
    n, d = x.shape if len(x) else (0, len(FEATURES))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    empty = Trees(-1.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if n == 0 or y.min() == y.max():
        empty.start = 1.0 if n and y[0] == 1 else -1.0
        return empty
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(d)]
    binned = np.stack([np.searchsorted(cuts[k], x[:, k], side="left") for k in range(d)], axis=1)
    p0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(p0 / (1 - p0)))
    score = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-9
        f_, t_ = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf)
            if len(rows) >= 2 * LEAST:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for k in range(d):
                    size = len(cuts[k]) + 1
                    bg, bh, bn = (np.bincount(binned[rows, k], w, size).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    ok = (bn >= LEAST) & (len(rows) - bn >= LEAST)
                    if not ok.any():
                        continue
                    gain = np.where(ok, bg**2 / (bh + 1) + (total_g - bg) ** 2 / (total_h - bh + 1) - total_g**2 / (total_h + 1), -1)
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], k, cuts[k][j])
            f_[node], t_[node] = best[1], best[2]
            at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        leaf = at - inner
        v = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        score += v[leaf]
        features.append(f_)
        thresholds.append(t_)
        values.append(v)
    return Trees(start, np.array(features), np.array(thresholds), np.array(values))


def _features(pages: DataFrame, rules: list[Rule], id_col: str, url_col: str) -> DataFrame:
    """Of every url: ``page_id, host, path, rule, ruled, suffix, fold, o`` (its place in the draw) and the features of the url alone, written."""
    a = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    a = a.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)).cast("int")
    a = a.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), suffix_of(F.col("host")).alias("suffix"), fold.alias("fold"), F.xxhash64("page_id", "url").alias("o"), "url")
    kind = a.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [lexical(u or "", h, p) for u, h, p in zip(*(b.column(k).to_pylist() for k in ("url", "host", "path")))]
            yield pa.RecordBatch.from_arrays([*b.columns[:8], pa.array(x, pa.list_(pa.float64()))], names=[*b.schema.names[:8], "x"])

    return materialize(a.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, ruled string, suffix string, fold int, o long, x array<double>"), "url-features")


def _with_suffixes(features: DataFrame, learnt: DataFrame) -> tuple[DataFrame, float]:
    """``features`` with ``rate`` and ``n`` of their suffix over the labelled urls ``learnt``, and the share of blocked ones. Urls with a
    label have those of the other folds. Suffixes are aggregated, and joined without moving urls where they are few."""
    blocked = (F.col("ruled") == "block").cast("long")
    overall = learnt.agg(F.avg(blocked.cast("double"))).first()[0] or 0.0
    each = learnt.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(blocked).alias("b"))
    own = each.groupBy("suffix").agg(F.sum("n").alias("s_n"), F.sum("b").alias("s_b"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "b")))).alias("folds"))
    own = small(materialize(own.withColumnRenamed("suffix", "of"), "url-suffixes"))
    j = features.join(own, F.col("suffix") == F.col("of"), "left")
    fold = F.when(F.col("rule").isNotNull(), F.element_at("folds", F.col("fold")))
    left = lambda total, part: (F.coalesce(F.col(total), F.lit(0)) - F.coalesce(fold[part], F.lit(0))).cast("double")
    n, b = left("s_n", "n"), left("s_b", "b")
    return j.select(*features.columns, ((b + SMOOTH * overall) / (n + SMOOTH)).alias("rate"), F.log1p(n).alias("n")), overall


def _drawn(labelled: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the first ``sample`` rows by hash: numbers alone."""
    rows = labelled.select(F.concat("x", F.array("rate", "n")).alias("x"), (F.col("ruled") == "block").cast("double").alias("y"), "o").orderBy("o", "x").limit(sample).collect()
    return np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows])


def judge(pages: DataFrame, rules: list[Rule], sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, blocked_score`` of every url."""
    features = _features(pages, rules, id_col, url_col)
    b, _ = _with_suffixes(features, features.filter(F.col("rule").isNotNull()))
    trees = fit_trees(*_drawn(b.filter(F.col("rule").isNotNull()), sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            page, host, path, rule, ruled, x, rate, n = r.columns
            own = np.array(x.to_pylist()).reshape(-1, len(FEATURES) - 2)
            s = trees.decision(np.column_stack([own, rate.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False)]))
            verdict = [v if v is not None else ("block" if k >= 0 else "allow") for v, k in zip(ruled.to_pylist(), s)]
            yield pa.RecordBatch.from_arrays([page, host, path, rule, pa.array(verdict, pa.string()), pa.array(1 / (1 + np.exp(-s)))], names=["page_id", "host", "path", "rule", "verdict", "blocked_score"])

    kind = features.schema["page_id"].dataType.simpleString()
    return b.select("page_id", "host", "path", "rule", "ruled", "x", "rate", "n").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, blocked_score double")


def held_out_accuracy(pages: DataFrame, rules: list[Rule], sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> tuple[float, float]:
    """How often the trees find the label of urls of a fold that neither they nor the suffix statistics have seen, and how often the
    commoner label is right there. For reports: the fold's numbers, ``sample`` rows at most, go to the driver."""
    features = _features(pages, rules, id_col, url_col)
    labelled = F.col("rule").isNotNull()
    seen = features.filter(labelled & (F.col("fold") != 0))
    b, _ = _with_suffixes(features, seen)
    trees = fit_trees(*_drawn(b.filter(labelled & (F.col("fold") != 0)), sample))
    x, y = _drawn(b.filter(labelled & (F.col("fold") == 0)), sample)
    return float(((trees.decision(x) >= 0) == y).mean()), float(max(y.mean(), 1 - y.mean()))
