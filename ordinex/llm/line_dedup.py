"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only.

A *run* is a Parquet table ``(h1, h2, n_docs, keeper)`` with one row for each line
key of a batch, hash-partitioned and sorted by the 128-bit key hash. A new batch is
merge-anti-joined with all runs: a key that no run has is *fresh*, and its row names
the batch's largest document id as its keeper; a key already known only adds its
count. The batch then becomes a run of level 0. When a level holds ``fanout`` runs,
they are merged into one run of the next level, so a key is rewritten a
logarithmic number of times. As batches arrive in descending order of document
ids, the keeper of a fresh key is the largest id that holds it.

Defined results: a null or empty text is one empty line; a null id ranks below all
ids and counts as one id; rows that repeat an id count as one document towards
``min_docs``, and all rows of the keeping id keep their lines; ids may be of any type
that has an order; an empty table gives an empty result; columns other than id and
text are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, lower_ascii, materialize, texts, wide_hash

KEY = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _hashed(line: Column, min_chars: int) -> Column:
    """Struct of the key's hash; null for keys that are too short to count."""
    key = F.btrim(line, F.lit(SPACES))
    h1, h2 = wide_hash(lower_ascii(key))
    return F.when(F.length(key) >= min_chars, F.struct(h1.alias("h1"), h2.alias("h2")))


class LineRuns:
    """The levelled store of sorted runs."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.fanout, self.levels = spark, fanout, []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(materialize(run.sortWithinPartitions(*KEY), f"line-run-l{level}"))
        if len(self.levels[level]) == self.fanout:
            merged, self.levels[level] = self._merged(self.levels[level]), []
            self._put(merged, level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``(doc_id, h1, h2)``, one row for each document and key.
        No id of a later batch may be larger than one of an earlier batch."""
        own = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top"))
        if self.runs():
            # Only keys are asked for: a key may stand in several runs, and an anti join doesn't mind.
            known = reduce(DataFrame.unionByName, [r.select(*KEY) for r in self.runs()])
            fresh = own.join(known, KEY, "left_anti").select(*KEY, "n_docs", F.col("top").alias("keeper"))
            again = own.join(known, KEY, "left_semi").select(*KEY, "n_docs", F.lit(None).cast(own.schema["top"].dataType).alias("keeper"))
            own = fresh.unionByName(again)
        else:
            own = own.withColumnRenamed("top", "keeper")
        self._put(own, 0)

    def totals(self) -> DataFrame | None:
        return self._merged(self.runs()) if self.runs() else None


def _edges(lines: DataFrame, batches: int) -> set:
    """Ids that cut ``lines`` into about equal ranges; of ids that aren't numbers, one drawn by hash cuts them."""
    if batches < 2:
        return set()
    kind = lines.schema["doc_id"].dataType
    if isinstance(kind, T.NumericType):
        cuts = lines.select(F.percentile_approx(F.col("doc_id"), [i / batches for i in range(1, batches)], 1000)).first()[0]
        return set(cuts or [])
    # Any cuts do: batches only have to descend.
    return {lines.select(F.min_by("doc_id", F.xxhash64("doc_id"))).first()[0]} - {None}


#: Beyond so many keys to drop from a text, they are looked up in as many parts.
PARTS = 64


def _without(lines: Column, drops: Column, min_chars: int) -> Column:
    """The lines whose key is none of ``drops``. Many drops are dealt to parts by their hash, so a line meets a few of them."""
    some = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(drops, _hashed(x, min_chars)), F.lit(False)))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.filter(drops, lambda d: F.pmod(d["h1"], F.lit(PARTS)) == p))
    many = F.transform(F.array(parts), lambda p: F.filter(lines, lambda x: ~F.coalesce(_in_part(p, _hashed(x, min_chars)), F.lit(False))))
    return F.when(F.size(drops) <= PARTS, some).otherwise(F.get(many, F.lit(0)))


def _in_part(parts: Column, key: Column) -> Column:
    return F.array_contains(F.get(parts, F.pmod(key["h1"], F.lit(PARTS)).cast("int")), key)


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without its repeated lines, and
    ``ox_n_lines``, ``ox_n_dropped``.

    Keys of ``min_chars`` code points or more in ``min_docs`` documents or more
    lose their lines except in the largest id that holds them. Texts move once,
    beside the narrow hashes; the join with the repeated keys can be skewed, and
    its large partitions are split at run time.
    """
    spark = docs.sparkSession
    t = texts(docs, id_col, text_col)
    keys = F.filter(F.transform(split_lines(F.col("text")), lambda x: _hashed(x, min_chars)), lambda x: x.isNotNull())
    lines = materialize(t.select("doc_id", F.explode(keys).alias("k")).select("doc_id", "k.h1", "k.h2").distinct(), "line-hashes")
    store = LineRuns(spark, fanout)
    # Descending ranges of ids; a null id, and all rows of one id, are in one batch.
    edges = sorted(_edges(lines, batches), reverse=True)
    for k in range(len(edges) + 1):
        c = F.col("doc_id")
        low = F.lit(True) if k == len(edges) else c > F.lit(edges[k])
        high = F.lit(True) if k == 0 else c <= F.lit(edges[k - 1])
        within = (low & high) if k < len(edges) else (high | c.isNull())
        store.add(lines.filter(within))
    repeated = store.totals().filter(F.col("n_docs") >= min_docs).select(*KEY, "keeper")
    hits = lines.join(repeated, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = hits.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("ox_drops")).select(F.col("doc_id").alias("ox_drop_id"), "ox_drops")
    joined = docs.join(drops, docs[id_col].eqNullSafe(drops["ox_drop_id"]), "left")
    split = split_lines(F.coalesce(docs[text_col], F.lit("")))
    lines_in = F.size(split)
    kept = F.when(F.col("ox_drops").isNull(), split).otherwise(_without(split, F.col("ox_drops"), min_chars))
    out = joined.withColumn("ox_kept", kept)
    rest = [F.array_join(F.col("ox_kept"), "\n").alias(text_col) if c == text_col else docs[c] for c in docs.columns]
    return out.select(*rest, lines_in.cast("long").alias("ox_n_lines"), (lines_in - F.size("ox_kept")).cast("long").alias("ox_n_dropped"))
