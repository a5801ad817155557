"""Document fingerprints: the canonical exact digest. DataFrame operations only.

Canonical form: compatibility composition (NFKC), full case folding, composition
again, runs of Unicode white space as one space, none at the ends. Digest: 128 bits
of xxHash (XXH64 under two seeds) as 32 hex digits. Texts of equal digest are a
bucket; inside a bucket the canonical bytes are compared, and texts that differ get
an ordinal behind the digest (``digest-1``, ...), so equal fingerprints mean equal
canonical texts. Normalisation and folding are called in the ICU library that Spark
ships for its collations, as SQL functions of the JVM.

Defined results: a null text is the empty text; an empty text has a fingerprint of
its own; repeated rows and ties get equal fingerprints; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hex64, materialize, texts, wide_hash

#: Unicode white space, as a Java character class.
WHITE = r"[\s\x1c-\x1f\u0085   -     　]+"


def _icu(method: str, c: Column) -> Column:
    cls = {"compose": "com.ibm.icu.text.Normalizer", "foldCase": "com.ibm.icu.lang.UCharacter"}[method]
    return F.java_method(F.lit(cls), F.lit(method), c, F.lit(True))


def canonical(c: Column) -> Column:
    """The canonical form; where all is ASCII, case and white space alone matter."""
    folded = F.when(c.rlike(r"[^\x00-\x7F]"), _icu("compose", _icu("foldCase", _icu("compose", c)))).otherwise(F.lower(c))
    return F.trim(F.regexp_replace(folded, WHITE, " "))


def digest(canon: Column) -> Column:
    h1, h2 = wide_hash(canon)
    return F.concat(hex64(h1), hex64(h2))


def collisions(canons: DataFrame) -> DataFrame:
    """``(digest, canon, ordinal)`` of the digests that stand for more than one canonical
    text. ``canons``: ``digest, canon``. Copies meet before the shuffle: what moves is
    each task's least and greatest text of a digest, and only buckets in which they
    differ are gathered. (Beyond two XXH64 at random, none does.)"""
    spread = canons.groupBy("digest").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).filter(F.col("low") != F.col("high")).select("digest")
    # Written first: it is all but empty, and its known size spares the texts another shuffle.
    spread = materialize(spread, "spread-digests")
    texts_ = canons.join(spread, "digest", "left_semi").distinct()
    return texts_.select("digest", "canon", (F.row_number().over(W.partitionBy("digest").orderBy("canon")) - 1).alias("ordinal"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with their fingerprint in ``out_col``: the digest, with an ordinal where bytes differ in a bucket."""
    a = docs.withColumn("ox_canon", canonical(F.coalesce(F.col(text_col), F.lit("")))).withColumn("ox_digest", digest(F.col("ox_canon")))
    return resolved(a, "ox_digest", "ox_canon", out_col, collisions(a.select(F.col("ox_digest").alias("digest"), F.col("ox_canon").alias("canon")))).drop("ox_canon", "ox_digest")


def resolved(df: DataFrame, digest_col: str, canon_col: str, out_col: str, collided: DataFrame) -> DataFrame:
    """``df`` with ``out_col``: the digest and, where bytes differ in its bucket, the ordinal of the text."""
    c = collided.select(F.col("digest").alias("ox_d"), F.col("canon").alias("ox_c"), F.col("ordinal").alias("ox_o"))
    j = df.join(c, (df[digest_col] == c["ox_d"]) & (df[canon_col] == c["ox_c"]), "left")
    suffix = F.when(F.coalesce(F.col("ox_o"), F.lit(0)) > 0, F.concat(F.lit("-"), F.col("ox_o").cast("string"))).otherwise(F.lit(""))
    return j.withColumn(out_col, F.concat(F.col(digest_col), suffix)).drop("ox_d", "ox_c", "ox_o")


def likeness(a: Column, b: Column) -> Column:
    """Of two exact fingerprints: 1 if equal, else 0."""
    return (a == b).cast("double")


#: No more ranges of ids than this, so that their edges stay small on the driver.
MAX_RANGES = 4096


def with_next(docs: DataFrame, rows_per_range: int = 1000) -> DataFrame:
    """``(doc_id, text, next_text)``: beside each document the one that follows in descending
    order of ids, after the last the first. Repeated ids follow one another by text; a
    null id comes last.

    Ids are cut into ranges of about ``rows_per_range`` rows (more beyond ``MAX_RANGES``
    ranges), each ordered in a task of its own. The first row of each range is sent
    to the range before it as well, so that texts are shuffled once.
    """
    t = texts(docs)
    spark = docs.sparkSession
    parts = max(1, min(MAX_RANGES, t.count() // rows_per_range))
    kind = t.schema["doc_id"].dataType
    if isinstance(kind, T.NumericType):
        cuts = t.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    else:  # other ids are cut at some of themselves, those of the least hashes
        cuts = [r[0] for r in t.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id")).limit(parts - 1).collect()] if parts > 1 else []
    b = t.withColumn("range", _below(F.col("doc_id"), sorted(set(cuts or []))))
    # Of each range, the id that comes first in descending order: a row for each range.
    tops = b.groupBy("range").agg(F.max("doc_id").alias("top")).orderBy(F.desc("range")).collect()
    if not tops:
        return t.select("doc_id", "text", F.col("text").alias("next_text"))
    before = [(r["range"], r["top"], tops[k - 1]["range"]) for k, r in enumerate(tops)]
    heads = spark.createDataFrame(before, T.StructType([T.StructField("range", T.IntegerType()), T.StructField("top", kind), T.StructField("before", T.IntegerType())]))
    # The first row of a range among equal ids: the least text.
    firsts = b.join(F.broadcast(heads), "range").filter(F.col("doc_id").eqNullSafe(F.col("top")))
    ghosts = firsts.groupBy("before").agg(F.min("text").alias("text")).select(F.lit(None).cast(t.schema["doc_id"].dataType).alias("doc_id"), "text", F.col("before").alias("range"), F.lit(1).alias("ghost"))
    w = W.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    placed = b.select("doc_id", "text", "range", F.lit(0).alias("ghost")).unionByName(ghosts)
    return placed.withColumn("next_text", F.lead("text").over(w)).filter("ghost = 0").select("doc_id", "text", "next_text")


def _below(c: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are below ``c``, by halving; null: none."""
    if not cuts:
        return F.lit(0)
    edges = F.lit(cuts)
    steps = F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))])
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(edges, at + step - 1) < c), at + step).otherwise(at)), F.lit(0))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text (the last third
    replaced by the start of the next document) and likeness to the next document.

    Buckets of documents are resolved by their bytes among all documents. An edited
    text is compared byte by byte with its own document, in the row that holds both: that is
    the likeness asked for. It is not held against other documents' edited texts, so equal
    fingerprints of two edited texts say that 128 bits are equal.
    """
    named = texts(docs).withColumn("canon", canonical(F.col("text"))).select(digest(F.col("canon")).alias("digest"), "canon")
    collided = materialize(collisions(named), "collisions")
    a = with_next(docs)
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    a = a.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - k), F.substr("next_text", F.lit(1), k)))
    a = a.withColumns({"c_own": canonical(F.col("text")), "c_edit": canonical(F.col("edited")), "c_next": canonical(F.col("next_text"))})
    a = a.withColumns({"d_own": digest(F.col("c_own")), "d_edit": digest(F.col("c_edit")), "same": F.col("c_own") == F.col("c_edit"), "same_next": F.col("c_own") == F.col("c_next")})
    a = resolved(a, "d_own", "c_own", "fingerprint", collided)
    edit = F.when(F.col("same"), F.col("fingerprint")).when(F.col("d_own") == F.col("d_edit"), F.concat("d_edit", F.lit("-edited"))).otherwise(F.col("d_edit"))
    return a.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        edit.alias("edited_fingerprint"),
        F.col("same").cast("double").alias("near_edited"),
        F.col("same_next").cast("double").alias("near_next"),
    )
