"""Sources and sinks: candidate pairs, traces, manifests, contracts, tables and their hashes."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contract import OutputContract
from ..operators.joins import latest, unique

CANDIDATES = "array<struct<box:array<double>,score:double,label:string>>"
PAIR = f"id string, clean_candidates {CANDIDATES}, perturbed_candidates {CANDIDATES}"
MANIFEST = "image_id long, ref_id long, query string, target_box array<double>, category_id int, image_path string, dataset string, source_split string, query_word_count int, bbox_area double"
PROBE = f"split string, spec struct<family:string,severity:double,seed:int>, outcome struct<coverage:int,rank_stable:int,operational_stable:int,primary_failure:string,culprit_clean_index:int,mapping:array<int>,matched_ious:array<double>,matched_scores:array<double>,missing_clean_indices:array<int>,perturbed_candidate_count:int>, raw_candidates {CANDIDATES}, candidates {CANDIDATES}"
TRACE = f"model string, image_id long, ref_id long, query string, target_box array<double>, category_id int, clean_eligible int, clean_correct int, clean_best_iou double, reason string, raw_clean_candidates {CANDIDATES}, tracked_clean_candidates {CANDIDATES}, probes array<struct<{', '.join(x.replace(' ', ':', 1) for x in PROBE.split(', '))}>>"


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, an object for each line that isn't blank. Anything else is an error that names the file and the
    line, counted within the part that a task reads (a gzipped or small file is one part)."""
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    a = spark.read.text(path).select("value", line.alias("line"), F.input_file_name().alias("file")).filter(F.trim("value") != "")
    return _parsed(a, schema, F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"), F.lit(" is not a JSON object"))).select("r.*")


def _parsed(a: DataFrame, schema: str, message: Column) -> DataFrame:
    """``a`` with its ``value`` parsed as ``r``, or the error ``message``."""
    kind = T._parse_datatype_string(schema)
    r = F.from_json("value", T.StructType([*kind.fields, T.StructField("ox_bad", T.StringType())]), {"columnNameOfCorruptRecord": "ox_bad"})
    a = a.withColumn("r", r)
    good = F.col("r").isNotNull() & F.col("r.ox_bad").isNull() & F.trim("value").startswith("{")
    return a.withColumn("r", F.when(good, F.struct(*[F.col(f"r.{f.name}").alias(f.name) for f in kind.fields])).otherwise(F.raise_error(message).cast(kind)))


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file: an object or a list of objects; anything else is an error that names the item."""
    a = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("value"), F.input_file_name().alias("file"))
    listed = F.col("value").startswith("[")
    items = F.when(listed, F.from_json("value", "array<string>")).when(F.col("value").startswith("{"), F.array("value"))
    a = a.withColumn("items", F.coalesce(items, F.raise_error(F.concat(F.lit("neither an object nor a list of objects: "), F.col("file"))).cast("array<string>")))
    a = a.select(F.posexplode("items").alias("item", "value"), "file")
    return _parsed(a, schema, F.concat(F.lit("item "), F.col("item").cast("string"), F.lit(" of "), F.col("file"), F.lit(" is not a JSON object"))).select("r.*")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Candidate pairs: an object for each line (``.jsonl``), or one document with an object or a list of them."""
    return (read_objects if ".jsonl" in path else read_document)(spark, path, PAIR)


def read_contract(path: str | None) -> OutputContract:
    """A small config file beside the driver; none: the defaults."""
    if path is None:
        return OutputContract()
    with open(path) as f:
        return OutputContract.of(json.load(f))


def read_trace(spark: SparkSession, path: str, on_duplicate: str = "last") -> DataFrame:
    """Sample traces in JSON lines, gzipped or not. Of a key written twice the last record counts (``last``: files by name, lines
    by place), or it is an error at run time (``error``), or both stay (``keep``)."""
    a = read_objects(spark, path, TRACE).withColumns({"file": F.input_file_name(), "line_no": F.monotonically_increasing_id()})
    keys = ["model", "image_id", "ref_id"]
    if on_duplicate == "last":
        return latest(a.withColumn("written", F.struct("file", "line_no")).drop("file"), keys, "written").drop("written")
    a = a.drop("file")
    return unique(a, keys) if on_duplicate == "error" else a


def compact(trace: DataFrame, counts: dict[str, int]) -> DataFrame:
    """A row for each probe of traces that must be whole, ``model, image_id, ref_id, split, ord, family, severity, coverage, rank_stable,
    stable, failure, culprit, eligible, correct``. A sample traced twice, an eligible sample without just as many probes of each
    split as ``counts`` says, or a probe that is stable without coverage is an error at run time. Ineligible samples have a row without a probe."""
    keys = ["model", "image_id", "ref_id"]
    own = F.coalesce("probes", F.array())
    of = lambda s: F.size(F.filter(own, lambda p: p["split"] == s))
    short = reduce(lambda x, y: x | y, [of(s) != n for s, n in counts.items()])
    named = F.to_json(F.struct(*keys))
    kind = "array<struct<split:string>>"
    checked = (
        F.when((F.col("clean_eligible") == 1) & short, F.raise_error(F.concat(F.lit("not as many probes as registered: "), named)).cast(kind))
        .when(F.exists(own, lambda p: p["outcome"]["operational_stable"] > p["outcome"]["coverage"]), F.raise_error(F.concat(F.lit("stable without coverage: "), named)).cast(kind))
        .otherwise(F.array().cast(kind))
    )
    a = unique(trace, keys).filter(F.size(checked) == 0).select(*keys, F.col("clean_eligible").alias("eligible"), F.col("clean_correct").alias("correct"), F.posexplode_outer("probes").alias("ord", "p"))
    o = F.col("p.outcome")
    return a.select(
        *keys, "p.split", "ord", "p.spec.family", "p.spec.severity", o["coverage"].alias("coverage"), o["rank_stable"].alias("rank_stable"),
        o["operational_stable"].alias("stable"), o["primary_failure"].alias("failure"), o["culprit_clean_index"].alias("culprit"), "eligible", "correct",
    )


def probes(trace: DataFrame) -> DataFrame:
    """A row for each probe of a trace with its place in the record."""
    return trace.select("model", "image_id", "ref_id", F.posexplode("probes").alias("ord", "p")).select("model", "image_id", "ref_id", "ord", "p.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_split(spark: SparkSession, path: str, split: str, column: str = "split") -> DataFrame:
    """A Parquet table all of whose rows are of one split; another is an error at run time."""
    a = spark.read.parquet(path)
    message = F.concat(F.lit("unexpected split: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return a.withColumn(column, F.when(F.col(column).eqNullSafe(F.lit(split)), F.col(column)).otherwise(F.raise_error(message).cast("string")))


def read_images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """``path, name, content`` of image files; the bytes are decoded where a model runs (:mod:`ordinex.operators.inference`)."""
    a = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return a.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def index_images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """File names under a folder with their paths; a name that occurs twice is an error at run time."""
    a = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path")
    n = a.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    return n.select("name", F.when(F.col("n") == 1, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("a file name occurs twice: "), F.col("name"))).cast("string")).alias("path"))


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of each file under a folder."""
    a = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return a.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with their nulls written out."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_run(trace: DataFrame, summary: DataFrame, path: str) -> None:
    """One step of a run: traces first, then their summary, so that a key in both is done whatever fails between."""
    trace.write.mode("append").parquet(f"{path}/trace")
    summary.write.mode("append").parquet(f"{path}/summary")


def write_table(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A small table as one CSV file with a header, in the order of its keys, replaced as a whole by the commit protocol."""
    one = df.coalesce(1) if not order else df.repartition(1).sortWithinPartitions(*order)
    one.write.mode("overwrite").option("header", True).csv(path)


def write_matrix(values: DataFrame, path: str, row: list[str], column: str, value: str) -> None:
    """A matrix of samples and settings as a long table, a folder for each setting, in the order of samples."""
    values.select(*row, column, value).repartition(column).sortWithinPartitions(column, *row).write.mode("overwrite").partitionBy(column).parquet(path)


def write_audit(row: DataFrame, path: str, **more: object) -> dict:
    """The one row of ``row`` and ``more`` as a JSON file beside the driver; another number of rows is an error. Written beside and then renamed."""
    found = row.limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"an audit is one row, not {'none' if not found else 'several'}")
    audit = found[0].asDict(recursive=True) | more
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.tmp", "w") as f:
        json.dump(audit, f, indent=2, default=str)
    os.replace(f"{path}.tmp", path)
    return audit


def progress(manifest: DataFrame, trace: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """``total, done, fraction, seconds_left`` of a run that has worked for ``seconds``; no estimate before the first sample is done."""
    done = trace.select(*keys).distinct().withColumn("ox_done", F.lit(1))
    g = manifest.select(*keys).distinct().join(done, keys, "left").agg(F.count(F.lit(1)).alias("total"), F.count("ox_done").alias("done"))
    left = F.when(F.col("done") > 0, (F.col("total") - F.col("done")) * F.lit(float(seconds)) / F.col("done"))
    return g.withColumns({"fraction": F.when(F.col("total") > 0, F.col("done") / F.col("total")), "seconds_left": left})


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A report table. For summaries, which are small."""
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    rows = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in df.collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
