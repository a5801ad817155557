"""Manifests: text rules, seeded order, one row for each image, slices, limits and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resampling import FACTORS, MODULUS, SEED_STEP, SHIFTS


def normalized_query(query: Column) -> Column:
    """Without white space at its ends and without full stops behind it."""
    return F.regexp_replace(F.trim(query), r"\.+$", "")


def word_count(query: Column) -> Column:
    """Words between white space; none in a blank or missing query."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " ")))


def id_in_name(name: Column, pattern: str = r"(\d+)\.[^.]*$") -> Column:
    """The number that a file's name ends with; null without one."""
    found = F.regexp_extract(name, pattern, 1)
    return F.when(found != "", found.cast("long"))


def labelled(column: Column, labels: dict[str, str]) -> Column:
    """Display names by value; a value without one is an error."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(names, column), F.raise_error(F.concat(F.lit("no label for "), F.coalesce(column, F.lit("null")))).cast("string"))


def manifest(rows: DataFrame) -> DataFrame:
    """``rows`` with ``query_word_count`` and ``bbox_area`` of their ``query`` and ``target_box``."""
    b = F.col("target_box")
    side = lambda i: F.get(b, F.lit(i + 2)) - F.get(b, F.lit(i))
    return rows.withColumns({"query_word_count": word_count(F.col("query")), "bbox_area": side(0) * side(1)})


def statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows, distinct images, and least, median, mean and greatest of word counts and box areas."""
    of = lambda c, n: [F.min(c).alias(f"{n}_min"), F.percentile(c, F.lit(0.5)).alias(f"{n}_median"), F.avg(c).alias(f"{n}_mean"), F.max(c).alias(f"{n}_max")]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("image_id").alias("images"), *of("query_word_count", "words"), *of("bbox_area", "area"))


def keyed_draw(key: Column, seed: int) -> Column:
    """The number of :func:`ordinex.operators.resampling.uniform` for a key (null: 0), repetition 0 and slot 0."""

    def mixed(x: Column) -> Column:
        x = x.bitwiseXOR(F.shiftright(x, SHIFTS[0]))
        for factor, shift in zip(FACTORS, SHIFTS[1:]):
            x = F.pmod(x * F.lit(factor).cast("long"), F.lit(MODULUS))
            x = x.bitwiseXOR(F.shiftright(x, shift))
        return x

    x = F.pmod(F.pmod(F.coalesce(key, F.lit(0)).cast("long"), F.lit(MODULUS)) + F.lit(seed * SEED_STEP).cast("long"), F.lit(MODULUS))
    return (mixed(mixed(mixed(x))) + 0.5) / MODULUS


def one_per_image(rows: DataFrame, seed: int, image: str = "image_id", key: str = "ref_id") -> DataFrame:
    """The first row of each image in seeded order; equal draws by key. By aggregation, so images with many rows are no window."""
    rest = [c for c in rows.columns if c != image]
    first = F.min_by(F.struct(*rest), F.struct(keyed_draw(F.col(key), seed), F.col(key)))
    return rows.groupBy(image).agg(first.alias("ox_r")).select(image, "ox_r.*").select(*rows.columns)


def shuffled(rows: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """The first ``most`` rows in seeded order with their ``position``: a bounded sort, each task sends its first rows alone.
    Fewer rows than that are returned as they are; see :func:`exactly`."""
    top = rows.withColumn("ox_u", keyed_draw(F.col(key), seed)).orderBy("ox_u", key).limit(most)
    return _numbered(top, ["ox_u", key]).drop("ox_u")


def _numbered(bounded: DataFrame, order: list[str]) -> DataFrame:
    """Rows that a limit has bounded with their ``position``."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in bounded.columns if c not in order])))
    return bounded.agg(rows.alias("ox_rows")).select(F.posexplode("ox_rows").alias("position", "ox_r")).select(*[F.col(f"ox_r.{c}").alias(c) for c in bounded.columns], F.col("position").cast("long").alias("position"))


def exactly(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows, or an error that says how many there were. Asks for no more than ``n``."""
    found = rows.limit(n).count()
    if found < n:
        raise ValueError(f"selected {found} of the requested {n} rows")
    return rows.limit(n)


def sliced(rows: DataFrame, order: list[str], start: int = 0, stop: int | None = None, limit: int | None = None) -> DataFrame:
    """The rows from place ``start`` up to ``stop`` in the order of their keys, of the first ``limit`` alone; an empty range is an error."""
    stop = limit if stop is None else stop if limit is None else min(stop, limit)
    if start < 0 or (stop is not None and stop <= start):
        raise ValueError("the selected range is empty")
    a = rows.orderBy(*order)
    a = a if stop is None else a.limit(stop)
    return a.offset(start) if start else a
