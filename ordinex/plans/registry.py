"""The queries by name, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import FACTS_SQL, facts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine digits: the order of sums differs between engines."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def add(name: str, query: Query, body: str | None = None, ctes: str = FACTS_SQL, doubles: str = "", ints: str = "") -> None:
    """Register a query and, with ``body``, its SQL: ``doubles`` are rounded, ``ints`` made 64-bit."""
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    if body:
        out = ", ".join([*(f"round({c}, 9) AS {c}" for c in doubles.split()), *(f"({c})::BIGINT AS {c}" for c in ints.split())])
        others = f"* EXCLUDE ({', '.join([*doubles.split(), *ints.split()])})" if out else "*"
        ORACLES[name] = f"WITH {ctes}, out_ AS ({body}) SELECT {', '.join(x for x in (others, out) if x)} FROM out_"


def on_facts(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(facts(spark, d))
