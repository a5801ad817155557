"""Evaluation of candidate pairs end to end, as an API and a command."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import from_wire, to_wire, validated
from ..operators.contract import OutputContract
from ..operators.outcome import evaluated
from ..sources.files import read_contract, read_pairs, write_json


def evaluate(pairs: DataFrame, contract: OutputContract | None = None) -> DataFrame:
    """Pairs in wire form to ``id, clean_eligible, tracked_clean_candidates, exposed_perturbed_candidates, outcome,
    ineligible_reason``. A narrow plan; a bad candidate is an error."""
    a = pairs.withColumns({c: validated(from_wire(F.col(c))) for c in ("clean_candidates", "perturbed_candidates")})
    e = evaluated(a, contract)
    return e.select("id", "clean_eligible", to_wire(F.col("tracked")).alias("tracked_clean_candidates"), to_wire(F.col("exposed")).alias("exposed_perturbed_candidates"), "outcome", "ineligible_reason")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ordinex")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--contract")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("ordinex").getOrCreate()
    write_json(evaluate(read_pairs(spark, a.input), read_contract(a.contract)), a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
