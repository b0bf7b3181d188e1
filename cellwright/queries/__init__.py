"""Registered queries of the table operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellwright.queries import cells, learned, profiles, repairs, votes  # noqa: F401  they put their queries on record
from cellwright.queries.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty customers, five detectors, their unions, and how each compares with the truth."""
    return QUERIES["I3_evaluate_min_k"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
