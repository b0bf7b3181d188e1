"""Known errors put into clean tables. Which rows are hit is a condition, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.samples import hash_share


def inject_misfielded(df: DataFrame, target: str, source: str, where: Column) -> DataFrame:
    """The source column's value is moved behind the target's, and left empty."""
    return df.withColumns({target: F.when(where, F.concat_ws(" ", target, source)).otherwise(F.col(target)), source: F.when(where, F.lit("")).otherwise(F.col(source))})


def inject_suffix(df: DataFrame, column: str, suffix: str, where: Column) -> DataFrame:
    return df.withColumn(column, F.when(where, F.concat(F.col(column), F.lit(suffix))).otherwise(F.col(column)))


def inject_placeholder(df: DataFrame, column: str, placeholder: str = "N/A", where: Column | None = None) -> DataFrame:
    """Nulls become a placeholder."""
    hit = F.col(column).isNull() if where is None else where & F.col(column).isNull()
    return df.withColumn(column, F.when(hit, F.lit(placeholder)).otherwise(F.col(column)))


def inject_variants(df: DataFrame, column: str, suffixes: list[str], weights: list[int], key: Column) -> DataFrame:
    """Each row gets one of the suffixes; ``key`` modulo the sum of the weights decides."""
    place, below = F.pmod(key, F.lit(sum(weights))), 0
    chosen = F.lit(None).cast("string")
    for suffix, weight in zip(suffixes, weights):
        chosen = F.coalesce(chosen, F.when((place >= below) & (place < below + weight), F.lit(suffix)))
        below += weight
    out = chosen
    return df.withColumn(column, F.concat(F.col(column), out))


def join_sources(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """A clean base table from two sources."""
    return left.join(right, left[left_key] == right[right_key]).drop(right[right_key])


def sample_records(df: DataFrame, record_id: str, percent: float, seed: int = 0) -> DataFrame:
    return df.where(hash_share([record_id], percent, seed))


def records_of(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` that belong to sampled records."""
    return df.join(sample.select(key).distinct(), key, "left_semi")
