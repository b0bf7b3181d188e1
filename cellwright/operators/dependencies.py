"""Violations of functional dependencies, by grouping; never by comparing pairs of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.spec import FD


def violating_groups(df: DataFrame, fd: FD) -> DataFrame:
    """The left-hand values (nulls as a group) that do not have exactly one right-hand value; nulls do not count as one."""
    return df.groupBy(*fd.lhs).agg(F.countDistinct(fd.rhs[0]).alias("n_rhs")).where("n_rhs <> 1")


def fd_violations(df: DataFrame, record_id: str, fds: list[FD], cells: str = "rhs") -> DataFrame:
    """recid, attr: the right-hand cell of every record of a violating group (cells="both": the left-hand ones too)."""
    found = []
    for fd in fds:
        bad = violating_groups(df, fd).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(fd.lhs)])
        match = reduce(lambda a, b: a & b, [df[c].eqNullSafe(bad[f"k{i}"]) for i, c in enumerate(fd.lhs)])
        names = [fd.rhs[0]] if cells == "rhs" else [*fd.lhs, fd.rhs[0]]
        found.append(df.join(bad, match, "left_semi").select(F.col(record_id).alias("recid"), F.explode(F.array(*[F.lit(n) for n in names])).alias("attr")))
    return reduce(DataFrame.unionByName, found).distinct()


def fd_votes(cell: DataFrame, df: DataFrame, record_id: str, fds: list[FD]) -> DataFrame:
    """Cells with ec_fd: 1 for a violation, else 0."""
    marks = fd_violations(df, record_id, fds).withColumn("mark_", F.lit(1))
    return cell.join(marks, ["recid", "attr"], "left").withColumn("ec_fd", F.coalesce("mark_", F.lit(0))).drop("mark_")
