"""Samples by hash: the same rows however the data are partitioned, and the same ones in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_share(keys: list[str] | tuple[str, ...], percent: float, seed: int = 0) -> Column:
    """Whether a row is among about ``percent`` of the keys: the first four digits of an MD5 sum against a bound."""
    if percent >= 100:
        return F.lit(True)
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))
    return F.substring(digest, 1, 4) < hex_bound(percent)


def hex_bound(percent: float) -> str:
    return f"{int(percent / 100 * 0x10000):04x}"


def hash_share_sql(keys: list[str], percent: float, seed: int = 0) -> str:
    """The same condition in SQL."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"substr(md5(concat_ws('|', {parts}, '{seed}')), 1, 4) < '{hex_bound(percent)}'"
