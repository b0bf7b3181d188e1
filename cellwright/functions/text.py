"""Text functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matches(value: Column, *patterns: str) -> Column:
    """Whether the whole value fits one of the patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(f"^(?:{p})$")
    return out


def case_class(value: Column) -> Column:
    """upper, lower, title, mixed or none (no letters); null stays null."""
    letters = F.regexp_replace(value, "[^A-Za-z]", "")
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(letters == "", "none")
        .when(letters == F.upper(letters), "upper")
        .when(letters == F.lower(letters), "lower")
        .when(value == F.initcap(value), "title")
        .otherwise("mixed")
    )


def char_ngrams(value: Column, n: int) -> Column:
    """All substrings of n characters, in order; shorter values have none."""
    return F.when(F.length(value) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - (n - 1), F.lit(1))), lambda i: F.substring(value, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def simplified(value: Column) -> Column:
    """Lower case, everything but letters, digits and the underscore replaced by blanks, null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9_]", " ")


def _jaro_winkler(a: str, b: str, scale: float = 0.1, longest: int = 4, boost: float = 0.7) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    other = [c for c, t in zip(b, taken) if t]
    swapped = sum(x != y for x, y in zip(mine, other)) // 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    while prefix < min(longest, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * scale * (1 - jaro) if jaro > boost else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_jaro_winkler(x or "", y or "") for x, y in zip(a, b)], dtype="float64")
