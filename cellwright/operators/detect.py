"""Error detectors as column expressions over cells joined with small per-attribute facts.

Votes: 1 error, -1 clean, 0 does not apply. Every detector takes cells (recid, attr, value) with, where needed, the
columns of ``with_profile``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright import spec as S
from cellwright.functions.numeric import ratio
from cellwright.functions.text import matches
from cellwright.operators.cells import DICTIONARY_ROWS
from cellwright.operators.profile import column_profile, top_values, value_counts
from cellwright.spec import TableSpec

#: Parts over which cells with frequent values are dealt.
SPREAD = 64


def _is_type(spec: TableSpec, *types: str) -> Column:
    names = [c for c in spec.columns if spec.type_of(c) in types]
    return F.col("attr").isin(*names) if names else F.lit(False)


def _vote(error: Column) -> Column:
    return F.when(error, S.ERROR).otherwise(S.CLEAN)


def _outside(error: Column) -> Column:
    """1 or 0, as the detectors of lengths and columns answer; undecidable counts as 0."""
    return F.when(error, S.ERROR).otherwise(S.DOES_NOT_APPLY)


def _defaults(spec: TableSpec) -> Column:
    """The lower-cased default values of the attribute's type; an empty array where the type has none."""
    empty = F.array().cast("array<string>")
    out = empty
    for kind, values in S.DEFAULT_VALUES.items():
        out = F.when(_is_type(spec, kind), F.array(*[F.lit(v.lower()) for v in values])).otherwise(out)
    return out


def _lowered(c: str) -> Column:
    return F.transform(c, lambda v: F.lower(v))


def missing() -> Column:
    return _vote(F.col("value").isNull())


def default_value(spec: TableSpec) -> Column:
    known = _is_type(spec, *S.DEFAULT_VALUES)
    return F.when(F.col("value").isNull() | ~known, S.DOES_NOT_APPLY).otherwise(_vote(F.array_contains(_defaults(spec), F.lower("value"))))


def top_value(spec: TableSpec) -> Column:
    """Clean if the value is among the most frequent ones that are no default values."""
    integers = F.array(*[F.lit(v.lower()) for v in S.DEFAULT_VALUES["Integer"]])
    listed = F.when(F.size(_defaults(spec)) > 0, _defaults(spec)).otherwise(integers)
    return F.when(F.col("value").isNull(), S.DOES_NOT_APPLY).otherwise(_vote(~F.coalesce(F.array_contains(F.array_except(_lowered("top10"), listed), F.lower("value")), F.lit(False))))


def in_top10() -> Column:
    return F.when(F.col("value").isNull(), S.DOES_NOT_APPLY).otherwise(_vote(~F.coalesce(F.array_contains(_lowered("top10"), F.lower("value")), F.lit(False))))


def valid_number(spec: TableSpec) -> Column:
    return F.when(F.col("value").isNull() | ~_is_type(spec, "Integer"), S.DOES_NOT_APPLY).otherwise(_vote(~matches(F.col("value"), S.NUMBER)))


def valid_type(spec: TableSpec) -> Column:
    value = F.col("value")
    ok = (
        F.when(_is_type(spec, "Social Security Number"), matches(value, S.SSN))
        .when(_is_type(spec, "Zip Code"), matches(value, *S.ZIP))
        .when(_is_type(spec, "State"), F.lower(value).isin(*S.STATE_CODES, *S.STATE_NAMES))
    )
    return F.when(value.isNull() | ok.isNull(), S.DOES_NOT_APPLY).otherwise(_vote(~ok))


PATTERNS = {"gender": (S.GENDER,), "email": (S.EMAIL,), "credit_card": S.CREDIT_CARDS, "number": (S.NUMBER,), "ssn": (S.SSN,), "zip": S.ZIP}


def valid_pattern(kind: str, value: Column | None = None) -> Column:
    """Whether values are of one of PATTERNS' kinds; case matters for none of them."""
    value = F.col("value") if value is None else value
    return F.when(value.isNull(), S.DOES_NOT_APPLY).otherwise(_vote(~matches(F.lower(value), *PATTERNS[kind])))


def cardinality(cell: DataFrame, spec: TableSpec, cell_only: bool = False) -> DataFrame:
    """Adds ec_cardinality: 1 for all cells of records whose value of a unique attribute occurs more than once."""
    unique = cell.where(F.col("attr").isin(*spec.unique_columns) & F.col("value").isNotNull()) if spec.unique_columns else cell.where("false")
    often = value_counts(unique).where("cnt > 1").select("attr", "value")
    bad = unique.join(often, ["attr", "value"], "left_semi").select("recid", "attr").distinct()
    keys = ["recid", "attr"] if cell_only else ["recid"]
    marks = bad.select(*keys).distinct().withColumn("mark_", F.lit(True))
    return cell.join(marks, keys, "left").withColumn("ec_cardinality", _outside(F.coalesce("mark_", F.lit(False)))).drop("mark_")


def lookup(cell: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """Adds ec_lookup: -1 where upper(trim(value)) is in the attribute's one-column dictionary, 1 where not, 0 without one."""
    out = cell.withColumn("key_", F.upper(F.trim("value")))
    entries = None
    for attr, df in dictionaries.items():
        one = df.select(F.lit(attr).alias("attr"), F.upper(F.trim(F.col(df.columns[0]).cast("string"))).alias("key_")).distinct()
        entries = one if entries is None else entries.unionByName(one)
    if entries is None:
        return cell.withColumn("ec_lookup", F.lit(S.DOES_NOT_APPLY))
    entries = entries.withColumn("known_", F.lit(True))
    if entries.limit(DICTIONARY_ROWS + 1).count() <= DICTIONARY_ROWS:
        out = out.join(F.broadcast(entries), ["attr", "key_"], "left")
    else:  # frequent values are dealt over parts, each with all entries
        parts = entries.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        out = out.withColumn("part_", F.pmod(F.xxhash64("recid"), F.lit(SPREAD)).cast("int")).join(parts, ["attr", "key_", "part_"], "left").drop("part_")
    return out.withColumn("ec_lookup", F.when(F.col("attr").isin(*dictionaries), _vote(F.col("known_").isNull())).otherwise(S.DOES_NOT_APPLY)).drop("key_", "known_")


def low_count() -> Column:
    return F.when(F.col("cnt").isNull() | (F.col("n_distinct") == F.col("n_rows")), S.DOES_NOT_APPLY).otherwise(_vote(F.col("cnt") == 1))


def unused_column() -> Column:
    return _outside(F.col("n_distinct") <= 1)


def _length() -> Column:
    return F.length("value")


def common_length() -> Column:
    return _outside(F.col("value").isNotNull() & ~F.array_contains("common_lengths", _length()))


def length_quartile() -> Column:
    return _outside((_length() < F.col("q1_len")) | (_length() > F.col("q3_len")))


def length_hampel(k: float = 1.0) -> Column:
    reach = k * 1.4826 * F.col("mad_len")
    return _outside((_length() < F.col("median_len") - reach) | (_length() > F.col("median_len") + reach))


def length_evt(threshold: float = 0.9) -> Column:
    z = (_length() - F.col("mean_len")) / F.nullif(F.col("std_len"), F.lit(0.0))
    return _outside(F.exp(-F.exp(-z)) > threshold)


def length_iqr(factor: float = 1.5, mode: str = "quartile") -> Column:
    """mode quartile: below factor times Q1 or above factor times Q3; mode tukey: the usual fences."""
    low, high = F.col("q1_len"), F.col("q3_len")
    if mode == "tukey":
        low, high = low - factor * (high - low), high + factor * (high - low)
    else:
        low, high = factor * low, factor * high
    return _outside((_length() < low) | (_length() > high))


def length_z(threshold: float = 3.0) -> Column:
    return _outside(F.abs(_length() - F.col("mean_len")) / F.nullif(F.col("std_len"), F.lit(0.0)) >= threshold)


def _length_range(kind: str, factor: float) -> Column:
    off = factor * F.col(f"{kind}_std")
    return _outside((_length() < F.col(f"{kind}_mean") - off) | (_length() > F.col(f"{kind}_mean") + off))


def length_trimmed(factor: float = 3.0) -> Column:
    return _length_range("trimmed", factor)


def length_winsorized(factor: float = 3.0) -> Column:
    return _length_range("winsorized", factor)


def with_profile(cell: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Cells with their attribute's profile (one row per attribute, broadcast) and their value's count.

    The profile knows the counts of the most frequent values, so only cells with other values meet the table of counts; nulls
    and frequent values are spread over SPREAD parts and meet nothing.
    """
    profile = column_profile(cell) if profile is None else profile
    place = F.coalesce(F.array_position("top10", F.col("value")), F.lit(0))
    sure = F.col("value").isNull() | (place > 0)
    part = F.when(sure, F.pmod(F.xxhash64("recid"), F.lit(SPREAD)) + 1).otherwise(F.lit(0))
    known = cell.join(F.broadcast(profile), "attr", "left").withColumn("part_", part)
    counts = value_counts(cell).select("attr", "value", F.col("cnt").alias("cnt_"), F.lit(0).cast("long").alias("part_"))
    counted = known.join(counts, ["attr", "value", "part_"], "left")
    return counted.withColumn("cnt", F.when(place > 0, F.get("freq_top10", F.greatest(place - 1, F.lit(0)).cast("int"))).otherwise(F.col("cnt_"))).drop("part_", "cnt_")


def column_detectors(spec: TableSpec) -> dict[str, Column]:
    """All detectors that are expressions over ``with_profile``."""
    return {
        "ec_missing": missing(), "ec_default": default_value(spec), "ec_top_value": top_value(spec), "ec_in_top10": in_top10(), "ec_number": valid_number(spec),
        "ec_type": valid_type(spec), "ec_low_count": low_count(), "ec_unused": unused_column(), "ec_common_length": common_length(),
        "ec_quartile": length_quartile(), "ec_hampel": length_hampel(), "ec_evt": length_evt(), "ec_iqr": length_iqr(), "ec_z": length_z(),
        "ec_trimmed": length_trimmed(), "ec_winsorized": length_winsorized(),
    }


def detector_matrix(cell: DataFrame, spec: TableSpec, dictionaries: dict[str, DataFrame] | None = None, labels: DataFrame | None = None, profile: DataFrame | None = None) -> DataFrame:
    """recid, attr, value, every ec_ column, and label where ``labels`` (recid, attr, label) is given."""
    votes = column_detectors(spec)
    out = with_profile(cell, profile).select("recid", "attr", "value", *[c.alias(n) for n, c in votes.items()])
    out = cardinality(lookup(out, dictionaries or {}), spec)
    return out if labels is None else out.join(labels.select("recid", "attr", "label"), ["recid", "attr"])


#: Detector bundles for kinds of errors.
PRESETS = {
    "misfielded": ("ec_common_length", "ec_low_count", "ec_lookup"),
    "wrong_type": ("ec_number", "ec_low_count"),
    "misspelling": ("ec_in_top10", "ec_number", "ec_low_count"),
}
#: What stands in the place of a clean value to name the kind of the error.
ERROR_MARKERS = ("#LV_AMBIGUOUS_DATA#", "#LV_MISFIELDED#", "#LV_UNUSED#", "#LV_MISSING#", "#LV_EXTRANEOUS_DATA#", "#LV_DEFAULT_VALUE#", "#LV_DIFFERENT_WORD_ORDERING#")


def preset(matrix: DataFrame, detectors: str | tuple[str, ...], attributes: list[str] | None = None) -> DataFrame:
    """The votes of a bundle (or of given detectors) on chosen attributes."""
    rows = matrix if attributes is None else matrix.where(F.col("attr").isin(*attributes))
    names = PRESETS[detectors] if isinstance(detectors, str) else detectors
    return rows.select("recid", "attr", "value", *[c for c in ("label",) if c in matrix.columns], *names)


def coverage(matrix: DataFrame, votes: list[str]) -> DataFrame:
    """detector, coverage: percentage of cells (4 digits) on which a detector answers, all in one aggregation."""
    one = matrix.agg(*[F.round(100 * F.avg((F.col(v) != 0).cast("double")), 4).alias(v) for v in votes])
    return one.unpivot([], votes, "detector", "coverage")


def class_by_attributes(groups: dict[str, list[str]]) -> Column:
    """The class of an erroneous cell by its attribute: classes with their attributes; null elsewhere."""
    out = F.lit(None).cast("string")
    for name, attributes in groups.items():
        out = F.when((F.col("label") == 1) & F.col("attr").isin(*attributes), name).otherwise(out)
    return out


def class_by_marker(markers: tuple[str, ...] = ERROR_MARKERS, clean: str = "clean_value") -> Column:
    """The class of a cell by the marker that stands in its clean value's place; null elsewhere."""
    return F.when(F.col(clean).isin(*markers), F.col(clean))


def coverage_by_class(matrix: DataFrame, votes: list[str], error_class: Column) -> DataFrame:
    """class and, for each detector, the percentage of the class's cells that it flags as errors; cells without a class are left out."""
    return matrix.where(error_class.isNotNull()).groupBy(error_class.alias("class")).agg(*[F.round(100 * F.avg((F.col(v) == 1).cast("double")), 4).alias(v) for v in votes])


# -- numeric outliers ---------------------------------------------------------------------------------------------


def gaussian_outliers(df: DataFrame, record_id: str, columns: list[str], n: float = 3.0) -> DataFrame:
    """recid, attr of the values more than n standard deviations off their column's mean; one profile row is broadcast."""
    long = df.select(F.col(record_id).alias("recid"), *[F.col(c).try_cast("double").alias(c) for c in columns]).unpivot("recid", columns, "attr", "x")
    facts = long.groupBy("attr").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return long.join(F.broadcast(facts), "attr").where(F.abs(F.col("x") - F.col("mean")) > n * F.col("std")).select("recid", "attr")


def histogram_outliers(cell: DataFrame, peak: float = 0.8, rare: float = 0.2, top: int = 10) -> DataFrame:
    """recid, attr of rare values in peaked attributes.

    An attribute is peaked if its ``top`` most frequent values hold at least ``peak`` of its values that are not
    null; there, values with a share below ``rare`` of the average share of the frequent ones are outliers.
    """
    counts = value_counts(cell)
    totals = counts.groupBy("attr").agg(F.sum("cnt").alias("n"), F.least(F.count("*"), F.lit(top)).alias("bins"))
    facts = totals.join(top_values(cell, top).groupBy("attr").agg(F.sum("cnt").alias("held")), "attr")  # one row an attribute
    odd = counts.join(F.broadcast(facts), "attr").where((ratio(F.col("held"), F.col("n")) >= peak) & (F.col("cnt") * F.col("bins") < rare * F.col("held")))
    return cell.join(odd.select("attr", "value"), ["attr", "value"], "left_semi").select("recid", "attr")


# -- flags and changes --------------------------------------------------------------------------------------------


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ismissing_<column> for each column: null or blank."""
    return df.withColumns({f"ismissing_{c}": F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in columns})


def mismatch_flags(df: DataFrame, kinds: dict[str, str], only_flagged: bool = True) -> DataFrame:
    """ismismatched_<column> for each column and its kind of PATTERNS; only rows with a mismatch, if wanted."""
    flags = {f"ismismatched_{c}": valid_pattern(k, F.col(c).cast("string")) == 1 for c, k in kinds.items()}
    out = df.withColumns(flags)
    any_flag = F.lit(False)
    for f in flags:
        any_flag = any_flag | F.col(f)
    return out.where(any_flag) if only_flagged else out


def changed_cells(before: DataFrame, after: DataFrame, clean: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of the cells (recid, attr, value) that a cleaning changed against those that were wrong."""
    b, a, c = (df.select("recid", "attr", F.col("value").alias(n)) for df, n in ((before, "b"), (after, "a"), (clean, "c")))
    both = b.join(a, ["recid", "attr"]).join(c, ["recid", "attr"])
    changed, wrong = ~F.col("b").eqNullSafe(F.col("a")), ~F.col("b").eqNullSafe(F.col("c"))
    counts = both.agg(F.count_if(changed & wrong).alias("tp"), F.count_if(changed & ~wrong).alias("fp"), F.count_if(~changed & wrong).alias("fn"))
    return with_scores(counts)


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 (4 digits; 0 where undefined) to tp, fp, fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(ratio(2 * p * r, p + r), 4)})
