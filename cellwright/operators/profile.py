"""Column profiles from cells. All statistics of lengths come from one length distribution per attribute."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.samples import hash_share
from cellwright.functions.numeric import ratio


def value_counts(cell: DataFrame) -> DataFrame:
    """attr, value, cnt of the values that are not null."""
    return cell.where("value IS NOT NULL").groupBy("attr", "value").agg(F.count("*").alias("cnt"))


def profile_basic(cell: DataFrame) -> DataFrame:
    """attr, n_rows, n_nulls, n_distinct, pct_nulls, pct_distinct (of all rows). One shuffle by value, one by attribute."""
    by_value = cell.groupBy("attr", "value").agg(F.count("*").alias("cnt"))
    return by_value.groupBy("attr").agg(
        F.sum("cnt").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).alias("n_nulls"), F.count("value").alias("n_distinct")
    ).withColumn("pct_nulls", ratio(100 * F.col("n_nulls"), F.col("n_rows"))).withColumn("pct_distinct", ratio(100 * F.col("n_distinct"), F.col("n_rows")))


def top_values(cell: DataFrame, k: int = 10) -> DataFrame:
    """attr, value, cnt, rnk (from 1, ties by value), probability among the listed ones (4 digits)."""
    by_count = Window.partitionBy("attr").orderBy(F.desc("cnt"), "value")
    top = value_counts(cell).withColumn("rnk", F.row_number().over(by_count)).where(F.col("rnk") <= k)
    return top.withColumn("probability", F.round(F.col("cnt") / F.sum("cnt").over(Window.partitionBy("attr")), 4))


def histograms(cell: DataFrame, k: int = 10) -> DataFrame:
    """attr, top10, freq_top10: arrays in the order of falling frequency."""
    rows = F.sort_array(F.collect_list(F.struct("rnk", "value", "cnt")))
    return top_values(cell, k).groupBy("attr").agg(rows.alias("r")).select("attr", F.col("r.value").alias("top10"), F.col("r.cnt").alias("freq_top10"))


def length_distribution(cell: DataFrame) -> DataFrame:
    """attr, len, cnt of the values that are not null."""
    return cell.where("value IS NOT NULL").groupBy("attr", F.length("value").alias("len")).agg(F.count("*").alias("cnt"))


def common_lengths(lengths: DataFrame) -> DataFrame:
    """attr, len without the rarest tenth (rounded up) where there are ten different lengths or more."""
    rarest = Window.partitionBy("attr").orderBy("cnt", F.desc("len"))
    n = F.count("*").over(Window.partitionBy("attr"))
    ranked = lengths.select("attr", "len", F.row_number().over(rarest).alias("r"), n.alias("n"))
    return ranked.where((F.col("n") < 10) | (F.col("r") > F.ceil(F.col("n") / 10))).select("attr", "len")


def length_stats(lengths: DataFrame) -> DataFrame:
    """attr, min_len, max_len, mean_len, var_len, std_len, median_len, mode_len, q1_len, q3_len, mad_len."""
    weighted = lambda what: F.sum(F.col("cnt") * what)
    n = F.sum("cnt")
    first = lengths.groupBy("attr").agg(
        F.min("len").alias("min_len"), F.max("len").alias("max_len"), (weighted(F.col("len")) / n).alias("mean_len"),
        F.when(n > 1, (weighted(F.col("len") * F.col("len")) - weighted(F.col("len")) * weighted(F.col("len")) / n) / (n - 1)).alias("var_len"),
        F.expr("percentile(len, 0.5, cnt)").alias("median_len"), F.min_by("len", F.struct(-F.col("cnt"), F.col("len"))).alias("mode_len"),
        F.expr("percentile(len, 0.25, cnt)").alias("q1_len"), F.expr("percentile(len, 0.75, cnt)").alias("q3_len"),
    ).withColumn("std_len", F.sqrt("var_len"))
    mad = lengths.join(F.broadcast(first.select("attr", "median_len")), "attr").withColumn("off", F.abs(F.col("len") - F.col("median_len"))).groupBy("attr").agg(F.expr("percentile(off, 0.5, cnt)").alias("mad_len"))
    return first.join(F.broadcast(mad), "attr")


def _cut(lengths: DataFrame, fraction: float) -> DataFrame:
    """With n, cut (values cut off at each end, rounded half up) and cum (values up to this length)."""
    every = Window.partitionBy("attr")
    return lengths.withColumn("n", F.sum("cnt").over(every)).withColumn("cum", F.sum("cnt").over(every.orderBy("len"))).withColumn("cut", F.floor(F.col("n") * (fraction / 2) + 0.5))


def _moments(df: DataFrame, value: str, weight: str, prefix: str) -> DataFrame:
    n, s, ss = F.sum(weight), F.sum(F.col(weight) * F.col(value)), F.sum(F.col(weight) * F.col(value) * F.col(value))
    return df.groupBy("attr").agg((s / n).alias(f"{prefix}_mean"), F.when(n > 1, F.sqrt((ss - s * s / n) / (n - 1))).alias(f"{prefix}_std"))


def trimmed_stats(lengths: DataFrame, fraction: float = 0.2) -> DataFrame:
    """attr, trimmed_mean, trimmed_std of the lengths without half of ``fraction`` at each end."""
    kept = F.greatest(F.lit(0), F.least(F.col("cum"), F.col("n") - F.col("cut")) - F.greatest(F.col("cum") - F.col("cnt"), F.col("cut")))
    return _moments(_cut(lengths, fraction).withColumn("kept", kept).where("kept > 0"), "len", "kept", "trimmed")


def winsorized_stats(lengths: DataFrame, fraction: float = 0.2) -> DataFrame:
    """attr, winsorized_mean, winsorized_std: the values cut off are replaced by the outermost kept ones."""
    every = Window.partitionBy("attr")
    low = F.min(F.when(F.col("cum") > F.col("cut"), F.col("len"))).over(every)
    high = F.max(F.when(F.col("cum") - F.col("cnt") < F.col("n") - F.col("cut"), F.col("len"))).over(every)
    return _moments(_cut(lengths, fraction).withColumn("w", F.least(F.greatest("len", low), high)), "w", "cnt", "winsorized")


def column_profile(cell: DataFrame, k: int = 10, fraction: float = 0.2) -> DataFrame:
    """One row per attribute: all of the above, the common lengths as an array."""
    lengths = length_distribution(cell)
    listed = common_lengths(lengths).groupBy("attr").agg(F.sort_array(F.collect_list("len")).alias("common_lengths"))
    out = profile_basic(cell)
    for part in (histograms(cell, k), length_stats(lengths), trimmed_stats(lengths, fraction), winsorized_stats(lengths, fraction), listed):
        out = out.join(part, "attr", "left")
    return out


def error_rate(diff: DataFrame) -> DataFrame:
    return diff.agg(F.avg("label").alias("error_rate"))


def errors_by_attribute(diff: DataFrame) -> DataFrame:
    """attr, errors, pct_of_errors."""
    per = diff.groupBy("attr").agg(F.sum("label").alias("errors"))
    return per.withColumn("pct_of_errors", ratio(100 * F.col("errors"), F.sum("errors").over(Window.partitionBy(F.lit(1)))))


def class_balance(diff: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    """Share of errors in a sample of cells by hash."""
    return diff.where(hash_share(("recid", "attr"), 100 * fraction, seed)).agg(F.count("*").alias("n"), F.avg("label").alias("error_share"))


def schema_summary(cell: DataFrame) -> DataFrame:
    return cell.agg(F.countDistinct("attr").alias("n_attributes"))


def text_bytes(df: DataFrame) -> DataFrame:
    """Bytes of all rows as text, values joined by commas, nulls left out."""
    return df.agg(F.sum(F.octet_length(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns]))).alias("text_bytes"))


def flag_share_in_errors(features: DataFrame, flags: list[str]) -> DataFrame:
    """attr and, for each flag, its share among the erroneous cells of the attribute."""
    return features.where("label = 1").groupBy("attr").agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags])
