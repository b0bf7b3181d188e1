"""Readers and writers of tables; every column of a text source is a string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.operators.cells import with_row_id


#: A field without quotes and text is null, one with quotes is empty; the marker for the former is no text that files hold.
_EMPTY_ON_READING = {"nullValue": "\x00null\x00", "emptyValue": ""}


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, header: bool = True, sep: str = ",", skip_lines: int = 0, format: str = "csv") -> DataFrame:
    """A CSV or TSV (all strings), or any format Spark reads; columns are renamed by position.

    skip_lines: lines of a preamble before the data (and the header) of each file; needs ``columns``. Lines are told
    apart by their place in the file, so files need not be ordered and are read once.
    """
    if format != "csv":
        df = spark.read.format(format).load(path)
        return df.toDF(*columns) if columns else df
    if skip_lines:
        if not columns:
            raise ValueError("skip_lines needs columns")
        return _after_preamble(spark, path, columns, header, sep, skip_lines)
    reader = spark.read.option("header", header).option("sep", sep).options(**_EMPTY_ON_READING)
    if columns and not header:
        return reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)
    df = reader.csv(path)
    return df.toDF(*columns) if columns else df


def _after_preamble(spark: SparkSession, path: str, columns: list[str], header: bool, sep: str, skip: int) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    # only a file's first block holds its first lines
    first = lines.where("block = 0").groupBy("file").agg(F.min("n").alias("start"))
    kept = lines.join(F.broadcast(first), "file").where((F.col("block") > 0) | (F.col("n") - F.col("start") >= skip + int(header)))
    schema = ", ".join(f"`{c}` string" for c in columns)
    return kept.select(F.from_csv("value", schema, {"sep": sep}).alias("r")).select("r.*")


def ingest_pairs(spark: SparkSession, dirty: str, truth: str, key: list[str], columns: list[str], file_key: str = r"([^/]+?)(?:\.[^./]*)?$", sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(dirty, clean) with a common ``row_id``: files of both folders are matched by name, rows by key."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def one(path: str) -> DataFrame:
        df = spark.read.option("sep", sep).schema(schema).csv(path)
        return df.withColumn("file_", F.regexp_extract(F.col("_metadata.file_path"), file_key, 1))

    d, t = one(dirty), one(truth)
    rest = [c for c in columns if c not in key]
    both = d.join(t.select("file_", *key, *[F.col(c).alias(f"{c}_true_") for c in rest]), ["file_", *key])
    numbered = with_row_id(both, ["file_", *key, *rest])
    return numbered.select("row_id", *columns), numbered.select("row_id", *key, *[F.col(f"{c}_true_").alias(c) for c in rest]).select("row_id", *columns)


PROFILE_SCHEMA = (
    "columnCombination struct<columnIdentifiers: array<struct<columnIdentifier: string>>>, statisticMap struct<"
    "`Nulls`: struct<value: bigint>, `Percentage of Nulls`: struct<value: double>, `Percentage of Distinct Values`: struct<value: double>, "
    "`Number of Tuples`: struct<value: bigint>, `Top 10 frequent items`: struct<value: array<string>>, `Frequency Of Top 10 Frequent Items`: struct<value: array<string>>>"
)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """attr, n_nulls, pct_nulls, pct_distinct, n_rows, top10, freq_top10 from a JSON column profile; quotes around names go."""
    raw = spark.read.schema(PROFILE_SCHEMA).json(path)
    s = F.col("statisticMap")
    attr = F.regexp_replace(F.element_at("columnCombination.columnIdentifiers", 1)["columnIdentifier"], '^"|"$', "")
    return raw.select(
        attr.alias("attr"), s["Nulls"]["value"].alias("n_nulls"), s["Percentage of Nulls"]["value"].alias("pct_nulls"), s["Percentage of Distinct Values"]["value"].alias("pct_distinct"),
        s["Number of Tuples"]["value"].alias("n_rows"), s["Top 10 frequent items"]["value"].alias("top10"), s["Frequency Of Top 10 Frequent Items"]["value"].cast("array<bigint>").alias("freq_top10"),
    )


def read_jdbc(spark: SparkSession, url: str, dbtable: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **properties: str) -> DataFrame:
    """A table over JDBC; with a partition column and its bounds it is read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable).options(**properties)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def read_libsvm(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", features) if features else reader).load(path)


def to_libsvm_rows(matrix: DataFrame, tools: list[str]) -> DataFrame:
    """value: ``label i:1 j:1 ...`` of every cell with at least one vote."""
    places = F.filter(F.array(*[F.when(F.col(t) == 1, F.lit(i)) for i, t in enumerate(tools, 1)]), lambda p: p.isNotNull())
    text = F.concat_ws(" ", F.col("label").cast("string"), F.transform("places", lambda p: F.concat(p.cast("string"), F.lit(":1"))))
    return matrix.withColumn("places", places).where(F.size("places") > 0).select(text.alias("value"))


def write_table(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "overwrite") -> None:
    """CSV or TSV in as many files as the table has partitions; ``read_table`` tells its nulls from its empty strings."""
    df.write.mode(mode).option("header", header).option("sep", sep).options(nullValue="", emptyValue='""').csv(path)


def read_lookup(spark: SparkSession, path: str, attr: str) -> DataFrame:
    """A file of one value a line as the dictionary of an attribute."""
    return spark.read.text(path).select(F.col("value").alias(f"lookup-{attr}"))


def dictionary_sets(dictionary: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """For each column its different values."""
    return {c: dictionary.select(c).where(F.col(c).isNotNull()).distinct() for c in columns}


def export_hits(matrix: DataFrame, tool: str) -> DataFrame:
    """hit: ``record-attribute`` of every cell a tool flags."""
    return matrix.where(F.col(tool) == 1).select(F.concat_ws("-", F.col("recid").cast("string"), "attr").alias("hit"))
