"""Wide tables as cells (record, attribute, value), labels, and votes per cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.session import saved
from cellwright.spec import TableSpec


def cells(df: DataFrame, spec: TableSpec, with_id: bool = False) -> DataFrame:
    """recid, attr, value (text): one row per cell, nulls included, in one pass over the table."""
    spec.check(df)
    names = ([spec.record_id] if with_id else []) + list(spec.columns)
    wide = df.select(F.col(spec.record_id).alias("recid"), *[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(names)])
    long = wide.unpivot("recid", [f"v{i}" for i in range(len(names))], "place", "value")
    return long.select("recid", _lookup({f"v{i}": c for i, c in enumerate(names)}, F.col("place")).alias("attr"), "value")


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def attribute_index(df: DataFrame, spec: TableSpec, attr: str = "attr") -> DataFrame:
    """Adds attr_nr: place of the attribute from 1, whatever its case; 0 if unknown."""
    numbers = {c.lower(): i for i, c in enumerate(spec.columns, 1)}
    key = F.create_map(*[x for k, v in numbers.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn("attr_nr", F.coalesce(key[F.lower(F.col(attr))], F.lit(0)))


def attribute_name(df: DataFrame, spec: TableSpec, number: str = "attr_nr") -> DataFrame:
    """Adds attr: the name at a place from 1; null if there is none."""
    key = F.create_map(*[x for i, c in enumerate(spec.columns, 1) for x in (F.lit(i), F.lit(c))])
    return df.withColumn("attr", key[F.col(number)])


def cell_diff(clean: DataFrame, dirty: DataFrame, spec: TableSpec, mode: str = "diff") -> DataFrame:
    """recid, attr, dirty_value, clean_value, label.

    mode diff: 1 where the values differ, null-safe. mode gold: 1 only where the clean value is neither null nor
    empty and the values differ.
    """
    both = cells(dirty, spec).withColumnRenamed("value", "dirty_value").join(cells(clean, spec).withColumnRenamed("value", "clean_value"), ["recid", "attr"])
    differs = ~F.col("dirty_value").eqNullSafe(F.col("clean_value"))
    if mode == "gold":
        differs = differs & (F.coalesce(F.col("clean_value"), F.lit("")) != "")
    return both.withColumn("label", differs.cast("int"))


def with_row_id(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """A row number from 1 over a stable order. Ranges are numbered apart; only one count per range is gathered.

    The ranges are written once: their bounds come from a sample, so rows and counts must not each draw their own.
    """
    ranged = saved(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("inside_", F.row_number().over(Window.partitionBy("range_").orderBy(*order)))
    counts = ranged.groupBy("range_").agg(F.count("*").alias("n_"))  # one row a partition
    before = counts.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("range_", "before_")), "range_").withColumn(name, F.col("before_") + F.col("inside_")).drop("range_", "inside_", "before_")


def gold_by_position(clean: DataFrame, dirty: DataFrame, spec: TableSpec, order: list[str], mode: str = "gold") -> DataFrame:
    """``cell_diff`` of tables without a common key, matched by their row number over ``order``."""
    numbered = TableSpec("row_id", spec.columns)
    pick = lambda df: with_row_id(df, order).select("row_id", *spec.columns)
    return cell_diff(pick(clean), pick(dirty), numbered, mode)


def error_cells(diff: DataFrame) -> DataFrame:
    return diff.where("label = 1").select("recid", "attr")


def dirty_records(clean: DataFrame, dirty: DataFrame, spec: TableSpec) -> DataFrame:
    """recid of the records with any differing attribute."""
    spec.check(clean).check(dirty)
    a, b = clean.alias("a"), dirty.alias("b")
    differs = reduce(lambda x, y: x | y, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in spec.columns])
    return a.join(b, F.col(f"a.{spec.record_id}") == F.col(f"b.{spec.record_id}")).where(differs).select(F.col(f"a.{spec.record_id}").alias("recid"))


def vote_column(base: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``base`` with a column: 1 where the cell is in ``found``, else 0."""
    marks = found.select("recid", "attr").distinct().withColumn("hit_", F.lit(1))
    return base.join(marks, ["recid", "attr"], "left").withColumn(name, F.coalesce("hit_", F.lit(0))).drop("hit_")


def vote_matrix(gold: DataFrame, tools: dict[str, DataFrame]) -> DataFrame:
    """recid, attr, label and one 0/1 column for each tool, by one aggregation over all tools' cells."""
    tagged = reduce(DataFrame.unionByName, [df.select("recid", "attr").withColumn("tool_", F.lit(name)) for name, df in tools.items()])
    hits = tagged.groupBy("recid", "attr").agg(*[F.max((F.col("tool_") == n).cast("int")).alias(n) for n in tools])
    return gold.select("recid", "attr", "label").join(hits, ["recid", "attr"], "left").na.fill(0, list(tools))


def truth_matrix(matrix: DataFrame, tools: list[str]) -> DataFrame:
    """Every vote replaced by whether it equals the label."""
    return matrix.select("recid", "attr", "label", *[(F.col(t) == F.col("label")).cast("int").alias(t) for t in tools])


def vote_triplets(matrix: DataFrame, tools: list[str], ternary: bool = True) -> DataFrame:
    """recid, attr, annotator (from 1), y (0 or 1), label: one row for each vote that applies."""
    votes = matrix.select("recid", "attr", "label", *[F.col(t).cast("int").alias(t) for t in tools]).unpivot(["recid", "attr", "label"], tools, "tool", "vote")
    if ternary:
        votes = votes.where("vote <> 0")
    number = F.create_map(*[x for i, t in enumerate(tools, 1) for x in (F.lit(t), F.lit(i))])
    return votes.select("recid", "attr", number[F.col("tool")].alias("annotator"), F.when(F.col("vote") == 1, 1).otherwise(0).alias("y"), "label")


def tuple_maps(cell: DataFrame) -> DataFrame:
    """recid, attributes: map from attribute to value."""
    entries = F.sort_array(F.collect_list(F.struct("attr", "value")))
    return cell.groupBy("recid").agg(F.map_from_entries(entries).alias("attributes"))


def tuple_features(cell: DataFrame) -> DataFrame:
    """recid, attr, feature: every cell with the ``attribute=value`` of each cell of its record."""
    others = cell.where("value IS NOT NULL").select("recid", F.concat_ws("=", "attr", "value").alias("feature"))
    return cell.select("recid", "attr").join(others, "recid")


#: Rows of a dictionary up to which every tuple is paired with it by broadcast; larger ones are joined by block.
DICTIONARY_ROWS = 100_000


def dictionary_candidates(cell: DataFrame, dictionary: DataFrame, attr: str, column: str) -> DataFrame:
    """recid, attr, candidate: each cell of one attribute with every value of a dictionary of a checked size.

    The output is cells times dictionary by definition; a dictionary above DICTIONARY_ROWS is refused.
    """
    values = dictionary.select(F.col(column).cast("string").alias("candidate")).distinct()
    if values.limit(DICTIONARY_ROWS + 1).count() > DICTIONARY_ROWS:
        raise ValueError(f"more than {DICTIONARY_ROWS} dictionary values; prune them first")
    listed = values.agg(F.sort_array(F.collect_list("candidate")).alias("listed"))
    return cell.where(F.col("attr") == attr).select("recid", "attr").join(F.broadcast(listed)).select("recid", "attr", F.explode("listed").alias("candidate"))


def cells_from_marks(df: DataFrame, spec: TableSpec, mark: str = "~") -> DataFrame:
    """recid, attr of cells whose value holds the mark; marks in ids are removed."""
    wide = df.withColumn(spec.record_id, F.replace(F.col(spec.record_id).cast("string"), F.lit(mark), F.lit("")))
    return cells(wide, spec).where(F.contains("value", F.lit(mark))).select("recid", "attr")


def cells_from_flags(df: DataFrame, record_id: str, prefix: str) -> DataFrame:
    """recid, attr for each column prefix + attr that says true."""
    flags = [c for c in df.columns if c.startswith(prefix)]
    long = df.select(F.col(record_id).alias("recid"), *[F.lower(F.col(c).cast("string")).alias(c) for c in flags]).unpivot("recid", flags, "flag", "says")
    return long.where("says = 'true'").select("recid", F.substring("flag", len(prefix) + 1, 10_000).alias("attr"))


def cells_from_violations(violations: DataFrame, df: DataFrame, spec: TableSpec, tuple_id: str = "tupleid", attribute: str = "attribute") -> DataFrame:
    """Distinct cells of a violation log whose records are in the table and whose attribute is known."""
    named = violations.select(F.col(tuple_id).alias("recid"), F.col(attribute).alias("attr")).where(F.col("attr").isin(*spec.columns)).distinct()
    return named.join(df.select(F.col(spec.record_id).alias("recid")), "recid", "left_semi")


def expand_records(ids: DataFrame, spec: TableSpec) -> DataFrame:
    """Every record as all its cells."""
    return ids.select("recid", F.explode(F.array(*[F.lit(c) for c in spec.columns])).alias("attr"))


def topk_prefixes(scores: DataFrame, column: str = "expectations") -> DataFrame:
    """dataset, k, tools: from lists ``id:score|id:score`` the sets of the k best tools for each k, each set once."""
    parts = scores.select("dataset", "algorithm", F.explode(F.split(column, "\\|")).alias("part"))
    one = parts.select("dataset", "algorithm", F.split_part("part", F.lit(":"), F.lit(1)).cast("int").alias("tool"), F.split_part("part", F.lit(":"), F.lit(2)).cast("double").alias("score"))
    growing = Window.partitionBy("dataset", "algorithm").orderBy(F.desc("score"), "tool")
    sets = one.select("dataset", "algorithm", F.row_number().over(growing).alias("k"), F.sort_array(F.collect_list("tool").over(growing.rowsBetween(Window.unboundedPreceding, 0))).alias("tools"))
    return sets.groupBy("dataset", "k", F.array_join(F.transform("tools", lambda t: t.cast("string")), ",").alias("tools")).agg(F.array_join(F.sort_array(F.collect_set("algorithm")), ",").alias("algorithms"))
