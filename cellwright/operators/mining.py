"""Patterns in tables: rules between values, sequences, near-duplicate texts, n-grams."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.functions.text import char_ngrams

#: Values whose n-grams one part counts.
VALUES = 20_000


def association_rules(cell: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """antecedent, consequent, confidence, lift, support between ``attribute=value`` items of a record."""
    items = cell.where("value IS NOT NULL").groupBy("recid").agg(F.array_sort(F.collect_set(F.concat_ws("=", "attr", "value"))).alias("items"))
    return FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).associationRules


def frequent_sequences(df: DataFrame, key: str, order: str, item: str, min_support: float = 0.1, longest: int = 4) -> DataFrame:
    """sequence, freq of the items by key, in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i"))))
    sequences = df.groupBy(key).agg(F.transform(rows, lambda r: F.array(r["i"])).alias("sequence"))
    return PrefixSpan(minSupport=min_support, maxPatternLength=longest).findFrequentSequentialPatterns(sequences)


def near_duplicates(df: DataFrame, key: str, text: str, distance: float = 0.3, n: int = 3, block: int = 1000) -> DataFrame:
    """a, b, distance: exact self-join of texts by the Jaccard distance, below ``distance``, of their sets of character n-grams.

    Equal texts (in lower case) are compared once: the smallest key stands for them in the pairs (a < b), and every other
    key is a row (smallest key, key, 0). A text shorter than n is one gram; null texts take no part. Two texts can only
    be near if they share one of their rarest grams; grams (as 64-bit hashes) that many texts share are dealt over a grid
    of blocks. Rows of the join carry their texts' grams, so this is for values, not for long documents.
    """
    rows = df.select(F.col(key).alias("key"), F.lower(text).alias("t")).where("t IS NOT NULL")
    one = rows.groupBy("t").agg(F.min("key").alias("id"))
    copies = rows.join(one, "t").where("key <> id").select(F.col("id").alias("a"), F.col("key").alias("b"), F.lit(0.0).alias("distance"))
    grams = F.when(F.length("t") < n, F.array("t")).otherwise(char_ngrams(F.col("t"), n))
    single = one.select("id", F.explode(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g)))).alias("gram"))
    rare_first = F.sort_array(F.collect_list(F.struct("cnt", "gram")))["gram"]
    sets = single.join(single.groupBy("gram").agg(F.count("*").alias("cnt")), "gram").groupBy("id").agg(rare_first.alias("grams"))
    size = F.size("grams")
    held = sets.select("id", "grams", F.explode(F.slice("grams", F.lit(1), size - F.greatest(F.ceil(size * (1 - distance) - 1e-9), F.lit(1)).cast("int") + 1)).alias("gram"))
    parts = held.groupBy("gram").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    cut = held.join(parts, "gram").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x = cut.select("gram", F.col("own").alias("i"), every.alias("j"), F.col("id").alias("a"), F.col("grams").alias("x"))
    y = cut.select("gram", F.col("own").alias("j"), every.alias("i"), F.col("id").alias("b"), F.col("grams").alias("y"))
    alike = (F.size("x") >= F.size("y") * (1 - distance) - 1e-9) & (F.size("y") >= F.size("x") * (1 - distance) - 1e-9)
    met = x.join(y, ["gram", "i", "j"]).where((F.col("a") < F.col("b")) & alike)
    common = F.size(F.array_intersect("x", "y"))
    pairs = met.select("a", "b", (1 - common / (F.size("x") + F.size("y") - common)).alias("distance")).where(F.col("distance") < distance).distinct()
    return pairs.unionByName(copies)


def ngrams(df: DataFrame, key: str, column: str, n: int) -> DataFrame:
    """key, gram, cnt of the character n-grams of each value.

    Rows are dealt by key, about VALUES a part, and a part counts its grams where they are made: only rows move, not grams.
    Keys of more than VALUES rows are counted by key and gram instead, so that they meet in many parts.
    """
    rows = df.select(F.col(key).alias(key), F.col(column).alias("value_"))
    grams = lambda of: of.select(key, F.explode(char_ngrams(F.col("value_"), n)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("cnt"))
    parts = rows.count() // VALUES + 1
    often = rows.groupBy(key).count().where(F.col("count") > VALUES).select(F.col(key).alias("often_"))
    frequent = F.broadcast(often)  # at most one of VALUES rows
    same = F.col(key).eqNullSafe(F.col("often_"))
    return grams(rows.join(frequent, same, "left_anti").repartition(parts, key)).unionByName(grams(rows.join(frequent, same, "left_semi").repartition(parts)))
