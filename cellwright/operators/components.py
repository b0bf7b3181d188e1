"""Joins in which one value may hold a large share of the rows, and connected components by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.operators.cells import DICTIONARY_ROWS
from cellwright.session import saved

#: Parts over which the rows of a key are dealt.
PARTS = 64


def join_facts(many: DataFrame, one: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Left join of ``many`` with ``one``, which has one row a key and is best a written table.

    Up to DICTIONARY_ROWS rows of ``one`` are broadcast, by their counted number. Beyond that, keys that ``many`` repeats
    often are dealt over PARTS parts by ``by``, each with that key's row; the others meet in one part as usual.
    """
    if one.limit(DICTIONARY_ROWS + 1).count() <= DICTIONARY_ROWS:
        return many.join(F.broadcast(one), keys, "left")
    often = many.groupBy(*keys).count().where(F.col("count") > DICTIONARY_ROWS // PARTS).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part_"))
    dealt = many.withColumn("part_", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")).join(often.withColumn("often_", F.lit(True)), [*keys, "part_"], "left")
    left = dealt.withColumn("part_", F.when(F.col("often_"), F.col("part_")).otherwise(0)).drop("often_")
    right = one.join(often, keys, "left").withColumn("part_", F.coalesce("part_", F.lit(0)))
    return left.join(right, [*keys, "part_"], "left").drop("part_")


def smallest_connected(links: DataFrame) -> DataFrame:
    """node, component: for every node of the links (a, b) the smallest node that it is connected with.

    Each round a node takes the smallest label among its neighbours and then that label's own label, so rounds grow with
    the logarithm of the longest chain. Every round is a written table.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "components")
    while True:
        heard = join_facts(both, labels.withColumnRenamed("node", "b"), ["b"], "a").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("label"))
        further = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        new = saved(join_facts(near, further, ["label"], "node").select("node", "old", F.least("label", "further").alias("component")), "components")
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
