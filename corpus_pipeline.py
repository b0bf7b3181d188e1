"""A pipeline over ``documents``: toxic texts go, one text of each near-duplicate group stays, repeated strings are cut, the rest is packed.

Defined cases: a null text counts as empty; empty texts and rows without a doc_id pass every stage that filters, unless their
score is toxic; a text of any length is worked on whole; of rows that repeat a doc_id and its text one stays, and rows that
repeat a doc_id with other texts are documents of their own; an empty table gives no rows; further columns, whatever their
names, are carried to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm import common, jaccard_join, packing, suffix_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; the model learns from the documents that are not held out."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    name = next(n for n in (f"toxicity_score{'_' * i}" for i in range(99)) if n not in docs.columns)
    return toxicity.with_scores(docs, model, name).where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id, once if its row repeats; documents without words all stay."""
    classes = jaccard_join.near_duplicate_classes(docs).where("doc_id IS NOT NULL")
    per_id = classes.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    odd = per_id.where("rows > 1 OR doc_id <> component_id").select(F.col("doc_id").alias("odd_id_"), (F.col("doc_id") == F.col("component_id")).alias("odd_stays_"))
    joined = docs.join(odd, docs["doc_id"].cast("long") == F.col("odd_id_"), "left")
    repeated = joined.where("odd_stays_").dropDuplicates(["doc_id", "text"])
    return joined.where("odd_id_ IS NULL").unionByName(repeated).drop("odd_id_", "odd_stays_")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every string of 100 bytes that also starts earlier is cut out; ``n_chars`` follows, and texts that the cut empties go; texts null or empty before stay."""
    name = next(n for n in (f"had_text{'_' * i}" for i in range(99)) if n not in docs.columns)
    rest = suffix_dedup.cleaned(docs.withColumn(name, F.coalesce(F.length("text") > 0, F.lit(False))))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.when(F.col(name), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rest.where(~F.col(name) | (F.length("text") > 0)).drop(name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a sequence."""
    return packing.pack_documents(docs).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL can express neither the trained scores nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.saved(docs, f"stage-{name}")
    return docs
