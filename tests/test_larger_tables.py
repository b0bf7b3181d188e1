"""Operators on tables large enough that ranges are sampled and groups of copies count."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.operators import cells as C
from cellwright.operators import duplicates, mining


def test_row_numbers_of_sampled_ranges(spark):
    """Rows and their ranges' counts are of the same ranges, also where a range's bounds come from a sample of a large table."""
    df = spark.range(0, 300_000, 1, 8).select((F.col("id") * 7919 % 300_007).alias("k"), F.col("id").cast("string").alias("text"))
    got = C.with_row_id(df, ["k"]).selectExpr("row_id", "text", "row_number() OVER (ORDER BY k) AS place")
    found = got.selectExpr("count(*) AS n", "count_if(row_id <> place) AS moved", "count(DISTINCT text) AS texts").first()
    assert tuple(found) == (300_000, 0, 300_000)


def test_ngrams_are_dealt_by_key(spark, monkeypatch):
    """As many parts as the table needs; a frequent key, a null key and short or null values give the rows of one plain count."""
    monkeypatch.setattr(mining, "VALUES", 50)
    rows = [(i % 90, f"word {i % 7}") for i in range(300)] + [(7, f"again {i}") for i in range(200)] + [(None, "no key")] * 3 + [(5, "ab"), (6, None)]
    df = spark.createDataFrame(rows, "k int, text string")
    out = mining.ngrams(df, "k", "text", 3)
    want = {}
    for k, text in rows:
        for i in range(len(text or "") - 2):
            want[k, text[i : i + 3]] = want.get((k, text[i : i + 3]), 0) + 1
    assert {(r.k, r.gram): r.cnt for r in out.collect()} == want and out.count() == len(want)
    assert "hashpartitioning(k" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan


COPIES = [(i, "b", ["green apple", "green apples", "Green Apple", "red pear", ""][i % 5]) for i in range(120)] + [(200 + i, "c", None) for i in range(3)]


def test_pairs_of_large_groups_are_not_sorted(spark, monkeypatch):
    """Lists of copies give every pair once; pairs are made in as many parts as they need and are not shuffled after that."""
    monkeypatch.setattr(duplicates, "LIST", 4)
    monkeypatch.setattr(duplicates, "PAIRS", 100)
    df = spark.createDataFrame(COPIES, "id long, block string, name string")
    out = duplicates.duplicate_pairs(df, "id", "block", [], ["name"])
    alike = lambda x, y: x[1] == y[1] and ((x[2] or "") == (y[2] or "") or "pple" in (x[2] or "") and "pple" in (y[2] or ""))
    want = sorted((x[0], y[0]) for x in COPIES for y in COPIES if x[0] < y[0] and alike(x, y))
    assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and out.rdd.getNumPartitions() > 20


def test_scores_of_classes_are_those_of_pairs(spark):
    df = spark.createDataFrame(COPIES, "id long, block string, name string")
    found, true = ("block", [], ["name"], 0.9), ("block", ["name"], ["block"], 0.99)
    want = duplicates.duplicate_scores(*[duplicates.duplicate_pairs(df, "id", *rule) for rule in (found, true)]).first()
    got = duplicates.duplicate_class_scores(df, "id", found, true).first()
    assert got == want and 0 < got.tp < got.tp + got.fp
    back = duplicates.duplicate_class_scores(df, "id", true, found).first()
    assert (back.tp, back.fp, back.fn) == (want.tp, want.fn, want.fp)
    assert duplicates.duplicate_class_scores(df.where("id < 0"), "id", found, true).first().tp == 0
