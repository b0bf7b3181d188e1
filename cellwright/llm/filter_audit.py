"""How filters overlap: what each of several filters removes, by the order in which they are applied, and its Shapley share.

A row is what it fails: a set of filters. Rows are counted by that set, at most 2 ** n counts a part, so the table of all
coalitions (how many rows at least one filter of a coalition removes) follows from counts alone, whatever the input's size.
In any order, what a filter removes at its step is the difference between the coalition with it and the one before it.

A filter's Shapley share comes from exact constrained least squares: of all additive shares that sum up to what all filters
remove together, the one that comes closest to the coalitions' removals under the kernel weights
(n - 1) / (C(n, s) s (n - s)). The normal equations with that constraint are solved in rational numbers, so shares are exact.

Defined cases: a null text is empty; any length is read whole; a null language is the part of the empty string; repeated rows
count each; a row without a doc_id is no copy of another, and others are no copies of it; a document is good or toxic if any
of its label rows says so, and a document without labels is neither; an empty table has no parts and gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm.common import saved, table
from cellwright.llm.jaccard_join import spread_join

#: The filters, by their letters.
FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: the failures of A to D, which follow from a text alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def bits(w: Column) -> Column:
        failed = [
            F.size(w) < 200,
            100 * F.size(F.array_distinct(w)) < 50 * F.size(w),
            100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text).cast("long"),
            text.rlike(r"[#$%&*|]"),
        ]
        out = F.lit(0)
        for i, f in enumerate(failed):
            out = out.bitwiseOR(F.when(f, 1 << i).otherwise(0))
        return out

    return F.transform(F.array(words), bits)[0]  # the words are made once


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits in the order of FILTERS), n, good, toxic: rows counted by what they fail.

    The digest of a text stands for it. Copies are counted before they meet: rows of one text fail the same of A to D, and
    those of its smallest doc_id pass E.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    seen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("fails"))
    keys = ["digest", "part", "fails"]
    rows = saved(seen.groupBy("doc_id", *keys).agg(F.count("*").alias("n")), "failures")
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    marked = spread_join(rows, marks, ["doc_id"], "digest").na.fill(0, ["quality", "toxic"])
    # of a text's rows with one part and one pair of marks: all of them, and those of the smallest id
    per_text = marked.groupBy(*keys, "quality", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless")
    )
    # a text has at most one row a part and marks by now; its smallest id may stand in several parts
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("nameless") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    split = per_text.select("part", "fails", "quality", "toxic", "n", passing.alias("passing"))
    both = F.array(F.struct(F.col("fails"), F.col("passing").alias("m")), F.struct(F.col("fails").bitwiseOR(F.lit(1 << FILTERS.index("E"))).alias("fails"), (F.col("n") - F.col("passing")).alias("m")))
    each = split.select("part", "quality", "toxic", F.explode(both).alias("x")).where("x.m > 0")
    return each.groupBy("part", "x.fails").agg(F.sum("x.m").alias("n"), F.sum(F.col("x.m") * F.col("quality")).alias("good"), F.sum(F.col("x.m") * F.col("toxic")).alias("toxic"))


def coalition_removals(fails: list[int], counts: list[int], n: int) -> list[int]:
    """By coalition of n filters (a set of bits): how many of the counted rows at least one of its filters removes."""
    return [sum(c for f, c in zip(fails, counts) if f & s) for s in range(1 << n)]


def solve(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """The solution of a regular system of linear equations, in rational numbers."""
    rows, n = [[*r, y] for r, y in zip(a, b)], len(b)
    for i in range(n):
        pivot = next(k for k in range(i, n) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i and rows[k][i]:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i])]
    return [r[n] for r in rows]


def shapley_shares(removed: list[int], n: int) -> list[Fraction]:
    """Each filter's share of ``removed`` (by coalition): constrained weighted least squares, by its normal equations."""
    if n == 1:
        return [Fraction(removed[1])]
    a, b = [[Fraction(0)] * (n + 1) for _ in range(n + 1)], [Fraction(0)] * (n + 1)
    for s in range(1, (1 << n) - 1):
        members = [i for i in range(n) if s >> i & 1]
        weight = Fraction(n - 1, comb(n, len(members)) * len(members) * (n - len(members)))
        for i in members:
            b[i] += weight * removed[s]
            for k in members:
                a[i][k] += weight
    for i in range(n):  # the constraint and its multiplier
        a[i][n] = a[n][i] = Fraction(1)
    b[n] = Fraction(removed[-1])
    return solve(a, b)[:n]


def audit(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row a part, order of ``filters`` (a letter each) and step: see the module. ``failed``: part, fails, n, good, toxic."""
    n = len(filters)
    orders = list(permutations(range(n)))

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        fails = pdf["fails"].tolist()
        removals = {c: coalition_removals(fails, pdf[c].tolist(), n) for c in COUNTS}
        v, total, full = removals["n"], int(pdf["n"].sum()), (1 << n) - 1
        shares = [len(orders) * x for x in shapley_shares(v, n)]
        out = []
        for order in orders:
            before = 0
            for step, i in enumerate(order, 1):
                after = before | 1 << i
                gone = {c: r[after] - r[before] for c, r in removals.items()}
                out.append((pdf["part"].iloc[0], "".join(filters[k] for k in order), step, total - v[after], gone["n"], v[1 << i] - gone["n"], v[full] - v[full ^ 1 << i], gone["good"], gone["toxic"], int(shares[i])))
                before = after
        return pd.DataFrame(out, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])

    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return failed.groupBy("part").applyInPandas(steps, schema)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: By definition: every order is applied, and a filter's removals are summed over the orders.
ORACLE = r"""
WITH base AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS body FROM documents),
worded AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS smallest FROM base),
marks AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(smallest < w.doc_id, false) THEN 'E' ELSE '' END AS fails
  FROM worded w LEFT JOIN marks m ON w.doc_id = m.doc_id),
counted AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM masks GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
met AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, part, n, good, bad, contains(fails, substr(filter_order, step, 1)) AS failing,
    len(list_intersect(string_split(fails, ''), string_split(substr(filter_order, 1, step - 1), ''))) > 0 AND step > 1 AND fails <> '' AS gone, fails = substr(filter_order, step, 1) AS sole
  FROM steps, counted),
summed AS (SELECT part, filter_order, step, x, sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (NOT gone AND failing) AS removed, sum(n) FILTER (gone AND failing) AS redundant,
    sum(n) FILTER (sole) AS unique_fails, sum(good) FILTER (NOT gone AND failing) AS good_lost, sum(bad) FILTER (NOT gone AND failing) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM summed"""
