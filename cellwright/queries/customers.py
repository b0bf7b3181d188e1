"""The case that most queries run on: customers with their nation and region, and the same table with known errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.operators import cells as C
from cellwright.operators import dependencies, detect
from cellwright.session import table
from cellwright.spec import FD, TableSpec

COLUMNS = ("c_name", "n_name", "r_name", "c_mktsegment", "c_acctbal")
FDS = [FD(("n_name",), ("r_name",))]
SPEC = TableSpec("recid", COLUMNS, {"c_acctbal": "Integer"}, tuple(FDS), ("c_name",))
TOOLS = ["missing", "default_value", "lookup", "fd", "number"]


def clean(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    # 25 nations, 5 regions
    places = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    c = table(spark, d, "customer")
    return c.join(F.broadcast(places), c.c_nationkey == places.n_nationkey).select(
        F.col("c_custkey").alias("recid"), "c_name", "n_name", "r_name", "c_mktsegment", F.col("c_acctbal").cast("decimal(15,2)").cast("string").alias("c_acctbal")
    )


def dirty(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("recid")
    key = lambda m, r: F.pmod(k, F.lit(m)) == r
    segment = F.when(key(17, 2), F.concat("c_mktsegment", F.lit("X"))).when(key(13, 1), "N/A").when(key(11, 0), F.lit(None)).otherwise(F.col("c_mktsegment"))
    region = F.when(key(37, 6), "").when(key(29, 3), F.when(F.col("r_name") == "ASIA", "EUROPE").otherwise("ASIA")).otherwise(F.col("r_name"))
    nation = F.when(key(37, 6), F.concat_ws(" ", "n_name", "r_name")).otherwise(F.col("n_name"))
    name = F.when(key(97, 5), F.concat(F.lit("Customer#"), F.lpad((k - 1).cast("string"), 9, "0"))).otherwise(F.col("c_name"))
    balance = F.when(key(31, 4), F.concat("c_acctbal", F.lit(" USD"))).otherwise(F.col("c_acctbal"))
    return clean(spark, d).select("recid", name.alias("c_name"), nation.alias("n_name"), region.alias("r_name"), segment.alias("c_mktsegment"), balance.alias("c_acctbal"))


def dictionaries(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"n_name": table(spark, d, "nation").select("n_name"), "r_name": table(spark, d, "region").select("r_name")}


def dirty_cells(spark: SparkSession, d: str) -> DataFrame:
    return C.cells(dirty(spark, d), SPEC)


def clean_cells(spark: SparkSession, d: str) -> DataFrame:
    return C.cells(clean(spark, d), SPEC)


def diff(spark: SparkSession, d: str) -> DataFrame:
    return C.cell_diff(clean(spark, d), dirty(spark, d), SPEC)


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """recid, attr, label and five votes of 0 and 1."""
    df = dirty(spark, d)
    cell = C.cells(df, SPEC)
    voted = detect.lookup(cell, dictionaries(spark, d))
    marks = dependencies.fd_violations(df, "recid", FDS).withColumn("fd", F.lit(1))
    labels = diff(spark, d).select("recid", "attr", "label")
    hit = lambda c, name: (c == 1).cast("int").alias(name)
    out = voted.join(marks, ["recid", "attr"], "left").select("recid", "attr", hit(detect.missing(), "missing"), hit(detect.default_value(SPEC), "default_value"), hit(F.col("ec_lookup"), "lookup"), F.coalesce("fd", F.lit(0)).alias("fd"), hit(detect.valid_number(SPEC), "number"))
    return labels.join(out, ["recid", "attr"])


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """recid, attr, value, prediction: the union of all votes."""
    votes = matrix(spark, d).select("recid", "attr", F.greatest(*TOOLS).alias("prediction"))
    return dirty_cells(spark, d).join(votes, ["recid", "attr"])


def long_sql(name: str, columns: tuple[str, ...] = COLUMNS) -> str:
    return " UNION ALL ".join(f"SELECT recid, '{c}' AS attr, {c} AS value FROM {name}" for c in columns)


#: The same tables in SQL; a query's own SQL follows.
BASE = f"""
WITH clean AS (
  SELECT c_custkey AS recid, c_name, n_name, r_name, c_mktsegment, CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) AS c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
dirty AS (
  SELECT recid,
    CASE WHEN recid % 97 = 5 THEN 'Customer#' || lpad(CAST(recid - 1 AS VARCHAR), 9, '0') ELSE c_name END AS c_name,
    CASE WHEN recid % 37 = 6 THEN n_name || ' ' || r_name ELSE n_name END AS n_name,
    CASE WHEN recid % 37 = 6 THEN '' WHEN recid % 29 = 3 THEN CASE WHEN r_name = 'ASIA' THEN 'EUROPE' ELSE 'ASIA' END ELSE r_name END AS r_name,
    CASE WHEN recid % 17 = 2 THEN c_mktsegment || 'X' WHEN recid % 13 = 1 THEN 'N/A' WHEN recid % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
    CASE WHEN recid % 31 = 4 THEN c_acctbal || ' USD' ELSE c_acctbal END AS c_acctbal
  FROM clean),
cells AS ({long_sql("dirty")}),
ccells AS ({long_sql("clean")}),
diff AS (SELECT recid, attr, d.value AS dirty_value, c.value AS clean_value, CAST(d.value IS DISTINCT FROM c.value AS INTEGER) AS label
         FROM cells d JOIN ccells c USING (recid, attr)),
vc AS (SELECT attr, value, count(*) AS cnt FROM cells WHERE value IS NOT NULL GROUP BY ALL),
basic AS (SELECT attr, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL) AS n_nulls, count(DISTINCT value) AS n_distinct FROM cells GROUP BY attr),
ranked AS (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY cnt DESC, value) AS rnk FROM vc),
top AS (SELECT * FROM ranked WHERE rnk <= 10),
lens AS (SELECT attr, length(value) AS len, count(*) AS cnt FROM cells WHERE value IS NOT NULL GROUP BY ALL),
lrank AS (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY cnt, len DESC) AS r, count(*) OVER (PARTITION BY attr) AS n FROM lens),
clens AS (SELECT attr, len FROM lrank WHERE n < 10 OR r > ceil(n / 10)),
lraw AS (SELECT attr, length(value) AS len FROM cells WHERE value IS NOT NULL),
lstat AS (SELECT attr, min(len) AS min_len, max(len) AS max_len, avg(len) AS mean_len, var_samp(len) AS var_len, stddev_samp(len) AS std_len,
          quantile_cont(len, 0.5) AS median_len, quantile_cont(len, 0.25) AS q1_len, quantile_cont(len, 0.75) AS q3_len FROM lraw GROUP BY attr),
lmad AS (SELECT attr, quantile_cont(abs(len - median_len), 0.5) AS mad_len FROM lraw JOIN lstat USING (attr) GROUP BY attr),
lmode AS (SELECT attr, arg_min(len, (-cnt, len)) AS mode_len FROM lens GROUP BY attr),
cutting AS (SELECT attr, len, row_number() OVER (PARTITION BY attr ORDER BY len) AS r, count(*) OVER (PARTITION BY attr) AS n FROM lraw),
cuts AS (SELECT *, floor(n * 0.1 + 0.5) AS cut FROM cutting),
trimmed AS (SELECT attr, avg(len) AS trimmed_mean, stddev_samp(len) AS trimmed_std FROM cuts WHERE r > cut AND r <= n - cut GROUP BY attr),
borders AS (SELECT attr, min(len) FILTER (WHERE r > cut AND r <= n - cut) AS lo, max(len) FILTER (WHERE r > cut AND r <= n - cut) AS hi FROM cuts GROUP BY attr),
winsorized AS (SELECT attr, avg(least(greatest(len, lo), hi)) AS winsorized_mean, stddev_samp(least(greatest(len, lo), hi)) AS winsorized_std FROM cuts JOIN borders USING (attr) GROUP BY attr),
badfd AS (SELECT n_name FROM dirty GROUP BY n_name HAVING count(DISTINCT r_name) <> 1),
m AS (SELECT recid, attr, label, CAST(value IS NULL AS INTEGER) AS missing,
        CAST(coalesce(attr <> 'c_acctbal' AND lower(value) IN ('not available','-','--','n/a','unknown','null','not provided by airline','(none assigned)','dimensions unavailable')
             OR attr = 'c_acctbal' AND lower(value) IN ('not available','-','--','n/a','unknown','null','nan'), false) AS INTEGER) AS default_value,
        CAST(attr = 'n_name' AND NOT coalesce(upper(trim(value)) IN (SELECT upper(trim(n_name)) FROM nation), false)
             OR attr = 'r_name' AND NOT coalesce(upper(trim(value)) IN (SELECT upper(trim(r_name)) FROM region), false) AS INTEGER) AS lookup,
        CAST(attr = 'r_name' AND recid IN (SELECT recid FROM dirty JOIN badfd USING (n_name)) AS INTEGER) AS fd,
        CAST(coalesce(attr = 'c_acctbal' AND NOT regexp_full_match(value, '(0|[1-9][0-9]*)(\\.[0-9]+)?|\\.[0-9]+'), false) AS INTEGER) AS number
      FROM cells JOIN diff USING (recid, attr)),
pred AS (SELECT recid, attr, value, greatest(missing, default_value, lookup, fd, number) AS prediction FROM m JOIN cells USING (recid, attr))
"""


def sql(text: str) -> str:
    """``text`` over the tables of BASE; further tables may be added as ``, name AS (...)`` before its SELECT."""
    return BASE + text


def scores_sql(source: str) -> str:
    """Counts tp, fp, fn of ``source`` with the scores of ``with_scores``."""
    return f"""SELECT *, round(CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS "precision", round(CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
  round(CASE WHEN tp <> 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 4) AS f1 FROM ({source})"""


def all_scores_sql(source: str) -> str:
    return f"""SELECT *, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, fp + fn AS wrong FROM ({scores_sql(source)})"""
