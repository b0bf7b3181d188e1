"""Repairs, error injection, pattern mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.functions.samples import hash_share_sql
from cellwright.operators import cells as C
from cellwright.operators import inject, mining, repair
from cellwright.queries import customers as U
from cellwright.queries.registry import query
from cellwright.session import saved, table
from cellwright.spec import FD



def _repaired_table(spark, d):
    df = U.dirty(spark, d)
    keep = lambda c, when, v: F.when(when, v).otherwise(repair.NO_REPAIR).alias(c)
    return df.select(
        "recid", *[F.lit(repair.NO_REPAIR).alias(c) for c in ("c_name", "n_name")], keep("r_name", F.col("r_name") == "", F.lit("ASIA")), keep("c_mktsegment", F.col("c_mktsegment") == "N/A", F.lit("BUILDING")),
        keep("c_acctbal", F.col("c_acctbal").endswith(" USD"), F.replace("c_acctbal", F.lit(" USD"), F.lit(""))),
    )


_LOG = """(SELECT recid, 'r_name' AS attr, 'ASIA' AS new_value FROM dirty WHERE r_name = '' UNION ALL SELECT recid, 'c_mktsegment', 'BUILDING' FROM dirty WHERE c_mktsegment = 'N/A'
 UNION ALL SELECT recid, 'c_acctbal', replace(c_acctbal, ' USD', '') FROM dirty WHERE c_acctbal LIKE '% USD')"""


@query("J1_repair_log", U.sql(f"SELECT * FROM {_LOG}"))
def j1(spark, d):
    return repair.repair_log(_repaired_table(spark, d), U.SPEC)


_AUDIT = "SELECT recid, 'r_name' AS attr, CASE WHEN recid % 2 = 0 THEN 'second' ELSE 'first' END AS new_value FROM dirty WHERE recid % 29 = 3"


def _audit(spark, d):
    df = U.dirty(spark, d).where(F.col("recid") % 29 == 3).select(F.col("recid").alias("tupleid"), F.lit("r_name").alias("attribute"))
    first = df.select("*", F.lit("first").alias("newvalue"), F.lit(1).alias("time"))
    return first.unionByName(df.where(F.col("tupleid") % 2 == 0).select("*", F.lit("second").alias("newvalue"), F.lit(2).alias("time"))).unionByName(first.withColumn("tupleid", F.col("tupleid") + 100_000_000))


@query("J2_repair_log_from_audit", U.sql(_AUDIT))
def j2(spark, d):
    return repair.repair_log_from_audit(_audit(spark, d), U.dirty(spark, d), U.SPEC)


@query("J3_impute_by_group", U.sql(", g AS (SELECT n_name, min(c_mktsegment) FILTER (WHERE trim(c_mktsegment) <> '') AS v FROM dirty GROUP BY 1) SELECT recid, CASE WHEN c_mktsegment IS NULL OR trim(c_mktsegment) = '' THEN v ELSE '#NO-REPAIR#' END AS c_mktsegment FROM dirty JOIN g USING (n_name)"))
def j3(spark, d):
    return repair.impute_by_group(U.dirty(spark, d), "n_name", ["c_mktsegment"]).select("recid", "c_mktsegment")


@query("J4_merge_repairs", U.sql(f"SELECT recid, attr, coalesce(a.new_value, '#NO-REPAIR#') AS log_a, coalesce(b.new_value, '#NO-REPAIR#') AS log_b FROM {_LOG} a FULL JOIN ({_AUDIT}) b USING (recid, attr)"))
def j4(spark, d):
    return repair.merge_repairs({"log_a": repair.repair_log(_repaired_table(spark, d), U.SPEC), "log_b": repair.repair_log_from_audit(_audit(spark, d), U.dirty(spark, d), U.SPEC)})


_DOMAIN = "SELECT attr, value, count(*) AS cnt FROM pred WHERE prediction = 0 AND value IS NOT NULL GROUP BY ALL"


@query("J5_clean_domain", U.sql(_DOMAIN))
def j5(spark, d):
    return repair.clean_domain(U.predicted(spark, d))


_REP_FDS = [FD(("c_mktsegment",), ("n_name",))]
_FD_REPAIRS = """, bad AS (SELECT * FROM pred WHERE prediction = 1), known AS (SELECT DISTINCT c_mktsegment AS k, n_name AS candidate FROM dirty WHERE n_name IS NOT NULL AND recid NOT IN (SELECT recid FROM bad WHERE attr IN ('c_mktsegment', 'n_name')))
, fdr AS (SELECT DISTINCT d.recid, 'n_name' AS attr, candidate FROM dirty d JOIN known ON k = c_mktsegment WHERE d.recid IN (SELECT recid FROM bad WHERE attr = 'n_name'))"""


@query("J6_fd_repairs", U.sql(_FD_REPAIRS + " SELECT * FROM fdr"))
def j6(spark, d):
    return repair.fd_repairs(U.predicted(spark, d), U.dirty(spark, d), "recid", _REP_FDS)


@query("J7_histogram_repairs", U.sql("SELECT p.recid, p.attr, t.value AS candidate FROM pred p JOIN top t USING (attr) WHERE prediction = 1"))
def j7(spark, d):
    return repair.histogram_repairs(U.predicted(spark, d))


_CANDIDATES = _FD_REPAIRS + f""", cand AS (SELECT recid, attr, 'fd' AS source, candidate FROM fdr UNION ALL SELECT p.recid, p.attr, 'histogram', t.value FROM pred p JOIN top t USING (attr) WHERE prediction = 1
 UNION ALL SELECT recid, attr, 'log', new_value FROM {_LOG})"""


def _candidates(spark, d):
    p = U.predicted(spark, d)
    fd = repair.fd_repairs(p, U.dirty(spark, d), "recid", _REP_FDS).withColumn("source", F.lit("fd"))
    hist = repair.histogram_repairs(p).withColumn("source", F.lit("histogram"))
    log = repair.repair_log(_repaired_table(spark, d), U.SPEC).withColumnRenamed("new_value", "candidate").withColumn("source", F.lit("log"))
    return fd.unionByName(hist).unionByName(log)


_COMBINED = _CANDIDATES + """, sh AS (SELECT recid, attr, lower(candidate) AS candidate, count(DISTINCT source) / 5.0::DOUBLE AS share FROM cand WHERE candidate IS NOT NULL GROUP BY ALL),
 kept AS (SELECT *, max(share) OVER (PARTITION BY recid, attr) AS t FROM sh), combined AS (SELECT recid, attr, list(candidate ORDER BY share DESC, candidate) AS vals FROM kept WHERE t <= 0.2 OR share > 0.2 GROUP BY ALL)"""


@query("J8_combine_repairs", U.sql(_COMBINED + " SELECT recid, attr, array_to_string(vals, '|') AS vals FROM combined"))
def j8(spark, d):
    return repair.combine_repairs(_candidates(spark, d)).select("recid", "attr", F.array_join("values", "|").alias("vals"))


@query("J9_suggestions", U.sql(_COMBINED + " SELECT recid, attr, vals[1] AS first, array_to_string(vals[1:3], '|') AS first_three FROM combined"))
def j9(spark, d):
    return repair.suggestions(repair.combine_repairs(_candidates(spark, d))).select("recid", "attr", "first", F.array_join("first_three", "|").alias("first_three"))


@query("J10_repair_coverage", U.sql(_CANDIDATES + ", o AS (SELECT source, recid, attr, max(CAST(lower(candidate) = lower(c.value) AS INTEGER)) AS hit FROM cand JOIN ccells c USING (recid, attr) GROUP BY ALL) SELECT source, count(*) AS n, CAST(coalesce(sum(hit), 0) AS BIGINT) AS found, round(100 * coalesce(sum(hit), 0) / count(*), 4) AS pct_found FROM o GROUP BY source"))
def j10(spark, d):
    return repair.repair_coverage(_candidates(spark, d), U.clean_cells(spark, d))


@query("J10_overlap_patterns", U.sql(_CANDIDATES + ", o AS (SELECT recid, attr, max(CASE WHEN source = 'fd' AND lower(candidate) = lower(c.value) THEN 1 ELSE 0 END) AS fd, max(CASE WHEN source = 'histogram' AND lower(candidate) = lower(c.value) THEN 1 ELSE 0 END) AS histogram FROM cand JOIN ccells c USING (recid, attr) GROUP BY ALL) SELECT fd, histogram, count(*) AS n FROM o GROUP BY ALL"))
def j10b(spark, d):
    return repair.overlap_patterns(_candidates(spark, d), U.clean_cells(spark, d), ["fd", "histogram"])


_FIVE = _FD_REPAIRS + f""", cand AS (SELECT recid, attr, 'fd' AS source, candidate FROM fdr UNION ALL SELECT p.recid, p.attr, 'histogram', t.value FROM pred p JOIN top t USING (attr) WHERE prediction = 1
 UNION ALL SELECT recid, attr, 'repaired', new_value FROM {_LOG} UNION ALL SELECT recid, attr, 'audit', new_value FROM ({_AUDIT})),
dom AS (SELECT DISTINCT attr, lower(value) AS candidate FROM pred WHERE prediction = 0 AND value IS NOT NULL), err AS (SELECT recid, attr FROM pred WHERE prediction = 1),
mine AS (SELECT e.recid, e.attr, lower(candidate) AS candidate, count(DISTINCT source) AS n FROM err e JOIN cand USING (recid, attr) WHERE candidate IS NOT NULL GROUP BY ALL),
every AS (SELECT recid, attr, candidate, sum(n) / 5.0::DOUBLE AS share FROM (SELECT * FROM mine UNION ALL SELECT recid, attr, candidate, 1 FROM err JOIN dom USING (attr)) GROUP BY ALL),
best AS (SELECT *, max(share) OVER (PARTITION BY recid, attr) AS t FROM every), kept5 AS (SELECT * FROM best WHERE t <= 0.2 OR share > 0.2),
lists AS (SELECT recid, attr, list(candidate ORDER BY share DESC, candidate) AS vals, bool_and(t <= 0.2) AS whole_domain FROM kept5 GROUP BY ALL)"""


def _five(spark, d):
    p = saved(U.predicted(spark, d), "predicted")
    named = lambda df, source: df.withColumn("source", F.lit(source))
    logs = {"repaired": repair.repair_log(_repaired_table(spark, d), U.SPEC), "audit": repair.repair_log_from_audit(_audit(spark, d), U.dirty(spark, d), U.SPEC)}
    out = named(repair.fd_repairs(p, U.dirty(spark, d), "recid", _REP_FDS), "fd").unionByName(named(repair.histogram_repairs(p), "histogram"))
    for source, log in logs.items():
        out = out.unionByName(named(log.withColumnRenamed("new_value", "candidate"), source))
    return saved(out, "candidates"), repair.clean_domain(p), p.where("prediction = 1").select("recid", "attr")


@query("J9_suggestions_of_five", U.sql(_FIVE + " SELECT recid, attr, coalesce(whole_domain, true) AS whole_domain, vals[1] AS first, coalesce(array_to_string(vals[1:3], '|'), '') AS first_three FROM err LEFT JOIN lists USING (recid, attr)"))
def j9b(spark, d):
    return repair.combine_with_domain(*_five(spark, d)).select("recid", "attr", "whole_domain", "first", F.array_join("first_three", "|").alias("first_three"))


_SOURCES = ["fd", "histogram", "repaired", "audit"]


@query("J10_repair_summary", U.sql(_FIVE + f""", t AS (SELECT recid, attr, lower(value) AS truth FROM err JOIN ccells USING (recid, attr) WHERE value IS NOT NULL),
hits AS (SELECT t.*, vals, {", ".join(f"EXISTS (SELECT 1 FROM mine JOIN cand USING (recid, attr) WHERE mine.recid = t.recid AND mine.attr = t.attr AND source = '{s}' AND lower(cand.candidate) = truth) AS {s}_" for s in _SOURCES)},
  EXISTS (SELECT 1 FROM dom WHERE dom.attr = t.attr AND dom.candidate = truth) AS clean_ FROM t LEFT JOIN lists USING (recid, attr)),
o AS ({" UNION ALL ".join(f"SELECT '{s}' AS source, count(*) AS n, count(*) FILTER (WHERE {c}) AS found FROM hits" for s, c in [*((s, f"{s}_") for s in _SOURCES), ("clean values", "clean_"), ("combined", "list_contains(vals, truth)"), ("first three", "list_contains(vals[1:3], truth)"), ("single", "vals[1] = truth")])})
SELECT *, round(CASE WHEN n > 0 THEN 100 * found / n ELSE 0 END, 4) AS pct_found FROM o"""))
def j10c(spark, d):
    return repair.repair_summary(*_five(spark, d), U.clean_cells(spark, d), _SOURCES)


@query("J11_with_truth", U.sql(f"SELECT recid, attr, new_value, c.value AS truth FROM {_LOG} JOIN ccells c USING (recid, attr)"))
def j11(spark, d):
    return repair.with_truth(repair.repair_log(_repaired_table(spark, d), U.SPEC), U.clean_cells(spark, d))


_CO = ", co AS (SELECT a.attr, a.value, b.attr AS given_attr, b.value AS given_value, count(*) AS n FROM small a JOIN small b USING (recid) WHERE a.attr <> b.attr AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL), cop AS (SELECT *, n / sum(n) OVER (PARTITION BY attr, given_attr, given_value) AS p FROM co)"
# J12 to J16 over the cells of every attribute; candidates are bounded by the co-occurrence join
_WHOLE = ", small AS (SELECT * FROM pred), dom AS (SELECT DISTINCT attr, value AS candidate FROM small WHERE prediction = 0 AND value IS NOT NULL)" + _CO
_PRUNED = _WHOLE + ", pruned AS (SELECT w.recid, w.attr, c.value AS candidate, max(p) AS p FROM small w JOIN small o USING (recid) JOIN cop c ON c.attr = w.attr AND c.given_attr = o.attr AND c.given_value = o.value JOIN dom ON dom.attr = w.attr AND dom.candidate = c.value WHERE w.prediction = 1 AND w.attr <> o.attr AND p >= 0.1 GROUP BY ALL)"


@query("J12_candidate_domain", U.sql(_PRUNED + " SELECT recid, attr, candidate FROM pruned UNION ALL SELECT recid, attr, value FROM small WHERE prediction = 0"))
def j12(spark, d):
    return repair.pruned_candidate_domain(U.predicted(spark, d), 0.1)


@query("J13_cooccurrence", U.sql(_WHOLE + " SELECT attr, value, given_attr, given_value, n, p FROM cop"))
def j13(spark, d):
    return repair.cooccurrence(U.predicted(spark, d))


@query("J14_prune_domain", U.sql(_PRUNED + " SELECT tau, recid, attr, candidate, p FROM pruned, (SELECT unnest(range(1, 11))::DOUBLE / 10 AS tau) WHERE p >= tau"))
def j14(spark, d):
    # one scored table for every tau; tau 0 is the whole domain of an attribute for every error, which is never spread out
    return repair.prune_domain(U.predicted(spark, d), 0.1).withColumn("tau", F.explode(F.array(*[F.lit(i / 10) for i in range(1, 11)]))).where("p >= tau")


@query("J14_domain_sizes", U.sql(_PRUNED + """, e AS (SELECT attr, count(*) AS n_cells FROM small WHERE prediction = 1 GROUP BY attr), g AS (SELECT unnest(range(1, 11))::DOUBLE / 10 AS tau),
c AS (SELECT tau, attr, recid, count(*) AS n FROM pruned, g WHERE p >= tau GROUP BY ALL), s AS (SELECT tau, attr, sum(n) AS n_candidates, count(*) AS n_covered FROM c GROUP BY ALL)
SELECT 0.0::DOUBLE AS tau, attr, n_cells, CAST(n_cells * coalesce(v, 0) AS BIGINT) AS n_candidates, CASE WHEN v > 0 THEN n_cells ELSE 0 END AS n_covered FROM e LEFT JOIN (SELECT attr, count(*) AS v FROM dom GROUP BY attr) USING (attr)
UNION ALL SELECT tau, attr, n_cells, CAST(coalesce(n_candidates, 0) AS BIGINT), coalesce(n_covered, 0) FROM (SELECT * FROM e, g) LEFT JOIN s USING (tau, attr)"""))
def j14b(spark, d):
    return repair.domain_sizes(saved(U.predicted(spark, d), "predicted"), [i / 10 for i in range(11)])


_SCORED = _PRUNED + """, byv AS (SELECT n_name AS k, r_name AS own, count(*) AS n FROM dirty GROUP BY ALL), byg AS (SELECT k, sum(n) FILTER (WHERE own IS NOT NULL) AS every FROM byv GROUP BY k),
scored AS (SELECT c.recid, c.attr, c.candidate, 0.5::DOUBLE + CASE WHEN c.candidate IS NOT DISTINCT FROM s.value THEN 0.5 ELSE 0 END + CASE WHEN c.attr = 'r_name' AND every - coalesce(v.n, 0) - CASE WHEN d.r_name <> c.candidate THEN 1 ELSE 0 END > 0 THEN -1.0 ELSE 0 END AS score
 FROM pruned c JOIN small s USING (recid, attr) JOIN dirty d USING (recid) LEFT JOIN byg ON byg.k = d.n_name LEFT JOIN byv v ON v.k = d.n_name AND v.own = c.candidate)"""


def _scored(spark, d):
    candidates = repair.prune_domain(U.predicted(spark, d), 0.1).drop("p")
    return repair.score_candidates(candidates, U.dirty(spark, d), "recid", U.FDS)


@query("J15_score_candidates", U.sql(_SCORED + " SELECT * FROM scored"))
def j15(spark, d):
    return _scored(spark, d)


@query("J16_best_candidate", U.sql(_SCORED + " SELECT recid, attr, candidate, score FROM (SELECT *, max(score) OVER (PARTITION BY recid, attr) AS t FROM scored) WHERE score = t AND score > 0"))
def j16(spark, d):
    return repair.best_candidate(_scored(spark, d))


@query("J17_attribute_name", U.sql("SELECT recid, CASE WHEN missing = 1 THEN 4 ELSE 3 END AS attr_nr, CASE WHEN missing = 1 THEN 'c_mktsegment' ELSE 'r_name' END AS attr FROM m WHERE missing + fd > 0"))
def j17(spark, d):
    found = U.matrix(spark, d).where("missing + fd > 0").select("recid", F.when(F.col("missing") == 1, 4).otherwise(3).alias("attr_nr"))
    return C.attribute_name(found, U.SPEC)


@query("K1_inject_misfielded", U.sql("SELECT recid, CASE WHEN recid % 10 = 0 THEN n_name || ' ' || r_name ELSE n_name END AS n_name, CASE WHEN recid % 10 = 0 THEN '' ELSE r_name END AS r_name FROM clean"))
def k1(spark, d):
    return inject.inject_misfielded(U.clean(spark, d), "n_name", "r_name", F.col("recid") % 10 == 0).select("recid", "n_name", "r_name")


@query("K2_inject_suffix", U.sql("SELECT recid, CASE WHEN recid % 20 = 1 THEN c_acctbal || '%' ELSE c_acctbal END AS c_acctbal FROM clean"))
def k2(spark, d):
    return inject.inject_suffix(U.clean(spark, d), "c_acctbal", "%", F.col("recid") % 20 == 1).select("recid", "c_acctbal")


@query("K3_inject_placeholder", U.sql("SELECT recid, coalesce(c_mktsegment, 'N/A') AS c_mktsegment FROM dirty"))
def k3(spark, d):
    return inject.inject_placeholder(U.dirty(spark, d), "c_mktsegment").select("recid", "c_mktsegment")


@query("K4_inject_variants", U.sql("SELECT recid, c_acctbal || CASE WHEN recid % 10 < 5 THEN ' oz' WHEN recid % 10 < 7 THEN ' ounce' WHEN recid % 10 < 8 THEN ' OZ.' WHEN recid % 10 < 9 THEN ' oz can' ELSE '' END AS c_acctbal FROM clean"))
def k4(spark, d):
    return inject.inject_variants(U.clean(spark, d), "c_acctbal", [" oz", " ounce", " OZ.", " oz can", ""], [5, 2, 1, 1, 1], F.col("recid")).select("recid", "c_acctbal")


@query("K5_join_sources", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def k5(spark, d):
    return inject.join_sources(table(spark, d, "customer"), table(spark, d, "nation"), "c_nationkey", "n_nationkey").select("c_custkey", "c_name", "n_name")


@query("K6_sample_records", U.sql(f"SELECT * FROM m WHERE {hash_share_sql(['recid'], 10)}"))
def k6(spark, d):
    picked = inject.sample_records(U.dirty(spark, d), "recid", 10.0)
    return inject.records_of(U.matrix(spark, d), picked, "recid")


@query("L1_association_rules")
def l1(spark, d):
    return mining.association_rules(U.dirty_cells(spark, d), 0.02, 0.5)


#: All sets of a record's items, counted; a rule needs a frequent set and the share of its records among those of the rest.
_RULES = """, items AS (SELECT recid, item, row_number() OVER (PARTITION BY recid ORDER BY item) AS i FROM (SELECT DISTINCT recid, attr || '=' || value AS item FROM cells WHERE value IS NOT NULL)),
total AS (SELECT count(DISTINCT recid) AS every FROM items),
subsets AS (SELECT recid, bits, list(item ORDER BY item) AS s FROM items, (SELECT unnest(range(1, 32)) AS bits) WHERE (bits >> (i - 1)) & 1 = 1 GROUP BY recid, bits HAVING count(*) = bit_count(bits)),
freq AS (SELECT s, count(*) AS n FROM subsets GROUP BY s HAVING count(*) >= (SELECT ceil(0.02 * every) FROM total)),
rules AS (SELECT s, n, unnest(s) AS c FROM freq WHERE len(s) > 1), split AS (SELECT s, n, c, list(m ORDER BY m) AS rest FROM (SELECT *, unnest(s) AS m FROM rules) WHERE m <> c GROUP BY ALL)
SELECT array_to_string(rest, '|') AS antecedent, c AS consequent, round(r.n / a.n, 9) AS confidence, round(r.n / a.n / (o.n / every), 9) AS lift, round(r.n / every, 9) AS support
FROM split r JOIN freq a ON a.s = rest JOIN freq o ON o.s = [c], total WHERE r.n / a.n >= 0.5"""


@query("L1_rules_listed", U.sql(_RULES))
def l1b(spark, d):
    rules = mining.association_rules(U.dirty_cells(spark, d), 0.02, 0.5)
    return rules.select(F.array_join(F.array_sort("antecedent"), "|").alias("antecedent"), F.array_join("consequent", "|").alias("consequent"), *[F.round(c, 9).alias(c) for c in ("confidence", "lift", "support")])


@query("L2_frequent_sequences")
def l2(spark, d):
    return mining.frequent_sequences(table(spark, d, "events"), "user_id", "ts", "event_type", 0.4, 3)


#: The earliest place at which each sequence of up to three items ends, by user.
_SEQUENCES = """WITH s AS (SELECT user_id, event_type AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS place FROM events),
p1 AS (SELECT user_id, item AS sequence, min(place) AS place FROM s GROUP BY ALL),
p2 AS (SELECT user_id, sequence || ' > ' || item AS sequence, min(s.place) AS place FROM p1 JOIN s USING (user_id) WHERE s.place > p1.place GROUP BY ALL),
p3 AS (SELECT user_id, sequence || ' > ' || item AS sequence, min(s.place) AS place FROM p2 JOIN s USING (user_id) WHERE s.place > p2.place GROUP BY ALL)
SELECT sequence, count(*) AS freq FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY sequence HAVING count(*) >= (SELECT ceil(0.4 * count(DISTINCT user_id)) FROM events)"""


@query("L2_sequences_listed", _SEQUENCES)
def l2b(spark, d):
    found = mining.frequent_sequences(table(spark, d, "events"), "user_id", "ts", "event_type", 0.4, 3)
    return found.select(F.array_join(F.flatten("sequence"), " > ").alias("sequence"), "freq")


@query("L3_near_duplicates", """WITH t AS (SELECT p_partkey AS key, lower(concat_ws(' ', p_name, p_brand, p_type)) AS t FROM part), one AS (SELECT t, min(key) AS id FROM t GROUP BY t),
g AS (SELECT DISTINCT id, CASE WHEN length(t) < 3 THEN t ELSE substr(t, CAST(i AS INTEGER), 3) END AS gram FROM (SELECT id, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM one)), size AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM g x JOIN g y ON x.gram = y.gram AND x.id < y.id GROUP BY ALL),
p AS (SELECT a, b, 1 - common / (x.n + y.n - common) AS distance FROM c JOIN size x ON x.id = a JOIN size y ON y.id = b)
SELECT a, b, distance FROM p WHERE distance < 0.2 UNION ALL SELECT id, key, 0.0::DOUBLE FROM t JOIN one USING (t) WHERE key <> id""")
def l3(spark, d):
    return mining.near_duplicates(table(spark, d, "part").withColumn("t", F.concat_ws(" ", "p_name", "p_brand", "p_type")), "p_partkey", "t", 0.2)


@query("L4_ngrams", "SELECT k, gram, count(*) AS cnt FROM (SELECT p_partkey AS k, substr(p_name, CAST(i AS INTEGER), 3) AS gram FROM (SELECT p_partkey, p_name, unnest(generate_series(1, length(p_name) - 2)) AS i FROM part WHERE length(p_name) >= 3)) GROUP BY ALL")
def l4(spark, d):
    return mining.ngrams(table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name"), "k", "p_name", 3)


