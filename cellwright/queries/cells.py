"""Sources and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.operators import cells as C
from cellwright.queries import customers as U
from cellwright.queries.registry import query
from cellwright.session import shared_dir, table
from cellwright.sources import tables as S


def _written(df, name: str) -> str:
    import uuid

    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    S.write_table(df, path)
    return path


@query("A1_read_csv", U.sql("SELECT * FROM dirty"))
def a1(spark, d):
    path = _written(U.dirty(spark, d), "csv")
    df = S.read_table(spark, path, ["recid", *U.COLUMNS])
    return df.select(F.col("recid").cast("long").alias("recid"), *U.COLUMNS)


@query("A2_read_without_header", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def a2(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    import uuid

    path = f"{shared_dir(spark)}/plain-{uuid.uuid4().hex}"
    S.write_table(df, path, header=False)
    return S.read_table(spark, path, ["k", "name", "region"], header=False)


@query("A3_skip_preamble", "SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name FROM customer")
def a3(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/preamble-{uuid.uuid4().hex}"
    rows = table(spark, d, "customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name").alias("value"))
    head = "# made by a tool\n# settings: none\nk,name"
    # every part file begins with two lines of preamble and a header
    rows.groupBy(F.spark_partition_id().alias("p")).agg(F.concat_ws("\n", F.lit(head), F.array_join(F.sort_array(F.collect_list("value")), "\n")).alias("value")).select("value").repartition(4, "value").write.option("maxRecordsPerFile", 1).text(path)
    return S.read_table(spark, path, ["k", "name"], skip_lines=2)


@query("A4_ingest_pairs", "SELECT row_number() OVER (ORDER BY 'seg-' || lower(c_mktsegment), CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE c_name END) AS row_id, CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE c_name END AS name, c_name AS true_name FROM customer")
def a4(spark, d):
    import uuid

    root = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("name"), F.concat(F.lit("seg-"), F.lower("c_mktsegment")).alias("source"))
    # one folder of files a source on both sides; a key may stand in several sources, so files are matched by their source
    c.write.partitionBy("source").option("sep", "\t").csv(f"{root}/truth")
    c.withColumn("name", F.when(F.col("k").cast("long") % 7 == 0, F.upper("name")).otherwise(F.col("name"))).write.partitionBy("source").option("sep", "\t").csv(f"{root}/dirty")
    dirty, clean = S.ingest_pairs(spark, f"{root}/dirty/*", f"{root}/truth/*", ["k"], ["k", "name"], file_key=r"source=([^/]+)/")
    return dirty.join(clean.select("row_id", F.col("name").alias("true_name")), "row_id")


@query("A5_read_profile", U.sql("SELECT attr, n_rows, n_nulls, round(100.0 * n_nulls / n_rows, 6) AS pct_nulls, array_to_string(list(value ORDER BY rnk), '|') AS top10 FROM basic JOIN top USING (attr) GROUP BY ALL"))
def a5(spark, d):
    import uuid

    from cellwright.operators import profile as P

    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    facts = P.profile_basic(U.dirty_cells(spark, d)).join(P.histograms(U.dirty_cells(spark, d)), "attr")
    v = lambda c: F.struct(c.alias("value"))
    facts.select(
        F.struct(F.array(F.struct(F.concat(F.lit('"'), F.col("attr"), F.lit('"')).alias("columnIdentifier"))).alias("columnIdentifiers")).alias("columnCombination"),
        F.struct(v(F.col("n_nulls")).alias("Nulls"), v(F.col("pct_nulls")).alias("Percentage of Nulls"), v(F.col("pct_distinct")).alias("Percentage of Distinct Values"), v(F.col("n_rows")).alias("Number of Tuples"), v(F.col("top10")).alias("Top 10 frequent items"), v(F.col("freq_top10").cast("array<string>")).alias("Frequency Of Top 10 Frequent Items")).alias("statisticMap"),
    ).write.json(path)
    return S.read_profile(spark, path).select("attr", "n_rows", "n_nulls", F.round("pct_nulls", 6).alias("pct_nulls"), F.array_join("top10", "|").alias("top10"))


_LIBSVM = "SELECT CAST(label AS VARCHAR) || ' ' || array_to_string(list_filter([CASE WHEN missing=1 THEN '1:1' END, CASE WHEN default_value=1 THEN '2:1' END, CASE WHEN lookup=1 THEN '3:1' END, CASE WHEN fd=1 THEN '4:1' END, CASE WHEN number=1 THEN '5:1' END], lambda x: x IS NOT NULL), ' ') AS value FROM m WHERE greatest(missing, default_value, lookup, fd, number) = 1"


@query("A7_read_libsvm", U.sql("SELECT CAST(label AS DOUBLE) AS label, count(*) AS n FROM m WHERE greatest(missing, default_value, lookup, fd, number) = 1 GROUP BY label"))
def a7(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/libsvm-{uuid.uuid4().hex}"
    S.to_libsvm_rows(U.matrix(spark, d), U.TOOLS).write.text(path)
    return S.read_libsvm(spark, path, len(U.TOOLS)).groupBy("label").agg(F.count("*").alias("n"))


@query("A8_libsvm_rows", U.sql(f"SELECT value, count(*) AS n FROM ({_LIBSVM}) GROUP BY value"))
def a8(spark, d):
    return S.to_libsvm_rows(U.matrix(spark, d), U.TOOLS).groupBy("value").agg(F.count("*").alias("n"))


@query("A9_write_tsv", U.sql("SELECT recid, c_name, n_name FROM clean"))
def a9(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/tsv-{uuid.uuid4().hex}"
    S.write_table(U.clean(spark, d).select("recid", "c_name", "n_name"), path, sep="\t", header=False)
    return S.read_table(spark, path, ["recid", "c_name", "n_name"], header=False, sep="\t").withColumn("recid", F.col("recid").cast("long"))


@query("A10_lookup_source", 'SELECT n_name AS "lookup-n_name" FROM nation')
def a10(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/lookup-{uuid.uuid4().hex}"
    table(spark, d, "nation").select("n_name").write.text(path)
    return S.read_lookup(spark, path, "n_name")


@query("A11_dictionary_sets", U.sql("SELECT DISTINCT 'n_name' AS attr, n_name AS value FROM dirty WHERE n_name IS NOT NULL UNION ALL SELECT DISTINCT 'r_name', r_name FROM dirty WHERE r_name IS NOT NULL"))
def a11(spark, d):
    sets = S.dictionary_sets(U.dirty(spark, d), ["n_name", "r_name"])
    return sets["n_name"].select(F.lit("n_name").alias("attr"), F.col("n_name").alias("value")).union(sets["r_name"].select(F.lit("r_name"), "r_name"))


@query("A12_export_hits", U.sql("SELECT CAST(recid AS VARCHAR) || '-' || attr AS hit FROM m WHERE fd = 1"))
def a12(spark, d):
    return S.export_hits(U.matrix(spark, d), "fd")


@query("B1_cells", U.sql("SELECT * FROM cells"))
def b1(spark, d):
    return U.dirty_cells(spark, d)


@query("B2_attribute_index", U.sql("SELECT recid, attr, value, CASE attr WHEN 'c_name' THEN 1 WHEN 'n_name' THEN 2 WHEN 'r_name' THEN 3 WHEN 'c_mktsegment' THEN 4 ELSE 5 END AS attr_nr FROM cells"))
def b2(spark, d):
    return C.attribute_index(U.dirty_cells(spark, d), U.SPEC)


@query("B3_cell_diff", U.sql("SELECT * FROM diff"))
def b3(spark, d):
    return U.diff(spark, d)


@query("B4_gold_standard", U.sql("SELECT recid, attr, dirty_value, clean_value, CAST(dirty_value IS DISTINCT FROM clean_value AND coalesce(clean_value, '') <> '' AS INTEGER) AS label FROM diff"))
def b4(spark, d):
    return C.cell_diff(U.clean(spark, d), U.dirty(spark, d), U.SPEC, "gold")


@query("B5_gold_by_row_id", U.sql("SELECT recid AS recid, attr, label FROM (SELECT row_number() OVER (PARTITION BY attr ORDER BY recid) AS recid, attr, label FROM diff)"))
def b5(spark, d):
    clean, dirty = U.clean(spark, d), U.dirty(spark, d)
    return C.gold_by_position(clean, dirty, U.SPEC, ["recid"], "diff").select("recid", "attr", "label")


@query("B6_error_cells", U.sql("SELECT recid, attr FROM diff WHERE label = 1"))
def b6(spark, d):
    return C.error_cells(U.diff(spark, d))


@query("B7_dirty_records", U.sql("SELECT DISTINCT recid FROM diff WHERE label = 1"))
def b7(spark, d):
    return C.dirty_records(U.clean(spark, d), U.dirty(spark, d), U.SPEC)


@query("B8_vote_column", U.sql("SELECT recid, attr, label, missing AS vote FROM m"))
def b8(spark, d):
    found = U.dirty_cells(spark, d).where("value IS NULL")
    return C.vote_column(U.diff(spark, d).select("recid", "attr", "label"), found, "vote")


@query("B9_vote_matrix", U.sql("SELECT recid, attr, label, missing, lookup, fd FROM m"))
def b9(spark, d):
    m = U.matrix(spark, d)
    return C.vote_matrix(U.diff(spark, d), {t: m.where(F.col(t) == 1) for t in ("missing", "lookup", "fd")})


@query("B10_truth_matrix", U.sql("SELECT recid, attr, label, " + ", ".join(f"CAST({t} = label AS INTEGER) AS {t}" for t in U.TOOLS) + " FROM m"))
def b10(spark, d):
    return C.truth_matrix(U.matrix(spark, d), U.TOOLS)


@query("B11_vote_triplets", U.sql(" UNION ALL ".join(f"SELECT recid, attr, {i} AS annotator, {t} AS y, label FROM m" for i, t in enumerate(U.TOOLS, 1))))
def b11(spark, d):
    return C.vote_triplets(U.matrix(spark, d), U.TOOLS, ternary=False)


@query("B12_tuple_maps", U.sql("SELECT recid, 'c_acctbal=' || coalesce(c_acctbal,'?') || '|c_mktsegment=' || coalesce(c_mktsegment,'?') || '|c_name=' || coalesce(c_name,'?') AS entries FROM dirty"))
def b12(spark, d):
    maps = C.tuple_maps(U.dirty_cells(spark, d))
    one = lambda k: F.concat(F.lit(f"{k}="), F.coalesce(F.col("attributes")[k], F.lit("?")))
    return maps.select("recid", F.concat_ws("|", one("c_acctbal"), one("c_mktsegment"), one("c_name")).alias("entries"))


@query("B13_tuple_features", U.sql("SELECT a.recid, a.attr, b.attr || '=' || b.value AS feature FROM cells a JOIN cells b USING (recid) WHERE b.value IS NOT NULL"))
def b13(spark, d):
    return C.tuple_features(U.dirty_cells(spark, d))


@query("B14_dictionary_candidates", U.sql("SELECT recid, attr, r.r_name AS candidate FROM cells, region r WHERE attr = 'r_name'"))
def b14(spark, d):
    return C.dictionary_candidates(U.dirty_cells(spark, d), table(spark, d, "region"), "r_name", "r_name")


@query("B15_cells_from_marks", U.sql("SELECT CAST(recid AS VARCHAR) AS recid, 'c_acctbal' AS attr FROM dirty WHERE recid % 5 = 0 UNION ALL SELECT CAST(recid AS VARCHAR), 'c_name' FROM dirty WHERE recid % 9 = 0"))
def b15(spark, d):
    df = U.dirty(spark, d)
    marked = df.select(F.when(F.col("recid") % 4 == 0, F.concat(F.lit("~"), F.col("recid").cast("string"))).otherwise(F.col("recid").cast("string")).alias("recid"), F.when(F.col("recid") % 9 == 0, F.concat("c_name", F.lit("~"))).otherwise(F.col("c_name")).alias("c_name"), *[F.col(c) for c in U.COLUMNS[1:4]], F.when(F.col("recid") % 5 == 0, F.concat(F.lit("~"), "c_acctbal")).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return C.cells_from_marks(marked, U.SPEC)


@query("B16_cells_from_flags", U.sql("SELECT recid, 'c_name' AS attr FROM dirty WHERE recid % 3 = 0 UNION ALL SELECT recid, 'n_name' FROM dirty WHERE recid % 4 = 1"))
def b16(spark, d):
    df = U.dirty(spark, d).select("recid", F.when(F.col("recid") % 3 == 0, "TRUE").otherwise("false").alias("vio_c_name"), (F.col("recid") % 4 == 1).alias("vio_n_name"))
    return C.cells_from_flags(df, "recid", "vio_")


@query("B17_cells_from_violations", U.sql("SELECT recid, 'r_name' AS attr FROM dirty JOIN badfd USING (n_name)"))
def b17(spark, d):
    df = U.dirty(spark, d)
    from cellwright.operators.dependencies import fd_violations

    found = fd_violations(df, "recid", U.FDS).select(F.col("recid").alias("tupleid"), F.col("attr").alias("attribute"))
    log = found.unionByName(found).unionByName(found.select((F.col("tupleid") + 100_000_000).alias("tupleid"), "attribute"))
    return C.cells_from_violations(log, df, U.SPEC)


@query("B18_expand_records", U.sql("SELECT DISTINCT d.recid, c.attr FROM diff d JOIN cells c USING (recid) WHERE d.label = 1"))
def b18(spark, d):
    return C.expand_records(C.dirty_records(U.clean(spark, d), U.dirty(spark, d), U.SPEC), U.SPEC)


_SCORED = "SELECT CAST(c_nationkey AS VARCHAR) AS dataset, CASE WHEN c_custkey % 2 = 0 THEN 'ucb' ELSE 'greedy' END AS algorithm, CAST(c_custkey % 5 AS INTEGER) + 1 AS tool, sum(CAST(c_custkey AS BIGINT)) AS score FROM customer GROUP BY ALL"


@query("B19_topk_prefixes", f"""WITH s AS ({_SCORED}), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, algorithm ORDER BY score DESC, tool) AS k FROM s),
p AS (SELECT a.dataset, a.algorithm, a.k, array_to_string(list(b.tool ORDER BY b.tool), ',') AS tools FROM r a JOIN r b ON a.dataset = b.dataset AND a.algorithm = b.algorithm AND b.k <= a.k GROUP BY ALL)
SELECT dataset, k, tools, array_to_string(list(algorithm ORDER BY algorithm), ',') AS algorithms FROM p GROUP BY ALL""")
def b19(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("dataset"), F.when(F.col("c_custkey") % 2 == 0, "ucb").otherwise("greedy").alias("algorithm"), (F.col("c_custkey") % 5).cast("int").alias("t"), F.col("c_custkey").alias("v"))
    one = c.groupBy("dataset", "algorithm", (F.col("t") + 1).alias("tool")).agg(F.sum("v").alias("score"))
    lists = one.groupBy("dataset", "algorithm").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.col("tool").cast("string"), F.col("score").cast("string")))), "|").alias("expectations"))
    return C.topk_prefixes(lists)


