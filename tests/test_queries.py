"""Every registered table query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from cellwright.queries import ORACLES, QUERIES, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark):
    out = flagship(spark, SF).toPandas()
    assert len(out) == 5 and out.loc[out.name == "min-1", "recall"].iloc[0] > 0.3


@pytest.mark.parametrize("name", ["E6_precision_ordering", "E8_spectral_reliability_1", "F6_k_best_path", "F9_best_k", "G16_split", "K6_sample_records", "H9_decision_tree", "L1_association_rules"])
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_candidates_cover_every_attribute(spark):
    pairs = QUERIES["J13_cooccurrence"](spark, SF).select("attr", "given_attr").distinct().count()
    assert pairs == 20
    scored = {r.attr for r in QUERIES["J15_score_candidates"](spark, SF).select("attr").distinct().collect()}
    assert len(scored) > 1
    assert {r.attr for r in QUERIES["J12_candidate_domain"](spark, SF).select("attr").distinct().collect()} == {"c_name", "n_name", "r_name", "c_mktsegment", "c_acctbal"}


def test_profiles_of_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "HELLO world"), (2, "HELLO WORLD"), (3, "Hello World"), (4, "123"), (5, None), (6, "hello " * 500)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a b",)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.doc_id: r.case_class for r in QUERIES["D27_case_class"](spark, str(tmp_path)).collect()}
    assert got == {1: "mixed", 2: "upper", 3: "title", 4: "none", 5: None, 6: "lower"}
    assert {tuple(r) for r in QUERIES["C7_common_lengths"](spark, str(tmp_path)).collect()} == {("p_name", 3), ("text", 11), ("text", 3), ("text", 3000)}


def test_no_python_in_plans_and_no_products(spark):
    for name in ("B3_cell_diff", "D20_detector_matrix", "D21_fd_violations", "J13_cooccurrence", "F8_brute_force"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name
