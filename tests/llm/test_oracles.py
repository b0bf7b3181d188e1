"""Corpus queries that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from cellwright.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op6_ngram_jaccard", "op9_suffix_dedup", "op12_phrase_automata", "op13_filter_audit"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) > 0
    listed = lambda df: sorted(map(tuple, df[columns].astype(object).values.tolist()))
    assert listed(got) == listed(want)
