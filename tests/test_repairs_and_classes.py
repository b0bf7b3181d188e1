"""Duplicate classes, connected components, combined repairs, bundles of detectors and JDBC tables, on small cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cellwright.functions.text import _jaro_winkler
from cellwright.operators import components, detect, duplicates, evaluate, repair, similarity
from cellwright.sources import tables


@pytest.mark.parametrize("rows", [100_000, 2])
def test_components_and_dealt_joins(spark, monkeypatch, rows):
    """Chains, stars and lone links; facts broadcast, and dealt over parts."""
    monkeypatch.setattr(components, "DICTIONARY_ROWS", rows)
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 600)] + [(9, 7), (7, 7)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(40)]
    top = {x: x for e in links for x in e}
    for _ in range(len(top)):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in components.smallest_connected(df).collect()} == top
    assert components.smallest_connected(df.limit(0)).count() == 0
    many = spark.range(300).select("id", (F.col("id") % 2).alias("k"))
    one = spark.createDataFrame([(0, "x"), (2, "z"), (3, "w")], "k long, v string")
    got = components.join_facts(many, one, ["k"], "id")
    assert got.count() == 300 and got.where("v = 'x'").count() == 150 and got.where("v IS NULL").count() == 150


@pytest.mark.parametrize("grid", [256, 2])
def test_duplicate_classes_say_what_pairs_say(spark, monkeypatch, grid):
    monkeypatch.setattr(duplicates, "GRID", grid)
    rng = random.Random(2)
    names = ["anna bell", "anna  bell", "anna bel", "Anna-Bell", "carl", "carla", "zoe", None, ""]
    rows = [(i, rng.choice("xy"), rng.choice(names)) for i in range(80)] + [(100 + i, "hot", "same name") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, block string, name string")
    pairs = {(r.a, r.b) for r in duplicates.duplicate_pairs(df, "id", "block", [], ["name"]).collect()}
    every, links = duplicates.duplicate_classes(df, "id", "block", [], ["name"])
    top = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    got = {r.id: r for r in every.collect()}
    assert {i: r.component_id for i, r in got.items()} == top
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in p for p in pairs) for i in top}
    inside = sum(got[a].class_id == got[b].class_id for a, b in pairs)
    assert links.agg(F.sum("n_pairs")).first()[0] + inside == len(pairs)
    assert all(_jaro_winkler("anna bell", x) > 0.9 for x in ("anna bel", "anna  bell"))
    lost = spark.createDataFrame([(None, "x", "carl"), (1, "x", "carl")], "id long, block string, name string")
    assert [r.id for r in duplicates.duplicate_classes(lost, "id", "block", [], ["name"])[0].collect()] == [1]
    assert duplicates.duplicate_classes(df.limit(0), "id", "block", [], ["name"])[0].count() == 0


def combined(proposals: list[tuple[str, str]], domain: list[str]) -> list[str]:
    """The reference rule, with the clean values spread out: shares of five sources, those above a fifth if any."""
    of: dict[str, set] = {}
    for source, v in [*proposals, *(("domain", v) for v in domain)]:
        if v is not None:
            of.setdefault(v.lower(), set()).add(source)
    strong = {v: len(s) for v, s in of.items() if len(s) > 1} or {v: len(s) for v, s in of.items()}
    return sorted(strong, key=lambda v: (-strong[v], v))


def test_clean_values_count_without_being_spread(spark):
    domain = {"a": ["P", "q", "r", "Zz"], "b": ["only"]}
    proposals = {(1, "a"): [("fd", "p"), ("log", "x")], (2, "a"): [("fd", "x"), ("log", "m")], (3, "a"): [], (4, "b"): [("fd", "X"), ("log", "x"), ("audit", "only"), ("histogram", "x")], (5, "c"): [("fd", "v")], (6, "c"): [], (7, "a"): [("fd", None)]}
    truth = {(1, "a"): "p", (2, "a"): "ZZ", (3, "a"): "q", (4, "b"): "only", (5, "c"): "w", (6, "c"): "w", (7, "a"): None}
    cand = spark.createDataFrame([(r, a, s, v) for (r, a), ps in proposals.items() for s, v in ps], "recid long, attr string, source string, candidate string")
    dom = spark.createDataFrame([(a, v, 1) for a, vs in domain.items() for v in vs], "attr string, value string, cnt long")
    errors = spark.createDataFrame(list(proposals), "recid long, attr string")
    want = {k: combined(ps, domain.get(k[1], [])) for k, ps in proposals.items()}
    got = {(r.recid, r.attr): r for r in repair.combine_with_domain(cand, dom, errors).collect()}
    for k, r in got.items():
        assert r.first == (want[k][0] if want[k] else None) and r.first_three == want[k][:3]
        full = set(r["values"]) | ({v.lower() for v in domain.get(k[1], [])} if r.whole_domain else set())
        assert full == set(want[k])
    clean = spark.createDataFrame([(*k, v) for k, v in truth.items()], "recid long, attr string, value string")
    known = {k: t.lower() for k, t in truth.items() if t is not None}
    found = {r.source: (r.n, r.found) for r in repair.repair_summary(cand, dom, errors, clean, ["fd", "log"]).collect()}
    assert found["combined"] == (len(known), sum(t in want[k] for k, t in known.items()))
    assert found["first three"] == (len(known), sum(t in want[k][:3] for k, t in known.items()))
    assert found["single"] == (len(known), sum(want[k][:1] == [t] for k, t in known.items()))
    assert found["clean values"] == (len(known), sum(t in [v.lower() for v in domain.get(k[1], [])] for k, t in known.items()))
    assert found["fd"] == (len(known), 1)
    assert {r.found for r in repair.repair_summary(cand.limit(0), dom.limit(0), errors.limit(0), clean, ["fd"]).collect()} == {0}


def test_domain_sizes(spark):
    rows = [(i, "k", "xy"[i % 2], 0) for i in range(10)] + [(i, "v", f"v{i % 2}", 0) for i in range(8)] + [(8, "v", "bad", 1), (9, "v", None, 1)]
    got = {(r.tau, r.attr): (r.n_cells, r.n_candidates, r.n_covered) for r in repair.domain_sizes(spark.createDataFrame(rows, "recid long, attr string, value string, prediction int"), [0.0, 0.5, 0.9]).collect()}
    assert got == {(0.0, "v"): (2, 4, 2), (0.5, "v"): (2, 2, 2), (0.9, "v"): (2, 1, 1)}


def test_votes_are_scored_where_they_answer(spark):
    rows = [(1, 1, 0, -1), (1, -1, 1, 0), (0, 1, 0, 0), (0, -1, -1, -1), (1, 0, 0, 0)]
    got = {r.name: (r.tp, r.fp, r.fn, r.tn) for r in evaluate.evaluate_votes(spark.createDataFrame(rows, "label int, a int, b int, c int"), ["a", "b", "c"]).collect()}
    assert got == {"a": (1, 1, 1, 1), "b": (1, 0, 0, 1), "c": (0, 0, 1, 1), "majority": (2, 1, 1, 1), "union": (2, 1, 1, 1)}


def test_error_classes(spark):
    rows = [("city", 1, "#LV_MISFIELDED#", 1), ("city", 0, "x", 1), ("abv", 1, "#LV_MISSING#", 0), ("other", 1, "y", 1)]
    df = spark.createDataFrame(rows, "attr string, label int, clean_value string, ec int")
    assert {tuple(r) for r in detect.coverage_by_class(df, ["ec"], detect.class_by_attributes({"misfielded": ["city"], "type": ["abv"]})).collect()} == {("misfielded", 100.0), ("type", 0.0)}
    assert {tuple(r) for r in detect.coverage_by_class(df, ["ec"], detect.class_by_marker()).collect()} == {("#LV_MISFIELDED#", 100.0), ("#LV_MISSING#", 0.0)}


def test_subsets_are_all_combinations(spark):
    names = [tuple(r.members) for r in similarity.tool_subsets(spark, ["a", "b", "c", "d"], 2).collect()]
    assert len(names) == len(set(names)) == 11 and ("a", "c", "d") in names and all(len(n) >= 2 for n in names)


def test_jdbc_in_parts(spark, tmp_path, monkeypatch):
    """The database that comes with Spark, in memory; a table is read in parallel ranges of its key."""
    monkeypatch.chdir(tmp_path)
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:cells;create=true"
    rows = [(i, f"v{i}" if i % 7 else None) for i in range(100)]
    spark.createDataFrame(rows, "id long, v string").write.format("jdbc").option("url", url).option("dbtable", "t").save()
    got = tables.read_jdbc(spark, url, "t", "id", (0, 100), 4)
    assert got.rdd.getNumPartitions() == 4 and sorted((r[0], r[1]) for r in got.collect()) == sorted(rows, key=lambda r: r[0])
    assert tables.read_jdbc(spark, url, '(SELECT "id" FROM t WHERE "id" < 5) s').count() == 5
