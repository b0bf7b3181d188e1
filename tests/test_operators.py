"""Worked examples and edge cases of the table operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.functions.numeric import ratio, round0, safe_ln
from cellwright.functions.text import _jaro_winkler, case_class, matches
from cellwright.operators import cells as C
from cellwright.operators import dependencies, detect, duplicates, evaluate, features, mining, profile, repair, similarity, votes
from cellwright.spec import FD, NUMBER, TableSpec

SPEC = TableSpec("id", ("a", "b"))


@pytest.fixture(scope="module")
def pair(spark):
    clean = spark.createDataFrame([(1, "x", "p"), (2, "y", None), (3, "", "q")], "id long, a string, b string")
    dirty = spark.createDataFrame([(1, "x", None), (2, "z", "r"), (3, "w", "q")], "id long, a string, b string")
    return clean, dirty


def test_cells_and_labels(pair):
    clean, dirty = pair
    assert C.cells(dirty, SPEC).count() == 6
    diff = {(r.recid, r.attr): r.label for r in C.cell_diff(clean, dirty, SPEC).collect()}
    gold = {(r.recid, r.attr): r.label for r in C.cell_diff(clean, dirty, SPEC, "gold").collect()}
    assert diff == {(1, "a"): 0, (1, "b"): 1, (2, "a"): 1, (2, "b"): 1, (3, "a"): 1, (3, "b"): 0}
    assert gold == {(1, "a"): 0, (1, "b"): 1, (2, "a"): 1, (2, "b"): 0, (3, "a"): 0, (3, "b"): 0}


def test_unknown_columns_are_refused(pair):
    with pytest.raises(ValueError):
        C.cells(pair[0], TableSpec("id", ("a", "B")))
    with pytest.raises(ValueError):
        C.cells(pair[0], TableSpec("id", ("a",), unique_columns=("Id",)))


def test_row_numbers_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    out = C.with_row_id(df, ["k"]).orderBy("k").collect()
    assert [r.row_id for r in out] == list(range(1, 1001))


def test_ternary_majority(spark):
    names = [f"t{i}" for i in range(9)]
    vote = lambda v: spark.createDataFrame([tuple(v)], ", ".join(f"{n} int" for n in names)).select(votes.majority(names).alias("m"), votes.union_all(names).alias("u")).first()
    assert tuple(vote([1] * 4 + [-1] * 3 + [0] * 2)) == (1, 1)
    assert tuple(vote([1] * 3 + [-1] * 6)) == (-1, 1)
    assert tuple(vote([0] * 9)) == (-1, -1)


def test_number_pattern(spark):
    df = spark.createDataFrame([(v,) for v in ("12.0 oz.", "12.0", "N/A", "0", ".5", "007", "", "5.")], "v string")
    assert [r[0] for r in df.select(matches(F.col("v"), NUMBER)).collect()] == [False, True, False, True, True, False, False, False]


def test_guarded_numbers(spark):
    r = spark.range(1).select(ratio(F.lit(1), F.lit(0)), safe_ln(F.lit(0.0)), round0(F.lit(float("nan")), 2), round0(F.lit(None).cast("double"), 2), round0(F.lit(3.56), 0)).first()
    assert tuple(r) == (0.0, 0.0, 0.0, 0.0, 4.0)


def test_case_class(spark):
    df = spark.createDataFrame([("ABC",), ("abc",), ("Abc Def",), ("aBc",), ("12",), (None,)], "v string")
    assert [r[0] for r in df.select(case_class(F.col("v"))).collect()] == ["upper", "lower", "title", "mixed", "none", None]


def test_jaro_winkler():
    assert round(_jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert _jaro_winkler("", "") == 1.0 and _jaro_winkler("", "a") == 0.0 and _jaro_winkler("abc", "xyz") == 0.0


def test_fd_groups_of_nulls_are_violations(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "y", "p"), (4, "y", "p"), (5, None, "p"), (6, None, "q")], "id long, a string, b string")
    assert sorted(r.recid for r in dependencies.fd_violations(df, "id", [FD(("a",), ("b",))]).collect()) == [1, 2, 5, 6]


def test_duplicates_in_a_hot_block(spark):
    rows = [(i, "k", f"name {i % 7:03d}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, block string, name string")
    old, duplicates.GRID = duplicates.GRID, 2
    try:
        got = {(r.a, r.b) for r in duplicates.duplicate_pairs(df, "id", "block", [], ["name"], 0.95).collect()}
    finally:
        duplicates.GRID = old
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if _jaro_winkler(rows[i][2], rows[j][2]) > 0.95}
    assert got == want


def test_mutual_information_of_a_table(spark):
    rows = [(1, 1)] * 40 + [(1, 0)] * 10 + [(0, 1)] * 5 + [(0, 0)] * 45
    df = spark.createDataFrame(rows, "f int, label int")
    p = np.array([[40, 10], [5, 45]]) / 100
    want = (p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum()
    assert abs(features.mutual_information(df, ["f"]).first().mi - want) < 1e-4


def test_thresholds(spark):
    rng = np.random.default_rng(0)
    rows = [(float(np.round(s, 2)), int(l)) for s, l in zip(rng.random(300), rng.integers(0, 2, 300))]
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in evaluate.threshold_table(spark.createDataFrame(rows, "score double, label int")).collect()}
    for t, counts in got.items():
        assert counts == (sum(s >= t and l for s, l in rows), sum(s >= t and not l for s, l in rows), sum(s < t and l for s, l in rows))


@pytest.fixture(scope="module")
def planted(spark):
    """Votes of known quality."""
    rng = np.random.default_rng(5)
    label = rng.random(2000) < 0.3
    tools = {"good": 0.95, "fair": 0.8, "weak": 0.65}
    rows = [(i, "a", int(l), *[int(l if rng.random() < q else not l) for q in tools.values()]) for i, l in enumerate(label)]
    return spark.createDataFrame(rows, "recid long, attr string, label int, good int, fair int, weak int").cache()


def test_dawid_skene_finds_the_reliable_annotator(planted):
    out, confusion = votes.dawid_skene(C.vote_triplets(planted, ["good", "fair", "weak"], ternary=False))
    accuracy = out.join(planted, ["recid", "attr"]).agg(F.avg((F.col("predicted") == F.col("label")).cast("int"))).first()[0]
    assert accuracy > 0.85
    assert confusion[1, 1, 1] > confusion[2, 1, 1] > 0.5


def test_spectral_weights_follow_quality(planted):
    ternary = planted.select("recid", "attr", *[(2 * F.col(t) - 1).alias(t) for t in ("good", "fair", "weak")])
    for alg in (1, 2):
        w = votes.spectral_reliability(ternary, ["good", "fair", "weak"], alg)
        assert w[0] > 0 and w[0] >= w[2]


def test_precision_ordering_and_sets(planted):
    _, order = votes.precision_ordering(planted, ["fair", "good", "weak"], 0.5)
    assert order[0] == "good"
    table = {(r.tools, r.k): r.recall for r in similarity.brute_force(planted, ["good", "fair", "weak"]).collect()}
    assert table["good,fair,weak", 1] >= table["good,fair,weak", 2] >= table["good,fair,weak", 3]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, a string, b string")
    cell = C.cells(empty, SPEC)
    assert cell.count() == 0 and profile.column_profile(cell).count() == 0
    assert detect.detector_matrix(cell, SPEC).count() == 0
    assert evaluate.evaluate_sets(cell, cell).first().f1 == 0.0


def test_combining_candidates(spark):
    rows = [(1, "a", s, v) for s, v in (("x", "P"), ("y", "p"), ("z", "q"))] + [(2, "a", "x", None)]
    out = repair.combine_repairs(spark.createDataFrame(rows, "recid long, attr string, source string, candidate string")).collect()
    assert [(r.recid, r["values"]) for r in out] == [(1, ["p"])]


def test_stream_votes(spark, tmp_path):
    from cellwright.streaming.detect import stream_votes

    df = spark.createDataFrame([(i, "x" if i % 5 else None, "v") for i in range(50)], "id long, a string, b string")
    df.write.parquet(str(tmp_path / "in"))
    cell = C.cells(df, SPEC)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_votes(stream, SPEC, profile.column_profile(cell), profile.value_counts(cell)).writeStream.format("memory").queryName("votes_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("votes_out").where("ec_missing = 1").count() == 10


@pytest.mark.parametrize("block", [1000, 3])
def test_near_duplicates_are_exact_and_name_every_copy(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("abc"), rng.integers(0, 14)))) for i in range(150)]
    rows += [(200 + i, "one large BRASS tin box") for i in range(5)] + [(300, "one large brass tin boxes"), (301, "ab"), (302, "AB"), (303, None)]
    got = [(r.a, r.b, round(r.distance, 9)) for r in mining.near_duplicates(spark.createDataFrame(rows, "k long, t string"), "k", "t", 0.4, block=block).collect()]
    first: dict[str, int] = {}
    want = []
    for k, t in rows:
        if t is not None and first.setdefault(t.lower(), k) != k:
            want.append((first[t.lower()], k, 0.0))
    sets = {k: {t[i : i + 3] for i in range(len(t) - 2)} or {t} for t, k in first.items()}
    for a in sets:
        for b in sets:
            d = 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if a < b and d < 0.4:
                want.append((a, b, round(d, 9)))
    assert sorted(got) == sorted(want)
