"""Votes, their evaluation, similarity and selection of tools, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.functions.samples import hash_share_sql
from cellwright.operators import cells as C
from cellwright.operators import evaluate as E
from cellwright.operators import features, similarity, votes
from cellwright.plans import patterns
from cellwright.queries import customers as U
from cellwright.queries.registry import query
from cellwright.session import saved

T = U.TOOLS
_SUM = " + ".join(T)
_TERNARY = ", ".join(f"CASE WHEN {t} = 1 THEN 1 ELSE -1 END AS {t}" for t in T)


def _ternary(spark, d):
    return U.matrix(spark, d).select("recid", "attr", "label", *[F.when(F.col(t) == 1, 1).otherwise(-1).alias(t) for t in T])


@query("E1_union_all", U.sql(f"SELECT recid, attr, CASE WHEN {_SUM} > 0 THEN 1 ELSE -1 END AS vote FROM m"))
def e1(spark, d):
    return _ternary(spark, d).select("recid", "attr", votes.union_all(T).alias("vote"))


@query("E2_majority", U.sql(f"SELECT recid, attr, CASE WHEN {_SUM} >= 2 THEN 1 ELSE -1 END AS vote FROM m"))
def e2(spark, d):
    return _ternary(spark, d).select("recid", "attr", votes.majority(T).alias("vote"))


@query("E3_majority_tie_is_error", U.sql("SELECT recid, attr, CAST(missing + default_value + lookup + fd >= 2 AS INTEGER) AS vote FROM m"))
def e3(spark, d):
    return U.matrix(spark, d).select("recid", "attr", votes.majority(T[:4], tie_is_error=True).alias("vote"))


@query("E4_min_k", U.sql(f"SELECT recid, attr, CAST({_SUM} >= 2 AS INTEGER) AS vote FROM m"))
def e4(spark, d):
    return U.matrix(spark, d).select("recid", "attr", votes.min_k(T, 2).alias("vote"))


@query("E5_max_k", U.sql(f"SELECT recid, attr, CAST({_SUM} BETWEEN 1 AND 1 AS INTEGER) AS vote FROM m"))
def e5(spark, d):
    return U.matrix(spark, d).select("recid", "attr", votes.max_k(T, 1).alias("vote"))


#: One row a vote of each counted pattern.
_LONG = f""", pat AS (SELECT row_number() OVER () AS pid, * FROM (SELECT label, {', '.join(T)}, count(*) AS n FROM m GROUP BY ALL)),
v AS ({" UNION ALL ".join(f"SELECT pid, label, n, '{t}' AS tool, {t} AS vote FROM pat" for t in T)}),
hits AS (SELECT tool, sum(n * vote) AS hits, sum(n * vote * label) AS tp FROM v GROUP BY tool)"""


def _ordering_sql(delta: float, first: str = "") -> str:
    """The greedy order by precision, a round a tool."""
    rounds = ["c0 AS (SELECT 0 AS step, CAST('' AS VARCHAR) AS tool WHERE false)"]
    for i in range(len(T)):
        left = f"SELECT tool, sum(n * vote) AS hits, sum(n * vote * label) AS tp FROM v WHERE tool NOT IN (SELECT tool FROM c{i}) AND pid NOT IN (SELECT pid FROM v JOIN c{i} USING (tool) WHERE vote = 1) GROUP BY tool"
        best = f"SELECT tool, CASE WHEN hits > 0 THEN tp / hits ELSE 0 END AS p, hits FROM ({left}) ORDER BY p DESC, tool LIMIT 1"
        rounds.append(f"c{i + 1} AS (SELECT * FROM c{i} UNION ALL SELECT {i + 1}, tool FROM ({best}) WHERE hits > 0 AND p >= {delta} AND (SELECT count(*) FROM c{i}) = {i})")
    out = f", {', '.join(rounds)}, picked AS (SELECT pid, label, n, max(CASE WHEN tool IN (SELECT tool FROM c{len(T)}) THEN vote ELSE 0 END) AS yes FROM v GROUP BY ALL)"
    counts = "SELECT " + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE yes = {y} AND label {op} 1), 0) AS BIGINT) AS {name}" for name, y, op in (("tp", 1, "="), ("fp", 1, "<>"), ("fn", 0, "="), ("tn", 0, "<>"))) + " FROM picked"
    return out + f" SELECT {first}o.*, (SELECT coalesce(string_agg(tool, ',' ORDER BY step), '') FROM c{len(T)}) AS tools FROM ({U.all_scores_sql(counts)}) o"


@query("E6_precision_ordering", U.sql(_LONG + _ordering_sql(0.3)))
def e6(spark, d):
    m = U.matrix(spark, d)
    prediction, order = votes.precision_ordering(m, T, 0.3)
    return E.evaluate(m, prediction).withColumn("tools", F.lit(",".join(order)))


#: Precisions that a tool has to reach to be taken.
_DELTAS = (0.1, 0.2, 0.3, 0.4, 0.5)


@query("E6_precision_orderings", " UNION ALL ".join(f"(SELECT * FROM ({U.sql(_LONG + _ordering_sql(x, f'{x}::DOUBLE AS delta, '))}))" for x in _DELTAS))
def e6b(spark, d):
    return similarity.precision_orderings(U.matrix(spark, d), T, _DELTAS)


@query("E7_weighted_vote", U.sql("SELECT recid, attr, CASE WHEN 0.5 * (2 * missing - 1) + 1.5 * (2 * default_value - 1) + 2.0 * (2 * lookup - 1) + 0.25 * (2 * fd - 1) + 4.5 * (2 * number - 1) > 0 THEN 1 ELSE -1 END AS vote FROM m"))
def e7(spark, d):
    return _ternary(spark, d).select("recid", "attr", votes.weighted_vote(T, [0.5, 1.5, 2.0, 0.25, 4.5]).alias("vote"))


def _leading_sql(name: str, source: str, steps: int = 1000) -> str:
    """Tables of the leading eigenvectors of agreement, of answering together and of their ratio, by power iteration.

    Ratios lie between -1 and 1, so adding n on the diagonal makes their largest eigenvalue the dominant one.
    """
    n = range(len(T))
    cell = lambda f: "[" + ", ".join("[" + ", ".join(f(i, j) for j in n) + "]" for i in n) + "]"
    gram = cell(lambda i, j: f"sum({T[i]} * {T[j]})::DOUBLE")
    both = cell(lambda i, j: f"sum(abs({T[i]} * {T[j]}))::DOUBLE")
    shifted = cell(lambda i, j: f"CASE WHEN tg[{i + 1}][{j + 1}] <> 0 THEN ag[{i + 1}][{j + 1}] / tg[{i + 1}][{j + 1}] ELSE 0 END + {len(T) if i == j else 0}")
    times = lambda m, v: "[" + ", ".join(f"list_inner_product({m}[{i + 1}], {v})" for i in n) + "]"
    unit = lambda v: "[" + ", ".join(f"{v}[{i + 1}] / sqrt(list_inner_product({v}, {v}))" for i in n) + "]"
    start = "[" + ", ".join(f"{1 - i / 10}::DOUBLE" for i in n) + "]"
    ratio = lambda i: f"CASE WHEN abs(y[{i + 1}]) > 1e-12 THEN x[{i + 1}] / abs(y[{i + 1}]) ELSE 0 END"
    signed = lambda w: f"CASE WHEN list_sum({w}) >= 0 THEN 1 ELSE -1 END"
    return f""", {name}_g AS MATERIALIZED (SELECT ag, tg, {shifted} AS rt FROM (SELECT {gram} AS ag, {both} AS tg FROM ({source}))),
{name}_p AS (SELECT 0 AS step, {start} AS x, {start} AS y, {start} AS z UNION ALL
  SELECT step + 1, {unit("a")}, {unit("b")}, {unit("c")} FROM (SELECT step, {times("ag", "x")} AS a, {times("tg", "y")} AS b, {times("rt", "z")} AS c FROM {name}_p, {name}_g WHERE step < {steps})),
{name} AS MATERIALIZED (SELECT 1 AS alg, {signed("w")} AS sign, w FROM (SELECT [{', '.join(ratio(i) for i in n)}] AS w FROM {name}_p WHERE step = {steps}) UNION ALL SELECT 2, {signed("z")}, z FROM {name}_p WHERE step = {steps})
"""


def _recursive(text: str) -> str:
    return U.sql(text).replace("WITH ", "WITH RECURSIVE ", 1)


def _spectral(alg: int):
    def run(spark, d):
        m = _ternary(spark, d)
        weights = votes.spectral_reliability(m, T, alg)
        return m.select("recid", "attr", votes.weighted_vote(T, weights.tolist()).alias("vote"))

    return run


for _alg, _name in ((1, "E8_spectral_reliability_1"), (2, "E9_spectral_reliability_2")):
    _weighted = " + ".join(f"sign * w[{i}] * (2 * {t} - 1)" for i, t in enumerate(T, 1))
    query(_name, _recursive(_leading_sql("spectral", f"SELECT {_TERNARY} FROM m") + f"SELECT recid, attr, CASE WHEN {_weighted} > 0 THEN 1 ELSE -1 END AS vote FROM m, spectral WHERE alg = {_alg}"))(_spectral(_alg))

#: The attributes that a tool speaks about; on others it abstains.
_ABOUT = {"lookup": ("n_name", "r_name"), "fd": ("r_name",), "number": ("c_acctbal",)}
_ABSTAINING = ", ".join(f"CASE WHEN attr NOT IN ({', '.join(repr(a) for a in _ABOUT.get(t, U.COLUMNS))}) THEN 0 WHEN {t} = 1 THEN 1 ELSE -1 END AS {t}" for t in T)


@query(
    "E9_tool_weights",
    _recursive(_leading_sql("spectral", f"SELECT {_ABSTAINING} FROM m") + f"SELECT CAST(alg AS INTEGER) AS alg, unnest([{', '.join(repr(t) for t in T)}]) AS tool, unnest([{', '.join(f'round(sign * w[{i}], 4)' for i in range(1, len(T) + 1))}]) AS weight FROM spectral"),
)
def e9b(spark, d):
    voted = [F.when(~F.col("attr").isin(*_ABOUT.get(t, U.COLUMNS)), 0).when(F.col(t) == 1, 1).otherwise(-1).alias(t) for t in T]
    m = saved(U.matrix(spark, d).select(*voted), "ternary")
    rows = [(alg, t, float(w)) for alg in (1, 2) for t, w in zip(T, votes.spectral_reliability(m, T, alg))]
    return spark.createDataFrame(rows, "alg int, tool string, weight double").withColumn("weight", F.round("weight", 4))


@query("E10_dawid_skene")
def e10(spark, d):
    return patterns.dawid_skene(saved(U.matrix(spark, d), "matrix"), T)[0]


def _em_sql(steps: int = 25) -> str:
    """Expectation maximisation over the counted patterns: em has the probabilities before each step's posterior, by initial guess."""
    odds = "ln((max(a1) + 1) / (max(a0) + 1)) + sum(ln(((1 + y + e1) / (3 + a1)) / ((2 - y + e0) / (3 + a0))))"
    summed = "sum(n * p) OVER (PARTITION BY initial, tool{0}) AS {1}1, sum(n * (1 - p)) OVER (PARTITION BY initial, tool{0}) AS {1}0"
    return f""", pat AS MATERIALIZED (SELECT row_number() OVER () AS pid, * FROM (SELECT {', '.join(T)}, count(*) AS n FROM m GROUP BY ALL)),
v AS MATERIALIZED ({" UNION ALL ".join(f"SELECT pid, n, '{t}' AS tool, {t} AS y FROM pat" for t in T)}),
em AS (SELECT 0 AS step, initial, pid, CASE WHEN CASE WHEN initial = 'majority' THEN avg(y) ELSE max(y) END >= 0.5 THEN 0.9::DOUBLE ELSE 0.1 END AS p FROM v, (SELECT unnest(['majority', 'min_1']) AS initial) GROUP BY initial, pid
  UNION ALL SELECT step + 1, initial, pid, 1 / (1 + exp(-({odds}))) FROM (
    SELECT step, initial, pid, y, {summed.format(", y", "e")}, {summed.format("", "a")} FROM em JOIN v USING (pid) WHERE step < {steps}) GROUP BY step, initial, pid)
"""


@query("E10_dawid_skene_cells", _recursive(_em_sql() + f"SELECT recid, attr, initial, round(p, 6) AS p_error, CAST(p > 0.5 AS INTEGER) AS predicted FROM m JOIN pat USING ({', '.join(T)}) JOIN em USING (pid) WHERE step = 25"))
def e10c(spark, d):
    m = saved(U.matrix(spark, d), "matrix")
    found = [patterns.dawid_skene(m, T, 25, 0.0, i)[0].select("recid", "attr", F.lit(i).alias("initial"), F.round("p_error", 6).alias("p_error"), "predicted") for i in ("majority", "min_1")]
    return found[0].unionByName(found[1])


@query(
    "E10_dawid_skene_confusion",
    _recursive(_em_sql() + """, s AS (SELECT initial, tool, y, z, sum(CASE WHEN z = 1 THEN n * p ELSE n * (1 - p) END) AS e FROM em JOIN v USING (pid), (SELECT unnest([0, 1]) AS z) WHERE step = 24 GROUP BY ALL),
g AS (SELECT initial, tool, z, y, coalesce(e, 0) + 1 + CAST(y = z AS INTEGER) AS e FROM (SELECT DISTINCT initial, tool, z FROM s) CROSS JOIN (SELECT unnest([0, 1]) AS y) LEFT JOIN s USING (initial, tool, z, y))
SELECT initial, tool AS annotator, CAST(z AS INTEGER) AS truth, CAST(y AS INTEGER) AS y, round(e / sum(e) OVER (PARTITION BY initial, tool, z), 6) AS probability FROM g"""),
)
def e10d(spark, d):
    m = saved(U.matrix(spark, d), "matrix")
    found = [patterns.dawid_skene(m, T, 25, 0.0, i)[1].select(F.lit(i).alias("initial"), "annotator", "truth", "y", F.round("probability", 6).alias("probability")) for i in ("majority", "min_1")]
    return found[0].unionByName(found[1])


_TRIPLETS = " UNION ALL ".join(f"SELECT recid, attr, {i} AS annotator, {t} AS y FROM m" for i, t in enumerate(T, 1))


@query("E10_first_em_step", U.sql(f", t AS ({_TRIPLETS}), g AS (SELECT recid, attr, CAST(avg(y) >= 0.5 AS INTEGER) AS truth FROM t GROUP BY ALL) SELECT annotator, truth, y, count(*) AS expected FROM t JOIN g USING (recid, attr) GROUP BY ALL"))
def e10b(spark, d):
    return votes.first_em_step(C.vote_triplets(U.matrix(spark, d), T, ternary=False))


# -- similarity -----------------------------------------------------------------------------------------------------

_PAIRS = [(a, b) for i, a in enumerate(T) for b in T[i + 1 :]]


def _contingency(pairs, source: str = "m") -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, sum({a}) AS n_a, sum({b}) AS n_b, sum({a} * {b}) AS n_ab, sum(CAST({a} = {b} AS INTEGER)) AS agree FROM {source}" for a, b in pairs)


_PMI = "round(CASE WHEN n_ab > 0 THEN ln(n_ab * n / (n_a * n_b)) ELSE 0 END, 2)"
_CHANCE = "((n_a / n) * (n_b / n) + (1 - n_a / n) * (1 - n_b / n))"
_KAPPA = f"round(CASE WHEN {_CHANCE} <> 1 THEN (agree / n - {_CHANCE}) / (1 - {_CHANCE}) ELSE 0 END, 4)"
_COSINE = "round(CASE WHEN n_a * n_b > 0 THEN n_ab / (sqrt(n_a) * sqrt(n_b)) ELSE 0 END, 4)"
_TRUE = "(SELECT " + ", ".join(f"CAST({t} = label AS INTEGER) AS {t}" for t in T) + " FROM m)"


@query("F1_pmi", U.sql(f"SELECT a, b, {_PMI} AS pmi FROM ({_contingency(_PAIRS)})"))
def f1(spark, d):
    return similarity.pairwise_pmi(U.matrix(spark, d), T)


@query("F2_kappa", U.sql(f"SELECT a, b, {_KAPPA} AS kappa FROM ({_contingency(_PAIRS)}) WHERE {_KAPPA} >= -1"))
def f2(spark, d):
    return similarity.pairwise_kappa(U.matrix(spark, d), T, least=-1.0)


@query("F3_cosine", U.sql(f"SELECT a, b, {_COSINE} AS cosine FROM ({_contingency([('label', t) for t in T] + _PAIRS)})"))
def f3(spark, d):
    return similarity.pairwise_cosine(U.matrix(spark, d), T)


@query("F4_similarity_on_truth", U.sql(f"SELECT a, b, {_PMI} AS pmi, {_KAPPA} AS kappa, {_COSINE} AS cosine FROM ({_contingency(_PAIRS, _TRUE)})"))
def f4(spark, d):
    return similarity.pairwise_similarity(C.truth_matrix(U.matrix(spark, d), T), T)


#: Sets of tools (set_id, tools, tool) evaluated with min-1 to min-size.
_EVALUATE_SETS = """, sized AS (SELECT set_id, tools, count(*) AS size FROM sets GROUP BY ALL), voted AS (SELECT set_id, pid, label, n, sum(vote) AS votes FROM sets JOIN v USING (tool) GROUP BY ALL),
ks AS (SELECT set_id, tools, unnest(range(1, size + 1)) AS k FROM sized)
""" + U.scores_sql("SELECT tools, CAST(k AS INTEGER) AS k, CAST(coalesce(sum(n) FILTER (WHERE votes >= k AND label = 1), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (WHERE votes >= k AND label <> 1), 0) AS BIGINT) AS fp, CAST(coalesce(sum(n) FILTER (WHERE votes < k AND label = 1), 0) AS BIGINT) AS fn FROM ks JOIN voted USING (set_id) GROUP BY tools, k")


def _pmi_sets_sql(order: str) -> str:
    return f""", pairs AS (SELECT a, b, row_number() OVER (ORDER BY pmi {order}, a, b) AS rk FROM (SELECT a, b, {_PMI} AS pmi FROM ({_contingency(_PAIRS)}))),
members AS (SELECT DISTINCT i, tool FROM (SELECT unnest(range(1, 6)) AS i) JOIN (SELECT rk, unnest([a, b]) AS tool FROM pairs) ON rk <= i),
named AS (SELECT i, string_agg(tool, ',' ORDER BY tool) AS tools FROM members GROUP BY i), sets AS (SELECT min(i) OVER (PARTITION BY tools) AS set_id, tools, tool FROM named JOIN members USING (i) QUALIFY i = min(i) OVER (PARTITION BY tools))"""


@query("F5_pmi_tool_sets", U.sql(_LONG + _pmi_sets_sql("DESC") + _EVALUATE_SETS))
def f5(spark, d):
    return similarity.pmi_tool_sets(U.matrix(spark, d), T)


@query("F5_inverse_pmi_tool_sets", U.sql(_LONG + _pmi_sets_sql("ASC") + _EVALUATE_SETS))
def f5b(spark, d):
    return similarity.pmi_tool_sets(U.matrix(spark, d), T, inverse=True)


def _path_sql() -> str:
    rounds = ["p1 AS (SELECT 1 AS step, tool, CAST(hits AS BIGINT) AS hits FROM hits ORDER BY hits DESC, tool LIMIT 1)"]
    for i in range(1, len(T)):
        rounds.append(f"p{i + 1} AS (SELECT * FROM p{i} UNION ALL (SELECT {i + 1}, u.b, u.n_union FROM p{i} JOIN u ON u.a = p{i}.tool WHERE step = {i} AND u.b NOT IN (SELECT tool FROM p{i}) ORDER BY u.n_union DESC, u.b LIMIT 1))")
    union = f"SELECT a, b, CAST(n_a + n_b - n_ab AS BIGINT) AS n_union FROM ({_contingency(_PAIRS)})"
    return f", u AS ({union} UNION ALL SELECT b, a, n_union FROM ({union})), {', '.join(rounds)} SELECT step, tool, hits FROM p{len(T)}"


@query("F6_k_best_path", U.sql(_LONG + _path_sql()))
def f6(spark, d):
    return similarity.k_best_path(U.matrix(spark, d), T)


@query("F7_tool_precision", U.sql(" UNION ALL ".join(f"SELECT '{t}' AS tool, round(CASE WHEN sum({t}) > 0 THEN sum({t} * label) / sum({t}) ELSE 0 END, 3) AS precision FROM m" for t in T)))
def f7(spark, d):
    return similarity.tool_precision(U.matrix(spark, d), T)


def _sets_sql(sets) -> str:
    parts = []
    for s in sets:
        for k in range(1, len(s) + 1):
            yes = f"({' + '.join(s)} >= {k})"
            parts.append(f"SELECT '{','.join(s)}' AS tools, {k} AS k, count(*) FILTER (WHERE {yes} AND label = 1) AS tp, count(*) FILTER (WHERE {yes} AND label = 0) AS fp, count(*) FILTER (WHERE NOT {yes} AND label = 1) AS fn FROM m")
    return U.scores_sql(" UNION ALL ".join(parts))


def _combinations():
    import itertools

    return [c for k in range(2, len(T) + 1) for c in itertools.combinations(T, k)]


@query("F8_brute_force", U.sql(_sets_sql(_combinations())))
def f8(spark, d):
    return similarity.brute_force(U.matrix(spark, d), T)


@query("F8_brute_force_naive_bayes", U.sql(_LONG + f""", tr AS (SELECT * FROM m WHERE {hash_share_sql(['recid', 'attr'], 30)}), te AS (SELECT row_number() OVER () AS pid, label, {', '.join(T)}, count(*) AS n FROM m WHERE NOT {hash_share_sql(['recid', 'attr'], 30)} GROUP BY ALL),
c AS (SELECT count(*) FILTER (WHERE label = 1)::DOUBLE AS n1, count(*) FILTER (WHERE label <> 1)::DOUBLE AS n0, {', '.join(f"count(*) FILTER (WHERE label = 1 AND {t} = 1)::DOUBLE AS {t}_1, count(*) FILTER (WHERE label <> 1 AND {t} = 1)::DOUBLE AS {t}_0" for t in T)} FROM tr),
w AS ({" UNION ALL ".join(f"SELECT '{t}' AS tool, ln(({t}_1 + 1) / (n1 + 2)) - ln(({t}_0 + 1) / (n0 + 2)) AS yes, ln(1 - ({t}_1 + 1) / (n1 + 2)) - ln(1 - ({t}_0 + 1) / (n0 + 2)) AS no FROM c" for t in T)}),
long AS ({" UNION ALL ".join(f"SELECT pid, label, n, '{t}' AS tool, {t} AS vote FROM te" for t in T)}),
sets AS (SELECT tools, unnest(string_split(tools, ',')) AS tool FROM (SELECT unnest([{', '.join("'" + ','.join(x) + "'" for x in _combinations())}]) AS tools)),
s AS (SELECT tools, pid, label, n, sum(CASE WHEN vote = 1 THEN yes ELSE no END) + (SELECT ln(n1 + 1) - ln(n0 + 1) FROM c) > 0 AS flagged FROM sets JOIN w USING (tool) JOIN long USING (tool) GROUP BY ALL)
""" + U.scores_sql("SELECT tools, CAST(coalesce(sum(n) FILTER (WHERE flagged AND label = 1), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (WHERE flagged AND label <> 1), 0) AS BIGINT) AS fp, CAST(coalesce(sum(n) FILTER (WHERE NOT flagged AND label = 1), 0) AS BIGINT) AS fn FROM s GROUP BY tools")))
def f8b(spark, d):
    train, test = features.split(saved(U.matrix(spark, d), "matrix"), 30)
    return similarity.brute_force_naive_bayes(train, test, T)


@query("F9_best_k", U.sql(_LONG + """, by_precision AS (SELECT tool, row_number() OVER (ORDER BY round(CASE WHEN hits > 0 THEN tp / hits ELSE 0 END, 3) DESC, tool) AS rk FROM hits),
sets AS (SELECT i AS set_id, string_agg(tool, ',' ORDER BY rk) OVER (PARTITION BY i ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tools, tool FROM (SELECT unnest(range(2, 5)) AS i) JOIN by_precision ON rk <= i)""" + _EVALUATE_SETS))
def f9(spark, d):
    return similarity.best_k(U.matrix(spark, d), T)


@query("F10_tool_distances", U.sql(f"SELECT a, b, n - agree AS distance FROM ({_contingency(_PAIRS)})"))
def f10(spark, d):
    return similarity.tool_distances(U.matrix(spark, d), T)


@query("F10_cluster_tools")
def f10b(spark, d):
    return similarity.cluster_tools(U.matrix(spark, d), T, 3)


@query("F10_cluster_tools_bisecting")
def f10c(spark, d):
    return similarity.cluster_tools(C.truth_matrix(U.matrix(spark, d), T), T, 2, bisecting=True)


@query("F11_best_tool_per_cluster")
def f11(spark, d):
    return similarity.best_tool_per_cluster(U.matrix(spark, d), T, 3)


# -- evaluation -----------------------------------------------------------------------------------------------------


def _confusion(pred: str, source: str = "m", name: str = "") -> str:
    lead = f"'{name}' AS name, " if name else ""
    return f"SELECT {lead}count(*) FILTER (WHERE {pred} AND label = 1) AS tp, count(*) FILTER (WHERE {pred} AND label <> 1) AS fp, count(*) FILTER (WHERE NOT {pred} AND label = 1) AS fn, count(*) FILTER (WHERE NOT {pred} AND label <> 1) AS tn FROM {source}"


@query("I1_evaluate", U.sql(U.all_scores_sql(_confusion("(lookup = 1)"))))
def i1(spark, d):
    return E.evaluate(U.matrix(spark, d), F.col("lookup"))


@query("I2_evaluate_tools", U.sql(U.all_scores_sql(" UNION ALL ".join(_confusion(f"({t} = 1)", name=t) for t in T))))
def i2(spark, d):
    return E.evaluate_tools(U.matrix(spark, d), T)


@query("I3_evaluate_min_k", U.sql(U.all_scores_sql(" UNION ALL ".join(_confusion(f"({_SUM} >= {k})", name=f"min-{k}") for k in range(1, len(T) + 1)))))
def i3(spark, d):
    return E.evaluate_min_k(U.matrix(spark, d), T)


@query("I4_evaluate_sets", U.sql(U.scores_sql("SELECT count(*) FILTER (WHERE label = 1 AND fd = 1) AS tp, count(*) FILTER (WHERE label = 0 AND fd = 1) AS fp, count(*) FILTER (WHERE label = 1 AND fd = 0) AS fn FROM m")))
def i4(spark, d):
    m = U.matrix(spark, d)
    return E.evaluate_sets(m.where("label = 1"), m.where("fd = 1"))


@query("I5_to_prediction", U.sql("SELECT recid, attr, lookup AS prediction, label FROM m WHERE attr IN ('n_name', 'r_name')"))
def i5(spark, d):
    from cellwright.operators import detect

    votes_ = detect.lookup(U.dirty_cells(spark, d), U.dictionaries(spark, d)).join(U.diff(spark, d).select("recid", "attr", "label"), ["recid", "attr"])
    return E.to_prediction(votes_, "ec_lookup", "single")


@query("I6_evaluate_repair", U.sql(""", r AS (SELECT recid, attr, coalesce(replace(value, ' USD', ''), 'BUILDING') AS value FROM cells),
k AS (SELECT count(*) FILTER (WHERE r.value IS DISTINCT FROM d.value) AS repaired, count(*) FILTER (WHERE r.value IS DISTINCT FROM d.value AND r.value IS DISTINCT FROM c.value) AS incorrect,
 count(*) FILTER (WHERE d.value IS DISTINCT FROM c.value) AS errors, count(*) FILTER (WHERE d.value IS DISTINCT FROM c.value AND r.value IS DISTINCT FROM c.value) AS uncorrected FROM cells d JOIN r USING (recid, attr) JOIN ccells c USING (recid, attr)),
p AS (SELECT *, (repaired - incorrect) / repaired AS p, 1 - uncorrected / errors AS r FROM k)
SELECT repaired, incorrect, errors, uncorrected, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM p"""))
def i6(spark, d):
    dirty = U.dirty_cells(spark, d)
    repaired = dirty.withColumn("value", F.coalesce(F.replace("value", F.lit(" USD"), F.lit("")), F.lit("BUILDING")))
    return E.evaluate_repair(U.clean_cells(spark, d), repaired, dirty)


@query("I7_false_positive_profile", U.sql("SELECT attr, lookup, missing, count(*) AS n FROM m WHERE fd = 1 AND label = 0 GROUP BY ALL"))
def i7(spark, d):
    return E.false_positive_profile(U.matrix(spark, d), "fd", ["lookup", "missing"])


@query("I8_vote_patterns", U.sql(f"SELECT label, {', '.join(T)}, count(*) AS n FROM m GROUP BY ALL"))
def i8(spark, d):
    return E.vote_patterns(U.matrix(spark, d), T)


@query("I9_threshold_table", U.sql(f""", s AS (SELECT ({_SUM}) / 5 AS threshold, label FROM m), g AS (SELECT threshold, sum(label) AS p, sum(1 - label) AS q FROM s GROUP BY 1),
c AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(q) OVER (ORDER BY threshold DESC) AS fp, (SELECT sum(p) FROM g) AS every FROM g)
{U.scores_sql("SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(every - tp AS BIGINT) AS fn FROM c")}"""))
def i9(spark, d):
    total = F.lit(0)
    for t in T:
        total = total + F.col(t)
    return E.threshold_table(U.matrix(spark, d).select((total / F.lit(5)).alias("score"), "label"))


# -- features -------------------------------------------------------------------------------------------------------

_TOPSQL = "EXISTS (SELECT 1 FROM top t WHERE t.attr = c.attr AND t.value = c.value)"


@query("G1_missing_value", U.sql("SELECT recid, attr, CAST(value IS NULL AS INTEGER) AS missing_value FROM cells"))
def g1(spark, d):
    return features.content_features(U.dirty_cells(spark, d), U.SPEC).select("recid", "attr", "missing_value")


@query("G2_type_flags", U.sql("SELECT recid, attr, CAST(attr <> 'c_acctbal' AS INTEGER) AS is_string_type, CAST(attr = 'c_acctbal' AS INTEGER) AS is_integer_type FROM cells"))
def g2(spark, d):
    return features.content_features(U.dirty_cells(spark, d), U.SPEC).select("recid", "attr", "is_string_type", "is_integer_type")


@query("G3_type_one_hot")
def g3(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from cellwright.operators.models import one_hot

    cell = U.dirty_cells(spark, d).withColumn("kind", features.type_column(U.SPEC))
    out = Pipeline(stages=one_hot(["kind"])).fit(cell).transform(cell)
    return out.select("recid", "attr", vector_to_array("kind_vector").alias("kind_vector"))


def _one_hot_sql(rows: str, seen: str, kind: str, columns: str) -> str:
    """One-hot lists as text: slots by falling frequency among ``seen``, ties by text; the last slot is that of kinds not seen."""
    return f""", rows_ AS ({rows}), slots AS (SELECT {kind}, row_number() OVER (ORDER BY count(*) DESC, CAST({kind} AS VARCHAR)) - 1 AS slot FROM rows_ WHERE {seen} GROUP BY {kind}),
size AS (SELECT count(*) AS n FROM slots) SELECT {columns}, array_to_string([CASE WHEN i = coalesce(slot, n) THEN 1 ELSE 0 END FOR i IN range(n + 1)], ',') AS slots FROM rows_ LEFT JOIN slots USING ({kind}), size"""


def _slots(vector: str):
    from pyspark.ml.functions import vector_to_array

    return F.array_join(F.transform(vector_to_array(vector), lambda x: x.cast("int")), ",").alias("slots")


@query("G3_type_one_hot_listed", U.sql(_one_hot_sql("SELECT recid, attr, CASE attr WHEN 'c_acctbal' THEN 'Integer' ELSE 'String' END AS kind FROM cells", "true", "kind", "recid, attr, kind")))
def g3b(spark, d):
    from pyspark.ml import Pipeline

    from cellwright.operators.models import one_hot

    cell = U.dirty_cells(spark, d).withColumn("kind", features.type_column(U.SPEC))
    return Pipeline(stages=one_hot(["kind"])).fit(cell).transform(cell).select("recid", "attr", "kind", _slots("kind_vector"))


@query("G4_top10_and_tail", U.sql(f"SELECT recid, attr, CAST({_TOPSQL} AS INTEGER) AS is_top10, 1 - CAST({_TOPSQL} AS INTEGER) AS in_tail FROM cells c"))
def g4(spark, d):
    return features.content_features(U.dirty_cells(spark, d), U.SPEC).select("recid", "attr", "is_top10", "in_tail")


@query("G5_fd_one_flag", U.sql("SELECT recid, attr, CAST(attr IN ('n_name', 'r_name') AS INTEGER) AS fd0 FROM cells"))
def g5(spark, d):
    return features.fd_features(U.dirty_cells(spark, d), U.FDS).select("recid", "attr", "fd0")


@query("G6_fd_two_flags", U.sql("SELECT recid, attr, CAST(attr = 'n_name' AS INTEGER) AS fd0_lhs, CAST(attr = 'r_name' AS INTEGER) AS fd0_rhs FROM cells"))
def g6(spark, d):
    return features.fd_features(U.dirty_cells(spark, d), U.FDS, "two").select("recid", "attr", "fd0_lhs", "fd0_rhs")


@query("G7_fd_count", U.sql("SELECT recid, attr, CAST(attr IN ('n_name', 'r_name') AS INTEGER) AS fd_count FROM cells"))
def g7(spark, d):
    return features.fd_count_feature(U.dirty_cells(spark, d), U.FDS).select("recid", "attr", "fd_count")


@query("G8_fd_partitions", U.sql(", s AS (SELECT n_name, count(*) AS n FROM dirty GROUP BY 1) SELECT recid, unnest(['n_name', 'r_name']) AS attr, CASE WHEN n > 1 THEN n_name ELSE 'clust-zero' END AS cluster, n AS cluster_size FROM dirty JOIN s USING (n_name)"))
def g8(spark, d):
    return features.fd_partition_features(U.dirty(spark, d), "recid", U.FDS[0])


@query("G8_hashed_clusters")
def g8b(spark, d):
    from pyspark.ml.functions import vector_to_array

    out = features.hashed_clusters(features.fd_partition_features(U.dirty(spark, d), "recid", U.FDS[0]), 64)
    return out.select("recid", "attr", F.array_position(vector_to_array("cluster_vector"), 1.0).alias("place"))


@query("G9_vote_features", U.sql(f"SELECT recid, attr, {_SUM} AS n_agree FROM m"))
def g9(spark, d):
    return features.vote_features(U.matrix(spark, d), T).select("recid", "attr", "n_agree")


@query("G9_encoded_vote_features", U.sql(_one_hot_sql(f"SELECT recid, attr, {', '.join(T)}, {_SUM} AS n_agree, {hash_share_sql(['recid', 'attr'], 10)} AS training FROM m", "training", "n_agree", f"recid, attr, concat_ws(',', {', '.join(T)}) AS votes, n_agree")))
def g9b(spark, d):
    m = saved(U.matrix(spark, d), "matrix")
    out = features.encoded_vote_features(features.split(m, 10)[0], m, T)
    return out.select("recid", "attr", F.array_join("votes", ",").alias("votes"), "n_agree", _slots("agree_vector"))


@query("G10_assembled", U.sql(f"SELECT c.recid, c.attr, label, missing, lookup, CAST(value IS NULL AS INTEGER) AS missing_value, CAST({_TOPSQL} AS INTEGER) AS is_top10, CAST(c.attr IN ('n_name', 'r_name') AS INTEGER) AS fd0 FROM m JOIN cells c USING (recid, attr)"))
def g10(spark, d):
    cell = U.dirty_cells(spark, d)
    out = features.assemble([U.matrix(spark, d), features.content_features(cell, U.SPEC).drop("value"), features.fd_features(cell, U.FDS).drop("value")])
    return out.select("recid", "attr", "label", "missing", "lookup", "missing_value", "is_top10", "fd0")


def _joint_sql(expression: str, name: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{t}' AS feature, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS y, sum({t})::DOUBLE AS x, sum({t} * label)::DOUBLE AS b FROM m" for t in T)
    return U.sql(f"SELECT feature, {expression} AS {name} FROM ({parts})")


def _term(j: str, a: str, b: str) -> str:
    return f"CASE WHEN {j} > 0 THEN ({j}) / n * ln(({j}) * n / (({a}) * ({b}))) ELSE 0 END"


_FOUR = [("b", "x", "y"), ("x - b", "x", "n - y"), ("y - b", "n - x", "y"), ("n - x - y + b", "n - x", "n - y")]


@query("G11_label_correlation", _joint_sql("round(CASE WHEN x * (n - x) * y * (n - y) > 0 THEN (n * b - x * y) / (sqrt(x * (n - x)) * sqrt(y * (n - y))) ELSE 0 END, 4)", "correlation"))
def g11(spark, d):
    return features.label_correlation(U.matrix(spark, d), T)


@query("G12_mutual_information", _joint_sql("round(" + " + ".join(_term(*x) for x in _FOUR) + ", 4)", "mi"))
def g12(spark, d):
    return features.mutual_information(U.matrix(spark, d), T)


@query("G13_dependence_probability", _joint_sql("1 - (" + " + ".join(f"CASE WHEN abs(({j}) / n - (({a}) / n) * (({b}) / n)) <= 1e-6 THEN 1 ELSE 0 END" for j, a, b in _FOUR) + ") / 4.0::DOUBLE", "dependence"))
def g13(spark, d):
    return features.dependence_probability(U.matrix(spark, d), T)


def _h(p: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN -{p} * ln({p}) / ln(2) ELSE 0 END + CASE WHEN 1 - {p} > 0 THEN -(1 - {p}) * ln(1 - {p}) / ln(2) ELSE 0 END)"


@query("G14_information_gain", _joint_sql(f"round({_h('(y / n)')} - (CASE WHEN x > 0 THEN x / n * {_h('(b / x)')} ELSE 0 END + CASE WHEN n - x > 0 THEN (n - x) / n * {_h('((y - b) / (n - x))')} ELSE 0 END), 4)", "gain"))
def g14(spark, d):
    return features.information_gain(U.matrix(spark, d), T)


@query("G15_selected_features")
def g15(spark, d):
    m = U.matrix(spark, d)
    return m.select("recid", "attr", *features.select_features(m, T))


@query("G16_split", U.sql(f"SELECT recid, attr, CASE WHEN {hash_share_sql(['recid', 'attr'], 10)} THEN 'train' ELSE 'test' END AS part FROM m"))
def g16(spark, d):
    train, test = features.split(U.matrix(spark, d), 10)
    return train.select("recid", "attr", F.lit("train").alias("part")).union(test.select("recid", "attr", F.lit("test")))


