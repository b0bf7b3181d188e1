"""Features of cells for supervised combination, and how much they tell about the label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.samples import hash_share
from cellwright.functions.numeric import ratio, safe_ln
from cellwright.operators.profile import top_values
from cellwright.spec import FD, SEMANTIC_TYPES, TableSpec


def type_flag(kind: str) -> str:
    return f"is_{kind.lower().replace(' ', '_').replace('/', '_')}_type"


def content_features(cell: DataFrame, spec: TableSpec, k: int = 10, globally: bool = False) -> DataFrame:
    """Adds missing_value, one flag a semantic type in use, is_top10 and in_tail.

    Frequent values are those of the cell's own attribute; with ``globally`` those of any attribute. The lists have at most
    k rows per attribute and are broadcast.
    """
    top = top_values(cell, k).select(*([] if globally else ["attr"]), "value").distinct().withColumn("is_top10", F.lit(1))
    out = cell.join(F.broadcast(top), ["value"] if globally else ["attr", "value"], "left").na.fill(0, ["is_top10"])
    used = [t for t in SEMANTIC_TYPES if any(spec.type_of(c) == t for c in spec.columns)]
    flags = {type_flag(t): F.col("attr").isin(*[c for c in spec.columns if spec.type_of(c) == t]).cast("int") for t in used}
    return out.withColumns({"missing_value": F.col("value").isNull().cast("int"), "in_tail": 1 - F.col("is_top10"), **flags})


def type_column(spec: TableSpec) -> Column:
    """The semantic type of the cell's attribute, for indexing and one-hot encoding."""
    return F.create_map(*[F.lit(x) for c in spec.columns for x in (c, spec.type_of(c))])[F.col("attr")]


def fd_features(cell: DataFrame, fds: list[FD], mode: str = "one") -> DataFrame:
    """mode one: fd<i> for each dependency the attribute takes part in; mode two: fd<i>_lhs and fd<i>_rhs."""
    flag = lambda names: F.col("attr").isin(*names).cast("int")
    if mode == "one":
        return cell.withColumns({f"fd{i}": flag(fd.attributes) for i, fd in enumerate(fds)})
    return cell.withColumns({f"fd{i}_{side}": flag(names) for i, fd in enumerate(fds) for side, names in (("lhs", fd.lhs), ("rhs", fd.rhs))})


def fd_count_feature(cell: DataFrame, fds: list[FD]) -> DataFrame:
    """Adds fd_count: in how many dependencies the attribute stands."""
    total = F.lit(0)
    for fd in fds:
        total = total + F.col("attr").isin(*fd.attributes).cast("int")
    return cell.withColumn("fd_count", total)


def fd_partition_features(df: DataFrame, record_id: str, fd: FD) -> DataFrame:
    """recid, attr, cluster, cluster_size of the cells in a dependency.

    A cluster is a group of records with equal left-hand values; groups of one record are ``clust-zero``. Clusters are as
    many as values, so they are hashed, not one-hot encoded.
    """
    keys = [f"k{i}" for i in range(len(fd.lhs))]
    rows = df.select(F.col(record_id).alias("recid"), *[F.col(c).cast("string").alias(k) for c, k in zip(fd.lhs, keys)])
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("cluster_size"))
    both = rows.alias("r").join(sizes.alias("s"), reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]))
    name = F.when(F.col("cluster_size") > 1, F.concat_ws("|", *[F.col(f"r.{k}") for k in keys])).otherwise("clust-zero")
    joined = both.select("recid", name.alias("cluster"), "cluster_size")
    return joined.select("recid", F.explode(F.array(*[F.lit(a) for a in fd.attributes])).alias("attr"), "cluster", "cluster_size")


def hashed_clusters(clusters: DataFrame, width: int = 256) -> DataFrame:
    """Adds a sparse vector of a fixed width for the cluster."""
    from pyspark.ml.feature import FeatureHasher

    return FeatureHasher(inputCols=["cluster"], outputCol="cluster_vector", numFeatures=width).transform(clusters)


def vote_features(matrix: DataFrame, tools: list[str]) -> DataFrame:
    """Adds votes (array) and n_agree."""
    return matrix.withColumn("votes", F.array(*[F.col(t).cast("int") for t in tools])).withColumn("n_agree", F.aggregate("votes", F.lit(0), lambda s, v: s + (v == 1).cast("int")))


def encoded_vote_features(train: DataFrame, df: DataFrame, tools: list[str]) -> DataFrame:
    """``vote_features`` of ``df`` with agree_vector: n_agree one-hot, slots by falling frequency in ``train``, ties by text.

    The encoder sees training rows only; a number of agreeing tools that ``train`` lacks has the last slot.
    """
    from pyspark.ml import Pipeline

    from cellwright.operators.models import one_hot

    rows = lambda d: vote_features(d, tools).withColumn("agree", F.col("n_agree").cast("string"))
    return Pipeline(stages=one_hot(["agree"])).fit(rows(train)).transform(rows(df)).drop("agree", "agree_index")


def assemble(parts: list[DataFrame]) -> DataFrame:
    """All parts joined on the cell; columns of the same name are taken from the first part that has them."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p.select("recid", "attr", *[c for c in p.columns if c not in out.columns]), ["recid", "attr"])
    return out


def split(df: DataFrame, share_percent: int = 10, key: tuple[str, ...] = ("recid", "attr")) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the cell: the same rows however the data are partitioned."""
    inside = hash_share(key, share_percent)
    return df.where(inside), df.where(~inside)


def _joint(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, n, n_x, n_y, n_xy of flags against the label, in one aggregation."""
    row = df.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_y"), *[F.count_if(F.col(f) == 1).alias(f"x{i}") for i, f in enumerate(features)], *[F.count_if((F.col(f) == 1) & (F.col("label") == 1)).alias(f"b{i}") for i, f in enumerate(features)])
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"x{i}").alias("n_x"), F.col(f"b{i}").alias("n_xy")) for i, f in enumerate(features)])
    return row.select("n", "n_y", F.explode(parts).alias("r")).select("n", "n_y", "r.*")


def _cells() -> list[tuple[Column, Column, Column]]:
    """(joint, marginal of the feature, marginal of the label) of the four cells."""
    n, x, y, b = (F.col(c) for c in ("n", "n_x", "n_y", "n_xy"))
    return [(b, x, y), (x - b, x, n - y), (y - b, n - x, y), (n - x - y + b, n - x, n - y)]


def label_correlation(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, correlation (Pearson, 4 digits; 0 where undefined)."""
    n, x, y, b = (F.col(c).cast("double") for c in ("n", "n_x", "n_y", "n_xy"))
    r = ratio(n * b - x * y, F.sqrt(x * (n - x)) * F.sqrt(y * (n - y)))
    return _joint(df, features).select("feature", F.round(r, 4).alias("correlation"))


def mutual_information(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, mi in nats (4 digits); empty cells add nothing."""
    n = F.col("n").cast("double")
    terms = [ratio(j, n) * safe_ln(ratio(j * n, a.cast("double") * b)) for j, a, b in _cells()]
    return _joint(df, features).select("feature", F.round(terms[0] + terms[1] + terms[2] + terms[3], 4).alias("mi"))


def dependence_probability(df: DataFrame, features: list[str], tolerance: float = 1e-6) -> DataFrame:
    """feature, dependence: share of the four cells whose probability is not the product of the marginals."""
    n = F.col("n").cast("double")
    same = [F.when(F.abs(ratio(j, n) - ratio(a, n) * ratio(b, n)) <= tolerance, 1).otherwise(0) for j, a, b in _cells()]
    return _joint(df, features).select("feature", (1 - (same[0] + same[1] + same[2] + same[3]) / F.lit(4.0)).alias("dependence"))


def information_gain(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, gain in bits (4 digits): entropy of the label less its entropy given the feature."""
    h = lambda p: -p * safe_ln(p) / F.ln(F.lit(2.0)) - (1 - p) * safe_ln(1 - p) / F.ln(F.lit(2.0))
    n, x, y, b = (F.col(c).cast("double") for c in ("n", "n_x", "n_y", "n_xy"))
    given = ratio(x, n) * h(ratio(b, x)) + ratio(n - x, n) * h(ratio(y - b, n - x))
    return _joint(df, features).select("feature", F.round(h(ratio(y, n)) - given, 4).alias("gain"))


def select_features(df: DataFrame, features: list[str], min_mi: float = 0.0) -> list[str]:
    """Features with more mutual information than ``min_mi``."""
    return [r.feature for r in mutual_information(df, features).where(F.col("mi") > min_mi).orderBy("feature").collect()]
