"""Repair logs, candidate values and their choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.numeric import ratio
from cellwright.operators.cells import cells
from cellwright.operators.components import join_facts
from cellwright.operators.profile import top_values
from cellwright.session import saved
from cellwright.spec import FD, TableSpec

NO_REPAIR = "#NO-REPAIR#"


def repair_log(repaired: DataFrame, spec: TableSpec) -> DataFrame:
    """recid, attr, new_value of a repaired table, without cells marked as not repaired."""
    return cells(repaired, spec).where(~F.col("value").eqNullSafe(F.lit(NO_REPAIR))).withColumnRenamed("value", "new_value")


def repair_log_from_audit(audit: DataFrame, dirty: DataFrame, spec: TableSpec) -> DataFrame:
    """recid, attr, new_value: the latest entry of an audit table (tupleid, attribute, newvalue, time) for each cell of the table."""
    entry = audit.where(F.col("attribute").isin(*spec.columns)).select(F.col("tupleid").alias("recid"), F.col("attribute").alias("attr"), F.struct("time", "newvalue").alias("e"))
    latest = entry.groupBy("recid", "attr").agg(F.max("e").alias("e")).select("recid", "attr", F.col("e.newvalue").alias("new_value"))
    return latest.join(dirty.select(F.col(spec.record_id).alias("recid")), "recid", "left_semi")


def impute_by_group(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with the missing values of ``columns`` replaced by the smallest value of their group, the others by NO_REPAIR.

    A group without any value leaves null. Groups are aggregated and joined back, so a large group stays spread.
    """
    facts = df.groupBy(key).agg(*[F.min(F.when(F.trim(c) != "", F.col(c))).alias(f"{c}_new_") for c in columns])
    joined = df.alias("d").join(facts.withColumnRenamed(key, "key_"), F.col(f"d.{key}").eqNullSafe(F.col("key_")))
    blank = lambda c: F.col(f"d.{c}").isNull() | (F.trim(F.col(f"d.{c}")) == "")
    return joined.select(*[F.when(blank(c), F.col(f"{c}_new_")).otherwise(NO_REPAIR).alias(c) if c in columns else F.col(f"d.{c}") for c in df.columns])


def merge_repairs(logs: dict[str, DataFrame]) -> DataFrame:
    """recid, attr and one column a log, NO_REPAIR where a log says nothing."""
    tagged = reduce(DataFrame.unionByName, [df.select("recid", "attr", "new_value").withColumn("log_", F.lit(n)) for n, df in logs.items()])
    return tagged.groupBy("recid", "attr").agg(*[F.coalesce(F.max(F.when(F.col("log_") == n, F.col("new_value"))), F.lit(NO_REPAIR)).alias(n) for n in logs])


def clean_domain(predicted: DataFrame) -> DataFrame:
    """attr, value, cnt of the cells predicted clean. predicted: recid, attr, value, prediction."""
    return predicted.where("prediction = 0 AND value IS NOT NULL").groupBy("attr", "value").agg(F.count("*").alias("cnt"))


def fd_repairs(predicted: DataFrame, df: DataFrame, record_id: str, fds: list[FD]) -> DataFrame:
    """recid, attr, candidate: for erroneous right-hand cells the right-hand values that clean cells have with the same left-hand values."""
    out = []
    bad = predicted.where("prediction = 1")
    for fd in fds:
        rhs, k = fd.rhs[0], [f"k{i}" for i in range(len(fd.lhs))]
        wide = df.select(F.col(record_id).alias("recid"), *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(fd.lhs)], F.col(rhs).cast("string").alias("candidate"))
        dirty = bad.where(F.col("attr").isin(*fd.attributes)).select("recid").distinct()
        known = wide.join(dirty, "recid", "left_anti").where("candidate IS NOT NULL").select(*k, "candidate").distinct()
        wrong = wide.join(bad.where(F.col("attr") == rhs).select("recid"), "recid", "left_semi").select("recid", *k)
        out.append(wrong.join(known, k).select("recid", F.lit(rhs).alias("attr"), "candidate"))
    return reduce(DataFrame.unionByName, out).distinct()


def histogram_repairs(predicted: DataFrame, k: int = 10) -> DataFrame:
    """recid, attr, candidate: the most frequent values of the attribute for its erroneous cells."""
    top = top_values(predicted.select("recid", "attr", "value"), k).select("attr", F.col("value").alias("candidate"))
    return predicted.where("prediction = 1").select("recid", "attr").join(F.broadcast(top), "attr").select("recid", "attr", "candidate")


def combine_repairs(candidates: DataFrame, n_sources: int = 5, least: float = 0.2) -> DataFrame:
    """recid, attr, values: by falling share of sources that propose them, ties by value.

    candidates: recid, attr, source, candidate. Values are compared in lower case; if any has a share above ``least``,
    only such values stay.
    """
    share = candidates.where("candidate IS NOT NULL").groupBy("recid", "attr", F.lower("candidate").alias("candidate")).agg((F.countDistinct("source") / F.lit(float(n_sources))).alias("share"))
    top = F.max("share").over(Window.partitionBy("recid", "attr"))
    kept = share.withColumn("top_", top).where((F.col("top_") <= least) | (F.col("share") > least))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("s"), F.col("candidate"))))
    return kept.groupBy("recid", "attr").agg(ordered.alias("r")).select("recid", "attr", F.col("r.candidate").alias("values"))


def combine_with_domain(candidates: DataFrame, domain: DataFrame, errors: DataFrame, n_sources: int = 5, least: float = 0.2, first: int = 3) -> DataFrame:
    """recid, attr, values, whole_domain, first, first_three: repairs by falling share of sources, for every cell of ``errors``.

    ``candidates`` (recid, attr, source, candidate) are what sources propose; the clean values of the attribute (``domain``:
    attr, value) are one source more, as a set, and are never spread over the cells. A value is worth more than ``least``
    only if some source proposes it, so where any value is, ``values`` is the whole answer. Where none is, all proposals
    and all clean values are equally good: ``values`` then holds the proposals, ``whole_domain`` says that the clean
    values belong there too, and the first ones come from the attribute's smallest values. Values are compared in lower case.
    """
    known = saved(domain.where("value IS NOT NULL").select("attr", F.lower("value").alias("candidate")).distinct(), "domain")
    proposed = candidates.where("candidate IS NOT NULL").groupBy("recid", "attr", F.lower("candidate").alias("candidate")).agg(F.countDistinct("source").alias("n"))
    share = join_facts(proposed, known.withColumn("clean", F.lit(1)), ["attr", "candidate"], "recid").withColumn("share", (F.col("n") + F.coalesce("clean", F.lit(0))) / F.lit(float(n_sources)))
    top = F.max("share").over(Window.partitionBy("recid", "attr"))
    kept = share.withColumn("top_", top).where((F.col("top_") <= least) | (F.col("share") > least))
    listed = kept.groupBy("recid", "attr").agg(F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("s"), F.col("candidate")))).alias("r"), F.first("top_").alias("top_"))
    smallest = known.withColumn("k", F.row_number().over(Window.partitionBy("attr").orderBy("candidate"))).where(F.col("k") <= first).groupBy("attr").agg(F.array_sort(F.collect_list("candidate")).alias("smallest"))
    none = F.array().cast("array<string>")
    cell = errors.select("recid", "attr").join(listed, ["recid", "attr"], "left").join(F.broadcast(smallest), "attr", "left")  # a row an attribute
    values, whole = F.coalesce(F.col("r.candidate"), none), F.coalesce(F.col("top_") <= least, F.lit(True))
    ordered = F.when(whole, F.slice(F.array_sort(F.array_distinct(F.concat(values, F.coalesce("smallest", none)))), 1, first)).otherwise(F.slice(values, 1, first))
    return cell.select("recid", "attr", values.alias("values"), whole.alias("whole_domain"), F.get(ordered, F.lit(0)).alias("first"), ordered.alias("first_three"))


def repair_summary(candidates: DataFrame, domain: DataFrame, errors: DataFrame, clean_cells: DataFrame, sources: list[str], **params) -> DataFrame:
    """source, n, found, pct_found over all erroneous cells whose true value is not null.

    Rows: each of ``sources``, the attribute's clean values, the combination of all, its first three values, its first one.
    """
    cell = saved(errors.select("recid", "attr").join(clean_cells.where("value IS NOT NULL").select("recid", "attr", F.lower("value").alias("truth")), ["recid", "attr"]), "errors")
    known = saved(domain.where("value IS NOT NULL").select("attr", F.lower("value").alias("truth")).distinct(), "domain")
    hit = candidates.join(cell, ["recid", "attr"]).where(F.lower("candidate") == F.col("truth")).groupBy("recid", "attr").agg(F.collect_set("source").alias("by"))
    combined = combine_with_domain(candidates, domain, cell, **params)
    every = join_facts(cell, known.withColumn("in_domain", F.lit(True)), ["attr", "truth"], "recid").join(hit, ["recid", "attr"], "left").join(combined, ["recid", "attr"])
    clean = F.coalesce("in_domain", F.lit(False))
    found = {s: F.array_contains("by", s) for s in sources} | {
        "clean values": clean,
        "combined": F.array_contains("values", F.col("truth")) | (F.col("whole_domain") & clean),
        "first three": F.array_contains("first_three", F.col("truth")),
        "single": F.col("first") == F.col("truth"),
    }
    row = every.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"found{i}") for i, c in enumerate(found.values())])
    parts = F.array(*[F.struct(F.lit(name).alias("source"), F.col("n"), F.col(f"found{i}").alias("found")) for i, name in enumerate(found)])
    return row.select(F.explode(parts).alias("r")).select("r.*").withColumn("pct_found", F.round(ratio(100 * F.col("found"), F.col("n")), 4))


def suggestions(combined: DataFrame) -> DataFrame:
    """recid, attr, first, first_three."""
    return combined.select("recid", "attr", F.get("values", F.lit(0)).alias("first"), F.slice("values", 1, 3).alias("first_three"))


def with_truth(df: DataFrame, clean_cells: DataFrame) -> DataFrame:
    return df.join(clean_cells.select("recid", "attr", F.col("value").alias("truth")), ["recid", "attr"])


def repair_coverage(candidates: DataFrame, clean_cells: DataFrame) -> DataFrame:
    """source, n, found, pct_found: cells for which a source proposes anything and proposes the true value."""
    one = with_truth(candidates, clean_cells).groupBy("source", "recid", "attr").agg(F.max((F.lower("candidate") == F.lower("truth")).cast("int")).alias("hit"))
    return one.groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found")).withColumn("pct_found", F.round(ratio(100 * F.col("found"), F.col("n")), 4))


def overlap_patterns(candidates: DataFrame, clean_cells: DataFrame, sources: list[str]) -> DataFrame:
    """How often each combination of sources finds the truth."""
    hits = [F.max(F.when((F.col("source") == s) & (F.lower("candidate") == F.lower("truth")), 1).otherwise(0)).alias(s) for s in sources]
    return with_truth(candidates, clean_cells).groupBy("recid", "attr").agg(*hits).groupBy(*sources).agg(F.count("*").alias("n"))


def candidate_domain(predicted: DataFrame, least: int = 1) -> DataFrame:
    """recid, attr, candidate: for erroneous cells all clean values of the attribute seen ``least`` times, for clean ones their own."""
    domain = clean_domain(predicted).where(F.col("cnt") >= least).select("attr", F.col("value").alias("candidate"))
    wrong = predicted.where("prediction = 1").select("recid", "attr").join(domain, "attr").select("recid", "attr", "candidate")
    return wrong.unionByName(predicted.where("prediction = 0").select("recid", "attr", F.col("value").alias("candidate")))


def cooccurrence(cell: DataFrame, least: int = 1) -> DataFrame:
    """attr, value, given_attr, given_value, n, p: probability of a value given another attribute's value in the same record."""
    known = cell.where("value IS NOT NULL")
    other = known.select("recid", F.col("attr").alias("given_attr"), F.col("value").alias("given_value"))
    pairs = known.join(other, "recid").where("attr <> given_attr").groupBy("attr", "value", "given_attr", "given_value").agg(F.count("*").alias("n"))
    given = pairs.groupBy("attr", "given_attr", "given_value").agg(F.sum("n").alias("all_"))
    return pairs.where(F.col("n") >= least).join(given, ["attr", "given_attr", "given_value"]).withColumn("p", ratio(F.col("n"), F.col("all_"))).drop("all_")


def prune_domain(predicted: DataFrame, tau: float, least: int = 1) -> DataFrame:
    """recid, attr, candidate, p: clean values that occur with another value of the record with a probability of ``tau`` or more; p is the largest.

    Candidates come from the co-occurrence table by the record's own values, so the full domain is never spread out.
    """
    cell = predicted.select("recid", "attr", "value")
    wrong = predicted.where("prediction = 1").select("recid", "attr")
    given = wrong.join(cell.select("recid", F.col("attr").alias("given_attr"), F.col("value").alias("given_value")), "recid").where("attr <> given_attr AND given_value IS NOT NULL")
    table = cooccurrence(cell, least).where(F.col("p") >= tau).join(clean_domain(predicted).select("attr", "value"), ["attr", "value"], "left_semi")
    met = given.join(table, ["attr", "given_attr", "given_value"])
    return met.groupBy("recid", "attr", F.col("value").alias("candidate")).agg(F.max("p").alias("p"))


def domain_sizes(predicted: DataFrame, taus: list[float], least: int = 1) -> DataFrame:
    """tau, attr, n_cells, n_candidates, n_covered: what is left of the candidate domains of erroneous cells at each tau.

    n_candidates counts pairs of an erroneous cell and a candidate. At tau 0 that is the whole clean domain for every
    error, a product that is counted as one and never made; above 0 it comes from the co-occurrence join. n_covered is
    the number of erroneous cells that keep any candidate.
    """
    wrong = predicted.where("prediction = 1").groupBy("attr").agg(F.count("*").alias("n_cells"))
    values = clean_domain(predicted).groupBy("attr").agg(F.count("*").alias("n_values"))
    whole = wrong.join(values, "attr", "left").select(F.lit(0.0).alias("tau"), "attr", (F.col("n_cells") * F.coalesce("n_values", F.lit(0))).alias("n_candidates"), F.when(F.col("n_values") > 0, F.col("n_cells")).otherwise(F.lit(0)).alias("n_covered"))
    above = sorted(t for t in taus if t > 0)
    per_tau = [F.struct(F.lit(float(t)).alias("tau"), F.count_if(F.col("p") >= t).alias("n")) for t in above]
    per_cell = prune_domain(predicted, above[0], least).groupBy("attr", "recid").agg(F.array(*per_tau).alias("at")).select("attr", F.explode("at").alias("at"))
    left = per_cell.groupBy("at.tau", "attr").agg(F.sum("at.n").alias("n_candidates"), F.count_if(F.col("at.n") > 0).alias("n_covered"))
    grid = wrong.select("attr", F.explode(F.array(*[F.lit(float(t)) for t in above])).alias("tau"))  # a row an attribute and tau
    pruned = grid.join(left, ["tau", "attr"], "left").select("tau", "attr", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_covered", F.lit(0)).alias("n_covered"))
    return whole.where(F.lit(0.0 in taus or 0 in taus)).unionByName(pruned).join(wrong, "attr").select("tau", "attr", "n_cells", "n_candidates", "n_covered")


def pruned_candidate_domain(predicted: DataFrame, tau: float, least: int = 1) -> DataFrame:
    """recid, attr, candidate: for erroneous cells of every attribute the candidates of ``prune_domain``, for clean ones their own value."""
    own = predicted.where("prediction = 0").select("recid", "attr", F.col("value").alias("candidate"))
    return prune_domain(predicted, tau, least).select("recid", "attr", "candidate").unionByName(own)


def score_candidates(candidates: DataFrame, df: DataFrame, record_id: str, fds: list[FD], domain: float = 0.5, initial: float = 0.5, violation: float = -1.0) -> DataFrame:
    """recid, attr, candidate, score: a weight for each candidate of the domain, one for the initial value, one for each dependency it would break.

    A candidate for a right-hand cell breaks a dependency if the record's left-hand values occur with another right-hand
    value in other records; that is read from counts by group.
    """
    long = cells(df, TableSpec(record_id, tuple(c for c in df.columns if c != record_id)))
    start = candidates.join(long, ["recid", "attr"], "left").select("recid", "attr", "candidate", (F.lit(domain) + F.when(F.col("candidate").eqNullSafe(F.col("value")), initial).otherwise(0.0)).alias("score"))
    for fd in fds:
        rhs, k = fd.rhs[0], [f"k{i}" for i in range(len(fd.lhs))]
        wide = df.select(F.col(record_id).alias("recid"), *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(fd.lhs)], F.col(rhs).cast("string").alias("own"))
        by_value = wide.groupBy(*k, "own").agg(F.count("*").alias("n"))
        by_group = by_value.groupBy(*k).agg(F.sum(F.when(F.col("own").isNotNull(), F.col("n"))).alias("all_"))
        role = start.where(F.col("attr") == rhs).select("recid", "attr", "candidate").join(wide, "recid").join(by_group, k)
        role = role.join(by_value.select(*k, F.col("own").alias("candidate"), F.col("n").alias("same")), [*k, "candidate"], "left")
        # records of the group with another value, not counting this record
        other = F.coalesce("all_", F.lit(0)) - F.coalesce("same", F.lit(0)) - F.when(F.col("own").isNotNull() & (F.col("own") != F.col("candidate")), 1).otherwise(0)
        broken = role.where(other > 0).select("recid", "attr", "candidate", F.lit(violation).alias("off_"))
        start = start.join(broken, ["recid", "attr", "candidate"], "left").select("recid", "attr", "candidate", (F.col("score") + F.coalesce("off_", F.lit(0.0))).alias("score"))
    return start


def best_candidate(scored: DataFrame) -> DataFrame:
    """The candidates with the highest score of their cell, if it is positive; ties stay."""
    top = F.max("score").over(Window.partitionBy("recid", "attr"))
    return scored.withColumn("top_", top).where("score = top_ AND score > 0").drop("top_")
