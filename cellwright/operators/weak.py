"""Weak supervision: every rule gives a cell one vote of +1 or -1; a positive sum is an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.operators.profile import top_values
from cellwright.spec import FD


def rule_votes(cell: DataFrame, df: DataFrame, record_id: str, fds: list[FD], dictionaries: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """recid, attr, rule, vote.

    Rules: in the tail of the attribute's values +1; missing +1; among the k most frequent -1; in the attribute's
    dictionary -1; and for the right-hand cell of each dependency +1 if its group has another value, -1 if another
    record of the group agrees, -1 more if the agreed value is among the k most frequent. Group counts replace pairs.
    """
    top = top_values(cell, k).select("attr", "value").withColumn("top_", F.lit(True))
    ranked = cell.join(F.broadcast(top), ["attr", "value"], "left")
    vote = lambda df, rule, v: df.select("recid", "attr", F.lit(rule).alias("rule"), F.lit(v).alias("vote"))
    votes = [
        vote(ranked.where("top_ IS NULL AND value IS NOT NULL"), "tail", 1),
        vote(ranked.where("value IS NULL"), "missing", 1),
        vote(ranked.where("top_"), "top", -1),
    ]
    for attr, words in dictionaries.items():
        known = words.select(F.upper(F.trim(F.col(words.columns[0]).cast("string"))).alias("key_")).distinct()
        own = cell.where(F.col("attr") == attr).withColumn("key_", F.upper(F.trim("value")))
        votes.append(vote(own.join(known, "key_", "left_semi"), f"dictionary {attr}", -1))
    for i, fd in enumerate(fds):
        rhs, ks = fd.rhs[0], [f"k{j}" for j in range(len(fd.lhs))]
        wide = df.select(F.col(record_id).alias("recid"), *[F.col(c).cast("string").alias(f"k{j}") for j, c in enumerate(fd.lhs)], F.col(rhs).cast("string").alias("own")).where("own IS NOT NULL").dropna(subset=ks)
        same = wide.groupBy(*ks, "own").agg(F.count("*").alias("same"))
        every = same.groupBy(*ks).agg(F.sum("same").alias("every"))
        facts = wide.join(same, [*ks, "own"]).join(every, ks).withColumn("attr", F.lit(rhs))
        votes.append(vote(facts.where("every > same"), f"fd{i} conflict", 1))
        votes.append(vote(facts.where("same > 1"), f"fd{i} agreement", -1))
        peers = facts.where("same > 1").join(F.broadcast(top.select("attr", F.col("value").alias("own"))), ["attr", "own"], "left_semi")
        votes.append(vote(peers, f"fd{i} frequent agreement", -1))
    return reduce(DataFrame.unionByName, votes)


def weak_supervision(cell: DataFrame, df: DataFrame, record_id: str, fds: list[FD], dictionaries: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """recid, attr, total, prediction of every cell; cells without votes have total 0."""
    sums = rule_votes(cell, df, record_id, fds, dictionaries, k).groupBy("recid", "attr").agg(F.sum("vote").alias("total"))
    return cell.select("recid", "attr").join(sums, ["recid", "attr"], "left").select("recid", "attr", F.coalesce("total", F.lit(0)).alias("total")).withColumn("prediction", (F.col("total") > 0).cast("int"))
