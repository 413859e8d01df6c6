"""Ranking metrics with explicit treatment of ties.

AUC groups by score first: with the positives p and negatives n of each score in order,
AUC = sum p * (negatives below + n / 2) / (P * N), the average-rank statistic without a
window over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import prefix


def roc_auc(scored: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, auc): ties count half; null where one class is missing."""
    return area(classes(scored, [*keys, score], label), score, keys)


def classes(scored: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """(by, p, n): the positives and negatives of each group."""
    good = F.col(label) > 0
    return scored.groupBy(*by).agg(F.sum(F.when(good, 1).otherwise(0)).alias("p"), F.sum(F.when(good, 0).otherwise(1)).alias("n"))


def area(per: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, auc) from the p positives and n negatives of each score."""
    by = [*keys]
    # the negatives at and below each score, in parts by range
    upto = prefix.running(per.withColumn("_n", F.col("n")), by, [score], {"_n": F.col("n")})
    beaten = F.sum(F.col("p") * (F.col("_n") - F.col("n") / 2))
    return upto.groupBy(*by).agg(F.try_divide(beaten, F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def average_precision(scored: DataFrame, score: str, label: str, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ap): mean precision at the positives in order of falling score, ties in order of the tie column."""
    by = [*keys]
    hit = F.when(F.col(label) > 0, 1).otherwise(0)
    falling = scored.select(*by, (-F.col(score)).alias("_falling"), F.col(tie).alias("_tie"), hit.alias("_hit"))
    ranked = prefix.running(falling, by, ["_falling", "_tie"], {"hits": F.col("_hit"), "place": F.lit(1)})
    return ranked.where("_hit = 1").groupBy(*by).agg(F.avg(F.col("hits") / F.col("place")).alias("ap"))


def against_negatives(positives: DataFrame, negatives: DataFrame, query: str, score: str) -> DataFrame:
    """(query, above, tied, n): how many negatives score above and as high as each query's positive."""
    p = positives.select(query, F.col(score).alias("_p"))
    j = negatives.select(query, F.col(score).alias("_n")).join(p, query)
    return j.groupBy(query).agg(
        F.sum(F.when(F.col("_n") > F.col("_p"), 1).otherwise(0)).alias("above"), F.sum(F.when(F.col("_n") == F.col("_p"), 1).otherwise(0)).alias("tied"), F.count(F.lit(1)).alias("n")
    )


def ranking(counts: DataFrame) -> DataFrame:
    """One row: mrr, recall at 1 and 10 and auc with the middle rank of ties."""
    beaten = F.col("above") + F.col("tied") / 2
    return counts.agg(
        F.avg(1 / (beaten + 1)).alias("mrr"), F.avg((beaten < 0.5).cast("int")).alias("r_at_1"), F.avg((beaten < 10).cast("int")).alias("r_at_10"), F.avg(1 - beaten / F.col("n")).alias("auc")
    )


def ranking_by_rank(counts: DataFrame) -> DataFrame:
    """As ranking, but a rank of exactly 1.5 and 10 still counts."""
    rank = F.col("above") + F.col("tied") / 2 + 1
    return counts.agg(F.avg(1 / rank).alias("mrr"), F.avg((rank <= 1.5).cast("int")).alias("r_at_1"), F.avg((rank <= 10).cast("int")).alias("r_at_10"))


def strict_mrr(counts: DataFrame) -> DataFrame:
    """One row: mrr where ties favour the positive."""
    return counts.agg(F.avg(1 / (F.col("above") + 1)).alias("mrr"))


def batched(scored: DataFrame, place: Column, size: int = 200, least: int = 8) -> DataFrame:
    """scored with its batch; batches of fewer than `least` rows are left out."""
    cut = scored.withColumn("batch", F.floor(place / size))
    return cut.join(cut.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("batch"), "batch", "left_semi")
