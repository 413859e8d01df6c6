"""Whether a bipartite graph is dense enough to learn from: degrees and two-hop reach per period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Median two-hop degrees from which a graph counts as viable and as marginal.
VIABLE, MARGINAL = 5, 3


def two_hop_counts(pairs: DataFrame) -> DataFrame:
    """(period, entity, n): how many other entities share a bridge in the period; pairs (period, entity, bridge) are distinct."""
    size = pairs.groupBy("period", "bridge").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("period", "bridge")
    live = pairs.join(size, ["period", "bridge"], "left_semi")
    other = live.withColumnRenamed("entity", "peer")
    met = live.join(other, ["period", "bridge"]).where("entity <> peer").select("period", "entity", "peer").distinct()
    return met.groupBy("period", "entity").agg(F.count(F.lit(1)).alias("n"))


def density_report(edges: DataFrame) -> DataFrame:
    """One row of figures; edges: (entity, bridge, period)."""
    pairs = edges.distinct()
    bridge = pairs.groupBy("period", "bridge").agg(F.count(F.lit(1)).alias("n"))
    entity = pairs.groupBy("period", "entity").agg(F.count(F.lit(1)).alias("n"))
    reach = two_hop_counts(pairs)
    mean = lambda c: F.round(F.avg(c), 6)
    a = edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("entity").alias("entities"), F.countDistinct("bridge").alias("bridges"), F.countDistinct("period").alias("periods"))
    b = bridge.agg(F.median("n").alias("bridge_degree_median"), mean("n").alias("bridge_degree_mean"), mean((F.col("n") > 1).cast("int")).alias("multi_entity_bridge_share"))
    c = entity.agg(F.median("n").alias("entity_degree_median"))
    t = reach.agg(F.median("n").alias("two_hop_degree_median"), mean("n").alias("two_hop_degree_mean"), mean((F.col("n") >= 5).cast("int")).alias("two_hop_ge5_share"))
    out = a.withColumn("k", F.lit(1))
    for one in (b, c, t):  # each has one row
        out = out.join(F.broadcast(one.withColumn("k", F.lit(1))), "k")
    return out.drop("k")


def verdict(two_hop_median: float) -> str:
    return "VIABLE" if two_hop_median >= VIABLE else "MARGINAL" if two_hop_median >= MARGINAL else "TOO SPARSE"
