"""Links that hold for a span of days: overlaps, links alive at an instant, two-hop links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "2100-01-01"


def overlapping(links: DataFrame, low: Column, high: Column) -> DataFrame:
    """(s, c, ts, weight): links whose span meets [low, high], dated from low on; a pair's first link counts, links without an end don't."""
    met = links.where((F.col("start_") <= high) & (F.col("end_") >= low)).withColumn("ts", F.greatest("start_", low))
    w = Window.partitionBy("s", "c").orderBy("start_", "end_")
    return met.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def alive_at(links: DataFrame, asked: DataFrame, key: str, bucket_days: int = 90) -> DataFrame:
    """asked (key, when) joined with the links alive then: start <= when < end, a null end being open.

    Spans are cut into date buckets, so that the join is an equi-join on key and bucket with a range residual.
    """
    day = lambda c: F.floor(F.unix_date(c) / bucket_days)
    bounded = links.withColumn("end_", F.coalesce("end_", F.lit(OPEN_END).cast("date"))).where("start_ < end_")
    cut = bounded.withColumn("bucket", F.explode(F.sequence(day(F.col("start_")), day(F.date_sub("end_", 1)))))
    q = asked.withColumn("bucket", day(F.col("when")))
    return q.join(cut, [key, "bucket"]).where("start_ <= when and when < end_").drop("bucket")


def two_hop_alive(links: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(c, when, s2): suppliers of the suppliers alive at `when`, neither suppliers nor the asking customer itself; at most so many per question, least ids first."""
    first = alive_at(links.select("s", "c", "start_", "end_"), asked, "c").select("c", "when", "s").distinct()
    second = links.select(F.col("s").alias("s2"), F.col("c").alias("via"), "start_", "end_")
    # suppliers appear as customers of others in the same id space
    asked2 = first.select(F.col("s").alias("via"), "when").distinct()
    hop = alive_at(second, asked2, "via").select("via", "when", "s2").distinct()
    far = first.join(hop.withColumnRenamed("via", "s"), ["s", "when"]).select("c", "when", "s2").distinct().where("s2 <> c")
    near = first.select("c", "when", F.col("s").alias("s2"))
    w = Window.partitionBy("c", "when").orderBy("s2")
    return far.join(near, ["c", "when", "s2"], "left_anti").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def pair_masks(sources: dict[int, DataFrame]) -> DataFrame:
    """(a, b, mask, n_sources): which sources hold each undirected pair; sources: bit -> (src, dst)."""
    parts = [df.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(1 << bit).alias("m")) for bit, df in sources.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where("a <> b").groupBy("a", "b").agg(F.bit_or("m").alias("mask")).withColumn("n_sources", F.bit_count("mask"))
