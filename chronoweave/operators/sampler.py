"""Strictly causal neighbourhoods: the K interactions of a node before an instant.

Queries (qid, node, t) and edges go through one running count per node in order of time,
a query before edges of its own instant; the count is the query's cut, and the rows of a
sample are then an equi-join on (node, place in the run). No range join occurs, and runs
are counted in parts by range (functions/prefix.py), so that a hub isn't one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import prefix
from chronoweave.functions.portable import uniform

NEVER = 1e7


def cuts_and_runs(edges: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, node, t, cut), how many edges of the node are strictly before t, and (node, idx, edge), the place of each edge in its run: one pass for both, written once."""
    shown = ["dst", "ts", "relation", "weight"]
    stream = edges.select(
        F.col("src").alias("node"), F.col("ts").alias("at"), F.lit(1).alias("is_edge"), F.lit(None).cast("bigint").alias("qid"), "seq", F.struct(*shown).alias("edge")
    ).unionByName(queries.select("node", F.col("t").alias("at"), F.lit(0).alias("is_edge"), F.col("qid").cast("bigint").alias("qid")), allowMissingColumns=True)
    counted = prefix.running(stream, ["node"], ["at", "is_edge", "seq", "qid"], {"cut": F.col("is_edge")})
    return counted.where("is_edge = 0").select("qid", "node", F.col("at").alias("t"), "cut"), counted.where("is_edge = 1").select("node", F.col("cut").alias("idx"), "edge")


def cuts(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, node, t, cut): how many edges of the node are strictly before t."""
    stream = edges.select(F.col("src").alias("node"), F.col("ts").alias("at"), F.lit(1).alias("is_edge"), F.lit(None).cast("bigint").alias("qid"), "seq").unionByName(
        queries.select("node", F.col("t").alias("at"), F.lit(0).alias("is_edge"), F.col("qid").cast("bigint").alias("qid")), allowMissingColumns=True
    )
    counted = prefix.running(stream, ["node"], ["at", "is_edge", "seq", "qid"], {"cut": F.col("is_edge")})
    return counted.where("is_edge = 0").select("qid", "node", F.col("at").alias("t"), "cut")


def _rows(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (qid, node, t, slot, idx) joined with the runs."""
    r = runs.select("node", "idx", F.col("edge.dst").alias("neighbour"), F.col("edge.ts").alias("neighbour_ts"), "edge.relation", "edge.weight")
    return wanted.join(r, ["node", "idx"]).drop("idx")


def sample_recent(edges: DataFrame, queries: DataFrame, k: int, keep_empty: bool = False) -> DataFrame:
    """(qid, node, t, slot, neighbour, neighbour_ts, relation, weight): the k latest, slots ascending in time and filled from the right.

    keep_empty adds a row with a null slot for queries without history.
    """
    cut, runs = cuts_and_runs(edges, queries)
    some = cut.where("cut > 0").select("qid", "node", "t", "cut", F.explode(F.sequence(F.greatest(F.col("cut") - k + 1, F.lit(1)), F.col("cut"))).alias("idx"))
    out = _rows(runs, some.select("qid", "node", "t", "idx", (F.col("idx") - F.col("cut") + k - 1).cast("int").alias("slot")))
    if not keep_empty:
        return out
    return out.unionByName(cut.where("cut = 0").select("qid", "node", "t"), allowMissingColumns=True)


def sample_uniform(edges: DataFrame, queries: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k draws with replacement over the whole history before t."""
    cut, runs = cuts_and_runs(edges, queries)
    slots = cut.where("cut > 0").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    u = uniform(F.lit(seed), F.col("qid"), F.col("slot"))
    return _rows(runs, slots.select("qid", "node", "t", "slot", (F.lit(1) + F.floor(u * F.col("cut"))).alias("idx")))


def recency_features(edges: DataFrame, queries: DataFrame, k: int, second: float = 1.0) -> DataFrame:
    """(qid, node, t, f_count, f_since, f_span, f_rate): four numbers on how much and how lately a node was active; second: time units per second."""
    cut, runs = cuts_and_runs(edges, queries)
    r = runs.select("node", "idx", F.col("edge.ts").alias("ts"))
    last = r.select("node", F.col("idx").alias("cut"), F.col("ts").alias("last_ts"))
    kth = r.select("node", F.col("idx").alias("kth"), F.col("ts").alias("kth_ts"))
    at = cut.withColumn("kth", F.greatest(F.col("cut") - k + 1, F.lit(1)))
    seen = at.join(last, ["node", "cut"], "left").join(kth, ["node", "kth"], "left")
    days = 86_400.0 * second
    since = F.when(F.col("cut") > 0, F.col("t") - F.col("last_ts")).otherwise(F.lit(NEVER * second)) / days
    span = F.greatest(F.when(F.col("cut") > 0, F.col("t") - F.col("kth_ts")).otherwise(F.lit(NEVER * second)) / days, F.lit(1 / 24))
    return seen.select(
        "qid", "node", "t", (F.log1p("cut") / 5).alias("f_count"), F.log1p(since).alias("f_since"), F.log1p(span).alias("f_span"),
        F.log((F.least(F.col("cut"), F.lit(k)) + 1) / span).alias("f_rate"),
    )


def two_hop_peers(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, node, t, peer): entities met through the k latest bridges at t, each bridge's k latest entities at the same t, without the node.

    edges go from entity to bridge; both directions are walked.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ts", "relation", "weight", "seq")
    hop = sample_recent(edges, queries, k).select("qid", "node", "t", F.col("neighbour").alias("bridge")).distinct()
    # a bridge at an instant is asked once, whoever asks
    asked = hop.select(F.col("bridge").alias("node"), "t").distinct().withColumn("qid", F.xxhash64("node", "t"))
    peers = sample_recent(back, asked, k).select(F.col("node").alias("bridge"), "t", F.col("neighbour").alias("peer")).distinct()
    return hop.join(peers, ["bridge", "t"]).where("peer <> node").select("qid", "node", "t", "peer").distinct()
