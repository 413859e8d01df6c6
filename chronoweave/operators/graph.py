"""A temporal multigraph as a table of edges (src, dst, ts, relation, weight, seq).

Adjacency is never materialised as pointers: a vertex's run is its rows in order of
(ts, seq), addressed by the rank within the run. Parallel edges and self-loops are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import prefix
from chronoweave.schema import EDGE_SCHEMA
from chronoweave.session import cut

MAX_RELATION = 65_535


def create_graph(spark: SparkSession, max_vertices: int) -> DataFrame:
    """An empty graph; at least one vertex is required."""
    if max_vertices <= 0:
        raise ValueError("a graph needs at least one vertex")
    return spark.createDataFrame([], EDGE_SCHEMA)


def checked(edges: DataFrame, max_vertices: int, weights: bool = True) -> DataFrame:
    """The edges, failing on ids outside the graph, relations that don't fit, or weights where there are none."""
    ids = F.col("src").between(0, max_vertices - 1) & F.col("dst").between(0, max_vertices - 1)
    fits = F.col("relation").between(0, MAX_RELATION)
    light = F.lit(weights) | (F.coalesce("weight", F.lit(0.0)) == 0)
    ok = F.coalesce(ids & fits & light, F.lit(False))
    return edges.withColumn("src", F.when(ok, F.col("src")).otherwise(F.raise_error("an edge doesn't fit the graph").cast("bigint")))


def append_edges(edges: DataFrame, path: str, max_vertices: int, weights: bool = True, files: int | None = None) -> None:
    """Append checked edges, clustered by src and sorted by time within files; all or none of them are written."""
    good = checked(edges, max_vertices, weights)
    spread = good.repartitionByRange(files, "src", "ts") if files else good.repartitionByRange("src", "ts")
    spread.sortWithinPartitions("src", "ts", "seq").write.mode("append").parquet(path)


def runs(edges: DataFrame) -> DataFrame:
    """Edges with idx, the 1-based place in their source's run."""
    return prefix.ranks(edges, ["src"], ["ts", "seq"], "idx")


def neighbours(edges: DataFrame, vertex: int) -> DataFrame:
    """The live run of one vertex in order, with relation and weight."""
    return edges.where(F.col("src") == vertex).select("dst", "ts", "relation", "weight", "seq").orderBy("ts", "seq")


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, degree): live out-degree, 0 for idle vertices."""
    counts = edges.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("d"))
    return vertices.join(counts, "vertex", "left").select("vertex", F.coalesce("d", F.lit(0)).alias("degree"))


def offsets(degree: DataFrame) -> DataFrame:
    """(vertex, degree, start): the exclusive running sum of degrees in order of the vertices."""
    summed = prefix.running(degree, [], ["vertex"], {"upto": F.col("degree")})
    return summed.select("vertex", "degree", (F.col("upto") - F.col("degree")).alias("start"))


def alive(edges: DataFrame, cutoff: int) -> DataFrame:
    """Edges left after dropping, of each run in order of arrival, the longest prefix older than the cutoff.

    With runs in time order this is the filter ts >= cutoff; an out-of-order run stops at its first survivor.
    """
    first = edges.where(F.col("ts") >= cutoff).groupBy("src").agg(F.min("seq").alias("first_live"))
    return edges.join(first, "src").where(F.col("seq") >= F.col("first_live")).drop("first_live")


def expired_counts(edges: DataFrame, cutoff: int) -> DataFrame:
    """(src, expired): the length of each run's expired prefix."""
    first = edges.where(F.col("ts") >= cutoff).groupBy("src").agg(F.min("seq").alias("first_live"))
    gone = edges.join(first, "src", "left").where(F.col("first_live").isNull() | (F.col("seq") < F.col("first_live")))
    return gone.groupBy("src").agg(F.count(F.lit(1)).alias("expired"))


def coo(edges: DataFrame) -> DataFrame:
    """(src, dst, ts, relation, weight) in order of vertex and arrival."""
    return edges.orderBy("src", "ts", "seq").select("src", "dst", "ts", "relation", "weight")


def disordered(edges: DataFrame, arrival: str = "seq") -> DataFrame:
    """(src, n_breaks): the runs in which an edge is older than one that arrived before it."""
    # places by arrival, then each edge meets the one before by its place: no task holds a whole hub
    placed = cut(prefix.ranks(edges.select("src", "ts", arrival), ["src"], [arrival], "place").select("src", "place", "ts"))
    before = placed.select("src", (F.col("place") + 1).alias("place"), F.col("ts").alias("ts_before"))
    return placed.join(before, ["src", "place"]).where("ts_before > ts").groupBy("src").agg(F.count(F.lit(1)).alias("n_breaks"))


def counters(edges: DataFrame, cutoff: int) -> DataFrame:
    """One row: edges, vertices with edges, expired and live edges, and the sum of targets."""
    live = F.col("ts") >= cutoff
    return edges.agg(
        F.count(F.lit(1)).alias("num_edges"), F.countDistinct("src").alias("num_sources"),
        F.sum(F.when(~live, 1).otherwise(0)).alias("expired_edges"), F.sum(F.when(live, 1).otherwise(0)).alias("live_edges"),
        F.sum("dst").alias("checksum"),
    )


def degree_skew(degree: DataFrame, share: float = 0.01) -> DataFrame:
    """One row: greatest and median degree, and the share of edges of the top vertices (degree, then id)."""
    # degrees are grouped first, so that the order is over distinct degrees only
    hist = degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    total = degree.agg(F.count(F.lit(1)).alias("v"), F.sum("degree").alias("e"), F.max("degree").alias("max_degree"), F.expr("median(degree)").alias("median_degree"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = hist.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).join(F.broadcast(total))
    top = F.greatest(F.floor(F.col("v") * share), F.lit(1))
    taken = F.least(F.greatest(top - F.col("before"), F.lit(0)), F.col("n"))
    return ranked.groupBy("max_degree", "median_degree", "e").agg(F.sum(taken * F.col("degree")).alias("t")).select(
        "max_degree", "median_degree", F.try_divide(F.col("t"), F.col("e")).alias("top_share")
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) in both directions, without self-loops."""
    e = edges.where(F.col("src") != F.col("dst"))
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select(F.col("dst"), F.col("src"))).distinct()


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(vertex, component): the least vertex of each connected component of undirected pairs (a, b).

    Each round takes the least label of the neighbours and then of the label itself, so
    that paths shorten by doubling; each round's labels go to the shared checkpoint folder.
    """
    both = cut(pairs.union(pairs.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("b"), F.col("vertex")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["vertex"]).groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(near, labels["vertex"] == near["a"]).select("vertex", F.least("component", "least").alias("c"), F.col("component").alias("old"))
        up = step.select(F.col("vertex").alias("c"), F.col("c").alias("cc"))
        jumped = step.join(up, "c").select("vertex", F.least("c", "cc").alias("component"), "old")
        jumped = cut(jumped)
        changed = jumped.where("component <> old").limit(1).count()
        labels = jumped.select("vertex", "component")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


