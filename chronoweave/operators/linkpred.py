"""Structural baselines for new links: splits, negatives, neighbourhood scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import prefix
from chronoweave.functions.portable import hash_int
from chronoweave.operators import pair_cells
from chronoweave.session import discard, stored


#: Tasks over which the neighbours of one vertex are spread.
SALTS = 8


def placed(edges: DataFrame) -> DataFrame:
    """Edges with pos, their 0-based place in time (then seq); they are written once, so that counts and splits read places."""
    return prefix.ranks(edges, [], ["ts", "seq"], "pos").withColumn("pos", F.col("pos") - 1)


def chronological_split(edges: DataFrame, train: float = 0.70, valid: float = 0.85) -> DataFrame:
    """Edges with pos and part: train, valid or test by place in time."""
    at = placed(edges)
    n = at.count()
    a, b = int(n * train), int(n * valid)
    return at.withColumn("part", F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "valid").otherwise("test"))


def evenly(rows: DataFrame, n: int, take: int, pos: str = "pos") -> DataFrame:
    """take rows at even distances of n placed rows: places floor(i * (n - 1) / (take - 1))."""
    if take >= n:
        return rows
    i = F.round(F.col(pos) * (take - 1) / (n - 1))
    hit = lambda k: F.floor(k * (n - 1) / (take - 1)) == F.col(pos)
    return rows.where(hit(i) | hit(i + 1) | hit(i - 1))


def is_repeat(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """edges with repeated: whether their (src, dst) is among the seen edges."""
    known = seen.select("src", "dst").distinct().withColumn("_k", F.lit(True))
    return edges.join(known, ["src", "dst"], "left").withColumn("repeated", F.coalesce("_k", F.lit(False))).drop("_k")


def is_inductive(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """edges with inductive: whether an end isn't an end of any seen edge."""
    known = seen.select(F.col("src").alias("v")).union(seen.select("dst")).distinct()
    a, b = known.select(F.col("v").alias("src"), F.lit(True).alias("_a")), known.select(F.col("v").alias("dst"), F.lit(True).alias("_b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").withColumn("inductive", F.col("_a").isNull() | F.col("_b").isNull()).drop("_a", "_b")


def negatives(queries: DataFrame, train: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """(qid, slot, src, dst): `count` targets per query in proportion to their training degree.

    The end of a random training edge has just that distribution, so a draw is an
    equi-join on the edge's place; train has pos from 0 without gaps.
    """
    n = train.count()
    slots = queries.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    draw = F.pmod(hash_int(F.lit(seed), F.col("qid"), F.col("slot")), F.lit(max(n, 1)))
    ends = train.select(F.col("pos").alias("_at"), F.col("dst").alias("_dst"))
    return slots.withColumn("_at", draw).join(ends, "_at").select("qid", "slot", "src", F.col("_dst").alias("dst"))


def uniform_negatives(queries: DataFrame, vertices: int, count: int, seed: int = 0) -> DataFrame:
    """(qid, slot, src, dst): `count` targets per query, uniform over ids below `vertices`."""
    slots = queries.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return slots.select("qid", "slot", "src", F.pmod(hash_int(F.lit(seed), F.col("qid"), F.col("slot")), F.lit(vertices)).alias("dst"))


def in_degree(train: DataFrame) -> DataFrame:
    return train.groupBy("dst").agg(F.count(F.lit(1)).alias("degree"))


def popularity(pairs: DataFrame, train: DataFrame) -> DataFrame:
    """pairs with popularity, the training in-degree of dst."""
    return pairs.join(in_degree(train), "dst", "left").withColumn("popularity", F.coalesce("degree", F.lit(0))).drop("degree")


def common_neighbours(asked: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(src, dst, common): the vertices that share a neighbour with each asked vertex (src); adjacency: distinct (a, b) in both directions.

    The walk begins at those that ask, so that a hub is expanded for its asking neighbours only, and its
    neighbours are spread over SALTS tasks.
    """
    left = asked.join(adjacency.select(F.col("a").alias("src"), F.col("b").alias("via")), "src").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = adjacency.select(F.col("a").alias("dst"), F.col("b").alias("via"), F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt"))
    return left.join(right, ["via", "salt"]).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("common"))


def neighbourhood_shares(groups: Sequence[DataFrame], order: list[str], edges: str, count: int, most: int, train: float = 0.70, valid: float = 0.85, seed: int = 0) -> list[DataFrame]:
    """(qid, slot, label, common, adamic_adar, popularity) of every test link of the chronological split (slot -1) and `count` negatives of each, in at most `most` shares by source.

    groups: rows whose edges, a list of (src, dst), are the links in order, in shares that are made one after
    another; only places and ends are kept.
    """
    made = [stored(g) for g in groups]
    at = prefix.running(reduce(DataFrame.union, made), [], order, {"_upto": F.size(edges)}, kept=[edges])
    for m in made:
        discard(m)
    n = at.select(F.max("_upto")).first()[0] or 0
    links = at.select((F.col("_upto") - F.size(edges)).alias("_first"), F.posexplode(edges).alias("_i", "_e")).select((F.col("_first") + F.col("_i")).alias("pos"), "_e.src", "_e.dst")
    return pair_cells.shares(links, int(n * train), int(n * valid), count, seed, most)


def directed_adamic_adar(pairs: DataFrame, train: DataFrame) -> DataFrame:
    """(src, dst, score): sum of 1 / ln(2 + in-degree with multiplicity) over out(src) and in(dst)."""
    step = train.select("src", "dst").distinct()
    deg = in_degree(train).withColumnRenamed("dst", "via")
    asked = pairs.select("src", "dst").distinct()
    out = asked.join(step.select("src", F.col("dst").alias("via")), "src")
    both = out.join(step.select(F.col("src").alias("via"), "dst"), ["via", "dst"]).join(deg, "via")
    return both.groupBy("src", "dst").agg(F.sum(1 / F.log(F.col("degree") + 2)).alias("score"))


def bipartite_adamic_adar(pairs: DataFrame, train: DataFrame) -> DataFrame:
    """(src, dst, score, overlap): peers of src are the sources that share a target with it (src included); those that link to dst count 1 / ln(2 + their number of targets)."""
    step = train.select("src", "dst").distinct()
    size = step.groupBy(F.col("src").alias("peer")).agg(F.count(F.lit(1)).alias("k"))
    asked = pairs.select("src", "dst").distinct()
    # peers are sought only for the sources that ask
    asking = step.join(asked.select("src").distinct(), "src", "left_semi").select("src", F.col("dst").alias("via"))
    peers = asking.join(step.select(F.col("src").alias("peer"), F.col("dst").alias("via")), "via").select("src", "peer").distinct()
    linked = asked.join(step.select(F.col("src").alias("peer"), "dst"), "dst")
    met = linked.join(peers, ["src", "peer"]).join(size, "peer")
    return met.groupBy("src", "dst").agg(F.sum(1 / F.log(F.col("k") + 2)).alias("score"), F.count(F.lit(1)).alias("overlap"))


def pair_history(pairs: DataFrame, train: DataFrame, now: Column, unit: float = 86_400.0) -> DataFrame:
    """pairs with frequency ln(1 + count) and recency 1 / (1 + days since) of their own past links."""
    past = train.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last"))
    j = pairs.join(past, ["src", "dst"], "left")
    return j.withColumn("frequency", F.log1p(F.coalesce("_n", F.lit(0)))).withColumn("recency", F.coalesce(1 / (1 + (now - F.col("_last")) / unit), F.lit(0.0))).drop("_n", "_last")


def ensemble_sweep(scored: DataFrame, logit: str, extra: str, label: str, lambdas: list[float]) -> DataFrame:
    """(lam, auc): the auc of sigmoid(logit) + lam * extra for each lam; scored is read once."""
    from chronoweave.operators import metrics

    rows = stored(metrics.classes(scored, [logit, extra], label)).withColumn("lam", F.explode(F.array(*[F.lit(float(x)) for x in lambdas])))
    mixed = rows.withColumn("mixed", F.round(1 / (1 + F.exp(-F.col(logit))) + F.col("lam") * F.col(extra), 9))
    return metrics.area(mixed.groupBy("lam", "mixed").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "mixed", ["lam"])


def permuted_times(edges: DataFrame, seed: int = 0) -> DataFrame:
    """placed edges whose times are dealt anew: the row at place i gets the time at the place that hash order gives i."""
    dealt = edges.withColumn("_h", hash_int(F.lit(seed), F.col("pos")))
    order = prefix.ranks(dealt, [], ["_h", "pos"], "_r").select((F.col("_r") - 1).alias("pos"), F.col("ts").alias("new_ts"))
    return edges.join(order, "pos").withColumn("ts", F.col("new_ts")).drop("new_ts")


