"""Temporal attention over causal samples: time encoding, masked attention and link scores by a fitted predictor.

The encoding and the fixed-weight pooling are column expressions; learned layers run as
NumPy over Arrow batches, on distinct (node, time) questions, so that shared ones are
computed once. Their weights are random and not trained: only the link predictor on top
is fitted, by Adam on a bounded sample of links; weights go to the tasks with the function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.sampler import sample_recent

#: Links on which a model is trained at most.
TRAINING_LINKS = 20_000


def frequencies(dim: int, decades: float = 9.0) -> list[float]:
    if dim % 2:
        raise ValueError("the dimension must be even")
    half = dim // 2
    return [1.0] if half == 1 else [10.0 ** (-decades * i / (half - 1)) for i in range(half)]


def time_encode(delta: Column, dim: int, decades: float = 9.0) -> Column:
    """sqrt(1/d) [cos(w t), sin(w t)] with frequencies from 1 down to 10^-decades."""
    omega = frequencies(dim, decades)
    scale = math.sqrt(2.0 / dim)
    return F.array(*[F.cos(delta * w) * scale for w in omega], *[F.sin(delta * w) * scale for w in omega])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def pooled(samples: DataFrame, keys: Sequence[str], delta: str, value: str, dim: int, unit: float) -> DataFrame:
    """(keys, pooled): softmax attention of one head with fixed weights: the query is the encoding of no time, the keys those of the time passed."""
    logit = dot(time_encode(F.col(delta) / unit, dim), time_encode(F.lit(0.0), dim)) * math.sqrt(dim)
    e = samples.withColumn("_l", logit).withColumn("_m", F.max("_l").over(Window.partitionBy(*keys))).withColumn("_w", F.exp(F.col("_l") - F.col("_m")))
    return e.groupBy(*keys).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("pooled"))


@dataclass
class Tgat:
    """Weights of one attention layer with heads, a merge layer, and a link predictor; node_dim numbers per node."""

    node_dim: int
    time_dim: int
    relations: int
    heads: int
    params: dict[str, np.ndarray]

    @staticmethod
    def create(node_dim: int = 8, time_dim: int = 8, relations: int = 32, heads: int = 2, seed: int = 0) -> Tgat:
        rng = np.random.default_rng(seed)
        width, relation_dim = node_dim + time_dim, 4
        init = lambda *s: rng.normal(0, 1 / math.sqrt(s[0]), s)
        p = {
            "rel": init(relations, relation_dim) * 0.1, "q": init(width, node_dim), "k": init(width + relation_dim, node_dim), "v": init(width + relation_dim, node_dim),
            "m1": init(2 * node_dim, node_dim), "m2": init(node_dim, node_dim), "s1": init(2 * node_dim, node_dim), "s2": init(node_dim, 1),
        }
        return Tgat(node_dim, time_dim, relations, heads, p)

    def encode(self, t: np.ndarray) -> np.ndarray:
        w = np.array(frequencies(self.time_dim))
        x = t[..., None] * w
        return math.sqrt(2.0 / self.time_dim) * np.concatenate([np.cos(x), np.sin(x)], -1)

    def attend(self, own: np.ndarray, others: np.ndarray, delta: np.ndarray, relation: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(B, D) from own (B, D), others (B, K, D), delta and relation (B, K) and mask (B, K); an empty history gives no context."""
        p, h = self.params, self.heads
        b, k, d = others.shape
        rel = p["rel"][np.clip(relation, 0, self.relations - 1)]
        q = np.concatenate([own, self.encode(np.zeros(b))], -1) @ p["q"]
        kv = np.concatenate([others, self.encode(delta), rel], -1)
        keys, values = kv @ p["k"], kv @ p["v"]
        qh, kh, vh = q.reshape(b, h, d // h), keys.reshape(b, k, h, d // h), values.reshape(b, k, h, d // h)
        logits = np.einsum("bhd,bkhd->bhk", qh, kh) / math.sqrt(d // h)
        logits = np.where(mask[:, None, :], logits, -1e30)
        w = np.exp(logits - logits.max(-1, keepdims=True)) * mask[:, None, :]
        w = w / np.maximum(w.sum(-1, keepdims=True), 1e-12)
        context = np.einsum("bhk,bkhd->bhd", w, vh).reshape(b, d)
        x = np.maximum(np.concatenate([context, own], -1) @ p["m1"], 0) @ p["m2"] + own
        return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)

    def link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = np.concatenate([a, b], -1)
        if "w1" in self.params:  # a fitted predictor; it also sees where the two sides agree
            return predict(self.params, np.concatenate([x, a * b], -1))
        return (np.maximum(x @ self.params["s1"], 0) @ self.params["s2"])[:, 0]


def embed(edges: DataFrame, queries: DataFrame, features: DataFrame, model: Tgat, k: int, unit: float = 1.0, layers: int = 1) -> DataFrame:
    """(node, t, embedding) of distinct (node, t) in queries; neighbours are embedded at their own time of interaction; features: (node, x).

    Each layer is one causal sample of the distinct questions of the layer above, so that the
    number of questions is bounded by the distinct pairs, not by k to the power of the layers.
    """
    asked = queries.select("node", "t").distinct().withColumn("qid", F.xxhash64("node", "t"))
    sample = sample_recent(edges, asked, k)
    if layers == 1:
        below = sample.join(features.withColumnsRenamed({"node": "neighbour", "x": "nx"}), "neighbour", "left")
    else:
        deeper = embed(edges, sample.select(F.col("neighbour").alias("node"), F.col("neighbour_ts").alias("t")), features, model, k, unit, layers - 1)
        below = sample.join(deeper.withColumnsRenamed({"node": "neighbour", "t": "neighbour_ts", "embedding": "nx"}), ["neighbour", "neighbour_ts"], "left")
    rows = below.groupBy("node", "t").agg(F.sort_array(F.collect_list(F.struct("slot", ((F.col("t") - F.col("neighbour_ts")) / unit).alias("delta"), F.col("relation").cast("int").alias("relation"), "nx"))).alias("past"))
    full = asked.select("node", "t").join(rows, ["node", "t"], "left").join(features, "node", "left")
    d = model.node_dim

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = len(b)
            own, others = np.zeros((n, d)), np.zeros((n, k, d))
            delta, relation, mask = np.zeros((n, k)), np.zeros((n, k), int), np.zeros((n, k), bool)
            for i, (x, past) in enumerate(zip(b["x"], b["past"])):
                if x is not None:
                    own[i] = x
                for p in past if past is not None else ():
                    j = p["slot"]
                    delta[i, j], relation[i, j], mask[i, j] = p["delta"], p["relation"] or 0, True
                    if p["nx"] is not None:
                        others[i, j] = p["nx"]
            out = model.attend(own, others, delta, relation, mask) if n else own
            yield pd.DataFrame({"node": b["node"], "t": b["t"], "embedding": list(out)})

    return full.select("node", "t", "x", "past").mapInPandas(run, "node bigint, t bigint, embedding array<double>")


def score(pairs: DataFrame, embedded: DataFrame, model: Tgat) -> DataFrame:
    """pairs (src, dst, t, ...) with logit; each side is encoded once and joined back."""
    a = embedded.withColumnsRenamed({"node": "src", "embedding": "_a"})
    b = embedded.withColumnsRenamed({"node": "dst", "embedding": "_b"})
    j = pairs.join(a, ["src", "t"]).join(b, ["dst", "t"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            logit = model.link(np.stack(x["_a"].to_list()), np.stack(x["_b"].to_list())) if len(x) else []
            yield x.drop(columns=["_a", "_b"]).assign(logit=logit)

    from pyspark.sql.types import DoubleType, StructType

    keep = [f for f in j.schema.fields if f.name not in ("_a", "_b")]
    return j.mapInPandas(run, StructType(keep).add("logit", DoubleType()))


def fit_links(pairs: DataFrame, embedded: DataFrame, model: Tgat, most: int = TRAINING_LINKS, seed: int = 0) -> Tgat:
    """The model with its link predictor fitted on about `most` of the pairs (src, dst, t), chosen by hash.

    The layers below stay as they are; each chosen pair has one negative, its src with the dst of another chosen pair.
    """
    share = min(1.0, most / max(1, pairs.count()))
    chosen = pairs.where(F.pmod(F.xxhash64("src", "dst", "t", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).select("src", "dst", "t").limit(2 * most)
    a = embedded.withColumnsRenamed({"node": "src", "embedding": "_a"})
    b = embedded.withColumnsRenamed({"node": "dst", "embedding": "_b"})
    rows = chosen.join(a, ["src", "t"]).join(b, ["dst", "t"]).toPandas().sort_values(["src", "dst", "t"])
    if len(rows) < 2:
        return model
    left, right = np.stack(rows["_a"].to_list()), np.stack(rows["_b"].to_list())
    other = right[np.random.default_rng(seed).permutation(len(rows))]
    x = np.concatenate([np.concatenate([left, y, left * y], 1) for y in (right, other)])
    fitted = fit_predictor(x, np.repeat([1.0, 0.0], len(rows)), seed=seed)
    return Tgat(model.node_dim, model.time_dim, model.relations, model.heads, model.params | fitted)


def fit_predictor(x: np.ndarray, y: np.ndarray, hidden: int = 16, steps: int = 300, rate: float = 0.02, seed: int = 0) -> dict[str, np.ndarray]:
    """A two-layer link predictor on concatenated features by Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    p = {"w1": rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / math.sqrt(hidden), hidden), "b2": np.zeros(1)}
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for i in range(1, steps + 1):
        z = x @ p["w1"] + p["b1"]
        h = np.maximum(z, 0)
        e = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - y) / len(y)
        gh = np.outer(e, p["w2"]) * (z > 0)
        g = {"w1": x.T @ gh, "b1": gh.sum(0), "w2": h.T @ e, "b2": np.array([e.sum()])}
        for key in p:
            m[key] = 0.9 * m[key] + 0.1 * g[key]
            v[key] = 0.999 * v[key] + 0.001 * g[key] ** 2
            p[key] = p[key] - rate * (m[key] / (1 - 0.9**i)) / (np.sqrt(v[key] / (1 - 0.999**i)) + 1e-8)
    return p


def predict(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.maximum(x @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"]


def pairwise_pressure(predictions: DataFrame) -> DataFrame:
    """(date, country, signal): the mean of the sigmoid of the predictions towards each country by the others; predictions: (date, src, dst, logit)."""
    others = predictions.where("src <> dst")
    n = others.groupBy("date").agg((F.countDistinct("src")).alias("n"))
    total = others.groupBy("date", "dst").agg(F.sum(1 / (1 + F.exp(-F.col("logit")))).alias("s"))
    return total.join(F.broadcast(n), "date").select("date", F.col("dst").alias("country"), (F.col("s") / F.greatest(F.col("n") - 1, F.lit(1))).alias("signal"))
