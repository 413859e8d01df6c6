"""Queries of the attention model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import attention, sampler
from chronoweave.plans.adapters import NATION_EVENTS, USER_EDGES, nation_events, user_edges
from chronoweave.plans.registry import REGISTRY
from chronoweave.session import cut

query = REGISTRY.query
DIM, HOUR = 8, 3_600_000_000.0
_OMEGA = attention.frequencies(DIM)


def _enc(x: str) -> str:
    return ", ".join([f"cos({x} * {w!r}::double) * 0.5" for w in _OMEGA] + [f"sin({x} * {w!r}::double) * 0.5" for w in _OMEGA])


@query("time_encode", f"with {USER_EDGES}, x as (select seq, (ts - (select min(ts) from user_edges)) / {HOUR} as h from user_edges) select seq, " + ", ".join(f"round({e}, 6) as e{i}" for i, e in enumerate(_enc("h").split(", "))) + " from x")
def time_encode(spark: SparkSession, d: str) -> DataFrame:
    e = user_edges(spark, d)
    first = e.select(F.min("ts")).scalar()
    x = e.select("seq", attention.time_encode((F.col("ts") - first) / HOUR, DIM).alias("v"))
    return x.select("seq", *[(F.round(F.col("v")[i], 6) + 0.0).alias(f"e{i}") for i in range(DIM)])


@query(
    "attention_pool",
    f"""
with {USER_EDGES}, s as (
  select q.seq as qid, (q.ts - e.ts) / {HOUR} as h, e.weight as v, row_number() over (partition by q.seq order by e.ts desc, e.seq desc) as back from user_edges q join user_edges e on e.src = q.src and e.ts < q.ts),
l as (select qid, v, ({' + '.join(f'cos(h * {w!r}::double) * 0.25' for w in _OMEGA)}) * sqrt({DIM}.0::double) as l from s where back <= 5),
w as (select *, exp(l - max(l) over (partition by qid)) as w from l)
select qid, round(sum(w * v) / sum(w), 6) as pooled from w group by 1""",
)
def attention_pool(spark: SparkSession, d: str) -> DataFrame:
    e = user_edges(spark, d)
    asked = e.select(F.col("seq").alias("qid"), F.col("src").alias("node"), F.col("ts").alias("t"))
    s = sampler.sample_recent(e, asked, 5).withColumn("delta", F.col("t") - F.col("neighbour_ts"))
    return attention.pooled(s, ["qid"], "delta", "weight", DIM, HOUR).withColumn("pooled", F.round("pooled", 6))


@query(
    "pairwise_pressure",
    f"""
with {NATION_EVENTS}, p as (select date, src, dst, (sum(goldstein) / 10.0::double) as logit from nation_events group by all), o as (select * from p where src <> dst),
n as (select date, count(distinct src) as n from o group by 1)
select date, dst as country, round(sum(1 / (1 + exp(-logit))) / greatest(any_value(n) - 1, 1), 6) as signal from o join n using (date) group by 1, 2""",
)
def pairwise_pressure(spark: SparkSession, d: str) -> DataFrame:
    p = nation_events(spark, d).groupBy("date", "src", "dst").agg((F.sum("goldstein") / 10.0).alias("logit"))
    return attention.pairwise_pressure(p).withColumn("signal", F.round("signal", 6))


@query("link_scores")
def link_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every interaction scored from two layers of attention strictly before it, by a predictor fitted on the first 70 % of time; features are hashed from the ids."""
    e = user_edges(spark, d).withColumn("dst", F.col("dst") + 1_000_000)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ts", "relation", "weight", "seq"))
    nodes = both.select(F.col("src").alias("node")).distinct()
    x = F.array(*[(F.pmod(F.xxhash64("node", F.lit(i)), F.lit(2001)) / 1000.0 - 1.0) for i in range(DIM)])
    model = attention.Tgat.create(node_dim=DIM, time_dim=DIM)
    pairs = e.select("src", "dst", F.col("ts").alias("t"), "seq")
    asked = pairs.select(F.col("src").alias("node"), "t").unionByName(pairs.select(F.col("dst").alias("node"), "t"))
    emb = cut(attention.embed(both, asked, nodes.select("node", x.alias("x")), model, 5, HOUR, layers=2))
    until = pairs.select(F.percentile_approx("t", 0.7)).first()[0]
    model = attention.fit_links(pairs.where(F.col("t") <= (until or 0)), emb, model)
    return attention.score(pairs, emb, model).select("seq", F.round("logit", 6).alias("logit"))
