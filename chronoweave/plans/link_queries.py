"""Queries of link prediction: splits, negatives, scores and metrics, over the trade graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import linkpred, metrics
from chronoweave.operators.graph import undirected
from chronoweave.plans.adapters import TRADE_EDGES, trade_edges, trade_orders
from chronoweave.plans.registry import REGISTRY
from chronoweave.session import cut, stored

query = REGISTRY.query
NEGATIVES = 10
#: Most shares of pairs that are counted one after another.
COUNT_SHARES = 3

_SPLIT = f"""
with {TRADE_EDGES}, p as (select *, row_number() over (order by ts, seq) - 1 as pos, count(*) over () as n from trade_edges),
sp as (select *, case when pos < floor(n * 0.70) then 'train' when pos < floor(n * 0.85) then 'valid' else 'test' end as part from p),
tr as (select * from sp where part = 'train'), te as (select * from sp where part = 'test')
"""
#: Every test link asks.
_ASK = _SPLIT + f""", ask as (select pos as qid, src, dst, ts from te),
draw as (
  select a.qid, s.slot, a.src, ('0x' || substr(md5('0:' || a.qid || ':' || s.slot), 1, 8))::bigint % t.n as at
  from ask a, (select unnest(range({NEGATIVES})) as slot) s, (select count(*) as n from tr) t),
neg as (select qid, slot, draw.src, tr.dst from draw join tr on tr.pos = draw.at),
deg as (select dst, count(*) as degree from tr group by 1),
pairs as (select qid, -1 as slot, src, dst, 1 as label from ask union all select qid, slot, src, dst, 0 from neg)
"""
_ADJ = """, adj as (select distinct src as a, dst as b from tr where src <> dst union select distinct dst, src from tr where src <> dst),
k as (select a, count(*) as k from adj group by 1)"""


def _split(spark: SparkSession, d: str) -> DataFrame:
    return linkpred.chronological_split(trade_edges(spark, d))


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training edges, pairs with qid, slot and label, the asking links): every test link asks."""
    s = _split(spark, d)
    train = s.where("part = 'train'")
    ask = s.where("part = 'test'").select(F.col("pos").alias("qid"), "src", "dst", "ts")
    neg = linkpred.negatives(ask.select("qid", "src"), train, NEGATIVES)
    pairs = ask.select("qid", F.lit(-1).alias("slot"), "src", "dst", F.lit(1).alias("label")).unionByName(neg.withColumn("label", F.lit(0)))
    return train, pairs, ask


@query("chronological_split", _SPLIT + "select part, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from sp group by 1")
def chronological_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("evenly_spaced", _SPLIT + "select pos from p join (select distinct floor(i * (n - 1) / 999)::bigint as x from (select unnest(range(1000)) as i), (select max(n) as n from p)) on pos = x")
def evenly_spaced(spark: SparkSession, d: str) -> DataFrame:
    e = linkpred.placed(trade_edges(spark, d))
    return linkpred.evenly(e, e.count(), 1000).select("pos")


@query("stride_sample", _SPLIT + "select pos, src, dst from p where pos % 7 = 0")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return linkpred.placed(trade_edges(spark, d)).where("pos % 7 = 0").select("pos", "src", "dst")


@query("new_vs_repeat", _SPLIT + "select exists (select 1 from tr where tr.src = te.src and tr.dst = te.dst) as repeated, count(*) as n from te group by 1")
def new_vs_repeat(spark: SparkSession, d: str) -> DataFrame:
    s = _split(spark, d)
    return linkpred.is_repeat(s.where("part = 'test'"), s.where("part = 'train'")).groupBy("repeated").agg(F.count(F.lit(1)).alias("n"))


@query("inductive_split", _SPLIT + ", v as (select src as v from tr union select dst from tr) select src not in (select v from v) or dst not in (select v from v) as inductive, count(*) as n from te group by 1")
def inductive_split(spark: SparkSession, d: str) -> DataFrame:
    """Test links by whether an end isn't an end of any training edge."""
    s = _split(spark, d)
    return linkpred.is_inductive(s.where("part = 'test'"), s.where("part = 'train'")).groupBy("inductive").agg(F.count(F.lit(1)).alias("n"))


@query("neg_sample_degree", _ASK + "select qid, slot::int as slot, src, dst from neg")
def neg_sample_degree(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d)[1].where("label = 0").select("qid", "slot", "src", "dst")


@query("neg_sample_uniform", _SPLIT + f", v as (select max(greatest(src, dst)) + 1 as n from trade_edges) select pos as qid, slot::int as slot, src, ('0x' || substr(md5('5:' || pos || ':' || slot), 1, 8))::bigint % v.n as dst from te, v, (select unnest(range({NEGATIVES})) as slot)")
def neg_sample_uniform(spark: SparkSession, d: str) -> DataFrame:
    """Every test link asks; targets are uniform over all vertices, whose number the edges give."""
    s = _split(spark, d)
    vertices = s.select(F.max(F.greatest("src", "dst"))).first()[0]
    return linkpred.uniform_negatives(s.where("part = 'test'").select(F.col("pos").alias("qid"), "src"), (vertices or 0) + 1, NEGATIVES, 5)


@query("popularity_scores", _ASK + "select qid, slot::int as slot, coalesce(degree, 0) as popularity, round(ln(1 + coalesce(degree, 0)), 6) as log_popularity from pairs left join deg using (dst)")
def popularity_scores(spark: SparkSession, d: str) -> DataFrame:
    train, pairs, _ = _asked(spark, d)
    return linkpred.popularity(pairs, train).select("qid", "slot", "popularity", F.round(F.log1p("popularity"), 6).alias("log_popularity"))


_AA = _ASK + _ADJ + """, cn as (
  select x.src, x.dst, count(*) as common, sum(1 / ln(k.k + 2)) as aa from (select distinct src, dst from pairs) x join adj l on l.a = x.src join adj r on r.a = x.dst and r.b = l.b join k on k.a = l.b group by 1, 2)"""


def _near_shares(spark: SparkSession, d: str, most: int) -> list[DataFrame]:
    """Every test link and its negatives with common, adamic_adar and popularity, in at most so many shares."""
    return linkpred.neighbourhood_shares(trade_orders(spark, d), ["ts", "o"], "edges", NEGATIVES, most)


def _near(spark: SparkSession, d: str) -> DataFrame:
    return _near_shares(spark, d, 1)[0]


@query("adamic_adar", _AA + " select qid, slot::int as slot, coalesce(common, 0) as common, round(coalesce(aa, 0), 6) as adamic_adar from pairs left join cn using (src, dst)")
def adamic_adar(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select("qid", "slot", "common", F.round("adamic_adar", 6).alias("adamic_adar"))


#: Searches ask from the vertices whose id is divisible by this, against all.
SEARCH_STEP = 50


@query("common_neighbours", _SPLIT + _ADJ + f" select l.a as src, r.a as dst, count(*) as common from adj l join adj r on l.b = r.b and l.a <> r.a where l.a % {SEARCH_STEP} = 0 group by 1, 2")
def common_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """A search: the vertices whose id is divisible by 50, against all vertices that share a neighbour with them."""
    adj = cut(undirected(_split(spark, d).where("part = 'train'")))
    return linkpred.common_neighbours(adj.where(F.col("a") % SEARCH_STEP == 0).select(F.col("a").alias("src")).distinct(), adj)


@query(
    "adamic_adar_directed",
    _ASK + """, st as (select distinct src, dst from tr)
select x.src, x.dst, round(sum(1 / ln(2 + deg.degree)), 6) as score from (select distinct src, dst from pairs) x join st a on a.src = x.src join st b on b.src = a.dst and b.dst = x.dst join deg on deg.dst = a.dst group by 1, 2""",
)
def adamic_adar_directed(spark: SparkSession, d: str) -> DataFrame:
    train, pairs, _ = _asked(spark, d)
    return linkpred.directed_adamic_adar(pairs, train).withColumn("score", F.round("score", 6))


@query(
    "adamic_adar_bipartite",
    _ASK + """, st as (select distinct src, dst from tr), sz as (select src, count(*) as k from st group by 1),
peers as (select distinct a.src, b.src as peer from st a join st b using (dst) where a.src % 50 = 0)
select x.src, x.dst, round(sum(1 / ln(2 + sz.k)), 6) as score, count(*) as overlap
from (select distinct src, dst from pairs where src % 50 = 0) x join peers on peers.src = x.src join st on st.src = peers.peer and st.dst = x.dst join sz on sz.src = peers.peer group by 1, 2""",
)
def adamic_adar_bipartite(spark: SparkSession, d: str) -> DataFrame:
    """A search: the links and negatives of the sources whose id is divisible by 50, against all sources that share a target with them."""
    train, pairs, _ = _asked(spark, d)
    return linkpred.bipartite_adamic_adar(pairs.where(F.col("src") % SEARCH_STEP == 0), train).withColumn("score", F.round("score", 6))


@query(
    "pair_recency",
    _ASK + """, h as (select src, dst, count(*) as n, max(ts) as last from tr group by 1, 2), t as (select max(ts) as now from tr)
select qid, slot::int as slot, round(ln(1 + coalesce(n, 0)), 6) as frequency, round(coalesce(1 / (1 + (now - last) / 86400.0::double), 0), 6) as recency from pairs left join h using (src, dst), t""",
)
def pair_recency(spark: SparkSession, d: str) -> DataFrame:
    train, pairs, _ = _asked(spark, d)
    now = train.select(F.max("ts")).scalar()
    return linkpred.pair_history(pairs, train, now).select("qid", "slot", F.round("frequency", 6).alias("frequency"), F.round("recency", 6).alias("recency"))


_POP = _ASK + """, sc as (select qid, slot, label, coalesce(degree, 0) as score from pairs left join deg using (dst)),
c as (select n.qid, count(*) filter (where n.score > p.score) as above, count(*) filter (where n.score = p.score) as tied, count(*) as n
  from sc n join sc p on p.qid = n.qid and p.label = 1 where n.label = 0 group by 1)"""


def _popular(spark: SparkSession, d: str) -> DataFrame:
    train, pairs, _ = _asked(spark, d)
    return linkpred.popularity(pairs, train).withColumn("score", F.col("popularity"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    s = _popular(spark, d)
    return metrics.against_negatives(s.where("label = 1"), s.where("label = 0"), "qid", "score")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query("ranking_metrics_midrank", _POP + ", b as (select *, above + tied / 2.0::double as beaten from c) select round(avg(1 / (beaten + 1)), 6) as mrr, round(avg((beaten < 0.5)::int), 6) as r_at_1, round(avg((beaten < 10)::int), 6) as r_at_10, round(avg(1 - beaten / n), 6) as auc from b")
def ranking_metrics_midrank(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.ranking(_counts(spark, d)))


@query("ranking_metrics_rank", _POP + ", b as (select *, above + tied / 2.0::double + 1 as r from c) select round(avg(1 / r), 6) as mrr, round(avg((r <= 1.5)::int), 6) as r_at_1, round(avg((r <= 10)::int), 6) as r_at_10 from b")
def ranking_metrics_rank(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.ranking_by_rank(_counts(spark, d)))


@query("mrr_strict", _POP + " select round(avg(1 / (above + 1.0::double)), 6) as mrr from c")
def mrr_strict(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.strict_mrr(_counts(spark, d)))


_AUC = """, r as (select {keys} label, rank() over ({part} order by score) + (count(*) over (partition by {pk} score) - 1) / 2.0::double as rk from sc)"""


@query("roc_auc", _POP + _AUC.format(keys="", part="", pk="") + " select round((sum(rk) filter (where label = 1) - sum(label) * (sum(label) + 1) / 2.0::double) / (sum(label) * sum(1 - label)), 6) as auc from r")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_popular(spark, d), "score", "label"))


@query("average_precision", _POP + ", w as (select label, sum(label) over o as hits, count(*) over o as place from (select *, qid * 100 + slot as tie from sc) window o as (order by score desc, tie rows unbounded preceding)) select round(avg(hits / place) filter (where label = 1), 6) as ap from w")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.average_precision(_popular(spark, d).withColumn("tie", F.col("qid") * 100 + F.col("slot")), "score", "label", "tie"))


@query(
    "batch_auc",
    _POP + """, z as (select *, floor((qid - (select min(qid) from sc)) / 20)::bigint as batch from sc), g as (select batch from z group by 1 having count(*) >= 8),
r as (select batch, label, rank() over (partition by batch order by score) + (count(*) over (partition by batch, score) - 1) / 2.0::double as rk from z where batch in (select batch from g))
select batch, round((sum(rk) filter (where label = 1) - sum(label) * (sum(label) + 1) / 2.0::double) / (sum(label) * sum(1 - label)), 6) as auc from r group by 1""",
)
def batch_auc(spark: SparkSession, d: str) -> DataFrame:
    s = _popular(spark, d)
    first = s.select(F.min("qid")).scalar()
    cut = metrics.batched(s, F.col("qid") - first, 20)
    return metrics.roc_auc(cut, "score", "label", ["batch"]).withColumn("auc", F.round("auc", 6))


@query("cold_warm_split", _AA + " select coalesce(common, 0) > 0 as warm, label, count(*) as n from pairs left join cn using (src, dst) group by all")
def cold_warm_split(spark: SparkSession, d: str) -> DataFrame:
    """The shares are counted one after another, each without the shuffle files of the one before."""
    counts = [stored(s.groupBy((F.col("common") > 0).alias("warm"), "label").agg(F.count(F.lit(1)).alias("n"))) for s in _near_shares(spark, d, COUNT_SHARES)]
    return reduce(DataFrame.union, counts).groupBy("warm", "label").agg(F.sum("n").alias("n"))


@query(
    "ensemble_sweep",
    _AA + """, m as (
  select l.lam, label, round(1 / (1 + exp(-(coalesce(degree, 0) - 50) / 50.0::double)) + l.lam * coalesce(aa, 0), 9) as score from pairs left join cn using (src, dst) left join deg using (dst), (values (0.0::double), (0.1), (1.0)) l(lam)),
r as (select lam, label, rank() over (partition by lam order by score) + (count(*) over (partition by lam, score) - 1) / 2.0::double as rk from m)
select lam, round((sum(rk) filter (where label = 1) - sum(label) * (sum(label) + 1) / 2.0::double) / (sum(label) * sum(1 - label)), 4) as auc from r group by 1""",
)
def ensemble_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = _near(spark, d).withColumn("logit", (F.col("popularity") - 50) / 50.0)
    return linkpred.ensemble_sweep(s, "logit", "adamic_adar", "label", [0.0, 0.1, 1.0]).withColumn("auc", F.round("auc", 4))


@query(
    "permuted_times",
    _SPLIT + """, h as (select *, ('0x' || substr(md5('0:' || pos), 1, 8))::bigint as h from tr), o as (select row_number() over (order by h, pos) - 1 as pos, ts as new_ts from h)
select tr.pos, o.new_ts as ts from tr join o using (pos)""",
)
def permuted_times(spark: SparkSession, d: str) -> DataFrame:
    return linkpred.permuted_times(_split(spark, d).where("part = 'train'")).select("pos", "ts")
