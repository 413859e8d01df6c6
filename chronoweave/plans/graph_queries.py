"""Queries of the graph store and the causal sampler."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave import schema
from chronoweave.operators import graph, sampler
from chronoweave.plans.adapters import TRADE_EDGES, USER_EDGES, node_days, trade_edges, user_edges
from chronoweave.plans.registry import REGISTRY

query = REGISTRY.query
#: Instants of the expiry queries: micros of 2024-01-16, seconds of 1998-01-01.
USER_CUT, TRADE_CUT = 1_705_363_200_000_000, 883_612_800
K = 3

_U, _T = f"with {USER_EDGES}", f"with {TRADE_EDGES}"
_R6 = lambda c: F.round(c, 6)


@query("adjacency_runs", _T + " select src, row_number() over (partition by src order by ts, seq) as idx, dst, ts, relation, weight from trade_edges")
def adjacency_runs(spark: SparkSession, d: str) -> DataFrame:
    return graph.runs(trade_edges(spark, d)).select("src", "idx", "dst", "ts", "relation", "weight")


@query("neighbours_of_vertex", _U + " select dst, ts, relation, weight, seq from user_edges where src = 7")
def neighbours_of_vertex(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(user_edges(spark, d), 7)


_DEGREES = ", v as (select distinct c_custkey as vertex from customer), deg as (select v.vertex, count(e.src) as degree from v left join trade_edges e on e.src = v.vertex group by 1)"


def _degrees(spark: SparkSession, d: str) -> DataFrame:
    from chronoweave.session import read_table

    customers = read_table(spark, d, "customer").select(F.col("c_custkey").alias("vertex")).distinct()
    return graph.degrees(customers, trade_edges(spark, d))


@query("vertex_degrees", _T + _DEGREES + " select vertex, degree from deg")
def vertex_degrees(spark: SparkSession, d: str) -> DataFrame:
    return _degrees(spark, d)


@query("csr_offsets", _T + _DEGREES + " select vertex, degree, (sum(degree) over (order by vertex rows unbounded preceding) - degree)::bigint as start from deg")
def csr_offsets(spark: SparkSession, d: str) -> DataFrame:
    return graph.offsets(_degrees(spark, d))


@query(
    "degree_skew",
    _T + _DEGREES + """
select max(degree) as max_degree, median(degree) as median_degree,
       round(sum(degree) filter (where rn <= greatest(floor(n * 0.01), 1)) / sum(degree), 6) as top_share
from (select degree, row_number() over (order by degree desc, vertex) as rn, count(*) over () as n from deg)""",
)
def degree_skew(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_skew(_degrees(spark, d)).withColumn("top_share", _R6("top_share"))


@query("coo_export", _U + " select src, dst, ts, relation, weight from user_edges")
def coo_export(spark: SparkSession, d: str) -> DataFrame:
    return graph.coo(user_edges(spark, d))


@query("expire_before", _U + f" select src, dst, ts, seq from user_edges where ts >= {USER_CUT}")
def expire_before(spark: SparkSession, d: str) -> DataFrame:
    return graph.alive(user_edges(spark, d), USER_CUT).select("src", "dst", "ts", "seq")


_ALIVE = f", l as (select *, max(ts) over (partition by src order by seq rows unbounded preceding) as m from trade_edges)"


@query("expire_prefix_unordered", _T + _ALIVE + f" select src, dst, ts, weight from l where m >= {TRADE_CUT}")
def expire_prefix_unordered(spark: SparkSession, d: str) -> DataFrame:
    return graph.alive(trade_edges(spark, d), TRADE_CUT).select("src", "dst", "ts", "weight")


@query("expire_vertex_before", _T + _ALIVE + f" select src, dst, ts, weight from l where m >= {TRADE_CUT} and src = 11")
def expire_vertex_before(spark: SparkSession, d: str) -> DataFrame:
    return graph.alive(trade_edges(spark, d).where("src = 11"), TRADE_CUT).select("src", "dst", "ts", "weight")


@query("expired_counts", _T + _ALIVE + f" select src, count(*) as expired from l where m < {TRADE_CUT} group by 1")
def expired_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.expired_counts(trade_edges(spark, d), TRADE_CUT)


@query("run_validate", _T + " select src, count(*) as n_breaks from (select src, lag(ts) over (partition by src order by seq) > ts as falls from trade_edges) where falls group by 1")
def run_validate(spark: SparkSession, d: str) -> DataFrame:
    return graph.disordered(trade_edges(spark, d))


@query(
    "graph_counters",
    _T + f"""
select count(*) as num_edges, count(distinct src) as num_sources, count(*) filter (where ts < {TRADE_CUT}) as expired_edges,
       count(*) filter (where ts >= {TRADE_CUT}) as live_edges, sum(dst)::bigint as checksum from trade_edges""",
)
def graph_counters(spark: SparkSession, d: str) -> DataFrame:
    return graph.counters(trade_edges(spark, d), TRADE_CUT)


@query("scan_checksum", _T + " select sum(dst)::bigint as checksum, count(*) as n from trade_edges")
def scan_checksum(spark: SparkSession, d: str) -> DataFrame:
    return trade_edges(spark, d).agg(F.sum("dst").alias("checksum"), F.count(F.lit(1)).alias("n"))


@query(
    "relation_unpack",
    _U + """
, p as (select seq, (relation & 255) | ((seq % 3) << 8) | ((seq % 4) << 11) as code from user_edges)
select seq, code::bigint as code, (code & 255)::int as kind, ((code >> 8) & 3)::int as confidence, ((code >> 11) & 7)::int as source from p""",
)
def relation_unpack(spark: SparkSession, d: str) -> DataFrame:
    e = user_edges(spark, d)
    packed = e.select("seq", schema.pack_relation(F.col("relation").cast("bigint"), F.col("seq") % 3, F.col("seq") % 4).alias("code"))
    kind, confidence, source = schema.unpack_relation(F.col("code"))
    return packed.select("seq", "code", kind.cast("int").alias("kind"), confidence.cast("int").alias("confidence"), source.cast("int").alias("source"))


@query(
    "edge_weights",
    """
select m.name as magnitude, s.name as sign, round(m.v * s.v, 6) as weight
from (values ('NEGLIGIBLE', 0.1), ('SMALL', 0.3), ('MODERATE', 1.0), ('LARGE', 3.0), ('HUGE', 0.0)) m(name, v), (values ('NEGATIVE', -1), ('NEUTRAL', 0), ('POSITIVE', 1)) s(name, v)""",
)
def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    names = [(m, s) for m in (*schema.MAGNITUDES, "HUGE") for s in schema.SIGNS]
    return spark.createDataFrame(names, "magnitude string, sign string").withColumn("weight", _R6(schema.edge_weight(F.col("sign"), F.col("magnitude"))))


# --- sampler ----------------------------------------------------------------

_NODE_DAYS = ", q as (select distinct src as node, ts as t, src * 100000 + floor(ts / 86400)::bigint as qid from trade_edges)"
_BEFORE = f"""
, x as (
  select q.qid, q.node, q.t, e.dst as neighbour, e.ts as neighbour_ts, e.relation, e.weight,
         row_number() over (partition by q.qid order by e.ts desc, e.seq desc) as back, count(*) over (partition by q.qid) as cut
  from q join trade_edges e on e.src = q.node and e.ts < q.t)"""


@query("cut_counts", _T + _NODE_DAYS + " select q.qid, q.node, q.t, count(e.src) as cut from q left join trade_edges e on e.src = q.node and e.ts < q.t group by all")
def cut_counts(spark: SparkSession, d: str) -> DataFrame:
    e = trade_edges(spark, d)
    return sampler.cuts(e, node_days(e))


@query("sample_recent", _T + _NODE_DAYS + _BEFORE + f" select qid, node, t, ({K} - back)::int as slot, neighbour, neighbour_ts, relation, weight from x where back <= {K}")
def sample_recent(spark: SparkSession, d: str) -> DataFrame:
    e = trade_edges(spark, d)
    return sampler.sample_recent(e, node_days(e), K).select("qid", "node", "t", "slot", "neighbour", "neighbour_ts", "relation", "weight")


@query(
    "sample_recent_users",
    _U + f"""
, x as (
  select q.seq as qid, q.ts as t, e.dst as neighbour, e.ts as neighbour_ts, row_number() over (partition by q.seq order by e.ts desc, e.seq desc) as back
  from user_edges q join user_edges e on e.src = q.src and e.ts < q.ts)
select qid, t, (10 - back)::int as slot, neighbour, neighbour_ts from x where back <= 10""",
)
def sample_recent_users(spark: SparkSession, d: str) -> DataFrame:
    e = user_edges(spark, d)
    asked = e.select(F.col("seq").alias("qid"), F.col("src").alias("node"), F.col("ts").alias("t"))
    return sampler.sample_recent(e, asked, 10).select("qid", "t", "slot", "neighbour", "neighbour_ts")


@query("sample_recent_padded", _T + _NODE_DAYS + _BEFORE + f" select q.qid, ({K} - back)::int as slot, neighbour from q left join x on x.qid = q.qid and back <= {K}")
def sample_recent_padded(spark: SparkSession, d: str) -> DataFrame:
    e = trade_edges(spark, d)
    return sampler.sample_recent(e, node_days(e), K, keep_empty=True).select("qid", "slot", "neighbour")


_U01 = "(('0x' || substr(md5({}), 1, 8))::bigint / 4294967296.0::double)"


@query(
    "sample_uniform",
    _T + _NODE_DAYS + f"""
, r as (select *, row_number() over (partition by src order by ts, seq) as idx from trade_edges)
, c as (select q.qid, q.node, q.t, count(e.src) as cut from q join trade_edges e on e.src = q.node and e.ts < q.t group by all)
, s as (select *, unnest(range({K})) as slot from c)
, w as (select *, 1 + floor({_U01.format("'0:' || qid || ':' || slot")} * cut)::bigint as idx from s)
select w.qid, w.slot::int as slot, r.dst as neighbour, r.ts as neighbour_ts from w join r on r.src = w.node and r.idx = w.idx""",
)
def sample_uniform(spark: SparkSession, d: str) -> DataFrame:
    e = trade_edges(spark, d)
    return sampler.sample_uniform(e, node_days(e), K).select("qid", "slot", "neighbour", "neighbour_ts")


@query(
    "recency_features",
    _T + _NODE_DAYS + f"""
, c as (
  select q.qid, q.node, q.t, count(e.src) as cut, max(e.ts) as last_ts, list_sort(list(e.ts)) as h
  from q left join trade_edges e on e.src = q.node and e.ts < q.t group by all)
, f as (
  select *, case when cut > 0 then (t - last_ts) / 86400.0::double else 1e7::double / 86400 end as since,
         greatest(case when cut > 0 then (t - h[greatest(cut - {K} + 1, 1)]) / 86400.0::double else 1e7::double / 86400 end, 1 / 24.0::double) as span from c)
select qid, round(ln(1 + cut) / 5, 6) as f_count, round(ln(1 + since), 6) as f_since, round(ln(1 + span), 6) as f_span,
       round(ln((least(cut, {K}) + 1) / span), 6) as f_rate from f""",
)
def recency_features(spark: SparkSession, d: str) -> DataFrame:
    e = trade_edges(spark, d)
    f = sampler.recency_features(e, node_days(e), K)
    return f.select("qid", *[_R6(c).alias(c) for c in ("f_count", "f_since", "f_span", "f_rate")])


@query(
    "two_hop_peers",
    _U + """
, q as (select distinct src as node, max(ts) over () as t from user_edges)
, h1 as (select q.node, q.t, e.dst as bridge, row_number() over (partition by q.node order by e.ts desc, e.seq desc) as n from q join user_edges e on e.src = q.node and e.ts < q.t)
, b as (select distinct bridge, t from h1 where n <= 5)
, h2 as (select b.bridge, b.t, e.src as peer, row_number() over (partition by b.bridge order by e.ts desc, e.seq desc) as n from b join user_edges e on e.dst = b.bridge and e.ts < b.t)
select distinct h1.node, h2.peer from h1 join h2 on h1.bridge = h2.bridge and h1.t = h2.t where h1.n <= 5 and h2.n <= 5 and h2.peer <> h1.node""",
)
def two_hop_peers(spark: SparkSession, d: str) -> DataFrame:
    e = user_edges(spark, d)
    last = e.select(F.max("ts")).scalar()
    asked = e.select(F.col("src").alias("node")).distinct().select("node", last.alias("t"), F.col("node").alias("qid"))
    return sampler.two_hop_peers(e, asked, 5).select("node", "peer")


@query(
    "connected_components",
    """
with recursive p as (select distinct rptownercik as o, issuercik as i from reportingowner join submission using (accession_number) where rptownercik is not null and issuercik is not null),
e as (select 'o' || trim(o) as a, 'i' || trim(i) as b from p), both_ as (select a, b from e union select b, a from e),
r as (select distinct a as vertex, a as c from both_ union select both_.b, r.c from r join both_ on both_.a = r.vertex)
select vertex, min(c) as component from r group by 1""",
)
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    from chronoweave.session import read_table

    o, s = read_table(spark, d, "reportingowner"), read_table(spark, d, "submission")
    pairs = o.join(s, "accession_number").where("rptownercik is not null and issuercik is not null").select(
        F.concat(F.lit("o"), F.trim("rptownercik")).alias("a"), F.concat(F.lit("i"), F.trim("issuercik")).alias("b")
    ).distinct()
    return graph.components(pairs)
