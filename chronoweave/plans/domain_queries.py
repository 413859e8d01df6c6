"""Queries over the tables of events, filings, links and chains: ids, filters, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave import schema
from chronoweave.functions.calendar import arrival_seconds
from chronoweave.operators import ids, ownership, windows_of_validity
from chronoweave.plans.adapters import TRADE_EDGES, VALIDITY, trade_edges, validity
from chronoweave.plans.registry import REGISTRY
from chronoweave.session import checked_broadcast, read_table

query = REGISTRY.query

# --- ids and the event corpus ------------------------------------------------

_NORM = "upper(trim(regexp_replace({0}, '[ \\t\\r\\n\\x0B\\f]+', ' ', 'g')))"
_NAMES = f"""
with e as (select rec_id, min(src) as src, min(dst) as dst from corpus where rec_id is not null group by 1),
n as (select {_NORM.format('src')} as name, rec_id as position from e union all select {_NORM.format('dst')}, rec_id + (select max(rec_id) from e) + 1 from e),
f as (select name, min(position) as position from n where name is not null and name not in ('', 'NAN', 'NONE') group by 1),
ids as (select name, row_number() over (order by position) - 1 as id from f)
"""


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "corpus").where("rec_id is not null").groupBy("rec_id").agg(F.min("src").alias("src"), F.min("dst").alias("dst"))
    return rows.select("rec_id", ids.normalize_name(F.col("src")).alias("src"), ids.normalize_name(F.col("dst")).alias("dst"))


@query("dense_ids", _NAMES + "select name, id from ids")
def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return ids.dense_ids(ids.edge_names(_corpus(spark, d), "rec_id"))


@query(
    "map_edges_to_ids",
    _NAMES + f"""
select e.rec_id, coalesce(a.id, -1) as src_id, coalesce(b.id, -1) as dst_id
from e left join ids a on a.name = {_NORM.format('e.src')} left join ids b on b.name = {_NORM.format('e.dst')}""",
)
def map_edges_to_ids(spark: SparkSession, d: str) -> DataFrame:
    """Both ends as ids; -1 is no name alone."""
    rows = _corpus(spark, d)
    known = checked_broadcast(ids.dense_ids(ids.edge_names(rows, "rec_id")))
    return ids.with_ids(ids.with_ids(rows, known, "src", "src_id"), known, "dst", "dst_id").select("rec_id", "src_id", "dst_id")


@query("id_overflow", _NAMES + f"select count(*) filter (where a.id >= 400 or b.id >= 400) as edges_over, count(*) filter (where a.id >= 400) + count(*) filter (where b.id >= 400) as ends_over from e left join ids a on a.name = {_NORM.format('e.src')} left join ids b on b.name = {_NORM.format('e.dst')}")
def id_overflow(spark: SparkSession, d: str) -> DataFrame:
    """How many edges and ends a bound of 400 ids would leave without one."""
    rows = _corpus(spark, d)
    known = checked_broadcast(ids.dense_ids(ids.edge_names(rows, "rec_id")))
    mapped = ids.with_ids(ids.with_ids(rows, known, "src", "src_id"), known, "dst", "dst_id")
    over = [(F.col(c) >= 400).cast("int") for c in ("src_id", "dst_id")]
    return mapped.agg(F.sum(F.greatest(*over)).alias("edges_over"), F.sum(over[0] + over[1]).alias("ends_over"))


_CODE = "case when length(trim({0})) = 3 then upper(trim({0})) end"
_REDUCED = f"""
with n as (select canonical_name, min(country_code) as cc from actor_ref group by 1),
r as (
  select globaleventid, case when dateadded >= 10000000000000 then epoch(try_strptime(cast(dateadded as varchar), '%Y%m%d%H%M%S'))::bigint else dateadded end as ts,
         coalesce({_CODE.format('actor1countrycode')}, a.cc) as src, coalesce({_CODE.format('actor2countrycode')}, b.cc) as dst, quadclass, goldsteinscale, nummentions
  from gdelt_slices left join n a on a.canonical_name = actor1name left join n b on b.canonical_name = actor2name),
red as (select * from r where ts is not null and src is not null and dst is not null and src <> dst)
"""


def reduced(spark: SparkSession, d: str) -> DataFrame:
    """Events between two countries: the code where it has three letters, else that of the name; no self-loops."""
    g = read_table(spark, d, "gdelt_slices")
    n = checked_broadcast(read_table(spark, d, "actor_ref").groupBy("canonical_name").agg(F.min("country_code").alias("cc")))
    code = lambda c: F.when(F.length(F.trim(c)) == 3, F.upper(F.trim(c)))
    a, b = n.withColumnsRenamed({"canonical_name": "actor1name", "cc": "ca"}), n.withColumnsRenamed({"canonical_name": "actor2name", "cc": "cb"})
    rows = g.join(a, "actor1name", "left").join(b, "actor2name", "left").select(
        "globaleventid", arrival_seconds(F.col("dateadded")).alias("ts"), F.coalesce(code("actor1countrycode"), "ca").alias("src"),
        F.coalesce(code("actor2countrycode"), "cb").alias("dst"), "quadclass", "goldsteinscale", "nummentions",
    )
    return rows.where("ts is not null and src is not null and dst is not null and src <> dst")


@query("corpus_reduce", _REDUCED + "select globaleventid, ts, src, dst, coalesce(quadclass, 0)::int as quad_class, goldsteinscale as goldstein, coalesce(nummentions, 1)::int as num_mentions from red")
def corpus_reduce(spark: SparkSession, d: str) -> DataFrame:
    return reduced(spark, d).select(
        "globaleventid", "ts", "src", "dst", F.coalesce("quadclass", F.lit(0)).alias("quad_class"), F.col("goldsteinscale").alias("goldstein"), F.coalesce("nummentions", F.lit(1)).alias("num_mentions")
    )


@query("split_by_quad", _REDUCED + "select case when quadclass in (3, 4) then 'conflict' else 'cooperation' end as side, src, count(*) as n from red where quadclass between 1 and 4 group by all")
def split_by_quad(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("quadclass").isin(*schema.CONFLICT), "conflict").otherwise("cooperation")
    return reduced(spark, d).where("quadclass between 1 and 4").groupBy(side.alias("side"), "src").agg(F.count(F.lit(1)).alias("n"))


@query("corpus_totals", _REDUCED + "select count(*) as n_events, min(ts) as first_ts, max(ts) as last_ts, count(distinct src) as n_src, count(distinct dst) as n_dst from red")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    return reduced(spark, d).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst")
    )


# --- insider filings ---------------------------------------------------------

_CIK = "nullif(ltrim(trim({0}), '0'), '')"
_REL = "regexp_replace(lower(rptowner_relationship), '[^a-z]', '', 'g')"
_OWNERS = f"""
o as (select accession_number, {_CIK.format('rptownercik')} as owner,
        max(case when {_REL} like '%director%' then 1 when {_REL} like '%officer%' then 2 when {_REL} like '%tenpercent%' then 3 else 0 end) as relation
      from reportingowner where {_CIK.format('rptownercik')} is not null group by 1, 2),
s as (select distinct accession_number, {_CIK.format('issuercik')} as issuer from submission where {_CIK.format('issuercik')} is not null),
oe as (select o.accession_number, owner, issuer, relation from o join s using (accession_number))"""


def _owner_edges(spark: SparkSession, d: str) -> DataFrame:
    return ownership.owner_edges(read_table(spark, d, "reportingowner"), read_table(spark, d, "submission"))


@query("form345_owner_edges", f"with {_OWNERS} select accession_number, owner, issuer, relation::int as relation from oe")
def form345_owner_edges(spark: SparkSession, d: str) -> DataFrame:
    return _owner_edges(spark, d).select("accession_number", "owner", "issuer", "relation")


@query("bridge_cap", f"with {_OWNERS}, k as (select owner from oe group by 1 having count(distinct issuer) <= 15) select owner, issuer, count(*) as n from oe where owner in (select owner from k) group by all")
def bridge_cap(spark: SparkSession, d: str) -> DataFrame:
    return ownership.within_cap(_owner_edges(spark, d), "owner", "issuer", 15).groupBy("owner", "issuer").agg(F.count(F.lit(1)).alias("n"))


@query(
    "interlock_pairs",
    f"""
with {_OWNERS}, last as (select owner, issuer, max(accession_number) as ts from oe group by 1, 2),
k as (select owner from last group by 1 having count(*) <= 15), l as (select * from last where owner in (select owner from k)),
p as (select x.issuer as a, y.issuer as b, x.owner as bridge, greatest(x.ts, y.ts) as ts from l x join l y on x.owner = y.owner and x.issuer < y.issuer)
select a, b, bridge, ts from (select *, row_number() over (partition by a, b order by bridge, ts) as r from p) where r = 1""",
)
def interlock_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ownership.interlocks(_owner_edges(spark, d), "owner", "issuer", "accession_number")


@query(
    "discretionary_trades",
    """
with t as (select distinct nonderiv_trans_sk, accession_number, trans_code, trans_shares, trans_pricepershare from nonderiv_trans),
s as (select distinct accession_number from submission where trim(document_type) = '4')
select nonderiv_trans_sk, trans_code, round(trans_shares * trans_pricepershare, 4) as value from t join s using (accession_number) where trans_code in ('P', 'S')""",
)
def discretionary_trades(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "nonderiv_trans").select("nonderiv_trans_sk", "accession_number", "trans_code", "trans_shares", "trans_pricepershare").distinct()
    s = read_table(spark, d, "submission").where(F.trim("document_type") == "4").select("accession_number").distinct()
    return t.where(F.col("trans_code").isin(*ownership.OPEN_MARKET)).join(s, "accession_number").select(
        "nonderiv_trans_sk", "trans_code", F.round(F.col("trans_shares") * F.col("trans_pricepershare"), 4).alias("value")
    )


_FLOW = f"""
with t as (select distinct nonderiv_trans_sk, accession_number, trans_code, trans_shares * trans_pricepershare as v from nonderiv_trans where trans_code in ('P', 'S')),
s as (select distinct accession_number, {_CIK.format('issuercik')} as issuer, coalesce(try_cast(filing_date as date), try_strptime(trim(filing_date), '%d-%b-%Y')::date, try_strptime(trim(filing_date), '%Y%m%d')::date, try_strptime(trim(filing_date), '%m/%d/%Y')::date) as day from submission where issuercik is not null),
f as (select issuer, day, sum(case when trans_code = 'P' then v else -v end) as flow from t join s using (accession_number) where day is not null group by all),
big as (select * from f where abs(flow) >= 10000)
"""


@query("net_insider_flow", _FLOW + "select issuer, day, round(flow, 2) as flow, sign(flow)::int as sign from big where abs(flow) >= (select quantile_cont(abs(flow), 0.9) from big)")
def net_insider_flow(spark: SparkSession, d: str) -> DataFrame:
    from chronoweave.operators.hot_keys import cik_key

    t = read_table(spark, d, "nonderiv_trans").select("nonderiv_trans_sk", "accession_number", "trans_code", (F.col("trans_shares") * F.col("trans_pricepershare")).alias("v")).distinct()
    s = read_table(spark, d, "submission").where("issuercik is not null").select("accession_number", cik_key(F.col("issuercik")).alias("issuer"), ownership.filing_date(F.col("filing_date")).alias("day")).distinct()
    rows = t.join(s, "accession_number").where("day is not null")
    return ownership.net_flow(rows, "issuer", "day", "trans_code", F.col("v"), 10_000, 0.9).withColumn("flow", F.round("flow", 2))


@query(
    "majority_symbol",
    f"""
with c as (select {_CIK.format('issuercik')} as issuer, upper(trim(issuertradingsymbol)) as symbol, count(*) as n from submission where issuertradingsymbol is not null group by all)
select issuer, symbol from (select *, row_number() over (partition by issuer order by n desc, symbol) as r from c where issuer is not null) where r = 1""",
)
def majority_symbol(spark: SparkSession, d: str) -> DataFrame:
    from chronoweave.operators.hot_keys import cik_key

    s = read_table(spark, d, "submission").select(cik_key(F.col("issuercik")).alias("issuer"), F.upper(F.trim("issuertradingsymbol")).alias("symbol"))
    return ownership.majority(s.where("issuer is not null"), "issuer", "symbol")


# --- chains ------------------------------------------------------------------

_CHAIN = """
with t as (select block_number, transaction_index, min(lower(from_address)) as src, min(lower(to_address)) as dst, max(value_f64) as v, max(n_input_bytes) as b, bool_and(success) as ok
  from eth_transactions group by 1, 2)
"""


def _chain(spark: SparkSession, d: str) -> DataFrame:
    """Each transaction once, with its relation code; the later tests override the earlier ones."""
    t = read_table(spark, d, "eth_transactions").groupBy("block_number", "transaction_index").agg(
        F.min(F.lower("from_address")).alias("src"), F.min(F.lower("to_address")).alias("dst"), F.max("value_f64").alias("v"), F.max("n_input_bytes").alias("b"), F.bool_and("success").alias("ok")
    )
    r = schema.CHAIN_RELATIONS
    code = (
        F.when(F.col("ok") == F.lit(False), r["FAILED"]).when(F.col("dst").isNull(), r["CREATE"])
        .when((F.col("b") > 0) & (F.coalesce("v", F.lit(0.0)) == 0), r["ZERO_CALL"]).when(F.col("b") > 0, r["CALL"])
        .when(F.col("v") > 0, r["VALUE_TRANSFER"]).otherwise(r["UNKNOWN"])
    )
    return t.withColumn("relation", code)


_CLASSED = _CHAIN + """, c as (select *, case when ok = false then 5 when dst is null then 4 when b > 0 and coalesce(v, 0) = 0 then 3 when b > 0 then 2 when v > 0 then 1 else 0 end as relation from t)"""


@query("chain_relation_share", _CLASSED + " select relation::int as relation, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from c group by 1")
def chain_relation_share(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    counts = _chain(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))  # six rows at most
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query(
    "chain_edges",
    _CLASSED + """
, e as (select c.*, epoch(block_time)::bigint as ts from c left join (select distinct block_number, block_time from eth_blocks) using (block_number) where dst is not null and src is not null),
d as (select v, count(*) as n from (select src as v from e union all select dst from e) group by 1 having count(*) >= 5)
select block_number, transaction_index, src, dst, relation::int as relation, v as value from e where src in (select v from d) and dst in (select v from d)""",
)
def chain_edges(spark: SparkSession, d: str) -> DataFrame:
    blocks = read_table(spark, d, "eth_blocks").select("block_number", "block_time").distinct()
    e = _chain(spark, d).where("src is not null and dst is not null").join(blocks, "block_number", "left")
    return ids.min_degree(e, 5).select("block_number", "transaction_index", "src", "dst", "relation", F.col("v").alias("value"))


# --- supply links ------------------------------------------------------------

_PAD = "lpad(regexp_replace(trim({0}), '^0+', ''), 6, '0')"
_LINKS = f"""
with l as (select distinct {_PAD.format('gvkey')} as src, {_PAD.format('cgvkey')} as dst, srcdate, salecs from supply_chain
           where gvkey is not null and cgvkey is not null and srcdate is not null),
k as (select *, salecs / nullif(sum(salecs) over (partition by src, year(srcdate)), 0) as share from l where src <> dst)
"""


@query("supply_links", _LINKS + "select src, dst, srcdate, round(share, 6) as weight from k where share >= 0.1")
def supply_links(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    pad = lambda c: F.lpad(F.regexp_replace(F.trim(c), "^0+", ""), 6, "0")
    l = read_table(spark, d, "supply_chain").where("gvkey is not null and cgvkey is not null and srcdate is not null").select(
        pad("gvkey").alias("src"), pad("cgvkey").alias("dst"), "srcdate", "salecs"
    ).distinct().where("src <> dst")
    share = F.try_divide("salecs", F.sum("salecs").over(Window.partitionBy("src", F.year("srcdate"))))
    return l.withColumn("share", share).where("share >= 0.1").select("src", "dst", "srcdate", F.round("share", 6).alias("weight"))


@query("first_link_per_pair", _LINKS + "select src, dst, min(srcdate) as first_date from k group by all")
def first_link_per_pair(spark: SparkSession, d: str) -> DataFrame:
    pad = lambda c: F.lpad(F.regexp_replace(F.trim(c), "^0+", ""), 6, "0")
    l = read_table(spark, d, "supply_chain").where("gvkey is not null and cgvkey is not null and srcdate is not null")
    return l.select(pad("gvkey").alias("src"), pad("cgvkey").alias("dst"), "srcdate").where("src <> dst").groupBy("src", "dst").agg(F.min("srcdate").alias("first_date"))


@query(
    "artifact_dates",
    "with c as (select o_orderdate::date as day, count(*) as n from orders group by 1) select day, n from c where n > 2 * (select median(n) from c)",
)
def artifact_dates(spark: SparkSession, d: str) -> DataFrame:
    counts = read_table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > 2 * counts.select(F.median("n")).scalar())


# --- spans of validity -------------------------------------------------------

_LO, _HI = "date '1997-01-01'", "date '1997-06-30'"


@query("validity_overlap", f"with {VALIDITY} select s, c, greatest(start_, {_LO}) as ts from validity where start_ <= {_HI} and end_ >= {_LO}")
def validity_overlap(spark: SparkSession, d: str) -> DataFrame:
    return windows_of_validity.overlapping(validity(spark, d), F.expr(_LO), F.expr(_HI)).select("s", "c", "ts")


_ASKED = "asked as (select distinct o_custkey as c, o_orderdate::date as when_ from orders where o_custkey % 50 = 0)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose id is divisible by 50 ask on each of their order days."""
    return read_table(spark, d, "orders").where("o_custkey % 50 = 0").select(F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("when")).distinct()


@query("asof_validity_join", f"with {VALIDITY}, {_ASKED} select a.c, a.when_ as \"when\", v.s from asked a join validity v on v.c = a.c and v.start_ <= a.when_ and a.when_ < v.end_")
def asof_validity_join(spark: SparkSession, d: str) -> DataFrame:
    return windows_of_validity.alive_at(validity(spark, d), _asked(spark, d), "c").select("c", "when", "s")


@query(
    "two_hop_validity",
    f"""
with {VALIDITY}, {_ASKED}, h as (select distinct a.c, a.when_, v.s from asked a join validity v on v.c = a.c and v.start_ <= a.when_ and a.when_ < v.end_),
f as (select distinct h.c, h.when_, v.s as s2 from h join validity v on v.c = h.s and v.start_ <= h.when_ and h.when_ < v.end_ where v.s <> h.c),
x as (select f.* from f left join h on h.c = f.c and h.when_ = f.when_ and h.s = f.s2 where h.c is null)
select c, when_ as "when", s2 from (select *, row_number() over (partition by c, when_ order by s2) as r from x) where r <= 40""",
)
def two_hop_validity(spark: SparkSession, d: str) -> DataFrame:
    return windows_of_validity.two_hop_alive(validity(spark, d), _asked(spark, d), 40)


_BITS = f"""
with {TRADE_EDGES}, r as (select relation, least(src, dst) as a, greatest(src, dst) as b from trade_edges where src <> dst),
m as (select a, b, bit_or(case when relation = 1 then 1 when relation = 14 then 2 else 4 end) as mask from r group by all)
"""


def _masks(spark: SparkSession, d: str) -> DataFrame:
    e = trade_edges(spark, d)
    return windows_of_validity.pair_masks({0: e.where("relation = 1"), 1: e.where("relation = 14"), 2: e.where("relation not in (1, 14)")})


@query("corroboration_mask", _BITS + "select a, b, mask::int as mask, bit_count(mask)::int as n_sources from m")
def corroboration_mask(spark: SparkSession, d: str) -> DataFrame:
    return _masks(spark, d)


@query(
    "source_overlap",
    _BITS + """
select x.bit::int as bit_a, y.bit::int as bit_b, count(*) filter (where (mask & x.bit) > 0 and (mask & y.bit) > 0) as shared, count(*) filter (where (mask & x.bit) > 0 or (mask & y.bit) > 0) as either
from m, (values (1), (2), (4)) x(bit), (values (1), (2), (4)) y(bit) where x.bit < y.bit group by all""",
)
def source_overlap(spark: SparkSession, d: str) -> DataFrame:
    m = _masks(spark, d)
    counts = m.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))  # at most eight rows
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("bit_a"), F.lit(b).alias("bit_b")) for a, b in ((1, 2), (1, 4), (2, 4))])).alias("p")
    has = lambda c: F.col("mask").bitwiseAND(F.col(c)) > 0
    rows = counts.select("mask", "n", pairs).select("mask", "n", "p.*")
    return rows.groupBy("bit_a", "bit_b").agg(
        F.sum(F.when(has("bit_a") & has("bit_b"), F.col("n")).otherwise(0)).alias("shared"), F.sum(F.when(has("bit_a") | has("bit_b"), F.col("n")).otherwise(0)).alias("either")
    )


# --- density -----------------------------------------------------------------


@query(
    "density_report",
    f"""
with {TRADE_EDGES}, p as (select distinct year(to_timestamp(ts)) * 10 + quarter(to_timestamp(ts)) as period, src as entity, dst as bridge from trade_edges),
bd as (select period, bridge, count(*) as n from p group by all), ed as (select period, entity, count(*) as n from p group by all),
live as (select p.* from p join bd using (period, bridge) where bd.n > 1),
th as (select x.period, x.entity, count(distinct y.entity) as n from live x join live y on x.period = y.period and x.bridge = y.bridge and x.entity <> y.entity group by all)
select (select count(*) from trade_edges) as edges, (select count(distinct entity) from p) as entities, (select count(distinct bridge) from p) as bridges,
       (select count(distinct period) from p) as periods, (select median(n) from bd) as bridge_degree_median, (select round(avg(n), 6) from bd) as bridge_degree_mean,
       (select round(avg((n > 1)::int), 6) from bd) as multi_entity_bridge_share, (select median(n) from ed) as entity_degree_median,
       (select median(n) from th) as two_hop_degree_median, (select round(avg(n), 6) from th) as two_hop_degree_mean, (select round(avg((n >= 5)::int), 6) from th) as two_hop_ge5_share""",
)
def density_report(spark: SparkSession, d: str) -> DataFrame:
    from chronoweave.operators.density import density_report as report

    e = trade_edges(spark, d)
    day = F.date_from_unix_date((F.col("ts") / 86_400).cast("int"))
    return report(e.select(F.col("src").alias("entity"), F.col("dst").alias("bridge"), (F.year(day) * 10 + F.quarter(day)).alias("period")))


@query(
    "two_hop_degree",
    f"""
with {_OWNERS}, q as (select distinct issuer as a, owner as b from oe), k as (select b from q group by 1 having count(*) <= 15),
p as (select * from q where b in (select b from k))
select x.a as vertex, count(distinct y.a) as n from p x join p y on x.b = y.b and x.a <> y.a group by 1""",
)
def two_hop_degree(spark: SparkSession, d: str) -> DataFrame:
    from chronoweave.operators.density import two_hop_counts

    pairs = ownership.within_cap(_owner_edges(spark, d), "owner", "issuer", 15).select(F.col("issuer").alias("entity"), F.col("owner").alias("bridge"), F.lit(0).alias("period")).distinct()
    return two_hop_counts(pairs).select(F.col("entity").alias("vertex"), "n")
