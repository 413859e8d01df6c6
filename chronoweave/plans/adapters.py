"""Canonical edges and panels over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import prefix
from chronoweave.session import read_table

#: Codes of the event types and of an order line's state.
EVENT_TYPES = ("click", "view", "purchase", "signup", "logout")

#: Shares in which orders and lines of more than a task's share meet.
ORDER_SHARES = 2


def user_edges(spark: SparkSession, d: str) -> DataFrame:
    """events as edges from users to keys; times are unique microseconds."""
    e = read_table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("bigint").alias("dst"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ts"),
        (F.length("event_type") % 7).cast("int").alias("relation"), F.col("value").alias("weight"), F.col("event_id").alias("seq"),
    )


USER_EDGES = """user_edges as (
  select user_id as src, cast(json_extract_string(props, '$.k') as bigint) as dst, epoch_us(ts) as ts, (length(event_type) % 7)::int as relation,
         value as weight, event_id as seq from events)"""


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """orders and their lines as edges from customers to suppliers; many share a day."""
    o, l = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.unix_date(F.to_date("o_orderdate")).cast("bigint") * 86_400).alias("ts"),
        (F.ascii("l_returnflag") - 64).cast("int").alias("relation"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("weight"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )


def trade_orders(spark: SparkSession, d: str) -> list[DataFrame]:
    """(ts, o, edges): the trade edges of each order and time, as (src, dst) in order of seq; by (ts, o) they are all in order of (ts, seq). In shares by the order's key, so that a join shuffles only its share."""
    o, l = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    shares = ORDER_SHARES if prefix.size_of(l) > prefix.PART_BYTES else 1
    part = lambda t, key, i: t.where(F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(shares)) == i) if shares > 1 else t
    return [_orders(part(o, "o_orderkey", i), part(l, "l_orderkey", i)) for i in range(shares)]


def _orders(o: DataFrame, l: DataFrame) -> DataFrame:
    e = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        (F.unix_date(F.to_date("o_orderdate")).cast("bigint") * 86_400).alias("ts"), F.col("l_orderkey").alias("o"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "o_custkey").alias("e"),
    )
    ends = F.transform(F.array_sort(F.collect_list("e")), lambda x: F.struct(x["o_custkey"].alias("src"), x["l_suppkey"].alias("dst")))
    return e.groupBy("ts", "o").agg(ends.alias("edges"))


TRADE_EDGES = """trade_edges as (
  select o_custkey as src, l_suppkey as dst, (o_orderdate::date - date '1970-01-01')::bigint * 86400 as ts, (ascii(l_returnflag) - 64)::int as relation,
         l_extendedprice * (1 - l_discount) as weight, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq
  from lineitem join orders on l_orderkey = o_orderkey)"""


def own_queries(edges: DataFrame, step: int = 1) -> DataFrame:
    """Every edge asks for what its source did before it."""
    return edges.select(F.xxhash64("src", "ts", "seq").alias("qid"), F.col("src").alias("node"), F.col("ts").alias("t"))


def node_days(edges: DataFrame) -> DataFrame:
    """Each distinct (source, time) asks once; qid is made of both."""
    return edges.select(F.col("src").alias("node"), F.col("ts").alias("t")).distinct().withColumn("qid", F.col("node") * 100_000 + F.floor(F.col("t") / 86_400))


def nation_events(spark: SparkSession, d: str) -> DataFrame:
    """Trade between nations as an event corpus: src, dst nation names, day, quad class of the priority, goldstein of the discount, mentions of the quantity."""
    n = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    o, l = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    c, s = read_table(spark, d, "customer").select("c_custkey", "c_nationkey"), read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    quad = F.greatest(F.lit(5) - F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(0))
    return (
        l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(n.withColumnsRenamed({"n_nationkey": "ck", "n_name": "src"})), F.col("c_nationkey") == F.col("ck"))
        .join(F.broadcast(n.withColumnsRenamed({"n_nationkey": "sk", "n_name": "dst"})), F.col("s_nationkey") == F.col("sk"))
        .select("src", "dst", F.to_date("o_orderdate").alias("date"), quad.alias("quad_class"), (F.lit(5.0) - F.col("l_discount") * 100).alias("goldstein"), F.col("l_quantity").alias("num_mentions"))
    )


NATION_EVENTS = """nation_events as (
  select cn.n_name as src, sn.n_name as dst, o_orderdate::date as date, greatest(5 - substr(o_orderpriority, 1, 1)::int, 0) as quad_class,
         5.0::double - l_discount * 100 as goldstein, l_quantity as num_mentions
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  join nation cn on c_nationkey = cn.n_nationkey join nation sn on s_nationkey = sn.n_nationkey)"""


def prices(spark: SparkSession, d: str) -> DataFrame:
    """(date, ticker, close, volume): mean unit price and quantity per supplier nation and order day; days without trade are missing."""
    n, s = read_table(spark, d, "nation").select("n_nationkey", "n_name"), read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    o, l = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate"), read_table(spark, d, "lineitem")
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.to_date("o_orderdate").alias("date"), F.col("n_name").alias("ticker")).agg(
        F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("close"), F.sum("l_quantity").alias("volume")
    )


PRICES = """prices as (
  select o_orderdate::date as date, n_name as ticker, round(sum(l_extendedprice) / sum(l_quantity), 6) as close, sum(l_quantity) as volume
  from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all)"""


def validity(spark: SparkSession, d: str) -> DataFrame:
    """(s, c, start_, end_): the span of each supplier and customer pair."""
    o, l = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("l_suppkey").alias("s"), F.col("o_custkey").alias("c")).agg(
        F.min(F.to_date("o_orderdate")).alias("start_"), F.max(F.to_date("l_shipdate")).alias("end_")
    )


VALIDITY = """validity as (
  select l_suppkey as s, o_custkey as c, min(o_orderdate::date) as start_, max(l_shipdate::date) as end_
  from lineitem join orders on l_orderkey = o_orderkey group by all)"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null")
