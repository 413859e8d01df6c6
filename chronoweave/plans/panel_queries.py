"""Queries of signal panels, the backtest and event studies, over trade between nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.operators import panels, studies
from chronoweave.plans.adapters import NATION_EVENTS, PRICES, nation_events, prices
from chronoweave.plans.registry import REGISTRY
from chronoweave.session import read_table

query = REGISTRY.query
DAYS, HORIZONS = 7, (1, 2, 3, 5, 10)
CONFIG = panels.BacktestConfig()

_DAILY = f"""
with {NATION_EVENTS}, {PRICES}, both_ as (
  select date, src as country, {{v}} as v from nation_events union all select date, dst, {{v}} from nation_events),
daily as (select date, country, sum(v) as value from both_ group by all),
ends as (select min(date) as a, max(date) as b from daily),
grid as (select country, unnest(generate_series(a, b, interval 1 day))::date as date from (select distinct country from daily), ends),
dense as (select g.date, g.country, coalesce(value, 0) as value from grid g left join daily using (date, country)),
sig as (select date, country, sum(value) over (partition by country order by date rows between {DAYS} preceding and 1 preceding) as signal from dense)
"""
_PRESSURE = "(case when quad_class in (3, 4) then coalesce(num_mentions, 1) * abs(least(coalesce(goldstein, 0), 0)) else 0 end)"
_GOLD, _COUNT = _DAILY.format(v=_PRESSURE), _DAILY.format(v="1.0::double")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    e = nation_events(spark, d)
    v = panels.conflict_pressure(F.col("quad_class"), F.col("goldstein"), F.col("num_mentions"))
    return panels.trailing_signal(panels.daily_by_actor(e, v), DAYS)


@query("goldstein_signal", _GOLD + "select date, country, round(signal, 6) as signal from sig where signal is not null")
def goldstein_signal(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).withColumn("signal", F.round("signal", 6))


@query("event_count_signal", _COUNT + "select date, country, signal from sig where signal is not null and dayofweek(date) between 1 and 5")
def event_count_signal(spark: SparkSession, d: str) -> DataFrame:
    return panels.business_days(panels.trailing_signal(panels.daily_by_actor(nation_events(spark, d), F.lit(1.0)), DAYS))


_GRID = """cal as (select distinct date from prices), g0 as (select c.date, t.ticker from cal c, (select distinct ticker from prices) t),
pg as (select date, ticker, close, close / lag(close) over w - 1 as ret, lag(close, 5) over w as back from g0 left join prices using (date, ticker) window w as (partition by ticker order by date))"""


@query("reversal_signal", f"with {PRICES}, {_GRID} select date, ticker as country, round(-(close / back - 1), 6) as signal from pg where close / back is not null")
def reversal_signal(spark: SparkSession, d: str) -> DataFrame:
    return panels.reversal_signal(prices(spark, d), 5).withColumn("signal", F.round("signal", 6))


@query("liquidity_screen", f"with {PRICES} select ticker, round(median(close * volume), 4) as median_value, coalesce(median(close * volume) >= 50000 or median(close * volume) <= 0, true) as kept from prices group by 1")
def liquidity_screen(spark: SparkSession, d: str) -> DataFrame:
    return panels.liquid(prices(spark, d), 50_000).withColumn("median_value", F.round("median_value", 4))


@query(
    "tradability_screen",
    f"with {PRICES}, {_GRID} select ticker, round(stddev_samp(ret) * sqrt(252), 6) as volatility, round(max(abs(ret)), 6) as max_move, coalesce(stddev_samp(ret) * sqrt(252) between 1 and 40 and max(abs(ret)) <= 30, true) as kept from pg group by 1",
)
def tradability_screen(spark: SparkSession, d: str) -> DataFrame:
    return panels.tradable(prices(spark, d), 1, 40, 30).withColumns({"volatility": F.round("volatility", 6), "max_move": F.round("max_move", 6)})


# two nations share an instrument
_UNIVERSE = """u as (select n_name as country, case when n_nationkey = 1 then (select n_name from nation where n_nationkey = 0) else n_name end as ticker from nation),
ms as (select date, ticker, avg(signal) as signal from sig join u using (country) where signal is not null group by all)"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "nation")
    first = n.where("n_nationkey = 0").select("n_name").scalar()
    u = n.select(F.col("n_name").alias("country"), F.when(F.col("n_nationkey") == 1, first).otherwise(F.col("n_name")).alias("ticker"))
    return panels.instruments(_gold(spark, d), u)


@query("instrument_signals", _GOLD + f", {_UNIVERSE} select date, ticker, round(signal, 6) as signal from ms")
def instrument_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).withColumn("signal", F.round("signal", 6))


_WEIGHTS = (
    _GOLD
    + f""", {_UNIVERSE}, pr as (select * from prices where ticker in (select ticker from ms)), cal as (select distinct date from pr), g0 as (select c.date, t.ticker from cal c, (select distinct ticker from pr) t),
pg as (select date, ticker, close, close / lag(close) over (partition by ticker order by date) - 1 as ret from g0 left join pr using (date, ticker)),
a1 as (select pg.*, case when close is not null then signal end as s0 from pg left join ms using (date, ticker)),
a2 as (select *, case when count(s0) over w >= 10 then s0 - avg(s0) over w end as s from a1 window w as (partition by ticker order by date rows between 60 preceding and 1 preceding)),
a3 as (select *, greatest(least(-1.0::double * (s - avg(s) over d) / nullif(stddev_pop(s) over d, 0), 3.0), -3.0) as z0 from a2 window d as (partition by date)),
a3b as (select *, case when s is not null and (s - avg(s) over d) / nullif(stddev_pop(s) over d, 0) is not null then z0 end as z from a3 window d as (partition by date)),
a4 as (select *, z - avg(z) over (partition by date) as w1 from a3b),
a5 as (select *, w1 / nullif(sum(abs(w1)) over (partition by date), 0) as w2 from a4),
a6 as (select *, w2 * least(0.15::double / nullif(max(abs(w2)) over (partition by date), 0), 1.0) as w3 from a5),
wt as (select date, ticker, ret, case when count(s) over (partition by date) >= 5 then w3 end as weight from a6)
"""
)


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return panels.weights(_signals(spark, d), prices(spark, d), CONFIG)


@query("zscore_weights", _WEIGHTS + "select date, ticker, round(weight, 6) as weight from wt where weight is not null")
def zscore_weights(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).where("weight is not null").select("date", "ticker", F.round("weight", 6).alias("weight"))


_BOOK = (
    _WEIGHTS
    + """, h as (select *, lag(weight, 2) over (partition by ticker order by date) as held, row_number() over (partition by ticker order by date) as rn from wt),
m as (select *, case when rn > 1 then abs(coalesce(held, 0) - coalesce(lag(held) over (partition by ticker order by date), 0)) else 0 end as move from h),
bk as (select date, sum(held * ret) as gross_return, sum(move) as turnover, count(held) as names from m group by 1),
book as (select *, turnover * 5 / 10000.0::double as cost, gross_return - turnover * 5 / 10000.0::double as net_return from bk where names > 0)
"""
)


@query("backtest_daily", _BOOK + "select date, round(gross_return, 6) as gross_return, round(cost, 8) as cost, round(net_return, 6) as net_return, round(turnover, 6) as turnover, names from book")
def backtest_daily(spark: SparkSession, d: str) -> DataFrame:
    b = panels.daily_book(_weights(spark, d), CONFIG)
    return b.select("date", *[F.round(c, n).alias(c) for c, n in (("gross_return", 6), ("cost", 8), ("net_return", 6), ("turnover", 6))], "names")


@query(
    "backtest_metrics",
    _BOOK
    + """, e as (select *, product(1 + net_return) over (order by date rows unbounded preceding) as equity from book where net_return is not null),
q as (select *, equity / max(equity) over (order by date rows unbounded preceding) - 1 as dd from e),
a as (select count(*) as days, arg_max(equity, date) - 1 as total, stddev_samp(net_return) as sd, avg(net_return) as m, min(dd) as mdd, avg((net_return > 0)::int) as hit, avg(turnover) as t, sum(cost) as c from q)
select days, round(total, 5) as total_return, round(case when total <= -1 then -1 else pow(1 + greatest(total, -1), 252.0::double / days) - 1 end, 5) as annual_return, round(sd * sqrt(252), 5) as annual_volatility,
       round(m / sd * sqrt(252), 5) as sharpe, round(m / sd * sqrt(days), 5) as t_stat, round(mdd, 5) as max_drawdown, round(hit, 6) as hit_rate, round(t, 6) as avg_turnover, round(c, 6) as total_cost from a""",
)
def backtest_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = panels.summary(panels.daily_book(_weights(spark, d), CONFIG))
    fine = {"hit_rate", "avg_turnover", "total_cost"}
    return m.select("days", *[F.round(c, 6 if c in fine else 5).alias(c) for c in m.columns if c != "days"])


@query(
    "walk_forward_folds",
    """
with e as (select min(epoch(o_orderdate))::bigint as a, max(epoch(o_orderdate))::bigint as b from orders), s as (select a, b, a + floor((b - a) * 0.4)::bigint as st from e)
select i::int as fold, a as train_start, floor(st + i * ((b - st) / 4.0::double))::bigint as train_end, floor(st + i * ((b - st) / 4.0::double))::bigint as test_start,
       case when i = 3 then b + 1 else floor(st + (i + 1) * ((b - st) / 4.0::double))::bigint end as test_end from s, (select unnest(range(4)) as i)""",
)
def walk_forward_folds(spark: SparkSession, d: str) -> DataFrame:
    day = F.unix_date(F.to_date("o_orderdate")).cast("bigint") * 86_400
    r = read_table(spark, d, "orders").agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    rows = [(i, *f) for i, f in enumerate(panels.folds(r.a, r.b, 4, 0.4))]
    return spark.createDataFrame(rows, "fold int, train_start bigint, train_end bigint, test_start bigint, test_end bigint")


_ABN = f"with {PRICES}, {_GRID}, ab as (select date, ticker, ret - avg(ret) over (partition by date) as abn from pg)"
_CAR = _ABN + ", h as (select * from (values (1), (2), (3), (5), (10)) h(horizon)), o as (select *, row_number() over (partition by ticker order by date) as rn, count(*) over (partition by ticker) as n from ab), " + (
    "car as (select a.date, a.ticker, h.horizon, sum(b.abn) as car from o a, h, o b where b.ticker = a.ticker and b.rn between a.rn + 1 and a.rn + h.horizon and a.rn + h.horizon <= a.n group by all having sum(b.abn) is not null)"
)


def _abn(spark: SparkSession, d: str) -> DataFrame:
    return studies.abnormal(panels.price_grid(prices(spark, d)))


@query("abnormal_returns", _ABN + " select date, ticker, round(abn, 6) as abn from ab where abn is not null")
def abnormal_returns(spark: SparkSession, d: str) -> DataFrame:
    return _abn(spark, d).where("abn is not null").withColumn("abn", F.round("abn", 6))


@query("forward_car", _CAR + " select date, ticker, horizon, round(car, 6) as car from car")
def forward_car(spark: SparkSession, d: str) -> DataFrame:
    return studies.forward(_abn(spark, d), HORIZONS).withColumn("car", F.round("car", 6))


_SHOCK = ", sh as (select date, ticker, sign(abn)::int as sign from ab where abs(abn) >= (select quantile_cont(abs(abn), 0.99) from ab))"


@query("shock_quantile", _ABN + _SHOCK + " select date, ticker, sign from sh")
def shock_quantile(spark: SparkSession, d: str) -> DataFrame:
    return studies.shocks(_abn(spark, d), 0.99)


_RESPONSE = """
, {n}p as (select horizon, date, avg(sign * car) as v, count(*) as k from {ev} join car using (date, ticker) group by all)
, {n} as (select horizon, avg(v) as mean, sum(k)::bigint as n, case when stddev_samp(v) > 0 then stddev_samp(v) / sqrt(count(*)) end as se, count(*) as clusters from {n}p group by 1)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("horizon", *[F.round(c, 6).alias(c) for c in ("mean", "t", "se")], "n", "clusters")


def _study(spark: SparkSession, d: str):
    abn = _abn(spark, d)
    n = read_table(spark, d, "nation").select("n_name", "n_regionkey")
    near = n.join(n.withColumnsRenamed({"n_name": "neighbour"}), "n_regionkey").where("n_name <> neighbour").select(F.col("n_name").alias("ticker"), "neighbour")
    events = studies.shocks(abn, 0.99)
    return abn, studies.forward(abn, HORIZONS), events, near, n.select(F.col("n_name").alias("ticker"))


@query("event_response", _CAR + _SHOCK + _RESPONSE.format(n="own", ev="sh") + " select horizon, round(mean, 6) as mean, round(mean / se, 6) as t, n, round(se, 6) as se, clusters from own")
def event_response(spark: SparkSession, d: str) -> DataFrame:
    _, car, events, _, _ = _study(spark, d)
    return _rounded(studies.response(events, car))


_NEAR = """
, nb as (select a.n_name as ticker, b.n_name as neighbour from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name <> b.n_name)
, ne as (select s.date, nb.neighbour as ticker, s.sign, s.ticker as "of" from sh s join nb using (ticker) where not exists (select 1 from sh x where x.date = s.date and x.ticker = nb.neighbour))
, want as (select date, "of", count(*) as want, any_value(sign) as sign from ne group by all)
, dr as (
    select w.*, ('0x' || substr(md5('0:' || w.date || ':' || w."of" || ':' || w.slot), 1, 8))::bigint % c.n as place
    from (select *, unnest(range(8 * want + 16)) as slot from want) w, (select count(*) as n from nation) c)
, fr as (
    select d.date, d."of", t.ticker, d.sign, d.want, min(d.slot) as slot
    from dr d join (select n_name as ticker, row_number() over (order by n_name) - 1 as place from nation) t using (place)
    where t.ticker <> d."of" and not exists (select 1 from nb where nb.ticker = d."of" and nb.neighbour = t.ticker) and not exists (select 1 from sh x where x.date = d.date and x.ticker = t.ticker) group by all)
, pl as (select date, ticker, sign from (select *, row_number() over (partition by date, "of" order by slot) as r from fr) where r <= want)"""
_DIFF = _CAR + _SHOCK + _NEAR + _RESPONSE.format(n="tr", ev="ne") + _RESPONSE.format(n="co", ev="pl") + """
, df as (select horizon, tr.mean - co.mean as mean, least(tr.n, co.n) as n, sqrt(coalesce(tr.se, 0) ** 2 + coalesce(co.se, 0) ** 2) as se, least(tr.clusters, co.clusters) as clusters from tr join co using (horizon))"""


@query("event_study", _DIFF + " select horizon, round(mean, 6) as mean, round(mean / nullif(se, 0), 6) as t, n, round(se, 6) as se, clusters from df")
def event_study(spark: SparkSession, d: str) -> DataFrame:
    _, car, events, near, names = _study(spark, d)
    ne = studies.neighbour_events(events, near)
    return _rounded(studies.difference(studies.response(ne, car), studies.response(studies.placebo(events, near, names, ne), car)))


@query(
    "half_life",
    _CAR + _SHOCK + ", ev as (select date, ticker, -sign as sign from sh)" + _RESPONSE.format(n="own", ev="ev") + """
, c as (select horizon, mean, lag(horizon) over (order by horizon) as ph, lag(mean) over (order by horizon) as pm, max(mean) over () / 2 as target from own)
select round(arg_min(case when ph is null then 0.0 else ph + (target - pm) / (mean - pm) * (horizon - ph) end, horizon), 6) as half_life from c where target > 0 and mean >= target""",
)
def half_life(spark: SparkSession, d: str) -> DataFrame:
    _, car, events, _, _ = _study(spark, d)
    curve = studies.response(events.withColumn("sign", -F.col("sign")), car)
    return studies.half_life(curve).withColumn("half_life", F.round("half_life", 6))


@query("lead_lag", _CAR + _SHOCK + " select k::int as days, round(avg(sign * car), 6) as mean, count(*) as n from sh, (values (-5), (-1), (0), (1), (5)) v(k) join car on car.date = sh.date + v.k::int and car.ticker = sh.ticker and car.horizon = 3 group by 1")
def lead_lag(spark: SparkSession, d: str) -> DataFrame:
    _, car, events, _, _ = _study(spark, d)
    return studies.lead_lag(events, car, (-5, -1, 0, 1, 5), 3).withColumn("mean", F.round("mean", 6))


@query("synthetic_close", f"with {PRICES}, {_GRID} select date, ticker, round(c, 1) as close, round(ln(c), 4) as log_close from (select date, ticker, product(1 + coalesce(ret, 0)) over (partition by ticker order by date rows unbounded preceding) as c from pg)")
def synthetic_close(spark: SparkSession, d: str) -> DataFrame:
    """The close compounded over the whole calendar from the daily returns, and its logarithm; the order of the products moves the last digits only."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return panels.price_grid(prices(spark, d)).select(
        "date", "ticker", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w).alias("c")
    ).select("date", "ticker", F.round("c", 1).alias("close"), F.round(F.ln("c"), 4).alias("log_close"))
