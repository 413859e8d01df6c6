"""Signal panels: trailing sums per name and day, screens, weights and the daily book of a cross-section."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.session import checked_broadcast

TRADING_DAYS = 252


@dataclass(frozen=True)
class BacktestConfig:
    """Defaults of the daily cross-sectional book."""

    direction: float = -1.0
    lag_days: int = 1
    cost_bps: float = 5.0
    max_weight: float = 0.15
    gross: float = 1.0
    min_names: int = 5
    window: int = 60
    min_periods: int = 10
    clip: float = 3.0


def daily_by_actor(events: DataFrame, value: Column) -> DataFrame:
    """(date, country, value): each event counts for both of its actors."""
    e = events.select("date", "src", "dst", value.alias("v"))
    both = e.select("date", F.col("src").alias("country"), "v").unionByName(e.select("date", F.col("dst").alias("country"), "v"))
    return both.groupBy("date", "country").agg(F.sum("v").alias("value"))


def on_calendar(daily: DataFrame, key: str = "country") -> DataFrame:
    """(date, key, value) of every day between the first and last of all, 0 where nothing happened."""
    ends = daily.agg(F.min("date").alias("a"), F.max("date").alias("b")).withColumn("k", F.lit(1))
    names = daily.select(key).distinct().withColumn("k", F.lit(1))
    grid = names.join(F.broadcast(ends), "k").select(key, F.explode(F.sequence("a", "b")).alias("date"))  # ends is one row
    return grid.join(daily, ["date", key], "left").fillna(0, ["value"])


def trailing_signal(daily: DataFrame, days: int, key: str = "country") -> DataFrame:
    """(date, country, signal): the sum over the `days` days before each day; the first day has none."""
    w = Window.partitionBy(key).orderBy("date").rowsBetween(-days, -1)
    return on_calendar(daily, key).withColumn("signal", F.sum("value").over(w)).where("signal is not null").select("date", key, "signal")


def conflict_pressure(quad: Column, goldstein: Column, mentions: Column) -> Column:
    """Mentions times the depth below 0, of conflicts; a missing mention counts 1, a missing depth 0."""
    return F.when(quad.isin(3, 4), F.coalesce(mentions, F.lit(1.0)) * F.abs(F.least(F.coalesce(goldstein, F.lit(0.0)), F.lit(0.0)))).otherwise(0.0)


def business_days(df: DataFrame, date: str = "date") -> DataFrame:
    return df.where(~F.dayofweek(date).isin(1, 7))


def price_grid(prices: DataFrame) -> DataFrame:
    """(date, ticker, close, ret): every trading day of every ticker, without prices where there was no trade; ret needs both days."""
    days = prices.select("date").distinct().groupBy().agg(F.array_sort(F.collect_list("date")).alias("days")).withColumn("k", F.lit(1))
    names = prices.select("ticker").distinct().withColumn("k", F.lit(1))
    grid = names.join(F.broadcast(days), "k").select("ticker", F.explode("days").alias("date"))  # the calendar is one row of trading days
    w = Window.partitionBy("ticker").orderBy("date")
    full = grid.join(prices.select("date", "ticker", "close"), ["date", "ticker"], "left")
    return full.withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1)


def reversal_signal(prices: DataFrame, days: int) -> DataFrame:
    """(date, country, signal): the fall over the last `days` trading days."""
    w = Window.partitionBy("ticker").orderBy("date")
    g = price_grid(prices).withColumn("signal", -(F.try_divide("close", F.lag("close", days).over(w)) - 1))
    return g.where("signal is not null").select("date", F.col("ticker").alias("country"), "signal")


def liquid(prices: DataFrame, least: float) -> DataFrame:
    """(ticker, median_value, kept): the screen on the median of price times volume; tickers without a positive median stay."""
    m = prices.groupBy("ticker").agg(F.median(F.col("close") * F.col("volume")).alias("median_value"))
    return m.withColumn("kept", F.coalesce((F.col("median_value") >= least) | (F.col("median_value") <= 0), F.lit(True)))


def tradable(prices: DataFrame, low: float, high: float, jump: float) -> DataFrame:
    """(ticker, volatility, max_move, kept): annual volatility within bounds and no daily move above `jump`; unknown stays."""
    s = price_grid(prices).groupBy("ticker").agg((F.stddev_samp("ret") * (TRADING_DAYS**0.5)).alias("volatility"), F.max(F.abs("ret")).alias("max_move"))
    return s.withColumn("kept", F.coalesce(F.col("volatility").between(low, high) & (F.col("max_move") <= jump), F.lit(True)))


def instruments(signals: DataFrame, universe: DataFrame) -> DataFrame:
    """(date, ticker, signal): countries mapped to instruments, the mean where several share one; universe: (country, ticker)."""
    return signals.join(checked_broadcast(universe), "country").groupBy("date", "ticker").agg(F.avg("signal").alias("signal"))


def weights(signals: DataFrame, prices: DataFrame, c: BacktestConfig) -> DataFrame:
    """(date, ticker, ret, weight): trailing-demeaned, standardised across names, clipped, neutral, scaled and capped weights."""
    names = signals.select("ticker").distinct()
    g = price_grid(prices.join(checked_broadcast(names), "ticker", "left_semi")).join(signals, ["date", "ticker"], "left")
    g = g.withColumn("s", F.when(F.col("close").isNotNull(), F.col("signal")))
    past = Window.partitionBy("ticker").orderBy("date").rowsBetween(-c.window, -1)
    g = g.withColumn("s", F.when(F.count("s").over(past) >= c.min_periods, F.col("s") - F.avg("s").over(past)))
    day = Window.partitionBy("date")
    z = (F.col("s") - F.avg("s").over(day)) / F.nullif(F.stddev_pop("s").over(day), F.lit(0.0))
    # least and greatest pass over nulls, so that an unknown z must stay out
    g = g.withColumn("z", z).withColumn("w", F.when(F.col("z").isNotNull(), F.greatest(F.least(c.direction * F.col("z"), F.lit(c.clip)), F.lit(-c.clip))))
    g = g.withColumn("w", F.col("w") - F.avg("w").over(day))
    g = g.withColumn("w", F.try_divide("w", F.nullif(F.sum(F.abs("w")).over(day), F.lit(0.0))) * c.gross)
    g = g.withColumn("w", F.col("w") * F.least(F.try_divide(F.lit(c.max_weight), F.nullif(F.max(F.abs("w")).over(day), F.lit(0.0))), F.lit(1.0)))
    return g.withColumn("weight", F.when(F.count("s").over(day) >= c.min_names, F.col("w"))).select("date", "ticker", "ret", "weight")


def daily_book(w: DataFrame, c: BacktestConfig) -> DataFrame:
    """(date, gross_return, cost, net_return, turnover, names): weights are held from lag_days after their day on."""
    by = Window.partitionBy("ticker").orderBy("date")
    held = w.withColumn("held", F.lag("weight", c.lag_days + 1).over(by))
    moved = held.withColumn("move", F.abs(F.coalesce("held", F.lit(0.0)) - F.coalesce(F.lag("held").over(by), F.lit(0.0))))
    # the first day of the calendar has no day before it
    moved = moved.withColumn("move", F.when(F.row_number().over(by) > 1, F.col("move")).otherwise(0.0))
    d = moved.groupBy("date").agg(F.sum(F.col("held") * F.col("ret")).alias("gross_return"), F.sum("move").alias("turnover"), F.count("held").alias("names"))
    return d.where("names > 0").withColumn("cost", F.col("turnover") * c.cost_bps / 10_000.0).withColumn("net_return", F.col("gross_return") - F.col("cost"))


def summary(daily: DataFrame) -> DataFrame:
    """One row of figures of a book; the peak of the drawdown doesn't count the start."""
    run = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    d = daily.where("net_return is not null").withColumn("equity", F.product(1 + F.col("net_return")).over(run))
    d = d.withColumn("drawdown", F.col("equity") / F.max("equity").over(run) - 1)
    a = d.agg(
        F.count(F.lit(1)).alias("days"), (F.max_by("equity", "date") - 1).alias("total_return"), F.stddev_samp("net_return").alias("sd"), F.avg("net_return").alias("m"),
        F.min("drawdown").alias("max_drawdown"), F.avg((F.col("net_return") > 0).cast("int")).alias("hit_rate"), F.avg("turnover").alias("avg_turnover"), F.sum("cost").alias("total_cost"),
    )
    sd = F.when(F.col("sd") > 0, F.col("sd"))
    return a.select(
        "days", "total_return",
        F.when(F.col("total_return") <= -1, -1.0).otherwise(F.pow(1 + F.greatest("total_return", F.lit(-1.0)), F.lit(float(TRADING_DAYS)) / F.col("days")) - 1).alias("annual_return"),
        (F.col("sd") * TRADING_DAYS**0.5).alias("annual_volatility"), (F.col("m") / sd * TRADING_DAYS**0.5).alias("sharpe"), (F.col("m") / sd * F.sqrt("days")).alias("t_stat"),
        "max_drawdown", "hit_rate", "avg_turnover", "total_cost",
    )


def folds(low: int, high: int, n: int, first_train: float, expanding: bool = True) -> list[tuple[int, int, int, int]]:
    """(train_start, train_end, test_start, test_end) of walk-forward folds over [low, high]; the last ends just behind high."""
    if n < 1 or not 0 < first_train < 1:
        raise ValueError("at least one fold and a training share between 0 and 1 are needed")
    span = high - low
    start = low + int(span * first_train)
    step = (high - start) / n
    out = []
    for i in range(n):
        a, b = int(start + i * step), int(start + (i + 1) * step)
        out.append((low if expanding else max(low, int(a - span * first_train)), a, a, high + 1 if i == n - 1 else b))
    return out
