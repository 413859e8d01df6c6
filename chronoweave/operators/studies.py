"""Event studies: abnormal returns, cumulative responses clustered by date, differences and half-lives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import prefix
from chronoweave.functions.portable import hash_int
from chronoweave.session import checked_broadcast


def abnormal(grid: DataFrame) -> DataFrame:
    """(date, ticker, abn): the return less the day's mean; grid has every trading day of every ticker."""
    return grid.withColumn("abn", F.col("ret") - F.avg("ret").over(Window.partitionBy("date"))).select("date", "ticker", "abn")


def forward(abn: DataFrame, horizons: Sequence[int], zero: bool = False) -> DataFrame:
    """(date, ticker, horizon, car): the sum over the next h trading days; none where the calendar ends before or all days are missing.

    zero: missing days count 0.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    v = F.coalesce("abn", F.lit(0.0)) if zero else F.col("abn")
    summed = abn.withColumns({
        f"_{h}": F.when(F.count(F.lit(1)).over(w.rowsBetween(1, h)) == h, F.sum(v).over(w.rowsBetween(1, h))) for h in horizons
    })
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_{h}").alias("car")) for h in horizons])
    return summed.select("date", "ticker", F.inline(rows)).where("car is not null")


def response(events: DataFrame, car: DataFrame) -> DataFrame:
    """(horizon, mean, t, n, se, clusters) of signed responses, averaged within event dates first; events: (date, ticker, sign)."""
    j = events.join(car, ["date", "ticker"]).withColumn("v", F.col("sign") * F.col("car"))
    per = j.groupBy("horizon", "date").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("k"))
    a = per.groupBy("horizon").agg(F.avg("v").alias("mean"), F.sum("k").alias("n"), F.stddev_samp("v").alias("sd"), F.count(F.lit(1)).alias("clusters"))
    se = F.when(F.col("sd") > 0, F.col("sd") / F.sqrt("clusters"))
    return a.select("horizon", "mean", (F.col("mean") / se).alias("t"), "n", se.alias("se"), "clusters")


def difference(treated: DataFrame, control: DataFrame) -> DataFrame:
    """(horizon, mean, t, n, se, clusters): treated less control, errors in quadrature, the lesser counts."""
    a, b = treated.alias("a"), control.alias("b")
    se = F.sqrt(F.pow(F.coalesce("a.se", F.lit(0.0)), 2) + F.pow(F.coalesce("b.se", F.lit(0.0)), 2))
    delta = F.col("a.mean") - F.col("b.mean")
    return a.join(b, "horizon").select(
        "horizon", delta.alias("mean"), (delta / F.when(se > 0, se)).alias("t"), F.least("a.n", "b.n").alias("n"), se.alias("se"), F.least("a.clusters", "b.clusters").alias("clusters")
    )


def half_life(curve: DataFrame) -> DataFrame:
    """(half_life,): where the mean first reaches half of its peak, between horizons in proportion; 0 at the first, null without a positive peak."""
    w = Window.partitionBy(F.lit(0)).orderBy("horizon")  # one row per horizon
    top = Window.partitionBy(F.lit(0))
    c = curve.where("mean is not null").select(
        "horizon", "mean", F.lag("horizon").over(w).alias("ph"), F.lag("mean").over(w).alias("pm"), (F.max("mean").over(top) / 2).alias("target")
    )
    at = F.when(F.col("ph").isNull(), 0.0).otherwise(F.col("ph") + F.coalesce(F.try_divide(F.col("target") - F.col("pm"), F.col("mean") - F.col("pm")), F.lit(1.0)) * (F.col("horizon") - F.col("ph")))
    hit = c.where("target > 0 and mean >= target").agg(F.min_by(at, "horizon").alias("half_life"))
    return hit


def neighbour_events(events: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(date, ticker, sign): each event at its neighbours, without those that have an event on the day; neighbours: (ticker, neighbour)."""
    far = events.join(neighbours, "ticker").select("date", F.col("neighbour").alias("ticker"), "sign", F.col("ticker").alias("of"))
    return far.join(events.select("date", "ticker").distinct(), ["date", "ticker"], "left_anti")


def placebo(events: DataFrame, neighbours: DataFrame, names: DataFrame, near: DataFrame, seed: int = 0) -> DataFrame:
    """As many tickers per event as it has neighbours in `near`, drawn by hash, among those that are neither neighbours nor the event's own and have no event on the day.

    Each event draws 8 places per wanted ticker and 16 more in the list of names and keeps the first that serve, so
    that an event meets its draws only and never all names; one whose names nearly all are taken may get fewer.
    """
    listed = prefix.ranks(names.select("ticker").distinct(), [], ["ticker"], "place").withColumn("place", F.col("place") - 1)
    n = listed.count()
    count = near.groupBy("date", "of").agg(F.count(F.lit(1)).alias("want"), F.first("sign").alias("sign"))
    draws = count.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), 8 * F.col("want") + 15)))
    drawn = draws.withColumn("place", F.pmod(hash_int(F.lit(seed), F.col("date"), F.col("of"), F.col("slot")), F.lit(max(n, 1)))).join(checked_broadcast(listed), "place")
    free = drawn.where("ticker <> of").join(neighbours.select(F.col("ticker").alias("of"), F.col("neighbour").alias("ticker")), ["of", "ticker"], "left_anti")
    free = free.join(events.select("date", "ticker").distinct(), ["date", "ticker"], "left_anti")
    once = free.groupBy("date", "of", "ticker").agg(F.min("slot").alias("slot"), F.first("want").alias("want"), F.first("sign").alias("sign"))
    w = Window.partitionBy("date", "of").orderBy("slot")
    return once.withColumn("r", F.row_number().over(w)).where("r <= want").select("date", "ticker", "sign", "of")


def shocks(abn: DataFrame, quantile: float) -> DataFrame:
    """(date, ticker, sign): days whose abnormal return is at least as large as the quantile of sizes."""
    bound = abn.select(F.expr(f"percentile(abs(abn), {quantile})")).scalar()
    return abn.where(F.abs("abn") >= bound).select("date", "ticker", F.signum("abn").cast("int").alias("sign"))


def lead_lag(events: DataFrame, car: DataFrame, offsets: Sequence[int], horizon: int) -> DataFrame:
    """(days, mean, n): the response when events are moved by so many calendar days; days off the calendar are left out."""
    moved = events.withColumn("days", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("date", F.date_add("date", F.col("days")))
    j = moved.join(car.where(F.col("horizon") == horizon), ["date", "ticker"])
    return j.groupBy("days").agg(F.avg(F.col("sign") * F.col("car")).alias("mean"), F.count(F.lit(1)).alias("n"))
