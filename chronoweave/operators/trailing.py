"""Rolling totals over trailing periods, days without activity included.

Rows become daily totals per entity first; each entity-calendar date is then
range-joined to the daily totals within its trailing bounds. Coarse date buckets as
wide as the longest period restrict the candidates: a total can only reach dates of its
own bucket and of the next, so it is replicated twice and the join is an equi-join on
(entity, bucket) with a range residual.

Defined cases: rows without entity or instant don't count; a row key counts once; a
missing weight counts as the given default; a null value adds nothing; entities
without rows and empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.calendar import utc_day


def daily_totals(rows: DataFrame, key: str, entity: str, seconds: str, values: Mapping[str, float | None]) -> DataFrame:
    """(entity, day, one total per value). values: column -> what null counts as (None: nothing)."""
    names = list(values)
    each = rows.where(F.col(entity).isNotNull() & F.col(seconds).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.col(entity).alias("entity"), utc_day(F.col(seconds)).alias("day"),
        *[(F.coalesce(c, F.lit(float(d))) if d is not None else c).alias(f"v{i}") for i, (n, d) in enumerate(values.items()) for c in [F.col(n).cast("double")]],
    )
    vs = [f"v{i}" for i in range(len(names))]
    once = each.groupBy("k").agg(F.min(F.struct("entity", "day", *vs)).alias("s")).select("s.*")
    return once.groupBy("entity", "day").agg(*[F.sum(v).alias(n) for v, n in zip(vs, names)])


def calendar(totals: DataFrame) -> DataFrame:
    """(entity, day, first_day): every day from the entity's first to its last."""
    span = totals.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return span.select("entity", "first_day", F.explode(F.sequence("first_day", "last_day")).alias("day"))


def trailing(totals: DataFrame, values: Sequence[str], periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Per entity and calendar day: sum_<value>_<p> and avg_<value>_<p> (per day) over the p days that end on it."""
    width = max(periods)
    bucket = F.floor(F.col("day") / width)
    dates = calendar(totals).withColumn("bucket", bucket)
    near = totals.select(
        "entity", F.col("day").alias("total_day"), *values, F.explode(F.array(bucket, bucket + 1)).alias("bucket")
    )
    inside = (near["total_day"] <= dates["day"]) & (near["total_day"] > dates["day"] - width)
    pairs = dates.join(near, (dates["entity"] == near["entity"]) & (dates["bucket"] == near["bucket"]) & inside, "left").select(
        dates["entity"], dates["first_day"], dates["day"], (dates["day"] - near["total_day"]).alias("age"), *values
    )
    sums = pairs.groupBy("entity", "first_day", "day").agg(
        *[F.coalesce(F.sum(F.when(F.col("age") < p, F.col(v))), F.lit(0.0)).alias(f"sum_{v}_{p}") for v in values for p in periods]
    )
    return sums.withColumns({f"avg_{v}_{p}": F.col(f"sum_{v}_{p}") / p for v in values for p in periods})
