"""Per-day aggregates by event time that late arrivals correct up to a cut-off.

Conflict-free counters, keyed by period, source and version: a source is an event, its
version the instant of an arrival, and every delivered row is a state of its source that
counts one. States merge per source by precedence of version (the earliest arrival says
when the event came, the latest one within the cut-off says its value), and the sources
of a period are then summed. The merge takes states in any order, in any split into
deliveries and any number of times, and loses none, as two sources never share a state.

Defined cases: rows without event id are ignored; an event without a valid day or
without any valid arrival takes part in nothing; a null value counts as an event but
not in the mean; an event whose rows name several days belongs to the first; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.calendar import arrival_seconds, date_of, day_number, utc_day, ymd_to_date

CUT_OFF_DAYS = 7


def delivered(rows: DataFrame, key: str, day: str, stamp: str, value: str, cut_off: int = CUT_OFF_DAYS) -> DataFrame:
    """A delivery as states (source, period, version, revision), one per row; revision is (arrival, value) of an arrival within the cut-off."""
    at = rows.select(
        F.col(key).alias("source"),
        day_number(ymd_to_date(F.col(day))).cast("bigint").alias("period"),
        arrival_seconds(F.col(stamp)).alias("version"),
        F.col(value).cast("double").alias("_v"),
    ).where("source is not null")
    in_time = utc_day(F.col("version")) - F.col("period") <= cut_off
    return at.select("source", "period", "version", F.when(in_time, F.struct(F.col("version").alias("at"), F.col("_v").alias("value"))).alias("revision"))


def merge_counters(*states: DataFrame) -> DataFrame:
    """Merge any number of tables of states to one state per source; partial merges happen before the shuffle."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy("source").agg(F.min("period").alias("period"), F.min("version").alias("version"), F.max("revision").alias("revision"))


def complete(states: DataFrame) -> DataFrame:
    return states.where("period is not null and version is not null")


def counters(states: DataFrame) -> DataFrame:
    """Merged states -> (event_day, source_day, events, values, total): the sum of the sources per period and day of arrival."""
    value = F.col("revision.value")
    return (
        complete(states)
        .groupBy(F.col("period").alias("event_day"), utc_day(F.col("version")).alias("source_day"))
        .agg(F.count(F.lit(1)).alias("events"), F.count(value).alias("values"), F.sum(value.cast("decimal(38,10)")).alias("total"))
    )


def daily(sums: DataFrame, cut_off: int = CUT_OFF_DAYS) -> DataFrame:
    """Counters -> per event day: counts on time, corrected and dropped, and the corrected count and mean."""
    late = F.col("source_day") - F.col("event_day")
    kept = late <= cut_off
    return (
        sums.groupBy("event_day")
        .agg(
            F.sum(F.when(late <= 0, F.col("events")).otherwise(0)).alias("on_time"),
            F.sum(F.when((late > 0) & kept, F.col("events")).otherwise(0)).alias("corrected"),
            F.sum(F.when(~kept, F.col("events")).otherwise(0)).alias("dropped"),
            F.sum(F.when(kept, F.col("events")).otherwise(0)).alias("n_events"),
            F.sum(F.when(kept, F.col("values")).otherwise(0)).alias("n_values"),
            F.sum(F.when(kept, F.col("total"))).alias("total"),
        )
        .select(
            date_of(F.col("event_day")).alias("event_date"), "on_time", "corrected", "dropped", "n_events",
            F.try_divide(F.col("total").cast("double"), F.col("n_values")).alias("mean_value"),
        )
    )


def revisions(sums: DataFrame, cut_off: int = CUT_OFF_DAYS) -> DataFrame:
    """Every published version of a day: its count and mean as of each arrival day that changed it within the cut-off."""
    w = Window.partitionBy("event_day").orderBy("late").rowsBetween(Window.unboundedPreceding, 0)
    late = F.greatest(F.col("source_day") - F.col("event_day"), F.lit(0))
    per = (
        sums.withColumn("late", late).where(F.col("late") <= cut_off)
        .groupBy("event_day", "late").agg(F.sum("events").alias("e"), F.sum("values").alias("v"), F.sum("total").alias("t"))
    )
    return per.select(
        date_of(F.col("event_day")).alias("event_date"), F.col("late").alias("days_late"),
        F.sum("e").over(w).alias("n_events"),
        F.try_divide(F.sum("t").over(w).cast("double"), F.sum("v").over(w)).alias("mean_value"),
    )


def outcomes(states: DataFrame, cut_off: int = CUT_OFF_DAYS) -> DataFrame:
    """Merged states -> (event_id, outcome) of the events that came after their day: `corrected` within the cut-off, else `dropped`."""
    late = utc_day(F.col("version")) - F.col("period")
    return complete(states).where(late > 0).select(F.col("source").alias("event_id"), F.when(late <= cut_off, "corrected").otherwise("dropped").alias("outcome"))
