"""Streams of edges and of late events into tables, with the batch operators' semantics.

A query's checkpoint is its only writer; a batch is written to a folder named after its
id, so that a batch that is run again replaces itself. Back-pressure is the source's
files per trigger; a failed batch ends the query, and its exception reaches the caller.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoweave.functions.calendar import utc_day
from chronoweave.operators import late_events
from chronoweave.schema import EDGE_SCHEMA


def edge_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EDGE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(edges: DataFrame, table: str, checkpoint: str, max_vertices: int, once: bool = True) -> StreamingQuery:
    """Append checked edges to the table, a folder per batch."""
    from chronoweave.operators.graph import checked

    def write(batch: DataFrame, batch_id: int) -> None:
        checked(batch, max_vertices).sortWithinPartitions("src", "ts", "seq").write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    w = edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def progress(query: StreamingQuery) -> dict[str, float]:
    """Rows pushed and consumed and batches so far."""
    seen = query.recentProgress
    return {"rows": sum(p["numInputRows"] for p in seen), "batches": len(seen), "rows_per_second": max([0.0, *(p.get("processedRowsPerSecond") or 0.0 for p in seen)])}


def sliding_degrees(edges: DataFrame, table: str, checkpoint: str, window: str, late: str) -> StreamingQuery:
    """(window_start, src, degree): edges per source and event-time window; edges later than `late` behind the watermark are left out."""
    at = edges.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    counts = at.groupBy(F.window("at", window).alias("w"), "src").agg(F.count(F.lit(1)).alias("degree")).select(F.col("w.start").alias("window_start"), "src", "degree")
    return counts.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_window(edges: DataFrame, table: str, checkpoint: str, seconds: int) -> StreamingQuery:
    """The table `batch=<n>` after each batch holds the edges of the last `seconds` before the greatest time seen; older ones expire."""
    spark = edges.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.schema(EDGE_SCHEMA).parquet(f"{table}/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], EDGE_SCHEMA)
        every = before.unionByName(batch.select(before.columns))
        now = every.select(F.max("ts")).scalar()
        every.where(F.col("ts") >= now - seconds).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return edges.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Days by which deliveries may come in another order than their arrivals.
DISORDER_DAYS = 7


def late_counters(slices: DataFrame, table: str, checkpoint: str, cut_off: int = late_events.CUT_OFF_DAYS, disorder: int = DISORDER_DAYS) -> StreamingQuery:
    """Counters of late events, merged batch by batch; slices: globaleventid, sqldate, dateadded, goldsteinscale.

    `open/batch=n` holds the merged states of the days that can still change, `closed/batch=n` the sums of the days
    that batch n closed, `mark/batch=n` the latest day of arrival. A day closes when an arrival more than cut_off +
    disorder days behind it was seen; what is delivered for it afterwards is left out, so that the state holds a
    bounded number of days. A batch that comes again replaces itself; one that brings rows a second time changes nothing.
    """
    spark = slices.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = late_events.delivered(batch, "globaleventid", "sqldate", "dateadded", "goldsteinscale", cut_off)
        mark = new.agg(F.max(utc_day(F.col("version"))).alias("mark"))
        if batch_id:
            before = spark.read.parquet(f"{table}/mark/batch={batch_id - 1}")
            last = before.select("mark").scalar()
            mark = mark.unionByName(before).agg(F.max("mark").alias("mark"))
            fresh = new.where(~closed_by(last)).unionByName(spark.read.parquet(f"{table}/open/batch={batch_id - 1}"))
        else:
            fresh = new
        mark.write.mode("overwrite").parquet(f"{table}/mark/batch={batch_id}")
        states = late_events.merge_counters(fresh).persist(StorageLevel.DISK_ONLY)
        gone = closed_by(F.lit(spark.read.parquet(f"{table}/mark/batch={batch_id}").first().mark))
        late_events.counters(states.where(gone)).write.mode("overwrite").parquet(f"{table}/closed/batch={batch_id}")
        states.where(~gone).write.mode("overwrite").parquet(f"{table}/open/batch={batch_id}")
        states.unpersist()

    def closed_by(mark: Column) -> Column:
        # a state without its day expires by its arrival
        day = F.coalesce("period", utc_day(F.col("version")))
        return F.coalesce(day + cut_off + disorder < mark, F.lit(False))

    return slices.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters_of(spark: SparkSession, table: str, batch_id: int) -> DataFrame:
    """The daily figures after a batch: the sums of the closed days and of the open ones."""
    closed = spark.read.parquet(*[f"{table}/closed/batch={i}" for i in range(batch_id + 1)])
    return late_events.daily(closed.unionByName(late_events.counters(spark.read.parquet(f"{table}/open/batch={batch_id}"))))
