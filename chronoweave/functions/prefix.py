"""Running sums and ranks that no task makes alone for a whole hot key or a whole table.

Runs of keys that fit in a task are summed by a window. The rows of hot keys, and of a
table without keys, are range-partitioned by keys and order (bounds sampled from the
data, parts by its size) and sorted; every part is summed in one pass, in Arrow batches.
What goes on from part to part stands first or last in each: only these keys' totals, at
most two a part, are summed over parts and added to the rows by a broadcast of that
bound. Both ways give the same sums. The result is written to the shared folder, so that
all that follows sees the same parts and nothing is summed twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from chronoweave.session import cut, stored

#: Bytes of the input files for which there is a part; rows from which a key is hot.
PART_BYTES, HOT_ROWS = 256 << 20, 5_000_000


def _leaves(df: DataFrame) -> tuple[int, int]:
    """(bytes of the files and local rows that df reads, most parts of what was written before, whose bytes aren't known)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = written = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            written = max(written, leaf.rdd().getNumPartitions())
        else:
            size += int(str(leaf.stats().sizeInBytes()))
    return size, written


def size_of(df: DataFrame) -> int:
    """Bytes of the files and local rows that df reads."""
    return _leaves(df)[0]


def parts_of(df: DataFrame) -> int:
    """Parts by the size of what df reads, at least the session's number of shuffle partitions."""
    size, written = _leaves(df)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), written, -(-size // PART_BYTES))


def _hot(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The keys of more than HOT_ROWS rows, at most a row for each HOT_ROWS; None if all that df reads is a task's share."""
    size, written = _leaves(df)
    if size <= PART_BYTES and not written:
        return None
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select(*keys).collect()
    return df.sparkSession.createDataFrame(hot, df.select(*keys).schema) if hot else None


def _summed(keys: Sequence[str], values: Sequence[str]):
    """Adds, to batches of a part in order, the running sums within the part and the row's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, place = None, np.zeros(len(values), np.int64), 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            columns = [b.column(b.schema.get_field_index(k)) for k in keys]
            begins = np.zeros(n, bool)
            for c in columns:
                begins[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            here = tuple(c[0].as_py() for c in columns)
            goes_on = last is not None and here == last
            group = np.cumsum(begins)
            first = np.concatenate([[0], np.flatnonzero(begins)])
            out = []
            for j, v in enumerate(values):
                x = b.column(b.schema.get_field_index(v)).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(x)
                sums = total - (total[first] - x[first])[group]
                if goes_on:
                    sums[group == 0] += carry[j]
                carry[j] = sums[-1]
                out.append(pa.array(sums))
            last = tuple(c[n - 1].as_py() for c in columns)
            kept = [i for i, f in enumerate(b.schema) if f.name not in values]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in kept), *out, pa.array(np.arange(place, place + n))], names=[*(b.schema.names[i] for i in kept), *(f"_w_{v}" for v in values), "_place"]
            )
            place += n

    return run


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], kept: Sequence[str] | None = None) -> DataFrame:
    """df with, per name, the running sum of its whole, not negative value over the keys in the order.

    Of a table without keys only the columns `kept` are written, if given, in compressed columns.
    Rows with a null key have no run and are left out; equal places in the order may be summed in any order.
    """
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys)) if keys else df
    given = known.withColumns({n: F.coalesce(v.cast("bigint"), F.lit(0)) for n, v in values.items()})
    shown = [c for c in df.columns if c not in values]
    if not keys:
        return _by_range(given, keys, order, values, kept).select(*(shown if kept is None else kept), *values)
    hot = _hot(given, keys)
    if hot is None:
        return cut(_by_window(given, keys, order, values).select(*shown, *values))
    few = F.broadcast(hot)
    cold = _by_window(given.join(few, [*keys], "left_anti"), keys, order, values).select(*shown, *values)
    return cut(cold).unionByName(_by_range(given.join(few, [*keys], "left_semi"), keys, order, values).select(*shown, *values))


def _by_window(given: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return given.withColumns({n: F.sum(n).over(w) for n in values})


def _by_range(given: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], kept: Sequence[str] | None = None) -> DataFrame:
    sort = [*keys, *order]
    ranged = given.repartitionByRange(parts_of(given), *sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id())
    if kept is not None:
        ranged = ranged.select(*keys, *kept, *values, "_part")
    schema = StructType([f for f in ranged.schema.fields if f.name not in values])
    for n in values:
        schema = schema.add(f"_w_{n}", LongType())
    schema = schema.add("_place", LongType())
    done = (cut if kept is None else stored)(ranged.mapInArrow(_summed(keys, list(values)), schema))
    # the first and the last key of each part, and what each part has of them
    if keys:
        key = F.struct(*keys)
        ends = done.groupBy("_part").agg(F.min_by(key, "_place").alias("a"), F.max_by(key, "_place").alias("b"))
        ends = ends.select("_part", F.explode(F.array_distinct(F.array("a", "b"))).alias("k")).select("_part", *[F.col(f"k.{k}").alias(k) for k in keys])
        at_ends = done.join(F.broadcast(ends), ["_part", *keys], "left_semi")
    else:
        at_ends = done
    totals = at_ends.groupBy("_part", *keys).agg(*[F.max(f"_w_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("_part", *keys, *[F.sum(f"_t_{n}").over(before).alias(f"_a_{n}") for n in values])
    ahead = ahead.where(" or ".join(f"_a_{n} > 0" for n in values))
    joined = done.join(F.broadcast(ahead), ["_part", *keys], "left")  # at most two rows a part
    sums = {n: F.coalesce(f"_a_{n}", F.lit(0)) + F.col(f"_w_{n}") for n in values}
    return joined.withColumns(sums)


def ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with the 1-based rank of each row among its keys."""
    return running(df, keys, order, {name: F.lit(1)})
