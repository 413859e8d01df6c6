"""Names to dense ids in order of first appearance, and the vertices of a resolved graph."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import prefix

#: Texts that stand for no name.
NO_NAMES = ("", "NAN", "NONE")


def normalize_name(name: Column) -> Column:
    """Upper case, white space collapsed; null for what stands for no name."""
    clean = F.upper(F.trim(F.regexp_replace(name, r"[ \t\r\n\x0B\f]+", " ")))
    return F.when(~clean.isin(*NO_NAMES), clean)


def dense_ids(names: DataFrame, name: str = "name", position: str = "position") -> DataFrame:
    """(name, id): 0-based ids by the least position of each name; positions are whole numbers that differ between names."""
    first = names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(position).alias("position"))
    ranked = prefix.ranks(first, [], ["position"], "r")
    return ranked.select("name", (F.col("r") - 1).alias("id"))


def edge_names(rows: DataFrame, position: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """(name, position): all sources in order of the rows, then all targets; positions are even for sources' half."""
    top = rows.agg(F.max(position)).first()[0] or 0
    a = rows.select(F.col(src).alias("name"), F.col(position).alias("position"))
    return a.unionByName(rows.select(F.col(dst).alias("name"), (F.col(position) + top + 1).alias("position")))


def with_ids(rows: DataFrame, ids: DataFrame, column: str, out: str, cap: int | None = None) -> DataFrame:
    """rows with the id of a name column; -1 for no name, for names not in ids, and for ids from the cap on."""
    known = rows.join(ids.withColumnsRenamed({"name": column, "id": out}), column, "left")
    got = F.coalesce(out, F.lit(-1))
    return known.withColumn(out, got if cap is None else F.when(got >= cap, -1).otherwise(got))


def overflow(rows: DataFrame, ids: DataFrame, columns: Sequence[str], cap: int) -> DataFrame:
    """One row: overflow, how often a name in these columns gets -1 for the cap and not for being blank."""
    every = reduce(DataFrame.unionByName, [rows.select(F.col(c).alias("name")) for c in columns])
    return every.join(ids.where(F.col("id") >= cap), "name").agg(F.count(F.lit(1)).alias("overflow"))


def min_degree(edges: DataFrame, least: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """The edges both of whose ends have at least so many edges (both ends counted, a self-loop twice); one pass."""
    ends = edges.select(F.col(src).alias("v")).unionByName(edges.select(F.col(dst).alias("v")))
    busy = ends.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("v")
    return edges.join(busy, edges[src] == busy["v"], "left_semi").join(busy, edges[dst] == busy["v"], "left_semi")
