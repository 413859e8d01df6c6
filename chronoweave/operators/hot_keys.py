"""Per-key results where a few keys hold most rows.

Eager aggregation through the join: each input is first reduced to one compact state
per join key (and result key), the states are joined, counts are multiplied and sums
scaled by the other side's count, and the products are rolled up to the result key. No
task ever holds the rows of one key: map-side partial aggregation leaves at most one
state per key and task. No row is dropped, capped or sampled.

Defined cases: a null result key gets no row but its rows stay in the totals; null
measures count as rows and add nothing to sums; a join key without a match keeps its
rows, with no block side; repeated rows are counted in `n_rows` and, where a row key is
given, once in the other figures; empty inputs give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eager_join_totals(
    fact: DataFrame,
    dim: DataFrame,
    join_key: str,
    result_key: Column,
    row_key: Sequence[str],
    sums: Sequence[str] = (),
    dim_count: str = "n_dim",
) -> DataFrame:
    """Per result key: n_rows (as delivered), n_items (distinct row keys), the sums over items, and both counts after the join.

    dim is joined on join_key; n_joined is the number of pairs of item and dim row, and
    joined_<sum> the sum over those pairs.
    """
    measures = [f"m{i}" for i, _ in enumerate(sums)]
    base = fact.select(
        F.col(join_key).alias("jk"),
        result_key.alias("rk"),
        *[F.col(c).alias(f"r{i}") for i, c in enumerate(row_key)],
        *[F.col(c).alias(m) for c, m in zip(sums, measures)],
    )
    row_cols = [f"r{i}" for i, _ in enumerate(row_key)]
    items = base.groupBy("jk", "rk", *row_cols).agg(F.count(F.lit(1)).alias("n"), *[F.max(m).alias(m) for m in measures])
    left = items.groupBy("jk", "rk").agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_items"),
        *[F.sum(m).alias(m) for m in measures],
    )
    right = dim.where(F.col(join_key).isNotNull()).groupBy(F.col(join_key).alias("jk")).agg(F.count(F.lit(1)).alias("dn"))
    joined = left.join(right, "jk", "left").withColumn("dn", F.coalesce("dn", F.lit(0)))
    return (
        joined.where(F.col("rk").isNotNull())
        .groupBy("rk")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_items").alias("n_items"),
            *[F.sum(m).alias(s) for s, m in zip(sums, measures)],
            F.sum(F.col("n_items") * F.col("dn")).alias("n_joined"),
            *[F.sum(F.col(m) * F.col("dn")).alias(f"joined_{s}") for s, m in zip(sums, measures)],
        )
    )


def heavy_keys(totals: DataFrame, all_rows: Column, share: float = 0.02) -> DataFrame:
    """The keys that hold at least `share` of all rows (a scalar subquery or literal)."""
    return totals.where(F.col("n_rows") >= F.lit(share) * all_rows)


def address_key(c: Column) -> Column:
    return F.lower(c)


def cik_key(c: Column) -> Column:
    """Trimmed, without leading zeros; blank is no key."""
    return F.nullif(F.regexp_replace(F.trim(c), "^0+", ""), F.lit(""))


def address_totals(transactions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per to_address: rows, transactions, value and gas, and the transactions whose block is known."""
    return eager_join_totals(
        transactions, blocks, "block_number", address_key(F.col("to_address")), ["transaction_index"], ["value_f64", "gas_used"]
    )


def owner_filings(owners: DataFrame, submissions: DataFrame) -> DataFrame:
    """Per owner: rows, filings (distinct accession numbers), and pairs of filing and submission row."""
    return eager_join_totals(owners, submissions, "accession_number", cik_key(F.col("rptownercik")), [])
