"""Mixes sources to target weights by a low-discrepancy schedule.

The documents of a source are shuffled by a hash, repeated in whole rounds up to the
capped number, and cut at the source's quota of tokens. The quotas belong to the largest
total that no source's capped supply falls short of. Each source's sequence is cut into
blocks of equal tokens; slot i of the schedule lies at the golden-ratio point
frac(i * phi) of the cumulative weights, the slots of a source are ranked, and its
blocks are joined to them in order. All running sums are two-level (bucket totals, then
within buckets), so that no task holds a whole source.

Defined cases: a source without documents or without tokens reaches no share, and its
share is divided among the others in proportion; sources without a target are left out;
documents without tokens are left out; null sources are no source; targets that are
null or not above 0 ask for nothing; repeats below 1 count as 1; of several rows of one
source the greatest share counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.session import checked_broadcast

#: Tokens of a block, and rows of a bucket of the two-level sums.
BLOCK_TOKENS, BUCKET_ROWS = 4_096, 20_000
SLOTS_OF_CHUNK = 65_536
GOLDEN = (math.sqrt(5) - 1) / 2


def targets(mix: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats): one row per source."""
    return (
        mix.where(F.col("source").isNotNull() & (F.col("target_share") > 0))
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("max_repeats"))
    )


def plan(sized: DataFrame, mix: DataFrame) -> list[dict]:
    """Per target source: its supply, quota of tokens and rounds; one row per source of the target table, which is small.

    sized: (doc_id, source, n_tokens), with one row per document.
    """
    supply = sized.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("docs"))
    rows = [r.asDict() for r in targets(mix).join(supply, "source", "left").fillna(0, ["supply", "docs"]).orderBy("source").collect()]
    alive = [r for r in rows if r["supply"] > 0]
    weight = sum(r["target_share"] for r in alive)
    total = min((r["supply"] * r["max_repeats"] * weight / r["target_share"] for r in alive), default=0.0)
    for r in rows:
        r["weight"] = r["target_share"] / weight if r["supply"] > 0 else 0.0
        r["quota"] = min(math.floor(total * r["weight"]), r["supply"] * r["max_repeats"])
        r["rounds"] = max(1, math.ceil(r["quota"] / r["supply"])) if r["supply"] > 0 else 0
    return rows


def _lookup(rows: list[dict], field: str, kind: str) -> Column:
    """The field of a source's plan as a column."""
    pairs = [x for r in rows for x in (F.lit(r["source"]), F.lit(r[field]).cast(kind))]
    return F.create_map(*pairs)[F.col("source")]


def sequence(sized: DataFrame, rows: list[dict], seed: int = 0) -> DataFrame:
    """(doc_id, source, repeat_no, n_tokens, end): the copies of each source's documents up to its quota; end is the running sum of tokens."""
    alive = [r for r in rows if r["quota"] > 0]
    if not alive:
        return sized.select("doc_id", "source", F.lit(1).alias("repeat_no"), "n_tokens", F.col("n_tokens").alias("end")).limit(0)
    n_buckets = max(8, math.ceil(sum(r["docs"] for r in alive) / BUCKET_ROWS))
    wanted = sized.where(F.col("source").isin([r["source"] for r in alive]) & (F.col("n_tokens") > 0))
    key = F.xxhash64("doc_id", F.lit(seed))
    base = wanted.withColumn("key", key).withColumn("bucket", F.pmod(F.col("key"), F.lit(n_buckets)).cast("int"))
    # a round repeats the same order, so the sums of one round serve all
    totals = base.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    ahead = totals.withColumn("ahead", F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).drop("t")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = base.withColumn("within", F.sum("n_tokens").over(inside)).join(checked_broadcast(ahead), ["source", "bucket"])
    rounds = F.explode(F.sequence(F.lit(0), _lookup(alive, "rounds", "int") - 1))
    copies = summed.withColumn("round", rounds).withColumn(
        "end", F.col("ahead") + F.col("within") + F.col("round") * _lookup(alive, "supply", "bigint")
    )
    # a copy belongs to the quota if more than half of it lies within
    kept = copies.where(F.col("end") - F.col("n_tokens") / 2 <= _lookup(alive, "quota", "bigint"))
    return kept.select("doc_id", "source", (F.col("round") + 1).alias("repeat_no"), "n_tokens", "end")


def schedule(spark, rows: list[dict], block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, block, slot): the slot of each block of each source."""
    alive = [r for r in rows if r["quota"] > 0]
    most = max((r["quota"] / block_tokens + 2) / r["weight"] for r in alive)
    n = math.ceil(most) + 64
    at, low, source = F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0)), 0.0, F.lit(alive[-1]["source"])
    bounds = []
    for r in alive[:-1]:
        low += r["weight"]
        bounds.append((low, r["source"]))
    for high, name in reversed(bounds):
        source = F.when(at < high, F.lit(name)).otherwise(source)
    slots = spark.range(n).select(F.col("id").alias("slot"), source.alias("source"), F.floor(F.col("id") / SLOTS_OF_CHUNK).alias("chunk"))
    counts = slots.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("c"))
    ahead = counts.withColumn("ahead", F.sum("c").over(Window.partitionBy("source").orderBy("chunk")) - F.col("c")).drop("c")
    rank = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    return slots.withColumn("r", rank).join(checked_broadcast(ahead), ["source", "chunk"]).select("source", (F.col("ahead") + F.col("r")).alias("block"), "slot")


def mix_documents(sized: DataFrame, mix: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """The collection (doc_id, source, repeat_no, n_tokens, slot, at) and the plan; reading by slot, then at, follows the schedule."""
    rows = plan(sized, mix)
    copies = sequence(sized, rows, seed).withColumn("block", F.floor((F.col("end") - F.col("n_tokens")) / block_tokens))
    if not any(r["quota"] > 0 for r in rows):
        return copies.withColumn("slot", F.lit(0).cast("bigint")).select("doc_id", "source", "repeat_no", "n_tokens", "slot", F.col("end").alias("at")), rows
    placed = copies.join(schedule(sized.sparkSession, rows, block_tokens), ["source", "block"])
    return placed.select("doc_id", "source", "repeat_no", "n_tokens", "slot", F.col("end").alias("at")), rows


def shares(collection: DataFrame, rows: list[dict]) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_copies, most_repeats, max_repeats): one row per target source."""
    spark = collection.sparkSession
    goal = spark.createDataFrame(
        [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in rows], "source string, target_share double, max_repeats int"
    )
    got = collection.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_copies"), F.max("repeat_no").alias("most_repeats")
    )
    whole = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
    return (
        goal.join(got, "source", "left")
        .fillna(0, ["n_tokens", "n_copies", "most_repeats"])
        .withColumn("actual_share", F.coalesce(F.try_divide("n_tokens", whole), F.lit(0.0)))
    )
