"""Insider filings: owners, issuers and their trades as bipartite edges and flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.hot_keys import cik_key

#: Relation code of each kind of relationship, in order of precedence.
RELATIONSHIPS = (("director", 1), ("officer", 2), ("tenpercent", 3))
OPEN_MARKET = ("P", "S")


def relationship_code(text: Column) -> Column:
    """Director before officer before ten-percent owner before other (0)."""
    low = F.regexp_replace(F.lower(text), "[^a-z]", "")
    code = F.lit(0)
    for word, n in reversed(RELATIONSHIPS):
        code = F.when(low.contains(word), n).otherwise(code)
    return F.coalesce(code, F.lit(0))


def filing_date(text: Column) -> Column:
    """Dates as 2023-01-31, 20230131, 31-JAN-2023 or 01/31/2023."""
    t = F.upper(F.trim(text))
    return F.coalesce(
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10).try_cast("date")),
        F.when(t.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)).try_cast("date")),
        F.when(
            t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"),
            F.concat_ws("-", F.substring(t, -4, 4), F.lpad(F.regexp_extract(t, r"^\d+", 0), 2, "0"), F.lpad(F.regexp_extract(t, r"/(\d+)/", 1), 2, "0")).try_cast("date"),
        ),
        F.when(
            t.rlike(r"^\d{1,2}-[A-Z]{3}-\d{4}$"),
            F.concat_ws("-", F.substring(t, -4, 4), F.lpad(month_number(F.regexp_extract(t, "[A-Z]{3}", 0)), 2, "0"), F.lpad(F.regexp_extract(t, r"^\d+", 0), 2, "0")).try_cast("date"),
        ),
    )


def month_number(name: Column) -> Column:
    """JAN -> 1 and so on; null for other texts."""
    names = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
    return F.try_element_at(F.create_map(*[x for i, n in enumerate(names, 1) for x in (F.lit(n), F.lit(str(i)))]), name)


def owner_edges(owners: DataFrame, submissions: DataFrame) -> DataFrame:
    """(accession_number, owner, issuer, relation): one row per distinct filing, owner and issuer."""
    o = owners.select("accession_number", cik_key(F.col("rptownercik")).alias("owner"), relationship_code(F.col("rptowner_relationship")).alias("relation")).where("owner is not null")
    s = submissions.select("accession_number", cik_key(F.col("issuercik")).alias("issuer")).where("issuer is not null").distinct()
    return o.groupBy("accession_number", "owner").agg(F.max("relation").alias("relation")).join(s, "accession_number")


def within_cap(edges: DataFrame, bridge: str, entity: str, most: int) -> DataFrame:
    """The edges of bridges that touch at most so many entities."""
    ok = edges.select(bridge, entity).distinct().groupBy(bridge).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select(bridge)
    return edges.join(ok, bridge, "left_semi")


def interlocks(edges: DataFrame, bridge: str, entity: str, at: str, most: int = 15) -> DataFrame:
    """(a, b, bridge, ts): pairs of entities that share a bridge, a < b, with the later of their last times; a pair's earliest bridge counts.

    Bridges of more than `most` entities connect nothing, which also bounds the pairs of a bridge.
    """
    last = edges.groupBy(bridge, entity).agg(F.max(at).alias("ts"))
    kept = within_cap(last, bridge, entity, most)
    a = kept.select(bridge, F.col(entity).alias("a"), F.col("ts").alias("ta"))
    b = kept.select(F.col(bridge).alias("bb"), F.col(entity).alias("b"), F.col("ts").alias("tb"))
    pairs = a.join(b, (F.col(bridge) == F.col("bb")) & (F.col("a") < F.col("b"))).select("a", "b", F.col(bridge).alias("bridge"), F.greatest("ta", "tb").alias("ts"))
    return pairs.groupBy("a", "b").agg(F.min(F.struct("bridge", "ts")).alias("s")).select("a", "b", "s.bridge", "s.ts")


def net_flow(trades: DataFrame, firm: str, day: str, code: str, value: Column, least: float, quantile: float) -> DataFrame:
    """(firm, day, flow, sign): open-market purchases less sales per firm and day, of at least `least` and the quantile of sizes."""
    signed = F.when(F.col(code) == "P", value).otherwise(-value)
    flow = trades.where(F.col(code).isin(*OPEN_MARKET)).groupBy(firm, day).agg(F.sum(signed).alias("flow"))
    big = flow.where(F.abs("flow") >= least)
    bound = big.select(F.expr(f"percentile(abs(flow), {quantile})")).scalar()
    return big.where(F.abs("flow") >= bound).withColumn("sign", F.signum("flow").cast("int"))


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the most frequent value of each key, ties to the least."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, value)
