"""Readers of the file formats that events, filings, links and chains come in.

Every reader gives a lazy DataFrame with a declared schema, so that filters and columns
reach the scan. Fetching over a network isn't part of the engine: `missing` says what is
still to be fetched.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.calendar import arrival_seconds, ymd_to_date

# --- fixed values: the positions of the columns kept of an event export, and other names of the columns of link tables ---
EVENT_COLUMNS = {
    0: "globaleventid", 1: "sqldate", 5: "actor1code", 6: "actor1name", 7: "actor1countrycode", 15: "actor2code", 16: "actor2name", 17: "actor2countrycode", 26: "eventcode", 28: "eventrootcode",
    29: "quadclass", 30: "goldsteinscale", 31: "nummentions", 34: "avgtone", 59: "dateadded", 60: "sourceurl",
}
EVENT_TYPES = {"globaleventid": "bigint", "sqldate": "bigint", "quadclass": "int", "goldsteinscale": "double", "nummentions": "int", "avgtone": "double", "dateadded": "bigint"}
EVENT_WIDTH = 61
LINK_ALIASES = {
    "src": ("gvkey", "supplier_gvkey", "sgvkey", "supplier_id", "supplier", "src"), "dst": ("cgvkey", "customer_gvkey", "cid", "customer_id", "customer", "dst"),
    "date": ("srcdate", "datadate", "fyear", "date", "ts"), "sales": ("salecs", "sales", "cust_sales", "revenue_percent", "weight"),
}


def quarter_hours(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(stamp,): the quarter hours of [start, end) as YYYYMMDDHHMMSS; start is rounded down."""
    a, b = (F.unix_timestamp(F.lit(x).cast("timestamp")) for x in (start, end))
    first = F.floor(a / 900) * 900
    rows = spark.range(1).select(F.explode(F.when(first < b, F.sequence(first, b - 1, F.lit(900))).otherwise(F.array().cast("array<bigint>"))).alias("s"))
    return rows.select(F.date_format(F.timestamp_seconds("s"), "yyyyMMddHHmmss").alias("stamp"))


def missing(wanted: DataFrame, present: DataFrame, key: str = "stamp") -> DataFrame:
    """The wanted slices that aren't there yet."""
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def read_events(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Tab-separated event exports without header, plain or gzipped: 16 of 61 positional columns under their names and types."""
    schema = ", ".join(f"_c{i} string" for i in range(EVENT_WIDTH))
    raw = spark.read.csv(path, sep="\t", header=False, schema=schema, quote="")
    return raw.select(*[F.col(f"_c{i}").try_cast(EVENT_TYPES.get(n, "string")).alias(n) for i, n in EVENT_COLUMNS.items()])


def read_prices_wide(spark: SparkSession, path: str, date: str = "Date") -> DataFrame:
    """A table of one column per ticker -> (date, ticker, close) without empty cells."""
    wide = spark.read.csv(path, header=True)
    tickers = [c for c in wide.columns if c != date]
    long = wide.unpivot([date], tickers, "ticker", "close")
    return long.select(F.col(date).try_cast("date").alias("date"), "ticker", F.col("close").try_cast("double").alias("close")).where("close is not null")


def read_form345(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three tab-separated tables of a quarter of insider filings, names in lower case."""
    out = {}
    for name in ("SUBMISSION", "REPORTINGOWNER", "NONDERIV_TRANS"):
        t = spark.read.csv(f"{folder}/{name}.tsv", sep="\t", header=True)
        out[name.lower()] = t.toDF(*[c.strip().lower() for c in t.columns])
    return out


def first_present(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """The first of the names among the columns, whatever their case."""
    low = {c.strip().lower(): c for c in columns}
    return next((low[n] for n in names if n in low), None)


def link_date(value: Column) -> Column:
    """A date, YYYYMMDD, or a year (its last day)."""
    t = F.trim(value.cast("string"))
    return F.coalesce(
        F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-12-31")).try_cast("date")), F.when(t.rlike(r"^\d{8}$"), ymd_to_date(t.try_cast("bigint"))), F.substring(t, 1, 10).try_cast("date")
    )


def read_links(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]] = LINK_ALIASES) -> DataFrame:
    """(src, dst, date, weight) of a table of links in CSV or Parquet whose columns go by several names."""
    t = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    found = {k: first_present(t.columns, v) for k, v in aliases.items()}
    lacking = [k for k in ("src", "dst", "date") if found[k] is None]
    if lacking:
        raise ValueError(f"no column for {lacking} among {t.columns}")
    weight = F.col(found["sales"]).try_cast("double") if found["sales"] else F.lit(None).cast("double")
    return t.select(F.upper(F.trim(F.col(found["src"]).cast("string"))).alias("src"), F.upper(F.trim(F.col(found["dst"]).cast("string"))).alias("dst"), link_date(F.col(found["date"])).alias("date"), weight.alias("weight"))


def read_chain(spark: SparkSession, transactions: str, blocks: str) -> DataFrame:
    """Transactions with the time of their block: the first block column whose name contains `time`."""
    t, b = spark.read.parquet(transactions), spark.read.parquet(blocks)
    at = next(c for c in b.columns if "time" in c.lower())
    return t.join(b.select("block_number", F.col(at).alias("block_time")), "block_number", "left")


def read_company_tickers(spark: SparkSession, path: str) -> DataFrame:
    """(cik, ticker, name) of a JSON object of numbered entries; the first entry of a cik counts."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, struct<cik_str: bigint, ticker: string, title: string>>")
    rows = raw.select(F.explode(entries).alias("n", "e")).select(F.col("n").cast("int").alias("n"), "e.*")
    first = rows.groupBy("cik_str").agg(F.min(F.struct("n", "ticker", "title")).alias("s"))
    return first.select(F.col("cik_str").alias("cik"), F.upper("s.ticker").alias("ticker"), F.col("s.title").alias("name"))


def read_form_index(spark: SparkSession, path: str, form_type: str = "8-K") -> DataFrame:
    """(form, company, cik, date_filed, path) of a fixed-width index: the rows behind its rule that have exactly the form's type."""
    lines = spark.read.text(path).select("value").where(F.col("value").rlike(r"\d{4}-\d{2}-\d{2}\s+edgar/") | F.col("value").rlike(r"\s{2,}\S+\.txt\s*$"))
    p = F.split(F.trim("value"), r"\s{2,}")
    t = lines.select(
        F.get(p, 0).alias("form"), F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 4, F.lit(0))), " ").alias("company"), F.try_element_at(p, F.lit(-3)).try_cast("bigint").alias("cik"),
        F.try_element_at(p, F.lit(-2)).try_cast("date").alias("date_filed"), F.try_element_at(p, F.lit(-1)).alias("path"),
    )
    return t.where((F.col("form") == form_type) & F.col("cik").isNotNull() & F.col("date_filed").isNotNull())


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines, plain or gzipped, with a declared schema."""
    return spark.read.json(path, schema=schema)


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, ts, seq) of a CSV whose first columns are user, item and time; items are numbered behind the users, times cut to whole seconds from 0 on."""
    raw = spark.read.csv(path, header=True)
    u, i, t = raw.columns[:3]
    rows = raw.select(F.col(u).cast("double").cast("bigint").alias("src"), F.col(i).cast("double").cast("bigint").alias("item"), F.greatest(F.floor(F.col(t).cast("double")), F.lit(0)).alias("ts"), F.monotonically_increasing_id().alias("seq"))
    top = rows.select(F.max("src")).scalar()
    return rows.select("src", (F.col("item") + top + 1).alias("dst"), "ts", "seq")


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    """(date, ticker, close): closes compounded from a table of permno, date and ret."""
    from pyspark.sql import Window

    t = spark.read.csv(path, header=True) if not path.endswith(".parquet") else spark.read.parquet(path)
    rows = t.select(F.col("permno").cast("string").alias("ticker"), F.col("date").try_cast("date").alias("date"), F.col("ret").try_cast("double").alias("ret")).where("date is not null and ret is not null")
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("date", "ticker", F.product(1 + F.col("ret")).over(w).alias("close"))


def replay(rows: DataFrame, seconds: str, src: str, dst: str, position: str) -> DataFrame:
    """(src, dst, ts, seq): rows with an instant and both ends, in order of time and then of arrival."""
    t = rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), arrival_seconds(F.col(seconds)).alias("ts"), F.col(position).alias("seq"))
    return t.where("src is not null and dst is not null and ts is not null").orderBy("ts", "seq")
