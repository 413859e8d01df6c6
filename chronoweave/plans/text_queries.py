"""Queries of filing texts and company names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import filings
from chronoweave.plans.registry import REGISTRY
from chronoweave.session import checked_broadcast, read_table

query = REGISTRY.query
_DENSE = ", ".join(f"'{c}'" for c in filings.DENSE_ITEMS)
_PROC = ", ".join(f"'{c}'" for c in filings.PROCEDURAL_ITEMS)
_CODES = ", ".join(f"'{c}'" for c in filings.ITEM_CODES)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null")


@query("clean_text")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", filings.clean_text(F.col("text")).alias("clean"))


@query("filing_body")
def filing_body(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where("source = 'edgar_8k'").select("doc_id", filings.filing_body(F.col("text")).alias("body"))


@query(
    "body_items",
    f"""
with x as (select doc_id, regexp_extract_all(lower('item ' || array_to_string(item_codes, ' item ')), 'item\\s+(\\d\\.\\d{{2}})', 1) as c from documents where item_codes is not null)
select doc_id, array_to_string(list_sort(list_distinct(list_filter(c, lambda y: y in ({_CODES})))), ',') as items from x""",
)
def body_items(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where("item_codes is not null")
    told = F.concat(F.lit("Item "), F.array_join("item_codes", " ITEM "))
    return docs.select("doc_id", F.array_join(F.array_sort(filings.body_items(told)), ",").alias("items"))


@query(
    "item_gates",
    f"select doc_id, len(item_codes) = 0 or len(list_filter(item_codes, lambda c: c not in ({_PROC}))) > 0 as worth, len(item_codes) = 0 or len(list_filter(item_codes, lambda c: c in ({_DENSE}))) > 0 as dense from documents where item_codes is not null",
)
def item_gates(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where("item_codes is not null")
    return docs.select("doc_id", filings.worth_extracting(F.col("item_codes")).alias("worth"), filings.has_dense_item(F.col("item_codes")).alias("dense"))


@query("filing_keys", "select doc_id, concat_ws(':', cik, strftime(date_filed, '%Y%m%d'), substr(sha1(text), 1, 8)) as filing_key from documents where text is not null and cik is not null and date_filed is not null")
def filing_keys(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).where("cik is not null and date_filed is not null")
    return docs.select("doc_id", filings.filing_key(F.col("cik"), F.col("date_filed"), F.col("text")).alias("filing_key"))


@query("pointers", "select doc_id from documents where length(text) < 2500 and regexp_matches(text, '(?i)(?:incorporated herein by reference|furnished (?:herewith|as exhibit)|attached (?:hereto )?as exhibit|a copy of the press release)')")
def pointers(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where(filings.is_pointer(F.col("text"))).select("doc_id")


_SUFFIX = "'\\b(?:" + "|".join(filings.COMPANY_SUFFIXES) + ")\\b\\.?\\s*$'"


def _key_sql(c: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\w\\s&]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for _ in range(3):
        out = f"trim(regexp_replace({out}, {_SUFFIX}, ''))"
    return out


_INDEX = f"""
with c as (select {_key_sql('company')} as key, ticker from documents where ticker is not null and company is not null),
ix as (select key, min(ticker) as ticker, count(distinct ticker) as n_tickers from c where length(key) >= 4 group by 1)
"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    return filings.name_index(read_table(spark, d, "documents").where("company is not null"), "company", "ticker")


@query("name_index", _INDEX + "select key, ticker, n_tickers from ix")
def name_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)


@query(
    "resolve_entities",
    _INDEX + f"""
, n as (select distinct issuername as name, {_key_sql('issuername')} as key from submission where issuername is not null),
r as (select n.name, n.key, ix.ticker, case when length(n.key) < 4 then 'too_short' when n_tickers > 1 then 'ambiguous' when n_tickers = 1 then 'anchored' else 'unanchored' end as outcome from n left join ix using (key))
select name, outcome, case when outcome = 'anchored' then 'anchored' when outcome <> 'too_short' then 'unanchored' end as kind,
       case when outcome = 'anchored' then ticker when outcome <> 'too_short' then key end as entity from r""",
)
def resolve_entities(spark: SparkSession, d: str) -> DataFrame:
    names = read_table(spark, d, "submission").where("issuername is not null").select(F.col("issuername").alias("name")).distinct().withColumn("filer", F.lit(None).cast("string"))
    return filings.resolve(names, "name", "filer", checked_broadcast(_index(spark, d))).select("name", "outcome", "kind", "entity")


@query("find_listed")
def find_listed(spark: SparkSession, d: str) -> DataFrame:
    return filings.find_listed(_documents(spark, d), "doc_id", "text", "ticker", _index(spark, d))


_EDGE = """
with l as (select distinct lpad(regexp_replace(trim(gvkey), '^0+', ''), 6, '0') as a, lpad(regexp_replace(trim(cgvkey), '^0+', ''), 6, '0') as b from supply_chain where gvkey is not null and cgvkey is not null)
"""


@query(
    "parse_edges",
    _EDGE + """
select a as key, 'Firm ' || a as subject, 'Firm ' || b as object, 1 + (1 << 8) as relation_code, 0.0::double as weight from l where a <> b""",
)
def parse_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links written as an extractor's JSON and read back: the signed, repeated and self-directed edges come out neutral, once or not at all."""
    pad = lambda c: F.lpad(F.regexp_replace(F.trim(c), "^0+", ""), 6, "0")
    l = read_table(spark, d, "supply_chain").where("gvkey is not null and cgvkey is not null").select(pad("gvkey").alias("a"), pad("cgvkey").alias("b")).distinct()
    a, b = F.concat(F.lit("Firm "), "a"), F.concat(F.lit("Firm "), "b")

    def edge(subject, object_, *words: str):
        named = zip(("relation", "sign", "magnitude", "confidence"), words)
        return F.struct(subject.alias("subject"), object_.alias("object"), *[F.lit(w).alias(n) for n, w in named])

    edges = F.array(
        edge(a, b, "supplies_to", "positive", "Small", "medium"), edge(F.lower(a), b, "SUPPLIES_TO", "neutral", "large", "high"),
        edge(a, F.lit("press release"), "SUPPLIES_TO", "neutral", "large", "high"), edge(a, b, "BEFRIENDS", "neutral", "large", "high"),
    )
    text = F.concat(F.lit("Answer: "), F.to_json(F.struct(edges.alias("edges"))))
    rows = l.select(F.concat_ws("-", "a", "b").alias("key"), text.alias("raw"))
    out = filings.parse_edges(rows, "key", "raw")
    return out.select(F.substring("key", 1, 6).alias("key"), "subject", "object", F.col("relation_code").cast("int").alias("relation_code"), F.abs("weight").alias("weight"))
