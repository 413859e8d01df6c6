"""Queries of the general data problems: late events, hot keys, schema drift, trailing totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.calendar import ymd_of
from chronoweave.operators import hot_keys, late_events, schema_drift, trailing
from chronoweave.plans.registry import REGISTRY
from chronoweave.session import read_table

query = REGISTRY.query

# --- late and out-of-order events -------------------------------------------

_P3_EVENTS = """
with rows as (
  select globaleventid,
         case when length(cast(sqldate as varchar)) = 8 then try_strptime(cast(sqldate as varchar), '%Y%m%d')::date end as d,
         case when dateadded >= 10000000000000 then epoch(try_strptime(cast(dateadded as varchar), '%Y%m%d%H%M%S'))::bigint
              when dateadded < 100000000000 then dateadded end as a,
         goldsteinscale as g
  from gdelt_slices),
ev as (
  select globaleventid, min(d) as d, min(a) as a,
         arg_max(g, (a, g)) filter (where floor(a / 86400) - (d - date '1970-01-01') <= 7 and a is not null and g is not null) as g
  from rows where globaleventid is not null group by 1),
ok as (
  select *, (floor(a / 86400)::bigint - (d - date '1970-01-01'))::bigint as late from ev where d is not null and a is not null)
"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """The merged states of all slices: each row of the table is the state that its own slice delivered."""
    return late_events.merge_counters(late_events.delivered(read_table(spark, d, "gdelt_slices"), "globaleventid", "sqldate", "dateadded", "goldsteinscale"))


@query(
    "p3_daily",
    _P3_EVENTS
    + """
select d as event_date, count(*) filter (where late <= 0) as on_time, count(*) filter (where late between 1 and 7) as corrected,
       count(*) filter (where late > 7) as dropped, count(*) filter (where late <= 7) as n_events,
       round(avg(g) filter (where late <= 7), 6) as mean_goldstein
from ok group by 1""",
)
def p3_daily(spark: SparkSession, d: str) -> DataFrame:
    out = late_events.daily(late_events.counters(_merged(spark, d)))
    return out.withColumn("mean_goldstein", F.round("mean_value", 6)).drop("mean_value")


@query(
    "p3_revisions",
    _P3_EVENTS
    + """
, per as (select d, greatest(late, 0) as days_late, count(*) as e, count(g) as v, sum(g) as t from ok where late <= 7 group by 1, 2)
select d as event_date, days_late, sum(e) over w as n_events, round(sum(t) over w / nullif(sum(v) over w, 0), 6) as mean_goldstein
from per window w as (partition by d order by days_late rows unbounded preceding)""",
)
def p3_revisions(spark: SparkSession, d: str) -> DataFrame:
    out = late_events.revisions(late_events.counters(_merged(spark, d)))
    return out.withColumn("mean_goldstein", F.round("mean_value", 6)).drop("mean_value")


@query(
    "p3_found",
    _P3_EVENTS + "select globaleventid, case when late <= 7 then 'corrected' else 'dropped' end as outcome from ok where late > 0",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return late_events.outcomes(_merged(spark, d)).withColumnRenamed("event_id", "globaleventid")


# --- a few keys holding most records ----------------------------------------


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.address_totals(read_table(spark, d, "eth_transactions"), read_table(spark, d, "eth_blocks"))


def _owners(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.owner_filings(read_table(spark, d, "reportingowner"), read_table(spark, d, "submission"))


@query(
    "p5_address_totals",
    """
with items as (
  select block_number, transaction_index, lower(to_address) as k, count(*) as n, max(value_f64) as v, max(gas_used) as g
  from eth_transactions group by all),
b as (select block_number, count(*) as dn from eth_blocks group by 1)
select k as to_address, sum(n)::bigint as n_rows, count(*) as n_transactions, round(sum(v), 4) as value, sum(g)::bigint as gas,
       coalesce(sum(dn), 0)::bigint as n_with_block
from items left join b using (block_number) where k is not null group by 1""",
)
def p5_address_totals(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select(
        F.col("rk").alias("to_address"), "n_rows", F.col("n_items").alias("n_transactions"), F.round("value_f64", 4).alias("value"),
        F.col("gas_used").alias("gas"), F.col("n_joined").alias("n_with_block"),
    )


@query(
    "p5_owner_filings",
    """
with items as (
  select accession_number, nullif(ltrim(trim(rptownercik), '0'), '') as k, count(*) as n from reportingowner group by all),
s as (select accession_number, count(*) as dn from submission group by 1)
select k as rptownercik, sum(n)::bigint as n_rows, count(*) as n_filings, coalesce(sum(dn), 0)::bigint as n_submission_rows
from items left join s using (accession_number) where k is not null group by 1""",
)
def p5_owner_filings(spark: SparkSession, d: str) -> DataFrame:
    return _owners(spark, d).select(
        F.col("rk").alias("rptownercik"), "n_rows", F.col("n_items").alias("n_filings"), F.col("n_joined").alias("n_submission_rows")
    )


@query(
    "p5_found",
    """
select 'eth_transactions' as table_name, lower(to_address) as key_value from eth_transactions where to_address is not null
group by 2 having count(*) >= 0.02 * (select count(*) from eth_transactions)
union all
select 'reportingowner', nullif(ltrim(trim(rptownercik), '0'), '') as k from reportingowner
group by 2 having k is not null and count(*) >= 0.02 * (select count(*) from reportingowner)""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, totals in (("eth_transactions", _addresses(spark, d)), ("reportingowner", _owners(spark, d))):
        every = read_table(spark, d, name).select(F.count(F.lit(1))).scalar()
        parts.append(hot_keys.heavy_keys(totals, every).select(F.lit(name).alias("table_name"), F.col("rk").alias("key_value")))
    return parts[0].unionByName(parts[1])


# --- schemas that drift between files ---------------------------------------


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.catalogue(read_table(spark, d, "feed_records"), read_table(spark, d, "field_spelling"))


_P6_CATALOGUE = """
with lines as (select distinct feed, file_no, payload from feed_records),
keys as (select feed, file_no, payload, unnest(json_keys(payload)) as raw from lines),
named as (
  select k.feed, k.file_no, lower(trim(raw)) as spelling, coalesce(s.field_name, lower(trim(raw))) as field,
         json_type(payload, '$."' || raw || '"') as t
  from keys k left join field_spelling s on s.feed = k.feed and s.spelling = lower(trim(raw))),
seq as (select feed, file_no, row_number() over (partition by feed order by file_no) as file_seq from (select distinct feed, file_no from feed_records)),
sets as (
  select feed, file_no, file_seq, field, list_sort(list(distinct spelling)) as spellings,
         list_sort(list(distinct case t when 'VARCHAR' then 'string' when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'decimal'
                    when 'BOOLEAN' then 'boolean' when 'NULL' then null else lower(t) end)) as types
  from named join seq using (feed, file_no) group by all),
cat as (
  select feed, file_no, file_seq, field, spellings,
         nullif(array_to_string(list_filter(types, lambda x: x is not null and not (x = 'integer' and list_contains(types, 'decimal'))), '|'), '') as json_type
  from sets)
"""


@query("p6_catalogue", _P6_CATALOGUE + "select feed, file_no, field as field_name, array_to_string(spellings, ',') as spellings, json_type from cat")
def p6_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return _catalogue(spark, d).where("field is not null").select(
        "feed", "file_no", F.col("field").alias("field_name"), F.array_join("spellings", ",").alias("spellings"), "json_type"
    )


@query(
    "p6_found",
    _P6_CATALOGUE
    + """
, prev as (
  select c.*, p.spellings as old_spellings, p.file_seq as old_seq,
         (select t.json_type from cat t where t.feed = c.feed and t.field = c.field and t.file_seq < c.file_seq and t.json_type is not null
            and (select count(*) from cat u where u.feed = c.feed and u.field = c.field and u.file_seq between t.file_seq and c.file_seq)
                = c.file_seq - t.file_seq + 1
          order by t.file_seq desc limit 1) as old_type
  from cat c left join cat p on p.feed = c.feed and p.field = c.field and p.file_seq = c.file_seq - 1)
select feed, file_no, field as field_name, 'added' as change_kind from prev where old_seq is null and file_seq > 1
union all select feed, file_no, field, 'renamed' from prev where old_seq is not null and old_spellings <> spellings
union all select feed, file_no, field, 'retyped' from prev where old_type is not null and json_type is not null and old_type <> json_type
union all
select s.feed, s.file_no, c.field, 'removed' from cat c join seq s on s.feed = c.feed and s.file_seq = c.file_seq + 1
where not exists (select 1 from cat n where n.feed = c.feed and n.field = c.field and n.file_seq = c.file_seq + 1)""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(_catalogue(spark, d))


_P6_VALUES = """
with lines as (select feed, file_no, line_no, payload, min(file_name) as file_name, min(delivered_at) as delivered_at from feed_records where feed = '{feed}' and payload is not null group by all),
keys as (select *, unnest(json_keys(payload)) as raw from lines),
named as (
  select k.file_no, k.line_no, k.payload, raw, coalesce(s.field_name, lower(trim(raw))) as field, nullif(trim(json_extract_string(payload, '$."' || raw || '"')), '') as v
  from keys k left join field_spelling s on s.feed = k.feed and s.spelling = lower(trim(raw))),
one as (select file_no, line_no, payload, field, arg_min(v, raw) as v from named where v is not null group by all),
wide as (
  select l.feed, l.file_no, l.file_name, l.delivered_at, l.line_no, map_from_entries(list((o.field, o.v)) filter (where o.field is not null)) as m
  from lines l left join one o using (file_no, line_no, payload) group by l.feed, l.file_no, l.file_name, l.delivered_at, l.line_no, l.payload)
"""
_DATE = "case when {v} ~ '^[0-9]{{4}}$' then make_date({v}::int, 12, 31) when {v} ~ '^[0-9]{{8}}$' then try_strptime({v}, '%Y%m%d')::date else try_cast(substr({v}, 1, 10) as date) end"
_ID = "lpad(regexp_replace({v}, '\\.0+$', ''), 6, '0')"
_SUPPLY_FIELDS = {"cgvkey": _ID, "ctic": "{v}", "gvkey": _ID, "sale_unit": "{v}", "salecs": "try_cast({v} as double)", "seg_rank": "try_cast({v} as bigint)", "srcdate": _DATE, "stype": "{v}", "tic": "{v}"}
_GDELT_FIELDS = {
    "actor1countrycode": "{v}", "actor1name": "{v}", "actor2countrycode": "{v}", "actor2name": "{v}", "dateadded": "try_cast({v} as bigint)", "globaleventid": "try_cast({v} as bigint)",
    "goldsteinscale": "try_cast({v} as double)", "isrootevent": "try_cast({v} as boolean)", "numarticles": "try_cast({v} as bigint)", "nummentions": "try_cast({v} as bigint)", "sourceurl": "{v}", "sqldate": _DATE,
}


def _wide(feed: str, fields: dict[str, str]) -> str:
    """SQL of a feed's table; its columns are those of the files at sf0.01."""
    columns = [e.replace("{v}", f"m['{f}']").replace("{{", "{").replace("}}", "}") + f" as {f}" for f, e in fields.items()]
    return _P6_VALUES.replace("{feed}", feed) + f"select feed, file_no, file_name, delivered_at, line_no, {', '.join(columns)} from wide"


@query("p6_supply_chain", _wide("supply_chain", _SUPPLY_FIELDS))
def p6_supply_chain(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(read_table(spark, d, "feed_records"), read_table(spark, d, "field_spelling"), "supply_chain")


@query("p6_gdelt", _wide("gdelt", _GDELT_FIELDS))
def p6_gdelt(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(read_table(spark, d, "feed_records"), read_table(spark, d, "field_spelling"), "gdelt")


@query("p6_casts")
def p6_casts(spark: SparkSession, d: str) -> DataFrame:
    """The type each field got, and how many of its values can't be cast."""
    return schema_drift.cast_report(read_table(spark, d, "feed_records"), read_table(spark, d, "field_spelling"))


# --- rolling totals over trailing periods -----------------------------------

_P7 = """
with once as (
  select rec_id, min(dst) as dst, min(floor(ts / 86400))::int as day, min(coalesce(num_mentions, 1)) as m, min(goldstein) as g
  from corpus where ts is not null and dst is not null and rec_id is not null group by 1),
daily as (select dst, day, sum(m) as m, sum(g) as g from once group by 1, 2),
span as (select dst, min(day) as a, max(day) as b from daily group by 1),
dates as (select dst, a, b, unnest(range(a, b + 1)) as day from span),
roll as (
  select c.dst, c.a, c.day,
         coalesce(sum(m) filter (where c.day - t.day < 7), 0) as m7, coalesce(sum(m), 0) as m30,
         coalesce(sum(g) filter (where c.day - t.day < 7), 0) as g7, coalesce(sum(g), 0) as g30
  from dates c left join daily t on t.dst = c.dst and t.day between c.day - 29 and c.day group by all)
"""


def _trailing(spark: SparkSession, d: str) -> DataFrame:
    totals = trailing.daily_totals(read_table(spark, d, "corpus"), "rec_id", "dst", "ts", {"goldstein": None, "num_mentions": 1.0})
    return trailing.trailing(totals, ["goldstein", "num_mentions"])


@query(
    "p7_trailing",
    _P7
    + """
select dst, strftime(date '1970-01-01' + day::int, '%Y%m%d')::bigint as day_ymd, m7 as mentions_7, m30 as mentions_30,
       round(g7, 6) + 0 as goldstein_7, round(g30, 6) + 0 as goldstein_30, round(m7 / 7, 6) as avg_mentions_7, round(m30 / 30, 6) as avg_mentions_30,
       round(g7 / 7, 6) + 0 as avg_goldstein_7, round(g30 / 30, 6) + 0 as avg_goldstein_30
from roll""",
)
def p7_trailing(spark: SparkSession, d: str) -> DataFrame:
    t = _trailing(spark, d)
    return t.select(
        F.col("entity").alias("dst"), ymd_of(F.col("day")).alias("day_ymd"),
        *[F.col(f"sum_num_mentions_{p}").alias(f"mentions_{p}") for p in (7, 30)],
        *[(F.round(f"sum_goldstein_{p}", 6) + 0).alias(f"goldstein_{p}") for p in (7, 30)],
        *[F.round(f"avg_num_mentions_{p}", 6).alias(f"avg_mentions_{p}") for p in (7, 30)],
        *[(F.round(f"avg_goldstein_{p}", 6) + 0).alias(f"avg_goldstein_{p}") for p in (7, 30)],
    )


@query(
    "p7_found",
    _P7 + "select dst, strftime(date '1970-01-01' + day::int, '%Y%m%d')::bigint as day_ymd from roll where day >= a + 29 and m7 >= 50 and 30 * m7 >= 14 * m30",
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    s7, s30 = F.col("sum_num_mentions_7"), F.col("sum_num_mentions_30")
    busy = _trailing(spark, d).where((F.col("day") >= F.col("first_day") + 29) & (s7 >= 50) & (30 * s7 >= 14 * s30))
    return busy.select(F.col("entity").alias("dst"), ymd_of(F.col("day")).alias("day_ymd"))
