"""One consistent table from files whose schemas drift, and a log of every change.

A column lifespan catalogue: the fields of every line are exploded to (feed, file,
field, spelling, type), reduced to one row per file and field, and windows over each
field's files (lag, islands of consecutive files) give beginnings, endings, renames and
changes of type. The casts of the consistent table are generated from the alias table
(which name a field has) and the catalogue (which fields there are, and what their values
are): a field that a feed gains becomes a column by itself.

Defined cases: a name counts trimmed and in lower case; a name the alias table doesn't
hold stands for itself; a line that isn't a JSON object carries no field; a null payload
likewise; a field of several types in one file has the set of them as its type (integers
among decimals are decimals); repeated lines count once in the table; where a line has
one field under several names, the first that isn't null in order of the names counts;
values that can't be cast come out null and are counted by `cast_report`; empty tables
give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.calendar import ymd_to_date
from chronoweave.session import checked_broadcast

#: A kind of values makes a field's type where at least this share of its values is of the kind; most fields of a feed.
KIND_SHARE, MOST_FIELDS = 0.95, 10_000


def aliases(spelling: DataFrame) -> DataFrame:
    """(feed, spelling, field): one row per spelling."""
    clean = spelling.select("feed", F.lower(F.trim("spelling")).alias("spelling"), F.lower(F.trim("field_name")).alias("field"))
    return clean.where("spelling is not null and feed is not null").groupBy("feed", "spelling").agg(F.min("field").alias("field"))


def catalogue(records: DataFrame, spelling: DataFrame) -> DataFrame:
    """(feed, file_no, file_seq, field, spellings, json_type): one row per field that a file carries.

    The exploded names are reduced to distinct ones per file before the alias join, so
    that only the catalogue, not the data, is shuffled.
    """
    spark = records.sparkSession
    parsed = records.where("feed is not null and file_no is not null").select("feed", "file_no", F.try_parse_json("payload").alias("doc"))
    # an array or scalar has no fields
    objects = parsed.withColumn("doc", F.when(F.schema_of_variant("doc").startswith("OBJECT"), F.col("doc")))
    fields = objects.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer())).select(
        "feed", "file_no", F.lower(F.trim("key")).alias("spelling"), json_type(F.schema_of_variant("value")).alias("json_type")
    )
    # a file without any field stays as a row without one, so that its neighbours are compared with it
    nothing = F.lit(None).cast("string")
    files = parsed.select("feed", "file_no", nothing.alias("spelling"), nothing.alias("json_type"))
    seen = fields.unionByName(files).groupBy("feed", "file_no", "spelling").agg(F.collect_set("json_type").alias("types"))
    named = seen.join(checked_broadcast(aliases(spelling)), ["feed", "spelling"], "left").withColumn("field", F.coalesce("field", "spelling"))
    per = named.groupBy("feed", "file_no", "field").agg(
        F.array_sort(F.collect_set("spelling")).alias("spellings"), F.array_distinct(F.flatten(F.collect_list("types"))).alias("types")
    )
    several = F.when(F.array_contains("types", "decimal"), F.array_remove("types", "integer")).otherwise(F.col("types"))
    per = per.withColumn("json_type", F.nullif(F.array_join(F.array_sort(several), "|"), F.lit(""))).drop("types")
    # files are numbered per feed; the catalogue holds a row per file and field only
    order = Window.partitionBy("feed").orderBy("file_no")
    return per.withColumn("file_seq", F.dense_rank().over(order))


def json_type(variant_schema: Column) -> Column:
    """Type name of a variant -> string, integer, decimal, boolean, or the name itself for nested values; null for null."""
    t = F.upper(variant_schema)
    return (
        F.when(t == "STRING", "string")
        .when(t == "BIGINT", "integer")
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "decimal")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "VOID", F.lit(None).cast("string"))
        .otherwise(F.lower(F.regexp_extract(t, "^[A-Z]+", 0)))
    )


def changes(lifespans: DataFrame) -> DataFrame:
    """(feed, file_no, field_name, change_kind) of every beginning, ending, rename and change of type."""
    files = lifespans.select("feed", "file_no", "file_seq").distinct()
    carried = lifespans.where("field is not null")
    by_field = Window.partitionBy("feed", "field").orderBy("file_seq")
    last = files.groupBy("feed").agg(F.max("file_seq").alias("last_seq"))
    runs = (
        carried.withColumn("before", F.lag("file_seq").over(by_field))
        .withColumn("after", F.lead("file_seq").over(by_field))
        .withColumn("spelled", F.lag("spellings").over(by_field))
        .withColumn("joins", F.coalesce(F.col("before") == F.col("file_seq") - 1, F.lit(False)))
        .withColumn("island", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(by_field))
    )
    in_island = Window.partitionBy("feed", "field", "island").orderBy("file_seq").rowsBetween(Window.unboundedPreceding, -1)
    typed = runs.withColumn("type_before", F.last("json_type", ignorenulls=True).over(in_island)).join(F.broadcast(last), "feed")
    def change(when: Column, at: Column, kind: str) -> Column:
        return F.when(when, F.struct(at.alias("at"), F.lit(kind).alias("kind")))

    here, joins = F.col("file_seq"), F.col("joins")
    gone = (here < F.col("last_seq")) & (F.coalesce("after", F.lit(0)) != here + 1)
    kinds = F.array_compact(
        F.array(
            change(~joins & (here > 1), here, "added"),
            change(joins & (F.col("spelled") != F.col("spellings")), here, "renamed"),
            change(joins & (F.col("type_before") != F.col("json_type")), here, "retyped"),
            change(gone, here + 1, "removed"),
        )
    )
    found = typed.select("feed", "field", F.inline(kinds))
    return found.join(files.withColumnRenamed("file_seq", "at"), ["feed", "at"]).select(
        "feed", "file_no", F.col("field").alias("field_name"), F.col("kind").alias("change_kind")
    )


# --- casts -------------------------------------------------------------------


def _named_values(records: DataFrame, spelling: DataFrame) -> DataFrame:
    """(feed, file_no, line_no, payload, field, raw name, value) of every field of every line that has a value."""
    spark = records.sparkSession
    lines = records.where("feed is not null and payload is not null").select("feed", "file_no", "line_no", "payload", F.try_parse_json("payload").alias("doc"))
    objects = lines.withColumn("doc", F.when(F.schema_of_variant("doc").startswith("OBJECT"), F.col("doc")))
    fields = objects.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer())).select(
        "feed", "file_no", "line_no", "payload", F.col("key").alias("raw"), F.lower(F.trim("key")).alias("spelling"), F.nullif(F.trim(F.col("value").cast("string")), F.lit("")).alias("value")
    )
    named = fields.where("value is not null").join(checked_broadcast(aliases(spelling)), ["feed", "spelling"], "left")
    return named.withColumn("field", F.coalesce("field", "spelling"))


def _kinds(v: Column) -> dict[str, Column]:
    """Which kinds a value is of."""
    iso, eight, year = v.rlike(r"^\d{4}-\d{2}-\d{2}"), v.rlike(r"^\d{8}$"), v.rlike(r"^(?:19|20)\d{2}$")
    return {
        "digits": v.rlike(r"^\d+(?:\.0+)?$"), "padded": v.rlike(r"^0\d+$"), "integer": v.rlike(r"^[-+]?\d{1,18}(?:\.0+)?$"), "decimal": v.try_cast("double").isNotNull(),
        "word": F.lower(v).isin("true", "false"), "boolean": F.lower(v).isin("true", "false", "0", "1"), "iso": iso & v.try_cast("date").isNotNull(),
        "date": (iso & v.try_cast("date").isNotNull()) | (eight & ymd_to_date(v.try_cast("bigint")).isNotNull()) | year,
    }


@dataclass(frozen=True)
class Cast:
    """The one type of a field, the digits of an identifier, and how many values there are and fail."""

    feed: str
    field: str
    kind: str
    width: int
    n_values: int
    n_failed: int


def profile(records: DataFrame, spelling: DataFrame) -> DataFrame:
    """(feed, field, n, width, n_<kind>...): one row per field, in one pass with partial sums."""
    v = F.col("value")
    counts = [F.sum(c.cast("int")).alias(f"n_{k}") for k, c in _kinds(v).items()]
    width = F.max(F.when(v.rlike(r"^\d+$"), F.length(v))).alias("width")
    return _named_values(records, spelling).groupBy("feed", "field").agg(F.count(F.lit(1)).alias("n"), width, *counts)


def casts(records: DataFrame, spelling: DataFrame, feed: str | None = None) -> list[Cast]:
    """The cast of each field of the catalogue and the alias table; fields without a value are strings."""
    chosen, names = (records, aliases(spelling)) if feed is None else (records.where(F.col("feed") == feed), aliases(spelling).where(F.col("feed") == feed))
    every = names.select("feed", "field").distinct().join(profile(chosen, spelling), ["feed", "field"], "full")
    rows = every.limit(MOST_FIELDS + 1).collect()
    if len(rows) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields")
    return sorted((_cast(r) for r in rows), key=lambda c: (c.feed, c.field))


def _cast(r) -> Cast:
    n = r.n or 0
    most = lambda k: n > 0 and r[f"n_{k}"] >= KIND_SHARE * n
    if n and r.n_padded and most("digits"):
        kind, good = "identifier", r.n_digits
    elif n and r.n_iso and most("date"):
        kind, good = "date", r.n_date
    elif n and r.n_word and most("boolean"):
        kind, good = "boolean", r.n_boolean
    elif most("integer"):
        kind, good = "bigint", r.n_integer
    elif most("decimal"):
        kind, good = "double", r.n_decimal
    else:
        kind, good = "string", n
    # an identifier that isn't of digits stays as it is
    return Cast(r.feed, r.field, kind, r.width or 0, n, 0 if kind == "identifier" else n - good)


def cast_report(records: DataFrame, spelling: DataFrame) -> DataFrame:
    """(feed, field_name, type, n_values, n_failed): the type each field got, and its values that can't be cast."""
    rows = [(c.feed, c.field, c.kind, c.n_values, c.n_failed) for c in casts(records, spelling)]
    return records.sparkSession.createDataFrame(rows, "feed string, field_name string, type string, n_values bigint, n_failed bigint")


def typed(text: Column, kind: str, width: int = 0) -> Column:
    """The cast of a trimmed text to the field's one type."""
    if kind == "identifier":
        digits = F.regexp_replace(text, r"\.0+$", "")
        return F.when(digits.rlike("^[0-9]+$"), F.lpad(digits, width, "0")).otherwise(text)
    if kind == "date":
        year = F.when(text.rlike("^[0-9]{4}$"), F.concat(text, F.lit("-12-31")).try_cast("date"))
        return F.coalesce(year, F.when(text.rlike("^[0-9]{8}$"), ymd_to_date(text.try_cast("bigint"))), F.when(text.rlike("^[0-9]{4}-"), F.substring(text, 1, 10).try_cast("date")))
    if kind == "bigint":
        return text.try_cast("decimal(38,6)").try_cast("bigint")
    return text.try_cast(kind)


def consistent_table(records: DataFrame, spelling: DataFrame, feed: str, types: list[Cast] | None = None) -> DataFrame:
    """One row per distinct line of a feed: its place, and each field of the catalogue and the alias table under one name and type."""
    types = casts(records, spelling, feed) if types is None else types
    own = records.where((F.col("feed") == feed) & F.col("payload").isNotNull())
    lines = own.groupBy("file_no", "line_no", "payload").agg(F.min("file_name").alias("file_name"), F.min("delivered_at").alias("delivered_at"))
    # names of a line are brought to fields within the line; the alias table is bounded by the casts
    alias_of = {r.spelling: r.field for r in aliases(spelling).where(F.col("feed") == feed).limit(MOST_FIELDS).collect()}
    by_field: dict[str, list[str]] = {}
    for name, field in alias_of.items():
        by_field.setdefault(field, []).append(name)
    raw = F.coalesce(F.from_json("payload", "map<string,string>"), F.create_map().cast("map<string,string>"))
    entries = F.transform(F.map_entries(raw), lambda e: F.struct(e["key"].alias("raw"), F.lower(F.trim(e["key"])).alias("name"), F.nullif(F.trim(e["value"]), F.lit("")).alias("value")))
    full = lines.withColumn("entries", F.array_sort(F.filter(entries, lambda e: e["value"].isNotNull())))

    def value_of(field: str) -> Column:
        names = by_field.get(field, []) + ([field] if alias_of.get(field, field) == field and field not in by_field.get(field, []) else [])
        return F.get(F.filter(F.col("entries"), lambda e: e["name"].isin(*names)), 0)["value"]

    return full.select(
        F.lit(feed).alias("feed"), "file_no", "file_name", "delivered_at", "line_no", *[typed(value_of(c.field), c.kind, c.width).alias(c.field) for c in types]
    )
