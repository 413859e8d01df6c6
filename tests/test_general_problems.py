"""Late events, hot keys, schema drift and trailing totals on small fixtures: nulls, ties, repeats, empty tables, clashing columns."""

import random

from pyspark.sql import functions as F

from chronoweave.operators import hot_keys, late_events, schema_drift, trailing

SLICES = "globaleventid bigint, sqldate bigint, dateadded bigint, goldsteinscale double, event_day string, version int"


def slices(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SLICES)


def delivered(df):
    return late_events.delivered(df, "globaleventid", "sqldate", "dateadded", "goldsteinscale")


def registers(df):
    return late_events.merge_counters(delivered(df))


ROWS = [
    (1, 20230101, 20230101120000, 1.0), (1, 20230101, 20230105120000, 2.0), (1, 20230101, 20230120120000, 9.0),
    (2, 20230101, 1672747200, 3.0), (3, 20230101, 20230110000000, 5.0), (4, 20230230, 20230301000000, 1.0),
    (5, None, 20230301000000, 1.0), (6, 20230101, None, 1.0), (7, 20230101, 20221231000000, None), (None, 20230101, 20230101000000, 1.0),
]


def test_late_events_outcomes_and_means(spark):
    r = registers(slices(spark, ROWS))
    assert {(x.event_id, x.outcome) for x in late_events.outcomes(r).collect()} == {(2, "corrected"), (3, "dropped")}
    (day,) = late_events.daily(late_events.counters(r)).collect()
    # event 1 counts with its latest value within the cut-off; 3 is dropped; 7 has no value
    assert (day.on_time, day.corrected, day.dropped, day.n_events, day.mean_value) == (2, 1, 1, 3, 2.5)


def test_late_events_merge_is_idempotent_and_free_of_order(spark):
    g = random.Random(1)
    whole = sorted(map(str, late_events.daily(late_events.counters(registers(slices(spark, ROWS)))).collect()))
    for parts in (2, 3, 5):
        deliveries = [[] for _ in range(parts)]
        for row in ROWS * 2:  # every row comes twice, perhaps in two deliveries
            g.choice(deliveries).append(row)
        states = [registers(slices(spark, x)) for x in deliveries]
        g.shuffle(states)
        merged = late_events.merge_counters(states[0], late_events.merge_counters(*states), states[-1])
        assert sorted(map(str, late_events.daily(late_events.counters(merged)).collect())) == whole


def test_no_event_is_lost_between_deliveries(spark):
    at = [(i, 20230101, 20230102000000, 1.0) for i in (1, 2, 3)]
    first, second = registers(slices(spark, at[:2])), registers(slices(spark, at[2:]))
    (day,) = late_events.daily(late_events.counters(late_events.merge_counters(first, second))).collect()
    assert day.n_events == 3 and day.corrected == 3


def test_late_events_empty(spark):
    r = registers(slices(spark, []))
    assert late_events.outcomes(r).count() == 0 and late_events.daily(late_events.counters(r)).count() == 0
    assert late_events.revisions(late_events.counters(r)).count() == 0


def test_revisions_grow(spark):
    rows = late_events.revisions(late_events.counters(registers(slices(spark, ROWS)))).orderBy("days_late").collect()
    assert [(r.days_late, r.n_events) for r in rows] == [(0, 2), (2, 3)]


def test_hot_keys_against_brute_force(spark):
    g = random.Random(3)
    tx = [(g.randrange(5), i, g.choice(["0xAA", "0xaa", "0xbb", None, "0xcc"]), g.choice([None, 1.5, 2.0]), 7) for i in range(300)]
    tx += tx[:40]
    t = spark.createDataFrame(tx, "block_number bigint, transaction_index int, to_address string, value_f64 double, gas_used bigint").withColumn("jk", F.lit(0)).withColumn("n", F.lit(9))
    b = spark.createDataFrame([(i,) for i in range(4)], "block_number bigint")
    got = {r.rk: (r.n_rows, r.n_items, round(r.value_f64 or 0, 6), r.gas_used, r.n_joined) for r in hot_keys.address_totals(t, b).collect()}
    want = {}
    for k in {x[2].lower() for x in tx if x[2]}:
        rows = [x for x in tx if x[2] and x[2].lower() == k]
        once = set(rows)
        want[k] = (len(rows), len(once), round(sum(x[3] or 0 for x in once), 6), 7 * len(once), sum(x[0] < 4 for x in once))
    assert got == want


def test_hot_keys_shares_and_empty(spark):
    o = spark.createDataFrame([("a", " 0012 "), ("a", "12"), ("b", "0012"), ("c", "7"), ("d", None), ("e", " ")], "accession_number string, rptownercik string")
    s = spark.createDataFrame([("a",), ("b",)], "accession_number string")
    t = hot_keys.owner_filings(o, s)
    assert {(r.rk, r.n_rows, r.n_items, r.n_joined) for r in t.collect()} == {("12", 3, 2, 2), ("7", 1, 1, 0)}
    assert [r.rk for r in hot_keys.heavy_keys(t, F.lit(6), 0.5).collect()] == ["12"]
    assert hot_keys.owner_filings(o.limit(0), s.limit(0)).count() == 0


FEED = "feed string, file_no int, file_name string, delivered_at timestamp, line_no int, payload string, field string"


def feed(spark, lines):
    return spark.createDataFrame([("f", n, f"{n}", None, i, p, "x") for i, (n, p) in enumerate(lines)], FEED)


def spelling(spark):
    return spark.createDataFrame([("f", "amount", "amount"), ("f", "amount", "amt")], "feed string, field_name string, spelling string")


def test_schema_changes(spark):
    lines = [
        (1, '{"id": 1, "amt": 5}'), (1, '{"id": 1, "amt": 5}'), (3, '{"ID ": 2, "amount": null}'), (4, '{"id": 3, "amount": 2.0}'), (5, '{"id": 4}'),
        (6, '{"id": 4, "amount": "7"}'), (7, '{"id": true, "amt": "x"}'), (8, "not json"), (8, None), (9, '{"id": 1}'),
    ]
    got = {(r.file_no, r.field_name, r.change_kind) for r in schema_drift.changes(schema_drift.catalogue(feed(spark, lines), spelling(spark))).collect()}
    # file 6 begins a new stretch of amount, so its type isn't compared with file 4's; file 8 carries nothing
    assert got == {
        (3, "amount", "renamed"), (4, "amount", "retyped"), (5, "amount", "removed"), (6, "amount", "added"), (7, "amount", "renamed"), (7, "id", "retyped"),
        (8, "id", "removed"), (8, "amount", "removed"), (9, "id", "added"),
    }


def test_schema_empty(spark):
    empty = feed(spark, [])
    assert schema_drift.changes(schema_drift.catalogue(empty, spelling(spark))).count() == 0
    assert schema_drift.consistent_table(empty, spelling(spark), "f").count() == 0


def test_consistent_table(spark):
    lines = [(1, '{"id": "007", "AMT ": "5"}'), (1, '{"id": "007", "AMT ": "5"}'), (2, '{"id": 12, "amount": 2.5, "more": null, "other": true}'), (3, "[1]"), (4, '{"id": 3, "other": 0, "added": "2023-01-05"}'), (5, '{"added": 20230106}')]
    rows = schema_drift.consistent_table(feed(spark, lines), spelling(spark), "f").orderBy("file_no", "line_no").collect()
    got = [(r.file_no, r.id, r.amount, r.other, str(r.added)) for r in rows]
    want = [(1, "007", 5.0, None, "None"), (1, "007", 5.0, None, "None"), (2, "012", 2.5, True, "None"), (3, None, None, None, "None"), (4, "003", None, False, "2023-01-05"), (5, None, None, None, "2023-01-06")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_mixed_types_and_failed_casts(spark):
    lines = [(1, '{"id": 1, "x": 5}'), (1, '{"id": "a", "x": 5.5}')] + [(2, '{"id": 2, "x": 7}')] * 30 + [(2, '{"x": "bad"}')]
    cat = {(r.file_no, r.field): r.json_type for r in schema_drift.catalogue(feed(spark, lines), spelling(spark)).collect()}
    assert cat[1, "id"] == "integer|string" and cat[1, "x"] == "decimal" and cat[2, "x"] == "integer|string"
    report = {r.field_name: (r.type, r.n_values, r.n_failed) for r in schema_drift.cast_report(feed(spark, lines), spelling(spark)).collect()}
    assert report["x"] == ("double", 33, 1) and report["id"] == ("bigint", 32, 1) and report["amount"] == ("string", 0, 0)


def test_field_types(spark):
    values = [("identifier", "1234", "001234"), ("identifier", "x1", "x1"), ("date", "2023", "2023-12-31"), ("date", "20230105", "2023-01-05"), ("date", "2023-01-05", "2023-01-05"), ("bigint", "12.0", "12"), ("bigint", "x", None)]
    for kind, raw, want in values:
        got = spark.range(1).select(schema_drift.typed(F.lit(raw), kind, 6).cast("string")).first()[0]
        assert got == want, (kind, raw, got)


def test_trailing_against_brute_force(spark):
    g = random.Random(5)
    rows = [(i, g.choice(["A", "B", None]), g.choice([None, g.randrange(86_400 * 90)]), g.choice([None, 1.0, 2.0]), g.choice([None, -1.0, 4.0])) for i in range(150)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "rec_id bigint, dst string, ts bigint, num_mentions double, goldstein double").withColumn("entity", F.lit("z")).withColumn("day", F.lit(1))
    totals = trailing.daily_totals(df, "rec_id", "dst", "ts", {"goldstein": None, "num_mentions": 1.0})
    got = {(r.entity, r.day): (r.sum_num_mentions_7, r.sum_goldstein_30) for r in trailing.trailing(totals, ["goldstein", "num_mentions"]).collect()}
    once = {r[0]: r for r in rows if r[1] and r[2] is not None}.values()
    for c in "AB":
        own = [(r[2] // 86_400, r[3] if r[3] is not None else 1.0, r[4] or 0.0) for r in once if r[1] == c]
        days = [x[0] for x in own]
        for d in range(min(days), max(days) + 1):
            want = (sum(x[1] for x in own if d - 7 < x[0] <= d), sum(x[2] for x in own if d - 30 < x[0] <= d))
            assert got.pop((c, d)) == want
    assert not got


def test_trailing_empty(spark):
    df = spark.createDataFrame([], "rec_id bigint, dst string, ts bigint, num_mentions double")
    assert trailing.trailing(trailing.daily_totals(df, "rec_id", "dst", "ts", {"num_mentions": 1.0}), ["num_mentions"]).count() == 0
