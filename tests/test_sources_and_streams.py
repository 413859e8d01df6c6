"""Readers, writers and streams on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import filings, panels
from chronoweave.schema import EDGE_SCHEMA
from chronoweave.sources import readers, sinks
from chronoweave.streaming import ingest


def test_quarter_hours(spark):
    s = [r.stamp for r in readers.quarter_hours(spark, "2023-11-01 08:07:00", "2023-11-01 08:45:00").collect()]
    assert s == ["20231101080000", "20231101081500", "20231101083000"]
    assert readers.quarter_hours(spark, "2023-11-01 08:45:00", "2023-11-01 08:00:00").count() == 0
    have = spark.createDataFrame([("20231101081500",)], "stamp string")
    assert readers.missing(readers.quarter_hours(spark, "2023-11-01 08:00:00", "2023-11-01 08:30:00"), have).count() == 1


def test_read_events(spark, tmp_path):
    row = [str(i) for i in range(61)]
    row[6], row[30], row[59] = 'FR"ANCE', "x", "20231101080000"
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("\t".join(row) + "\n")
    (r,) = readers.read_events(spark, str(tmp_path)).collect()
    assert (r.globaleventid, r.actor1name, r.goldsteinscale, r.dateadded, len(r)) == (0, 'FR"ANCE', None, 20231101080000, 16)


def test_read_links_prices_index_tickers(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Supplier_GVKEY,cid,FYEAR,cust_sales\n 12 ,b,2020,3\n13,c,bad,x\n")
    rows = readers.read_links(spark, str(tmp_path / "l.csv")).collect()
    assert [(r.src, r.dst, str(r.date), r.weight) for r in rows] == [("12", "B", "2020-12-31", 3.0), ("13", "C", "None", None)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_links(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "p.csv").write_text("Date,A,B\n2020-01-01,1,\n2020-01-02,2,3\n")
    assert readers.read_prices_wide(spark, str(tmp_path / "p.csv")).count() == 3
    (tmp_path / "i.idx").write_text("Form  Company  CIK\n--------------------\n8-K  ACME CORP  123  2024-01-02  edgar/a.txt\n8-K/A  ACME  123  2024-01-02  edgar/b.txt\n8-K  BAD  x  2024-01-02  edgar/c.txt\n")
    (r,) = readers.read_form_index(spark, str(tmp_path / "i.idx")).collect()
    assert (r.company, r.cik, str(r.date_filed), r.path) == ("ACME CORP", 123, "2024-01-02", "edgar/a.txt")
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 1, "ticker": "aa", "title": "A"}, "1": {"cik_str": 1, "ticker": "ab", "title": "A2"}}))
    assert [(r.cik, r.ticker) for r in readers.read_company_tickers(spark, str(tmp_path / "t.json")).collect()] == [(1, "AA")]


def test_read_form345_chain_interactions_returns(spark, tmp_path):
    for n, h, r in (("SUBMISSION", "ACCESSION_NUMBER\tISSUERCIK", "a\t1"), ("REPORTINGOWNER", "ACCESSION_NUMBER\tRPTOWNERCIK", "a\t2"), ("NONDERIV_TRANS", "ACCESSION_NUMBER\tTRANS_CODE", "a\tP")):
        (tmp_path / f"{n}.tsv").write_text(f"{h}\n{r}\n")
    t = readers.read_form345(spark, str(tmp_path))
    assert t["submission"].join(t["reportingowner"], "accession_number").count() == 1
    spark.createDataFrame([(1, 0)], "block_number bigint, i int").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(1, "2023-01-01")], "block_number bigint, block_timestamp string").write.parquet(str(tmp_path / "b"))
    assert readers.read_chain(spark, str(tmp_path / "t"), str(tmp_path / "b")).first().block_time == "2023-01-01"
    (tmp_path / "j.csv").write_text("u,i,t,x\n0,0,-1.5,9\n3,1,7.9,9\n")
    assert sorted((r.src, r.dst, r.ts) for r in readers.read_interactions(spark, str(tmp_path / "j.csv")).collect()) == [(0, 4, 0), (3, 5, 7)]
    (tmp_path / "r.csv").write_text("permno,date,ret\n1,2020-01-01,0.5\n1,2020-01-02,-0.5\n1,2020-01-03,C\n")
    assert [r.close for r in readers.read_returns(spark, str(tmp_path / "r.csv")).orderBy("date").collect()] == [1.5, 0.75]


def test_sinks(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "c"), build).count() == 5
    assert len(calls) == 1
    for _ in range(2):
        sinks.write_jsonl(spark.range(3), str(tmp_path / "j"), "1")
    assert readers.read_jsonl(spark, str(tmp_path / "j"), "id bigint").count() == 3
    sinks.write_dimension(spark.range(3), str(tmp_path / "d"))
    sinks.write_csv(spark.range(3), str(tmp_path / "v"))
    assert spark.read.csv(str(tmp_path / "v"), header=True).count() == 3


def edges(spark, rows):
    return spark.createDataFrame([(s, d, t, 0, 1.0, i) for i, (s, d, t) in enumerate(rows)], EDGE_SCHEMA)


def test_stream_equals_batch_and_runs_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for k in range(3):
        edges(spark, [(k, 1, 10 * k + i) for i in range(4)]).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):  # the second run finds nothing new
        q = ingest.ingest(ingest.edge_stream(spark, src), out, ck, 9)
        q.awaitTermination()
    assert spark.read.parquet(out).count() == 12
    assert ingest.progress(q)["rows"] in (0, 12)


def test_stream_failure_reaches_the_caller(spark, tmp_path):
    edges(spark, [(99, 1, 1)]).write.parquet(str(tmp_path / "in"))
    q = ingest.ingest(ingest.edge_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), 9)
    with pytest.raises(Exception, match="doesn't fit|FOREACH"):
        q.awaitTermination()


def test_sliding_window(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    edges(spark, [(0, 1, t) for t in range(0, 100, 10)]).coalesce(1).write.parquet(src)
    ingest.keep_window(ingest.edge_stream(spark, src), out, ck, 30).awaitTermination()
    assert sorted(r.ts for r in spark.read.parquet(f"{out}/batch=0").collect()) == [60, 70, 80, 90]
    ingest.sliding_degrees(ingest.edge_stream(spark, src), str(tmp_path / "w"), str(tmp_path / "wk"), "20 seconds", "10 seconds").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "w")).count() >= 3


def test_late_counters_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    kinds = "globaleventid bigint, sqldate bigint, dateadded bigint, goldsteinscale double"
    a = [(1, 20230101, 20230101120000, 1.0), (2, 20230101, 20230103120000, 3.0)]
    for rows in ([a[1]], [a[0]], a):  # out of order and again
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(src)
    ingest.late_counters(s, str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    (day,) = ingest.counters_of(spark, str(tmp_path / "t"), 2).collect()
    assert (day.on_time, day.corrected, day.mean_value) == (1, 1, 2.0)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_clean_text(spark):
    raw = "<html><style>p{}</style><p>A &amp; B&nbsp;&#8217;s &#x41; &bogus; &amp;lt;</p>" + "x" * 250 + "\nSIGNATURES\nJohn"
    got = one(spark, filings.clean_text(F.lit(raw)))
    assert got.startswith("A & B ’s A   &lt; x".replace("   ", " ")) and got.endswith("x") and "John" not in got
    assert one(spark, filings.clean_text(F.lit("a\nSignature"))) == "a\nSignature"
    assert one(spark, filings.clean_text(F.lit(None).cast("string"))) is None
    assert one(spark, filings.clean_text(F.lit(""))) == ""


def test_filing_documents(spark):
    raw = "h</SEC-HEADER><DOCUMENT><TYPE>8-K\n<p>Cover. Item 2.02 See press. Incorporated herein by reference</DOCUMENT><DOCUMENT><TYPE>EX-99.1\n" + "word " * 100 + "</DOCUMENT>"
    assert one(spark, F.array_join(filings.documents_of(F.lit(raw))["type"], ",")) == "8-K,EX-99.1"
    body = one(spark, filings.filing_body(F.lit(raw)))
    assert body.startswith("Item 2.02") and body.count("word") == 100
    assert one(spark, filings.primary_document(F.lit("a</SEC-HEADER>rest"))) == "rest" and one(spark, filings.primary_document(F.lit("plain"))) == "plain"
    assert one(spark, filings.header_items(F.lit("ITEM INFORMATION: Mine Safety\nITEM INFORMATION:\tOther Events\nITEM INFORMATION: Mine safety\nITEM INFORMATION: ?"))) == ["1.04", "8.01"]
    assert one(spark, filings.body_items(F.lit("ITEM 5.02 item 9.99 Item 2.02 item 5.02"))) == ["5.02", "2.02"]


def test_company_names(spark):
    for raw, want in (("Acme Holdings Inc.", "acme"), ("AT&T Corp", "at&t"), ("Élan, plc", "élan"), ("Beta Industries", "beta industries")):
        assert one(spark, filings.company_key(F.lit(raw))) == want
    for name, ok in (("Beta Industries", True), ("May 3, 2024", False), ("the Lender", False), ("press release", False), ("The Coca-Cola Company", True), ("the U.S. cannabis industry", False), ("quarterly dividend", False), ("", False)):
        assert one(spark, filings.is_entity(F.lit(name))) is ok, name
    assert "siemens" in one(spark, filings.name_candidates(F.lit("today Siemens AG announced it")))


def test_parse_edges_strict(spark):
    bad = spark.createDataFrame([("k", '{"edges": [{"subject": "A", "object": "B", "relation": "LIKES", "sign": "neutral", "magnitude": "small", "confidence": "low"}]}'), ("n", None), ("e", "none")], "key string, raw string")
    assert filings.parse_edges(bad, "key", "raw").count() == 0
    with pytest.raises(Exception, match="vocabulary"):
        filings.parse_edges(bad, "key", "raw", strict=True).select("subject").collect()


def test_extractor_failures_are_isolated_and_retried(spark):
    t = spark.createDataFrame([(1, "a"), (2, "boom")], "key bigint, text string")

    def work(x):
        if x == "boom":
            raise ValueError("no")
        return "{}"

    done = filings.extract_with(t, "key", "text", work)
    assert {(r.key, r.error is None) for r in done.collect()} == {(1, True), (2, False)}
    assert [r.key for r in filings.pending(t, done, "key").collect()] == [2]


def test_folds_tile():
    f = panels.folds(0, 1000, 4, 0.4)
    assert f[0][1] == 400 and f[-1][3] == 1001 and all(a[3] == b[2] for a, b in zip(f, f[1:]))
    with pytest.raises(ValueError):
        panels.folds(0, 10, 0, 0.4)
