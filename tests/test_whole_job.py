"""The queries over the whole job, against brute force that has no bound of its own."""

import math
from collections import Counter

import pytest

from chronoweave.operators import ids
from chronoweave.plans import load
from chronoweave.plans.adapters import prices, trade_edges

QUERIES = load().queries


@pytest.fixture(scope="module")
def links(spark, small):
    """(training, test) links in order of time, as (pos, src, dst, ts)."""
    rows = sorted(trade_edges(spark, small).select("ts", "seq", "src", "dst").collect())
    every = [(i, r.src, r.dst, r.ts) for i, r in enumerate(rows)]
    return every[: int(len(rows) * 0.70)], every[int(len(rows) * 0.85) :]


def test_inductive_split_sees_every_training_edge(spark, small, links):
    train, test = links
    seen = {x[1] for x in train} | {x[2] for x in train}
    want = Counter(x[1] not in seen or x[2] not in seen for x in test)
    got = {r.inductive: r.n for r in QUERIES["inductive_split"](spark, small).collect()}
    assert got == dict(want)


def test_common_neighbours_against_all_vertices(spark, small, links):
    near = {}
    for _, a, b, _ in links[0]:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {(a, b): n for a in near for b in near if a % 50 == 0 and a != b and (n := len(near[a] & near[b]))}
    got = {(r.src, r.dst): r.common for r in QUERIES["common_neighbours"](spark, small).collect()}
    assert got == want
    assert got


def test_every_test_link_asks(spark, small, links):
    train, test = links
    degree = Counter(x[2] for x in train)
    scores = QUERIES["popularity_scores"](spark, small).collect()
    assert Counter(r.qid for r in scores) == {x[0]: 11 for x in test}
    assert {r.qid: r.popularity for r in scores if r.slot == -1} == {x[0]: degree[x[2]] for x in test}
    assert sum(r.n for r in QUERIES["cold_warm_split"](spark, small).collect()) == 11 * len(test)
    assert {r.batch for r in QUERIES["batch_auc"](spark, small).collect()} == set(range((len(test) + 19) // 20))


def test_uniform_negatives_reach_every_vertex(spark, small, links):
    got = QUERIES["neg_sample_uniform"](spark, small).collect()
    assert Counter(r.qid for r in got) == {x[0]: 10 for x in links[1]}
    most = max(max(r.src, r.dst) for r in trade_edges(spark, small).collect())
    assert {r.dst for r in got} == set(range(most + 1))


def test_synthetic_close_over_the_whole_calendar(spark, small):
    close = {(r.date, r.ticker): r.close for r in prices(spark, small).collect()}
    days, want = sorted({k[0] for k in close}), {}
    for ticker in {k[1] for k in close}:
        level, before = 1.0, None
        for day in days:
            now = close.get((day, ticker))
            if now is not None and before is not None:
                level *= now / before
            want[day, ticker], before = level, now
    got = {(r.date, r.ticker): r.log_close for r in QUERIES["synthetic_close"](spark, small).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(math.log(want[k]), abs=6e-5) for k in want)
    assert max(k[0] for k in got) == days[-1]


def test_ids_have_no_cap(spark, small):
    names = {r.name: r.id for r in QUERIES["dense_ids"](spark, small).collect()}
    got = QUERIES["map_edges_to_ids"](spark, small).collect()
    assert {x for r in got for x in (r.src_id, r.dst_id)} - {-1} == set(names.values())
    assert len(names) > 400


def test_cap_and_its_overflow(spark):
    rows = spark.createDataFrame([(0, "A", "B"), (1, "C", "A"), (2, None, "C"), (3, "D", None), (4, "C", "D")], "i bigint, src string, dst string")
    known = ids.dense_ids(ids.edge_names(rows, "i"))
    capped = ids.with_ids(ids.with_ids(rows, known, "src", "s", 1), known, "dst", "d", 1)
    assert sorted((r.i, r.s, r.d) for r in capped.collect()) == [(0, 0, -1), (1, -1, 0), (2, -1, -1), (3, -1, -1), (4, -1, -1)]
    assert ids.overflow(rows, known, ["src", "dst"], 1).first()[0] == 6
    assert ids.overflow(rows, known, ["src", "dst"], 4).first()[0] == 0
