"""Graph and sampler on random graphs with heavy ties, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import attention, graph, linkpred, metrics, sampler, studies
from chronoweave.schema import EDGE_SCHEMA


def make(spark, n=400, v=9, span=60, seed=0):
    g = random.Random(seed)
    rows = [(g.randrange(v) if g.random() > 0.4 else 0, g.randrange(v), g.randrange(span), g.randrange(5), 1.0, i) for i in range(n)]
    return rows, spark.createDataFrame(rows, EDGE_SCHEMA)


def test_sample_recent_is_strictly_before(spark):
    rows, edges = make(spark)
    asked = [(i, i % 10, t) for i, t in enumerate([0, 1, 30, 59, 60, 61, 200, 17, 17, 5, 40, 41])]
    q = spark.createDataFrame(asked, "qid bigint, node bigint, t bigint")
    got = {}
    for r in sampler.sample_recent(edges, q, 4, keep_empty=True).collect():
        got.setdefault(r.qid, []).append((r.slot, r.neighbour, r.neighbour_ts))
    for qid, node, t in asked:
        past = sorted((x for x in rows if x[0] == node and x[2] < t), key=lambda x: (x[2], x[5]))[-4:]
        want = [(4 - len(past) + i, x[1], x[2]) for i, x in enumerate(past)] or [(None, None, None)]
        assert sorted(got[qid], key=str) == sorted(want, key=str)


def test_future_edges_change_nothing(spark):
    rows, edges = make(spark, seed=2)
    q = spark.createDataFrame([(i, i % 9, 30) for i in range(9)], "qid bigint, node bigint, t bigint")
    f = lambda e: sorted(map(tuple, sampler.recency_features(e, q, 3).collect()))
    assert f(edges) == f(edges.where("ts < 30"))


def test_no_dependence_on_parts(spark, monkeypatch):
    from chronoweave.functions import prefix

    _, edges = make(spark, seed=4)
    q = edges.select(F.col("seq").alias("qid"), F.col("src").alias("node"), F.col("ts").alias("t"))
    one = sorted(map(tuple, sampler.cuts(edges, q).collect()))
    monkeypatch.setattr(prefix, "PART_BYTES", 1)
    monkeypatch.setattr(prefix, "HOT_ROWS", 1)
    monkeypatch.setattr(prefix, "parts_of", lambda df: 9)
    assert sorted(map(tuple, sampler.cuts(edges, q).collect())) == one


def test_expiry_of_prefixes(spark):
    rows, edges = make(spark, seed=6)
    want = []
    for v in range(9):
        run = sorted((x for x in rows if x[0] == v), key=lambda x: x[5])
        while run and run[0][2] < 40:
            run.pop(0)
        want += [x[5] for x in run]
    assert sorted(r.seq for r in graph.alive(edges, 40).collect()) == sorted(want)
    assert sum(r.expired for r in graph.expired_counts(edges, 40).collect()) == len(rows) - len(want)


def test_checks(spark, tmp_path):
    _, edges = make(spark)
    graph.append_edges(edges, str(tmp_path / "g"), 9)
    graph.append_edges(edges, str(tmp_path / "g"), 9)
    assert spark.read.parquet(str(tmp_path / "g")).count() == 800
    with pytest.raises(Exception, match="doesn't fit"):
        graph.append_edges(edges, str(tmp_path / "h"), 5)
    with pytest.raises(Exception, match="doesn't fit"):
        graph.checked(edges, 9, weights=False).agg(F.sum("src")).collect()
    with pytest.raises(ValueError):
        graph.create_graph(spark, 0)
    assert graph.create_graph(spark, 3).count() == 0


def test_empty_graph(spark):
    none = spark.createDataFrame([], EDGE_SCHEMA)
    q = spark.createDataFrame([(1, 1, 5)], "qid bigint, node bigint, t bigint")
    assert [r.cut for r in sampler.cuts(none, q).collect()] == [0]
    assert sampler.sample_recent(none, q, 3).count() == 0 and graph.runs(none).count() == 0


def test_components_of_paths_and_rings(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 30)]
    got = {r.vertex: r.component for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("scores,want", [(([3, 4, 5], [0, 1, 2]), 1.0), (([0, 1, 2], [3, 4, 5]), 0.0), (([1, 1], [1, 1]), 0.5), (([1], []), None)])
def test_auc(spark, scores, want):
    rows = [(float(s), 1) for s in scores[0]] + [(float(s), 0) for s in scores[1]]
    assert metrics.roc_auc(spark.createDataFrame(rows, "score double, label int"), "score", "label").first()[0] == want


def test_ranking_of_one_tie_differs_between_conventions(spark):
    c = spark.createDataFrame([(0, 1, 10)], "above int, tied int, n int")
    assert metrics.ranking(c).first().r_at_1 == 0.0 and metrics.ranking_by_rank(c).first().r_at_1 == 1.0


def test_negatives_follow_degree(spark):
    rows = [(0, 1 if i % 4 else 2, i, 0, 1.0, i) for i in range(400)]
    train = linkpred.placed(spark.createDataFrame(rows, EDGE_SCHEMA))
    neg = linkpred.negatives(spark.createDataFrame([(i, 0) for i in range(200)], "qid bigint, src bigint"), train, 10)
    share = neg.where("dst = 1").count() / neg.count()
    assert neg.count() == 2000 and 0.7 < share < 0.8


def test_time_encoding(spark):
    v = np.array(spark.range(1).select(attention.time_encode(F.lit(12.5), 8)).first()[0])
    assert abs(v @ v - 1) < 1e-9  # a unit vector
    with pytest.raises(ValueError):
        attention.frequencies(7)
    m = attention.Tgat.create()
    assert np.allclose(m.encode(np.array([12.5]))[0], v)


def test_attention_ignores_masked_slots():
    m, g = attention.Tgat.create(), np.random.default_rng(0)
    own, others, delta = g.normal(size=(3, 8)), g.normal(size=(3, 4, 8)), g.random((3, 4))
    relation, mask = np.zeros((3, 4), int), np.array([[0, 0, 1, 1]] * 2 + [[0, 0, 0, 0]], bool)
    a = m.attend(own, others, delta, relation, mask)
    others[:, :2] = 99
    assert np.allclose(a, m.attend(own, others, delta, relation, mask))


def test_predictor_learns():
    g = np.random.default_rng(0)
    x = g.normal(size=(600, 6))
    y = ((x[:, 0] * x[:, 1]) > 0).astype(float)
    p = attention.fit_predictor(x[:400], y[:400])
    assert ((attention.predict(p, x[400:]) > 0) == (y[400:] > 0)).mean() > 0.8


def test_half_life(spark):
    f = lambda *c: studies.half_life(spark.createDataFrame([(h, m) for h, m in c], "horizon int, mean double")).first()[0]
    assert f((1, 0.0), (3, 4.0), (5, 4.0)) == 2.0 and f((1, 3.0), (2, 4.0)) == 0.0 and f((1, -1.0)) is None


@pytest.mark.parametrize("hot", [None, 3, 10**9])
def test_running_sums_of_hot_keys(spark, monkeypatch, hot):
    """By window, by range for hot keys only, and by window after a count: the same sums."""
    from chronoweave.functions import prefix

    if hot is not None:
        monkeypatch.setattr(prefix, "PART_BYTES", 1)
        monkeypatch.setattr(prefix, "HOT_ROWS", hot)
        monkeypatch.setattr(prefix, "parts_of", lambda df: 7)
    g = random.Random(4)
    rows = [(g.choice(["a"] * 6 + ["b", "c", None]), g.randrange(5), i, g.randrange(3)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    want, at = {}, {}
    for k, t, i, v in sorted((r for r in rows if r[0]), key=lambda r: r[:3]):
        at[k] = at.get(k, 0) + v
        want[i] = at[k]
    assert {r.i: r.s for r in prefix.running(df, ["k"], ["t", "i"], {"s": F.col("v")}).collect()} == want
    placed = {r.i: r.p for r in prefix.ranks(df, [], ["t", "i"], "p").collect()}
    assert [i for i, _ in sorted(placed.items(), key=lambda x: x[1])] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))] and sorted(placed.values()) == list(range(1, 121))
    assert prefix.running(df.limit(0), ["k"], ["t"], {"s": F.col("v")}).count() == 0 and prefix.ranks(df.limit(0), [], ["t"], "p").count() == 0


def test_link_predictor_on_planted_communities(spark):
    g = np.random.default_rng(3)
    side = np.arange(80) % 2
    emb = spark.createDataFrame([(n, 5, [float(v) for v in g.normal((2 * side[n] - 1) * np.ones(4), 1.0)]) for n in range(80)], "node bigint, t bigint, embedding array<double>")
    rows = [(int(a), int(b), 5) for a, b in g.integers(0, 80, (900, 2)) if side[a] == side[b]]
    held = [(int(a), int(b), 5, int(side[a] == side[b])) for a, b in g.integers(0, 80, (300, 2))]
    model = attention.fit_links(spark.createDataFrame(rows, "src bigint, dst bigint, t bigint"), emb, attention.Tgat.create(node_dim=4, time_dim=4))
    scored = attention.score(spark.createDataFrame(held, "src bigint, dst bigint, t bigint, label int"), emb, model)
    assert metrics.roc_auc(scored, "logit", "label").first().auc > 0.65
    assert attention.fit_links(spark.createDataFrame(rows[:0], "src bigint, dst bigint, t bigint"), emb, model) is model
