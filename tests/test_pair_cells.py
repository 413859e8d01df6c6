"""Scores of pairs in cells: against brute force, with hubs in pieces, missing ids and many cells; what is shuffled doesn't follow the wedges."""

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from chronoweave.functions.portable import hash_int
from chronoweave.operators import pair_cells
from chronoweave.plans import adapters, load

QUERIES = load().queries
MEDIUM = "/root/testdata/sf0.01"


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("name, times", [("adamic_adar", 4), ("cold_warm_split", 4), ("ensemble_sweep", 8)])
def test_shuffles_a_few_times_the_input(spark, name, times):
    size = sum(os.path.getsize(f"{MEDIUM}/{t}.parquet") for t in ("orders", "lineitem"))
    before = shuffled(spark)
    QUERIES[name](spark, MEDIUM).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < times * size


def brute(links, train, asks, draws):
    """{(qid, slot): (common, adamic_adar, popularity)}"""
    near, degree = defaultdict(set), Counter()
    for a, b in links[:train]:
        degree[b] += 1
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for q in range(asks, len(links)):
        for slot, dst in [(-1, links[q][1]), *((s, links[at][1]) for s, at in draws[q])]:
            both = near[links[q][0]] & near[dst] if None not in (links[q][0], dst) else set()
            out[q, slot] = len(both), sum(1 / math.log(len(near[v]) + 2) for v in both), degree[dst] if dst is not None else 0
    return out


@pytest.mark.parametrize("cell_rows, train, asks", [(6_000_000, 700, 850), (40, 700, 850), (40, 700, 700), (40, 0, 900)])
def test_scores_are_those_of_brute_force(spark, monkeypatch, cell_rows, train, asks):
    monkeypatch.setattr(pair_cells, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(pair_cells, "DRAW_ROWS", 130)
    r = np.random.default_rng(1)
    big = 1 << 40
    name = lambda x: None if x == 7 else big - int(x) if x % 5 == 0 else -int(x) if x % 11 == 0 else int(x)
    links = [(name(a), name(3 if r.random() < 0.3 else b)) for a, b in zip(r.integers(0, 60, 1000), r.integers(0, 40, 1000))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(links)], "pos bigint, src bigint, dst bigint")
    at = F.pmod(hash_int(F.lit(0), F.col("q"), F.col("s")), F.lit(max(train, 1)))
    draws = defaultdict(list)
    if train:
        for x in spark.range(asks, len(links)).select(F.col("id").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("s")).select("q", "s", at.alias("at")).collect():
            draws[x.q].append((x.s, x.at))
    got = pair_cells.scores(df, train, asks, 4).collect()
    want = brute(links, train, asks, draws)
    assert len(got) == len(want)
    for x in got:
        common, score, popularity = want[x.qid, x.slot]
        assert (x.common, x.popularity, x.label) == (common, popularity, int(x.slot == -1))
        assert x.adamic_adar == pytest.approx(score, abs=1e-9)


def test_a_vertex_in_pieces_and_sums_in_parts(monkeypatch):
    r = np.random.default_rng(2)
    pairs = [(int(a) if r.random() < 0.6 else 5, int(b)) for a, b in zip(r.integers(0, 30, 400), r.integers(0, 50, 400))]
    rows = sorted([(a, 2, b, 0) for a, b in pairs] + [(b, 2, a, 1) for a, b in pairs] + [(v, g, 0, 0) for v in range(50) for g in (0, 1)])
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "g", "b", "i"])
    got = []
    for pack, most in ((3, 2), (10_000, 4_000_000)):
        monkeypatch.setattr(pair_cells, "PACK_ROWS", pack)
        monkeypatch.setattr(pair_cells, "SUM_ROWS", most)
        lists = [*pair_cells._lists(1)(batch.slice(i, 3) for i in range(0, len(rows), 3))]
        asked = [pair_cells.packed(pair_cells.steps(np.arange(1500) * 2), np.repeat(np.arange(30), 50), np.tile(np.arange(50), 30))]
        found = [*lists, *pair_cells._rows((0, pair_cells.PAIRS, x) for x in asked)]
        t = pa.Table.from_batches([*pair_cells._scored(2)(iter(found))]).sort_by("qid")
        got.append(t)
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = [len(near[a] & near[b]) for a in range(30) for b in range(50)]
    for t in got:
        assert t["common"].to_pylist() == want
        assert t["popularity"].to_pylist() == [sum(y == b for _, y in pairs) for _ in range(30) for b in range(50)]
    assert got[0]["adamic_adar"].to_pylist() == pytest.approx(got[1]["adamic_adar"].to_pylist())


def test_blocks_are_those_of_spark(spark):
    ids = [0, 1, -1, 5, 1 << 62, -(1 << 63), (1 << 63) - 1, *range(1000, 1200)]
    rows = spark.createDataFrame([(x,) for x in ids], "x bigint").select("x", F.pmod(F.xxhash64("x"), F.lit(7)).alias("h")).collect()
    assert pair_cells.block(np.array([r.x for r in rows]), 7).tolist() == [r.h for r in rows]


@pytest.mark.parametrize("train", [700, 0])
def test_shares_are_all_of_the_scores(spark, monkeypatch, train):
    monkeypatch.setattr(pair_cells, "CELL_ROWS", 40)
    monkeypatch.setattr(pair_cells, "SHARE_ROWS", 100)
    r = np.random.default_rng(3)
    links = [(None if a == 9 else int(a) - 5, None if b == 9 else int(b)) for a, b in r.integers(0, 40, (1000, 2))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(links)], "pos bigint, src bigint, dst bigint")
    shares = pair_cells.shares(df, train, 850, 4, 0, 3)
    assert len(shares) == 3
    got = [x for s in shares for x in s.collect()]
    assert all(s.select("qid").distinct().count() < 150 for s in shares)
    assert sorted(got, key=lambda x: (x.qid, x.slot)) == pair_cells.scores(df, train, 850, 4).orderBy("qid", "slot").collect()


def test_orders_meet_lines_in_shares(spark, monkeypatch):
    whole = adapters.trade_orders(spark, MEDIUM)
    monkeypatch.setattr(adapters.prefix, "PART_BYTES", 1000)
    shares = adapters.trade_orders(spark, MEDIUM)
    assert (len(whole), len(shares)) == (1, adapters.ORDER_SHARES)
    assert sorted(x for s in shares for x in s.collect()) == sorted(whole[0].collect())


def test_cold_warm_split_holds_a_share_of_its_shuffles(spark, monkeypatch):
    """What is shuffled between two writes, after which the shuffle files are removed."""
    monkeypatch.setattr(pair_cells, "SHARE_ROWS", 50_000, raising=False)
    held, write = [], DataFrameWriter.parquet

    def watched(self, *a, **k):
        before = shuffled(spark)
        write(self, *a, **k)
        held.append(shuffled(spark) - before)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    before = shuffled(spark)
    rows = QUERIES["cold_warm_split"](spark, MEDIUM)
    held.append(-sum(held))
    got = {tuple(x) for x in rows.collect()}
    held[-1] += shuffled(spark) - before
    size = sum(os.path.getsize(f"{MEDIUM}/{t}.parquet") for t in ("orders", "lineitem"))
    assert sum(n for _, _, n in got) == 11 * 9_000
    assert max(held) < 1.3 * size
    assert max(held[-4:]) < 0.3 * size  # three shares and the sum of their counts
