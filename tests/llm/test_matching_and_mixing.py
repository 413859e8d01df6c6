import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import matching, mixing

REF = [
    (1, "BROULMANIA"), (2, "BROULMANIA NAVY"), (3, "BROULMANIA SUPREME COURT"), (4, "TRUMGRA"), (5, "MINISTRY OF TRADE OF TRUMGRA"), (6, "TRUMGRA SUPREME COURT"), (7, "KLAENROL INTERNATIONAL MINING"),
    (8, "DOULBOQERK INTERNATIONAL MINING"), (9, "MINISTRY OF TRADE OF BROULMANIA"), (10, "THEIVEIRES CORPORATION"), (11, "ZHUTHQUR CORPORATION"), (12, "TRUMGRA NAVY"), (13, None), (14, " "),
]
TYPED = [
    ("broulmania", 1), ("THE BROULMANIA", 1), ("Broulmаnia", 1), ("BRÓULMANIA.", 1), ("BROULMANIAN", 1), ("BR0ULMANIA (GOV)", 1), ("NAVY, BROULMANIA", 2), ("BROULMANIANAVY", 2), ("supr. court trumgra", 6),
    ("TRUMGRASUPREME COURT", 6), ("OF TRADE OF TRUMGRA MINISTRY", 5), ("MINISTRY TRADE OF TRUMGRA", 5), ("MINISTRY_for_TRADE_OF_BROULMANAI", 9), ("KLAENROL INTL MINING", 7), ("klaenrol international mini", 7),
    ("KLAENROL INTERNATIONAL", 7), ("THEIVEIRES CORP", 10), ("ZHUTHQUR CO", 11), ("SUPREME COURT", -1), ("FISETHTRURKZHEI SUPREME COURT", -1), ("xyz", -1), ("0", -1), ("BROULMANIA MINING", -1),
]


@pytest.mark.parametrize("value,want", TYPED)
def test_typed(value, want):
    assert (matching.Matcher([(i, n) for i, n in REF]).best([value])[0] or (0, 0, -1))[2] == want


def test_the_tree_equals_brute_force():
    g = random.Random(0)
    words = ["".join(g.choice("abcd") for _ in range(g.randrange(1, 12))) for _ in range(200)] + ["x" * 70, "x" * 69 + "y"]
    tree = matching.BkTree(words)
    asked = ["".join(g.choice("abcde") for _ in range(g.randrange(0, 12))) for _ in range(60)] + ["x" * 68, ""]
    for r in (0, 1, 3):
        q, n, d = tree.within(asked, r)
        got = {(int(a), tree.strings[b]): int(c) for a, b, c in zip(q, n, d)}
        want = {(i, w): e for i, t in enumerate(asked) for w in tree.strings if (e := matching.levenshtein(t, w)) <= r}
        assert got == want
    assert matching.BkTree([]).within(["a"], 2)[0].size == 0


def test_map_values(spark):
    rows = [(v,) for v, _ in TYPED] * 2 + [(None,), ("",), ("  ",), ("\t\u00a0",)]
    values = spark.createDataFrame(rows, "value string").withColumn("ref_id", F.lit("x"))
    ref = spark.createDataFrame(REF, "ref_id bigint, name string")
    got = {r.value: r.ref_id for r in matching.map_values(values, ref).collect()}
    assert got == dict(TYPED)
    assert matching.map_values(values.limit(0), ref).count() == 0
    assert {r.ref_id for r in matching.map_values(values, ref.limit(0)).collect()} == {-1}


def real_names(spark, d):
    names = spark.read.parquet(f"{d}/gdelt_slices.parquet").select(F.col("actor1name").alias("value")).union(spark.read.parquet(f"{d}/corpus.parquet").select("src"))
    return names, spark.read.parquet(f"{d}/actor_ref.parquet").select("ref_id", "canonical_name")


def test_shards_give_the_same_rows_on_the_real_names(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_VALUES", 600)
    values, ref = real_names(spark, "/root/testdata/sf0.01")
    one, four = ({tuple(r) for r in matching.map_values(values, ref, shards=k).collect()} for k in (1, 4))
    assert one == four and len(one) > 2000 and sum(r[1] >= 0 for r in one) > 1500


def test_many_readings_are_taken_together_with_the_same_answer(spark, small):
    values, ref = real_names(spark, small)
    asked = sorted({r.value for r in values.collect() if r.value and r.value.strip()})[::5] + [v for v, _ in TYPED]
    entries = [tuple(r) for r in ref.collect()] + [(1000 + i, n) for i, n in REF]
    assert matching.Matcher(entries, most_readings=0).best(asked) == matching.Matcher(entries).best(asked)


def test_long_and_ambiguous_values_end():
    m = matching.Matcher(REF)
    assert m.best(["MI IN SU CO " * 4, "CO " * 5000, "x" * 100_000]) == [None, None, None]
    assert m.best(["TR OF MI OF TRUMGRA"])[0] == matching.Matcher(REF, most_readings=0).best(["TR OF MI OF TRUMGRA"])[0]


def docs(spark, n=3000, seed=0):
    g = random.Random(seed)
    rows = [(i, g.choice(["a"] * 6 + ["b", "b", "c", "other"]), g.randrange(1, 400)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


MIX = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("none", 0.1, 4), (None, 0.2, 1)]


def test_mixture(spark):
    mix = spark.createDataFrame(MIX, "source string, target_share double, max_repeats int")
    collection, rows = mixing.mix_documents(docs(spark), mix, block_tokens=500)
    got = {r.source: r for r in mixing.shares(collection, rows).collect()}
    for s, share in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert abs(got[s].actual_share - share) < 0.005 and got[s].most_repeats <= got[s].max_repeats
    assert got["none"].n_tokens == 0 and None not in got
    data = collection.toPandas()
    assert not data.duplicated(["doc_id", "repeat_no"]).any() and (data["n_tokens"] > 0).all()
    # any beginning of the schedule holds the shares as well
    data = data.sort_values(["slot", "at"])
    start = data.head(len(data) // 4)
    assert abs(start.loc[start["source"] == "a", "n_tokens"].sum() / start["n_tokens"].sum() - 0.5 / 0.9) < 0.03


def test_mixture_does_not_depend_on_partitions(spark):
    mix = spark.createDataFrame(MIX, "source string, target_share double, max_repeats int")
    a, b = (mixing.mix_documents(docs(spark).repartition(k), mix, 500)[0].toPandas().sort_values(["slot", "at", "doc_id"]).reset_index(drop=True) for k in (1, 7))
    assert a.equals(b)


def test_mixture_of_nothing(spark):
    mix = spark.createDataFrame(MIX, "source string, target_share double, max_repeats int")
    collection, rows = mixing.mix_documents(docs(spark).limit(0), mix)
    assert collection.count() == 0 and all(r.actual_share == 0 for r in mixing.shares(collection, rows).collect())
    collection, rows = mixing.mix_documents(docs(spark), mix.limit(0))
    assert collection.count() == 0 and rows == []


def test_slots_follow_the_weights(spark):
    rows = [{"source": "a", "weight": 0.7, "quota": 7_000_000}, {"source": "b", "weight": 0.3, "quota": 3_000_000}]
    slots = mixing.schedule(spark, rows, 1000).toPandas().sort_values("slot")
    share = (slots["source"] == "a").cumsum() / np.arange(1, len(slots) + 1)
    assert abs(share.iloc[200:] - 0.7).max() < 0.01
    assert (slots.groupby("source")["block"].apply(lambda b: sorted(b) == list(range(len(b))))).all()
