import random

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import bpe, splitting

TEXTS = {
    "empty": "", "short": "a" * 4000, "one word": "x" * 9001, "spaces": " " * 5000, "sentences": "This is one sentence. " * 400, "paragraphs": ("Word " * 150 + "\n\n") * 12,
    "headings": ("# Heading\n\n" + "Some text here. " * 120 + "\n\n") * 6, "crlf": ("line of text\r\n" * 50 + "\r\n") * 20, "wide": "日本語。" * 2000, "emoji": "👩🏽‍💼 " * 2000,
}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("limit,overlap", [(4000, 200), (300, 40), (50, 0)])
def test_pieces(name, limit, overlap):
    text = TEXTS[name]
    spans = splitting.spans(text, limit, overlap)
    assert "".join(text[s:e] for _, s, e, _ in spans) == text
    for (f0, s0, e0, _), (f, s, e, _) in zip(spans, spans[1:]):
        assert s == e0 and e - f <= limit and 0 <= s - f <= overlap and f >= f0
        # the repeated end begins with a word, unless there is none to begin with
        if f < s and f > 0 and not text[f].isspace():
            assert text[f - 1].isspace() or not any(c.isspace() for c in text[max(0, s - overlap) : s - 1])
    assert all(e - f <= limit for f, _, e, _ in spans)


def test_cuts_at_the_strongest_boundary():
    text = "A" * 90 + ". " + "B" * 90 + ".\n\n" + "C" * 90 + ". " + "D" * 90 + "."
    assert [splitting.BOUNDARIES[k] for *_, k in splitting.spans(text, 200, 0)] == ["paragraph", "section"]


def test_split_table(spark):
    rows = [(1, None), (2, ""), (3, "a" * 4000), (4, "b c " * 1001), (5, "é" * 4001)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("piece", F.lit(1)).withColumn("start", F.lit("x"))
    got = splitting.split_oversized(df, "doc_id", "text")
    assert {r.doc_id for r in got.collect()} == {4, 5} and got.agg(F.max(F.length("piece"))).first()[0] <= 4000
    assert splitting.split_oversized(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "doc_id", "text", 100, 60)


@pytest.fixture(scope="module")
def own():
    return bpe.load()


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(own, library):
    g = random.Random(0)
    letters = ["aeinorst", "abc  \n\t123.,'\"-_=<>", "éüßñçøžЖдкΩ日本語한글👍🏽", "aaaa    "]
    texts = ["<|endoftext|> a", "\x00\x7f", " ", "\r\n\r\n  x", "don't we'll I'VE", "a" * 3000, "ab" * 1500]
    texts += ["".join(g.choice(g.choice(letters)) for _ in range(g.randrange(1, 120))) for _ in range(600)]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids, t
        assert own.decode(ids).decode() == t and own.count(t) == len(ids)


def test_token_tables(spark, own):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (3, "hello world")], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    assert [(r.doc_id, r.ids) for r in bpe.encode_column(df, "doc_id", "text").orderBy("doc_id").collect()] == [(1, []), (2, []), (3, own.encode("hello world")), (3, own.encode("hello world"))]
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0
    assert {r.text for r in bpe.decode_column(bpe.encode_column(df, "doc_id", "text"), "doc_id").collect()} == {"", "hello world"}
    assert own.decode([]) == b""


def test_the_word_cache_is_bounded(own, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    own.words.clear()
    own.encode("one two three four five six seven")
    assert len(own.words) <= 3
