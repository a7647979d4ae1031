import random

import pandas as pd
import pytest
import tiktoken

from skygrain.llm import bpe


@pytest.fixture(scope="module")
def own():
    with open(bpe.DEFAULT_VOCABULARY, "rb") as f:
        return bpe.Encoder(f.read())


@pytest.fixture(scope="module")
def public(own):
    return tiktoken.Encoding("own", pat_str=bpe.WORDS, mergeable_ranks=own.ranks, special_tokens={})


ODD = ["", " ", "\n\n\n", "  a  b ", "<|endoftext|>", "don't we'll I'm", "naïve café — “quoted”", "日本語のテキスト。", "مرحبا بالعالم", "🙂👩‍👩‍👧", "a" * 3000, "ab" * 900, "0123456789" * 30, "​﻿\x00", "x\r\n\r\ny", "!" * 500, "é" * 200]


def test_odd_texts(own, public):
    for text in ODD:
        assert own.encode(text) == public.encode_ordinary(text), text[:30]
    assert own.encode(None) == []


def test_random_texts(own, public):
    rng = random.Random(7)
    letters = "abcdefghij  '’\n\t.,é漢字م🙂019"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(200)))
        assert own.encode(text) == public.encode_ordinary(text)


def test_both_merges_agree(own):
    rng = random.Random(1)
    for n in (2, 3, 17, 400):
        for _ in range(50):
            word = bytes(rng.choice(b"theinganderaaaa ") for _ in range(n))
            assert bpe.merge_short(word, own.ranks) == bpe.merge_long(word, own.ranks)


def test_memo_is_bounded(own, public, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    own.memo.clear()
    text = " ".join(f"word{i}" for i in range(50))
    assert own.encode(text) == public.encode_ordinary(text) and len(own.memo) <= 5


def test_table(spark, sf_dir, public):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    want = {k: public.encode_ordinary(t) if t else [] for k, t in zip(docs.doc_id, docs.text)}
    got = {r.doc_id: r.ids for r in bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").collect()}
    assert got == want


def test_rows_and_names(spark, public):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", None), (3, "a b", None)], "k long, body string, ids string")
    got = sorted((r.k, r.ids) for r in bpe.encode(df, "k", "body").collect())
    assert got == [(1, []), (2, []), (3, public.encode_ordinary("a b")), (3, public.encode_ordinary("a b"))]
    assert bpe.encode(df.limit(0), "k", "body").count() == 0
