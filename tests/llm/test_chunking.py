import random

import pytest

from skygrain.llm import bpe, chunking


@pytest.fixture(scope="module")
def own():
    with open(bpe.DEFAULT_VOCABULARY, "rb") as f:
        return bpe.Encoder(f.read())


def texts():
    rng = random.Random(3)
    words = "the light sensor reads a value and keeps it for later use café 日本 naïve".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 25))).capitalize() + rng.choice(".!?")
    prose = "".join(sentence() + rng.choice([" ", " ", "\n", "\n\n"]) for _ in range(700))
    return [None, "", " \n", "short text.", prose, "word " * 5000, "漢字。" * 3000, "x" * 30_000, "é" * 9000, prose + "z" * 9000 + prose, "\n" * 8000, "!\n" * 4000]


def greedy(own, text, limit, overlap):
    """One cut after the other over the same boundaries."""
    total, nodes = chunking.boundaries(own, text, limit, overlap)
    if total <= limit:
        return [total] if total else []
    at, out = nodes[0], []
    while at[0] < total:
        at = max((n for n in nodes if at[0] < n[0] <= at[1] + limit), key=lambda n: n[0])
        out.append(at[0])
    return out


@pytest.mark.parametrize("limit,overlap", [(1024, 64), (100, 10)])
def test_pieces(spark, own, limit, overlap):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "pos long, body string, kind string, total int")
    got = chunking.pieces(df, "pos", "body", limit=limit, overlap=overlap).collect()
    tokens = {v: k for k, v in own.ranks.items()}
    by: dict = {}
    for r in got:
        by.setdefault(r.pos, []).append(r)
    for k, text in rows:
        mine = sorted(by.get(k, []), key=lambda r: r.piece)
        assert [r.end for r in mine] == greedy(own, text or "", limit, overlap)
        if not text:
            continue
        assert [r.piece for r in mine] == list(range(len(mine))) and mine[0].start == 0
        assert all(0 < r.n_tokens <= limit for r in mine)
        for a, b in zip(mine, mine[1:]):
            assert overlap <= a.end - b.start <= max(2 * overlap, overlap + 4)
        assert text.startswith(mine[0].piece_text) and text.endswith(mine[-1].piece_text)
        # Pieces are whole characters of the tokens they name, and these run to the end without a gap.
        ids = own.encode(text)
        for r in mine:
            assert b"".join(tokens[i] for i in ids[r.start : r.end]) == r.piece_text.encode()
        assert mine[-1].end == len(ids)


def test_natural_boundaries_come_first(spark, own):
    text = " ".join(["One sentence of some words here."] * 400)
    df = spark.createDataFrame([(1, text)], "k long, t string")
    r = chunking.cuts(df, "k", "t").collect()
    assert {x.kind for x in r} == {"sentence", "end"}


def test_empty(spark):
    assert chunking.pieces(spark.createDataFrame([], "k long, t string"), "k", "t").count() == 0
    with pytest.raises(ValueError):
        chunking.cuts(spark.createDataFrame([], "k long, t string"), "k", "t", limit=100, overlap=50)
