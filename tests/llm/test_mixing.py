import math
import random

import numpy as np
from pyspark.sql import functions as F

from skygrain.functions.prefix import running_total
from skygrain.llm import mixing


def corpus(spark):
    rng = random.Random(0)
    word = lambda: rng.choice(["sensor", "light", "value", "record", "time"])
    rows = []
    for source, n in (("big", 300), ("mid", 60), ("small", 6)):
        rows += [(len(rows) + i, source, " ".join(word() for _ in range(rng.randrange(50, 400)))) for i in range(n)]
    rows += [(9001, None, "unlisted"), (9002, "big", None), (9003, "big", ""), (9004, "mid", "light " * 6000)]
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, source string, text string, tokens string, block int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "mix_id string, source string, weight double, max_repeats int")


MIXES = [("m", "big", 5.0, 1), ("m", "mid", 3.0, 2), ("m", "small", 2.0, 3), ("m", "nowhere", 0.5, 9), ("n", "big", 0.9, 2), ("n", "mid", 0.1, 1), ("n", None, 1.0, 1), ("n", "small", None, 1), (None, "big", 1.0, 1), ("n", "small", 0.0, 1)]


def test_mix(spark):
    sizes = mixing.sized(corpus(spark), "doc_id", "text", "source")
    plan, slots = mixing.schedule(sizes, targets(spark, MIXES))
    tokens = {r.source: r.t for r in sizes.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    rows = {(r.mix_id, r.source): r for r in mixing.report(plan, slots).collect()}
    assert set(rows) == {("m", "big"), ("m", "mid"), ("m", "small"), ("m", "nowhere"), ("n", "big"), ("n", "mid")}
    for (mix, source), r in rows.items():
        total = sum(w for m, s, w, _ in MIXES if m == mix and w and s)
        share = next(w for m, s, w, _ in MIXES if (m, s) == (mix, source)) / total
        size = sum(tokens.get(s, 0) for m, s, w, _ in MIXES if m == mix and w and s)
        assert abs(r.target_share - share) < 1e-12 and r.size == size
        assert r.short == (tokens.get(source, 0) * r.max_repeats < share * size)
        assert abs(r.slots_wanted - share * r.n_slots) < 3 + math.log(r.n_slots)
        assert r.drawn_tokens <= tokens.get(source, 0) * r.max_repeats
    # Empty slots of short sources go to those with blocks left: every slot is filled, once.
    filled = [(r.mix_id, r.slot) for r in slots.filter("filled").collect()]
    assert len(filled) == len(set(filled)) == sum({r.mix_id: r.n_slots for r in rows.values()}.values())
    assert rows["m", "big"].slots_for_others > 0 and rows["m", "small"].slots_for_others == 0
    # Every slot draws one block to the token, no text more often than allowed, and the sums agree.
    drawn = mixing.drawn(plan, slots, sizes)
    per_slot = drawn.groupBy("mix_id", "source", "slot").agg(F.sum("tokens").alias("t")).collect()
    assert len(per_slot) == len(filled) and all(r.t == rows[r.mix_id, r.source].block for r in per_slot)
    of = {r.doc: r.tokens for r in sizes.collect()}
    for r in drawn.groupBy("mix_id", "source", "doc", "repetition").agg(F.sum("tokens").alias("t")).collect():
        assert r.t <= of[r.doc] and r.repetition < rows[r.mix_id, r.source].max_repeats
    for r in drawn.groupBy("mix_id", "source").agg(F.sum("tokens").alias("t")).collect():
        assert r.t == rows[r.mix_id, r.source].drawn_tokens


def test_the_schedule_decides_who_falls_short(spark, monkeypatch):
    """With slots that all go to one source the others have none empty, and their exact tokens aren't asked."""
    docs = spark.createDataFrame([(i, "ab"[i % 10 == 0], "light value " * 300) for i in range(200)], "doc_id long, source string, text string")
    sizes, goals = mixing.sized(docs, "doc_id", "text", "source"), targets(spark, [("m", "a", 0.5, 1), ("m", "b", 0.5, 1)])
    short = lambda: {r.source for r in mixing.report(*mixing.schedule(sizes, goals)).filter("short").collect()}
    assert short() == {"b"}
    monkeypatch.setattr(mixing, "GOLDEN", 0.0)  # every point is 0: all slots ask source a
    assert short() == {"a"}


def test_golden_points_keep_to_their_bound():
    n, golden = 20_000, mixing.GOLDEN
    points = np.mod((np.arange(n) + 0.5) * golden, 1)
    rng = np.random.default_rng(0)
    for low, high in np.sort(rng.random((200, 2)), axis=1):
        inside = np.cumsum((points >= low) & (points < high))
        assert (np.abs(inside - (high - low) * np.arange(1, n + 1)) < 3 + np.log(np.arange(1, n + 1))).all()


def test_enough_of_each_reaches_the_shares(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "light value " * 300) for i in range(600)], "doc_id long, source string, text string")
    goals = targets(spark, [("m", "s0", 2.0, 3), ("m", "s1", 1.0, 3), ("m", "s2", 1.0, 3)])
    for r in mixing.report(*mixing.schedule(mixing.sized(docs, "doc_id", "text", "source"), goals)).collect():
        assert not r.short and abs(r.actual_share - r.target_share) < (3 + math.log(r.n_slots)) / r.n_slots


def test_running_total(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = {r.i: r.before for r in running_total(df, ["g"], F.floor(F.col("i") / 40), ["i"], F.col("v"), "before").collect()}
    total: dict = {}
    for g, i, v in rows:
        assert got[i] == total.get(g, 0)
        total[g] = total.get(g, 0) + v


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    sizes = mixing.sized(none, "doc_id", "text", "source")
    plan, slots = mixing.schedule(sizes, targets(spark, [("m", "a", 1.0, 1)]))
    assert [(r.source, r.short) for r in mixing.report(plan, slots).collect()] == [("a", False)]
    assert mixing.drawn(plan, slots, sizes).count() == 0
    assert mixing.report(*mixing.schedule(sizes, targets(spark, []))).count() == 0
