import random

import pytest
from pyspark.sql import functions as F

from skygrain.llm import asof_stream

TOLERANCE = 4_000_000


def brute(left, right):
    out = {}
    for e, t, k in left:
        if e is None or t is None or k is None:
            continue
        best = min(((abs(t - u), f) for g, u, f in right if g == e and u is not None and f is not None and abs(t - u) <= TOLERANCE), default=None)
        if best:
            out[k] = (best[1], best[0])
    return out


def run(spark, left, right):
    frame = lambda rows: spark.createDataFrame(rows, "entity string, t long, key long")
    got = asof_stream.nearest(frame(left), frame(right), TOLERANCE).collect()
    assert len(got) == len({r.key for r in got})
    return {r.key: (r.right_key, r.gap_us) for r in got}


def random_rows(seed, n=300):
    rng = random.Random(seed)
    at = lambda: 1_700_000_000_000_000 + rng.randrange(40) * 64_000_000 + rng.randrange(-9_000_000, 9_000_000)
    who = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    left = [(who(), at(), k) for k in range(n)]
    right = [(who(), at(), 10_000 + k) for k in range(n)]
    right += [(e, t, k + 5000) for e, t, k in right[:50]]  # equally near
    left += [("a", None, 9001), ("a", 1_700_000_000_000_000, 9002), ("a", 1_700_000_004_000_000, 9003), ("zz", 5, 9004)]
    right += [("a", None, 20_001), ("zz", 4_000_005, 20_002), ("zz", -3_999_995, 20_003)]
    return left, right


def test_against_brute_force(spark):
    left, right = random_rows(1)
    assert run(spark, left, right) == brute(left, right)


def test_many_slices(spark, monkeypatch):
    """Small slices move the watermark with every batch; no row may be lost at a slice's border."""
    monkeypatch.setattr(asof_stream, "ROWS_PER_CORE", 120 // spark.sparkContext.defaultParallelism)
    left, right = random_rows(2)
    spaced = lambda rows: [(e, t and t + (k % 7) * 3_600_000_000, k) for e, t, k in rows]
    left, right = spaced(left), spaced(right) + right
    assert run(spark, left, right) == brute(left, right)


def test_slices_grow_with_the_cluster(spark, monkeypatch, tmp_path):
    """Borders lie at equal counts; as many rows per core give as many slices."""
    every = spark.range(4000).select(F.lit("a").alias("entity"), F.lit(0).cast("long").alias("cell"), (F.col("id") * 1000).alias("t"), F.col("id").alias("key"), F.lit(0).alias("side"))
    cores = spark.sparkContext.defaultParallelism
    for k, rows in enumerate((every, every.unionByName(every))):
        monkeypatch.setattr(asof_stream, "ROWS_PER_CORE", rows.count() // (4 * cores))
        slices = asof_stream._staged(rows, 50_000, str(tmp_path / str(k)))
        sizes = [spark.read.parquet(str(tmp_path / str(k) / f"slice={s}")).count() for s in slices]
        assert len(slices) in (4, 5) and max(sizes) <= rows.count() / 4 + 100 and sum(sizes) == rows.count()


@pytest.mark.parametrize("left,right", [([], []), ([("a", 1, 1)], []), ([], [("a", 1, 1)])])
def test_empty(spark, left, right):
    assert run(spark, left, right) == {}
