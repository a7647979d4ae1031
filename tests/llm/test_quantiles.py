import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygrain.llm import quantiles

P = [0.0, 0.25, 0.5, 0.9, 1.0]


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(g, v, "clash") for g, v in rows], "g string, v double, value string").repartition(parts)
    got = {(r.g, r.p): (r.value, r.n) for r in quantiles.select(quantiles.counts(df, ["g"], F.col("v")), ["g"], P).collect()}
    groups: dict = {}
    for g, v in rows:
        if v is not None and math.isfinite(v):
            groups.setdefault(g, []).append(v)
    assert set(got) == {(g, p) for g in groups for p in P}
    for g, values in groups.items():
        for p in P:
            assert got[g, p][1] == len(values)
            assert math.isclose(got[g, p][0], float(np.quantile(values, p)), rel_tol=1e-12, abs_tol=1e-12), (g, p)


def rows(seed=0):
    rng = np.random.default_rng(seed)
    out = [("wide", float(v)) for v in rng.standard_normal(500)]
    out += [("ties", float(v)) for v in rng.integers(0, 4, 300)]
    out += [("most", 7.0)] * 300 + [("most", float(v)) for v in rng.uniform(0, 7, 99)]
    out += [("top", 9.0)] * 61 + [("top", float(v)) for v in range(61)]
    out += [("one", 3.5), (None, 1.0), (None, 2.0), ("none", None), ("none", math.nan), ("none", math.inf), ("wide", math.nan), ("wide", -math.inf)]
    return out


def test_against_numpy(spark):
    check(spark, rows())


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_parts_change_nothing(spark, monkeypatch, parts):
    """Equal results whatever the number of parts that propose medians, and of those that a target's values are in."""
    if parts == 3:
        monkeypatch.setattr(quantiles, "PART_VALUES", 40)
    proposals = []
    kept = quantiles._pivots
    monkeypatch.setattr(quantiles, "_pivots", lambda live: proposals.append(live.rdd.getNumPartitions()) or kept(live))
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 27 if parts == 1 else 1000)
        check(spark, rows(1), parts)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len(proposals) > 4 and (proposals[0] >= parts if parts > 1 else max(proposals) == 1)


def test_small_groups_go_through_the_rounds(spark, monkeypatch):
    rounds = []
    kept = quantiles._pivots
    monkeypatch.setattr(quantiles, "_pivots", lambda live: rounds.append(1) or kept(live))
    check(spark, [("a", float(v)) for v in range(50)])
    assert len(rounds) >= 4


def test_days_join(spark):
    rng = np.random.default_rng(2)
    days = [rng.gamma(2.0, 30, 200 + 50 * k) for k in range(3)]
    tables = [quantiles.counts(spark.createDataFrame([("a", k, float(v)) for v in d], "g string, day int, v double"), ["g", "day"], F.col("v")) for k, d in enumerate(days)]
    got = {r.p: r.value for r in quantiles.select(quantiles.merged(tables, ["g"]), ["g"], P).collect()}
    assert all(math.isclose(got[p], float(np.quantile(np.concatenate(days), p)), rel_tol=1e-12) for p in P)


def test_no_groups_and_empty(spark):
    one = quantiles.select(quantiles.counts(spark.range(1, 10), [], F.col("id")), [], [0.5]).collect()
    assert [(r.p, r.value, r.n) for r in one] == [(0.5, 5.0, 9)]
    none = spark.createDataFrame([], "g string, v double")
    assert quantiles.select(quantiles.counts(none, ["g"], F.col("v")), ["g"], P).count() == 0
    with pytest.raises(ValueError):
        quantiles.select(quantiles.counts(none, ["g"], F.col("v")), ["g"], [1.5])
