"""Small anchors of the reference's own operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygrain.functions.exprs import finite, haversine_km, lon180
from skygrain.operators import grid, nearby, quality, series, stats
from skygrain.operators.model import folds, kriging, linear


def test_quality_mask(spark):
    v = [-37.2, 0.0, 1.0, 500.0, 500.000001, 91912.7, math.inf, math.nan, None]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    assert [r.x for r in df.filter(quality.in_range(F.col("x"))).collect()] == [1.0, 500.0]
    report = {r.reason: r.n_rows for r in quality.rejections(spark.createDataFrame([(-1.0,), (0.0,), (9e4,), (math.inf,), (math.nan,)], "x double"), F.col("x")).collect()}
    assert report == {"nonfinite": 2, "at_or_below_min": 2, "above_max": 1}


def test_dedup_and_dead_groups(spark):
    df = spark.createDataFrame([(1, 5, 381.562231), (1, 6, 380.908871), (2, 1, 100.0), (2, 2, 87000.0)], "t int, o int, v double")
    assert sorted((r.t, r.v) for r in quality.first_of(df, ["t"], ["o"]).collect()) == [(1, 381.562231), (2, 100.0)]
    assert [r.t for r in quality.conflicts(df, ["t"], "v").collect()] == [2]
    files = spark.createDataFrame([("a", 0.0)] * 30 + [("b", 0.0)] * 29 + [("b", 120.0)] + [("c", 0.0)] * 1500, "f string, v double")
    assert [r.f for r in quality.dead_groups(files, "f", "v").collect()] == ["a"]


def test_snapping(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (1.5,), (359.9,), (-0.1,)], "x double")
    r = df.select(grid.cell_index(F.col("x"), 0.0, 1.0).alias("c"), grid.wrapped_index(F.col("x"), 0.0, 1.0).alias("w"), grid.nearest_value(F.col("x"), [0, 1, 3]).alias("n")).collect()
    assert [x.c for x in r] == [0, 0, 2, 360, 0]
    assert [x.w for x in r] == [0, 0, 2, 0, 0]
    assert [x.n for x in r] == [0.0, 0.0, 1.0, 3.0, 0.0]


def test_circular_and_distance(spark):
    df = spark.createDataFrame([(23.0,), (1.0,)], "h double")
    assert abs(df.agg(grid.circular_mean(F.col("h"), 24.0)).first()[0] % 24) < 1e-9
    d = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)), lon180(F.lit(180.0)), lon180(F.lit(-190.0)), finite(F.lit(None).cast("double"))).first()
    assert math.isclose(d[0], 6371.0088 * math.pi / 2, rel_tol=1e-12) and tuple(d[1:]) == (-180.0, 170.0, False)


def test_bracketing(spark):
    t0 = dt.datetime(2025, 1, 1, 0, 59, 58)
    track = [("a", t0, 10.0, 1), ("a", t0 + dt.timedelta(seconds=10), 20.0, 2), ("a", t0 + dt.timedelta(seconds=10), 99.0, 5), ("a", t0 + dt.timedelta(seconds=400), 30.0, 3), ("b", t0, 1.0, 4)]
    track = spark.createDataFrame(track, "p string, at timestamp_ntz, lat double, k int")
    samples = spark.createDataFrame([(i, "a", t0 + dt.timedelta(seconds=s)) for i, s in enumerate((-1, 0, 1, 5, 10, 200, 9000))], "i int, p string, at timestamp_ntz")
    got = {r.i: r.lat for r in series.interpolated(series.bracketed(samples, track, "p", "at", "k", ["lat"]), ["lat"], 60_000_000).collect()}
    assert got == {0: None, 1: 10.0, 2: 11.0, 3: 15.0, 4: 20.0, 5: None, 6: None}
    # Only the nearer fix counts, however far the other one is, also across slices.
    near = {r.i: r.lat for r in series.interpolated(series.bracketed(samples, track, "p", "at", "k", ["lat"]), ["lat"], 250_000_000).collect()}
    assert near == {**got, 5: 20.0 + 10.0 * 190 / 390}


def test_percentiles_against_numpy(spark, monkeypatch):
    from skygrain.functions import skew
    from skygrain.operators import stats

    rng = np.random.default_rng(1)
    values = {"a": rng.standard_normal(999), "b": rng.integers(0, 3, 400).astype(float), "c": np.array([5.0])}
    rows = [(g, float(v)) for g, x in values.items() for v in x] + [("a", math.nan), ("a", None), ("none", math.inf)]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = {"low": 0.0, "q": 0.25, "mid": 0.5, "high": 0.99, "top": 1.0}
    for r in stats.percentiles(df, ["g"], "v", ps).collect():
        assert all(math.isclose(r[n], np.quantile(values[r.g], p), abs_tol=1e-12) for n, p in ps.items())
    one = stats.percentiles(df, [], "v", ps).collect()
    assert len(one) == 1 and math.isclose(one[0].mid, np.median(np.concatenate(list(values.values()))))
    assert stats.percentiles(df.limit(0), ["g"], "v", ps).count() == 0
    # Ranks are the same whether or not rows of frequent values stay where they are.
    want = {(r.g, repr(r.v)): r.rank for r in stats.ranked(df, ["g"], "v", "rank").collect()}
    lows = {r.g: r.mid for r in stats.percentiles(df, ["g"], "v", ps).collect()}
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    monkeypatch.setattr(stats, "STRETCH_VALUES", 100)
    assert {r.g: r.mid for r in stats.percentiles(df, ["g"], "v", ps).collect()} == lows
    got = stats.ranked(df, ["g"], "v", "rank").collect()
    assert {(r.g, repr(r.v)): r.rank for r in got} == want and len(got) == len(rows) - 1


def test_polynomial_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(2025, 2026, 300)
    y = 3 - 2 * (x - 2025) + 5 * (x - 2025) ** 2 + 0.1 * rng.standard_normal(300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x - 2025, y)], "x double, y double")
    got = series.polynomial(df, F.col("x"), F.col("y"), 2)
    assert np.allclose(got["coefficients"], np.polyfit(x - 2025, y, 2)[::-1], atol=1e-8) and got["n"] == 300 and got["r2"] > 0.9
    at = df.select(series.evaluated(got["coefficients"], F.col("x")).alias("p")).first().p
    assert math.isclose(at, np.polyval(got["coefficients"][::-1], float(x[0] - 2025)))
    with pytest.raises(ValueError):
        series.polynomial(df.limit(2), F.col("x"), F.col("y"), 2)


def test_week_buckets(spark):
    days = spark.createDataFrame([(dt.date(2025, 10, 6),), (dt.date(2025, 10, 7),), (dt.date(2025, 10, 13),)], "d date")
    assert [str(r[0]) for r in days.select(series.bucket(F.col("d"), "week")).collect()] == ["2025-10-06", "2025-10-13", "2025-10-13"]


def test_autocorrelation(spark):
    x = [math.sin(i) for i in range(40)]
    s = spark.createDataFrame([(i, v) for i, v in enumerate(x) if i not in (7, 20)] + [(7, math.nan)], "i long, x double")
    got = {r.lag: r for r in series.autocorrelation(s, "i", "x", 3).collect()}
    a = [(x[i], x[i - 2]) for i in range(2, 40) if not {i, i - 2} & {7, 20}]
    assert got[2].n_pairs == len(a) and math.isclose(got[2].autocorrelation, np.corrcoef(np.array(a).T)[0, 1], rel_tol=1e-9)


def test_ranks(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, 1.0)], "k int, v double")
    assert sorted(r.r for r in stats.ranked(df, ["k"], "v", "r").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_sampled_pairs_are_linear(spark):
    df = spark.createDataFrame([(i, 1, 1.0 * i % 80, 2.0 * i % 170, float(i)) for i in range(200)], "k long, g int, lat double, lon double, v double")
    p = stats.sampled_pairs(df, "g", "k", "lat", "lon", ["v"]).collect()
    assert len(p) == 3 * 200 - 6 and all(r.left_k != r.right_k for r in p)
    assert len({frozenset((r.left_k, r.right_k)) for r in p}) == len(p)


def test_time_blocks(spark):
    df = spark.createDataFrame([(i,) for i in range(10)] * 2, "t int")
    assert [r.time_block for r in folds.time_blocks(df, "t", 4).orderBy("t").collect()] == [math.floor(i * 4 / 10) for i in range(10)]


def test_fold_sums(spark):
    items = [(s, t, float(s * 10 + t)) for s in range(3) for t in range(2) for _ in range(s + t + 1)]
    df = spark.createDataFrame(items, "s int, t int, v double")
    for r in folds.fold_sums(df, "s", "t", {"v": F.col("v")}).collect():
        assert math.isclose(r.train_v, sum(v for s, t, v in items if s != r.s and t != r.t))


def test_lasso_and_ridge(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.standard_normal(400) + 5
    df = spark.createDataFrame([(i % 5, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "f long, a double, b double, c double, y double")
    w, c, alpha = linear.fit_lasso(linear.moments(df, linear.plain_design(["a", "b", "c"]), "y", "f"))
    assert np.allclose(w, [2, -1, 0], atol=0.05) and abs(c - 5) < 0.05 and alpha < 0.1
    design = linear.plain_design(["a", "b", "c"])
    fit = linear.fit_ridges(df, design, "y", "f", {"all": set(range(5))})["all"]
    z = (x - fit["mean"]) / fit["scale"]
    h = np.einsum("ij,jk,ik->i", z, fit["inverse"], z) + 1 / 400
    loo = (((y - fit["ybar"] - z @ fit["b"]) / (1 - h)) ** 2).sum()
    for a in (fit["alpha"] * 3, fit["alpha"] / 3):
        inv = np.linalg.inv(z.T @ z + a * np.eye(3))
        other = (((y - y.mean() - z @ inv @ z.T @ (y - y.mean())) / (1 - np.einsum("ij,jk,ik->i", z, inv, z) - 1 / 400)) ** 2).sum()
        assert loo <= other + 1e-6


def test_splines():
    x = np.linspace(-1, 6, 50)
    b = linear.bspline(x, np.array([0.0, 1, 2, 3, 4, 5]))
    assert b.shape[1] == 7 and (b >= -1e-12).all() and (b.sum(axis=1) <= 1 + 1e-9).all()
    assert np.allclose(b[x <= 0], b[np.argmin(np.abs(x))], atol=0.6)


def test_kriging():
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 100, (80, 4))
    v = {"nugget": 0.0, "psill": 1.0, "reach": 120.0}
    y = np.sin(p[:, 0] / 20)
    mean, var = kriging.krige(p, y, p[:5], v)
    assert np.allclose(mean, y[:5], atol=1e-6) and np.allclose(var, 0, atol=1e-6)
    held, _ = kriging.krige(p[10:], y[10:], p[:10], v)
    assert np.abs(held - y[:10]).mean() < np.abs(y[:10] - y[10:].mean()).mean()
    fit = kriging.fit_variogram([(d, float(kriging.spherical(np.array([d]), 0.2, 1.0, 500.0)[0]), 100) for d in (50, 150, 250, 350, 450, 600, 900)])
    assert abs(fit["nugget"] - 0.2) < 0.05 and abs(fit["psill"] - 1) < 0.05 and abs(fit["reach"] - 500) < 40


def test_scratch_follows_the_setting(spark):
    from skygrain.sources import scratch

    assert scratch.written(spark.range(3), "x").count() == 3
    setting = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch.new_path(spark, "x").startswith(setting.rstrip("/") if setting else "file:///tmp/spark-")


def test_bad_radius(spark):
    with pytest.raises(ValueError):
        nearby.pairs_within(spark.range(1), "id", "id", "id", "id", 0, 1)


def test_registry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, timeout=120)
