import datetime as dt
import math

import numpy as np

from skygrain.operators import spikes

COLUMNS = "obs_id long, platform string, at timestamp_ntz, radiance double, t string, source int"
ARGS = ("platform", "at", "radiance", "obs_id")


def rows(spark, items):
    return spark.createDataFrame([(i, p, at, v, "clash", 7) for i, (p, at, v) in enumerate(items)], COLUMNS)


def series(platform, n=400, level=200.0, scatter=1.0, seed=0, start=dt.datetime(2025, 10, 1)):
    rng = np.random.default_rng(seed)
    return [[platform, start + dt.timedelta(seconds=2 * i), float(level + scatter * rng.standard_normal())] for i in range(n)]


def found(spark, items):
    return {r[0] for r in spikes.implausible(rows(spark, items), *ARGS).collect()}


def test_limits_need_neither_time_nor_source(spark):
    items = [(None, None, -1.0), ("a", None, 0.0), (None, dt.datetime(2025, 1, 1), 501.0), ("a", None, math.nan), ("a", None, math.inf), ("a", None, None), ("a", None, 500.0)]
    assert found(spark, items) == {0, 1, 2, 3, 4}


def test_spikes_runs_and_steps(spark):
    items = series("a")
    items[100][2] = 260.0  # alone
    for i in (200, 201, 202):
        items[i][2] = 120.0  # with neighbours
    for i in range(300, 306):
        items[i][2] = 200.5  # six equal readings
    for i in range(350, 355):
        items[i][2] = 199.5  # five are no case
    step = series("b", seed=1)
    for i in range(200, 400):
        step[i][2] += 60.0  # a level that stays
    copies = [list(items[100]), list(items[302])]
    every = items + step + copies
    want = {100, 200, 201, 202, *range(300, 306), len(every) - 2, len(every) - 1}
    assert found(spark, every) == want


def test_spikes_beside_a_step(spark):
    items = series("a", 120)
    for i in range(60, 120):
        items[i][2] += 50.0
    for i in (50, 51, 52, 66):
        items[i][2] -= 90.0
    assert found(spark, items) == {50, 51, 52, 66}


def test_copies_do_not_make_a_run(spark):
    items = series("a", 50)
    items[10][2] = 201.25
    assert found(spark, items + [list(items[10])] * 8) == set()


def test_chunks_change_nothing(spark, monkeypatch):
    items = series("a", 900, seed=3)
    for i in (3, 299, 300, 301, 600, 890):
        items[i][2] = 300.0
    for i in range(446, 455):
        items[i][2] = 202.5
    whole = found(spark, items)
    for rows_of_a_chunk in (70, 150):
        monkeypatch.setattr(spikes, "CHUNK_ROWS", rows_of_a_chunk)
        assert found(spark, items) == whole == {3, 299, 300, 301, 600, 890, *range(446, 455)}


def test_every_reading_is_scored(spark):
    items = series("a", 300)
    items[50][2] = 400.0
    got = {r.t: r for r in spikes.score_readings(rows(spark, items), *ARGS).collect()}
    assert len(got) == 300 and all(0 < r.score <= 1 for r in got.values())
    assert max(got.values(), key=lambda r: r.score).v == 400.0


def test_impossible_readings_are_scored_by_the_forest(spark):
    items = series("a", 300)
    items[20][2], items[120][2], items[220][2] = math.nan, -3.0, 2000.0
    got = [r for r in spikes.score_readings(rows(spark, items), *ARGS).collect()]
    bad = [r for r in got if r.impossible]
    assert len(bad) == 3 and all(r.limit <= r.score < 1 for r in bad) and not any(r.spike for r in bad)


def test_the_forest_decides_how_far_is_too_far(spark, monkeypatch):
    items = series("a", 1200, seed=4)
    usual = np.median(np.abs([x[2] - 200.0 for x in items]))
    mild, wild = (100, 250, 400), range(50, 1150, 75)
    for k, times in ((wild, 30), (mild, 7.5)):
        for i in k:
            items[i][2] = float(200.0 + times * usual)
    assert found(spark, items) == set(wild) - set(mild)
    # Without it the direction alone would take the milder ones too.
    monkeypatch.setattr(spikes, "forest_score", lambda model, x: np.ones(len(x)))
    assert found(spark, items) >= {*mild, *wild}


def test_empty_and_short(spark):
    assert found(spark, []) == set()
    assert found(spark, [("a", dt.datetime(2025, 1, 1), 200.0)]) == set()
    assert found(spark, [(None, None, None)] * 3) == set()


def test_forest_against_brute_paths():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 5)).astype(np.float32)
    x[0] = 9
    model = spikes.fit_forest(x, 1)
    # Walk each tree by hand.
    for i in (0, 7, 99):
        total = 0.0
        for f, c, p in zip(model["feature"], model["cut"], model["path"]):
            node = 0
            for _ in range(spikes.DEPTH):
                node = 2 * node + 1 + int(x[i, f[node]] > c[node])
            total += p[node]
        assert np.isclose(spikes.forest_score(model, x)[i], 2 ** (-total / spikes.TREES / model["usual"]))
    s = spikes.forest_score(model, x)
    assert s.argmax() == 0 and np.median(s) < 0.5


def test_median_of_windows():
    rng = np.random.default_rng(2)
    w, keep = rng.standard_normal((50, 9)), rng.random((50, 9)) < 0.6
    want = [np.median(a[k]) if k.any() else np.nan for a, k in zip(w, keep)]
    assert np.allclose(spikes._median_of(w, keep), want, equal_nan=True)


def test_a_burst_is_cut_into_chunks_of_one_size(spark, monkeypatch):
    """All readings of an hour and more come within a second; no chunk outgrows its rows and halos."""
    monkeypatch.setattr(spikes, "CHUNK_ROWS", 100)
    start = dt.datetime(2025, 10, 1)
    items = [("a", start + dt.timedelta(microseconds=i), 200.0 + i % 7) for i in range(1000)] + [("a", start + dt.timedelta(days=i), 200.0) for i in range(1, 5)]
    r = rows(spark, items)
    chunks = spikes.featured(r.selectExpr("platform source", "unix_micros(cast(at as timestamp)) t", "radiance v", "obs_id o"), 0.0, 500.0, 0.01, 120.0)
    assert sorted(len(c.t) for c in chunks.collect()) == [4, *[100] * 10]
