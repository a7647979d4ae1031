import datetime as dt
import math

import numpy as np

from skygrain.operators import regrid

START = dt.datetime(2025, 10, 1)
COLUMNS = "cell_id long, hour timestamp_ntz, mean double, n int, source string, t int, y double"
ARGS = ("cell_id", "hour", "mean", "n")


def frame(spark, items):
    return spark.createDataFrame([(c, t, m, n, "clash", 1, 2.0) for c, t, m, n in items], COLUMNS)


def at(hours):
    return START + dt.timedelta(hours=hours)


def slots(spark, items):
    base = int((START - dt.datetime(1970, 1, 1)).total_seconds() // 3600)
    return {(r[0], r[1] - base) for r in regrid.missing_hours(frame(spark, items), *ARGS).collect()}


def test_missing_hours(spark):
    items = [(1, at(0.2), 200.0, 3), (1, at(1.9), 201.0, 1), (1, at(1.9), 201.0, 1), (1, at(2.5), math.nan, 5), (1, at(3.5), 0.0, 5), (1, at(4.5), 501.0, 5), (1, at(5.5), 200.0, 0), (1, at(6.0), 202.0, 2), (1, at(9.0), None, 2), (1, at(8.0), 200.0, None)]
    items += [(2, at(0), 100.0, 1), (None, at(1), 100.0, 1), (2, None, 100.0, 1), (3, at(0), math.inf, 1)]
    assert slots(spark, items) == {(1, h) for h in (2, 3, 4, 5)}


def test_months_have_their_own_grids(spark):
    items = [(1, at(24 * 30 + 22), 100.0, 1), (1, at(24 * 31 + 3), 100.0, 1), (1, at(24 * 31 + 5), 100.0, 1)]
    assert slots(spark, items) == {(1, 24 * 31 + 4)}


def test_smoother_against_dense_solution():
    """The state-space smoother equals the Gaussian conditional mean of the same process, built as one dense system."""
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 20, 14))
    y = np.where(rng.random(14) < 0.6, 100 + rng.standard_normal(14), np.nan)
    y[3] = 101.0
    r, ql, qs = np.full(14, 0.5), 0.3, 0.05
    level, var = regrid.smooth(t, y, r, ql, qs)
    seen = np.flatnonzero(~np.isnan(y))
    wide = np.var(y[seen]) + r[seen[0]] + 1.0
    n = len(t)
    mean, cov = np.zeros(2 * n), np.zeros((2 * n, 2 * n))
    f = [None] * n
    q = [None] * n
    mean[:2] = [y[seen[0]], 0]
    cov[:2, :2] = np.diag([10 * wide, wide])
    for i in range(1, n):
        d = t[i] - t[i - 1]
        f[i] = np.array([[1, d], [0, 1]])
        q[i] = np.array([[ql * d + qs * d**3 / 3, qs * d**2 / 2], [qs * d**2 / 2, qs * d]])
        mean[2 * i : 2 * i + 2] = f[i] @ mean[2 * i - 2 : 2 * i]
        for j in range(i):
            c = f[i] @ cov[2 * i - 2 : 2 * i, 2 * j : 2 * j + 2]
            cov[2 * i : 2 * i + 2, 2 * j : 2 * j + 2], cov[2 * j : 2 * j + 2, 2 * i : 2 * i + 2] = c, c.T
        cov[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = f[i] @ cov[2 * i - 2 : 2 * i, 2 * i - 2 : 2 * i] @ f[i].T + q[i]
    h = 2 * seen
    k = cov[:, h] @ np.linalg.inv(cov[np.ix_(h, h)] + np.diag(r[seen]))
    want, spread = mean + k @ (y[seen] - mean[h]), cov - k @ cov[h]
    assert np.allclose(level, want[::2], atol=1e-6) and np.allclose(var, np.diag(spread)[::2], atol=1e-6)


def test_filled_values_are_near_held_out_ones(spark):
    rng = np.random.default_rng(4)
    truth = lambda h: 200 + 20 * math.sin(h / 24 * 2 * math.pi)
    items = [(1, at(h + 0.5), truth(h + 0.5) + rng.standard_normal(), 5) for h in range(300) if h % 7]
    got = {r.slot: r for r in regrid.regular(frame(spark, items), *ARGS).collect()}
    base = min(got) - 1
    error = [abs(got[s].value - truth(s - base)) for s in got if got[s].missing]
    assert len(error) == 42 and np.mean(error) < 2.5
    sure = np.mean([r.std for r in got.values() if not r.missing])
    assert np.mean([r.std for r in got.values() if r.missing]) > sure


def test_a_long_gap_is_unsure_in_its_middle(spark):
    rng = np.random.default_rng(5)
    items = [(1, at(h + 0.5), 200 + rng.standard_normal(), 5) for h in range(200) if not 100 <= h < 130]
    got = {r.slot: r for r in regrid.regular(frame(spark, items), *ARGS).collect()}
    base = min(got)
    sure = np.median([r.std for r in got.values() if not r.missing])
    std = [got[base + h].std for h in range(100, 130)]
    assert all(got[base + h].missing for h in range(100, 130)) and std[15] > 2 * sure and std[15] > std[3] and std[15] > std[26]


def test_side_by_side_is_one_by_one():
    """Series of several lengths in one batch, padded, give what each gives alone."""
    rng = np.random.default_rng(7)
    many = []
    for n in (30, 11, 2, 19):
        t = np.sort(rng.uniform(0, 40, n))
        y = np.where(rng.random(n) < 0.5, rng.standard_normal(n), np.nan)
        y[n // 2] = 1.0
        many.append((t, y, rng.uniform(0.1, 1, n), *rng.uniform(0.01, 1, 2)))
    pad = lambda x, v: np.r_[x, np.full(30 - len(x), v)]
    level, var = regrid.smooth_many(np.array([pad(t, t[-1]) for t, *_ in many]), np.array([pad(m[1], np.nan) for m in many]), np.array([pad(m[2], 0.0) for m in many]), *np.array([m[3:] for m in many]).T)
    for k, m in enumerate(many):
        one, spread = regrid.smooth(*m)
        assert np.allclose(level[k, : len(one)], one) and np.allclose(var[k, : len(one)], spread)


def test_buckets_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    items = [(c, at(float(h)), 100 + 10 * c + rng.standard_normal(), 1) for c in range(12) for h in np.sort(rng.uniform(0, 24 * 40, 40 + 5 * c))]
    rows = lambda: sorted((r.source, r.slot, round(r.value, 6), round(r.std, 6), r.missing, r.n_readings) for r in regrid.regular(frame(spark, items), *ARGS).collect())
    want = rows()
    monkeypatch.setattr(regrid, "BUCKET_BINS", 60)
    monkeypatch.setattr(regrid, "SIDE_BY_SIDE", 3)
    assert rows() == want


def test_empty(spark):
    assert regrid.regular(frame(spark, []), *ARGS).count() == 0
