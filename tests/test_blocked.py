import numpy as np

from skygrain.operators.model import blocked, forest, kriging
from skygrain.plans import modelling


def test_forest():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 60, (4000, 9)).astype(np.uint8)
    y = np.sin(x[:, 0] / 10) + x[:, 1] / 40 + rng.normal(0, 0.2, 4000)
    tree, bag, leaf = forest.grow(x, y, np.random.default_rng(2), 6, 5, 3)
    assert (forest.leaves(tree, x[bag], 6) == leaf).all()
    weight = np.random.default_rng(2).poisson(1.0, 4000)[bag]
    assert np.bincount(leaf, weight)[np.unique(leaf)].min() >= 5
    assert np.allclose(tree[3][leaf], (np.bincount(leaf, weight * y[bag]) / np.maximum(np.bincount(leaf, weight), 1))[leaf])
    fitted, mean, variance = forest.fit_predict(x[:3000], y[:3000], x[3000:], [3])
    assert np.mean((mean - y[3000:]) ** 2) < 0.35 * y.var() and np.mean((fitted - y[:3000]) ** 2) < 0.2 * y.var() and (variance > 0).all()


def test_blocks_of_kriging_with_equal_points():
    rng = np.random.default_rng(4)
    train, at = np.round(rng.uniform(0, 7000, (900, 4)), -2), rng.uniform(0, 7000, (40, 4))
    train[450:] = train[:450]  # each twice
    y = np.r_[rng.normal(size=450)]
    y = np.r_[y, y]
    for v in ({"nugget": 0.3, "psill": 1.0, "reach": 3000.0}, {"nugget": 0.0, "psill": 1.0, "reach": 3000.0}):
        ((mean, var),) = kriging.krige_blocks(train, at, [(y, v)], 2000.0, 16)
        for i, p in enumerate(at):
            near = train[(np.abs(np.floor(train / 2000) - np.floor(p / 2000)) <= 1).all(axis=1)]
            values = y[(np.abs(np.floor(train / 2000) - np.floor(p / 2000)) <= 1).all(axis=1)]
            if len(near) < 3:
                assert mean[i] == 0 and np.isnan(var[i])
                continue
            o = np.argsort(((near - p) ** 2).sum(axis=1), kind="stable")[:16]
            k = len(o)
            m, r = np.ones((k + 1, k + 1)), np.ones(k + 1)
            m[:k, :k] = kriging.spherical(np.sqrt(((near[o][:, None] - near[o]) ** 2).sum(axis=2)), **v)
            m[k, k], r[:k] = 0, kriging.spherical(np.sqrt(((near[o] - p) ** 2).sum(axis=1)), **v)
            w = np.linalg.pinv(m) @ r
            assert abs(w[:k] @ values[o] - mean[i]) < 1e-8 and abs(max(w @ r, 0) - var[i]) < 1e-8


def test_tasks_agree_with_jobs_per_block(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(modelling, "TREES", 3)
    monkeypatch.setattr(modelling, "_forest", lambda train, f=modelling._forest: f(train, 3))
    some = modelling._blocks
    monkeypatch.setattr(modelling, "_blocks", lambda m: some(m)[3:5])
    gam = lambda: {(r.fold, r.row_id): r for r in modelling.kriging_predict(spark, sf_dir).filter("model = 'gam'").collect()}
    got = gam()
    monkeypatch.setattr(modelling, "ROWS_IN_TASK", 0)
    want = gam()
    assert got and got.keys() == want.keys()
    for k, a in want.items():
        for c in ("v", "mean_prediction", "kriged_prediction", "mean_variance", "kriging_variance"):
            assert (a[c] is None) == (got[k][c] is None) and (a[c] is None or abs(a[c] - got[k][c]) <= 1e-6 * abs(a[c])), (k, c)


def test_benchmark_has_no_pass_and_no_task_for_two_blocks(spark, sf_dir, monkeypatch):
    def no(*_):
        raise AssertionError("a pass per block")

    monkeypatch.setattr(modelling, "TREES", 3)
    monkeypatch.setattr(modelling, "_forest_mean", no)
    tasks, kept = [], blocked.predicted
    monkeypatch.setattr(blocked, "predicted", lambda *a: (tasks.append(kept(*a).rdd.getNumPartitions()), kept(*a))[1])
    got = modelling.kriging_benchmark(spark, sf_dir).collect()
    blocks = {r.fold for r in got}
    assert tasks[0] >= len(blocks) > 1 and len(got) == 4 * len(blocks)


def test_codes_are_counted_once(monkeypatch):
    counted, kept = [0], np.bincount
    monkeypatch.setattr(np, "bincount", lambda a, *b, **c: (counted.__setitem__(0, counted[0] + len(a)), kept(a, *b, **c))[1])
    for codes in (30, 200):
        rng = np.random.default_rng(5)
        n, plain = 6000, 5
        x, code = rng.integers(0, 64, (n, plain)).astype(np.uint8), rng.integers(0, codes, n)
        onehot = list((np.arange(codes)[:, None] == code).astype(np.uint8))
        y = x[:, 0] / 30 + rng.normal(size=codes)[code] + rng.normal(0, 0.1, n)
        wide, counted[0] = np.column_stack([x, *onehot]), 0
        want = forest.fit_predict(wide, y, wide[:500], [7], trees=4, depth=8)
        narrow, before, counted[0] = forest.coded(x, onehot), counted[0], 0
        for a, b in zip(want, forest.fit_predict(narrow, y, narrow[:500], [7], trees=4, depth=8, codes=codes)):  # the same trees
            assert np.allclose(a, b, atol=1e-9)
        assert counted[0] < 0.6 * before


def test_groups_of_nodes_make_one_tree(monkeypatch):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 60, (5000, 6)).astype(np.uint8), rng.normal(size=5000)
    y += x[:, 0] // 8
    x = forest.coded(x, list((np.arange(20)[:, None] == rng.integers(0, 20, 5000)).astype(np.uint8)))
    monkeypatch.setattr(forest, "TOGETHER", 200)
    tree, bag, leaf = forest.grow(x, y, np.random.default_rng(2), 9, 5, 5, 20)
    weight = np.random.default_rng(2).poisson(1.0, 5000)[bag]
    assert (forest.leaves(tree, x[bag], 9, 20) == leaf).all() and (tree[2] >= np.arange(len(tree[2]))).all()
    held = np.bincount(leaf, weight, len(tree[3]))
    assert held.sum() == weight.sum() and held[np.unique(leaf)].min() >= 5
    assert np.allclose(tree[3][leaf], (np.bincount(leaf, weight * y[bag]) / np.maximum(np.bincount(leaf, weight), 1))[leaf])


def test_cells_have_the_rows_of_distinct_cubes():
    rng = np.random.default_rng(6)
    for x in (rng.uniform(-9000, 9000, (500, 4)), rng.choice([-1e9, 0.0, 1e9], (50, 4)) * 1e6 + rng.uniform(0, 1, (50, 4)), np.empty((0, 4))):
        cells, rows, ends = kriging._cells(x, 2000.0)
        want, of = np.unique(np.floor(x / 2000).astype(np.int64), axis=0, return_inverse=True)
        assert (cells == want).all() and len(cells) == len(want) and sorted(rows) == list(range(len(x)))
        assert (np.repeat(np.arange(len(cells)), np.diff(ends, prepend=0)) == of.ravel()[rows]).all()


def test_few_equal_points_keep_the_others_on_the_plain_systems(monkeypatch):
    rng = np.random.default_rng(8)
    train, at = rng.uniform(0, 3000, (400, 4)), rng.uniform(0, 3000, (64, 4))
    train[1] = train[0]
    twins, kept = [], kriging._weights
    monkeypatch.setattr(kriging, "_weights", lambda m, r, twin, *a: (twins.append(0 if twin is None else len(m)), kept(m, r, twin, *a))[1])
    near = kriging.nearest_rows(train, at, 20)
    kriging.krige_near(train, at, near, [(rng.normal(size=400), {"nugget": 0.1, "psill": 1.0, "reach": 2000.0})])
    both = (np.isin(near, [0, 1]).sum(axis=1) == 2).sum()
    assert 0 < both < 64 and sum(twins) == both


def _observed(n, days, places, seed):
    """Rows of which many share a place and a day: latitude, longitude, hours, y and a prediction."""
    rng = np.random.default_rng(seed)
    at = np.column_stack([rng.integers(-320, 320, places) / 4, rng.integers(-720, 720, places) / 4])[rng.integers(0, places, n)]
    return at[:, 0], at[:, 1], np.sort(rng.integers(0, 24 * days, n)).astype(float), rng.normal(3, 1, n), rng.normal(3, 0.2, n)


def _all_pairs(lat, lon, hours, residual):
    """(mean distance, semivariance, pairs) of each lag, pair by pair."""
    la, lo = np.radians(lat), np.radians(lon)
    i, j = np.triu_indices(len(lat), 1)
    i, j = (x[hours[i] // 24 == hours[j] // 24] for x in (i, j))
    h = np.sin((la[j] - la[i]) / 2) ** 2 + np.cos(la[i]) * np.cos(la[j]) * np.sin((lo[j] - lo[i]) / 2) ** 2
    d = 2 * kriging.EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1, h)))
    lag = np.minimum(d // 1500, kriging.LAGS - 1)
    return [(d[lag == k].mean(), ((residual[i] - residual[j]) ** 2)[lag == k].mean() / 2, int((lag == k).sum())) for k in range(kriging.LAGS) if (lag == k).sum() >= 10]


def _recorded(monkeypatch):
    seen, kept = [], kriging.variogram
    monkeypatch.setattr(kriging, "variogram", lambda bins: (seen.append(bins), kept(bins))[1])
    return seen


def test_a_block_s_variograms_are_of_all_pairs_within_a_day(monkeypatch):
    for n, days, places in ((600, 9, 40), (600, 9, 5000), (40, 30, 4)):  # most places on most days, hardly any twice, few rows
        lat, lon, hours, y, ridge = _observed(n, days, places, n + places)
        for tile, together in ((512, 128), (7, 4)):
            seen = _recorded(monkeypatch)
            monkeypatch.setattr(kriging, "TILE", tile, raising=False)
            monkeypatch.setattr(kriging, "DAYS", together, raising=False)
            sides = []
            for k in (slice(None), slice(0, 5)):
                r = blocked.Rows(2)
                r.key, r.x = np.arange(n)[k], np.random.default_rng(1).integers(0, 60, (n, 2)).astype(np.uint8)[k]
                r.kept = {"lat": lat[k], "lon": lon[k], "hours": hours[k], "v": np.exp(y[k]), "y": y[k], "ridge": ridge[k], "last": np.where(np.arange(n) % 5 == 0, np.nan, ridge)[k]}
                sides.append(r)
            blocked._predicted("s0t0", [1], *sides, 2, 0)
            fitted = forest.fit_predict(sides[0].x, y, sides[1].x, [1], 2, codes=0)[0]
            known = np.arange(n) % 5 > 0
            for got, (ok, residual) in zip(seen, ((known | True, y - fitted), (known, y - ridge)), strict=True):
                want = _all_pairs(lat[ok], lon[ok], hours[ok], residual[ok])
                assert [b[2] for b in got] == [b[2] for b in want] and np.allclose(got, want, rtol=1e-9)
            monkeypatch.undo()


def test_a_table_s_variogram_is_of_all_pairs_within_a_day(spark, monkeypatch):
    n = 900
    lat, lon, hours, y, p = _observed(n, 12, 300, 3)
    seen = _recorded(monkeypatch)
    monkeypatch.setattr(kriging, "DAYS", 5, raising=False)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(lat, lon, hours, y, p))], "row_id long, lat double, lon double, hours double, y double, prediction double")
    assert modelling._kriged(df, df.filter("row_id < 20").drop("y")).count() == 20
    (got,), want = seen, _all_pairs(lat, lon, hours, y - p)
    assert [b[2] for b in got] == [b[2] for b in want] and np.allclose(got, want, rtol=1e-9)
