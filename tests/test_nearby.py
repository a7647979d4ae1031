import math
import random

import pytest

import numpy as np

from skygrain.operators import nearby

COLUMNS = "row_id long, hour int, latitude double, longitude double, k string, g int, cell long"


def distance(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


def brute(items, least, most):
    ok = [x for x in items if x[1] is not None and x[2] is not None and x[3] is not None and math.isfinite(x[2]) and math.isfinite(x[3]) and abs(x[2]) <= 90]
    return {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(ok) for b in ok[i + 1 :] if a[1] == b[1] and least <= distance(a[2:4], b[2:4]) <= most}


def pairs(spark, items, least, most, levels=2):
    df = spark.createDataFrame([tuple(x) + ("clash", 1, 2) for x in items], COLUMNS)
    got = [tuple(r) for r in nearby.pairs_within(df, "row_id", "hour", "latitude", "longitude", least, most, levels).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("least,most,levels", [(1, 42, 2), (0.001, 300, 3), (50, 51, 2), (1, 900, 1)])
def test_against_brute_force(spark, least, most, levels):
    rng = random.Random(most)
    items = []
    for i in range(500):
        lat = rng.choice([rng.uniform(-90, 90), rng.uniform(44, 47), rng.uniform(88.5, 90), -90.0, rng.uniform(-1, 1)])
        lon = rng.choice([rng.uniform(-180, 180), rng.uniform(179, 181), rng.uniform(358, 362), rng.uniform(8, 11)])
        items.append((i, rng.choice([1, 1, 2]), round(lat * 4) / 4, round(lon * 4) / 4))
    assert pairs(spark, items, least, most, levels) == brute(items, least, most)


def test_dirty_rows(spark):
    items = [(1, 1, 45.0, 9.0), (2, 1, 45.25, 9.0), (3, 1, 45.25, 369.0), (4, None, 45.25, 9.0), (5, 1, None, 9.0), (6, 1, math.nan, 9.0), (7, 1, 99.0, 9.0), (8, 1, 45.25, math.inf), (9, 1, 45.25, None), (10, 2, 45.25, 9.0)]
    assert pairs(spark, items, 1, 42) == {(1, 2), (1, 3)}


def test_a_hot_place(spark):
    """Copies of a place are no pairs of each other, and all pairs with a neighbour come out."""
    items = [(i, 1, 10.0, 10.0) for i in range(300)] + [(1000, 1, 10.25, 10.0)]
    assert pairs(spark, items, 1, 42) == {(i, 1000) for i in range(300)}


def test_interior_cells_hold_only_matches():
    import numpy as np

    grid, rng = nearby.Grid(0.3, 4), np.random.default_rng(0)
    for lat, lon in ((10.0, 20.0), (-60.3, 179.9), (89.6, -170.0)):
        ids, inside, _ = grid.ring(lat, lon, 5, 60)
        assert inside.any()
        y = np.clip(lat + rng.uniform(-1, 1, 4000), -90, 90)
        x = (lon + rng.uniform(-180 if lat > 85 else -2, 180 if lat > 85 else 2, 4000) + 180) % 360 - 180
        d = nearby._distance(lat, lon, y, x)
        cells = {(k, i): f for i, f, k in ((i, f, i & 7) for i, f in zip(ids, inside))}
        for level in range(4):
            at = grid.pack(level, *grid.cell(y, x, level))
            for key, km in zip(at, d):
                if cells.get((level, key)):
                    assert 5 <= km <= 60
        covered = np.zeros(4000, bool)
        for level in range(4):
            covered |= np.isin(grid.pack(level, *grid.cell(y, x, level)), ids)
        assert covered[(d >= 5) & (d <= 60)].all()


def test_empty(spark):
    assert pairs(spark, [], 1, 42) == set()


def test_regions_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rings = {"star": [(10 + (25 if k % 2 else 8) * np.sin(k * 0.7), 20 + (30 if k % 2 else 9) * np.cos(k * 0.7)) for k in range(9)], "line": [(-20, 170), (35, 165), (20, 215), (-30, 200)], "two": [(0, 0), (1, 1)], "pole": [(80, -170), (89.9, -170), (89.9, 170), (80, 170)]}
    regions = spark.createDataFrame([(n, [(float(y), float(x)) for y, x in r], 5) for n, r in rings.items()] + [(None, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], 5), ("void", None, 5)], "area string, ring array<struct<lat:double,lon:double>>, lat int")
    points = [(i, float(np.float32(rng.uniform(-90, 90))), float(np.float32(rng.uniform(-180, 360)))) for i in range(1500)] + [(9000, None, 1.0), (9001, 5.0, float("nan")), (9002, 95.0, 20.0), (9003, 9.0, 21.0), (9003, 9.0, 21.0)]
    df = spark.createDataFrame([(*p, "clash") for p in points], "id long, y double, x double, region string")
    got = sorted((r.id, r.area) for r in nearby.containing(df, "id", "y", "x", regions, "area", "ring").collect())
    want = []
    for i, y, x in points:
        if y is None or not np.isfinite(x) or abs(y) > 90:
            continue
        x = (x + 180) % 360 - 180
        for name, ring in rings.items():
            if len(ring) > 2:
                edges = np.array([[*a, *b] for a, b in zip(ring, ring[1:] + ring[:1])], float)
                if any(nearby._inside(np.array([y]), np.array([at]), edges)[0] for at in (x, x + 360)):
                    want.append((i, name))
    assert got == sorted(want) and len({n for _, n in want}) == 3
    assert nearby.containing(df.limit(0), "id", "y", "x", regions, "area", "ring").count() == 0


def test_polygon_cover_is_adaptive():
    """Interior cells hold inside points only, and most of a large region lies in cells that need no test."""
    grid = nearby.Grid(2.0, 5)
    edges = np.array([[0, 0, 0, 40], [0, 40, 30, 40], [30, 40, 30, 0], [30, 0, 0, 0]], float) + 0.013
    ids, inside = nearby.polygon_cover(grid, edges)
    area = lambda keep: sum(1 / 4.0 ** (int(i) & 7) for i in ids[keep])
    assert area(inside) > 20 * area(~inside) and len(set((ids & 7).tolist())) > 3
    rng = np.random.default_rng(1)
    y, x = rng.uniform(-5, 35, 4000), rng.uniform(-5, 45, 4000)
    own = [{int(v) for v in c} for c in np.column_stack([grid.pack(k, *grid.cell(y, x, k)) for k in range(5)])]
    cells, full = set(ids.tolist()), set(ids[inside].tolist())
    truth = nearby._inside(y, x, edges)
    assert all(t for c, t in zip(own, truth) if c & full) and all(c & cells for c, t in zip(own, truth) if t)
