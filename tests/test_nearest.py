import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from skygrain.operators import nearest
from skygrain.plans import records
from skygrain.plans.modelling import matched
from skygrain.plans.registry import era


def test_brute_force_at_any_distance(spark):
    rng = np.random.default_rng(4)
    known = np.vstack([rng.normal(0, 10, (200, 3)), rng.normal(3000, 1, (20, 3))])
    at = np.vstack([rng.normal(0, 40, (150, 3)), known[:5], [[1e5, -1e5, 7.0]] * 2])
    k = spark.createDataFrame(known.tolist(), "x double, y double, z double")
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(at.tolist())], "id long, x double, y double, z double")
    got = {r.id: r.distance for r in nearest.nearest_distance(p, k, "id", ["x", "y", "z"], 2.0).collect()}
    want = np.sqrt(((at[:, None] - known[None]) ** 2).sum(axis=2)).min(axis=1)
    assert len(got) == len(at) and np.allclose([got[i] for i in range(len(at))], want, atol=1e-9)
    assert [r.distance for r in nearest.nearest_distance(p.limit(1), k.limit(0), "id", ["x", "y", "z"], 2.0).collect()] == [None]


def test_every_located_row_has_a_distance(spark, sf_dir):
    """Against all pairs, in the reference's coordinates."""
    lon = ((F.col("longitude").cast("double") + 180) % 360 + 360) % 360 - 180
    frame = lambda df: df.select("row_id", F.col("latitude").cast("double").alias("a"), lon.alias("o"), "hour").toPandas()
    e, m = frame(era(spark, sf_dir)), frame(matched(spark, sf_dir).filter("latitude between -90 and 90 and abs(longitude) < 1e9 and hour is not null"))
    t = lambda x: (x["hour"] - dt.datetime(1970, 1, 1)).dt.total_seconds().to_numpy() / 3600
    plane = lambda x: 6371.0088 * np.radians(np.column_stack([x["o"] * math.cos(math.radians(m["a"].mean())), x["a"]]))
    scale = np.median(plane(m).std(axis=0))
    xyz = lambda x: np.column_stack([plane(x), (t(x) - t(m).mean()) / t(m).std() * scale])
    want = np.sqrt(((xyz(e)[:, None] - xyz(m)[None]) ** 2).sum(axis=2)).min(axis=1)
    got = {r.row_id: r.nearest_km for r in records.nearest_neighbor_dist(spark, sf_dir).collect()}
    assert len(got) == len(e) and np.allclose([got[i] for i in e["row_id"]], want, atol=1e-5)
