import math

import numpy as np
from pyspark.sql import functions as F

from skygrain.operators import profile


def loads(spark, n=12, rows=400, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        for i in range(rows):
            out.append([f"ld{k:02d}", float(np.float32(280 + 10 * rng.standard_normal())), float(max(0, rng.standard_normal())), f"f_{20250000 + int(rng.integers(100))}.grib"])
    return out


def frame(spark, items):
    return spark.createDataFrame([tuple(x) + ("clash", 1) for x in items], "load_id string, temp double, rain double, file string, mask string, x int")


def shifted(spark, items):
    p = profile.profile(frame(spark, items), "load_id", ["temp", "rain"], ["file"])
    return {(r.load_id, r.column_name) for r in profile.shifts(p).collect()}


def test_masks(spark):
    df = spark.createDataFrame([("era5_20251001_04.grib",), ("AB-12 é",), ("",), (None,), ("x" * 100,)], "s string")
    assert [r[0] for r in df.select(profile.mask(F.col("s"))).collect()] == ["aaaa9_99999999_99.aaaa".replace("aaaa9", "aaa9"), "AA-99 @", "", None, "a+"]
    numbers = spark.createDataFrame([(0.0,), (0.5,), (-12.5,), (100.0,), (999.0,), (1000.25,), (None,)], "x double")
    assert [r[0] for r in numbers.select(profile.number_mask(F.col("x"))).collect()] == ["zero", "0.9", "-99.9", "999", "999", "9999.9", None]


def test_profile_counts(spark):
    items = [["a", 1.0, 0.0, "x1"], ["a", math.nan, -2.0, None], ["a", None, math.inf, ""], ["a", -1.0, 0.0, "x1"], [None, 5.0, 0.0, "y"]]
    got = {(r.load_id, r.column_name): r for r in profile.profile(frame(spark, items), "load_id", ["temp", "rain"], ["file"]).collect()}
    t, r, f = got["a", "temp"], got["a", "rain"], got["a", "file"]
    assert (t.n_rows, t.n_missing, t.n_negative, t.min, t.max, t.mean) == (4, 2, 1, -1.0, 1.0, 0.0)
    assert (r.n_missing, r.n_zero, round(r.zero_rate_non_missing, 6), r.n_negative) == (1, 2, 0.666667, 1)
    assert (f.n_missing, f.n_distinct, f.n_masks) == (1, 2, 2)
    assert got[None, "temp"].n_rows == 1


def test_sound_loads_are_no_shift(spark):
    for seed in range(3):
        assert shifted(spark, loads(spark, seed=seed)) == set()


def test_broken_columns(spark):
    items = loads(spark)
    for i, x in enumerate(items):
        if x[0] == "ld01" and i % 2:
            x[1] = math.nan  # half missing
        if x[0] == "ld02":
            x[1] -= 273.15  # another unit
        if x[0] == "ld03":
            x[2] = -x[2]
        if x[0] == "ld04":
            x[3] = x[3].upper()
        if x[0] == "ld05" and i % 10 < 8:
            x[1] = 281.0  # stuck
    assert shifted(spark, items) == {("ld01", "temp"), ("ld02", "temp"), ("ld03", "rain"), ("ld04", "file"), ("ld05", "temp")}


def test_masks_decide_who_broke_a_column(spark, monkeypatch):
    """Without a divergence of masks no figure alone makes a shift."""
    items = loads(spark)
    for i, x in enumerate(items):
        if x[0] == "ld02":
            x[1] += 25
        if x[0] == "ld07" and i % 12 == 0:
            x[3] = x[3].replace("_", "-")  # a twelfth of the names
    assert shifted(spark, items) == {("ld02", "temp"), ("ld07", "file")}
    kept = profile.mask_divergence
    monkeypatch.setattr(profile, "mask_divergence", lambda masks: kept(masks).withColumn("divergence", F.lit(0.0)))
    assert shifted(spark, items) == set()


def test_reports(spark):
    p = profile.profile(frame(spark, loads(spark, 2, 100)), "load_id", ["temp", "rain"], [])
    zero = {r.load_id: r.zero_rate_non_missing for r in p.filter("column_name = 'rain'").collect()}
    said = [("ld00", "temp", 0.0, 0.0, 0), ("ld01", "temp", 0.01, 0.0, 0), ("ld00", "rain", None, zero["ld00"] + 0.0005, None), ("ld01", "rain", 0.0, zero["ld01"], 3), ("nowhere", "temp", 1.0, 1.0, 9), ("ld01", "temp", 0.01, 0.0, 0)]
    r = spark.createDataFrame(said, "load_id string, variable string, missing_rate double, zero_rate_non_missing double, n_negative long")
    assert {tuple(x) for x in profile.wrong_reports(p, r, "load_id", "variable").collect()} == {("ld01", "temp"), ("ld01", "rain")}


def test_divergence_against_brute_force(spark):
    items = [("a", "p", 3), ("a", "q", 1), ("b", "p", 2), ("b", "r", 2), ("c", "s", 4)]
    df = spark.createDataFrame([(load, "col", m, n) for load, m, n in items], "load_id string, column_name string, mask string, n long")
    got = {r.load_id: r.divergence for r in profile.mask_divergence(df).collect()}
    for load in "abc":
        p = {m: n for x, m, n in items if x == load}
        q: dict = {}
        for x, m, n in items:
            if x != load:
                q[m] = q.get(m, 0) + n
        p, q = ({k: v / sum(d.values()) for k, v in d.items()} for d in (p, q))
        js = sum(a.get(k, 0) * math.log2(a[k] / ((p.get(k, 0) + q.get(k, 0)) / 2)) for a in (p, q) for k in a) / 2
        assert math.isclose(got[load], js, abs_tol=1e-9)


def test_empty(spark):
    p = profile.profile(frame(spark, []), "load_id", ["temp"], ["file"])
    assert p.count() == 0 and profile.shifts(p).count() == 0
    assert profile.mask_violations(frame(spark, []), "load_id", ["temp"], ["file"]).count() == 0
