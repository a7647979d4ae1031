import math

import pytest
from pyspark.sql import functions as F

from skygrain.operators import quality
from skygrain.operators.model import folds
from skygrain.plans import records
from skygrain.sources import files


def text(spark, rows):
    return spark.createDataFrame(rows, "id int, lat string, lon string")


def degrees(spark, rows):
    return files.positions(text(spark, rows).withColumns({c: files.triple(F.col(c)) for c in ("lat", "lon")}), "lat", "lon").orderBy("id").collect()


def test_triples(spark):
    rows = [(1, "(1.5,-2,3e2)", None), (2, " ( 0, 0 ,0) ", None)]
    got = text(spark, rows).select(files.triple(F.col("lat")).alias("a"), files.triple(F.col("lon")).alias("b")).collect()
    assert [r.a for r in got] == [[1.5, -2.0, 300.0], [0.0, 0.0, 0.0]] and [r.b for r in got] == [None, None]
    for bad in ("(1,2)", "(1,2,3,4)", "", "1.5"):
        with pytest.raises(Exception, match="triple"):
            text(spark, [(1, "(1,2,3)", None), (2, bad, None)]).select(files.triple(F.col("lat"))).collect()


def test_scalars_and_unit_vectors(spark):
    got = degrees(spark, [(1, "(45.5,0,0)", "(-170,0,0)"), (2, "(1,0,0)", "(2,0,0)")])
    assert [(r.lat, r.lon) for r in got] == [(45.5, -170.0), (1.0, 2.0)]
    h = math.sqrt(0.5)
    got = degrees(spark, [(1, f"({-h},0.0,{h})", f"({-h},0.0,{h})"), (2, "(0,0,0)", "(0,0,0)"), (3, "(0,-1,0)", "(0,-1,0)")])
    assert math.isclose(got[0].lat, 45.0) and math.isclose(abs(got[0].lon), 180.0)
    assert got[1].lat is None and got[1].lon is None and (got[2].lat, got[2].lon) == (0.0, -90.0)
    with pytest.raises(ValueError):
        degrees(spark, [(1, "(0,1,0)", "(0,1,0)"), (2, "(3,4,0)", "(3,4,0)")])
    assert degrees(spark, []) == []


def test_the_delivery_of_a_day(spark):
    names = spark.createDataFrame([("geo_20250101_V50_1_4",), ("geo_20250101_V50_1_5",), ("geo_20250102_V50_1_5",)], "delivery string")
    got = {r.day: r.delivery for r in files.delivered(names, "V50_1_4").collect()}
    assert got == {"20250101": "geo_20250101_V50_1_4", "20250102": "geo_20250102_V50_1_5"}
    with pytest.raises(Exception, match="several deliveries of 20250101"):
        files.delivered(names, "V9").collect()


def test_metadata_is_merged_and_gated(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    files.with_metadata(spark.range(3), {"build": "a", "kept": "yes"}).write.parquet(one)
    files.with_metadata(spark.read.parquet(one), {"build": "b"}).write.parquet(two)
    back = spark.read.parquet(two)
    assert files.metadata_of(back) == {"build": "b", "kept": "yes"} and files.gated(back, {"build": "b", "kept": None}).count() == 3
    for required in ({"build": "a"}, {"absent": None}):
        with pytest.raises(ValueError):
            files.gated(back, required)


def test_dependencies_close(spark):
    assert records.needed({"x"}, {"x": {"y", "a"}, "y": {"b"}}) == {"a", "b"}
    assert records.needed({"x"}, {"x": {"y"}, "y": {"x", "a"}}) == {"a"}
    assert records.needed({"plain"}) == {"plain"}


def test_no_rows_is_an_error_where_some_must_be(spark):
    assert quality.some(spark.range(1), "x").count() == 1
    with pytest.raises(ValueError):
        quality.some(spark.range(0), "x")


def test_codes_follow_the_training_rows(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "slt float")
    codes = folds.codes_of(train, "slt")
    assert codes == [-1, 1, 3]
    got = folds.onehot(spark.createDataFrame([(3.0,), (7.0,), (math.nan,)], "slt float"), "slt", codes).collect()
    assert [(r.slt_missing, r.slt_1, r.slt_3) for r in got] == [(0.0, 0.0, 1.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0)]
    with pytest.raises(ValueError):
        folds.codes_of(spark.range(300).withColumn("slt", F.col("id")), "slt")


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from skygrain.sources import scratch

    class Far:
        applicationId, master = "app-none", "spark://host:7077"

    class Session:
        sparkContext = Far

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        scratch.shared_dir(Session)
