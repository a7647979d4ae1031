from pyspark.sql import functions as F

from skygrain.plans import modelling


def test_every_block_and_both_mean_models(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(modelling, "TREES", 3)
    monkeypatch.setattr(modelling, "_forest", lambda train, f=modelling._forest: f(train, 3))
    some = modelling._blocks
    monkeypatch.setattr(modelling, "_blocks", lambda m: some(m)[3:5])  # blocks of either parity; the loop over all is tested beside
    got = modelling.kriging_predict(spark, sf_dir).collect()
    m = modelling.matched(spark, sf_dir)
    want = {(f"s{s}t{t}", x, r.row_id) for s, t in modelling._blocks(m) for r in m.filter((F.col("s") == s) & (F.col("t") == t) & F.col("hour").isNotNull()).collect() for x in ("forest", "gam")}
    assert {(r.fold, r.model, r.row_id) for r in got} == want and len(got) == len(want)
    assert any(r.kriged_prediction != r.mean_prediction for r in got) and all(r.mean_variance >= 0 for r in got)


def test_grid_rows_have_all_parts(spark, sf_dir):
    got = modelling.grid_prediction(spark, sf_dir).collect()
    assert got and all(r.mean_variance >= 0 and r.nearest_km >= 0 for r in got)
    assert all(abs(r.predicted - r.mean_prediction * r.kriged_factor) < 1e-6 * r.predicted for r in got)
