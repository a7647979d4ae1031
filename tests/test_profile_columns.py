from skygrain.plans import dealt
from skygrain.sources.tables import table


def test_profile_has_every_load_and_column(spark, sf_dir):
    t = table(spark, sf_dir, "clara_era5_merged")
    want = {(r.load_id, c) for r in t.select("load_id").distinct().collect() for c in t.columns if c != "load_id"}
    got = dealt.p3_profile(spark, sf_dir).collect()
    assert {(r.load_id, r.column_name) for r in got} == want and len(got) == len(want)
    rows = {r.load_id: r["n"] for r in t.groupBy("load_id").count().withColumnRenamed("count", "n").collect()}
    assert all(r.n_rows == rows[r.load_id] for r in got)
    assert {r.column_name for r in dealt.p3_rare_masks(spark, sf_dir).collect()} <= {c for _, c in want}
