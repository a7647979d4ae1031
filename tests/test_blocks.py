from pyspark.sql import functions as F

from skygrain.operators.model import folds
from skygrain.plans import modelling


def test_training_rows_are_all_outside_the_block(spark, sf_dir):
    m = modelling.matched(spark, sf_dir)
    f = {f"s{r.s}t{r.t}": r for r in folds.fold_sums(m, "s", "t", {"n": F.lit(1)}).collect()}
    got = {name: (train.count(), test.count()) for name, train, test in modelling._held_out(m)}
    assert got == {k: (r.train_n, r.test_n) for k, r in f.items() if r.train_n >= modelling.MIN_TRAIN_ROWS and r.test_n >= modelling.MIN_TEST_ROWS} and len(got) > 4


def test_lasso_scores_every_block_from_its_training_set(spark, sf_dir):
    from skygrain.operators.model import linear

    got = {r.fold: r for r in modelling.lasso_benchmark(spark, sf_dir).collect()}
    m = modelling._featured(spark, sf_dir)
    m = m.join(folds.time_blocks(m, "hours", 5).withColumnRenamed("time_block", "inner"), "hours").cache()
    blocks = list(modelling._held_out(m))
    assert set(got) == {b[0] for b in blocks}
    name, train, test = blocks[0]
    w, c, _ = linear.fit_lasso(linear.moments(train, linear.plain_design(modelling._all(m)), "y", "inner"))
    p = F.lit(c) + sum(F.lit(float(b)) * F.col(f) for b, f in zip(w, modelling._all(m)))
    want = test.agg(*folds.metrics(F.col("v"), F.exp(p))).first()
    assert got[name].n == want.n and abs(got[name].rmse - want.rmse) < 1e-6


def test_ridge_of_a_set_is_that_of_its_rows(spark, sf_dir):
    """Fits from sums over blocks equal a least-squares solution on the rows themselves."""
    import numpy as np
    from skygrain.operators.model import linear

    m, cells = modelling._parted(modelling._featured(spark, sf_dir))
    s, t = modelling._blocks(m)[0]
    ks = modelling._outside(cells, {s}, {t})
    design = modelling._spline(m)
    fit = linear.fit_ridges(m, design, "y", "part", {"one": ks})["one"]
    pdf = m.filter(F.col("part").isin(list(ks))).toPandas()
    z = (design(pdf) - fit["mean"]) / fit["scale"]
    y = pdf["y"].to_numpy()
    assert len(pdf) == m.filter((F.col("s") != s) & (F.col("t") != t)).count()
    want = np.linalg.solve(z.T @ z + fit["alpha"] * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    assert np.allclose(fit["b"], want, atol=1e-6)


def test_nested_blocks_hold_each_row_once_and_train_outside(spark, sf_dir):
    m, cells = modelling._parted(modelling._featured(spark, sf_dir))
    for name, spaces, times in (("", (), ()), ("x/", {cells[0][0]}, {cells[0][1]})):
        inner = modelling._nested(cells, name, spaces, times)
        held = [k for _, test in inner.values() for k in test]
        assert len(inner) == 9 and sorted(held) == sorted(modelling._outside(cells, set(spaces), set(times)))
        for train, test in inner.values():
            assert not {cells[k][0] for k in train} & {cells[k][0] for k in test} and not {cells[k][1] for k in train} & {cells[k][1] for k in test}
    got = modelling.oof_residuals(spark, sf_dir).collect()
    assert len({r.row_id for r in got}) == len(got) > 0.9 * m.count()
