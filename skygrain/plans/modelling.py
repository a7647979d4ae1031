"""Blocked evaluation and models on the matched rows of fold_assignments and clara_era5_merged."""

from __future__ import annotations

import concurrent.futures
import functools

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrain.functions.exprs import finite, lon180, micros
from skygrain.operators import nearest
from skygrain.operators.model import blocked, folds, forest, kriging, linear
from skygrain.plans.registry import ERA, Registry, era
from skygrain.sources.scratch import written
from skygrain.sources.tables import table

query = Registry()
r6 = lambda c: F.round(c, 6)
CONTINUOUS = ["era5_t2m", "era5_sp", "era5_tcwv", "era5_tp", "era5_lcc", "era5_mcc", "era5_hcc", "era5_u10"]
FEATURES = [*CONTINUOUS, "lat", "lon", "local_time", "hours"]
TREES = 30
MIN_TRAIN_ROWS, MIN_TEST_ROWS = 50, 5
#: Up to so many matched rows, some 100 bytes each, a block's training rows are one task's; beyond, every block is a series of Spark jobs.
ROWS_IN_TASK = 6_000_000

#: Rows with a fold and a positive mean; y is its logarithm.
MATCHED = """(select f.row_id, f.space_fold::bigint s, f.time_fold::bigint t, e.clara_radiance_hourly_mean::double v, ln(e.clara_radiance_hourly_mean::double) y, e.* exclude (row_id) from fold_assignments f join clara_era5_merged e using (row_id)
 where f.space_fold is not null and f.time_fold is not null and isfinite(e.clara_radiance_hourly_mean) and e.clara_radiance_hourly_mean > 0)"""


def matched(spark, d):
    f = table(spark, d, "fold_assignments").filter("space_fold is not null and time_fold is not null").select("row_id", F.col("space_fold").cast("long").alias("s"), F.col("time_fold").cast("long").alias("t"))
    e = table(spark, d, "clara_era5_merged").filter(finite(F.col("clara_radiance_hourly_mean")) & (F.col("clara_radiance_hourly_mean") > 0))
    v = F.col("clara_radiance_hourly_mean").cast("double")
    return f.join(e, "row_id").withColumns({"v": v, "y": F.ln(v)})


def _featured(spark, d):
    """Matched rows with all features, missing ones filled by medians, soil types as 0/1 columns."""
    m = matched(spark, d).withColumns({"lat": F.col("latitude").cast("double"), "lon": lon180(F.col("longitude")), "hours": micros(F.col("hour")) / 3.6e9})
    m = written(m.filter(F.col("hour").isNotNull()).select("row_id", "s", "t", "v", "y", *FEATURES, "era5_slt"), "matched")
    codes = folds.codes_of(m, "era5_slt")
    return written(folds.onehot(folds.imputed(m, folds.medians(m, FEATURES), FEATURES), "era5_slt", codes).drop("era5_slt"), "features")


def _all(m):
    """The features of a featured frame: the continuous ones and the codes found in it."""
    return [*FEATURES, *_codes(m)]


def _codes(m):
    return [c for c in m.columns if c.startswith("era5_slt_")]


@query("""select hour, floor((row_number() over (order by hour) - 1) * 4 / count(*) over ())::bigint time_block from (select distinct hour from clara_era5_merged where hour is not null)""")
def time_folds(spark, d):
    return folds.time_blocks(table(spark, d, "clara_era5_merged"), "hour", 4)


@query()
def space_folds(spark, d):
    """k-means blocks of the distinct places."""
    e = era(spark, d).select((F.col("iy") / 4.0).alias("lat"), (F.col("ix") / 4.0).alias("lon"))
    return folds.space_blocks(e, "lat", "lon", 5)


@query(f"""with g as (select s, t, count(*) n from {MATCHED} group by 1, 2), a as (select sum(n) n from g), gs as (select s, sum(n) n from g group by 1), gt as (select t, sum(n) n from g group by 1)
 select g.s, g.t, g.n n_test, (a.n - gs.n - gt.n + g.n)::bigint n_train from g, a, gs, gt where g.s = gs.s and g.t = gt.t""")
def blocked_splits(spark, d):
    """Rows of the test block and of the training rows, which share neither block, per fold."""
    f = folds.fold_sums(matched(spark, d), "s", "t", {"n": F.lit(1)})
    return f.select("s", "t", F.col("test_n").alias("n_test"), F.col("train_n").alias("n_train"))


_BASE = f"""(select f.s, f.t, exp(avg(m.y)) baseline from (select distinct s, t from {MATCHED}) f join {MATCHED} m on m.s <> f.s and m.t <> f.t group by 1, 2)"""


def _baseline(spark, d):
    m = matched(spark, d)
    b = folds.fold_sums(m, "s", "t", {"n": F.lit(1), "y": F.col("y")})
    return m, b.select("s", "t", F.exp(F.col("train_y") / F.col("train_n")).alias("baseline"))


@query(f"select s, t, round(baseline, 6) baseline from {_BASE}")
def fold_baseline(spark, d):
    return _baseline(spark, d)[1].withColumn("baseline", r6("baseline"))


@query(f"""select s, t, count(*) n, round(sqrt(avg(pow(v - baseline, 2))), 5) rmse, round(avg(abs(v - baseline)), 5) mae, round(1 - sum(pow(v - baseline, 2)) / (sum(v * v) - sum(v) * sum(v) / count(*)), 5) r2 from {MATCHED} join {_BASE} using (s, t) group by 1, 2""")
def score_metrics(spark, d):
    m, b = _baseline(spark, d)
    out = m.join(b, ["s", "t"]).groupBy("s", "t").agg(*folds.metrics(F.col("v"), F.col("baseline")))
    return out.withColumns({c: F.round(c, 5) for c in ("rmse", "mae", "r2")})


@query(f"""select s, {', '.join(f"max(case when t = {k} then rmse end) t{k}" for k in range(4))} from (select s, t, round(sqrt(avg(pow(v - baseline, 2))), 5) rmse from {MATCHED} join {_BASE} using (s, t) group by 1, 2) group by 1""")
def pivot_rmse(spark, d):
    wide = score_metrics(spark, d).groupBy("s").pivot("t", [0, 1, 2, 3]).agg(F.max("rmse"))
    return wide.select("s", *[F.col(str(k)).alias(f"t{k}") for k in range(4)])


@query(f"""with k as (select median(case when isfinite(era5_t2m) then era5_t2m::double end) a, median(case when isfinite(era5_sp) then era5_sp::double end) b from {MATCHED} where s <> 0)
 select row_id, round(case when isfinite(era5_t2m) then era5_t2m::double else a end, 4) t2m, round(case when isfinite(era5_sp) then era5_sp::double else b end, 4) sp, {', '.join(f'coalesce((era5_slt = {i})::int::double, 0.0) era5_slt_{i}' for i in range(1, 8))}, (not coalesce(isfinite(era5_slt), false))::int::double era5_slt_missing from {MATCHED}, k""")
def impute_onehot(spark, d):
    """Medians of the training rows fill gaps; soil types become 0/1 columns."""
    m = matched(spark, d)
    train = m.filter("s <> 0")
    x = folds.onehot(folds.imputed(m, folds.medians(train, ["era5_t2m", "era5_sp"]), ["era5_t2m", "era5_sp"]), "era5_slt", folds.codes_of(train, "era5_slt"))
    # The query's columns are fixed; a code that no training row has is 0 everywhere.
    codes = [(F.col(c) if c in x.columns else F.lit(0.0)).alias(c) for c in (f"era5_slt_{k}" for k in (*range(1, 8), "missing"))]
    return x.select("row_id", F.round("era5_t2m", 4).alias("t2m"), F.round("era5_sp", 4).alias("sp"), *codes)


@query(f"""select row_id, round(exp(mu + (a + b) / 2), 5) mean, round((exp(a + b) - 1) * exp(2 * mu + a + b), 4) total, round((exp(a) - 1) * exp(2 * mu + a), 4) model_part from (select row_id, y mu, era5_lcc::double a, greatest(era5_mcc::double, 0) b from {MATCHED} where not isnan(era5_lcc) and not isnan(era5_mcc) and era5_lcc between 0 and 1 and era5_mcc between -1e-10 and 1)""")
def variance_components(spark, d):
    """Lognormal mean and variance of two additive log variances; materially negative ones are an error, tiny ones 0."""
    m = matched(spark, d).filter(F.col("era5_lcc").between(0, 1) & F.col("era5_mcc").between(-1e-10, 1))
    safe = lambda c: F.when(F.col(c) < -1e-10, F.raise_error(F.lit("negative variance")).cast("double")).otherwise(F.greatest(F.col(c).cast("double"), F.lit(0.0)))
    m = m.select("row_id", F.col("y").alias("mu"), safe("era5_lcc").alias("a"), safe("era5_mcc").alias("b"))
    mu, a, b = F.col("mu"), F.col("a"), F.col("b")
    return m.select("row_id", F.round(F.exp(mu + (a + b) / 2), 5).alias("mean"), F.round(F.expm1(a + b) * F.exp(2 * mu + a + b), 4).alias("total"), F.round(F.expm1(a) * F.exp(2 * mu + a), 4).alias("model_part"))


@query("""select variable, count(*) n, round(avg(missing_rate), 6) mean, round(median(missing_rate), 6) median, round(stddev_samp(missing_rate), 6) std, max(missing_rate) max, round(avg((abs(missing_rate) > 0.01)::int), 6) large_share from covariate_summary where missing_rate is not null and not isnan(missing_rate) group by 1""")
def importance_summary(spark, d):
    """A figure per variable summarised over its groups: mean, median, spread, maximum, share above a threshold."""
    x = F.col("missing_rate")
    return table(spark, d, "covariate_summary").filter(finite(x)).groupBy("variable").agg(F.count("*").alias("n"), r6(F.avg(x)).alias("mean"), r6(F.median(x)).alias("median"), r6(F.stddev_samp(x)).alias("std"), F.max(x).alias("max"), r6(F.avg((F.abs(x) > 0.01).cast("int"))).alias("large_share"))


@query(f"""with h as (select row_id, epoch_us(hour) / 3.6e9 t, cos(radians(iy / 4.0)) * cos(radians(ix / 4.0)) x, cos(radians(iy / 4.0)) * sin(radians(ix / 4.0)) y, sin(radians(iy / 4.0)) z from {ERA}),
 k as (select avg(t) m, stddev_pop(t) sd, list_sort([stddev_pop(x), stddev_pop(y), stddev_pop(z)])[2] sp from h) select row_id, round((t - m) / sd * sp, 6) + 0.0 z_time from h, k""")
def st_scaler(spark, d):
    """Time in units of the median spread of the unit coordinates."""
    la, lo = F.radians(F.col("iy") / 4.0), F.radians(F.col("ix") / 4.0)
    h = era(spark, d).select("row_id", (micros(F.col("hour")) / 3.6e9).alias("t"), (F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))
    k = h.agg(F.avg("t").alias("m"), F.stddev_pop("t").alias("sd"), F.array_sort(F.array(F.stddev_pop("x"), F.stddev_pop("y"), F.stddev_pop("z")))[1].alias("sp"))
    return h.join(F.broadcast(k)).select("row_id", (r6((F.col("t") - F.col("m")) / F.col("sd") * F.col("sp")) + 0.0).alias("z_time"))  # one row


# --- models ------------------------------------------------------------------------------------------------------------

def _blocks(m):
    """The given blocks that can be fitted: rows on both sides and a target that varies."""
    f = folds.fold_sums(m, "s", "t", {"n": F.lit(1), "y": F.col("y"), "yy": F.col("y") ** 2}).collect()  # one row per block
    f = [r for r in f if r["train_n"] >= MIN_TRAIN_ROWS and r["test_n"] >= MIN_TEST_ROWS]
    return sorted((r["s"], r["t"]) for r in f if r["train_yy"] - r["train_y"] ** 2 / r["train_n"] > 1e-12 * r["train_yy"])


def _held_out(m):
    """Every given space-time block: (name, training rows in neither its space nor its time, test rows)."""
    for s, t in _blocks(m):
        yield f"s{s}t{t}", m.filter((F.col("s") != s) & (F.col("t") != t)), m.filter((F.col("s") == s) & (F.col("t") == t))


def _forest(train, trees=TREES):
    return RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=trees, minInstancesPerNode=5, featureSubsetStrategy="sqrt", maxDepth=12, maxBins=64, seed=20).fit(train)


def _assembled(m):
    return VectorAssembler(inputCols=_all(m), outputCol="x").transform(m)


def _benchmark(predicted):
    out = functools.reduce(DataFrame.unionByName, predicted) if isinstance(predicted, list) else predicted
    return out.groupBy("fold").agg(*folds.metrics(F.col("v"), F.col("p")))


def _side_by_side(jobs, at_once=4):
    """The results of independent driver-side jobs, a few at a time: small fits don't fill a cluster one by one."""
    with concurrent.futures.ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(lambda job: job()), jobs))


@query()
def rf_benchmark(spark, d):
    """Random forest of log radiance on blocked folds; metrics on the original scale."""
    m = _featured(spark, d)

    def one(name, train, test):
        p = _forest(_assembled(train)).transform(_assembled(test)).select(F.lit(name).alias("fold"), "v", F.exp("prediction").alias("p"))
        return written(p, "forest")

    return _benchmark(_side_by_side([functools.partial(one, *b) for b in _held_out(m)]))


@query()
def tree_moments(spark, d):
    """Mean and variance over the trees of a forest for every matched row."""
    m = _featured(spark, d)
    return _forest_mean(m, m).select("row_id", F.col("prediction").alias("mean"), "variance")


def _parted(m):
    """m with `part`, the number of its (space, time) block, and the blocks by number."""
    spaces, times = (sorted(r[0] for r in m.select(c).distinct().collect()) for c in ("s", "t"))  # block numbers
    place = lambda c, of: F.array_position(F.array(*map(F.lit, of)), F.col(c)) - 1
    return m.withColumn("part", place("s", spaces) * len(times) + place("t", times)), [(a, b) for a in spaces for b in times]


def _outside(cells, spaces, times, within=None):
    """Numbers of the blocks in none of the spaces and none of the times, of those in `within` if given."""
    return {k for k, (a, b) in enumerate(cells) if a not in spaces and b not in times and (within is None or k in within)}


@query()
def lasso_benchmark(spark, d):
    """Lasso with its penalty chosen over five inner folds, contiguous in time, from moments gathered in one pass."""
    m = _featured(spark, d)
    inner = folds.time_blocks(m, "hours", 5).withColumnRenamed("time_block", "inner")
    m, cells = _parted(m.join(inner, "hours"))
    names = _all(m)
    own = linear.moments(m.withColumn("both", F.col("part") * 5 + F.col("inner")), linear.plain_design(names), "y", "both")
    out = []
    for s, t in _blocks(m):
        by_inner: dict[int, np.ndarray] = {}
        train = _outside(cells, {s}, {t})
        for k, x in own.items():
            if k // 5 in train:
                by_inner[k % 5] = by_inner.get(k % 5, 0) + x
        w, c, _ = linear.fit_lasso(by_inner)
        p = F.lit(c)
        for f, b in zip(names, w):
            if b:
                p = p + F.lit(float(b)) * F.col(f)
        out.append(m.filter((F.col("s") == s) & (F.col("t") == t)).select(F.lit(f"s{s}t{t}").alias("fold"), "v", F.exp(p).alias("p")))
    return _benchmark(out)


def _spline(m):
    """The spline design, its knots from the features of all rows: they say nothing of the target, and moments add up over blocks."""
    return linear.spline_design(linear.knots_of(m, [*CONTINUOUS, "lat"]), {"lon": 360.0, "local_time": 24.0}, _codes(m))


@query()
def spline_basis(spark, d):
    """The spline basis of temperature for every matched row, as an array."""
    m = _featured(spark, d).select("row_id", "era5_t2m")
    knots = linear.knots_of(m, ["era5_t2m"])["era5_t2m"]

    def run(batches):
        for pdf in batches:
            yield pdf[["row_id"]].assign(basis=list(linear.bspline(pdf["era5_t2m"].to_numpy(float), knots)))

    return m.mapInPandas(run, "row_id long, basis array<double>")


_KEEP = "row_id long, v double, y double, lat double, lon double, hours double"


def _named(cells, blocks):
    """Training sets of the outer blocks by name."""
    return {f"s{s}t{t}": _outside(cells, {s}, {t}) for s, t in blocks}


def _nested(cells, name="", spaces=(), times=()):
    """3 x 3 inner blocks of what lies outside the given spaces and times: {name: (training parts, test parts)}."""
    within = _outside(cells, set(spaces), set(times))
    left = [sorted({cells[k][i] for k in within}) for i in (0, 1)]
    out = {}
    for i, a in enumerate(np.array_split(left[0], 3)):
        for j, b in enumerate(np.array_split(left[1], 3)):
            a_, b_ = set(a.tolist()), set(b.tolist())
            test = {k for k in within if cells[k][0] in a_ and cells[k][1] in b_}
            out[f"{name}i{i}j{j}"] = (_outside(cells, a_, b_, within), test)
    return out


def _asked(m, of):
    """m once per name that wants its part: `of` maps names to parts."""
    wanted: dict[int, list[str]] = {}
    for name, ks in of.items():
        for k in ks:
            wanted.setdefault(k, []).append(name)
    lists = F.lit(None).cast("array<string>")
    for k, names in wanted.items():
        lists = F.when(F.col("part") == k, F.array(*map(F.lit, names))).otherwise(lists)
    return m.withColumn("fold", F.explode(lists))


def _gam_scored(m, cells, blocks):
    """Every test row by the spline ridge that left it out: two passes fit all blocks, a third scores."""
    design = _spline(m)
    fits = linear.fit_ridges(m, design, "y", "part", _named(cells, blocks))
    test = _asked(m, {n: {cells.index(b)} for n, b in zip(_named(cells, blocks), blocks)}).filter(F.col("fold").isin(list(fits)))
    return linear.scored(test, design, fits, "fold", ["fold", *_KEPT], "fold string, " + _KEEP)


@query()
def gam_benchmark(spark, d):
    """Spline ridge on blocked folds."""
    m, cells = _parted(_featured(spark, d))
    return _benchmark(_gam_scored(m, cells, _blocks(m)).select("fold", "v", F.exp("prediction").alias("p")))


@query()
def fold_predictions(spark, d):
    """Every held-out row of the spline ridge with its prediction, errors, and the error of the fold's baseline."""
    m, cells = _parted(_featured(spark, d))
    b = folds.fold_sums(m, "s", "t", {"n": F.lit(1), "y": F.col("y")})
    b = b.select(F.format_string("s%dt%d", "s", "t").alias("fold"), F.exp(F.col("train_y") / F.col("train_n")).alias("baseline"))
    p = _gam_scored(m, cells, _blocks(m)).withColumn("predicted", F.exp("prediction")).join(b, "fold")
    e = F.col("v") - F.col("predicted")
    return p.select("fold", "row_id", "v", "predicted", "baseline", e.alias("residual"), F.abs(e).alias("absolute_error"), (e * e).alias("squared_error"), (F.col("v") - F.col("baseline")).alias("baseline_residual"))


_KEPT = ["row_id", "v", "y", "lat", "lon", "hours"]


def _forest_mean(train, rows, keep=_KEPT):
    """rows with the mean of a forest's trees as `prediction` and the trees' variance."""
    x = _assembled(rows)
    model = _forest(_assembled(train))
    for i, tree in enumerate(model.trees):
        x = tree.setPredictionCol(f"p{i}").transform(x)
    p = F.array(*[F.col(f"p{i}") for i in range(len(model.trees))])
    x = x.select(*keep, p.alias("p")).withColumn("prediction", F.aggregate("p", F.lit(0.0), lambda a, b: a + b) / F.size("p"))
    return x.withColumn("variance", F.expr("aggregate(p, 0D, (a, b) -> a + (b - prediction) * (b - prediction)) / (size(p) - 1)")).drop("p")


def _kriged(fitted, at, held_out=None):
    """at with `kriged`, 0 where nothing is near, and `kriging_variance`, from the residuals y - prediction of the fitted rows.

    The variogram comes from `held_out` residuals (columns as of fitted) where given: those of the rows fitted are too small.
    """
    placed = lambda df: df.withColumns(kriging.coordinates(F.col("lat"), F.col("lon"), F.col("hours"), blocked.SPEED))
    rest = lambda df: placed(df).withColumn("residual", F.col("y") - F.col("prediction"))
    fitted = written(rest(fitted), "residuals")
    v = kriging.paired_variogram_of(fitted if held_out is None else rest(held_out))
    k = kriging.predict(fitted, placed(at), "row_id", v, blocked.BLOCK)
    return at.join(k, "row_id", "left").withColumn("kriged", F.coalesce("kriged", F.lit(0.0)))


def _gam_parts(m, cells, blocks):
    """(rows of every block's training and test sets with their predictions, held-out residual rows), by `fold`.

    Held out are the 3 x 3 inner blocks of each training set.
    """
    design, outer = _spline(m), _named(cells, blocks)
    inner = {n: _nested(cells, f"{n}/", {s}, {t}) for n, (s, t) in zip(outer, blocks)}
    every = {k: v for x in inner.values() for k, v in x.items()}
    fits = linear.fit_ridges(m, design, "y", "part", outer | {k: train for k, (train, _) in every.items()})
    rows = _asked(m, {n: ks | {cells.index(b)} for (n, ks), b in zip(outer.items(), blocks)})
    both = written(linear.scored(rows, design, fits, "fold", ["fold", "part", *_KEPT], "fold string, part long, " + _KEEP), "mean-model")
    out = linear.scored(_asked(m, {k: test for k, (_, test) in every.items() if k in fits}), design, fits, "fold", ["fold", *_KEPT], "fold string, " + _KEEP)
    return both, written(out.withColumn("fold", F.substring_index("fold", "/", 1)), "held-out")


def _in_tasks(m, cells, blocks):
    """What kriging_predict gives, each block in a task of its own: no pass per block, no tables of the blocks' rows."""
    design, outer, codes = _spline(m), _named(cells, blocks), _codes(m)
    inner = {k: (n, x) for n, (s, t) in zip(outer, blocks) for k, x in _nested(cells, f"{n}/", {s}, {t}).items()}
    fits = linear.fit_ridges(m, design, "y", "part", outer | {k: train for k, (_, (train, _)) in inner.items()})
    cuts = {c: k[1:-1] for c, k in linear.knots_of(m, FEATURES, forest.BINS + 1).items()}
    sides = {n: (ks, cells.index(b)) for (n, ks), b in zip(outer.items(), blocks)}
    rows = written(blocked.packed(m, design, cuts, codes, fits, sides, {k: (n, test) for k, (n, (_, test)) in inner.items()}), "packed")
    return written(blocked.predicted(rows, sides, {n: [20, s, t] for n, (s, t) in zip(outer, blocks)}, len(cuts) + 1, TREES, len(codes)), "kriged")


@query()
def kriging_predict(spark, d):
    """Forest and spline ridge with kriged residuals: the test rows of every block with both predictions and the variances."""
    m, cells = _parted(_featured(spark, d))
    blocks = _blocks(m)
    if m.count() <= ROWS_IN_TASK:
        return _in_tasks(m, cells, blocks)
    ridge, out_of_fold = _gam_parts(m, cells, blocks)

    def one(model, block):
        s, t = block
        name, at = f"s{s}t{t}", F.col("part") == cells.index(block)
        train, test = m.filter(F.col("part").isin(list(_outside(cells, {s}, {t})))), m.filter(at)
        if model == "forest":
            both, held_out = written(_forest_mean(train, train.unionByName(test), ["part", *_KEPT]), "mean-model"), None
        else:
            both, held_out = ridge.filter(F.col("fold") == name), out_of_fold.filter(F.col("fold") == name)
        k = _kriged(both.filter(~at), both.filter(at), held_out)
        k = k.select(
            F.lit(name).alias("fold"), F.lit(model).alias("model"), "row_id", "v", F.exp("prediction").alias("mean_prediction"),
            F.exp(F.col("prediction") + F.col("kriged")).alias("kriged_prediction"), F.col("variance").alias("mean_variance"), "kriging_variance",
        )
        return written(k, "kriged")

    return functools.reduce(DataFrame.unionByName, _side_by_side([functools.partial(one, x, b) for b in blocks for x in ("forest", "gam")]))


@query()
def kriging_benchmark(spark, d):
    """Metrics of forest and spline ridge on every block, alone and with kriged residuals."""
    p = kriging_predict(spark, d)
    kinds = F.explode(F.array(F.struct(F.lit("mean").alias("kind"), F.col("mean_prediction").alias("p")), F.struct(F.lit("kriged").alias("kind"), F.col("kriged_prediction").alias("p")))).alias("k")
    return p.select("fold", "model", "v", kinds).select("fold", "model", "v", "k.*").groupBy("fold", "model", "kind").agg(*folds.metrics(F.col("v"), F.col("p")))


@query()
def oof_residuals(spark, d):
    """Out-of-fold residuals of the spline ridge: 3 x 3 blocks of all matched rows, each row predicted by the fit outside its space and time."""
    m, cells = _parted(_featured(spark, d))
    design, inner = _spline(m), _nested(cells)
    fits = linear.fit_ridges(m, design, "y", "part", {k: train for k, (train, _) in inner.items()})
    p = linear.scored(_asked(m, {k: test for k, (_, test) in inner.items() if k in fits}), design, fits, "fold", ["fold", *_KEPT], "fold string, " + _KEEP)
    return p.select("row_id", "fold", (F.col("y") - F.col("prediction")).alias("residual"))


@query()
def grid_prediction(spark, d):
    """Final forest on all matched rows and its kriged residuals, at every grid row of the latest hour with a temperature."""
    m = _featured(spark, d)
    e = era(spark, d).filter(finite(F.col("era5_t2m"))).withColumns({"lat": F.col("latitude").cast("double"), "lon": lon180(F.col("longitude")), "hours": micros(F.col("hour")) / 3.6e9})
    e = e.join(F.broadcast(e.agg(F.max("hour").alias("hour"))), "hour")  # one row
    fill = folds.medians(m, FEATURES)
    codes = [-1 if c.endswith("_missing") else int(c.rsplit("_", 1)[1]) for c in _codes(m)]
    at = folds.onehot(folds.imputed(e.select("row_id", "hour", *FEATURES, "era5_slt"), fill, FEATURES), "era5_slt", codes)
    place = ["row_id", "lat", "lon", "hours"]
    rows = m.select(*place, "y", *[c for c in _all(m) if c not in place]).withColumns({"hour": F.lit(None).cast("timestamp_ntz"), "at": F.lit(False)})
    rows = rows.unionByName(at.withColumns({"y": F.lit(None).cast("double"), "at": F.lit(True)}), allowMissingColumns=True)
    both = written(_forest_mean(m, rows, [*place, "y", "hour", "at"]), "final")
    known = m.filter(F.col("lat").between(-90, 90)).select("lat", "lon", "hours")
    axes, side = nearest.space_time(known, "lat", "lon", "hours")
    points = both.filter("at").drop("y", "at")
    near = nearest.nearest_distance(points.withColumns(axes), known.withColumns(axes), "row_id", list(axes), side)
    k = _kriged(both.filter("not at"), points).join(near, "row_id")
    mu, a, b = F.col("prediction") + F.col("kriged"), F.col("variance"), F.col("kriging_variance")
    scale = F.exp(2 * mu + a + b)
    return k.select("row_id", "hour", "lat", "lon", F.exp(mu).alias("predicted"), F.exp("prediction").alias("mean_prediction"), F.exp("kriged").alias("kriged_factor"), a.alias("mean_variance"), b.alias("kriging_variance"), (scale * F.expm1(a)).alias("mean_radiance_variance"), (scale * F.exp(a) * F.expm1(b)).alias("kriging_radiance_variance"), F.col("distance").alias("nearest_km"))


QUERIES, SQL = query.queries, query.sql
