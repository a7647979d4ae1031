"""Implausible readings per source: isolation forests over local features, with explicit physical rules beside them.

Plan
 1. Copies (same source, time and value) fold into one row in a partial aggregation. A two-level count numbers the rows of
    a source in time order, and every `CHUNK_ROWS` of them are a chunk, so a source that holds a third of all rows, or an
    hour that does, becomes many chunks of one size.
 2. Rows within `HALO` of a chunk's border also go to the neighbouring chunk; numpy computes the features of a chunk.
 3. Scale and daily profile come per source from all readings (mergeable quantile sketches).
 4. One isolation forest per source is fitted on a bounded sample and scores every reading, impossible ones included. It
    also scores a reading that lies `jump` usual distances off on both sides and is like the source's others elsewise;
    that score is the source's limit. How far is too far is thus the forest's decision; the rule after it confirms the
    direction: off to one side of both, the level afterwards is the old one, and the distance is no ordinary scatter.

Defined results: readings with null value take no part in runs or levels; readings with null source or time can only break
the physical limits; equal copies share one result; an empty table gives an empty result; a source with under `MIN_FIT`
usable readings has no forest: its readings have the score 1 and the distance itself is held against `jump`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skygrain.functions.exprs import finite, micros
from skygrain.functions.prefix import running_total
from skygrain.sources.scratch import written

HALO, CHUNK_ROWS = 32, 4000
TREES, SAMPLE, DEPTH, MIN_FIT = 32, 256, 8, 16
LEVEL_WINDOW, SIDE_WINDOW, ONE_SIDED, PASS_GAP_S = 10, 7, 8, 120.0
MODEL_BROADCAST_BYTES = 64 << 20
FAR = 1e9  # distance of a reading that is no number
#: Trees cut at random places, so a score is sure to about a sixth of a distance; the reading at the limit lies that much
#: beyond the jump.
LIMIT_AT = 7 / 6

FEATURES = ["run", "level", "before", "after"]


def impossible(value: Column, low: float = 0.0, high: float = 500.0) -> Column:
    """A value outside (low, high], or not finite. Null is no value, hence False."""
    return F.coalesce(value.isNotNull() & (~finite(value) | (value <= low) | (value > high)), F.lit(False))


def _median_of(windows: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Row-wise median of the kept entries, NaN where there are none."""
    n = keep.sum(axis=1)
    ordered = np.sort(np.where(keep, windows, np.inf), axis=1)
    rows = np.arange(len(n))
    out = (ordered[rows, np.maximum(n - 1, 0) // 2] + ordered[rows, np.minimum(n // 2, ordered.shape[1] - 1)]) / 2
    return np.where(n > 0, out, np.nan)


def _neighbours(values: np.ndarray, group: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Median of values[at], where at is a matrix of positions; positions outside or of another group don't count."""
    inside = (at >= 0) & (at < len(values))
    safe = np.where(inside, at, 0)
    if not len(values):
        return np.full(len(own), np.nan)
    return _median_of(values[safe], inside & (group[safe] == own[:, None]))


def local_features(t: np.ndarray, v: np.ndarray, low: float, high: float, tolerance: float, pass_gap_s: float) -> dict[str, np.ndarray]:
    """Features of the readings of one source in time order (t in microseconds)."""
    n = len(t)
    with np.errstate(invalid="ignore"):
        step = np.abs(np.diff(v))
        # Values are decimals; the margin is far under any resolution and lets 0.01 pass as 0.01.
        starts = np.r_[True, ~(step <= tolerance + 1e-9)]
        usable = np.isfinite(v) & (v > low) & (v <= high)
    run = np.cumsum(starts) - 1
    new_time = np.r_[True, (np.diff(t) != 0)] | starts
    length = np.bincount(run, weights=new_time, minlength=run[-1] + 1 if n else 0)[run].astype(np.int32)

    # One usable reading per time makes the local level.
    first = usable.copy()
    pos = np.flatnonzero(usable)
    first[pos[1:]] &= t[pos[1:]] != t[pos[:-1]]
    u = np.flatnonzero(first)
    tu, vu = t[u], v[u]
    part = np.cumsum(np.r_[True, np.diff(tu) > pass_gap_s * 1e6]) if len(u) else np.zeros(0, int)
    i = np.arange(len(u))
    level = _neighbours(vu, part, i[:, None] + np.arange(-LEVEL_WINDOW, LEVEL_WINDOW + 1), part)
    off = np.abs(vu - level)
    # Beside a lasting step the readings on its shorter side are like those behind or ahead of them, not like the middle.
    behind = _neighbours(vu, part, i[:, None] + np.arange(-ONE_SIDED, 1), part)
    ahead = _neighbours(vu, part, i[:, None] + np.arange(ONE_SIDED + 1), part)
    nearest = np.minimum(off, np.minimum(np.abs(vu - behind), np.abs(vu - ahead)))
    calm = nearest <= 8 * max(float(np.median(off)) if len(off) else 0.0, 0.01)
    c, seen = np.flatnonzero(calm), np.cumsum(calm)
    back = np.arange(1, SIDE_WINDOW + 1)
    before = _neighbours(vu[c], part[c], (seen - calm)[:, None] - back, part)
    after = _neighbours(vu[c], part[c], seen[:, None] + back - 1, part)

    at = np.maximum(np.cumsum(first) - 1, 0)  # a reading takes the level of the usable one of its time, or of the last one
    out = {"run": length}
    for name, x in (("level", level), ("before", before), ("after", after)):
        out[name] = x[at] if len(u) else np.full(n, np.nan)
    return out


def _chunk_features(low: float, high: float, tolerance: float, pass_gap_s: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                own = np.asarray(r.own, bool)
                f = local_features(np.asarray(r.t, np.int64), np.asarray(r.v, float), low, high, tolerance, pass_gap_s)
                rows.append({"source": r.source, "t": r.t[own], "v": r.v[own], **{k: x[own] for k, x in f.items()}})
            yield pd.DataFrame(rows, columns=["source", "t", "v", *FEATURES])

    return run


def featured(readings: DataFrame, low: float, high: float, tolerance: float, pass_gap_s: float) -> DataFrame:
    """Chunks (source, arrays of t, v and the features) from columns source, t, v, o."""
    rows = readings.filter("source is not null and t is not null and v is not null")
    once = written(rows.groupBy("source", "t", "v").agg(F.min("o").alias("o")), "once")
    numbered = running_total(once, ["source"], F.floor(F.col("t") / 3_600_000_000), ["t", "o", "v"], F.lit(1).cast("long"), "i")
    own, at = F.floor(F.col("i") / CHUNK_ROWS), F.col("i") % CHUNK_ROWS
    member = lambda chunk, mine: F.struct(chunk.alias("chunk"), F.lit(mine).alias("own"))
    to = F.array(member(own, True), F.when(at < HALO, member(own - 1, False)), F.when(at >= CHUNK_ROWS - HALO, member(own + 1, False)))
    sent = numbered.select("source", "t", "v", "o", F.explode(F.array_compact(to)).alias("to")).select("source", "t", "v", "o", "to.*")
    items = F.array_sort(F.collect_list(F.struct("t", "o", "v", "own"))).alias("items")
    chunks = sent.groupBy("source", "chunk").agg(items).filter(F.exists("items", lambda i: i["own"]))
    kinds = {"t": "long", "v": "double", "run": "int"}
    arrays = ", ".join(f"{c} array<{kinds.get(c, 'double')}>" for c in ["t", "v", *FEATURES])
    out = chunks.selectExpr("source", "items.t t", "items.v v", "items.own own").mapInPandas(_chunk_features(low, high, tolerance, pass_gap_s), f"source string, {arrays}")
    return written(out, "features")


def distances(v, level, before, after, run, hour, scale, profile, spread) -> np.ndarray:
    """Level, differences, season and run length, the distances as multiples of what is usual for the source.

    Differences are those from the calm readings of the pass before and after, and the lesser of both where they have one
    sign. A missing side is no distance; a value that is no number is `FAR` in all.
    """
    s = max(scale or 0.0, 0.01)
    season = np.asarray(profile, np.float64)[hour]
    with np.errstate(invalid="ignore"):
        up, down = (v - before) / s, (v - after) / s
        apart = np.where(up * down > 0, np.minimum(np.abs(up), np.abs(down)), 0.0)
        out = np.column_stack([np.abs(v - level) / s, np.abs(up), np.abs(down), apart, np.abs(v - season) / max(spread or 0.0, 0.01), np.asarray(run, float)])
    out[~np.isfinite(v), :5] = FAR
    return np.minimum(np.nan_to_num(out, nan=0.0, posinf=FAR), FAR)


def _matrix(d: np.ndarray) -> np.ndarray:
    return np.log1p(d).astype(np.float32)


def _usual(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit_forest(x: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Trees as heaps: children of node i are 2i+1 and 2i+2; a leaf's path length is also that of all nodes under it."""
    rng, nodes = np.random.default_rng(seed), 2 ** (DEPTH + 1) - 1
    feature, cut, path = np.zeros((TREES, nodes), np.int8), np.full((TREES, nodes), np.inf, np.float32), np.zeros((TREES, nodes), np.float32)
    size = min(SAMPLE, len(x))
    for k in range(TREES):
        todo = [(0, 0, x[rng.choice(len(x), size, replace=False)])]
        while todo:
            node, depth, part = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth == DEPTH or len(part) <= 1 or not len(open_):
                value, under = depth + _usual(len(part)), [node]
                while under:
                    i = under.pop()
                    path[k, i] = value
                    if 2 * i + 2 < nodes:
                        under += [2 * i + 1, 2 * i + 2]
                continue
            f = rng.choice(open_)
            at = np.float32(rng.uniform(low[f], high[f]))
            feature[k, node], cut[k, node] = f, at
            right = part[:, f] > at
            todo += [(2 * node + 1, depth + 1, part[~right]), (2 * node + 2, depth + 1, part[right])]
    return {"feature": feature, "cut": cut, "path": path, "usual": np.float32(max(_usual(size), 1e-6))}


def forest_score(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """0 to 1; about 0.5 and less for the mass of the sample."""
    total, flat, base = np.zeros(len(x)), np.ascontiguousarray(x).ravel(), np.arange(len(x), dtype=np.int32) * x.shape[1]
    for feature, cut, path in zip(model["feature"], model["cut"], model["path"]):
        node = np.zeros(len(x), np.int32)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (flat[base + feature[node]] > cut[node])
        total += path[node]
    return np.exp2(-total / len(model["path"]) / model["usual"])


def _fit(jump: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        d = distances(*(pdf[c].to_numpy(float) for c in ("v", "level", "before", "after", "run")), pdf["hour"].to_numpy(int), first["scale"], first["profile"], first["spread"])
        x = _matrix(d)
        model = fit_forest(x[np.lexsort(x.T)], 7)  # whatever the order in which the rows came
        # The reading at the limit: as far off as may be on both sides, for the rest as usual.
        at = LIMIT_AT * jump
        model["limit"] = forest_score(model, _matrix(np.array([[at, at, at, at, np.median(d[:, 4]), 1.0]])))[0]
        return pd.DataFrame({"source": [first["source"]], "model": [pickle.dumps(model)]})

    return run


def _score(jump: float, run_min: int, low: float, high: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[str, dict] = {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                t, v, before, after = r.t, r.v, r.before, r.after
                usual = r.scale if r.scale == r.scale and r.scale is not None else 0.0
                profile = np.zeros(24) if r.profile is None else r.profile
                d = distances(v, r.level, before, after, r.run, (t // 3_600_000_000 % 24).astype(int), usual, profile, r.spread)
                if r.model is None:
                    score, limit = np.ones(len(t)), 1.0
                    odd = d[:, 3] > jump
                else:
                    if r.source not in models:
                        models = {r.source: pickle.loads(r.model)}  # chunks of a source mostly come together
                    score, limit = forest_score(models[r.source], _matrix(d)), models[r.source]["limit"]
                    odd = score >= limit
                with np.errstate(invalid="ignore"):
                    least = np.minimum(np.abs(v - before), np.abs(v - after))
                    # Away to one side of the level before and after, and the level afterwards is the old one.
                    aside = ((v - before) * (v - after) > 0) & (np.abs(before - after) < least / 2) & (d[:, 3] > jump / 2)
                    bad = ~(np.isfinite(v) & (v > low) & (v <= high))
                out.append(pd.DataFrame({"source": r.source, "t": t, "v": v, "score": score, "limit": limit, "impossible": bad, "stuck": r.run >= run_min, "spike": odd & aside & ~bad, "times": d[:, 3]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def score_readings(
    readings: DataFrame, source: str, time: str, value: str, key: str, low: float = 0.0, high: float = 500.0, jump: float = 12.0, run_min: int = 6, tolerance: float = 0.01, pass_gap_s: float = PASS_GAP_S
) -> DataFrame:
    """Every distinct (source, time, value) with its forest score and the rules it breaks.

    Columns: source, t (microseconds), v, score, limit (the score from which a reading of this source is implausible),
    impossible, stuck, spike, times (usual distances off to one side). `stuck`: `run_min` or more distinct times, each within
    `tolerance` of the one before. `spike`: the score reaches the limit, and the reading lies to one side of the calm
    readings of its pass before and after it, which are alike, by more than half of `jump`.
    """
    rows = readings.select(F.col(source).cast("string").alias("source"), micros(F.col(time)).alias("t"), F.col(value).cast("double").alias("v"), F.col(key).alias("o"))
    chunks = featured(rows, low, high, tolerance, pass_gap_s)
    flat = chunks.select("source", F.explode(F.arrays_zip("t", "v", *FEATURES)).alias("r")).select("source", "r.*").filter(~impossible(F.col("v"), low, high))
    flat = flat.withColumn("hour", F.pmod(F.floor(F.col("t") / 3_600_000_000), F.lit(24)).cast("int"))
    # Quantile sketches merge, so no source meets in one task before it is small.
    by_hour = flat.groupBy("source", "hour").agg(F.percentile_approx("v", 0.5, 1000).alias("m"))
    scale = flat.groupBy("source").agg(
        F.percentile_approx(F.abs(F.col("v") - F.col("level")), 0.5, 10000).alias("scale"),
        F.percentile_approx("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias("q"),
        F.count("*").alias("n"),
    )
    days = by_hour.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("hour", "m"))).alias("m"))
    profile = F.expr("transform(sequence(0, 23), h -> coalesce(m[h], q[1]))").alias("profile")
    stats = written(scale.join(days, "source").select("source", "n", "scale", (F.col("q")[2] - F.col("q")[0]).alias("spread"), profile), "source-stats")

    share = F.lit(1_000_000 * 2 * TREES * SAMPLE) / F.col("n")
    sampled = flat.join(stats, "source").filter((F.pmod(F.xxhash64("source", "t", "v"), F.lit(1_000_000)) < share) & (F.col("n") >= MIN_FIT))
    models = written(sampled.groupBy("source").applyInPandas(_fit(jump), "source string, model binary"), "forests")
    known = stats.join(models, "source", "left")
    bytes_ = models.agg(F.coalesce(F.sum(F.length("model")), F.lit(0))).first()[0]
    if bytes_ <= MODEL_BROADCAST_BYTES:
        known = F.broadcast(known)
    columns = "source string, t long, v double, score double, limit double, impossible boolean, stuck boolean, spike boolean, times double"
    return chunks.join(known, "source", "left").mapInPandas(_score(jump, run_min, low, high), columns)


def implausible(readings: DataFrame, source: str, time: str, value: str, key: str, **rules) -> DataFrame:
    """The keys of all implausible readings, copies included (one column, named as `key`)."""
    low, high = rules.get("low", 0.0), rules.get("high", 500.0)
    bad = impossible(F.col(value), low, high)
    flagged = score_readings(readings, source, time, value, key, **rules).filter("(stuck or spike) and not impossible").select("source", "t", "v")
    rest = readings.filter(~bad).select(F.col(key).alias("o"), F.col(source).cast("string").alias("source"), micros(F.col(time)).alias("t"), F.col(value).cast("double").alias("v"))
    return readings.filter(bad).select(key).unionByName(rest.join(flagged, ["source", "t", "v"], "left_semi").select(F.col("o").alias(key)))
