"""Every space-time block with its training rows in one task: ridge predictions come along, a forest is grown, residuals are kriged.

Rows are packed once, as one record per Arrow batch and part with the bytes of its columns, and the ridge's predictions for a
block are a column of their own: a task reads the parts and the column of its block, so that nothing is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrain.operators.model import forest, kriging
from skygrain.operators.model.linear import Design

#: float64 columns of a packed row.
KEPT = ("lat", "lon", "hours", "v", "y")
SPEED, BLOCK = 10.0, 2000.0  # km that an hour counts for, km of a kriging block


def _vectors(fits: dict[str, dict], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients on unscaled designs and intercepts, one column per fit."""
    b = np.column_stack([fits[n]["b"] / fits[n]["scale"] for n in names])
    return b, np.array([fits[n]["ybar"] - fits[n]["mean"] @ (fits[n]["b"] / fits[n]["scale"]) for n in names])


def packed(m: DataFrame, design: Design, cuts: dict[str, np.ndarray], onehot: list[str], fits: dict[str, dict], outer: dict[str, tuple[set[int], int]], inner: dict[str, tuple[str, set[int]]]) -> DataFrame:
    """(part, n, key, x, KEPT, p0, p1, ...): bytes of the rows of a part. x: bins of the columns of `cuts`, then which of `onehot` is 1. outer: training parts and test part by name; inner: block and held-out parts by name of a fit.

    p<i> is null where block i needs no row of the part; else it has the rows' predictions by the block's ridge, then the held-out
    ones of training rows, NaN without a fit, or the variances of test rows.
    """
    names, held = list(outer), [n for n in inner if n in fits]
    b, start = _vectors(fits, [*names, *held])
    #: For each block and part the column of the fit that held the part out.
    by_part = {(inner[n][0], k): len(names) + i for i, n in enumerate(held) for k in inner[n][1]}
    columns = ["part", "n", "key", "x", *KEPT, *[f"p{i}" for i in range(len(names))]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values(["part", "hours"])  # bytes of like values pack well
            z, part = design(pdf), pdf["part"].to_numpy()
            p = z @ b + start
            x = forest.coded(forest.binned([pdf[c].to_numpy(float) for c in cuts], list(cuts.values())), [pdf[c].to_numpy() for c in onehot])
            key, own = pdf["row_id"].to_numpy(np.int64), [pdf[c].to_numpy(float) for c in KEPT]
            rows = []
            for k in np.unique(part):
                at, of = part == k, []
                for i, (name, (train, test)) in enumerate(outer.items()):
                    if k in train:
                        j = by_part.get((name, int(k)))
                        of.append(np.concatenate([p[at, i], np.full(at.sum(), np.nan) if j is None else p[at, j]]).tobytes())
                    elif k == test:
                        f = fits[name]
                        s = (z[at] - f["mean"]) / f["scale"]
                        of.append(np.concatenate([p[at, i], f["sigma2"] * ((s @ f["inverse"]) * s).sum(axis=1)]).tobytes())
                    else:
                        of.append(None)
                rows.append((int(k), int(at.sum()), key[at].tobytes(), x[at].T.tobytes(), *[c[at].tobytes() for c in own], *of))
            yield pd.DataFrame(rows, columns=columns)

    schema = ", ".join(f"{c} {'long' if c in ('part', 'n') else 'binary'}" for c in columns)
    return m.select("row_id", "part", *dict.fromkeys([*KEPT, *cuts, *onehot])).mapInPandas(run, schema)


class Rows:
    """Rows of a block, training or test, put together from records, in the order of their keys."""

    def __init__(self, width: int):
        self.width, self.parts = width, []

    def add(self, r) -> None:
        x = np.frombuffer(r.x, np.uint8).reshape(self.width, r.n).T
        ridge, last = np.frombuffer(r.p).reshape(2, r.n)
        self.parts.append((np.frombuffer(r.key, np.int64), np.ascontiguousarray(x), *[np.frombuffer(getattr(r, c)) for c in KEPT], ridge, last))

    def done(self) -> None:
        kinds = [np.int64, np.uint8, *[np.float64] * (len(KEPT) + 2)]
        columns = [np.concatenate(c) for c in zip(*self.parts)] or [np.empty((0, self.width) if t is np.uint8 else 0, t) for t in kinds]
        self.parts = []
        order = np.argsort(columns[0], kind="stable")
        self.key, self.x, *kept = (c[order] for c in columns)
        self.kept = dict(zip([*KEPT, "ridge", "last"], kept))

    def place(self) -> np.ndarray:
        k = self.kept
        la, lo = np.radians(k["lat"]), np.radians(k["lon"])
        r = kriging.EARTH_RADIUS_KM
        return np.column_stack([r * np.cos(la) * np.cos(lo), r * np.cos(la) * np.sin(lo), r * np.sin(la), k["hours"] * SPEED])


def _predicted(name: str, seed: list[int], train: Rows, test: Rows, trees: int, codes: int) -> pd.DataFrame:
    a, b = train.kept, test.kept
    fitted, mean, variance = forest.fit_predict(train.x, a["y"], test.x, seed, trees, codes=codes)
    places = np.column_stack([a["lat"], a["lon"]])
    drawn = lambda ok, r: kriging.paired_variogram(places[ok], a["hours"][ok], r[ok])
    own, rest, known = a["y"] - fitted, a["y"] - a["ridge"], np.isfinite(a["last"])
    # The forest's variogram comes from residuals of the rows fitted, the ridge's from held-out ones.
    residuals = [(own, drawn(np.ones(len(own), bool), own)), (rest, drawn(known, a["y"] - a["last"]))]
    kriged = kriging.krige_blocks(train.place(), test.place(), residuals, BLOCK)
    out = [
        pd.DataFrame({"fold": name, "model": model, "row_id": test.key, "v": b["v"], "mean_prediction": np.exp(p), "kriged_prediction": np.exp(p + k), "mean_variance": s, "kriging_variance": e})
        for model, p, s, (k, e) in zip(("forest", "gam"), (mean, b["ridge"]), (variance, b["last"]), kriged)
    ]
    return pd.concat(out, ignore_index=True)


def predicted(rows: DataFrame, outer: dict[str, tuple[set[int], int]], seeds: dict[str, list[int]], width: int, trees: int, codes: int) -> DataFrame:
    """Test rows of every block by forest and ridge, alone and with kriged residuals, from the `packed` rows. width, codes: columns of x, columns of `onehot`."""
    schema = "fold string, model string, row_id long, v double, mean_prediction double, kriged_prediction double, mean_variance double, kriging_variance double"

    def one(i: int, name: str, test: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sides = Rows(width), Rows(width)
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    sides[r.part == test].add(r)
            for x in sides:
                x.done()
            yield _predicted(name, seeds[name], *sides, trees, codes)

        own = rows.select("part", "n", "key", "x", *KEPT, F.col(f"p{i}").alias("p")).filter("p is not null")
        return own.coalesce(1).mapInPandas(run, schema)  # a block is one task, which reads the packed table where it is

    # A union of single partitions only would be a single partition, all blocks in one task: an empty frame of two keeps them apart.
    none = rows.sparkSession.range(0, 0, 1, 2).mapInPandas(lambda batches: iter(()), schema)
    return functools.reduce(DataFrame.union, [one(i, name, test) for i, (name, (_, test)) in enumerate(outer.items())], none)
