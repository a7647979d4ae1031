"""Lasso and spline ridge from moments.

A pass over the rows leaves one matrix of sums per fold, as large as features squared however many rows there are; the
choice of penalties and the fit work on these. Rows are scored where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Design = Callable[[pd.DataFrame], np.ndarray]


def plain_design(features: list[str]) -> Design:
    return lambda pdf: pdf[features].to_numpy(float)


def moments(df: DataFrame, design: Design, target: str, fold: str) -> dict[int, np.ndarray]:
    """Per fold: sums of [1, x, y] outer [1, x, y]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), design(pdf), pdf[target].to_numpy(float)])
            for k in pdf[fold].unique():
                part = z[(pdf[fold] == k).to_numpy()]
                sums[int(k)] = sums.get(int(k), 0) + part.T @ part
        yield pd.DataFrame({"fold": list(sums), "m": [m.ravel() for m in sums.values()]})

    parts = df.mapInPandas(run, "fold long, m array<double>")
    total = parts.select("fold", F.posexplode("m").alias("i", "x")).groupBy("fold", "i").agg(F.sum("x").alias("x")).groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    out = {}
    for r in total.collect():  # folds x features squared
        m = np.array(r["m"])
        out[r["fold"]] = m.reshape(int(round(len(m) ** 0.5)), -1)
    return out


def standardised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(gram, cross, means, stds, mean of y, variance of y) of centred and scaled features, per row."""
    n, mean = m[0, 0], m[0, 1:-1] / m[0, 0]
    ybar = m[0, -1] / n
    cov = m[1:-1, 1:-1] / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.where(std > 1e-9 * np.maximum(1, np.abs(mean)), std, np.inf)
    return cov / np.outer(scale, scale), (m[1:-1, -1] / n - mean * ybar) / scale, mean, scale, ybar, m[-1, -1] / n - ybar**2


def lasso_path(gram: np.ndarray, cross: np.ndarray, alphas: np.ndarray, sweeps: int = 1000, tolerance: float = 1e-7) -> np.ndarray:
    """Coordinate descent along falling penalties; one row of coefficients per alpha."""
    b, out = np.zeros(len(cross)), []
    diagonal = np.diag(gram)
    for a in alphas:
        for _ in range(sweeps):
            most = 0.0
            for j in range(len(b)):
                if diagonal[j] <= 0:
                    continue
                r = cross[j] - gram[j] @ b + diagonal[j] * b[j]
                new = np.sign(r) * max(abs(r) - a, 0) / diagonal[j]
                most = max(most, abs(new - b[j]))
                b[j] = new
            if most < tolerance:
                break
        out.append(b.copy())
    return np.array(out)


def fit_lasso(by_fold: dict[int, np.ndarray], alphas: np.ndarray = np.logspace(3, -4, 120)) -> tuple[np.ndarray, float, float]:
    """(coefficients, intercept, alpha): the alpha of least held-out squared error over the folds, refitted on all."""
    every = sum(by_fold.values())
    error = np.zeros(len(alphas))
    for k in by_fold:
        train = every - by_fold[k]
        gram, cross, mean, scale, ybar, _ = standardised(train)
        for i, b in enumerate(lasso_path(gram, cross, alphas)):
            w = b / scale
            v = np.r_[-(ybar - mean @ w), -w, 1.0]
            error[i] += v @ by_fold[k] @ v  # squared error of the held-out rows from their moments
    alpha = alphas[int(np.argmin(error))]
    gram, cross, mean, scale, ybar, _ = standardised(every)
    w = lasso_path(gram, cross, alphas[alphas >= alpha])[-1] / scale
    return w, float(ybar - mean @ w), float(alpha)


def knots_of(train: DataFrame, columns: list[str], n: int = 6) -> dict[str, np.ndarray]:
    """Quantile knots from mergeable sketches, equal ones folded."""
    at = F.array(*[F.lit(i / (n - 1)) for i in range(n)])
    row = train.agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in columns]).first()
    return {c: np.unique(np.array(row[c], float)) for c in columns}


def bspline(x: np.ndarray, knots: np.ndarray, degree: int = 3) -> np.ndarray:
    """B-spline basis of a knot vector with repeated ends; values outside take the end's. len(knots) + degree - 1 columns,
    the last left out, as the basis sums to one."""
    if len(knots) < 2:
        return np.zeros((len(x), 0))
    t = np.r_[[knots[0]] * degree, knots, [knots[-1]] * degree]
    x = np.clip(x, knots[0], knots[-1])
    at = np.clip(np.searchsorted(t, x, side="right") - 1, degree, len(t) - degree - 2)
    basis = np.zeros((len(x), len(t) - 1))
    basis[np.arange(len(x)), at] = 1
    for d in range(1, degree + 1):
        new = np.zeros((len(x), len(t) - 1 - d))
        for i in range(len(t) - 1 - d):
            a, b = t[i + d] - t[i], t[i + d + 1] - t[i + 1]
            if a > 0:
                new[:, i] += (x - t[i]) / a * basis[:, i]
            if b > 0:
                new[:, i] += (t[i + d + 1] - x) / b * basis[:, i + 1]
        basis = new
    return basis[:, :-1]


def periodic(x: np.ndarray, period: float, harmonics: int = 2) -> np.ndarray:
    a = 2 * np.pi * x[:, None] / period * np.arange(1, harmonics + 1)
    return np.concatenate([np.sin(a), np.cos(a)], axis=1)


def spline_design(knots: dict[str, np.ndarray], cycles: dict[str, float], extra: list[str]) -> Design:
    def design(pdf: pd.DataFrame) -> np.ndarray:
        parts = [bspline(pdf[c].to_numpy(float), k) for c, k in knots.items()]
        parts += [periodic(pdf[c].to_numpy(float), p) for c, p in cycles.items()]
        return np.concatenate([*parts, pdf[extra].to_numpy(float)], axis=1)

    return design


def _ridge_start(m: np.ndarray, alphas: np.ndarray) -> dict:
    gram, cross, mean, scale, ybar, _ = standardised(m)
    n = m[0, 0]
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    values = np.maximum(values, 0) * n
    turned = vectors.T @ (cross * n)
    return {"m": m, "n": n, "gram": gram, "cross": cross, "mean": mean, "scale": scale, "ybar": float(ybar), "values": values, "vectors": vectors, "turned": turned, "shrunk": 1 / (values[:, None] + alphas)}


def _ridge_end(f: dict, alpha: float) -> dict:
    n, gram, cross, vectors = f["n"], f["gram"], f["cross"], f["vectors"]
    b = vectors @ (f["turned"] / (f["values"] + alpha))
    inverse = vectors @ np.diag(1 / (f["values"] + alpha)) @ vectors.T
    sse = f["m"][-1, -1] - n * f["ybar"] ** 2 - 2 * b @ (cross * n) + b @ (gram * n) @ b
    sigma2 = max(sse, 0) / max(n - np.linalg.matrix_rank(gram) - 1, 1)
    return {"b": b, "mean": f["mean"], "scale": f["scale"], "ybar": f["ybar"], "alpha": alpha, "inverse": inverse, "sigma2": float(sigma2)}


def fit_ridges(df: DataFrame, design: Design, target: str, part: str, sets: dict[str, set[int]], alphas: np.ndarray = np.logspace(-3, 6, 60)) -> dict[str, dict]:
    """A ridge per named set of parts of the rows, on its standardised design; sets without rows have none.

    One pass gathers the moments of every part, whose sums are those of any set. Alpha is chosen by leave-one-out error,
    whose sums for all sets and alphas a second pass collects.
    """
    own = moments(df, design, target, part)
    starts = {}
    for name, ks in sets.items():
        m = sum((own[k] for k in ks if k in own), np.zeros((0, 0)) if not own else np.zeros_like(next(iter(own.values()))))
        if m.size and m[0, 0] >= 2:
            starts[name] = _ridge_start(m, alphas)
    of: dict[int, list[str]] = {k: [n for n in starts if k in sets[n]] for k in own}
    keep = {}
    for n, f in starts.items():
        turn = f["vectors"] / f["scale"][:, None]
        keep[n] = (f["n"], f["ybar"], turn, f["mean"] @ turn, f["turned"][:, None], f["shrunk"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {n: np.zeros(len(alphas)) for n in keep}
        for pdf in batches:
            x, y, parts = design(pdf), pdf[target].to_numpy(float), pdf[part].to_numpy()
            for k in np.unique(parts):
                own_x, own_y = x[parts == k], y[parts == k]
                for name in of[int(k)]:
                    n, ybar, turn, middle, turned, shrunk = keep[name]
                    z = own_x @ turn
                    z -= middle
                    error = z @ (turned * shrunk)
                    error -= (own_y - ybar)[:, None]
                    z *= z
                    rest = z @ -shrunk  # 1 - leverage, but for 1
                    rest += 1 - 1 / n
                    error /= np.maximum(rest, 1e-9, out=rest)
                    total[name] += np.einsum("ij,ij->j", error, error)
        yield pd.DataFrame([(n, i, e) for n, t in total.items() for i, e in enumerate(t)], columns=["name", "i", "e"])

    errors: dict[str, dict[int, float]] = {}
    for r in df.mapInPandas(run, "name string, i long, e double").groupBy("name", "i").agg(F.sum("e").alias("e")).collect():  # sets x alphas
        errors.setdefault(r["name"], {})[r["i"]] = r["e"]
    return {n: _ridge_end(f, float(alphas[min(errors[n], key=lambda i: (errors[n][i], i))])) for n, f in starts.items()}


def scored(df: DataFrame, design: Design, fits: dict[str, dict], fit: str, keep: list[str], schema: str) -> DataFrame:
    """keep columns with the `prediction` of the fit that the row names, and its parameter variance sigma2 x' (X'X + alpha I)^-1 x."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, names = design(pdf), pdf[fit].to_numpy()
            prediction, variance = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            for name in set(names):
                f, at = fits[name], names == name
                z = (x[at] - f["mean"]) / f["scale"]
                prediction[at] = z @ f["b"] + f["ybar"]
                variance[at] = f["sigma2"] * np.einsum("ij,jk,ik->i", z, f["inverse"], z)
            yield pdf[keep].assign(prediction=prediction, variance=variance)

    return df.mapInPandas(run, f"{schema}, prediction double, variance double")
