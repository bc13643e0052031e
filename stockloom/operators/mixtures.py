"""Gaussian mixtures of four covariance kinds: all candidates are fitted together, one aggregate per step.

A step of expectation and maximisation needs, per component, the sums of responsibilities, of values and of
products of values. These sums are mergeable: tasks add them up for their rows and for every candidate that still
moves, Spark adds the tasks, and only the sums reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.operators.clustering import keyed_sample
from stockloom.operators.silhouette import sampled_silhouettes
from stockloom.session import written

KINDS = ["full", "diag", "tied", "spherical"]
FLOOR = 1e-6
START_ROWS = 2000


@dataclass
class Mixture:
    """One candidate: ``k`` components, a covariance kind, and what the last step found."""

    k: int
    kind: str
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray  # always one full matrix per component
    history: list[float] = field(default_factory=list)  # log-likelihood before each step
    n: float = 0.0

    @property
    def log_likelihood(self) -> float:
        return self.history[-1] if self.history else float("nan")

    @property
    def bic(self) -> float:
        d = self.means.shape[1]
        spread = {"full": self.k * d * (d + 1) / 2, "diag": self.k * d, "tied": d * (d + 1) / 2, "spherical": self.k}[self.kind]
        return (spread + self.k * d + self.k - 1) * np.log(self.n) - 2 * self.log_likelihood

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, per row and component."""
        d = x.shape[1]
        out = np.empty((len(x), self.k))
        for c in range(self.k):
            root = np.linalg.cholesky(self.covariances[c])
            z = np.linalg.solve(root, (x - self.means[c]).T)
            out[:, c] = np.log(self.weights[c]) - 0.5 * (d * np.log(2 * np.pi) + (z**2).sum(axis=0)) - np.log(np.diag(root)).sum()
        return out

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood, rows, and per component the sums of responsibilities, values and products, as one array."""
        joint = self.log_joint(x)
        top = joint.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
        share = np.exp(joint - total[:, None])
        return packed_sums(x, share, total.sum())


def packed_sums(x: np.ndarray, share: np.ndarray, log_likelihood: float) -> np.ndarray:
    products = np.stack([(x * share[:, [c]]).T @ x for c in range(share.shape[1])])
    return np.concatenate(([log_likelihood, len(x)], share.sum(axis=0), (share.T @ x).ravel(), products.ravel()))


def all_sums(models: list[Mixture], x: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """:meth:`Mixture.sums` of every model over rows that count ``times``, in two matrix products for all of them.

    The log of a density is linear in a row's products, values and 1; so are the sums in the responsibilities.
    """
    d = x.shape[1]
    i, j = np.triu_indices(d)
    terms = np.hstack([x[:, i] * x[:, j], x, np.ones((len(x), 1))])
    factors = []
    for m in models:
        for c in range(m.k):
            inner = np.linalg.inv(np.linalg.cholesky(m.covariances[c]))
            inverse, at = inner.T @ inner, inner @ m.means[c]
            constant = np.log(m.weights[c]) - 0.5 * (d * np.log(2 * np.pi) + at @ at) + np.log(np.diag(inner)).sum()
            factors.append(np.concatenate((np.where(i == j, -0.5, -1.0) * inverse[i, j], inverse @ m.means[c], [constant])))
    joint = terms @ np.array(factors).T
    first, likelihoods = 0, []
    for m in models:
        own = joint[:, first : first + m.k]
        top = own.max(axis=1, keepdims=True)
        np.exp(own - top, out=own)
        total = own.sum(axis=1, keepdims=True)
        likelihoods.append(float(((top + np.log(total))[:, 0] * times).sum()))
        own *= times[:, None] / total
        first += m.k
    sums = joint.T @ terms
    out, first = [], 0
    for m, likelihood in zip(models, likelihoods):
        own = sums[first : first + m.k]
        products = np.empty((m.k, d, d))
        products[:, i, j] = products[:, j, i] = own[:, : len(i)]
        out.append(np.concatenate(([likelihood, times.sum()], own[:, -1], own[:, len(i) : -1].ravel(), products.ravel())))
        first += m.k
    return out


def maximised(model: Mixture, sums: np.ndarray) -> Mixture:
    """The mixture that fits the sums best; every covariance gets a small floor on its diagonal."""
    k, d = model.k, model.means.shape[1]
    count = sums[2 : 2 + k] + 1e-10
    first = sums[2 + k : 2 + k + k * d].reshape(k, d)
    second = sums[2 + k + k * d :].reshape(k, d, d)
    means = first / count[:, None]
    full = second / count[:, None, None] - means[:, :, None] * means[:, None, :]
    if model.kind == "tied":
        full = np.repeat((full * count[:, None, None]).sum(axis=0, keepdims=True) / count.sum(), k, axis=0)
    elif model.kind != "full":
        spread = np.maximum(np.einsum("kii->ki", full), 0.0)
        if model.kind == "spherical":
            spread = np.repeat(spread.mean(axis=1, keepdims=True), d, axis=1)
        full = spread[:, :, None] * np.eye(d)
    full = full + FLOOR * np.eye(d)
    return Mixture(model.k, model.kind, count / count.sum(), means, full, model.history, float(sums[1]))


def start(x: np.ndarray, k: int, kind: str, seed: int) -> Mixture:
    """A mixture around the centres of a short k-means over sampled rows; centres are drawn far apart."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        apart = ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, x[rng.choice(len(x), p=apart / apart.sum()) if apart.sum() > 0 else rng.integers(len(x))]])
    for _ in range(20):
        own = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(k)])
    share = np.eye(k)[own] + 1e-6
    empty = Mixture(k, kind, np.full(k, 1 / k), centres, np.repeat(np.eye(x.shape[1])[None], k, axis=0))
    return maximised(empty, packed_sums(x, share / share.sum(axis=1, keepdims=True), 0.0))


def fit_mixtures(df: DataFrame, key: str, cols: list[str], ks=range(3, 11), kinds: list[str] = KINDS, max_iter: int = 100, tol: float = 1e-3, seed: int = 42) -> list[Mixture]:
    """Every candidate fitted to all rows of ``df``; rows with a null in ``cols`` are left out.

    A candidate is done when its mean log-likelihood gains less than ``tol`` in a step, or after ``max_iter`` steps.
    It starts from a keyed sample of ``START_ROWS`` rows at most; every step reads all rows once for all candidates,
    and equal rows once with their number.
    With fewer rows than components, or without rows, there are none.
    """
    data = written(df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).dropna())
    sample = np.array([[r[c] for c in cols] for r in keyed_sample(data, key, START_ROWS, seed).collect()]).reshape(-1, len(cols))
    models = [start(sample, k, kind, seed) for k in ks for kind in kinds if len(sample) >= k]
    tasks = df.sparkSession.sparkContext.defaultParallelism
    points = written(data.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias("_times")).repartition(tasks)) if models else data
    moving = set(range(len(models)))
    for _ in range(max_iter):
        if not moving:
            break
        now = {i: models[i] for i in moving}

        def added(batches, now=now):
            totals: dict[int, np.ndarray] = {}
            for b in batches:
                x, times = b[cols].to_numpy(dtype=float), b["_times"].to_numpy(dtype=float)
                for i, sums in zip(now, all_sums(list(now.values()), x, times)) if len(x) else ():
                    totals[i] = totals[i] + sums if i in totals else sums
            for i, sums in totals.items():
                yield pd.DataFrame({"model": i, "at": np.arange(len(sums)), "v": sums})

        parts = points.select(*cols, "_times").mapInPandas(added, "model int, at int, v double")
        rows = parts.groupBy("model", "at").agg(F.sum("v").alias("v")).collect()  # candidates x components x columns squared
        sums: dict[int, np.ndarray] = {i: np.zeros(2 + m.k * (1 + len(cols) + len(cols) ** 2)) for i, m in now.items()}
        for r in rows:
            sums[r.model][r["at"]] = r.v
        for i in list(moving):
            gain = sums[i][0] - models[i].log_likelihood if models[i].history else np.inf
            models[i].history.append(float(sums[i][0]))
            models[i].n = float(sums[i][1])
            if gain < tol * sums[i][1]:
                moving.discard(i)
            else:
                models[i] = maximised(models[i], sums[i])
    return models


def mixture_labels(df: DataFrame, key: str, cols: list[str], models: list[Mixture]) -> DataFrame:
    """``key, k, kind, cluster``: the likeliest component of every row under every candidate; no row with a null in ``cols``."""
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()

    def labelled(batches):
        for b in batches:
            x = b[cols].to_numpy(dtype=float)
            for m in models:
                yield pd.DataFrame({key: b[key], "k": m.k, "kind": m.kind, "cluster": m.log_joint(x).argmax(axis=1)})

    schema = T.StructType([rows.schema[key], T.StructField("k", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("cluster", T.IntegerType())])
    return rows.mapInPandas(labelled, schema)


def mixture_table(df: DataFrame, key: str, cols: list[str], models: list[Mixture], n: int = 2000, seed: int = 42) -> DataFrame:
    """``k, kind, log_likelihood, bic, steps, silhouette`` per candidate; silhouettes over a keyed sample."""
    schema = "k int, kind string, log_likelihood double, bic double, steps int"
    facts = df.sparkSession.createDataFrame([(m.k, m.kind, m.log_likelihood, float(m.bic), len(m.history)) for m in models], schema)
    sample = keyed_sample(df.select(key, *cols).dropna(), key, n, seed)
    scores = sampled_silhouettes(mixture_labels(sample, key, cols, models), df, key, cols, ["k", "kind"], n, seed)
    return facts.join(scores, ["k", "kind"], "left")


def best_mixture(table: DataFrame, models: list[Mixture]) -> Mixture:
    """The candidate with the best silhouette; of equal ones the fewer components, then the kind's name."""
    row = table.orderBy(F.col("silhouette").desc_nulls_last(), "k", "kind").first()
    return next(m for m in models if (m.k, m.kind) == (row.k, row.kind))
