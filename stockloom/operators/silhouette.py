"""Silhouettes of many clusterings of the same rows, over one keyed sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.operators.clustering import keyed_sample


def sampled_silhouettes(labels: DataFrame, df: DataFrame, key: str, cols: list[str], by: list[str], n: int = 2000, seed: int = 42) -> DataFrame:
    """``by, silhouette``: the mean silhouette of every clustering in ``labels(key, by, cluster)``.

    It is exact over a keyed sample of at most ``n`` rows of ``df``, the same for all clusterings; rows with a null are
    left out. At most ``n`` points and ``n`` labels per clustering are collected; distances are measured in the tasks,
    one clustering in each. With fewer than two clusters in the sample there is none (null).
    """
    spark = df.sparkSession
    sample = keyed_sample(df.select(key, *cols).dropna(), key, n, seed)
    rows = sample.collect()
    place = {r[key]: i for i, r in enumerate(rows)}
    found: dict[tuple, np.ndarray] = {}
    for r in labels.join(sample.select(key), key).select(key, "cluster", *by).collect():
        found.setdefault(tuple(r[c] for c in by), np.full(len(rows), -1))[place[r[key]]] = r["cluster"]
    schema = T.StructType([*[labels.schema[c] for c in by], T.StructField("silhouette", T.DoubleType())])
    if not found:
        return spark.createDataFrame([], schema)
    x = np.array([[float(r[c]) for c in cols] for r in rows]).reshape(len(rows), len(cols))
    shared = spark.sparkContext.broadcast((x, list(found.items())))

    def score(batches):
        points, settings = shared.value
        for b in batches:
            out = [(*settings[i][0], mean_silhouette(points, settings[i][1])) for i in b["id"]]
            yield pd.DataFrame(out, columns=[*by, "silhouette"])

    return spark.range(0, len(found), numPartitions=len(found)).mapInPandas(score, schema)


def mean_silhouette(x: np.ndarray, labels: np.ndarray) -> float | None:
    """Mean silhouette by Euclidean distance, in blocks of rows; none with fewer than two labels."""
    names, code = np.unique(labels, return_inverse=True)
    if len(names) < 2:
        return None
    member = np.eye(len(names))[code]
    sizes, total = member.sum(axis=0), 0.0
    for at in range(0, len(x), 256):
        rows = np.arange(at, min(at + 256, len(x)))
        sums = np.sqrt(((x[rows, None, :] - x[None, :, :]) ** 2).sum(axis=2)) @ member
        own = code[rows]
        inner = sums[np.arange(len(rows)), own] / np.maximum(sizes[own] - 1, 1)
        means = sums / sizes
        means[np.arange(len(rows)), own] = np.inf
        outer = means.min(axis=1)
        total += float(np.where(sizes[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0).sum())
    return total / len(x)
