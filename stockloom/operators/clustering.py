"""Cluster sweeps, density clustering on a grid, and cluster quality measures."""

from __future__ import annotations

import math
from itertools import product as all_combinations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.operators.aggregates import one
from stockloom.operators.components import components
from stockloom.operators.features import feature_vector
from stockloom.operators.prefix import row_positions
from stockloom.session import written


def _sweep(df: DataFrame, cols: list[str], keep: list[str], ks: list[int], make, cost, force_k: int | None):
    """Fit every k, score it by silhouette, and label with the best one (the lower k on a tie)."""
    data = written(feature_vector(df, cols, keep))
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    rows, fitted = [], {}
    for k in ks:
        model = make(k).fit(data)
        labels = model.transform(data)
        # A mixture may leave every row in one cluster; a silhouette needs two.
        used = labels.select("cluster").distinct().count()
        rows.append((k, float(cost(model)), float(judge.evaluate(labels)) if used > 1 else -1.0))
        fitted[k] = labels
    best = force_k or max(rows, key=lambda r: (r[2], -r[0]))[0]
    table = df.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")
    return table, fitted[best].select(*keep, F.col("cluster").cast("int").alias("cluster"))


def kmeans_sweep(df: DataFrame, cols: list[str], keep: list[str], ks: list[int] = range(3, 11), force_k: int | None = None, seed: int = 42):
    """(table of k, inertia, silhouette; labels)."""
    return _sweep(
        df, cols, keep, list(ks), lambda k: KMeans(k=k, seed=seed, predictionCol="cluster", maxIter=50), lambda m: m.summary.trainingCost, force_k
    )


def gmm_sweep(df: DataFrame, cols: list[str], keep: list[str], ks: list[int] = range(3, 11), force_k: int | None = None, seed: int = 42, max_iter: int = 100):
    """Mixtures with full covariance; the cost is minus the log-likelihood."""
    return _sweep(
        df, cols, keep, list(ks), lambda k: GaussianMixture(k=k, seed=seed, predictionCol="cluster", maxIter=max_iter), lambda m: -m.summary.logLikelihood, force_k
    )


def hierarchical_clusters(df: DataFrame, cols: list[str], keep: list[str], ks: list[int] = range(3, 11), force_k: int | None = None, seed: int = 42):
    """Divisive hierarchy: clusters are split in two until there are k."""
    return _sweep(
        df, cols, keep, list(ks), lambda k: BisectingKMeans(k=k, seed=seed, predictionCol="cluster"), lambda m: m.summary.trainingCost, force_k
    )


# ---- density clustering --------------------------------------------------------------------------


def _cell_key(cells: list[Column]) -> Column:
    return F.concat_ws("|", *[c.cast("string") for c in cells])


def _grid(df: DataFrame, key: str, dims: list[str], eps: float) -> DataFrame:
    """Points with the key of their cell. The diagonal of a cell is eps: points of one cell are neighbours."""
    side = eps / math.sqrt(len(dims))
    coords = [F.floor(F.col(c) / side).alias(f"_g{i}") for i, c in enumerate(dims)]
    g = df.select(key, *dims, *coords)
    return g.withColumn("_cell", _cell_key([F.col(f"_g{i}") for i in range(len(dims))]))


def _offsets(n_dims: int) -> list[tuple[int, ...]]:
    """Cells that may hold a point within eps, as steps from a cell."""
    reach = math.ceil(math.sqrt(n_dims))
    return [
        o for o in all_combinations(range(-reach, reach + 1), repeat=n_dims) if sum(max(abs(x) - 1, 0) ** 2 for x in o) <= n_dims
    ]


def _probes(points: DataFrame, n_dims: int, own: bool = True) -> DataFrame:
    """Each point once per cell around it, in column ``_near``."""
    steps = [o for o in _offsets(n_dims) if own or any(o)]
    rows = F.explode(F.array(*[F.array(*[F.lit(x) for x in o]) for o in steps]))
    p = points.withColumn("_o", rows)
    return p.withColumn("_near", _cell_key([F.col(f"_g{i}") + F.col("_o")[i] for i in range(n_dims)])).drop("_o")


def _within(dims: list[str], eps: float) -> Column:
    return sum((F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), 2) for c in dims), F.lit(0.0)) <= eps * eps


def dbscan_points(df: DataFrame, key: str, dims: list[str], eps: float, min_samples: int) -> DataFrame:
    """Every point with its role: core, border or noise.

    All points of a cell with enough points are core without any distance. Only points of thinner
    cells look around, and such a cell has fewer than ``min_samples`` of them, so a crowded cell meets a
    bounded number of probes and the work grows with the points, not with their pairs.
    """
    pts = written(_grid(df, key, dims, eps))
    sizes = pts.groupBy("_cell").agg(one().alias("_n"))
    sized = pts.join(sizes, "_cell")
    thin = sized.where(F.col("_n") < min_samples)
    seen = (
        _probes(thin, len(dims)).alias("a").join(pts.alias("b"), F.col("a._near") == F.col("b._cell")).where(_within(dims, eps))
        .groupBy(F.col(f"a.{key}").alias(key)).agg(one().alias("_seen"))
    )
    marked = sized.join(seen, key, "left")
    core = (F.col("_n") >= min_samples) | (F.coalesce("_seen", F.lit(0)) >= min_samples)
    marked = written(marked.withColumn("_core", core).drop("_n", "_seen"))
    cores, rest = marked.where("_core"), marked.where("not _core")
    near = (
        _probes(rest, len(dims)).alias("a")
        .join(cores.alias("b"), (F.col("a._near") == F.col("b._cell")) & _within(dims, eps), "left_semi")
        .select(key).distinct().withColumn("_b", F.lit(1))
    )
    role = F.when(F.col("_core"), "core").when(F.col("_b") == 1, "border").otherwise("noise")
    return marked.join(near, key, "left").withColumn("role", role).drop("_b")


def dbscan_noise(df: DataFrame, key: str, dims: list[str], grid: list[tuple[float, int]]) -> DataFrame:
    """Counts of each role and the share of noise for every (eps, min_samples)."""
    out = None
    for eps, m in grid:
        p = dbscan_points(df, key, dims, eps, m)
        row = p.agg(*[F.sum((F.col("role") == r).cast("long")).alias(r) for r in ("core", "border", "noise")], one().alias("n"))
        row = row.select(F.lit(float(eps)).alias("eps"), F.lit(m).alias("min_samples"), "core", "border", "noise", (F.col("noise") / F.col("n")).alias("noise_share"))
        out = row if out is None else out.unionByName(row)
    return out


def _boxes(points: DataFrame, dims: list[str], eps: float, level: int) -> DataFrame:
    """Bounding boxes of the core points in each sub-cell; a cell has at most 4^d sub-cells per level."""
    side = eps / math.sqrt(len(dims)) / 4**level
    sub = _cell_key([F.floor(F.col(c) / side) for c in dims])
    aggs = [f(c).alias(f"{n}_{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))]
    cells = [f"_g{i}" for i in range(len(dims))]
    return points.withColumn("_sub", sub).groupBy("_cell", "_sub", *cells).agg(*aggs)


def _cell_links(cores: DataFrame, dims: list[str], eps: float, levels: int = 5) -> DataFrame:
    """Pairs of cells with core points within eps, found by boxes and not by comparing all points.

    Two boxes whose farthest corners are within eps link their cells; boxes farther apart than eps never
    do. Only pairs in between are looked at again on a finer level, and what is left after the last
    level is compared point by point, which keeps the result exact.
    """
    d = len(dims)
    near2 = sum((F.pow(F.greatest(F.col(f"a.lo_{c}") - F.col(f"b.hi_{c}"), F.col(f"b.lo_{c}") - F.col(f"a.hi_{c}"), F.lit(0.0)), 2) for c in dims), F.lit(0.0))
    far2 = sum((F.pow(F.greatest(F.col(f"a.hi_{c}") - F.col(f"b.lo_{c}"), F.col(f"b.hi_{c}") - F.col(f"a.lo_{c}")), 2) for c in dims), F.lit(0.0))
    unique = cores.dropDuplicates(dims)
    links, open_pairs = None, None
    for level in range(1, levels + 1):
        boxes = written(_boxes(unique, dims, eps, level))
        if open_pairs is None:
            a = _probes(boxes, d, own=False)
            pairs = a.alias("a").join(boxes.alias("b"), (F.col("a._near") == F.col("b._cell")) & (F.col("a._cell") < F.col("b._cell")))
        else:
            a = boxes.join(open_pairs.select(F.col("_a").alias("_cell"), F.col("_b").alias("_near")).distinct(), "_cell")
            pairs = a.alias("a").join(boxes.alias("b"), F.col("a._near") == F.col("b._cell"))
        judged = pairs.where(near2 <= eps * eps).groupBy(F.col("a._cell").alias("_a"), F.col("b._cell").alias("_b")).agg(
            F.max((far2 <= eps * eps).cast("int")).alias("_sure")
        )
        judged = written(judged)
        sure = judged.where("_sure = 1").select("_a", "_b")
        links = sure if links is None else links.unionByName(sure)
        open_pairs = judged.where("_sure = 0").select("_a", "_b")
        if open_pairs.isEmpty():
            return links
    side = eps / math.sqrt(d) / 4**levels
    sub = _cell_key([F.floor(F.col(c) / side) for c in dims])
    fine = unique.withColumn("_sub", sub)
    boxes = _boxes(unique, dims, eps, levels)
    a = boxes.alias("a").join(open_pairs.alias("p"), F.col("a._cell") == F.col("p._a")).join(boxes.alias("b"), F.col("b._cell") == F.col("p._b"))
    subs = a.where(near2 <= eps * eps).select("p._a", "p._b", F.col("a._sub").alias("_sa"), F.col("b._sub").alias("_sb"))
    last = (
        subs.join(fine.alias("a"), F.col("_sa") == F.col("a._sub")).join(fine.alias("b"), F.col("_sb") == F.col("b._sub"))
        .where(_within(dims, eps)).select("_a", "_b").distinct()
    )
    return links.unionByName(last)


def connected_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node id of each component, found by star contraction however long its chains are."""
    found = written(components(links.select(F.col("_a").alias("a"), F.col("_b").alias("b"))))
    joined = nodes.select(F.col("node").alias("_n")).join(found, F.col("_n") == F.col("node"), "left")
    return joined.select(F.col("_n").alias("node"), F.coalesce("component", "_n").alias("label"))


def dbscan_clusters(df: DataFrame, key: str, dims: list[str], eps: float, min_samples: int) -> DataFrame:
    """(key, role, cluster): components of core cells; a border point joins the smallest cluster it touches; noise is -1."""
    pts = written(dbscan_points(df, key, dims, eps, min_samples))
    cores = pts.where("role = 'core'")
    nodes = cores.select(F.col("_cell").alias("node")).distinct()
    labels = connected_labels(nodes, _cell_links(cores, dims, eps))
    ids = labels.select("label").distinct()
    numbered = row_positions(ids, [], [F.col("label")], "cluster").withColumn("cluster", (F.col("cluster") - 1).cast("int"))
    cell_cluster = labels.join(numbered, "label").select(F.col("node").alias("_cell"), "cluster")
    core_out = cores.join(cell_cluster, "_cell").select(key, "role", "cluster")
    border = _probes(pts.where("role = 'border'"), len(dims))
    touched = (
        border.alias("a").join(cores.alias("b"), F.col("a._near") == F.col("b._cell")).where(_within(dims, eps))
        .select(F.col(f"a.{key}").alias(key), F.col("b._cell").alias("_cell")).distinct().join(cell_cluster, "_cell")
        .groupBy(key).agg(F.min("cluster").alias("cluster")).withColumn("role", F.lit("border"))
    )
    noise = pts.where("role = 'noise'").select(key, "role", F.lit(-1).alias("cluster"))
    return core_out.unionByName(touched.select(key, "role", "cluster")).unionByName(noise)


def choose_dbscan(results: list[dict]) -> dict:
    """Best by silhouette, then less noise, then fewer clusters."""
    return sorted(results, key=lambda r: (-r["silhouette"], r["noise"], r["clusters"]))[0]


# ---- quality measures ----------------------------------------------------------------------------


def keyed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows with the smallest hash of their key: the same rows on every run."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def silhouette_exact_sample(df: DataFrame, key: str, cluster: str, cols: list[str], n: int = 2000, seed: int = 42) -> DataFrame:
    """Mean silhouette by Euclidean distance over a keyed sample of at most n rows.

    The sample, at most n x d numbers whatever the table, is broadcast as one matrix; tasks measure their
    share of its rows against it.
    """
    sample = keyed_sample(df.select(key, cluster, *cols), key, n, seed)
    rows = sample.collect()
    x = np.array([[float(r[c]) for c in cols] for r in rows]).reshape(len(rows), len(cols))
    names, codes = np.unique([r[cluster] for r in rows], return_inverse=True)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((x, codes, len(names)))

    def score(batches):
        m, lab, k = shared.value
        sizes = np.bincount(lab, minlength=k).astype(float)
        member = np.eye(k)[lab]
        for b in batches:
            at = b["i"].to_numpy()
            d2 = ((m[at][:, None, :] - m[None, :, :]) ** 2).sum(axis=2)
            sums = np.sqrt(d2) @ member
            own = lab[at]
            r = np.arange(len(at))
            a = sums[r, own] / np.maximum(sizes[own] - 1, 1)
            means = sums / sizes
            means[r, own] = np.inf
            other = means.min(axis=1)
            s = np.where((sizes[own] > 1) & np.isfinite(other), (other - a) / np.maximum(np.maximum(a, other), 1e-300), 0.0)
            yield pd.DataFrame({"s": s})

    tasks = max(1, min(len(rows) // 100, 200))
    index = spark.range(0, len(rows), numPartitions=tasks).select(F.col("id").alias("i"))
    return index.mapInPandas(score, "s double").agg(F.avg("s").alias("silhouette"), one().alias("n"))


def _centroids(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    return df.groupBy(cluster).agg(one().alias("_n"), *[F.avg(c).alias(f"_c_{c}") for c in cols])


def davies_bouldin(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """Mean over clusters of the worst (scatter_i + scatter_j) / distance of the centroids.

    Pairs are formed between centroids only: one row per cluster.
    """
    df = written(df.select(cluster, *cols))
    cent = _centroids(df, cluster, cols)
    dist = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_c_{c}"), 2) for c in cols), F.lit(0.0)))
    scatter = df.join(cent, cluster).groupBy(cluster).agg(F.avg(dist).alias("_s"))
    full = cent.join(scatter, cluster)
    packed = full.agg(F.collect_list(F.struct(F.col(cluster).alias("k"), F.col("_s").alias("s"), F.array(*[f"_c_{c}" for c in cols]).alias("c"))))
    pairs = full.withColumn("o", F.explode(packed.scalar())).where(F.col("o.k") != F.col(cluster))
    gap = F.sqrt(sum((F.pow(F.col(f"_c_{c}") - F.col("o.c")[i], 2) for i, c in enumerate(cols)), F.lit(0.0)))
    worst = pairs.groupBy(cluster).agg(F.max((F.col("_s") + F.col("o.s")) / F.nullif(gap, F.lit(0.0))).alias("_r"))
    return worst.agg(F.avg("_r").alias("davies_bouldin"), one().alias("k"))


def calinski_harabasz(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """(between / (k - 1)) / (within / (n - k)), from per-cluster moments; both sums are centred."""
    g = written(
        df.groupBy(cluster).agg(
            one().cast("double").alias("_n"), *[F.avg(c).alias(f"_c_{c}") for c in cols],
            sum((F.var_pop(c) for c in cols), F.lit(0.0)).alias("_v"),
        )
    )
    grand = g.agg(F.struct(*[(F.sum(F.col("_n") * F.col(f"_c_{c}")) / F.sum("_n")).alias(f"g_{c}") for c in cols]).alias("g")).scalar()
    apart = sum((F.pow(F.col(f"_c_{c}") - F.col("_g")[f"g_{c}"], 2) for c in cols), F.lit(0.0))
    sums = g.withColumn("_g", grand).agg(F.sum("_n").alias("n"), one().alias("k"), F.sum(F.col("_n") * F.col("_v")).alias("_w"), F.sum(F.col("_n") * apart).alias("_b"))
    return sums.select(((F.col("_b") / (F.col("k") - 1)) / (F.col("_w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"), "k")
