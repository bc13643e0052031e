"""Density clustering for a whole grid of radii and neighbour counts at once.

Points lie in cells whose diagonal is the smallest radius. One pass counts, per point, the neighbours within
every radius; from these counts follows, for each neighbour count m, the first radius at which the point is
core. Two cells are linked for m from the first radius at which a core point of one reaches a core point of
the other. Links only ever come in as the radius grows, so the components of a radius are those of the
radius before, joined by the new links: a forest of merges per m instead of one run per pair of settings.
"""

from __future__ import annotations

import math
from itertools import product as all_combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.operators.aggregates import one
from stockloom.operators.components import components
from stockloom.operators.prefix import row_positions
from stockloom.operators.silhouette import sampled_silhouettes
from stockloom.session import discard, written

BOX_LEVELS = 5


def _level(d2: Column, eps: list[float]) -> Column:
    """Index of the first radius that covers the squared distance; the number of radii if none does."""
    return sum((F.when(d2 <= e * e, 0).otherwise(1) for e in eps), F.lit(0))


def _distance2(dims: list[str]) -> Column:
    return sum((F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), 2) for c in dims), F.lit(0.0))


def _nearest2(dims: list[str]) -> Column:
    gaps = [F.greatest(F.col(f"a.lo_{c}") - F.col(f"b.hi_{c}"), F.col(f"b.lo_{c}") - F.col(f"a.hi_{c}"), F.lit(0.0)) for c in dims]
    return sum((F.pow(g, 2) for g in gaps), F.lit(0.0))


def _farthest2(dims: list[str]) -> Column:
    spans = [F.greatest(F.col(f"a.hi_{c}") - F.col(f"b.lo_{c}"), F.col(f"b.hi_{c}") - F.col(f"a.lo_{c}")) for c in dims]
    return sum((F.pow(s, 2) for s in spans), F.lit(0.0))


def _bounds(dims: list[str]) -> list[Column]:
    return [f(c).alias(f"{n}_{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))]


def _cells(points: DataFrame, dims: list[str], eps: list[float]) -> DataFrame:
    """Cells that come within the largest radius of each other: ``_a, _b, n_b, lo, hi``, both ways and with itself.

    ``lo`` is the first radius at which points of the two may be neighbours, ``hi`` the first at which all are.
    """
    blocks = [f"_k{i}" for i in range(len(dims))]
    cells = written(points.groupBy("_cell", *blocks).agg(one().alias("n"), *_bounds(dims)))
    steps = F.explode(F.array(*[F.array(*[F.lit(x) for x in o]) for o in all_combinations((-1, 0, 1), repeat=len(dims))]))
    moved = cells.withColumn("_o", steps).select("*", *[(F.col(k) + F.col("_o")[i]).alias(f"_to{i}") for i, k in enumerate(blocks)])
    meet = [F.col(f"a._to{i}") == F.col(f"b.{k}") for i, k in enumerate(blocks)]
    met = moved.alias("a").join(cells.alias("b"), meet).where(_nearest2(dims) <= eps[-1] ** 2)
    return met.select(
        F.col("a._cell").alias("_a"), F.col("b._cell").alias("_b"), F.col("b.n").alias("n_b"), _level(_nearest2(dims), eps).alias("lo"), _level(_farthest2(dims), eps).alias("hi")
    )


def core_levels(df: DataFrame, key: str, dims: list[str], eps: list[float], min_samples: list[int]) -> tuple[DataFrame, DataFrame]:
    """``(points, cells)``: every point with ``core_i``, the index of the first radius at which it is core for count i.

    A cell knows from its neighbours alone the radius from which it surely has the largest count around every
    point. Only below it points look around; such a cell has fewer points than that count, so a crowded cell meets a
    bounded number of probes and the work grows with the points, not with their pairs.
    """
    k, side = len(eps), eps[0] / math.sqrt(len(dims))
    wide = math.ceil(eps[-1] / side) + 1
    grid = [F.floor(F.col(c) / side).alias(f"_g{i}") for i, c in enumerate(dims)]
    g = df.select(key, *[F.col(c).cast("double").alias(c) for c in dims], *grid)
    names = [f"_g{i}" for i in range(len(dims))]
    points = g.select(
        key, *dims, F.concat_ws("|", *[F.col(n).cast("string") for n in names]).alias("_cell"), *[F.floor(F.col(n) / wide).alias(f"_k{i}") for i, n in enumerate(names)]
    )
    points = written(points)
    cells = written(_cells(points, dims, eps))
    most = max(min_samples)
    sure = [(F.coalesce(F.sum(F.when(F.col("hi") <= j, F.col("n_b"))), F.lit(0)) < most).cast("int") for j in range(k)]
    open_until = written(cells.groupBy(F.col("_a").alias("_cell")).agg(sum(sure, F.lit(0)).alias("_open")))
    thin = points.join(open_until.where("_open > 0"), "_cell")
    probes = thin.join(cells.select(F.col("_a").alias("_cell"), "_b", "lo"), "_cell").where("lo < _open")
    lev = _level(_distance2(dims), eps)
    seen = (
        probes.alias("a").join(points.alias("b"), F.col("a._b") == F.col("b._cell")).select(F.col(f"a.{key}").alias(key), lev.alias("_l")).where(F.col("_l") < k)
        .groupBy(key).agg(*[F.sum((F.col("_l") <= j).cast("long")).alias(f"_c{j}") for j in range(k)])
    )
    found = points.join(open_until, "_cell").join(seen, key, "left")
    first = [
        sum(((F.lit(j) < F.col("_open")) & (F.coalesce(f"_c{j}", F.lit(0)) < m)).cast("int") for j in range(k)).alias(f"core_{i}") for i, m in enumerate(min_samples)
    ]
    return written(found.select(key, *dims, "_cell", *first)), cells


def _tagged(points: DataFrame, k: int, counts: int) -> DataFrame:
    """Core points once per setting ``_m, _j`` in which they are core."""
    tags = [F.when(F.col(f"core_{i}") <= j, F.struct(F.lit(i).alias("_m"), F.lit(j).alias("_j"))) for i in range(counts) for j in range(k)]
    return points.withColumn("_t", F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull()))).select("*", "_t._m", "_t._j").drop("_t")


def _apart(open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``_m, _a, _b`` whose cells are in different components, with these as ``a, b``."""
    root = nodes.select("_m", "_cell", "_now")
    both = open_.select("_m", "_a", "_b").join(root.toDF("_m", "_a", "a"), ["_m", "_a"]).join(root.toDF("_m", "_b", "b"), ["_m", "_b"])
    return both.where("a <> b")


def _joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the components that ``links`` (``_m, _a, _b``) bring together."""
    found = components(_apart(links, nodes).select("a", "b").distinct())
    step = written(nodes.join(found.toDF("_now", "_next"), "_now", "left").withColumn("_now", F.coalesce("_next", "_now")).drop("_next"))
    discard(nodes.sparkSession, nodes)
    return step


def _met(open_: DataFrame, cores: DataFrame, dims: list[str], radius: float) -> DataFrame:
    """The pairs of ``open_`` of which one outermost core point reaches an outermost one of the other cell."""
    ends = [f(F.array(*dims), c) for c in dims for f in (F.min_by, F.max_by)]
    cells = open_.select("_m", F.explode(F.array("_a", "_b")).alias("_cell")).distinct()
    ends = written(cores.join(cells, ["_m", "_cell"], "left_semi").groupBy("_m", "_cell").agg(F.array(*ends).alias("w")))
    near = lambda x, y: sum((F.pow(x[i] - y[i], 2) for i in range(len(dims))), F.lit(0.0)) <= radius**2
    both = open_.join(ends.toDF("_m", "_a", "x"), ["_m", "_a"]).join(ends.toDF("_m", "_b", "y"), ["_m", "_b"])
    return both.where(F.exists("x", lambda x: F.exists("y", lambda y: near(x, y)))).select("_m", "_a", "_b")


def cell_links(open_: DataFrame, nodes: DataFrame, cores: DataFrame, dims: list[str], radius: float, side: float) -> DataFrame:
    """``nodes`` after all pairs of ``open_`` (``_m, _a, _b``) have been decided: do core points of the two cells reach each other?

    Boxes around the core points of a cell decide most pairs: boxes whose farthest corners are in reach are
    linked, boxes out of reach are not. Undecided pairs are looked at again with smaller boxes unless other links have
    joined their components, and what is left then is compared point by point in boxes that may touch, so the answer is exact.
    """
    same = (F.col("a._m") == F.col("b._m")) & (F.col("a._b") == F.col("b._cell"))
    for level in range(BOX_LEVELS + 1):
        small = side / 4**level
        cells = open_.select("_m", F.explode(F.array("_a", "_b")).alias("_cell")).distinct()
        sub = F.concat_ws("|", *[F.floor(F.col(c) / small).cast("string") for c in dims]) if level else F.lit("")
        subbed = cores.join(cells, ["_m", "_cell"], "left_semi").withColumn("_sub", sub)
        boxes = written(subbed.groupBy("_m", "_cell", "_sub").agg(*_bounds(dims)))
        near = open_.join(boxes.withColumnRenamed("_cell", "_a"), ["_m", "_a"]).alias("a")
        met = near.join(boxes.alias("b"), same).where(_nearest2(dims) <= radius**2)
        if level == BOX_LEVELS:
            break
        judged = written(met.groupBy("a._m", "a._a", "a._b").agg(F.max((_farthest2(dims) <= radius**2).cast("int")).alias("_sure")))
        nodes = _joined(nodes, judged.where("_sure = 1"))
        open_ = written(_apart(judged.where("_sure = 0"), nodes).select("_m", "_a", "_b"))
        if open_.isEmpty():
            return nodes
    held = ["_m", "_a", "_b"]
    boxed = met.select(*[F.col(f"a.{c}") for c in held], F.col("a._sub").alias("_sa"), F.col("b._sub").alias("_sb"))
    own = ["_m", "_cell", "_sub", *dims]
    a = boxed.join(subbed.select(*own).toDF("_m", "_a", "_sa", *dims), ["_m", "_a", "_sa"]).alias("a")
    b = subbed.select(*own).toDF("_m", "_b", "_sb", *dims).alias("b")
    reach = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("_m", "_b", "_sb")]).where(_distance2(dims) <= radius**2)
    return _joined(nodes, reach.select(*[F.col(f"a.{c}") for c in held]).distinct())


def merge_forest(points: DataFrame, cells: DataFrame, dims: list[str], eps: list[float], counts: int) -> DataFrame:
    """``_m, _cell, _from, root_0 ... root_(k-1)``: the component of each cell with core points, radius by radius.

    A radius starts from the components of the one before and looks only at pairs of cells that are not in one
    component yet: first at their outermost points, which join neighbours in crowded space, then at what is left. So
    the work of a radius goes with the cells at the rim of components. ``_from`` is the first radius
    at which the cell has a core point; before it a root means nothing.
    """
    k, side = len(eps), eps[0] / math.sqrt(len(dims))
    unique = written(points.dropDuplicates(["_cell", *dims, *[f"core_{i}" for i in range(counts)]]))
    first = F.explode(F.array(*[F.struct(F.lit(i).alias("_m"), F.col(f"core_{i}").alias("_from")) for i in range(counts)]))
    firsts = unique.select("_cell", first.alias("t")).select("_cell", "t.*").where(F.col("_from") < k)
    nodes = firsts.groupBy("_m", "_cell").agg(F.min("_from").alias("_from")).withColumn("_now", F.concat_ws("|", F.col("_m").cast("string"), "_cell"))
    nodes, pairs = written(nodes), cells.where((F.col("_a") < F.col("_b")) & (F.col("lo") < k)).select("_a", "_b", "lo")
    for j, radius in enumerate(eps):
        wide = nodes.groupBy("_cell").agg(*[F.max(F.when(F.col("_m") == i, F.struct("_now", "_from"))).alias(f"n{i}") for i in range(counts)])
        wide = written(wide)
        ends = pairs.select("_a", "_b", "lo").join(wide.toDF("_a", *[f"a{i}" for i in range(counts)]), "_a").join(wide.toDF("_b", *[f"b{i}" for i in range(counts)]), "_b")
        apart = [F.coalesce(F.col(f"a{i}._now") != F.col(f"b{i}._now"), F.lit(False)) for i in range(counts)]
        ready = [F.when(apart[i] & (F.greatest(f"a{i}._from", f"b{i}._from") <= j), i) for i in range(counts)]
        pairs = written(ends.where(sum((c.cast("int") for c in apart), F.lit(0)) > 0).select("_a", "_b", "lo", F.filter(F.array(*ready), lambda i: i.isNotNull()).alias("_ready")))
        open_ = written(pairs.where(F.col("lo") <= j).select(F.explode("_ready").alias("_m"), "_a", "_b"))
        at = [F.when(F.col(f"core_{i}") <= j, i) for i in range(counts)]
        cores = unique.select("_cell", *dims, F.explode(F.filter(F.array(*at), lambda i: i.isNotNull())).alias("_m"))
        nodes = _joined(nodes, written(_met(open_, cores, dims, radius)))
        rest = written(_apart(open_, nodes).select("_m", "_a", "_b"))
        if not rest.isEmpty():
            nodes = cell_links(rest, nodes, cores, dims, radius, side)
        nodes, table = nodes.withColumn(f"root_{j}", F.col("_now")), nodes
        nodes._written_at = table._written_at
    return nodes.drop("_now")


def _touched(points: DataFrame, cells: DataFrame, key: str, dims: list[str], eps: list[float], counts: int) -> DataFrame:
    """``key, _m, _j, _cell``: cells with a core point in reach, for points that are not core themselves.

    A point that is not core for the largest count has fewer neighbours than that, so its pairs are few.
    """
    k, last = len(eps), f"core_{counts - 1}"
    thin = points.where(F.col(last) > 0).join(cells.select(F.col("_a").alias("_cell"), "_b", "lo"), "_cell").where(F.col("lo") < F.col(last))
    lev = _level(_distance2(dims), eps)
    of = lambda side, i: F.col(f"{side}.core_{i}")
    reach = [F.when(F.greatest(lev, of("b", i)) < of("a", i), F.struct(F.lit(i).alias("_m"), F.greatest(lev, of("b", i)).alias("_lo"), (of("a", i) - 1).alias("_hi"))) for i in range(counts)]
    met = thin.alias("a").join(points.alias("b"), F.col("a._b") == F.col("b._cell")).where(lev < F.least(F.col(f"a.{last}"), F.lit(k)))
    rows = met.select(F.col(f"a.{key}").alias(key), F.col("b._cell").alias("_cell"), F.explode(F.filter(F.array(*reach), lambda t: t.isNotNull())).alias("t"))
    return rows.select(key, "_cell", "t._m", F.explode(F.sequence("t._lo", "t._hi")).alias("_j")).distinct()


def _settings(df: DataFrame, key: str, eps: list[float], min_samples: list[int]) -> DataFrame:
    tags = [F.struct(F.lit(i).alias("_m"), F.lit(j).alias("_j"), F.lit(e).alias("eps"), F.lit(m).alias("min_samples")) for i, m in enumerate(min_samples) for j, e in enumerate(eps)]
    return df.select(key, F.explode(F.array(*tags)).alias("t")).select(key, "t.*")


def density_roles(df: DataFrame, key: str, dims: list[str], eps: list[float], min_samples: list[int]) -> DataFrame:
    """``key, eps, min_samples, role`` as in :func:`density_grid`, which needs no components."""
    eps, min_samples = sorted(set(map(float, eps))), sorted(set(min_samples))
    points, cells = core_levels(df.dropna(subset=dims), key, dims, eps, min_samples)
    cores = _tagged(points, len(eps), len(min_samples)).select(key, "_m", "_j", F.lit("core").alias("role"))
    border = _touched(points, cells, key, dims, eps, len(min_samples)).select(key, "_m", "_j").distinct().withColumn("role", F.lit("border"))
    every = _settings(df, key, eps, min_samples).join(cores.unionByName(border), [key, "_m", "_j"], "left")
    return every.select(key, "eps", "min_samples", F.coalesce("role", F.lit("noise")).alias("role"))


def density_grid(df: DataFrame, key: str, dims: list[str], eps: list[float], min_samples: list[int]) -> DataFrame:
    """``key, eps, min_samples, role, cluster`` for every point and every pair of settings.

    A point with ``min_samples`` points within ``eps`` (itself included) is core; clusters are components of core
    points; a border point has a core point within ``eps`` and joins the first cluster that it touches; noise has
    cluster -1. Clusters of a setting are numbered by their smallest core key. ``key`` must be unique; rows with a
    null in ``dims`` are noise in every setting. No rows give no rows.
    """
    eps, min_samples = sorted(set(map(float, eps))), sorted(set(min_samples))
    k, counts = len(eps), len(min_samples)
    whole = df.dropna(subset=dims)
    points, cells = core_levels(whole, key, dims, eps, min_samples)
    forest = merge_forest(points, cells, dims, eps, counts)
    roots = F.explode(F.array(*[F.struct(F.lit(j).alias("_j"), F.col(f"root_{j}").alias("_root")) for j in range(k)]))
    rooted = written(forest.select("_m", "_cell", "_from", roots.alias("t")).select("_m", "_cell", "_from", "t.*").where("_j >= _from").drop("_from"))
    cores = _tagged(points, k, counts).select(key, "_m", "_j", "_cell").join(rooted, ["_m", "_j", "_cell"])
    firsts = cores.groupBy("_m", "_j", "_root").agg(F.min(key).alias("_first"))
    number = row_positions(firsts, ["_m", "_j"], [F.col("_first")], "cluster")
    numbered = written(rooted.join(number.select("_m", "_j", "_root", (F.col("cluster") - 1).alias("cluster")), ["_m", "_j", "_root"]).drop("_root"))
    core_rows = _tagged(points, k, counts).join(numbered, ["_m", "_j", "_cell"]).select(key, "_m", "_j", F.lit("core").alias("role"), "cluster")
    touched = _touched(points, cells, key, dims, eps, counts)
    border = touched.join(numbered, ["_m", "_j", "_cell"]).groupBy(key, "_m", "_j").agg(F.min("cluster").alias("cluster")).withColumn("role", F.lit("border"))
    placed = core_rows.unionByName(border)
    every = _settings(df, key, eps, min_samples)
    return every.join(placed, [key, "_m", "_j"], "left").select(
        key, "eps", "min_samples", F.coalesce("role", F.lit("noise")).alias("role"), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster")
    )


def explored(labels: DataFrame, df: DataFrame, key: str, dims: list[str], n: int = 2000, seed: int = 42) -> DataFrame:
    """Per setting of ``labels``: core, border and noise points, share of noise, clusters, and the mean silhouette.

    The silhouette takes noise as one more cluster and is null with fewer than two clusters.
    """
    counts = labels.groupBy("eps", "min_samples").agg(
        *[F.sum((F.col("role") == r).cast("long")).alias(r) for r in ("core", "border", "noise")], (F.sum((F.col("role") == "noise").cast("double")) / one()).alias("noise_share"),
        F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"),
    )
    joined = counts.join(sampled_silhouettes(labels, df, key, dims, ["eps", "min_samples"], n, seed), ["eps", "min_samples"], "left")
    return joined.withColumn("silhouette", F.when(F.col("clusters") > 1, F.col("silhouette")))


def best_setting(table: DataFrame) -> DataFrame:
    """The row with the highest silhouette; of equal ones less noise, then fewer clusters, then smaller settings."""
    return table.orderBy(F.col("silhouette").desc_nulls_last(), "noise_share", "clusters", "eps", "min_samples").limit(1)


def noise_rows(labels: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` that are noise, once per setting, with ``eps`` and ``min_samples``."""
    return df.join(labels.where("role = 'noise'").select(key, "eps", "min_samples"), key)
