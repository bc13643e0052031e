"""Ward's hierarchy by parallel merging of reciprocal nearest neighbours.

Ward's distance is reducible: merging two clusters brings none of the others nearer. So two clusters that
are each other's nearest neighbours are merged in the dendrogram whatever happens elsewhere, and all such
pairs can be merged in one round. A cluster is a row of its size and its centre; no distance matrix is kept.

A round deals the clusters to boxes that part the space. A centre inside a box stays inside when its clusters merge,
so a box merges on, as far as no cluster outside of it can be nearer; the next round cuts the space elsewhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.operators.aggregates import one
from stockloom.operators.components import components
from stockloom.operators.prefix import row_positions
from stockloom.session import discard, written

FINISH = 1000
BOX = 6000
WIDEST = 12_000
SAMPLE = 20_000
LEAF = 64
NEAR_BOX = 10_000


def _leaves(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, starts)``: rows dealt to leaves of at most ``size`` by halving the widest column; equal rows stay together."""
    todo, leaves = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        spread = np.ptp(x[rows], axis=0) if len(rows) > size else np.zeros(1)
        if spread.max() <= 0:
            leaves.append(rows)
            continue
        half = len(rows) // 2
        rows = rows[np.argpartition(x[rows, spread.argmax()], half)]
        todo += [rows[:half], rows[half:]]
    return np.concatenate(leaves), np.cumsum([0] + [len(r) for r in leaves])


def nearest_of(ids: np.ndarray, n: np.ndarray, c: np.ndarray, asked: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(near, grown)`` for each cluster of ``asked`` (ids, n, c, bound): the cluster of the first table with the least growth up to the
    bound, -1 without any; ties by the pair's ids. Without ``asked`` every cluster of the table asks for the others.

    Clusters that ask are taken leaf by leaf, and only leaves within their bounds are looked at. A matrix product finds those
    that may be nearest, and their growth is then computed without its rounding.
    """
    own = asked is None
    q_ids, q_n, q_c, bound = (ids, n, c, np.full(len(ids), np.inf)) if own else asked
    near, grown = np.full(len(q_ids), -1, np.int64), np.array(bound, float)
    if not len(ids) or not len(q_ids):
        return near, grown
    order, starts = _leaves(c, LEAF)
    q_order, q_starts = (order, starts) if own else _leaves(q_c, LEAF)
    ids, n, c = ids[order], n[order], c[order]
    lo, hi, sizes, least, middle = np.minimum.reduceat(c, starts[:-1]), np.maximum.reduceat(c, starts[:-1]), np.diff(starts), n.min(), c.mean(axis=0)
    x, y = c - middle, q_c - middle
    x2, y2 = (x * x).sum(axis=1), (y * y).sum(axis=1)
    right, left = np.column_stack([x, np.ones(len(x)), x2]).T.copy(), np.column_stack([-2 * y, y2, np.ones(len(y))])
    slack = 1e-13 * (x2.max() + y2.max())

    def look(q: np.ndarray, at: np.ndarray, places: np.ndarray | None) -> None:
        about = left[q] @ right[:, at]
        about /= 1 / q_n[q][:, None] + 1 / n[at]
        if places is not None:
            about[np.arange(len(q)), np.searchsorted(at, places)] = np.inf
        most = np.minimum(about.min(axis=1), grown[q]) + slack * q_n[q]
        i, j = np.nonzero((about <= most[:, None]) & (about < np.inf))
        k, m = q[i], at[j]
        exact = np.zeros(len(k))
        for v in range(c.shape[1]):
            exact += (q_c[k, v] - c[m, v]) ** 2
        exact *= q_n[k] * n[m] / (q_n[k] + n[m])
        ranked = np.lexsort((np.maximum(q_ids[k], ids[m]), np.minimum(q_ids[k], ids[m]), exact, i))
        ranked = ranked[np.r_[True, i[ranked][1:] != i[ranked][:-1]]] if len(ranked) else ranked
        ranked = ranked[exact[ranked] <= grown[k[ranked]]]
        near[k[ranked]], grown[k[ranked]] = ids[m[ranked]], exact[ranked]

    for a, b in zip(q_starts[:-1], q_starts[1:]):
        q, places = q_order[a:b], np.arange(a, b) if own else None
        if own and b - a > 1:
            look(q, places, places)
        gap = np.maximum(np.maximum(lo - q_c[q].max(axis=0), q_c[q].min(axis=0) - hi), 0.0)
        reach = (grown[q] * (1 / q_n[q] + 1 / least)).max() * (1 + 1e-9)
        at = np.flatnonzero(np.repeat((gap * gap).sum(axis=1) <= reach, sizes))
        if len(at) and (not own or len(at) > 1):
            look(q, at, places if own and len(np.intersect1d(places, at)) else None)
    return near, grown


def nearest_clusters(clusters: DataFrame, d: int, box: int = NEAR_BOX) -> DataFrame:
    """``id, near, grown`` for ``clusters(id, n, c0 ...)``: the cluster with the least growth, ties by the pair's ids.

    Space is parted into boxes of about ``box`` clusters. A cluster looks in its own box first, and then in every box that
    comes within the distance at which a cluster could still do better; so no nearer one is missed.
    """
    centre = [f"c{i}" for i in range(d)]
    count, least = clusters.agg(one(), F.min("n")).first()
    cuts, lo, hi = _boxes(clusters, d, count, -(-count // box), 0)
    columns = ", ".join(f"{c} double" for c in centre)
    schema = f"box long, own boolean, id long, n double, {columns}, near long, grown double"
    names = ["box", "own", "id", "n", *centre, "near", "grown"]

    def inside(x: pd.DataFrame) -> pd.DataFrame:
        c, n = x[centre].to_numpy(), x["n"].to_numpy()
        near, grown = nearest_of(x["id"].to_numpy(), n, c)
        x = x.assign(own=True, near=near, grown=grown)[names]
        reach, parts = grown * (1 / n + 1 / least) * (1 + 1e-9), [x]
        for other in range(len(lo)):
            gap = np.maximum(np.maximum(lo[other] - c, c - hi[other]), 0.0)
            if other != x["box"].iloc[0]:
                parts.append(x[(gap * gap).sum(axis=1) <= reach].assign(box=other, own=False))
        return pd.concat(parts)

    def outside(x: pd.DataFrame) -> pd.DataFrame:
        own, asked = x[x["own"]], x[~x["own"]]
        columns_of = lambda t: (t["id"].to_numpy(), t["n"].to_numpy(), t[centre].to_numpy())
        near, grown = nearest_of(*columns_of(own), (*columns_of(asked), asked["grown"].to_numpy()))
        found = asked.assign(near=near, grown=grown)[near >= 0]
        return pd.concat([own[own["near"] >= 0], found])[["id", "near", "grown"]]

    dealt = _dealt(clusters, d, cuts).repartition(len(lo), "box")
    first = written(dealt.groupBy("box").applyInPandas(inside, schema))
    found = first.repartition(len(lo), "box").groupBy("box").applyInPandas(outside, "id long, near long, grown double")
    order = F.min(F.struct("grown", F.least("id", "near").alias("lo"), F.greatest("id", "near").alias("hi"))).alias("best")
    best = found.groupBy("id").agg(order)
    return best.select("id", F.when(F.col("best.lo") == F.col("id"), F.col("best.hi")).otherwise(F.col("best.lo")).alias("near"), F.col("best.grown").alias("grown"))


def _cuts(sample: np.ndarray, boxes: int, seed: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """``(cuts, lo, hi)``: a tree of cuts into about ``boxes`` boxes of equal shares of the sample, and the corners of each.

    A cut is (column, value, child below, child from the value on); a child below 0 is box ``-child - 1``. Columns and
    places are drawn anew for every seed, so what lies at a border in one round lies inside in another.
    """
    rng, d = np.random.default_rng(seed), sample.shape[1]
    cuts, corners = [], []

    def part(x: np.ndarray, share: int, lo: np.ndarray, hi: np.ndarray) -> int:
        spread = np.ptp(x, axis=0) if len(x) else np.zeros(d)
        if share <= 1 or spread.max(initial=0) <= 0:
            corners.append((lo, hi))
            return -len(corners)
        c = int(rng.choice(d, p=spread / spread.sum()))
        below = min(max(round(share * rng.uniform(0.35, 0.65)), 1), share - 1)
        v = np.sort(x[:, c])[min(len(x) * below // share, len(x) - 1)]
        v = v if v > x[:, c].min() else x[x[:, c] > v, c].min()
        at = len(cuts)
        cuts.append(None)
        left_hi, right_lo = hi.copy(), lo.copy()
        left_hi[c] = right_lo[c] = v
        left = x[:, c] < v
        cuts[at] = (c, v, part(x[left], below, lo, left_hi), part(x[~left], share - below, right_lo, hi))
        return at

    part(sample, boxes, np.full(d, -np.inf), np.full(d, np.inf))
    return cuts, np.array([x for x, _ in corners]), np.array([x for _, x in corners])


def _box_of(x: np.ndarray, cuts: list[tuple]) -> np.ndarray:
    """The box of every row, down the tree of cuts."""
    box, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))] if cuts else []
    while todo:
        at, rows = todo.pop()
        c, v, below, above = cuts[at]
        left = x[rows, c] < v
        for child, part in ((below, rows[left]), (above, rows[~left])):
            if child < 0:
                box[part] = -child - 1
            elif len(part):
                todo.append((child, part))
    return box


def _boxes(clusters: DataFrame, d: int, count: int, boxes: int, seed: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """The cuts into about ``boxes`` boxes by a bounded sample of the clusters, and their corners."""
    sample = []
    if boxes > 1:
        sample = clusters.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(-(-count // SAMPLE))) == 0).select(*[f"c{i}" for i in range(d)]).limit(2 * SAMPLE).collect()
    return _cuts(np.array(sample, float).reshape(-1, d), boxes, seed)


def _dealt(clusters: DataFrame, d: int, cuts: list[tuple]) -> DataFrame:
    """``clusters`` with their box."""
    centre = [f"c{i}" for i in range(d)]

    def placed(batches):
        for x in batches:
            yield x.assign(box=_box_of(x[centre].to_numpy(), cuts))

    return clusters.select("id", "n", *centre).mapInPandas(placed, f"id long, n double, {', '.join(f'{c} double' for c in centre)}, box long")


def _merged_in_boxes(clusters: DataFrame, d: int, count: int, box: int, seed: int) -> DataFrame:
    """``a, b, height, n, c0 ...``: the merges that are certain inside a box of about ``box`` clusters, and with no ``b`` the clusters left."""
    centre = [f"c{i}" for i in range(d)]
    least = float(clusters.agg(F.min("n")).first()[0])
    boxes = -(-count // box)
    cuts, lo, hi = _boxes(clusters, d, count, boxes, seed)

    def merged(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("id")
        at = int(x["box"].iloc[0])
        merges, (ids, n, c) = chained(x["id"].to_numpy(), x["n"].to_numpy(), x[centre].to_numpy(), lo[at], hi[at], least)
        rows = pd.DataFrame(merges, columns=["a", "b", "height", "n"]).astype({"a": "int64", "b": "Int64", "height": "float64", "n": "float64"})
        left = pd.DataFrame({"a": ids, "b": pd.array([None] * len(ids), "Int64"), "height": 0.0, "n": n, **{f"c{i}": c[:, i] for i in range(d)}})
        return pd.concat([rows.reindex(columns=left.columns), left])

    columns = ", ".join(f"{c} double" for c in centre)
    # A box is much work in few bytes, so each gets a task.
    return _dealt(clusters, d, cuts).repartition(boxes, "box").groupBy("box").applyInPandas(merged, f"a long, b long, height double, n double, {columns}")


def _merged_pairs(clusters: DataFrame, d: int) -> DataFrame:
    """The same table for one round over the whole space: all reciprocal nearest neighbours, wherever they are."""
    centre = [f"c{i}" for i in range(d)]
    near = written(nearest_clusters(clusters, d))
    both = near.alias("x").join(near.alias("y"), F.col("x.near") == F.col("y.id")).where("y.near = x.id and x.id < y.id")
    pairs = written(both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.grown").alias("grown")))
    of = clusters.join(pairs.select(F.col("b").alias("id"), F.col("a").alias("into")), "id", "left")
    total = F.sum("n")
    joined = of.groupBy(F.coalesce("into", "id").alias("a")).agg(total.alias("n"), *[(F.sum(F.col(c) * F.col("n")) / total).alias(c) for c in centre])
    left = joined.select("a", F.lit(None).cast("long").alias("b"), F.lit(0.0).alias("height"), "n", *centre)
    return left.unionByName(pairs.join(left.select("a", "n", *centre), "a").select("a", "b", F.sqrt(2 * F.col("grown")).alias("height"), "n", *centre))


def ward_merges(df: DataFrame, key: str, cols: list[str], finish: int = FINISH, box: int = BOX, widest: int = WIDEST) -> DataFrame:
    """The dendrogram ``a, b, height, size``: the clusters named by their smallest keys, merged at a height.

    Heights are those of the usual linkage, sqrt(2 x growth of the squared error). Equal rows are merged first, at
    height 0. When at most ``finish`` clusters are left, their sizes and centres are collected and merged on; so
    many rows are bounded whatever the table. A box has about ``box`` clusters. Once a round merges less than 15 in a hundred, as with
    many columns, where most of a box lies at its border, rounds merge all nearest pairs of the whole space, until
    ``widest`` are left, which one task merges on.
    ``key`` must be a unique whole number; nulls in ``cols`` count as 0.
    """
    d, spark = len(cols), df.sparkSession
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(cols)]
    rows = written(df.select(F.col(key).cast("long").alias("id"), *values))
    centre = [f"c{i}" for i in range(d)]
    equal = written(rows.groupBy(*centre).agg(F.min("id").alias("a"), one().cast("double").alias("n")))
    copies = rows.join(equal.where("n > 1"), centre).where("id <> a").select("a", F.col("id").alias("b"), F.lit(0.0).alias("height"), F.lit(None).cast("double").alias("size"))
    merges = [copies]
    clusters = written(equal.select(F.col("a").alias("id"), "n", *centre))
    count, step, slow = clusters.count(), 0, False
    while count > finish:
        step += 1
        if slow and count > widest:
            found = written(_merged_pairs(clusters, d))
        else:
            found = written(_merged_in_boxes(clusters, d, count, count if slow else box, step))
        merges.append(found.where("b is not null").select("a", "b", "height", F.col("n").alias("size")))
        clusters = found.where("b is null").select(F.col("a").alias("id"), "n", *centre)
        before, count = count, clusters.count()
        slow = slow or count > 0.85 * before
    last = chained(*_columns(clusters, centre))[0]
    merges.append(spark.createDataFrame(last, "a long, b long, height double, size double"))
    out = merges[0]
    for more in merges[1:]:
        out = out.unionByName(more)
    return written(out)


def _columns(clusters: DataFrame, centre: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = clusters.orderBy("id").collect()  # at most ``finish``
    return np.array([r.id for r in rows], np.int64), np.array([r.n for r in rows]), np.array([[r[c] for c in centre] for r in rows]).reshape(len(rows), len(centre))


def chained(ids: np.ndarray, n: np.ndarray, centre: np.ndarray, lo=-np.inf, hi=np.inf, least: float = 1.0) -> tuple[list[tuple[int, int, float, float]], tuple]:
    """``(merges, clusters left)`` of a bounded number of clusters in order of ``ids``, by walking to nearest neighbours until two are each other's.

    Clusters of at least ``least`` rows may lie outside of the box from ``lo`` to ``hi``. A cluster that may be nearer to one
    of those waits, and so does one whose nearest neighbour waits; both stay so, because merging brings none nearer.
    Of equal growth the smaller id counts.
    """
    ids, n, c, alive = ids.copy(), n.astype(float).copy(), centre.astype(float).T.copy(), np.ones(len(ids), bool)
    lo, hi = np.broadcast_to(lo, len(c)), np.broadcast_to(hi, len(c))
    out, chain, waits, at, dead = [], [], np.zeros(len(ids), bool), 0, 0
    while True:
        if dead > 64 and dead > len(ids) // 4:  # only the living are looked at
            to = np.cumsum(alive) - 1
            chain = [int(to[x]) for x in chain if alive[x]]
            at = int(alive[:at].sum())
            ids, n, c, waits, alive, dead = ids[alive], n[alive], c[:, alive].copy(), waits[alive], np.ones(int(alive.sum()), bool), 0
        while chain and not alive[chain[-1]]:
            chain.pop()
        if not chain:
            while at < len(ids) and (waits[at] or not alive[at]):
                at += 1
            if at == len(ids):
                break
            chain = [at]
        x = chain[-1]
        grown = np.zeros(len(ids))
        for v in c:
            grown += (v - v[x]) ** 2
        grown *= n[x] * n / (n[x] + n)
        grown[~alive] = np.inf
        grown[x] = np.inf
        y = int(grown.argmin())
        edge = max(min((c[:, x] - lo).min(), (hi - c[:, x]).min()), 0.0)
        certain = grown[y] < np.inf and (edge == np.inf or grown[y] < n[x] * least / (n[x] + least) * edge * edge * (1 - 1e-9))
        if not certain or waits[y]:
            waits[chain] = True
            chain = []
        elif len(chain) > 1 and y == chain[-2]:
            chain = chain[:-2]
            a, b = min(x, y), max(x, y)
            size = n[a] + n[b]
            c[:, a] = (c[:, a] * n[a] + c[:, b] * n[b]) / size
            n[a] = size
            alive[b] = False
            dead += 1
            at = min(at, a)
            out.append((int(ids[a]), int(ids[b]), float(np.sqrt(2 * grown[y])), float(size)))
        else:
            chain.append(y)
    return out, (ids[alive], n[alive], c[:, alive].T)


def ward_labels(df: DataFrame, key: str, merges: DataFrame, ks: list[int]) -> DataFrame:
    """``key, k, cluster``: every row's cluster where the dendrogram has ``k`` clusters, numbered by their smallest key.

    The highest merges are undone: one component run finds the clusters of the largest k, and the few merges above
    them join these to the clusters of the smaller k. With fewer than k rows each row is a cluster of its own.
    """
    ks = sorted(set(ks))
    spark = df.sparkSession
    order = [F.col("height").desc(), F.col("a").desc(), F.col("b").desc()]
    top = merges.orderBy(*order).limit(ks[-1] - 1).collect()  # at most the largest k less one
    kept = merges.join(spark.createDataFrame([(r.a, r.b) for r in top], "a long, b long"), ["a", "b"], "left_anti") if top else merges
    base = written(components(kept.select("a", "b")))
    rows = df.select(F.col(key).cast("long").alias("node"), F.col(key).alias("_key"))
    placed = written(rows.join(base, "node", "left").select("_key", F.coalesce("component", "node").alias("base")))
    named = placed.groupBy("base").agg(F.min("_key").alias("first"))
    ends = {r.a for r in top} | {r.b for r in top}
    found = placed.where(F.col("_key").isin(list(ends))).collect() if ends else []
    root = {int(r["_key"]): int(r["base"]) for r in found}
    step = []
    for k in ks:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        for r in top[k - 1 :]:
            a, b = sorted((find(root[r.a]), find(root[r.b])))
            if a != b:
                parent[b] = a
        step += [(k, x, find(x)) for x in set(root.values())]
    if step:
        moved = spark.createDataFrame(step, "k int, base long, joined long")
    else:
        moved = spark.createDataFrame([], "k int, base long, joined long")
    every = named.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    joined = every.join(moved, ["k", "base"], "left").withColumn("joined", F.coalesce("joined", "base"))
    firsts = joined.groupBy("k", "joined").agg(F.min("first").alias("first"))
    number = row_positions(firsts, ["k"], [F.col("first")], "cluster").select("k", "joined", (F.col("cluster") - 1).cast("int").alias("cluster"))
    by_base = joined.join(number, ["k", "joined"]).select("k", "base", "cluster")
    return placed.join(by_base, "base").select(F.col("_key").alias(key), "k", "cluster")
