"""Ward's hierarchy by rounds of merges against the plain algorithm."""

import numpy as np
import pytest

from stockloom.operators import hierarchy as H


def brute_ward(x):
    """Heights of all merges, and the clusters (as sets of rows) for each number of clusters."""
    groups, heights, at = [frozenset([i]) for i in range(len(x))], [], {len(x): None}
    at[len(x)] = set(groups)
    while len(groups) > 1:
        best = None
        for i in range(len(groups)):
            for j in range(i):
                a, b = x[list(groups[i])], x[list(groups[j])]
                grown = len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()
                if best is None or grown < best[0]:
                    best = (grown, i, j)
        grown, i, j = best
        heights.append(np.sqrt(2 * grown))
        groups = [g for n, g in enumerate(groups) if n not in (i, j)] + [groups[i] | groups[j]]
        at[len(groups)] = set(groups)
    return heights, at


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, " + ", ".join(f"v{j} double" for j in range(x.shape[1])))


def clusters(labels, k):
    out = {}
    for r in labels:
        if r.k == k:
            out.setdefault(r.cluster, set()).add(r.id)
    return out


@pytest.mark.parametrize(("dims", "finish"), [(2, 3), (4, 20), (3, 1000)])
def test_heights_and_labels_are_those_of_the_plain_algorithm(spark, dims, finish):
    rng = np.random.default_rng(dims)
    x = np.vstack([rng.normal(0, 0.05, (40, dims)), rng.normal(3, 0.5, (25, dims)), rng.uniform(-4, 8, (15, dims)), np.full((4, dims), 1.5)])
    heights, at = brute_ward(x)
    df = frame(spark, x)
    merges = H.ward_merges(df, "id", df.columns[1:], finish)
    rows = merges.collect()
    assert len(rows) == len(x) - 1 and len({r.b for r in rows}) == len(rows)
    assert sorted(r.height for r in rows) == pytest.approx(sorted(heights), abs=1e-9)
    labels = H.ward_labels(df, "id", merges, range(3, 11)).collect()
    for k in range(3, 11):
        got = clusters(labels, k)
        assert {frozenset(g) for g in got.values()} == at[k]
        assert [min(got[c]) for c in sorted(got)] == sorted(map(min, got.values())) and sorted(got) == list(range(k))


@pytest.mark.parametrize(("box", "widest", "finish"), [(12, 1000, 20), (40, 1000, 3), (2, 3, 118)])
def test_boxes_merge_as_the_plain_algorithm(spark, box, widest, finish):
    rng = np.random.default_rng(box)
    x = np.vstack([rng.normal(0, 0.05, (40, 3)), rng.normal(3, 0.5, (50, 3)), rng.uniform(-4, 8, (25, 3)), np.full((4, 3), 1.5)])
    heights, at = brute_ward(x)
    df = frame(spark, x)
    merges = H.ward_merges(df, "id", df.columns[1:], finish, box, widest)
    rows = merges.collect()
    assert len(rows) == len(x) - 1 and len({r.b for r in rows}) == len(rows)
    assert sorted(r.height for r in rows) == pytest.approx(sorted(heights), abs=1e-9)
    labels = H.ward_labels(df, "id", merges, [3, 7]).collect()
    assert all({frozenset(g) for g in clusters(labels, k).values()} == at[k] for k in (3, 7))


def test_a_box_waits_for_what_may_be_nearer_outside():
    ids, n, c = np.arange(4), np.ones(4), np.array([[0.1], [0.5], [5.0], [5.2]])
    merges, left = H.chained(ids, n, c, np.array([0.0]), np.array([np.inf]))
    assert [(a, b) for a, b, _, _ in merges] == [(2, 3)] and left[0].tolist() == [0, 1, 2]
    assert len(H.chained(ids, n, c)[0]) == 3


def test_many_different_rows_take_few_rounds(spark, monkeypatch):
    rounds, plain = [], H._merged_in_boxes
    monkeypatch.setattr(H, "_merged_in_boxes", lambda *a: rounds.append(a[2]) or plain(*a))
    monkeypatch.setattr(H, "nearest_clusters", lambda *a: pytest.fail("rounds over the whole space"))
    df = frame(spark, np.random.default_rng(1).normal(size=(9000, 6)))
    assert H.ward_merges(df, "id", df.columns[1:]).count() == 8999 and len(rounds) < 8


def test_nearest_clusters_are_exact(spark):
    rng = np.random.default_rng(5)
    c = np.vstack([rng.normal(0, 0.001, (150, 4)), rng.normal(0, 3, (150, 4))])
    n = rng.integers(1, 60, len(c)).astype(float)
    df = spark.createDataFrame([(i, float(n[i]), *map(float, c[i])) for i in range(len(c))], "id long, n double, c0 double, c1 double, c2 double, c3 double")
    grown = n[:, None] * n / (n[:, None] + n) * ((c[:, None] - c) ** 2).sum(axis=2)
    np.fill_diagonal(grown, np.inf)
    got = {r.id: r for r in H.nearest_clusters(df, 4).collect()}
    assert {i: r.near for i, r in got.items()} == {i: int(g.argmin()) for i, g in enumerate(grown)}


def test_hierarchy_of_odd_tables(spark):
    df = spark.createDataFrame([(7, 1.0, None), (8, 1.0, 0.0), (9, 1.0, 0.0)], "id long, v0 double, v1 double")
    merges = H.ward_merges(df, "id", ["v0", "v1"], 2)
    assert sorted((r.a, r.b, r.height) for r in merges.collect()) == [(7, 8, 0.0), (7, 9, 0.0)]
    assert {(r.id, r.cluster) for r in H.ward_labels(df, "id", merges, [5]).collect()} == {(7, 0), (8, 1), (9, 2)}
    none = H.ward_merges(df.limit(0), "id", ["v0", "v1"])
    assert none.collect() == [] and H.ward_labels(df.limit(0), "id", none, [3]).collect() == []


def test_nearest_clusters_lie_in_other_boxes_too(spark):
    rng = np.random.default_rng(8)
    c = np.vstack([rng.normal(0, 0.01, (150, 5)), rng.normal(0, 2, (250, 5)), np.repeat(rng.normal(size=(4, 5)), 2, axis=0), np.full((1, 5), 40.0)])
    n = rng.integers(1, 60, len(c)).astype(float)
    df = spark.createDataFrame([(i, float(n[i]), *map(float, c[i])) for i in range(len(c))], "id long, n double, " + ", ".join(f"c{j} double" for j in range(5)))
    grown = n[:, None] * n / (n[:, None] + n) * ((c[:, None] - c) ** 2).sum(axis=2)
    np.fill_diagonal(grown, np.inf)
    got = {r.id: r for r in H.nearest_clusters(df, 5, box=30).collect()}
    assert len(got) == len(c) and all(got[i].near == int(g.argmin()) and got[i].grown == pytest.approx(g.min(), abs=1e-12) for i, g in enumerate(grown))
