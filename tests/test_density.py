"""The grid of density clusterings against brute force."""

import numpy as np
import pytest

from stockloom.operators import density as D
from tests.test_operators import brute_dbscan

EPS, COUNTS = [0.15, 0.3, 0.45, 0.9], [3, 5, 12]


def clouds(dims, seed=7):
    rng = np.random.default_rng(seed)
    # A third of all points in one crowded spot, equal points, a chain, scattered ones.
    chain = np.column_stack([np.linspace(-2, 2, 40), *[np.zeros(40)] * (dims - 1)])
    return np.vstack([rng.normal(0, 0.02, (120, dims)), np.full((20, dims), 3.0), rng.normal(2, 0.4, (90, dims)), chain, rng.uniform(-3, 5, (50, dims))])


def brute_labels(x, eps, m):
    """Roles, and clusters numbered by their smallest core point; border points join the first they touch."""
    role, label = brute_dbscan(x, eps, m)
    order = {c: n for n, c in enumerate(dict.fromkeys(label[i] for i in sorted(label)))}
    out = {}
    for i, r in role.items():
        near = [order[label[j]] for j in label if ((x[i] - x[j]) ** 2).sum() <= eps * eps]
        out[i] = (r, order[label[i]] if r == "core" else min(near) if r == "border" else -1)
    return out


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_every_setting_matches_brute_force(spark, dims):
    x = clouds(dims)
    names = ["a", "b", "c"][:dims]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], f"id int, {', '.join(f'{n} double' for n in names)}")
    labels = D.density_grid(df, "id", names, EPS, COUNTS)
    got = {}
    for r in labels.collect():
        got.setdefault((r.eps, r.min_samples), {})[r.id] = (r.role, r.cluster)
    assert set(got) == {(e, m) for e in EPS for m in COUNTS}
    for (e, m), own in got.items():
        assert own == brute_labels(x, e, m), (e, m)


def test_exploration_choice_and_noise(spark):
    x = clouds(2, seed=3)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id int, a double, b double")
    labels = D.written(D.density_grid(df, "id", ["a", "b"], EPS, COUNTS))
    table = {(r.eps, r.min_samples): r for r in D.explored(labels, df, "id", ["a", "b"]).collect()}
    scores = {}
    for (e, m), row in table.items():
        want = brute_labels(x, e, m)
        roles = [r for r, _ in want.values()]
        cluster = np.array([want[i][1] for i in range(len(x))])
        assert (row.core, row.border, row.noise, row.clusters) == (roles.count("core"), roles.count("border"), roles.count("noise"), len(set(cluster) - {-1}))
        assert row.noise_share == pytest.approx(row.noise / len(x))
        assert (row.silhouette is None) == (row.clusters < 2)
        if row.silhouette is not None:
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
            s = []
            for i in range(len(x)):
                own = cluster == cluster[i]
                inner = d[i][own].sum() / max(own.sum() - 1, 1)
                outer = min(d[i][cluster == c].mean() for c in set(cluster) - {cluster[i]})
                s.append((outer - inner) / max(inner, outer) if own.sum() > 1 else 0.0)
            assert row.silhouette == pytest.approx(np.mean(s))
            scores[(e, m)] = (-row.silhouette, row.noise_share, row.clusters, e, m)
    best = D.best_setting(spark.createDataFrame(list(table.values()))).first()
    assert (best.eps, best.min_samples) == min(scores, key=scores.get)
    noise = D.noise_rows(labels, df, "id")
    assert noise.count() == sum(r.noise for r in table.values()) and set(noise.columns) == {"id", "a", "b", "eps", "min_samples"}


def test_density_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 9.0, 9.0)], "id int, a double, b double")
    got = {(r.id, r.min_samples): (r.role, r.cluster) for r in D.density_grid(df, "id", ["a", "b"], [0.5], [2, 1]).collect()}
    assert got == {(1, 1): ("noise", -1), (1, 2): ("noise", -1), (2, 1): ("core", 0), (3, 1): ("core", 0), (4, 1): ("core", 1), (2, 2): ("core", 0), (3, 2): ("core", 0), (4, 2): ("noise", -1)}
    assert D.density_grid(df.limit(0), "id", ["a", "b"], [0.5], [2]).collect() == []
    assert D.explored(D.density_grid(df.limit(0), "id", ["a", "b"], [0.5], [2]), df.limit(0), "id", ["a", "b"]).collect() == []


def test_crowded_space_needs_no_boxes(spark, monkeypatch):
    x = np.random.default_rng(5).uniform(0, 3, (4000, 3))
    looked = []
    plain = D.cell_links
    monkeypatch.setattr(D, "cell_links", lambda open_, *a: looked.append(open_.count()) or plain(open_, *a))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id int, a double, b double, c double")
    labels = D.density_grid(df, "id", ["a", "b", "c"], [0.6, 0.8], [3, 5])
    assert {(r.role, r.cluster) for r in labels.select("role", "cluster").distinct().collect()} == {("core", 0)}
    assert sum(looked) < 100  # of some thousand pairs of cells, for each count and radius
