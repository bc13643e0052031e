"""Mixtures fitted by merged sums: against a plain fit, on known clouds, and on odd tables."""

import numpy as np
import pytest

from stockloom.operators import mixtures as G


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, " + ", ".join(f"v{j} double" for j in range(x.shape[1])))


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(11)
    return np.vstack([rng.normal((0, 0, 0), 0.3, (200, 3)), rng.normal((4, 0, 1), (0.2, 0.9, 0.4), (120, 3)), rng.normal((-3, 5, 0), 0.6, (80, 3))])


def test_all_candidates_fit_as_they_would_alone(spark, clouds):
    df = frame(spark, clouds).repartition(5)
    models = G.fit_mixtures(df, "id", ["v0", "v1", "v2"], range(3, 6))
    assert [(m.k, m.kind) for m in models] == [(k, kind) for k in range(3, 6) for kind in G.KINDS]
    for m in models:
        gains = np.diff(m.history)
        assert (gains > -1e-6 * abs(np.array(m.history[1:]))).all(), (m.k, m.kind)  # the likelihood never falls
        alone = G.start(np.array([[r.v0, r.v1, r.v2] for r in G.keyed_sample(df, "id", G.START_ROWS).collect()]), m.k, m.kind, 42)
        for step in range(len(m.history)):
            sums = alone.sums(clouds)
            assert sums[0] == pytest.approx(m.history[step], rel=1e-9)
            if step < len(m.history) - 1:
                alone = G.maximised(alone, sums)
        assert np.allclose(alone.means, m.means) and np.allclose(alone.covariances, m.covariances) and m.weights.sum() == pytest.approx(1)
        same = {"tied": np.ptp(m.covariances, axis=0).max(), "diag": abs(m.covariances * (1 - np.eye(3))).max()}
        same["spherical"] = np.ptp(np.einsum("kii->ki", m.covariances), axis=1).max() + same["diag"]
        assert same.get(m.kind, 0.0) < 1e-12


def test_sums_of_all_models_count_equal_rows_by_their_number(spark, clouds):
    models = [G.start(clouds, k, kind, 1) for k in (2, 4) for kind in G.KINDS]
    times = np.arange(len(clouds)) % 3 + 1.0
    for m, got in zip(models, G.all_sums(models, clouds, times)):
        assert np.allclose(got, m.sums(np.repeat(clouds, times.astype(int), axis=0)), rtol=1e-9, atol=1e-7)
    twice = frame(spark, np.vstack([clouds, clouds]))
    m = G.fit_mixtures(twice, "id", ["v0", "v1", "v2"], [3], ["full"])[0]
    assert m.n == 800 and np.allclose(sorted(m.weights), [0.2, 0.3, 0.5], atol=0.01)


def test_clouds_are_told_apart_and_bic_finds_them(spark, clouds):
    df = frame(spark, clouds)
    cols = ["v0", "v1", "v2"]
    models = G.fit_mixtures(df, "id", cols, range(2, 6))
    table = G.mixture_table(df, "id", cols, models)
    rows = {(r.k, r.kind): r for r in table.collect()}
    assert len(rows) == 16
    d, m = 3, next(m for m in models if (m.k, m.kind) == (3, "full"))
    assert m.bic == pytest.approx((3 * 6 + 9 + 2) * np.log(400) - 2 * m.log_likelihood)
    assert min((r for r in rows.values() if r.kind == "full"), key=lambda r: r.bic).k == d
    best = G.best_mixture(table, models)
    assert best.k == 3
    truth = np.repeat([0, 1, 2], [200, 120, 80])
    label = {r.id: r.cluster for r in G.mixture_labels(df, "id", cols, [best]).collect()}
    assert len({(truth[i], c) for i, c in label.items()}) == 3 and len(label) == 400


def test_mixtures_of_odd_tables(spark):
    df = spark.createDataFrame([(i, 1.0, None if i == 3 else 2.0) for i in range(6)], "id long, v0 double, v1 double")
    models = G.fit_mixtures(df, "id", ["v0", "v1"], [2, 9])
    assert {m.k for m in models} == {2} and all(np.isfinite(m.log_likelihood) for m in models)
    assert G.mixture_labels(df, "id", ["v0", "v1"], models).count() == 5 * 4
    assert G.fit_mixtures(df.limit(0), "id", ["v0", "v1"]) == []
