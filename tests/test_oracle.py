"""Every registered query next to its SQL on the smallest tables."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
# Queries that train models for long and have no SQL; mixtures, hierarchy and learners have tests of their own.
SLOW = {"gmm_sweep", "hierarchical_clusters", "kmeans_sweep_embeddings", "train_regressors", "model_winners", "backtest_trained", "backtest_trained_summary", "trained_importance", "model_grid_search", "final_predictions", "feature_importance"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(set(queries()) - SLOW))
def test_query(spark, con, name):
    got = queries()[name](spark, SF).toArrow()
    sql = oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
    else:
        assert compare(got, con.sql(sql).to_arrow_table()) == []
