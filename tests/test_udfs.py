"""Hooks for user functions: many groups to a batch, groups over several batches, keys that are null."""

import pytest
from pyspark.sql import functions as F

from stockloom.operators.udfs import custom_aggregate, grouped_map_apply


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def sample(spark):
    big = 2**53 + 1
    rows = [(i % 5 if i % 5 else None, "x" if i % 3 else None, big + i if i % 4 else None) for i in range(200)] + [(9, "hot", i) for i in range(100)]
    return spark.createDataFrame(rows, "k long, s string, v long").repartition(3)


def test_groups_are_whole_whatever_the_batches(spark, small_batches):
    df = sample(spark)

    def largest(pdf):
        assert len(pdf[["k", "s"]].drop_duplicates()) == 1
        out = pdf[["k", "s"]].head(1).assign(n=len(pdf), top=str(int(pdf["v"].dropna().max())) if pdf["v"].notna().any() else None)
        return out

    got = {(r.k, r.s): r.n for r in grouped_map_apply(df, ["k", "s"], largest, "k long, s string, n long, top string").collect()}
    assert got == {(r.k, r.s): r["count"] for r in df.groupBy("k", "s").count().collect()}
    assert grouped_map_apply(df.limit(0), ["k"], largest, "k long, n long").collect() == []


def test_many_groups_go_through_python_in_one_message(spark):
    df = spark.range(5000).selectExpr("id as k", "id * 2 as v")
    plan = grouped_map_apply(df, ["k"], lambda pdf: pdf, "k long, v long")
    assert "FlatMapGroups" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {(r.k, r.v) for r in plan.collect()} == {(i, 2 * i) for i in range(5000)}


def test_whole_numbers_stay_whole_beside_nulls_of_other_groups(spark):
    df = spark.createDataFrame([(1, 2**53 + 1), (1, 3), (2, None)], "k long, v long").coalesce(1)
    got = grouped_map_apply(df, ["k"], lambda pdf: pdf[["k", "v"]].head(2), "k long, v long").collect()
    assert {(r.k, r.v) for r in got} == {(1, 2**53 + 1), (1, 3), (2, None)}


def test_states_of_a_group_meet_once(spark, small_batches):
    df = sample(spark).fillna(0, ["v"])
    got = custom_aggregate(df, ["k", "s"], "v", lambda v: str(len(v)).encode(), lambda a, b: str(int(a) + int(b)).encode(), lambda s: int(s), "n")
    assert {(r.k, r.s): r.n for r in got.collect()} == {(r.k, r.s): r["count"] for r in df.groupBy("k", "s").count().collect()}
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert custom_aggregate(df.limit(0), ["k"], "v", lambda v: b"", lambda a, b: a, lambda s: 0, "n").collect() == []


def test_tasks_of_a_spread_table_hold_a_bounded_number_of_rows(spark):
    from stockloom.session import spread

    df = spread(spark.range(1000).selectExpr("id as k", "id % 7 as v"), "k", rows=100)
    sizes = df.rdd.glom().map(len).collect()
    assert sum(sizes) == 1000 and len(sizes) == 11 and max(sizes) < 250


def test_sums_of_a_large_table_leave_no_task_more_than_its_rows(spark):
    from stockloom.session import summed

    df = spark.range(20_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 0 ELSE id % 6000 END AS p", "id * 1.0D AS v")
    out = summed(df, {"p": F.col("p")}, {"v": F.col("v")}, F.col("id"), rows=1000)
    assert out.rdd.getNumPartitions() == 21
    assert {r.p: r.v for r in out.collect()} == {r.p: r.v for r in df.groupBy("p").agg(F.sum("v").alias("v")).collect()}
    assert summed(df, {"p": F.col("p")}, {"v": F.col("v")}, F.col("id")).count() == 3001
