"""Every corpus query next to its SQL, and the pipeline stage by stage."""

import pytest

from __spark_entry__ import oracle_sql, queries
from corpus_pipeline import STAGES, run
from stockloom.llm.queries import QUERIES
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = queries()[name](spark, SF).toArrow()
    if name in oracle_sql():
        assert compare(got, connect(SF).sql(oracle_sql()[name]).to_arrow_table()) == []
    elif name == "op1_decontaminate":
        assert 0 < got.num_rows < 20
    else:
        table = "pages" if name.startswith("op6") else "documents"
        rows = got.num_rows if name != "op11_packing" else len(got.column("doc_id").unique())  # one row per piece
        assert rows == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left and left <= ids
        if name != STAGES[-1][0]:
            assert docs.columns == columns
        ids = left
    assert sorted(map(str, run(spark, SF).drop("map_version").collect())) == sorted(map(str, docs.drop("map_version").collect()))
