"""Rows that repeat an id or have none, maps that are edited later, and columns whose names clash."""

import pytest
from pyspark.sql import functions as F

from stockloom.llm.columns import free_names
from stockloom.llm.license_scan import scan_licenses
from stockloom.llm.minhash import near_duplicates, without_near_duplicates
from stockloom.llm.mixing import mixed_rows
from stockloom.llm.sharding import first_map, sharded, store_map, stored_map
from stockloom.llm.url_filter import spread

X = "one two three four five six seven eight nine ten"
Y = "eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def docs_of(spark, rows, more=()):
    names = ["id", "key", "row", "_row", "place", "places", "_position", "_epoch", *more]
    return spark.createDataFrame([(i, t, "s", *[f"{c} {n}" for c in names]) for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))


def test_texts_of_one_id_are_one_node(spark):
    got = near_duplicates(docs_of(spark, [(3, Y), (5, Y), (5, X), (4, X), (7, X), (9, None), (9, Y)]))
    assert {(r.doc_id, r.component_id, r.kept) for r in got.collect()} == {(3, 3, True), (4, 3, False), (5, 3, False), (7, 3, False), (9, 3, False)}


def test_no_row_leaves_because_of_another_text_of_its_id(spark):
    docs = docs_of(spark, [(3, Y), (5, Y), (5, X), (4, X), (7, X)])
    left = without_near_duplicates(docs)
    assert left.columns == docs.columns and {(r.doc_id, r.text) for r in left.collect()} == {(3, Y), (4, X)}
    docs = docs_of(spark, [(5, X), (5, Y), (5, X), (6, None), (6, ""), (None, X), (None, X)])
    left = without_near_duplicates(docs)
    rows = sorted((str(r.doc_id), r.text or "", r.row) for r in left.collect())
    assert rows == [("5", Y, "row 1"), ("5", X, "row 0"), ("6", "", "row 3"), ("None", X, "row 5"), ("None", X, "row 6")]


def test_rows_without_id_are_scanned_like_others(spark):
    notice = "under the mit license and this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    docs = docs_of(spark, [(1, notice), (None, notice), (None, X), (2, None)])
    found = scan_licenses(docs)
    rows = {r.doc_id if r.n_words else "none": r for r in found.collect() if r.n_words != 10}
    assert found.count() == 4 and rows[1].labels == rows[None].labels and "," in rows[1].labels
    assert rows[1].score == rows[None].score and rows[1].spans == rows[None].spans
    assert {(r.labels, r.score, r.spans) for r in found.collect() if r.n_words in (0, 10)} == {("", 0.0, None)}


def test_a_stored_map_is_edited_and_never_written_over(spark, tmp_path):
    path = str(tmp_path)
    versions = lambda: sorted(p.name for p in tmp_path.glob("version=*"))
    first = docs_of(spark, [(i, "a" * (i % 90)) for i in range(900)])
    before = {r.doc_id: r.shard for r in sharded(first, slots=256, map_path=path).collect()}
    one = {r.virtual_slot: r.shard for r in stored_map(spark, path, 1).collect()}
    assert versions() == ["version=000000", "version=000001"]
    again = sharded(first, slots=256, map_path=path)
    assert {r.doc_id: r.shard for r in again.collect()} == before and versions()[-1] == "version=000001"
    grown = docs_of(spark, [(i, "a" * (i % 90)) for i in range(900)] + [(i, "b" * 400) for i in range(900, 960)])
    rows = sharded(grown, slots=256, map_path=path).collect()
    two = {r.virtual_slot: r.shard for r in stored_map(spark, path, 2).collect()}
    assert versions()[-1] == "version=000002" and {r.map_version for r in rows} == {2}
    assert {r.virtual_slot: r.shard for r in stored_map(spark, path, 1).collect()} == one
    assert two != one and sum(two[s] == one[s] for s in one) > 128  # most slots stay
    assert all(two[r.virtual_slot] == r.shard for r in rows)
    wider = sharded(grown, shards=20, slots=256, map_path=path).collect()
    assert {r.map_version for r in wider} == {3} and {r.shard for r in wider} == set(range(20))
    with pytest.raises(ValueError, match="other slots"):
        sharded(grown, shards=16, slots=256, map_path=path)
    with pytest.raises(Exception, match="(?i)exist"):
        store_map(spark, path, 3, first_map(256, 16))


def test_the_mix_returns_the_columns_it_was_given(spark):
    docs = docs_of(spark, [(1, X), (2, Y), (None, X), (3, None), (3, X)])
    mixed = mixed_rows(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert all(r._position.startswith("_position ") and r._epoch.startswith("_epoch ") and r.place.startswith("place ") for r in rows)
    assert {r.doc_id for r in rows} == {1, 2, None, 3}


def test_free_names_differ_from_all_columns(spark):
    assert free_names(spark.createDataFrame([], "A int, a_ int, b int"), "a", "c") == ["a__", "c"]


def test_trust_spreads_until_it_settles(spark):
    """A chain of 25 hosts: every one is reached, and the ranks are those of the exact solution."""
    n = 25
    edges = [("t", f"h{i:02}", f"h{i + 1:02}", 1.0) for i in range(n)] + [("t", f"h{n:02}", f"h{n:02}", 1.0)]
    frame = spark.createDataFrame(edges, "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("t", "h00", 1.0)], "kind string, host string, share double")
    got = {r.host: r.rank for r in spread(frame, seeds, tolerance=1e-3).collect()}
    assert len(got) == n + 1 and sum(got.values()) == pytest.approx(1.0, abs=5e-3)
    for i in range(n):
        assert got[f"h{i:02}"] == pytest.approx(0.15 * 0.85**i, abs=1e-8)
