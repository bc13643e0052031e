"""Receipts over several versions: repeats, broken attempts, odd rows."""

import datetime as dt

import pytest

from stockloom.operators.receipts import newest_version, open_stock, order_status, receipt_ledger, receipts_at, receive_lines, stock_at

LINES = "order_id string, line_no int, product_id long, qty long"
DAY = "2024-03-01"


def stock(spark, path, version=None):
    return {r.product_id: r.stock for r in stock_at(spark, path, version).collect()}


@pytest.fixture
def shop(spark, tmp_path):
    path = str(tmp_path / "shop")
    inventory = spark.createDataFrame([(1, 10), (2, None), (2, 3), (None, 9)], "product_id long, stock long")
    assert open_stock(inventory, path) == 0 and open_stock(inventory, path) == 0
    return path


def test_lines_are_booked_once_over_versions(spark, shop):
    lines = spark.createDataFrame([("A", 1, 1, 5), ("A", 2, 1, 5), ("A", 3, 7, 4), ("B", 1, 2, 2), ("B", 2, 2, 0)], LINES)
    only_a = spark.createDataFrame([("A",), ("A",), ("none",)], "order_id string")
    assert stock(spark, shop) == {1: 10, 2: 3}
    assert receive_lines(lines, shop, DAY, only_a, line="line_no") == 1
    assert stock(spark, shop) == {1: 20, 2: 3, 7: 4}
    assert receive_lines(lines, shop, "2024-03-02", only_a, line="line_no") == 1  # sent again: no version
    assert receive_lines(lines, shop, "2024-03-03", line="line_no") == 2  # B is new
    assert receive_lines(lines, shop, "2024-03-04", line="line_no") == 2
    assert stock(spark, shop) == {1: 20, 2: 5, 7: 4}
    assert stock(spark, shop, 1) == {1: 20, 2: 3, 7: 4} and stock(spark, shop, 0) == {1: 10, 2: 3}
    ledger = receipt_ledger(receipts_at(spark, shop)).collect()
    assert sorted((r.date, r.order_id, r.product_id, r.qty) for r in ledger) == [
        (dt.date(2024, 3, 1), "A", 1, 5), (dt.date(2024, 3, 1), "A", 1, 5), (dt.date(2024, 3, 1), "A", 7, 4), (dt.date(2024, 3, 3), "B", 2, 2),
    ]
    assert receipts_at(spark, shop, 0) is None and receipts_at(spark, shop, 1).count() == 3


def test_an_attempt_that_broke_before_the_stock_was_complete_is_not_read(spark, shop):
    lines = spark.createDataFrame([("A", 1, 1, 5)], LINES)
    lost = spark.createDataFrame([("X", 1, 1, 99, dt.date(2024, 1, 1))], LINES + ", date date")
    lost.write.parquet(f"{shop}/receipts/v=1")
    lost.select("product_id", "qty").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{shop}/stock/v=1")
    assert newest_version(spark, shop) == 0 and stock(spark, shop) == {1: 10, 2: 3}
    assert receive_lines(lines, shop, DAY, line="line_no") == 1
    assert stock(spark, shop) == {1: 15, 2: 3}
    assert {r.order_id for r in receipts_at(spark, shop).collect()} == {"A"}


def test_odd_lines(spark, shop):
    odd = [("A", 1, 1, 5), ("A", 1, 1, 8), ("A", 1, 1, 8), (None, 1, 1, 9), ("A", None, 1, 9), ("A", 2, None, 9), ("A", 3, 1, None), ("A", 4, 1, -2)]
    # Of rows that repeat a line the greatest quantity counts; lines without key, item or quantity are left out.
    assert receive_lines(spark.createDataFrame(odd, LINES), shop, DAY, line="line_no") == 1
    assert stock(spark, shop) == {1: 18, 2: 3}
    assert receive_lines(spark.createDataFrame([], LINES), shop, DAY, line="line_no") == 1
    with pytest.raises(ValueError):
        receive_lines(spark.createDataFrame([], LINES), shop + "none", DAY)


def test_status_follows_the_lines_of_an_order(spark, shop):
    lines = spark.createDataFrame([("A", 1, 1, 5), ("A", 2, 2, 5), ("B", 1, 2, 2), ("C", 1, 1, 0)], LINES)
    headers = spark.createDataFrame([("A", "Pendiente"), ("B", "Pendiente"), ("C", "Pendiente")], "order_id string, status string")

    def status():
        rows = order_status(headers, lines, receipts_at(spark, shop), line="line_no").collect()
        return {r.order_id: (r.n_open, r.status) for r in rows}

    assert status() == {"A": (2, "Pendiente"), "B": (1, "Pendiente"), "C": (0, "Pendiente")}
    receive_lines(lines.where("order_id = 'B' or line_no = 1"), shop, DAY, line="line_no")
    assert status() == {"A": (1, "Pendiente"), "B": (0, "Recibida"), "C": (0, "Pendiente")}
    receive_lines(lines, shop, DAY, line="line_no")
    assert status() == {"A": (0, "Recibida"), "B": (0, "Recibida"), "C": (0, "Pendiente")}
