"""Streams over files that arrive in several batches."""

from datetime import datetime

from pyspark.sql import functions as F

from stockloom.operators.windows import running_stock_ledger
from stockloom.streaming import streams as R

SCHEMA = "ts timestamp, product_id bigint, qty bigint, seq int"


def write(spark, folder, n, data):
    spark.createDataFrame([(datetime.fromisoformat(a), *rest) for a, *rest in data], SCHEMA).coalesce(1).write.parquet(f"{folder}/b{n}")


def source(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*")


def test_late_rows_are_left_out(spark, tmp_path):
    write(spark, tmp_path, 1, [("2024-01-01 10:00:00", 1, 5, 1), ("2024-01-03 12:00:00", 1, 1, 2)])
    out = str(tmp_path / "o")
    first = source(spark, tmp_path)
    R.run_to_parquet(R.stream_daily_demand(first, "ts", "product_id", "qty"), out)
    write(spark, tmp_path, 2, [("2024-01-01 11:00:00", 1, 100, 3), ("2024-01-06 12:00:00", 1, 2, 4)])
    R.run_to_parquet(R.stream_daily_demand(source(spark, tmp_path), "ts", "product_id", "qty"), out)
    got = {str(r["date"]): r["qty"] for r in spark.read.parquet(f"{out}/out").collect()}
    assert got == {"2024-01-01": 5, "2024-01-03": 1}


def test_ledger_over_batches_equals_the_batch_ledger(spark, tmp_path):
    a = [("2024-01-01 10:00:00", 1, 4, 1), ("2024-01-01 11:00:00", 1, 6, 2), ("2024-01-01 12:00:00", 2, 1, 3)]
    b = [("2024-01-02 10:00:00", 1, 3, 4), ("2024-01-02 11:00:00", 9, 3, 5)]
    write(spark, tmp_path, 1, a)
    inv = spark.createDataFrame([(1, 10), (2, 5)], "product_id bigint, stock bigint")
    for n, extra in ((1, None), (2, b)):
        if extra:
            write(spark, tmp_path, 2, extra)
        s = source(spark, tmp_path).withColumn("day", F.to_date("ts"))
        path = R.stream_stock_ledger(s, inv, "product_id", "day", ["ts", "seq"], "qty", "stock", str(tmp_path / "led"))
    got = sorted((r["seq"], r["stock_after"], r["alert"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, 6, None), (2, 0, "CRIT"), (3, 4, None), (4, -3, "CRIT")]
    lines = spark.read.parquet(f"{tmp_path}/b*").withColumn("day", F.to_date("ts"))
    batch = running_stock_ledger(lines, inv, "product_id", "day", ["ts", "seq"], "qty", "stock")
    assert sorted((r["seq"], r["stock_after"]) for r in batch.collect()) == [(a, b) for a, b, _ in got]


def test_ledger_folds_balances_and_goes_on_after_restarts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "FOLD", 2)
    inv = spark.createDataFrame([(1, 100), (2, 50), (3, 7)], "product_id bigint, stock bigint")
    base, seq, total = str(tmp_path / "led"), 0, {1: 100, 2: 50, 3: 7}
    want = {}
    for run in range(3):
        for n in (2 * run, 2 * run + 1):
            day = f"2024-01-{20 - n:02d}"  # each batch is later than its rows: all lines after the first are late
            rows = [(f"{day} 10:00:00", 1, n + 1, seq + 1), (f"{day} 11:00:00", 1, 2, seq + 2), (f"{day} 09:00:00", 2, n, seq + 3), (f"{day} 08:00:00", 8, 1, seq + 4)]
            write(spark, tmp_path, n, rows)
            for _, item, qty, s in rows[:3]:
                total[item] -= qty
                want[s] = total[item]
            seq += 4
        stream = source(spark, tmp_path).withColumn("day", F.to_date("ts"))
        path = R.stream_stock_ledger(stream, inv, "product_id", "day", ["ts", "seq"], "qty", "stock", base)
    ledger = spark.read.parquet(path).collect()
    assert {r["seq"]: r["stock_after"] for r in ledger} == want and len(ledger) == len(want)
    assert {r["product_id"]: r["stock"] for r in R.stream_balances(inv, base, "product_id", "stock").collect()} == total
    # Only items that a batch met are written, and the folded tables hold the balances before their batch.
    assert {r["product_id"] for r in spark.read.parquet(f"{base}/sold/epoch=5").collect()} == {1, 2, 8}
    folded = {r["product_id"]: r["stock"] for r in spark.read.parquet(f"{base}/balances/before=4").collect()}
    assert folded == {1: 100 - sum(n + 3 for n in range(4)), 2: 50 - 6, 3: 7}


def test_repeated_rows_are_written_once(spark, tmp_path):
    write(spark, tmp_path, 1, [("2024-01-01 10:00:00", 1, 4, 1), ("2024-01-01 10:05:00", 1, 4, 2), ("2024-01-01 10:05:00", 1, 5, 3)])
    out = R.run_to_parquet(R.stream_ledger_dedup(source(spark, tmp_path), "ts", ["product_id", "qty"]), str(tmp_path / "o"))
    assert spark.read.parquet(out).count() == 2
