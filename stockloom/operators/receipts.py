"""A stock table in versions, and receipts that are booked once however often they are sent.

Under one folder in shared storage, ``receipts/v=N`` holds the lines that version N booked and ``stock/v=N`` the stock
after it. The stock is written last: a version counts once its stock is complete, and receipts of an unfinished version
are not read and are overwritten by the next attempt. Versions are never changed, so a reader keeps a consistent table.
One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOVEMENT = "Entrada compra"
RECEIVED = "Recibida"


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The greatest version whose stock is complete."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/stock")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    folders = [f.getPath() for f in fs.listStatus(where)]
    done = [f.getName() for f in folders if fs.exists(f.suffix("/_SUCCESS"))]
    return max((int(n.removeprefix("v=")) for n in done if n.startswith("v=")), default=None)


def open_stock(inventory: DataFrame, path: str) -> int:
    """Version 0 from the inventory (product_id, stock), unless the folder has a version. Returns the newest one.

    Rows that repeat an item are added up, a null stock counts 0, rows without an item are left out.
    """
    found = newest_version(inventory.sparkSession, path)
    if found is not None:
        return found
    zero = F.lit(0).cast("long")
    first = inventory.where(F.col("product_id").isNotNull()).groupBy("product_id").agg(F.coalesce(F.sum("stock"), zero).cast("long").alias("stock"))
    first.write.mode("overwrite").parquet(f"{path}/stock/v=0")
    return 0


def stock_at(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stock of a version, the newest by default."""
    v = newest_version(spark, path) if version is None else version
    if v is None:
        raise ValueError(f"no stock in {path}")
    return spark.read.parquet(f"{path}/stock/v={v}")


def receipts_at(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """All lines booked up to a version, with the version that booked them; None before the first receipt."""
    v = newest_version(spark, path) if version is None else version
    if not v:
        return None
    parts = [f"{path}/receipts/v={n}" for n in range(1, v + 1)]
    return spark.read.option("basePath", f"{path}/receipts").parquet(*parts).withColumnRenamed("v", "version")


def receive_lines(lines: DataFrame, path: str, day: str, orders: DataFrame | None = None, line: str = "product_id") -> int:
    """Books the lines (order_id, ``line``, product_id, qty) that are not booked yet; returns the newest version.

    ``orders`` (order_id) names the orders that arrived, all of ``lines`` by default. A line is known by (order_id,
    ``line``): one that was booked before, in any version, changes nothing, and of rows that repeat it the greatest
    quantity counts. Lines without quantity above 0 or without a key are left out. If nothing is new, no version is made.
    """
    spark = lines.sparkSession
    version = newest_version(spark, path)
    if version is None:
        raise ValueError(f"no stock in {path}")
    keys = list(dict.fromkeys(["order_id", line]))
    good = lines.where(F.col("qty") > 0).na.drop(subset=list(dict.fromkeys([*keys, "product_id"])))
    if orders is not None:
        good = good.join(orders.select("order_id"), "order_id", "left_semi")
    top = F.max(F.struct(F.col("qty").cast("long").alias("qty"), F.col("product_id").alias("p")))
    new = good.groupBy(*keys).agg(top.alias("_t"), F.lit(day).cast("date").alias("date"))
    known = receipts_at(spark, path, version)
    if known is not None:
        new = new.join(known.select(*keys), keys, "left_anti")
    item = [] if line == "product_id" else [F.col("_t.p").alias("product_id")]
    booked = f"{path}/receipts/v={version + 1}"
    new.select(*keys, *item, F.col("_t.qty").alias("qty"), "date").write.mode("overwrite").parquet(booked)
    written_lines = spark.read.parquet(booked)
    if written_lines.isEmpty():
        return version
    got = written_lines.groupBy("product_id").agg(F.sum("qty").alias("_got"))
    zero = F.lit(0).cast("long")
    stock = stock_at(spark, path, version).join(got, "product_id", "full")
    stock.select("product_id", (F.coalesce("stock", zero) + F.coalesce("_got", zero)).alias("stock")).write.mode("overwrite").parquet(f"{path}/stock/v={version + 1}")
    return version + 1


def receipt_ledger(receipts: DataFrame) -> DataFrame:
    """Ledger rows of booked lines."""
    return receipts.select("date", "order_id", "product_id", F.lit(MOVEMENT).alias("movement"), "qty")


def order_status(headers: DataFrame, lines: DataFrame, receipts: DataFrame | None, line: str = "product_id") -> DataFrame:
    """Headers with ``n_open`` lines and a status: received once all its lines are booked, else the one it had.

    Lines without quantity need no receipt; an order without any other line keeps its status.
    """
    keys = list(dict.fromkeys(["order_id", line]))
    due = lines.where(F.col("qty") > 0).select(*keys).distinct()
    booked = due.withColumn("_b", F.lit(0)) if receipts is None else due.join(receipts.select(*keys, F.lit(1).alias("_b")), keys, "left")
    left = booked.groupBy("order_id").agg(F.sum(1 - F.coalesce("_b", F.lit(0))).alias("n_open"))
    j = headers.join(left, "order_id", "left")
    return j.withColumn("status", F.when(F.col("n_open") == 0, RECEIVED).otherwise(F.col("status"))).withColumn("n_open", F.coalesce("n_open", F.lit(0).cast("long")))
