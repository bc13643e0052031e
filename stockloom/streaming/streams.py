"""Streaming forms of the order path: daily demand, running stock, ledger without repeats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.operators.windows import running_stock_ledger
from stockloom.session import shared_folder


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_daily_demand(stream: DataFrame, ts: str, product: str, qty: str, delay: str = "1 hour") -> DataFrame:
    """Units per product and day of event time; a day is published once the watermark has passed its end."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    daily = timed.groupBy(F.window(ts, "1 day"), product).agg(F.sum(qty).alias("qty"), F.count(F.lit(1)).alias("n"))
    return daily.select(F.to_date("window.start").alias("date"), product, "qty", "n")


def stream_ledger_dedup(stream: DataFrame, ts: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Each (keys) row once while the watermark still covers it."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def run_to_parquet(df: DataFrame, path: str | None = None) -> str:
    """Run a stream over what is available now into the exactly-once file sink; return its folder."""
    base = path or f"{shared_folder(df.sparkSession).rstrip('/')}/streams/{uuid.uuid4().hex}"
    q = (
        df.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return f"{base}/out"


FOLD = 16  # batches whose sums are kept apart before a table of all balances is written


def _less_sold(inventory: DataFrame, sold: DataFrame | None, product: str, stock: str) -> DataFrame:
    if sold is None:
        return inventory
    total = sold.groupBy(product).agg(F.sum("_sold").alias("_sold"))
    return inventory.join(total, product, "left").withColumn(stock, F.col(stock) - F.coalesce("_sold", F.lit(0))).select(*inventory.columns)


def stream_stock_ledger(
    stream: DataFrame, inventory: DataFrame, product: str, day: str, order: list[str], qty: str, stock: str, path: str | None = None
) -> str:
    """Running stock over a stream of order lines: a ledger row per line, from the balances its predecessors left.

    A batch writes its ledger rows and the sums of the items it touched, nothing for other items. Every ``FOLD``
    batches the sums are folded into a table of all balances, so a batch reads that table and at most ``FOLD`` small
    ones, and the work of a long stream does not grow with its age. Inside a batch the running total is cut by day, so a
    hot item is spread over tasks, which state kept per key could not do. A late line is booked in the batch that brings
    it. All tables are overwritten per batch number from tables that no longer change, so a batch that is run again,
    after a restart too, gives the same files.
    """
    spark = stream.sparkSession
    base = path or f"{shared_folder(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    kind = spark.createDataFrame([], stream.schema).agg(F.sum(qty).alias("_sold")).schema["_sold"].dataType
    initial = inventory.select(product, (F.col(stock) - F.lit(0).cast(kind)).alias(stock))

    def step(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        own = batch.groupBy(product).agg(F.sum(qty).alias("_sold"))

        def before(start: int, end: int) -> DataFrame:
            """Balances after batch ``end - 1``, from those before batch ``start``."""
            full = initial if start == 0 else session.read.schema(initial.schema).parquet(f"{base}/balances/before={start}")
            parts = [f"{base}/sold/epoch={e}" for e in range(start, end)]
            out = _less_sold(full, session.read.schema(own.schema).parquet(*parts) if parts else None, product, stock)
            return out.withColumn(stock, F.col(stock).cast(initial.schema[stock].dataType))

        start = epoch // FOLD * FOLD
        if epoch == start and start > 0:
            before(start - FOLD, start).write.mode("overwrite").parquet(f"{base}/balances/before={start}")
        ledger = running_stock_ledger(batch, before(start, epoch), product, day, order, qty, stock)
        ledger = ledger.withColumn("alert", F.when(F.col("stock_after") <= 0, "CRIT"))
        ledger.write.mode("overwrite").parquet(f"{base}/ledger/epoch={epoch}")
        own.write.mode("overwrite").parquet(f"{base}/sold/epoch={epoch}")  # last: the batch is complete

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{base}/ledger"


def stream_balances(inventory: DataFrame, base: str, product: str, stock: str) -> DataFrame:
    """Stock of every item after all complete batches of a ledger stream whose folder is ``base``."""
    sold = inventory.sparkSession.read.parquet(f"{base}/sold").select(product, "_sold")
    return _less_sold(inventory.select(product, stock), sold, product, stock)
