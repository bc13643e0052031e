"""Explicit schemas of the files this library reads as text."""

from pyspark.sql import types as T

DEMAND = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("qty", T.StringType()),
    ]
)
ORDERS = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("qty", T.LongType()),
    ]
)
PRICE_WINDOWS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("start", T.DateType()),
        T.StructField("end", T.DateType()),
        T.StructField("discount", T.DoubleType()),
        T.StructField("scope_type", T.StringType()),
        T.StructField("scope_values", T.StringType()),
        T.StructField("year", T.DoubleType()),
    ]
)
FACTOR_WINDOWS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("start", T.DateType()),
        T.StructField("end", T.DateType()),
        T.StructField("factor_type", T.StringType()),
        T.StructField("lift", T.DoubleType()),
        T.StructField("scope_type", T.StringType()),
        T.StructField("scope_values", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)
SUPPLIER_OFFERS = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("supplier_id", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("availability", T.DoubleType()),
        T.StructField("lead_time", T.IntegerType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("lead_time_bucket", T.StringType()),
    ]
)
LEDGER = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("supplier", T.StringType()),
        T.StructField("movement", T.StringType()),
        T.StructField("qty", T.DoubleType()),
    ]
)
