"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.plans.bindings import Tables, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def to_digits(df: DataFrame, digits: int) -> DataFrame:
    """Half-up rounding of every double column, written so that both engines round alike."""
    scale = float(10**digits)
    cols = [
        (F.floor(F.col(f.name) * scale + 0.5) / scale).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def query(
    name: str,
    sql: str | None = None,
    ctes: str = "",
    doubles: str = "",
    digits: int = 4,
):
    """Register ``fn(tables) -> DataFrame``; ``doubles`` names the columns the SQL side must round."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return to_digits(fn(Tables(spark, sf_dir)), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            scale = f"1e{digits}"
            body = sql
            if doubles:
                repl = ", ".join(f"floor({c} * {scale} + 0.5) / {scale} AS {c}" for c in doubles.split())
                body = f"SELECT * REPLACE ({repl}) FROM ({sql}) AS q"
            ORACLES[name] = with_ctes(ctes.split(), body)
        return fn

    return register
