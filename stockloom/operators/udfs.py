"""Hooks for user functions. Built-in expressions and windows come first; these are for what they cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stockloom.session import written

#: Types whose pandas form is the same whether Spark or Arrow makes it.
_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.StringType, T.DateType)


def grouped_map_apply(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` over the frame of each group. A group is held by one task: cut large ones by a further key (a day, a month).

    Groups are read from batches of sorted rows, many to a batch, since a message per group costs far more than
    a usual ``fn``. Tables with other than plain types get Spark's own call per group.
    """
    out = T.StructType.fromDDL(schema)
    if not all(isinstance(f.dataType, _PLAIN) for f in [*df.schema.fields, *out.fields]) or "_head" in df.columns:
        return df.groupBy(*keys).applyInPandas(fn, schema)
    arrow, names = to_arrow_schema(out), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the last group, which the next batch may go on with
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            heads = rows["_head"].to_numpy().nonzero()[0]
            rows = rows.select(names)
            if len(heads) == 0:
                held.append(rows)
                continue
            if heads[0]:
                held.append(rows.slice(0, heads[0]))
            frames = _frames(pa.concat_tables(held), [0]) if held else []
            frames += _frames(rows.slice(heads[0], heads[-1] - heads[0]), heads[:-1] - heads[0])
            held = [rows.slice(heads[-1])]
            yield from _made(map(fn, frames), arrow)
        if held:
            yield from _made(map(fn, _frames(pa.concat_tables(held), [0])), arrow)

    by_group = df.withColumn("_head", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))) == 1)
    return by_group.mapInArrow(run, schema)


def _frames(rows: pa.Table, heads) -> list[pd.DataFrame]:
    """The pandas frame of each group. A null makes floats of whole numbers, so then each group is converted on its own."""
    cuts = [*map(int, heads), rows.num_rows]
    spans = list(zip(cuts, cuts[1:]))
    mixed = any(rows[f.name].null_count for f in rows.schema if pa.types.is_integer(f.type) or pa.types.is_boolean(f.type))
    if mixed:
        return [rows.slice(a, b - a).to_pandas(date_as_object=True) for a, b in spans]
    whole = rows.to_pandas(date_as_object=True)
    return [whole.iloc[a:b].reset_index(drop=True) for a, b in spans]


def _made(frames, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Frames as one table of the schema; columns go by name, or by place where they are not named."""
    frames = [f for f in frames if len(f)]
    if not frames:
        return
    if not all(isinstance(c, str) for f in frames for c in f.columns):
        frames = [f.set_axis(schema.names, axis=1) for f in frames]
    parts = {n: [f[n] for f in frames] for n in schema.names}
    if any(any(s.dtype != series[0].dtype for s in series) for series in parts.values()):
        tables = [pa.Table.from_pandas(f[schema.names], schema=schema, preserve_index=False) for f in frames]
    else:
        joined = pd.DataFrame({n: pd.concat(series, ignore_index=True) for n, series in parts.items()})
        tables = [pa.Table.from_pandas(joined, schema=schema, preserve_index=False)]
    yield from pa.concat_tables(tables).combine_chunks().to_batches()


def scalar_apply(col: Column | str, fn: Callable[[pd.Series], pd.Series], return_type: str) -> Column:
    """A vectorised function of one column."""

    def call(s: pd.Series) -> pd.Series:
        return fn(s)

    return F.pandas_udf(call, return_type)(col)


def custom_aggregate(
    df: DataFrame,
    keys: list[str],
    col: str,
    partial: Callable[[pd.Series], bytes],
    merge: Callable[[bytes, bytes], bytes],
    finish: Callable[[bytes], float],
    out: str,
) -> DataFrame:
    """One number per group from a state that can be merged.

    ``partial`` makes a state from some of the values, ``merge`` joins two states, ``finish`` reads the
    result. Rows are ranged by key and value, so a small group lies in one task and a large one in several;
    a task reads sorted batches and keeps one state at a time, so none holds the values of a group. A group has
    one state for each task that met it, and these meet in one row.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch[col].to_pandas(date_as_object=True)
            if isinstance(values.dtype, pd.DatetimeTZDtype):
                values = values.dt.tz_convert(zone).dt.tz_localize(None)
            rows = batch.select(keys)
            heads = sorted({0, *(int(e) for c in rows.columns for e in pc.run_end_encode(c).run_ends.to_numpy() if e < len(rows))})
            states = [partial(values.iloc[a:b]) for a, b in zip(heads, [*heads[1:], len(rows)])]
            if held is not None and _row(rows, 0) == _row(last, 0):
                states[0] = merge(held, states[0])
            elif held is not None:
                yield _with(last, "_state", [held], pa.binary())
            yield _with(rows.take(pa.array(heads[:-1], pa.int64())), "_state", states[:-1], pa.binary())
            last, held = rows.slice(heads[-1], 1), states[-1]
        if held is not None:
            yield _with(last, "_state", [held], pa.binary())

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [float(finish(reduce(merge, states))) for states in batch["_states"].to_pylist()]
            yield _with(batch.select(keys), out, results, pa.float64())

    rows = written(df.select(*keys, col))
    sorted_ = rows.repartitionByRange(*keys, col).sortWithinPartitions(*keys)
    states = sorted_.mapInArrow(begin, f"{kinds}, _state binary").groupBy(*keys).agg(F.collect_list("_state").alias("_states"))
    return states.mapInArrow(end, f"{kinds}, `{out}` double")


def _row(rows: pa.RecordBatch, i: int) -> tuple:
    return tuple(c[i].as_py() for c in rows.columns)


def _with(rows: pa.RecordBatch, name: str, values: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(values, kind)], names=[*rows.schema.names, name])
