"""Sharding over fixed virtual slots with a stored, versioned slot-to-shard map."""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from stockloom.operators.prefix import row_positions
from stockloom.session import shared_folder, written

SLOTS = 4096
SHARDS = 16
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def measured(docs: DataFrame, slots: int = SLOTS, *more: Column) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` and ``more`` per record; the slot hashes the id, or the text of a row without one."""
    text = F.coalesce("text", F.lit(""))
    checksum = F.crc32(F.encode(text, "UTF-8"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), checksum))
    return docs.select(
        F.col("doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        checksum.alias("text_crc32"),
        F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("virtual_slot"),
        *more,
    )


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> dict[int, int]:
    return {s: s % shards for s in range(slots)}


def rebalanced(now: dict[int, int], loads: dict[int, int], shards: int = SHARDS) -> dict[int, int]:
    """An edited map whose shards carry nearly equal bytes; slots stay where they can.

    Shards above the mean give up slots, largest first where they fit the excess; the slots given up go
    to the lightest shard, largest first; at last single slots move, or two change places, between the
    heaviest and the lightest shard while that lowers the gap. The input is one number per slot.
    """
    out = dict(now)
    total = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in out.items():
        total[shard] += loads.get(slot, 0)
        held[shard].append(slot)
    mean = sum(total) / shards
    loose: list[int] = []
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (-loads.get(s, 0), s)):
            load = loads.get(slot, 0)
            if load and total[shard] - load >= mean:
                total[shard] -= load
                held[shard].remove(slot)
                loose.append(slot)
        # the last one over the mean goes too, so that the shard can be filled up again exactly
        small = [s for s in held[shard] if 0 < loads.get(s, 0)]
        if total[shard] > mean and small:
            slot = min(small, key=lambda s: (loads[s], s))
            total[shard] -= loads[slot]
            held[shard].remove(slot)
            loose.append(slot)
    queue = [(total[s], s) for s in range(shards)]
    heapq.heapify(queue)
    for slot in sorted(loose, key=lambda s: (-loads[s], s)):
        load, shard = heapq.heappop(queue)
        held[shard].append(slot)
        total[shard] = load + loads[slot]
        heapq.heappush(queue, (total[shard], shard))
    for _ in range(4 * shards):
        hi, lo = max(range(shards), key=lambda s: (total[s], s)), min(range(shards), key=lambda s: (total[s], -s))
        gap = total[hi] - total[lo]
        ups = [(loads.get(s, 0), s) for s in held[hi]]
        downs = [(loads.get(s, 0), s) for s in held[lo]] + [(0, -1)]
        best = min(((abs(gap - 2 * (a - b)), x, y) for a, x in ups for b, y in downs if 0 < a - b < gap), default=None)
        if best is None:
            break
        _, x, y = best
        held[hi].remove(x)
        held[lo].append(x)
        if y >= 0:
            held[lo].remove(y)
            held[hi].append(y)
        step = loads.get(x, 0) - (loads.get(y, 0) if y >= 0 else 0)
        total[hi] -= step
        total[lo] += step
    return {slot: shard for shard in range(shards) for slot in held[shard]}


def store_map(spark: SparkSession, path: str, version: int, slot_map: dict[int, int]) -> DataFrame:
    """Adds a version to the map table at ``path`` and returns the whole table. A version is never written over."""
    rows = [(version, slot, slot_map[slot]) for slot in sorted(slot_map)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("error").parquet(f"{path}/version={version:06d}")
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version=*")


def stored_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version:06d}")


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The last version of the map table at ``path``; none if there is no table yet."""
    try:
        table = spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version=*")
    except AnalysisException:
        return None
    return table.agg(F.max("version")).first()[0]


def current_map(spark: SparkSession, path: str, loads: dict[int, int], slots: int, shards: int) -> int:
    """The version of the map at ``path`` that fits ``loads``: the newest one, or that one edited and stored as the next.

    Where there is no map, version 0 deals the slots round and version 1 is edited for the loads. An edit that leaves
    the heaviest and the lightest shard as far apart as before is none. Shards may be added, not taken away.
    """
    version = newest_version(spark, path)
    if version is None:
        version = 0
        store_map(spark, path, version, first_map(slots, shards))
    now = {r.virtual_slot: r.shard for r in stored_map(spark, path, version).collect()}  # one row per virtual slot
    if set(now) != set(range(slots)) or max(now.values()) >= shards:
        raise ValueError(f"the map at {path} has other slots or more shards")
    edited = rebalanced(now, loads, shards)

    def gap(slot_map: dict[int, int]) -> int:
        total = [0] * shards
        for slot, shard in slot_map.items():
            total[shard] += loads.get(slot, 0)
        return max(total) - min(total)

    if gap(edited) < gap(now):
        version += 1
        store_map(spark, path, version, edited)
    return version


def slot_loads(records: DataFrame) -> dict[int, int]:
    """Bytes per virtual slot: one row per slot reaches the driver, however many records there are."""
    return {r.virtual_slot: r.load for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("load")).collect()}


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None, order: Column | None = None) -> DataFrame:
    """Law ``bytes``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version``.

    Records are hashed by id into ``slots`` virtual slots. The bytes per slot are summed, and the newest map
    at ``map_path`` is edited until the shards carry nearly equal bytes; an edited map is stored there as the next
    version (:func:`current_map`). Without ``map_path`` a map is begun in a new folder of the shared folder. ``slot`` is
    the record's place in its shard, from 0 without gaps: its rank inside the virtual slot plus the
    records of the shard's virtual slots before it, so no task orders more than one virtual slot. More
    virtual slots (a parameter) make smaller tasks and finer balance. One record is never split, so a
    shard can be uneven by one record at most as large as the heaviest slot. With ``order`` (no ties) a
    shard's records stand in that order instead, ranked over its whole length in cuts of any size.

    Nulls: a null text has size 1 and the checksum of the empty text; records without id are hashed by their text.
    Repeated rows each take a place. An empty table gives no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    path = map_path or f"{shared_folder(spark).rstrip('/')}/slot_maps/{uuid.uuid4().hex}"
    records = written(measured(docs, slots, *([] if order is None else [order.alias("_order")])))
    version = current_map(spark, path, slot_loads(records), slots, shards)
    current = F.broadcast(stored_map(spark, path, version))  # one row per virtual slot
    if order is not None:
        dealt = records.join(current, "virtual_slot")
        placed = row_positions(dealt, ["shard"], [F.col("_order").asc()], "_at")
        return _result(placed, F.col("_at") - 1)
    counts = records.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n")).join(current, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("virtual_slot", "shard", "version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    placed = records.withColumn("rank", F.row_number().over(inside) - 1)
    return _result(placed.join(F.broadcast(offsets), "virtual_slot"), F.col("before") + F.col("rank"))


def _result(placed: DataFrame, slot: Column) -> DataFrame:
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )
