"""Suffix-array dedup: removes every byte covered by a string that also starts earlier in the corpus.

A string of ``LENGTH`` bytes is anchored at the place inside it whose 32 bytes hash lowest: equal strings
have equal anchors at equal offsets. The strings that share one anchor occurrence lie side by side and
form a *segment*. All equal strings are in segments of equal anchors, so anchors deal the work to shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.arrays import FOLD, flat, mixed, pieces, prefix, spans
from stockloom.llm.cutting import cut, keyed, row_key
from stockloom.llm.keyfilter import found, key_filter, repeated_filter
from stockloom.llm.suffixes import common_prefixes, suffix_array
from stockloom.session import written

LENGTH = 100
ANCHOR = 32
SHARD_BYTES = 2 << 20
HOT_SEGMENTS = 4096


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """``(first, last, place, hash)`` per segment: first and last start of its strings, its anchor and that one's hash."""
    none = np.zeros(0, np.int64)
    n = len(data) - anchor + 1
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(n)
    hashes = spans(prefix(data), at, at + anchor)
    low = (hashes & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)  # of equal hashes the leftmost
    width, reach = 1, length - anchor + 1
    while 2 * width <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(data) - length + 1], low[reach - width :][: len(data) - length + 1])
    end = np.repeat(offsets[1:], np.diff(offsets))
    start = np.flatnonzero(np.arange(len(low)) + length <= end[: len(low)])
    place = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(new)
    if not len(heads):
        return none, none, none, none.astype(np.uint64)
    last = start[np.append(heads[1:], len(start)) - 1]
    return start[heads], last, place[heads], hashes[place[heads]]


def _again(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which keys stood earlier in the same text; rows are in text order."""
    order = np.lexsort((np.arange(len(keys)), keys, owner))
    out = np.zeros(len(keys), bool)
    out[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return out


def _candidates(docs: DataFrame, length: int) -> DataFrame:
    """The segments whose anchor occurs twice or more: ``ord, text_key, first, last, h, g, again``.

    ``g`` is a digest of the segment's bytes and of the anchor's place in it. Anchors are counted first,
    and only counts are shuffled; a bit array of fixed size then keeps single anchors out of the shuffle.
    """

    def counted(batches):
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(segments(*flat(piece.column("text")), length)[3].view(np.int64))], names=["h"])

    source = keyed(docs)
    repeated = repeated_filter(source.select("text").mapInArrow(counted, "h long"), "h")

    def passed(batches):
        for piece in pieces(batches):
            data, off = flat(piece.column("text"))
            first, last, place, h = segments(data, off, length)
            keep = found(repeated, h.view(np.int64))
            first, last, place, h = first[keep], last[keep], place[keep], h[keep]
            owner = np.searchsorted(off, first, "right") - 1
            g = mixed(spans(prefix(data), first, last + length) * FOLD + (place - first).astype(np.uint64))
            who = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("ord").take(who), piece.column("text_key").take(who), pa.array((first - off[owner]).astype(np.int32)),
                    pa.array((last - off[owner]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(_again(h ^ g * FOLD, owner)),
                ],
                names=["ord", "text_key", "first", "last", "h", "g", "again"],
            )

    return source.mapInArrow(passed, "ord long, text_key long, first int, last int, h long, g long, again boolean")


def _fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the segments in ``wanted(ord, text_key, first, last, h, hot)``.

    Rows ``h, ord, first, bytes`` for the shards; of a hot anchor instead one row ``w1, w2, ord, first`` per
    string, which are two independent hashes of it.
    """
    per_text = wanted.groupBy("ord", "text_key").agg(F.collect_list(F.struct("first", "last", "h", "hot")).alias("segments"))
    some = key_filter(wanted.select(row_key().alias("key")).distinct(), "key")

    def chosen(batches):
        for batch in batches:
            yield batch.filter(pa.array(found(some, batch.column("key").to_numpy())))

    def taken(batches):
        for batch in batches:
            for piece in pieces([batch]):
                out: dict[str, list] = {c: [] for c in ("ord", "text_key", "first", "h", "bytes", "w1", "w2")}

                def put(n, **values):
                    for c in out:
                        out[c].extend(values.get(c, [None] * n))

                for ord_, text_key, text, own in zip(*(piece.column(c) for c in ("ord", "text_key", "text", "segments"))):
                    raw = text.as_buffer().to_pybytes()
                    data, hot = np.frombuffer(raw, np.uint8), own.values.field("hot").to_numpy(zero_copy_only=False)
                    first, last, h = (own.values.field(c).to_numpy() for c in ("first", "last", "h"))
                    cold = np.flatnonzero(~hot)
                    put(len(cold), ord=[ord_.as_py()] * len(cold), text_key=[text_key.as_py()] * len(cold), first=first[cold].tolist(), h=h[cold].tolist(), bytes=[raw[first[i] : last[i] + length] for i in cold])
                    if hot.any():
                        at = np.concatenate([np.arange(first[i], last[i] + 1) for i in np.flatnonzero(hot)]).astype(np.int64)
                        w1 = spans(prefix(data), at, at + length)
                        w2 = spans(prefix(data ^ 0x5A), at, at + length)
                        put(len(at), ord=[ord_.as_py()] * len(at), text_key=[text_key.as_py()] * len(at), first=at.tolist(), w1=w1.view(np.int64).tolist(), w2=w2.view(np.int64).tolist())
                yield pa.RecordBatch.from_pydict(
                    {c: pa.array(v, pa.binary() if c == "bytes" else pa.int32() if c == "first" else pa.int64()) for c, v in out.items()}
                )

    texts = keyed(docs).withColumn("key", row_key()).mapInArrow(chosen, "ord long, text_key long, text string, key long").drop("key")
    return texts.join(per_text, ["ord", "text_key"]).mapInArrow(taken, "ord long, text_key long, first int, h long, bytes binary, w1 long, w2 long")


def shard_repeats(table: pa.Table, length: int = LENGTH) -> pa.Table:
    """Strings of one shard's segments that also start earlier: ``ord, text_key, start, end`` byte ranges.

    One suffix array is induced over all segments. Neighbours whose permuted common prefix reaches
    ``length`` form groups; of the starts inside segments, the first of each group stays.
    """
    parts = [b.as_buffer() for b in table.column("bytes")]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    begins = np.concatenate(([0], ends[:-1]))
    order = suffix_array(data, length)
    equal = common_prefixes(data, order, length, exact=False)[order] >= length
    group = np.cumsum(~equal)
    part = np.searchsorted(ends, order, "right")
    inside = order + length <= ends[part]  # matches never leave a segment
    order, part, group = order[inside], part[inside], group[inside]
    ord_, first = table.column("ord").to_numpy(), table.column("first").to_numpy().astype(np.int64)
    start = first[part] + order - begins[part]
    who = ord_[part]
    by = np.lexsort((start, who, group))
    group, who, start, part = group[by], who[by], start[by], part[by]
    head = np.ones(len(group), bool)
    head[1:] = group[1:] != group[:-1]
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    late = (who != who[lead]) | (start != start[lead])
    part, start = part[late], start[late]
    by = np.lexsort((start, part))
    part, start = part[by], start[by]
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(new)
    last = start[np.append(heads[1:], len(start)) - 1] if len(start) else start
    return pa.table(
        {
            "ord": pa.array(who_of := ord_[part[heads]], pa.int64()),
            "text_key": pa.array(table.column("text_key").to_numpy()[part[heads]], pa.int64()),
            "start": pa.array(start[heads], pa.int64()),
            "end": pa.array(last + length if len(who_of) else last, pa.int64()),
        }
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot: int = HOT_SEGMENTS) -> DataFrame:
    """``ord, text_key, start, end`` of the byte ranges whose strings of ``length`` bytes all start earlier too.

    Equal segments are merged first (partial sums before the shuffle), so a passage in a third of the
    documents is one segment with one first place; its later copies are late as a whole. The different
    segments of one anchor go to one shard, whose suffix array finds the strings they share. An anchor
    with more than ``hot`` different segments would overfill a shard: its strings are grouped by two 64-bit
    hashes in Spark instead, with partial sums, which gives the same answer.
    """
    rows = written(_candidates(docs, length))
    classes = written(rows.groupBy("h", "g").agg(F.min("ord").alias("first_ord")))
    anchors = written(classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", (F.col("n") > hot).alias("hot")))
    placed = rows.join(classes, ["h", "g"])
    late = F.expr("ord > first_ord or again")
    copies = placed.where(late).select("ord", "text_key", F.col("first").cast("long").alias("start"), (F.col("last") + length).cast("long").alias("end"))
    wanted = written(placed.where(~late).join(anchors, "h").select("ord", "text_key", "first", "last", "h", "hot"))
    parts = written(_fetched(docs, wanted, length))
    total = parts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    sharded = parts.where("bytes is not null").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    schema = "ord long, text_key long, start long, end long"
    in_shards = sharded.groupBy("shard").applyInArrow(lambda t: shard_repeats(t, length), schema)
    strings = parts.where("w1 is not null").select("ord", "text_key", "w1", "w2", F.col("first").cast("long").alias("start"))
    firsts = strings.groupBy("w1", "w2").agg(F.min("ord").alias("ord0"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = strings.join(written(firsts), ["w1", "w2"])
    start0 = near.where("ord = ord0").groupBy("w1", "w2").agg(F.min("start").alias("start0"))
    in_hot = near.join(written(start0), ["w1", "w2"]).where("ord > ord0 or start > start0").select("ord", "text_key", "start", (F.col("start") + length).alias("end"))
    return copies.unionByName(in_shards).unionByName(in_hot)


def without_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` per document.

    Removed is each byte covered by a string of ``length`` bytes that also starts earlier: in a smaller
    ``doc_id``, or before in the same document. Strings are judged on the input, overlaps count, and
    matches never cross documents. ``kept`` has the remaining bytes, null where nothing was removed.

    Nulls: a null text is an empty one; rows without id come last and are compared by place only, as one
    document. Rows that repeat an id are one document too: a string is a copy of one that starts before
    it. Ids must be whole numbers. An empty table gives no rows; further columns are ignored.
    """
    return cut(docs, written(repeated_spans(docs, length, **how)))
