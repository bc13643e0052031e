"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.arrays import flat, mixed, pieces, prefix, spans
from stockloom.llm.cutting import cut, keyed
from stockloom.llm.keyfilter import found, repeated_filter
from stockloom.session import written

CUT_BITS = 4
LEAST_CHUNK, MOST_CHUNK = 12, 192
LEAST_SPAN = 80
WINDOW = 16

GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2h + GEAR[byte] in 16 bits after every byte: it depends on the last 16 bytes."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint16(step)
        h = wider
    return h


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all texts.

    A text may be cut behind a byte if the top ``CUT_BITS`` of the hash are 0, a character ends there and
    no other such place lies within ``LEAST_CHUNK`` bytes before it. That depends on the nearest bytes
    alone, so an insertion moves no cut further on. Stretches without a cut are cut every
    ``MOST_CHUNK`` bytes, counted from the last one.
    """
    size = np.diff(offsets)
    text_start = np.repeat(offsets[:-1], size)
    able = gear_hashes(data) >> np.uint16(16 - CUT_BITS) == 0
    able[:-1] &= (data[1:] & 0xC0) != 0x80
    at = np.flatnonzero(able)
    at = at[at - text_start[at] >= WINDOW - 1]
    apart = np.ones(len(at), bool)
    apart[1:] = (np.diff(at) >= LEAST_CHUNK) | (text_start[at[1:]] != text_start[at[:-1]])
    cuts = np.unique(np.concatenate((at[apart] + 1, offsets)))
    gap = np.diff(cuts)
    long = np.flatnonzero(gap > MOST_CHUNK)
    if len(long):
        extra = (gap[long] - 1) // MOST_CHUNK
        step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        forced = np.repeat(cuts[long], extra) + step * MOST_CHUNK
        for _ in range(3):  # back to the start of a character
            forced -= (data[forced] & 0xC0) == 0x80
        cuts = np.unique(np.concatenate((cuts, forced)))
    return cuts[:-1], cuts[1:]


def _seen_before(digests: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which digests stood earlier in the same text; rows are in text order."""
    order = np.lexsort((np.arange(len(digests)), digests, owner))
    again = np.zeros(len(digests), bool)
    again[order[1:]] = (digests[order[1:]] == digests[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return again


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``ord, text_key, start, end`` of every chunk whose bytes stand earlier: in a smaller id, or before.

    Digests are counted first, and only their counts are shuffled. A bit array of fixed size over the
    repeated ones then lets the second scan pass on just the chunks that may have a copy; those are
    grouped by two 64-bit digests, with partial sums before the shuffle, and joined back to the first id.
    """

    def cut_up(piece: pa.RecordBatch):
        data, off = flat(piece.column("text"))
        starts, ends = chunks(data, off)
        owner = np.searchsorted(off, starts, "right") - 1
        return data, off, starts, ends, owner, spans(prefix(data), starts, ends)

    def counted(batches):
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cut_up(piece)[5].view(np.int64))], names=["digest"])

    source = keyed(docs)
    repeated = repeated_filter(source.select("text").mapInArrow(counted, "digest long"), "digest")

    def passed(batches):
        for piece in pieces(batches):
            data, off, starts, ends, owner, digest = cut_up(piece)
            keep = found(repeated, digest.view(np.int64))
            starts, ends, owner, digest = starts[keep], ends[keep], owner[keep], digest[keep]
            second = spans(prefix(data ^ 0x5A), starts, ends)
            who = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("ord").take(who), piece.column("text_key").take(who),
                    pa.array(starts - off[owner]), pa.array(ends - off[owner]),
                    pa.array(digest.view(np.int64)), pa.array(second.view(np.int64)), pa.array(_seen_before(digest, owner)),
                ],
                names=["ord", "text_key", "start", "end", "digest", "second", "again"],
            )

    rows = written(source.mapInArrow(passed, "ord long, text_key long, start long, end long, digest long, second long, again boolean"))
    firsts = written(rows.groupBy("digest", "second").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return rows.join(firsts, ["digest", "second"]).where("ord > first_ord or again").select("ord", "text_key", "start", "end")


def without_repeated_chunks(docs: DataFrame, least: int = LEAST_SPAN) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` per document.

    Chunks that stand earlier in the corpus are removed where they make up a run of at least ``least``
    bytes: single short chunks, which are a few words that anyone may write, stay. ``kept`` has the
    remaining bytes, null where nothing was removed; cuts lie between characters.

    Nulls: a null text is an empty one; rows without id come last and are no copies of each other. Rows
    that repeat an id are one document and no copies of each other either. Ids must be whole numbers. An
    empty table gives no rows; further columns are ignored.
    """
    return cut(docs, written(repeated_chunks(docs)), least)
