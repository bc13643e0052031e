"""Array helpers over Arrow text columns: slices of bounded bytes, words, rolling and window hashes.

Everything works on one flat byte array per slice with the offsets of its texts, so a slice costs a
fixed number of numpy passes however many texts it holds. Arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000
BASE = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.uint64(0xD6E8FEB86659FD93)

# The bytes that separate words, [\x20\x09-\x0D].
SPACE_BYTES = b" \t\n\x0b\x0c\r"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse; kept for the next call."""
    if "up" not in _powers or len(_powers["up"]) < n:
        inverse = pow(int(BASE), -1, 1 << 64)
        for name, base in (("up", BASE), ("down", np.uint64(inverse))):
            steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mixed32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words that spreads every bit."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def text_batches(df: DataFrame) -> DataFrame:
    """``df`` as it is, in a session that sends at most ``BATCH_ROWS`` rows at once to Python.

    Spark's default of 10,000 rows is meant for narrow rows; as many texts take a large share of an
    executor's memory. A smaller setting of the session stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def pieces(batches, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a piece holds at most ``limit`` text bytes, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its texts; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8, off[-1] - off[0], off[0]) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data`` and, per text, the number of its first word."""
    inside = is_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge |= cut
    marks = np.flatnonzero(edge)
    starts, ends = marks[:-1], marks[1:]
    keep = inside[starts] if len(data) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the bytes; ``spans`` turns two of them into the hash of a span."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[1:], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` neighbours, over text borders too: mask those with ``within``."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = out * FOLD + hashes[j : j + n]
    return mixed(out)


def within(first: np.ndarray, k: int) -> np.ndarray:
    """Which runs of ``k`` words lie inside one text, for texts whose first words are ``first``."""
    total = int(first[-1])
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return owner[: max(0, total - k + 1)] == owner[k - 1 :] if total >= k else np.zeros(0, bool)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))
