"""Packs token sequences into as few bins of fixed size as it can: minimum bin slack over the lengths.

What decides a packing is only how many pieces there are of each length, and lengths are bounded by the
bin. So the search runs on that histogram, and the pieces find their bins by their rank among the pieces
of equal length: no piece is compared with another.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.arrays import pieces, text_batches
from stockloom.operators.prefix import row_positions
from stockloom.session import written

LENGTH = 2048
END_ID = 0
KEPT_PARTS = 800_000
JOINED_PARTS = 5_000
_WIDE_SPACE = re.compile(r"\s\s")
_LOW = 1 << 48


class _Numbers(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        self.new.append(part)
        return n


class _Encoder:
    """From texts to their ids, by a tokenizer file; ids of the parts of a text are kept for later texts.

    Each Python worker loads the tokenizer once. What is kept is bounded, and forgotten as a whole when full.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose bytes begin with a blank
        self.leads[[n for token, n in vocabulary.items() if token.startswith("\u0120")]] = True
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.number.new = []
        self.ids, self.begins, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Keeps the ids of the new parts. Neighbours that are plain words go through the tokenizer as one text: an id that begins with a blank begins the next."""
        new, self.number.new = self.number.new, []
        is_plain = np.array([p[0] == " " and p[1:].split() == [p[1:]] and "<|" not in p for p in new], bool)
        plain = [p for p, x in zip(new, is_plain) if x]
        texts = ["".join(plain[i : i + JOINED_PARTS]) for i in range(0, len(plain), JOINED_PARTS)]
        coded = self._ids(texts)[0]
        begins = np.flatnonzero(self.leads[coded])
        if len(begins) != len(plain):
            is_plain[:] = False
            coded, begins = coded[:0], begins[:0]
        rest, sizes = self._ids([p for p, x in zip(new, is_plain) if not x])
        at = np.empty(len(new), np.int64)
        at[is_plain], at[~is_plain] = begins, len(coded) + np.cumsum(sizes) - sizes
        long = np.empty(len(new), np.int64)
        long[is_plain], long[~is_plain] = np.diff(np.append(begins, len(coded))), sizes
        self.begins = np.concatenate((self.begins, len(self.ids) + at))
        self.sizes = np.concatenate((self.sizes, long))
        self.ids = np.concatenate((self.ids, coded, rest))

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in lists], np.int64)
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.number) > KEPT_PARTS or len(self.ids) > 8 * KEPT_PARTS:
            self.forget()
        cut = [parts(t) for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(c) for c in cut]))).astype(np.int64)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(bounds[-1]))
        self.learn()
        sizes = self.sizes[at]
        total = np.concatenate(([0], np.cumsum(sizes)))
        where = np.repeat(self.begins[at] - total[:-1], sizes) + np.arange(total[-1])
        return self.ids[where], np.diff(total[bounds])


@lru_cache(maxsize=2)
def _encoder(tokenizer_file: str) -> _Encoder:
    return _Encoder(tokenizer_file)


def parts(text: str) -> list[str]:
    """``text`` cut at places where a byte-level tokenizer begins a new word and looks at nothing before it.

    These are: before a space that follows something else than white space, and around a line feed that
    has no white space beside it. So the ids of the text are those of its parts in a row, and a part
    that comes again needs no new search.
    """
    out: list[str] = []
    if not text[:1].isspace() and not _WIDE_SPACE.search(text):
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append("\n")
            cut = line.split(" ")
            if cut[0]:
                out.append(cut[0])
            out.extend([" " + p for p in cut[1:]])
        return out
    cut = text.split(" ")
    if cut[0]:
        out.append(cut[0])
    for before, part in zip(cut, cut[1:]):
        if out and (not before or before[-1].isspace()):
            out[-1] += " " + part
        else:
            out.append(" " + part)
    return out


def token_pieces(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids`` per piece of a document; ``ids`` are little-endian 32-bit numbers.

    A document is its ids and ``end_id`` behind them. Only one longer than ``length`` is cut: into pieces of
    ``length``, of which the first may be shorter. ``start`` counts the ids of the document before the piece.

    Nulls: a null text is an empty one, which is the end id alone; rows without id or with a repeated id
    are documents like any other. An empty table gives no rows; further columns are ignored.
    """

    def coded(batches):
        encode = _encoder(tokenizer_file)
        for piece in pieces(batches):
            ids, sizes = encode([t or "" for t in piece.column("text").to_pylist()])
            ends = np.cumsum(sizes)
            flat = np.insert(ids, ends, np.uint32(end_id))
            sizes = sizes + 1
            n = -(-sizes // length)
            owner = np.repeat(np.arange(len(n)), n)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            first = (sizes - (n - 1) * length)[owner]
            long = np.where(number == 0, first, length)
            ends = np.concatenate(([0], np.cumsum(long))) * 4
            for a in range(0, len(owner), 1 << 16):
                b = min(a + (1 << 16), len(owner))
                off = (ends[a : b + 1] - ends[a]).astype(np.int32)
                data = pa.py_buffer(flat[ends[a] // 4 : ends[b] // 4].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").take(pa.array(owner[a:b])), pa.array(number[a:b].astype(np.int32)),
                        pa.array(np.where(number == 0, 0, first + (number - 1) * length)[a:b]), pa.array(long[a:b]),
                        pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(off.tobytes()), data]),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_batches(docs).select("doc_id", "text").mapInArrow(coded, f"doc_id {kind}, piece int, start long, length long, ids binary")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length fill ``room`` best, of the ``counts`` there are; long pieces come first.

    Subset sums are bits of one integer: adding pieces of a length shifts it. The sums before each shift
    are kept, so the pieces of the best sum are read off backwards.
    """
    sums, within, steps = 1, (1 << (room + 1)) - 1, []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, chunk = min(counts[size], room // size), 1
        while left:
            chunk = min(chunk, left)
            steps.append((size, chunk, sums))
            sums |= (sums << (size * chunk)) & within
            left -= chunk
            chunk *= 2
        if sums >> room:
            break
    best, out = sums.bit_length() - 1, {}
    for size, chunk, before in reversed(steps):
        if not before >> best & 1:
            out[size] = out.get(size, 0) + chunk
            best -= size * chunk
    return out


def bin_patterns(counts: dict[int, int], length: int = LENGTH) -> list[tuple[dict[int, int], int]]:
    """Bins as ``(pieces of each length, how many such bins)``, for ``counts`` pieces of each length.

    Per bin the longest piece left is set and the fullest combination beside it is found and removed. The
    same combination is taken for as many bins as it lasts. Each pattern uses up a length or leaves less
    of it than one bin takes, so there are a few thousand patterns at most, whatever the counts.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        pattern = fullest({s: n for s, n in left.items() if n}, length - seed)
        left[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[s] // n for s, n in pattern.items())
        for s, n in pattern.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        out.append((pattern, times))
    return out


def _blocks(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Per pattern and length: which ranks of that length it takes, its first bin and the offset there; sorted."""
    rows, taken, bins = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for size, n in sorted(pattern.items(), reverse=True):
            at = taken.get(size, 0)
            rows.append((size * _LOW + at, n, bins, offset))
            taken[size] = at + n * times
            offset += size * n
        bins += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "each", "bin", "offset"), table.T.copy()))


def packed(pieces_: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces_`` with ``sequence_id`` and ``offset``: each piece's bin of at most ``length`` and its place there.

    ``pieces_(doc_id, piece, start, length, ...)``; further columns stay. Only the histogram of lengths, at most
    ``length`` rows, reaches the driver; what goes to the tasks has a row per pattern and length in it. Ranks
    among equal lengths come from a range partitioning, so a length may hold any share of the pieces. Offsets
    in a sequence have no gaps. Pieces equal in ``doc_id, piece, start, length`` are exchangeable. No pieces, no rows.
    """
    source = written(pieces_)
    counts = {r["length"]: r["n"] for r in source.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = _blocks(bin_patterns(counts, length))
    order = [F.col(c).asc_nulls_last() for c in ("doc_id", "piece", "start")]
    ranked = row_positions(source, ["length"], order, "_rank")
    columns = source.columns

    def placed(batches):
        for batch in batches:
            rank = batch.column("_rank").to_numpy() - 1
            size = batch.column("length").to_numpy()
            at = np.searchsorted(blocks["key"], size * _LOW + rank, "right") - 1
            inside = rank - blocks["key"][at] % _LOW
            each = blocks["each"][at]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(blocks["bin"][at] + inside // each), pa.array(blocks["offset"][at] + inside % each * size)],
                names=[*columns, "sequence_id", "offset"],
            )

    schema = T.StructType([*source.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(placed, schema)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids`` per bin, for packed pieces that carry their ``ids``; a bin is bounded by its size."""
    rows = packed_pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("rows"))
    joined = F.aggregate("rows", F.lit(b"").cast("binary"), lambda out, r: F.concat(out, r["ids"]))
    return rows.select("sequence_id", "n_tokens", joined.alias("ids"))
