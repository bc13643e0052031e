"""Periodic runs of words: stretches that repeat with one period, found by uniting suffixes by common prefix.

The suffixes of a document are sorted, and neighbours are united in the order of decreasing common prefix
(Kruskal's order on the suffix array). A class keeps its positions in order. Where a union makes two
positions i < j adjacent, their suffixes share exactly the present prefix, so w[i .. j + prefix) has period
j - i. If the period is short enough against the prefix and cannot go on to the left, this is a run, and
each run comes from the one union that joins its first position to the one a period later.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.arrays import FOLD, IS_SPACE, flat, grams, pieces, prefix, spans, text_batches, within, words

LEAST = 6
TIMES = 4


def suffix_order(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of several texts in order, and the words each shares with the one before it.

    ``ids`` numbers equal words alike; text t has the words ``first[t]`` to ``first[t + 1]``. Suffixes end
    with their text and are sorted text by text. Ranks of 1, 2, 4 ... words are kept until no two are
    equal; common prefixes are then put together from the ranks, so nothing rests on hashes.
    """
    n = len(ids)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    order = np.lexsort((ids, text))
    ranks, width = [], 1
    new = np.ones(n, bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        ranks.append(rank)
        if new.all():
            break
        behind = np.zeros(n, np.int64)
        at = np.flatnonzero(np.arange(n) + width < end)
        behind[at] = rank[at + width]
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        new[1:] = key[order[1:]] != key[order[:-1]]
        width *= 2
    shared = np.zeros(n, np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        open_ = np.flatnonzero((left < end[order[:-1]]) & (right < end[order[1:]]) & (text[order[:-1]] == text[order[1:]]))
        same = open_[ranks[level][left[open_]] == ranks[level][right[open_]]]
        shared[same + 1] += 1 << level
        left[same] += 1 << level
        right[same] += 1 << level
    return order, shared


def find_runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Per text its runs ``(start, length, period)``, by start and period: at least ``least`` words and ``times`` periods."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    if not len(ids):
        return out
    order, shared = suffix_order(ids, first)
    reach = max(1, min(max((times - 1) * d, least - d) for d in range(1, least + 1)))  # less cannot seed a run
    edges = np.flatnonzero(shared >= reach)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = first.tolist()
    words_ = ids.tolist()
    root: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for t, x, y, common in zip(text[order[edges]].tolist(), order[edges - 1].tolist(), order[edges].tolist(), shared[edges].tolist()):
        a, b = find(x), find(y)
        small, large = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(small) > len(large):
            small, large, a, b = large, small, b, a
        root[a] = b
        members[b] = large
        own = None
        for p in reversed(small):  # from the right: what is left of p is of the other class, what is right of it is too or is the one before
            at = bisect_left(large, p)
            before, behind = large[at - 1] if at else None, large[at] if at < len(large) else None
            for i, j in ((before, p), (p, behind)):
                if i is None or j is None or j == own:
                    continue
                d = j - i
                if common >= (times - 1) * d and common + d >= least and (i == starts[t] or words_[i - 1] != words_[j - 1]):
                    out[t].append((i - starts[t], common + d, d))
            large.insert(at, p)
            own = p
    return [sorted(set(runs), key=lambda r: (r[0], r[2])) for runs in out]


def looped(n: int, doc_id, every: int) -> np.ndarray | None:
    """Which original word stands at each place of a document that is made to loop, or None if it is not.

    One document in ``every``, by the checksum of its id, goes on from a place on with a period that fits
    three to ten times, as a generator that is stuck would. Both follow from the checksum.
    """
    if not n or doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % every:
        return None
    g = h // every
    a = g % n
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % (1 + (n - a) // (3 + g % 8)))


def _may_repeat(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Texts in which some ``k`` neighbouring words come twice."""
    inside = within(first, k)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(inside)][inside]
    keys = grams(hashes, k)[inside] ^ (owner.astype(np.uint64) + np.uint64(1)) * FOLD
    by = np.argsort(keys)
    twice = np.flatnonzero(keys[by[1:]] == keys[by[:-1]])
    return np.unique(owner[by[twice]])


def word_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, loop_every: int | None = None) -> DataFrame:
    """``doc_id, runs, collapsed`` per document: its periodic runs, and its text with one period of each left.

    Words are what white space (blank, tab to carriage return) separates. ``runs`` are structs ``start, length,
    period`` by start and period: maximal stretches of at least ``least`` words and ``times`` times their
    smallest period. A word is left out of ``collapsed`` if any run has it behind its first period; the rest
    is joined by one blank. With ``loop_every`` some documents are made to loop before (:func:`looped`).

    A map over whole documents, without a shuffle. A batch is sifted first: only documents in which as many
    words repeat as the shortest run needs are sorted. Nulls: a null text has no words, no runs and an empty
    ``collapsed``; rows without id or with a repeated id are documents like any other. An empty table gives no
    rows; further columns are ignored.
    """
    shortest = max(1, min(max((times - 1) * d, least - d) for d in range(1, least + 1)))

    def scan(batches):
        for piece in pieces(batches):
            data, off = flat(piece.column("text"))
            begins, ends, first = words(data, off, ~IS_SPACE)
            hashes = spans(prefix(data), begins, ends)
            ids, counts = piece.column("doc_id").to_pylist(), np.diff(first)
            moved = {}
            for t, doc_id in enumerate(ids) if loop_every else ():
                source = looped(int(counts[t]), doc_id, loop_every)
                if source is not None:
                    moved[t] = source
                    hashes[first[t] : first[t + 1]] = hashes[first[t] : first[t + 1]][source]
            raw = [data[a:b].tobytes().split() for a, b in zip(off[:-1], off[1:])]
            for t, source in moved.items():
                raw[t] = [raw[t][i] for i in source.tolist()]
            active = _may_repeat(hashes, first, shortest)
            number: dict[bytes, int] = {}
            exact = np.array([number.setdefault(w, len(number)) for t in active for w in raw[t]], np.int64)
            found = find_runs(exact, np.concatenate(([0], np.cumsum(counts[active]))), least, times)
            runs: list[list] = [[] for _ in ids]
            for t, own in zip(active.tolist(), found):
                runs[t] = own
                if own:
                    change = np.zeros(len(raw[t]) + 1, np.int64)
                    for start, size, period in own:
                        change[start + period] += 1
                        change[start + size] -= 1
                    raw[t] = [w for w, inside in zip(raw[t], np.cumsum(change).tolist()) if not inside]
            kinds = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            lists = pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs], pa.list_(kinds))
            kept = pa.array([b" ".join(r) for r in raw], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists, kept], names=["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return text_batches(docs).select("doc_id", "text").mapInArrow(scan, schema)


def strongest(runs: Column) -> Column:
    """The run that holds most periods; of equal ones the first. Lengths and periods are compared as fractions."""
    longer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(longer(best, r), r).otherwise(best))
