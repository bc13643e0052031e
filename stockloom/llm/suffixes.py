"""Suffix arrays by induced sorting, in whole-array steps.

The order of a scan over the suffix array only matters between buckets of one first byte and, inside a
bucket, between a suffix and the one it induces there. So a scan goes bucket by bucket, and inside a
bucket in waves: all suffixes found so far induce their predecessors at once, and those that fall into
the same bucket are the next wave.
"""

from __future__ import annotations

import numpy as np

from stockloom.llm.arrays import prefix, spans


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (type S). ``text`` ends with a unique smallest value."""
    n = len(text)
    rises = np.ones(n, bool)
    step = text[1:] != text[:-1]
    rises[:-1] = text[1:] > text[:-1]
    # equal neighbours take the type of the end of their run
    last = np.where(np.concatenate((step, [True])), np.arange(n), n)
    return rises[np.minimum.accumulate(last[::-1])[::-1]]


def _place(order: np.ndarray, found: np.ndarray, chars: np.ndarray, edge: np.ndarray, up: bool) -> None:
    """Puts suffixes at the edges of their buckets, in the order given, and moves the edges."""
    by = np.argsort(chars, kind="stable")
    found, chars = found[by], chars[by]
    counts = np.bincount(chars, minlength=len(edge))
    rank = np.arange(len(found)) - (np.cumsum(counts) - counts)[chars]
    if up:
        order[edge[chars] + rank] = found
        edge += counts
    else:
        order[edge[chars] - 1 - rank] = found
        edge -= counts


def induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from the order of the leftmost small ones, ``lms``."""
    n, width = len(text), int(text.max()) + 1
    bounds = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=width))))
    order = np.full(n, -1, np.int64)
    head, tail = bounds[:-1].copy(), bounds[1:].copy()
    _place(order, lms[::-1], text[lms[::-1]], tail, up=False)

    def pred(at: np.ndarray, kind: bool) -> np.ndarray:
        before = at[at > 0] - 1
        return before[small[before] == kind]

    for c in np.flatnonzero(np.diff(bounds)):  # large suffixes, smallest bucket first
        lo = bounds[c]
        while lo < head[c]:
            wave, lo = order[lo : head[c]], head[c]
            found = pred(wave, False)
            if len(found):
                _place(order, found, text[found], head, up=True)
        found = pred(order[tail[c] : bounds[c + 1]], False)
        if len(found):
            _place(order, found, text[found], head, up=True)
    tail = bounds[1:].copy()
    for c in np.flatnonzero(np.diff(bounds))[::-1]:  # small suffixes, largest bucket first
        hi = bounds[c + 1]
        while hi > tail[c]:
            wave, hi = order[tail[c] : hi][::-1], tail[c]
            found = pred(wave, True)
            if len(found):
                _place(order, found, text[found], tail, up=False)
        found = pred(order[bounds[c] : head[c]][::-1], True)
        if len(found):
            _place(order, found, text[found], tail, up=False)
        if c == 0:
            order[0] = n - 1
    return order


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``data`` in the order of their first ``depth`` bytes at least.

    Leftmost small substrings are sorted by one induced pass and named; where names repeat, the string of
    names is sorted in turn, by doubling, until names are single or cover ``depth`` bytes. A second
    induced pass sorts everything else. Equal strings beyond ``depth`` stay in no stated order.
    """
    text = np.concatenate((data.astype(np.int64) + 1, [0]))
    small = classify(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = induce(text, small, lms)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    placed = first[is_lms[first]]
    nth = np.zeros(len(text), np.int64)
    nth[lms] = np.arange(len(lms))
    ends = np.append(lms[1:] + 1, len(text))[nth[placed]]
    sums = prefix((text % 256).astype(np.uint8))
    prints = spans(sums, placed, ends)
    name = np.zeros(len(lms), np.int64)
    name[nth[placed]] = np.concatenate(([0], np.cumsum(prints[1:] != prints[:-1])))
    order = _sorted_names(name, depth)
    return induce(text, small, lms[order])[1:]


def _sorted_names(name: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a string of names; each name stands for two bytes or more."""
    n, reach = len(name), 1
    order = np.argsort(name, kind="stable")
    while 2 * reach <= depth and n and name.max() < n - 1:
        behind = np.zeros(n, np.int64)
        behind[: n - reach] = name[reach:] + 1
        key = name * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        name = np.empty(n, np.int64)
        name[order] = rank
        reach *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, exact: bool = True) -> np.ndarray:
    """Permuted common prefixes: per place in the text, the bytes its suffix shares with the one sorted before it.

    Counted up to ``most``, by hashes of equally long spans. Without ``exact`` anything short of ``most``
    counts as 0; with it, halving steps find the length.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    sums = prefix(data)
    shared = np.zeros(n, np.int64)
    at = np.flatnonzero(before >= 0)
    room = n - np.maximum(at, before[at])
    step = most
    while step and len(at):
        fits = np.flatnonzero(np.minimum(room, most) - shared[at] >= step)
        a = at[fits] + shared[at[fits]]
        b = before[at[fits]] + shared[at[fits]]
        same = spans(sums, a, a + step) == spans(sums, b, b + step)
        shared[at[fits[same]]] += step
        if not exact:
            break
        step = 1 << ((most - 1).bit_length() - 1) if step == most and most > 1 else step >> 1
    return shared
