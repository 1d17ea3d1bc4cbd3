"""Suffix arrays by induced sorting, with numpy steps over whole buckets, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

from lodestat.llm.common import run_ids

#: Up to so many symbols, buckets are induced one after the other; beyond that, buckets are too small for that to pay, and a text of
#: names is sorted by doubling its ranks.
BUCKETS = 2048


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes in order. ``text``: whole numbers below ``symbols``; its last one is 0 and the only 0."""
    n = len(text)
    if n < 3:
        return np.arange(n - 1, -1, -1, dtype=np.int64)
    small = smaller_types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = induce(text, symbols, small, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = order[is_lms[order]]
    names, count = name_substrings(text, lms, ranked)
    if count < len(lms):
        inner = suffix_array(names, count) if count <= BUCKETS else doubled(names)
        return induce(text, symbols, small, lms[inner])
    return induce(text, symbols, small, ranked)


def smaller_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; runs of one symbol take the type at their end."""
    up = np.sign(text[1:].astype(np.int64) - text[:-1]).astype(np.int8)
    place = np.where(up != 0, np.arange(len(up)), len(up))
    nearest = np.minimum.accumulate(place[::-1])[::-1]
    return np.append(up[np.minimum(nearest, len(up) - 1)] > 0, True)


def induce(text: np.ndarray, symbols: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that follows from the order of the leftmost smaller ones. Larger-type suffixes are put behind the
    heads of buckets from left to right, then smaller-type ones before the ends from right to left. A bucket induces at once, but for
    runs of its own symbol, which take a step for each repetition."""
    sizes = np.bincount(text, minlength=symbols)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    out = np.full(len(text), -1, np.int64)
    by = np.argsort(text[lms], kind="stable")
    starts_of = lms[by]
    n_lms = np.bincount(text[lms], minlength=symbols)
    first_lms = np.cumsum(n_lms) - n_lms

    at = heads.copy()
    for c in np.flatnonzero(sizes).tolist():
        found, done = [], heads[c]
        while at[c] > done:
            j = out[done:at[c]] - 1
            done = int(at[c])
            j = j[j >= 0]
            j = j[~small[j]]
            same = text[j] == c
            if same.any():
                own = j[same]
                out[done:done + len(own)] = own
                at[c] += len(own)
                # in scan order the rest of this step comes before what the own ones induce
                j = j[~same]
            found.append(j)
        j = starts_of[first_lms[c]:first_lms[c] + n_lms[c]] - 1
        found.append(j[j >= 0])
        _put(text, out, at, np.concatenate(found), 1)

    at = ends.copy()
    left = heads + np.bincount(text[~small], minlength=symbols)      # larger-type suffixes lie before it
    for c in np.flatnonzero(sizes)[::-1].tolist():
        found, done = [], ends[c]
        while at[c] < done:
            j = out[at[c]:done][::-1] - 1
            done = int(at[c])
            j = j[j >= 0]
            j = j[small[j]]
            same = text[j] == c
            if same.any():
                own = j[same]
                out[done - len(own):done] = own[::-1]
                at[c] -= len(own)
                j = j[~same]
            found.append(j)
        j = out[heads[c]:left[c]][::-1] - 1
        j = j[j >= 0]
        found.append(j[small[j]])
        _put(text, out, at, np.concatenate(found), -1)
    out[0] = len(text) - 1
    return out


def _put(text: np.ndarray, out: np.ndarray, at: np.ndarray, found: np.ndarray, step: int) -> None:
    """Puts suffixes at their buckets' marks, in order, and moves the marks."""
    if not len(found):
        return
    symbol = text[found]
    by = np.argsort(symbol, kind="stable")
    symbol, found = symbol[by], found[by]
    firsts = np.flatnonzero(np.diff(symbol.astype(np.int64), prepend=-1))
    counts = np.diff(np.append(firsts, len(symbol)))
    place = run_ids(counts)
    out[at[symbol] + (place if step > 0 else -1 - place)] = found
    at[symbol[firsts]] += step * counts


def name_substrings(text: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, int]:
    """Names, in text order, of the substrings from each leftmost smaller suffix to the next; equal ones share a name."""
    ends = np.append(lms[1:], len(text) - 1)
    end_of = np.zeros(len(text), np.int64)
    end_of[lms] = ends
    a, b = ranked[:-1], ranked[1:]
    length = end_of[b] - b + 1
    differ = (end_of[a] - a + 1) != length
    open_ = np.flatnonzero(~differ)
    k = 0
    while len(open_):
        bad = text[a[open_] + k] != text[b[open_] + k]
        differ[open_[bad]] = True
        k += 1
        open_ = open_[~bad]
        open_ = open_[length[open_] > k]
    name = np.concatenate([[0], np.cumsum(differ)])
    names = np.zeros(len(text), np.int64)
    names[ranked] = name
    return names[lms], int(name[-1]) + 1


def doubled(text: np.ndarray) -> np.ndarray:
    """The suffix array by sorting pairs of ranks until all differ."""
    n = len(text)
    rank, width = np.asarray(text, np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - width] = rank[width:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2
        if new[-1] == n - 1 or width >= n:
            return order


def common_prefixes(text: np.ndarray, places: np.ndarray, before: np.ndarray, enough: int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``places`` (ascending) and at ``before`` (-1: none), exact below ``enough``.

    In text order, a suffix whose partner follows the partner of the suffix before shares one symbol less than that one. Only the
    others are compared, symbols at a time, so long shared passages cost one comparison each.
    """
    if not len(places):
        return np.zeros(0, np.int64)
    chained = np.zeros(len(places), bool)
    chained[1:] = (places[1:] == places[:-1] + 1) & (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    chained[1:] &= text[places[1:] - 1] == text[np.maximum(before[1:] - 1, 0)]
    heads = np.flatnonzero(~chained)
    run = np.diff(np.append(heads, len(places)))
    want = enough + run            # the suffixes that follow need so much
    a, b = places[heads], before[heads]
    size = np.zeros(len(heads), np.int64)
    open_ = np.flatnonzero(b >= 0)
    padded = np.append(np.asarray(text, np.int32), -1 - np.arange(8, dtype=np.int32))      # no two places beyond the end are equal
    while len(open_):
        same = _equal(padded, a[open_] + size[open_], b[open_] + size[open_])
        size[open_] += same
        open_ = open_[(same == 8) & (size[open_] < want[open_])]
    lag = run_ids(run)
    return np.maximum(np.repeat(size, run) - lag, 0)


def _equal(text: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal symbols before the first different one, eight at most."""
    differ = np.stack([text[i + k] != text[j + k] for k in range(8)], axis=1)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
