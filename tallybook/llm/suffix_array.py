"""Suffix arrays by induced sorting, in numpy, for the shard one task works on.

Every step handles whole runs of buckets at once: suffixes are typed, the substrings between
leftmost-smaller positions are sorted by one induction and named, equal names are resolved by
recursion on the names, and a last induction gives the order of all suffixes.
"""

from __future__ import annotations

import numpy as np

SMALL = 24


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``text`` (non-negative integers) in ascending order."""
    text = np.asarray(text, dtype=np.int32)
    closed = np.append(text + 1, np.int32(0))
    return _induced_sort(closed, int(closed.max()) + 1)[1:]


def _induced_sort(t: np.ndarray, sigma: int) -> np.ndarray:
    """Order of all suffixes of ``t``, whose last element is its only and smallest 0."""
    n = len(t)
    if n <= SMALL:
        big_endian = t.astype(">u4")
        return np.array(sorted(range(n), key=lambda i: big_endian[i:].tobytes()), dtype=np.int64)
    smaller = _smaller_type(t)
    leftmost = np.zeros(n, dtype=bool)
    leftmost[1:] = smaller[1:] & ~smaller[:-1]
    marks = np.flatnonzero(leftmost)
    by_first = marks[np.argsort(t[marks], kind="stable")]
    roughly = _induce_all(t, smaller, by_first, sigma)
    ordered = roughly[leftmost[roughly]]
    names = _name(t, marks, ordered)
    if names.max() + 1 < len(marks):
        ordered = marks[_induced_sort(names, int(names.max()) + 1)]
        return _induce_all(t, smaller, ordered, sigma)
    return _induce_all(t, smaller, ordered, sigma)


def _smaller_type(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; runs take the type at their end."""
    n = len(t)
    step = t[1:] != t[:-1]
    ends = np.where(step, np.arange(n - 1), n)
    run_end = np.minimum.accumulate(ends[::-1])[::-1]
    smaller = np.empty(n, dtype=bool)
    smaller[:-1] = t[run_end] < t[run_end + 1]
    smaller[-1] = True
    return smaller


def _name(t: np.ndarray, marks: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Rank of the substring from each mark to the next, in text order; equal ones share it."""
    length = np.ones(len(t), dtype=np.int32)
    length[marks[:-1]] = np.diff(marks) + 1
    a, b = ordered[:-1], ordered[1:]
    differ = length[a] != length[b]
    active = np.flatnonzero(~differ)
    depth = 0
    while len(active):
        unequal = t[a[active] + depth] != t[b[active] + depth]
        differ[active[unequal]] = True
        depth += 1
        active = active[~unequal]
        active = active[length[a[active]] > depth]
    names = np.empty(len(t), dtype=np.int32)
    names[ordered] = np.concatenate(([0], np.cumsum(differ)))
    return names[marks]


def _induce_all(t: np.ndarray, smaller: np.ndarray, marks: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, from the sorted leftmost-smaller ones."""
    last = len(t) - 1
    larger = ~smaller
    found = _induce(t, marks, larger, sigma)
    larger_sorted = found[larger[found]]
    induced = smaller.copy()
    induced[last] = False
    found = _induce(sigma - 1 - t, larger_sorted[::-1], induced, sigma)
    return np.concatenate(([last], found[::-1]))


def _induce(t: np.ndarray, given: np.ndarray, wanted: np.ndarray, sigma: int) -> np.ndarray:
    """Place every ``wanted`` suffix behind the suffix after it, bucket by bucket.

    A bucket holds its wanted suffixes first and the given ones, already in order, behind them.
    Runs of buckets that place nothing among themselves are handled together.
    """
    wanted_count = np.bincount(t[wanted], minlength=sigma)
    first = t[given]
    given_count = np.bincount(first, minlength=sigma)
    start = np.zeros(sigma + 1, dtype=np.int64)
    np.cumsum(wanted_count + given_count, out=start[1:])
    before = np.cumsum(given_count) - given_count
    order = np.full(start[-1], -1, dtype=np.int64)
    order[start[first] + wanted_count[first] + np.arange(len(given)) - before[first]] = given
    head = start[:-1].copy()

    def place(after: np.ndarray) -> None:
        if len(after) == 0:
            return
        target = t[after]
        by_target = np.argsort(target, kind="stable")
        target, after = target[by_target], after[by_target]
        edge = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        count = np.diff(np.append(edge, len(target)))
        order[head[target] + np.arange(len(target)) - np.repeat(edge, count)] = after
        head[target[edge]] += count

    def preceding(found: np.ndarray) -> np.ndarray:
        before_it = found[found > 0] - 1
        return before_it[wanted[before_it]]

    buckets = np.flatnonzero(wanted_count + given_count)
    k, width = 0, 1
    while k < len(buckets):
        c, end = buckets[k], min(k + width, len(buckets))
        part = order[start[c] : start[buckets[end - 1] + 1]]
        after = preceding(part[part >= 0])
        nearest = t[after].min() if len(after) else sigma
        if nearest > buckets[end - 1]:
            place(after)
            k, width = end, width * 2
            continue
        if nearest > c:
            width = int(np.searchsorted(buckets, nearest)) - k
            continue
        front = order[start[c] : head[c]]
        while len(front):
            after = preceding(front)
            front = after[t[after] == c]
            order[head[c] : head[c] + len(front)] = front
            head[c] += len(front)
        after = preceding(order[start[c] : start[c + 1]])
        place(after[t[after] != c])
        k, width = k + 1, 1
    return order


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position, how many symbols it shares with the suffix sorted before it, up to ``most``.

    Kept in text order. Symbols are below 512, so seven of them, nine bits each, are compared at a
    time; zeros stand behind the end of the text.
    """
    n = len(text)
    padded = np.zeros(n + most + 8, dtype=np.uint64)
    padded[:n] = text
    word = np.zeros(n + most + 1, dtype=np.uint64)
    for j in range(7):
        word = (word << np.uint64(9)) | padded[j : j + len(word)]
    phi = np.full(n, -1, dtype=np.int64)
    phi[order[1:]] = order[:-1]
    shared = np.zeros(n, dtype=np.int32)
    here = np.flatnonzero(phi >= 0)
    there = phi[here]
    depth = 0
    while depth < most and len(here):
        a, b = word[here + depth], word[there + depth]
        same = a == b
        differing = (a ^ b)[~same]
        high = np.zeros(len(differing), dtype=np.int32)
        for j in range(1, 7):
            high += (differing >> np.uint64(9 * (7 - j))) == 0
        shared[here[~same]] = np.minimum(depth + high, most)
        here, there = here[same], there[same]
        inside = there + depth + 7 < n
        inside &= here + depth + 7 < n
        shared[here] = np.minimum(depth + 7, most)
        here, there = here[inside], there[inside]
        depth += 7
    return shared
