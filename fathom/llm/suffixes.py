"""Suffix arrays by two-stage sorting, to a bounded depth, in numpy."""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; zeros follow the end."""
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8)))
    return np.ndarray(shape=(len(text),), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)


def _smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the one that starts a byte later. The last one is
    greater than nothing."""
    n = len(text)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1] = -1
    # equal neighbours are alike: each takes the next step that isn't zero
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` bytes that follow, word by word where they tie."""
    n = len(words)
    at = at[np.argsort(words[at])]
    key = words[at]
    open_, group = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
    for skip in range(8, depth, 8):
        starts = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1]))) if len(key) else np.zeros(0, bool)
        group = np.cumsum(starts)
        size = np.bincount(group)
        tied = size[group] > 1
        open_, group = open_[tied], group[tied]
        if not len(open_):
            break
        pos = at[open_]
        deep = pos + skip
        key = np.where(deep < n, words[np.minimum(deep, n - 1)], np.uint64(0))
        order = np.lexsort((key, group))
        at[open_] = pos[order]
        key = key[order]
    return at


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Start positions of all suffixes, in the order of their first ``depth`` bytes.

    Two stages: suffixes smaller than their successors are sorted directly. All others start with a
    byte no less than the next, so one scan over the buckets of first bytes, in order, meets each
    one's successor before its own place and appends it there. The scan is a bucket at a time;
    within one, runs of a single byte take a step for each repetition.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    words = words_at(text) if words is None else words
    small = _smaller_than_next(text)
    direct = _sort_directly(np.flatnonzero(small), words, depth)
    size = np.bincount(text, minlength=256)
    start = np.concatenate(([0], np.cumsum(size)))
    of_direct = np.bincount(text[direct], minlength=256)
    out = np.full(n, -1, dtype=np.int64)
    began = np.concatenate(([0], np.cumsum(of_direct)))
    for c in np.flatnonzero(of_direct):
        out[start[c + 1] - of_direct[c] : start[c + 1]] = direct[began[c] : began[c + 1]]
    head = start[:-1].copy()
    out[head[text[-1]]] = n - 1
    head[text[-1]] += 1
    for c in np.flatnonzero(size):
        done = start[c]
        while done < head[c]:
            before = out[done : head[c]] - 1
            done = head[c]
            before = before[before >= 0]
            same = before[(text[before] == c) & ~small[before]]
            out[head[c] : head[c] + len(same)] = same
            head[c] += len(same)
        before = out[start[c] : start[c + 1]] - 1
        before = before[before >= 0]
        first = text[before]
        keep = (first > c) & ~small[before]
        before, first = before[keep], first[keep]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            edges = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1], [True])))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                d = first[x]
                out[head[d] : head[d] + y - x] = before[x:y]
                head[d] += y - x
    return out


def common_prefix_reaches(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in ``order`` but the first, whether it shares ``depth`` bytes (8 or more) with
    the one before. Every suffix has so many."""
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for skip in [*range(0, depth - 7, 8), depth - 8]:
        w = words[order + skip]
        same &= w[1:] == w[:-1]
    return same
