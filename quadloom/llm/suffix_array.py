"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard's text.

Suffixes are small or large by comparison with their right neighbour. Those that are small after a large one
(leftmost-smaller) are sorted by the substrings up to the next of their kind: one induction sorts these
substrings, equal ones share a name, and where names repeat the text of names is sorted in the same way,
recursively. From the sorted leftmost-smaller suffixes one pass forward places all large ones and one pass backward
all small ones. Every step is linear. Classification, names and buckets are arrays. The two passes follow the
order they make: over few symbols they take a bucket at a time, since a bucket is known when the pass comes
to it but for what its own runs of one symbol add; over many symbols (texts of names) they are plain loops."""

from __future__ import annotations

import numpy as np


def small_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its right neighbour; runs of equal symbols share the answer."""
    n = len(text)
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    rises = np.append(text[ends[:-1]] < text[ends[:-1] + 1], True)  # the last symbol is the least of all
    return np.repeat(rises, np.diff(np.concatenate([[-1], ends]))) if n else np.zeros(0, bool)


def induce(text: list[int], small: bytes, sizes: np.ndarray, seeds: list[int]) -> list[int]:
    """All suffixes, from leftmost-smaller ones in the order given."""
    ends = np.cumsum(sizes)
    out = [-1] * len(text)
    tail = ends.tolist()
    for i in reversed(seeds):
        c = text[i]
        tail[c] -= 1
        out[tail[c]] = i
    head = (ends - sizes).tolist()
    for i in out:  # large suffixes stand after the ones they come from, so the loop meets what it places
        if i > 0:
            i -= 1
            if not small[i]:
                c = text[i]
                out[head[c]] = i
                head[c] += 1
    tail = ends.tolist()
    for at in range(len(out) - 1, -1, -1):
        i = out[at] - 1
        if i >= 0 and small[i]:
            c = text[i]
            tail[c] -= 1
            out[tail[c]] = i
    return out


def by_symbol(items: np.ndarray, symbols: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Items of each symbol, in the order they have."""
    if not len(items):
        return []
    by = np.argsort(symbols, kind="stable")
    items, symbols = items[by], symbols[by]
    heads = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    return list(zip(symbols[heads].tolist(), np.split(items, heads[1:]), strict=True))


def induce_in_buckets(text: np.ndarray, small: np.ndarray, symbols: int, seeds: np.ndarray) -> np.ndarray:
    """The same, a bucket at a time."""
    none = np.zeros(0, np.int64)
    seeded = dict(by_symbol(seeds, text[seeds]))

    def sweep(order, first: dict, kind: np.ndarray, come: dict) -> dict:
        """Suffixes of one type in each bucket, in the order the pass meets them. ``first`` are known,
        ``come`` follow them in their bucket and only lead on."""
        got = {c: [x] for c, x in first.items()}
        laid = {}
        for c in order:
            waves, ahead = [], []
            wave = np.concatenate(got[c]) if c in got else none
            while len(wave):
                waves.append(wave)
                left = wave[wave > 0] - 1
                left = left[kind[left]]
                same = text[left] == c
                ahead.append(left[~same])
                wave = left[same]
            laid[c] = np.concatenate(waves) if waves else none
            left = come.get(c, none)
            left = left[left > 0] - 1
            ahead.append(left[kind[left]])
            ahead = np.concatenate(ahead)
            for d, x in by_symbol(ahead, text[ahead]):
                got.setdefault(d, []).append(x)
        return laid

    large = sweep(range(symbols), {}, ~small, seeded)
    end = {0: np.array([len(text) - 1])}
    down = sweep(range(symbols - 1, -1, -1), end, small, {c: x[::-1] for c, x in large.items()})
    return np.concatenate([part for c in range(symbols) for part in (large[c], down[c][::-1])])


#: Suffixes a symbol has on average, from which on buckets are taken whole.
FULL = 256


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order. The last symbol must be 0, and the only one."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = small_types(text)
    first = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(text)
    if n >= FULL * len(sizes):

        def place_all(seeds: np.ndarray) -> np.ndarray:
            return induce_in_buckets(text, small, len(sizes), seeds)

    else:
        symbols, types = text.tolist(), small.tobytes()

        def place_all(seeds: np.ndarray) -> np.ndarray:
            return np.array(induce(symbols, types, sizes, seeds.tolist()))

    order = place_all(first)
    # the leftmost-smaller substrings are in order now; equal ones get the same name
    place = np.full(n, -1)
    place[first] = np.arange(len(first))
    own = place[order]
    own = own[own >= 0]
    span = np.diff(np.append(first, n)) + 1  # up to and with the next of their kind
    span[-1] = 1
    differs = np.ones(len(own), bool)
    a, b = own[:-1], own[1:]
    open_ = np.flatnonzero(span[a] == span[b]) if len(own) > 1 else np.zeros(0, np.int64)
    differs[1:][open_] = False
    step = 0
    x, y = first[a[open_]], first[b[open_]]
    while len(open_):
        # symbols decide, and at the ends types too, which equal spans settle
        unlike = text[x + step] != text[y + step]
        differs[1:][open_[unlike]] = True
        step += 1
        on = ~unlike & (step < span[a[open_]])
        open_, x, y = open_[on], x[on], y[on]
    names = np.empty(len(first), np.int64)
    names[own] = np.cumsum(differs) - 1
    if len(first) and names.max() + 1 < len(first):
        own = suffix_array(names)
    return place_all(first[own])


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each start, in the order of the text: how much its suffix shares with the one before it in the
    suffix array. Going along the text, that falls by one at most."""
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    said, prior = text.tolist(), before.tolist()
    out = [0] * n
    same = 0
    for i in range(n):
        j = prior[i]
        if j < 0:
            same = 0
            continue
        a, b = i + same, j + same
        while said[a] == said[b]:  # the last symbol is unlike all others, and ends it
            a += 1
            b += 1
        same = a - i
        out[i] = same
        if same:
            same -= 1
    return np.array(out)


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """Whether the first ``length`` symbols from each start also stand at another start."""
    order = suffix_array(text)
    shared = common_prefixes(text, order) >= length
    out = shared.copy()
    hit = shared[order]  # also the suffix before one that shares enough
    out[order[:-1][hit[1:]]] = True
    return out
