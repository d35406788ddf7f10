"""Suffix arrays by induced sorting and permuted common prefixes, over windows of bytes, in numpy.

Windows are laid side by side, each ended by a separator that is smaller than all bytes; separators differ, in the
order of their windows, so no comparison goes beyond a window.  Leftmost-smaller substrings are sorted by induction,
named by direct comparison, and the string of names, a third as long at most, is sorted in the same way, at every size.

Induction goes through the buckets (the suffixes of one first symbol) in order.  Buckets in a row of which none induces
into another of them form a wave, handled by array operations; so a large alphabet takes about the square root of as
many steps.  Within a bucket what its members induce into it is appended in rounds.
"""

from __future__ import annotations

import numpy as np

from . import common as C

SEPARATOR = 0xFF  # never a byte of UTF-8
#: Symbols that one comparison of neighbouring substrings takes.
COMPARED = 1 << 20


def classify(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (type S); separators (0) are S, what precedes them is L."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int32))).astype(np.int8)
    at = np.minimum.accumulate(np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n - 1))[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = np.append(step, np.int8(1))[at] > 0
    small[t == 0] = True
    return small


def _waves(source: np.ndarray, target: np.ndarray, symbols: int) -> list[int]:
    """Edges of rows of buckets: none of a row induces into a later one of it."""
    least = np.full(symbols, symbols, np.int64)
    np.minimum.at(least, source, target)
    edges, reach = [0], symbols
    for s in np.flatnonzero(least < symbols).tolist():
        if s >= reach:
            edges.append(reach)
            reach = symbols
        # what lies between the last edge and s hasn't been reached, so s is of the same wave
        reach = min(reach, int(least[s]))
    return [*edges, reach, symbols] if reach < symbols else [*edges, symbols]


def _induced(t: np.ndarray, member: np.ndarray, seeds: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets in order, each the members that seeds and members induce, then its seeds (given in the order of their
    symbols); with them the buckets' starts and numbers of members.  A member's symbol is its successor's or greater."""
    at = np.flatnonzero(member)
    own, after = t[at], t[at + 1]
    n = np.bincount(own, minlength=symbols)
    first = t[seeds]
    n_seeds = np.bincount(first, minlength=symbols)
    start = np.concatenate([[0], np.cumsum(n + n_seeds)])
    out = np.empty(start[-1], np.int32)
    out[(start[:-1] + n - (np.cumsum(n_seeds) - n_seeds))[first] + np.arange(len(seeds))] = seeds
    head = start[:-1].copy()
    up = own > after
    edges = _waves(after[up], own[up], symbols)
    inner = np.concatenate([[0], np.cumsum(np.bincount(own[~up], minlength=symbols))])

    def put(p: np.ndarray) -> None:
        s = t[p]
        cut = C.starts_of(s)
        size = np.diff(np.append(cut, len(s)))
        out[np.repeat(head[s[cut]] - cut, size) + np.arange(len(s))] = p
        head[s[cut]] += size

    for a, z in zip(edges[:-1], edges[1:], strict=True):
        if inner[z] > inner[a]:
            present = out[C.ragged(start[a:z], head[a:z] - start[a:z])]
            while len(present):
                p = present - 1
                present = p[member[p] & (t[p] == t[present])]
                if len(present):
                    put(present)
        p = out[start[a] : start[z]] - 1  # before the first position comes the last one, a separator and no member
        p = p[member[p]]
        s = t[p]
        far = s >= z
        p, s = p[far], s[far]
        if len(p):
            put(p[np.argsort(s, kind="stable")])
    return out, start, n


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that leftmost-smaller suffixes, in the order given within each symbol, induce."""
    out, start, n = _induced(t, ~small, lms, symbols)
    large = out[C.ragged(start[:-1], n)]
    mirrored = (symbols - 1 - t).astype(t.dtype)
    out, _, _ = _induced(mirrored, small & (t > 0), large[::-1], symbols)
    return np.concatenate([lms[: np.searchsorted(t[lms], 1)], out[::-1]])


def _names(t: np.ndarray, found: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Names, from 1, of leftmost-smaller substrings in their order: equal ones share one."""
    length = follow[found] - found + 1
    same = np.zeros(len(found), bool)
    check = np.flatnonzero(length[1:] == length[:-1]) + 1
    edges = np.searchsorted(np.cumsum(length[check]), np.arange(COMPARED, int(length[check].sum()) + COMPARED, COMPARED), "right")
    low = 0
    for high in edges.tolist():
        high = max(high, min(low + 1, len(check)))
        own = check[low:high]
        if len(own):
            n = length[own]
            differ = t[C.ragged(found[own], n)] != t[C.ragged(found[own - 1], n)]
            same[own] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
        low = high
    return np.cumsum(~same)


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """Positions in the order of their suffixes; t has symbols under ``symbols`` and ends with a 0."""
    small = classify(t)
    star = small.copy()
    star[0] = t[0] == 0
    star[1:] &= ~small[:-1] | (t[1:] == 0)
    lms = np.flatnonzero(star).astype(np.int32)
    rough = induce(t, small, lms[np.argsort(t[lms], kind="stable")], symbols)
    found = rough[star[rough]]
    follow = np.empty(len(t), np.int32)
    follow[lms] = np.append(lms[1:], lms[-1])
    inner = t[found] > 0
    names = _names(t, found[inner], follow)
    name = np.zeros(len(t), np.int32)
    name[found[inner]] = names
    reduced = name[lms]
    k = int(names[-1]) + 1 if len(names) else 1
    # where all differ their order is known: separators, then by name
    order = np.argsort(reduced, kind="stable") if k - 1 == len(names) else suffix_array(reduced, k)
    lms = lms[order]
    return induce(t, small, lms[np.argsort(t[lms], kind="stable")], symbols)


def common_prefixes(data: np.ndarray, sa: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each position, the bytes that it shares with its predecessor in the suffix array.

    rest has the bytes from each position to its separator.  Positions whose left neighbours differ are compared
    directly, eight bytes at a time; of any other it is one less than of its left neighbour."""
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    direct = before <= 0
    direct[0] = True
    rows = np.flatnonzero(~direct)
    left = data[rows - 1]
    direct[rows] = (left != data[before[rows] - 1]) | (rest[rows] == 0) | (left == SEPARATOR)
    out = np.zeros(n, np.int32)
    words = C.wide(np.concatenate([data, np.full(8, SEPARATOR, np.uint8)]))
    live = np.flatnonzero(direct & (before >= 0) & (rest > 0))
    most = np.minimum(rest[live], rest[before[live]])
    length = np.zeros(len(live), np.int64)
    going = np.flatnonzero(most > 0)
    while len(going):
        a, b = live[going] + length[going], before[live[going]] + length[going]
        differ = words[a] ^ words[b]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // 8)
        length[going] = np.minimum(length[going] + same, most[going])
        going = going[(same == 8) & (length[going] < most[going])]
    out[live] = length
    at = np.arange(n, dtype=np.int32)
    anchor = np.maximum.accumulate(np.where(direct, at, 0))
    return np.maximum(out[anchor] - (at - anchor), 0)


def repeats(windows: list[bytes] | np.ndarray, size: int, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal strings of ``size`` bytes that windows hold: (group, window, start within the window), in the
    order of the strings; only groups of at least two."""
    if offsets is None:
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in windows])])
        windows = np.frombuffer(b"".join(windows), np.uint8)
    lens = np.diff(offsets)
    k = len(lens)
    data = np.full(len(windows) + k, SEPARATOR, np.uint8)
    start = offsets[:-1] + np.arange(k)
    data[C.ragged(start, lens)] = windows
    t = data.astype(np.uint16) + np.uint16(1)
    t[start + lens] = 0
    sa = suffix_array(t, 258)
    rest = (np.repeat(start + lens, lens + 1) - np.arange(len(data))).astype(np.int32)
    prefix = common_prefixes(data, sa, rest)[sa]
    more = prefix >= size  # shares enough with its predecessor
    member = more.copy()
    member[:-1] |= more[1:]
    place = sa[member]
    group = np.cumsum(~more[member])
    window = np.searchsorted(start, place, "right") - 1
    return group, window, place - start[window]
