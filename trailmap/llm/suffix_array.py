"""Suffix arrays by linear grouping, for many short texts at once.

Suffixes are grouped by their Lyndon prefix. Groups are taken in descending order: every
member points to its previous smaller suffix, the nearest one before it whose group is
lower, and the suffixes pointed to are split off their group by how often they are. With
all groups done, the order within them is emitted front to back along the same pointers;
nothing is renamed and there is no recursion (Baier 2016).

numpy works on one group of each text per step, so the steps are those of the longest
text and the texts of a call should be about equally long. A long text alone takes a step
for nearly each of its symbols; `ordered_to` sorts all suffixes at once instead, as far as
some symbols reach, by doubling (Manber and Myers 1990).
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ordered suffix starts of each text, one text's after another's.

    `text` holds all texts, `bounds` where each begins, and the end. Each text must end in
    a symbol of its own that is its smallest.
    """
    n, base = len(text), bounds[:-1]
    lane = np.repeat(np.arange(len(base)), np.diff(bounds))
    order = np.lexsort((text, lane))
    new = np.append(True, (text[order][1:] != text[order][:-1]) | (lane[order][1:] != lane[order][:-1]))
    starts = np.flatnonzero(new)
    sa, isa, group, size = order.copy(), np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    isa[order] = np.arange(n)
    group[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    size[starts] = np.diff(np.append(starts, n))
    prev = np.full(n, -1, np.int64)
    moved = np.zeros(n, bool)
    top, low = bounds[1:].copy(), base.copy()
    while len(top):
        gs = group[sa[top - 1]]
        count = top - gs
        ends = np.cumsum(count)
        slots = np.repeat(gs - (ends - count), count) + np.arange(ends[-1])
        members, own, first = sa[slots], np.repeat(gs, count), np.repeat(low, count)
        p = members - 1
        p[p < first] = -1
        prev[members] = p
        look = np.flatnonzero((p >= 0) & (group[p] >= own))
        while len(look):
            q = prev[p[look]]
            p[look] = q
            prev[members[look]] = q
            look = look[(q >= 0) & (group[q] >= own[look])]
        hit = np.sort(p[p >= 0])
        if len(hit):
            at = np.flatnonzero(np.append(True, hit[1:] != hit[:-1]))
            e, times = hit[at], np.diff(np.append(at, len(hit)))
            old = group[e]
            o = np.lexsort((times, old))
            e, times, old = e[o], times[o], old[o]
            heads = np.append(True, old[1:] != old[:-1])
            at = np.flatnonzero(heads)
            m = np.diff(np.append(at, len(e)))
            whole = size[old[at]]
            free = np.repeat(old[at] + whole - m, m)  # first slot of those split off
            rank = np.arange(len(e)) - np.repeat(at, m)
            ties = np.flatnonzero(heads | np.append(True, times[1:] != times[:-1]))
            tie_n = np.diff(np.append(ties, len(e)))
            start = np.repeat((free + rank)[ties], tie_n)
            size[old[at]] = whole - m
            size[start[ties]] = tie_n
            to, was = free + rank, isa[e]
            moved[e] = True
            there = sa[to]
            out = there[~moved[there]]
            vacated = was[was < free]
            moved[e] = False
            sa[vacated] = out
            isa[out] = vacated
            sa[to] = e
            isa[e] = to
            group[e] = start
        left = gs > low
        top, low = gs[left], low[left]
    return emitted(group, prev, bounds)


def emitted(group: np.ndarray, prev: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Orders the suffixes within groups: each that is in place puts the ones before it in theirs."""
    n, low, high = len(group), bounds[:-1].copy(), bounds[1:].copy()
    out, taken, placed = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    out[low] = high - 1
    placed[high - 1] = True
    i = low.copy()
    j = np.where(high - 2 >= low, high - 2, -1)
    while len(i):
        stop = (j < 0) | placed[j]
        if stop.any():
            i = i + stop
            left = i < high
            if not left.all():
                i, j, low, high, stop = i[left], j[left], low[left], high[left], stop[left]
                if not len(i):
                    break
            nxt = out[i] - 1
            nxt[nxt < low] = -1
            j = np.where(stop, nxt, j)
            go = (j >= 0) & ~placed[j]
        else:
            go = ~stop
        k = j[go]
        g = group[k]
        out[g + taken[g]] = k
        taken[g] += 1
        placed[k] = True
        j = j.copy()
        j[go] = prev[k]
    return out


def ordered_to(text: np.ndarray, bounds: np.ndarray, symbols: int) -> np.ndarray:
    """Like `suffix_arrays`, in order by `symbols` symbols at least and in any order beyond them. Symbols are below 512."""
    n, reach = len(text), 7
    lane = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    rank = np.zeros(n, np.int64)
    for i in range(reach):  # symbols after a text's end are another's, or none; its last is its own, so none decides
        rank[: n - i] |= text[i:].astype(np.int64) << 9 * (reach - 1 - i)
    while True:
        order = np.argsort(rank)
        at = rank[order]
        rank[order] = np.cumsum(np.append(1, at[1:] != at[:-1]))  # from 1; 0 is past the end
        later = np.zeros(n, np.int64)
        later[: max(0, n - reach)] = rank[reach:]
        rank = rank * (n + 1) + later
        reach *= 2
        if reach >= symbols:
            break
    order = np.argsort(rank)
    return order[np.argsort(lane[order], kind="stable")]
