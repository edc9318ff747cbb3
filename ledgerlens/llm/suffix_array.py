"""Suffix arrays of many strings at once by linear grouping, in numpy.

Phase 1 groups suffixes by first symbol and takes the groups of each string from the highest to the lowest.
For a group, every suffix finds its previous smaller one (the nearest to the left in a lower group, found by
following the pointers of higher groups). Suffixes that are pointed to leave their group for a new one right
above it, further up the more pointers meet in them: their common Lyndon prefix has grown by that many
copies of the group's. Phase 2 reads the suffix array from its lowest entry and hands each suffix that ends
at the entry its place, which is the next free one of its group. Nothing is renamed or sorted recursively.

All strings move in step: each round takes one group (or one entry) of every string, so that one array
operation serves thousands of strings.
"""

from __future__ import annotations

import numpy as np

from ledgerlens.llm.bytes_and_words import ranges


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffixes of each string in order. Strings lie one after another in `symbols`; the result has as many
    entries per string, as indexes into `symbols`.

    The last symbol of each string must be 0 and occur nowhere else in it.
    """
    lengths = np.asarray(lengths, np.int64)
    first = np.cumsum(lengths) - lengths
    group, previous = _grouped(symbols, first, lengths)
    return _emitted(group, previous, first, lengths)


def _grouped(symbols: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The final group (its first place) and the previous smaller suffix of each suffix."""
    n = len(symbols)
    of = np.repeat(np.arange(len(lengths)), lengths)
    key = of * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    ordered = key[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.zeros(n, np.int64)
    size[heads] = np.diff(np.append(heads, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(heads, size[heads])
    # A suffix without a smaller one before it points to place n, whose group is below all others.
    group = np.append(group, -1)
    previous = np.full(n + 1, n, np.int64)
    leaving = np.zeros(n, bool)
    start_of = np.repeat(first, lengths)
    high = first + lengths
    active = np.flatnonzero(lengths > 1)
    while len(active):
        end = high[active]
        begin = group[order[end - 1]]
        count = end - begin
        members = order[ranges(begin, count)]
        own = np.repeat(begin, count)
        _point(members, own, group, previous, start_of, n)
        high[active] = begin
        active = active[begin > first[active] + 1]
        targets = previous[members]
        targets = np.sort(targets[targets < n])
        if not len(targets):
            continue
        new = np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1]]))
        times = np.diff(np.append(new, len(targets)))
        targets = targets[new]
        _lift(targets, times, order, place, group, size, leaving)
    return group[:n], previous[:n]


def _point(members, own, group, previous, start_of, n) -> None:
    """Set the previous smaller suffix of the members of the groups `own`."""
    at = np.where(members > start_of[members], members - 1, n)
    todo = np.flatnonzero(group[at] > own)
    while len(todo):
        at[todo] = previous[at[todo]]
        todo = todo[group[at[todo]] > own[todo]]
    previous[members] = at
    # Where the pointer meets the same group, that member's own pointer holds.
    todo = np.flatnonzero(group[at] == own)
    while len(todo):
        at[todo] = previous[at[todo]]
        previous[members[todo]] = at[todo]
        todo = todo[group[at[todo]] == own[todo]]


def _lift(targets, times, order, place, group, size, leaving) -> None:
    """Move the targets to new groups at the upper end of theirs, in the order of their times."""
    old = group[targets]
    rank = np.lexsort((times, old))
    targets, times, old = targets[rank], times[rank], old[rank]
    head = np.concatenate([[True], old[1:] != old[:-1]])
    starts = np.flatnonzero(head)
    count = np.diff(np.append(starts, len(old)))
    tail = old[starts] + size[old[starts]] - count
    slots = ranges(tail, count)
    leaving[targets] = True
    occupants = order[slots]
    pushed = occupants[~leaving[occupants]]
    leaving[targets] = False
    freed = place[targets]
    freed = freed[freed < np.repeat(tail, count)]
    order[freed] = pushed
    place[pushed] = freed
    order[slots] = targets
    place[targets] = slots
    size[old[starts]] -= count
    run = np.flatnonzero(head | np.concatenate([[True], times[1:] != times[:-1]]))
    length = np.diff(np.append(run, len(old)))
    size[slots[run]] = length
    group[targets] = np.repeat(slots[run], length)


def _emitted(group: np.ndarray, previous: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    n = len(group)
    out = np.zeros(n, np.int64)
    free = np.arange(n)  # next free place of the group that starts here
    placed = np.zeros(n + 1, bool)
    placed[n] = True
    out[first] = first + lengths - 1
    placed[out[first]] = True
    # The suffix before a string's first belongs to another string.
    before = np.arange(-1, n - 1)
    before[first] = n
    longest_first = np.argsort(-lengths, kind="stable")
    first, lengths = first[longest_first], lengths[longest_first]
    going = np.searchsorted(-lengths, -np.arange(lengths[0] + 1 if len(lengths) else 1), side="left")
    for step in range(int(lengths[0]) if len(lengths) else 0):
        at = before[out[first[: going[step]] + step]]
        at = at[~placed[at]]
        while len(at):
            slot = free[group[at]]
            out[slot] = at
            free[group[at]] = slot + 1
            placed[at] = True
            at = previous[at]
            at = at[~placed[at]]
    return out


def equal_neighbours(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, block: int = 20_000) -> np.ndarray:
    """Whether the `length` bytes at a[k] and at b[k] are the same; all must lie inside `data`."""
    steps = length // 8
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) - 8 * steps + 1, steps), (1, 8), writeable=False) if (
        len(data) >= length
    ) else None
    same = np.zeros(len(a), bool)
    if words is None or not len(a):
        return same
    tail = np.arange(8 * steps, length)
    todo = np.flatnonzero(words[a, steps - 1] == words[b, steps - 1])
    for k in range(0, len(todo), block):
        part = todo[k : k + block]
        equal = (words[a[part]] == words[b[part]]).all(axis=1)
        if len(tail):
            equal &= (data[a[part][:, None] + tail] == data[b[part][:, None] + tail]).all(axis=1)
        same[part] = equal
    return same
