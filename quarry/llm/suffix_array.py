"""Linear-time suffix arrays by grouping: no recursion and no renaming of symbols."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a sequence of integers (0 or more).

    First, suffixes are grouped by their longest Lyndon prefix: groups of equal first symbols are taken in descending
    order; each suffix of a group points to the nearest suffix on its left in a lower group; and what is pointed to,
    more often counting as higher, moves to a group of its own behind its old one. Then each group's own order follows from
    the suffixes already placed, lowest first, along the same pointers.
    """
    text = (np.asarray(symbols, np.int64) + 1).tolist()
    text.append(0)  # an end below all symbols
    n = len(text)
    layout = np.argsort(np.array(text), kind="stable").tolist()  # suffixes in groups, low to high
    place = [0] * n
    first = [0] * n  # of a suffix: where its group begins
    begin = 0
    for k, s in enumerate(layout):
        if k and text[s] != text[layout[k - 1]]:
            begin = k
        place[s], first[s] = k, begin
    size = {}
    for s in layout:
        size[first[s]] = size.get(first[s], 0) + 1
    previous = [-1] * n
    high = n
    while high > 0:
        low = first[layout[high - 1]]
        members = sorted(layout[low:high])
        pointed: dict[int, int] = {}
        for s in members:
            # everything from low upwards is this group or a higher one, and has its pointer already
            j = s - 1
            while j >= 0 and first[j] >= low:
                j = previous[j]
            previous[s] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            by_count: dict[int, list[int]] = {}
            for j, count in pointed.items():
                by_count.setdefault(count, []).append(j)
            for count in sorted(by_count, reverse=True):
                moved: dict[int, list[int]] = {}
                for j in by_count[count]:
                    moved.setdefault(first[j], []).append(j)
                for old, some in moved.items():
                    whole = size[old]
                    if len(some) == whole:
                        continue  # the whole group moves: it stays where it is
                    new = old + whole - len(some)
                    # swap them to the end of their group
                    spot = old + whole - 1
                    for j in some:
                        other, at = layout[spot], place[j]
                        layout[at], place[other] = other, at
                        layout[spot], place[j] = j, spot
                        spot -= 1
                    for j in some:
                        first[j] = new
                    size[old], size[new] = whole - len(some), len(some)
        high = low
    # the order within groups
    out = [-1] * n
    free = {k: k for k in size}
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            group = first[j]
            out[free[group]] = j
            free[group] += 1
            placed[j] = True
            j = previous[j]
    return np.array(out[1:], np.int64)
