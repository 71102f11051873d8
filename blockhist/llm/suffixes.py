"""Suffix array by linear grouping construction.

Phase 1 sorts suffixes into groups of one Lyndon prefix. It starts with one group per symbol and goes
through the groups in descending order. For every suffix of a group it finds the nearest suffix before
it that lies in a lower group (its previous smaller one, found by following the pointers of the suffixes
in between). These predecessors have their group's prefix followed by the prefix of the current group,
so in their own group they rank above those that are not followed by it, and the more often it follows
the higher: each group is split by that number. No rank is ever computed again.

Phase 2 emits the order inside the groups in one sweep: the suffix before an emitted one, and then its
chain of previous smaller suffixes, each take the next free place of their group.

Published as: U. Baier, Linear-time Suffix Sorting - A New Approach for Suffix Array Construction (2016).
"""

from __future__ import annotations

from collections import Counter


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of ``text``, a list of integers > 0; a suffix that is a prefix of another
    comes first."""
    n = len(text) + 1
    text = [*text, 0]  # the one smallest symbol
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n  # where a suffix stands in order
    start = [0] * n  # first place of a suffix's group
    end = [0] * (n + 1)  # by first place: one past the last
    first = 0
    for at, s in enumerate(order):
        place[s] = at
        if text[s] != text[order[first]]:
            end[first] = at
            first = at
        start[s] = first
    end[first] = n
    before = [-1] * n  # previous smaller suffix

    def split(level: list[int]) -> None:
        """Puts the suffixes of ``level`` into new groups directly above what is left of their old ones."""
        moved: dict[int, int] = {}
        for j in level:
            g = start[j]
            last = end[g] - 1
            at, other = place[j], order[last]
            order[at], order[last] = other, j
            place[other], place[j] = at, last
            end[g] = last
            moved[g] = moved.get(g, 0) + 1
        for j in level:
            start[j] = end[start[j]]
        for g, size in moved.items():
            end[end[g]] = end[g] + size

    high = n
    while high > 0:
        low = start[order[high - 1]]
        if high - low == 1:
            i = order[low]
            p = i - 1
            while p >= 0 and start[p] > low:
                p = before[p]
            before[i] = p
            if p >= 0:
                g = start[p]
                last = end[g] - 1
                if last != g:
                    at, other = place[p], order[last]
                    order[at], order[last] = other, p
                    place[other], place[p] = at, last
                    end[g] = last
                    start[p] = last
                    end[last] = last + 1
        else:
            hits: Counter = Counter()
            for i in sorted(order[low:high]):
                p = i - 1
                while p >= 0 and start[p] > low:
                    p = before[p]
                if p >= 0 and start[p] == low:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    hits[p] += 1
            levels: dict[int, list[int]] = {}
            for p, times in hits.items():
                levels.setdefault(times, []).append(p)
            for times in sorted(levels, reverse=True):
                split(levels[times])
        high = low
    done = bytearray(n)
    upto = list(range(n))  # by first place of a group: its next free place
    order[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not done[s]:
            g = start[s]
            order[upto[g]] = s
            upto[g] += 1
            done[s] = 1
            s = before[s]
    return order[1:]
