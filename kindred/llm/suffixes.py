"""Linear suffix sorting by Lyndon groups (after U. Baier, "Linear-time Suffix Sorting", 2016).

Suffixes start in groups of equal first symbol. Groups are taken in descending order: every member
points to the nearest suffix before it in a lower group (its previous smaller one), and those targets are
moved behind their group-mates, by the number of members that point to them, for what follows them is
that often larger. At the end a group holds the suffixes with one Lyndon prefix. A second pass in ascending order
puts each suffix into the next free place of its group when the suffix that follows its Lyndon prefix
comes up. No names are made and nothing recurs.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Order of the suffixes of ``symbols`` (ints from 1 up); a suffix sorts before its extensions."""
    n = len(symbols) + 1
    text = [*symbols, 0]
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for i, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = i
        place[s], group[s] = i, start
        size[start] += 1
    smaller = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        counts: dict[int, int] = {}
        members = order[start:end]
        if len(members) > 1:
            members.sort()
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if len(counts) == 1:
            # The commonest case: one target, which becomes a group of its own.
            for p in counts:
                g = group[p]
                if size[g] > 1:
                    tail = g + size[g] - 1
                    other, at = order[tail], place[p]
                    order[at], place[other], order[tail], place[p] = other, at, p, tail
                    size[g] -= 1
                    group[p], size[tail] = tail, 1
        elif counts:
            touched: dict[int, list[int]] = {}
            for p in counts:
                touched.setdefault(group[p], []).append(p)
            for g, targets in touched.items():
                if len(targets) > 1:
                    targets.sort(key=counts.__getitem__, reverse=True)
                tail, i = g + size[g], 0
                while i < len(targets):
                    j, c = i, counts[targets[i]]
                    while j < len(targets) and counts[targets[j]] == c:
                        p = targets[j]
                        tail -= 1
                        other, at = order[tail], place[p]
                        order[at], place[other], order[tail], place[p] = other, at, p, tail
                        j += 1
                    if tail > g:
                        size[g] -= j - i
                        size[tail] = j - i
                        for p in targets[i:j]:
                            group[p] = tail
                    i = j
        end = start
    out, free, done = [0] * n, list(range(n)), bytearray(n)
    out[0], done[n - 1] = n - 1, 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = smaller[j]
    return out[1:]
