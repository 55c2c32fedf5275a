"""Suffix sorting by linear grouping: suffix groups of equal Lyndon prefix, refined in descending order, then emitted."""

from __future__ import annotations

from itertools import accumulate


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of ``s`` in order. Symbols are small non-negative integers; ``s`` must end in its only 0.

    First phase: groups start as the suffixes with the same first symbol. From the highest group down, each member points
    to the nearest suffix before it in a lower group; the suffixes that are pointed at move to a new group right above
    their old one, those that are pointed at more often further up. In the end a group holds the suffixes with the same
    Lyndon prefix. Second phase: in ascending order, a suffix that is placed places the one before it, then that one's
    pointer's target, and so on, each at the front of its group.

    Time is linear, and nothing is sorted: symbols and the numbers of pointers are counted, and members of a group stay in
    the order of their places, in which pointers never go back.
    """
    n = len(s)
    count = [0] * (max(s) + 1)
    for x in s:
        count[x] += 1
    first = [0, *accumulate(count)]
    head = [first[x] for x in s]  # by suffix: where its group starts
    end, start_at = [0] * (n + 1), [0] * (n + 1)  # by a group's start, and by its end
    members: list[list[int] | None] = [None] * (n + 1)
    for x, c in enumerate(count):
        if c:
            end[first[x]], start_at[first[x] + c], members[first[x]] = first[x] + c, first[x], []
    for i, h in enumerate(head):
        members[h].append(i)
    pointer = [-1] * n

    high = n
    while high > 0:
        low = start_at[high]
        targets, times = [-1], [0]
        for i in members[low]:
            if head[i] != low:
                continue  # it has moved up since
            j = i - 1
            while j >= 0 and head[j] >= low:
                j = pointer[j]
            pointer[i] = j
            if j == targets[-1]:
                times[-1] += 1
            else:
                targets.append(j)
                times.append(1)
        members[low], high = None, low
        by_times: list[list[int]] = [[] for _ in range(max(times[1:], default=0))]
        for j, c in zip(targets[1:], times[1:]):
            by_times[c - 1].append(j)
        for some in reversed(by_times):
            by_group: dict[int, list[int]] = {}
            for j in some:
                by_group.setdefault(head[j], []).append(j)
            for h, moved in by_group.items():
                e = end[h]
                start = e - len(moved)
                if start == h:
                    continue  # all of the group: it stays where it is
                for j in moved:
                    head[j] = start
                members[start] = moved
                end[h], end[start] = start, e
                start_at[e], start_at[start] = start, h

    out, filled, placed = [-1] * n, [0] * n, bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            h = head[j]
            out[h + filled[h]] = j
            filled[h] += 1
            placed[j] = 1
            j = pointer[j]
    return out
