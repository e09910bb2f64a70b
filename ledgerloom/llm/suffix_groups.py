"""Suffix array by groups of equal Lyndon prefixes, in linear time.

Suffixes start in groups by first symbol, kept in one array: a group is named
by the place where it begins, so names compare as the groups do. Groups are
taken from the greatest down. Each member points to the nearest earlier
suffix of a smaller group (previous-smaller pointer); suffixes that are
pointed to are moved into new groups right behind their old one, further
back the more pointers they got, because their prefix is followed by that
many copies of the group's. At the end the groups are those of equal Lyndon
prefixes. One ascending pass over the growing result then puts each suffix
that precedes a placed one, and what it points to in turn, next in its group.
No symbol is ever renamed.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """(group of each suffix, previous-smaller pointers); the last symbol must
    be the only least one."""
    n = len(text)
    array = sorted(range(n), key=text.__getitem__)
    place, group, size, before = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for k, i in enumerate(array):
        if text[i] != text[array[start]]:
            start = k
        place[i] = k
        group[i] = start
        size[start] += 1

    def move(chosen: list[int], old: int) -> None:
        """Chosen members of a group become the group right behind it."""
        many, k = size[old], len(chosen)
        if k == many:
            return
        to = old + many
        new = to - k
        size[old], size[new] = many - k, k
        for j in chosen:
            to -= 1
            p, other = place[j], array[to]
            array[to], array[p] = j, other
            place[j], place[other] = to, p
            group[j] = new

    end = n - 1
    while end >= 0:
        this = group[array[end]]
        if this == end:
            i = array[end]
            j = i - 1
            while j >= 0 and group[j] >= this:
                j = before[j]
            before[i] = j
            if j >= 0 and size[group[j]] > 1:
                move([j], group[j])
            end -= 1
            continue
        pointed: dict[int, int] = {}
        for i in sorted(array[this:end + 1]):
            j = i - 1
            while j >= 0 and group[j] >= this:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for j, count in pointed.items():
            by_count.setdefault(count, {}).setdefault(group[j], []).append(j)
        for count in sorted(by_count, reverse=True):
            for old, chosen in by_count[count].items():
                move(chosen, old)
        end = this - 1
    return group, before


def suffix_array(text: Sequence[int]) -> list[int]:
    """Suffixes of ``text`` in order; the last symbol must be the only least one."""
    n = len(text)
    if not n:
        return []
    group, before = lyndon_groups(text)
    free = list(range(n))  # the next place of the group that begins here
    placed = bytearray(n)
    out = [-1] * n
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return out
