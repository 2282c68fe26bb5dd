"""Suffix sorting by Lyndon-prefix groups.

The longest Lyndon prefix of a suffix ends where its next smaller suffix begins.
Suffixes with the same such prefix form a group, and the groups' order is that of
the prefixes. ``suffix_order`` builds it in two passes, each linear in the text:

1. Groups begin as the suffixes with the same first symbol and are processed from
   the highest down. When a group comes up, its members' prefixes are whole. Each
   member looks for the nearest suffix to its left in a lower group (its
   previous smaller one), jumping along the pointers found before. That suffix's
   prefix goes on with the members that lead to it, as many as stand in a row;
   suffixes of one group that go on alike leave it together for a new group just
   above it, the more members the higher.
2. In the order of the finished array, each suffix lets the suffixes whose next
   smaller one it is take the next free place of their group: the one before it,
   and on along the previous-smaller pointers up to one that has its place.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(text: np.ndarray) -> tuple[list[int], list[int]]:
    """For each suffix of ``text``: the first place of its group in the suffix array,
    and its previous smaller suffix (-1: none). ``text`` holds non-negative integers;
    its last symbol must be its only 0, so that the last suffix, which is also
    number -1, is the lowest group and ends every walk to the left."""
    n = len(text)
    first = np.argsort(text, kind="stable")
    bounds = np.append(0, np.cumsum(np.bincount(text)))
    order = first.tolist()
    place = np.empty(n, dtype=np.int64)
    place[first] = np.arange(n)
    place = place.tolist()
    group = bounds[text].tolist()
    size = [0] * (n + 1)
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b > a:
            size[a] = b - a
    prev = [-1] * n
    end = n
    while end:
        i = order[end - 1]
        g = group[i]
        if end - g == 1:
            j = i - 1
            while group[j] > g:
                j = prev[j]
            prev[i] = j
            moves = ((j,),) if j >= 0 else ()
        else:
            rows: dict[int, int] = {}
            longer = False
            # Left to right, so a member finds the one before it in its row done.
            for i in sorted(order[g:end]):
                j = i - 1
                while group[j] > g:
                    j = prev[j]
                if group[j] == g:
                    j = prev[j]
                    if j >= 0:
                        rows[j] += 1
                        longer = True
                elif j >= 0:
                    rows[j] = 1
                prev[i] = j
            if longer:
                by: dict[int, list[int]] = {}
                for j, c in rows.items():
                    by.setdefault(c, []).append(j)
                moves = [by[c] for c in sorted(by, reverse=True)]
            else:
                moves = (rows,)
        end = g
        for members in moves:
            leaving: dict[int, list[int]] = {}
            for j in members:
                old = group[j]
                if old in leaving:
                    leaving[old].append(j)
                else:
                    leaving[old] = [j]
            for old, moved in leaving.items():
                left = size[old] - len(moved)
                if not left:
                    continue  # the whole group goes on alike
                size[old] = left
                start = top = old + left
                size[start] = len(moved)
                for j in moved:
                    at, other = place[j], order[top]
                    order[at], place[other] = other, at
                    order[top], place[j] = j, top
                    group[j] = start
                    top += 1
    return group, prev


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of ``text``, whose last symbol must be its only 0."""
    group, prev = lyndon_groups(text)
    n = len(text)
    free = list(range(n))
    order = [0] * n
    order[0] = n - 1
    group[n - 1] = -1  # a suffix that has its place; number -1 is one
    for suffix in order:
        i = suffix - 1
        g = group[i]
        while g >= 0:
            group[i] = -1
            at = free[g]
            free[g] = at + 1
            order[at] = i
            i = prev[i]
            g = group[i]
    return np.array(order, dtype=np.int64)
