"""Greedy string tiling in linear memory and nearly linear time, on rows of words."""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heapify, heappop, heappush


def longest_matches(pattern: Sequence[str], text: Sequence[str]) -> tuple[list[int], list[int]]:
    """For each word of ``pattern``: the length of the longest run ending there that ``text`` holds, and where it ends there.

    ``text`` becomes a suffix automaton, which ``pattern`` is led through word by word.
    """
    step: list[dict[str, int]] = [{}]
    link, size, place, last = [-1], [0], [0], 0
    for at, word in enumerate(text, 1):
        new, p = len(step), last
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        place.append(at)
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            if size[q] != size[p] + 1:
                # a copy of the state for the shorter runs
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                place.append(place[q])
                copy = len(step) - 1
                while p >= 0 and step[p].get(word) == q:
                    step[p][word] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    lengths, ends = [], []
    state = held = 0
    for word in pattern:
        while state and word not in step[state]:
            state = link[state]
            held = size[state]
        if word in step[state]:
            state = step[state][word]
            held += 1
        lengths.append(held)
        ends.append(place[state])
    return lengths, ends


def tiles(pattern: Sequence[str], text: Sequence[str], least: int) -> list[tuple[int, int, int]]:
    """Runs of ``pattern`` that ``text`` holds, longest first: (place in pattern, place in text, length).

    Tiles do not overlap in ``pattern`` and have ``least`` words or more; ``text`` may be used again and
    again. A run that a longer tile has shortened waits for its turn with what is left of it.
    """
    lengths, ends = longest_matches(pattern, text)
    queue = []
    for i, n in enumerate(lengths):
        # a run that goes on with the next word is part of a longer one
        if n >= least and (i + 1 == len(lengths) or lengths[i + 1] <= n):
            queue.append((-n, i - n + 1, ends[i] - n))
    heapify(queue)
    taken = [False] * len(pattern)
    out = []
    while queue:
        n, at, there = heappop(queue)
        begin, stop = at, at - n
        # longest runs do not lie within each other, so only their ends can be taken
        while begin < stop and taken[begin]:
            begin += 1
        while stop > begin and taken[stop - 1]:
            stop -= 1
        if stop - begin < least:
            continue
        if stop - begin < -n:
            heappush(queue, (begin - stop, begin, there + begin - at))
            continue
        taken[begin:stop] = [True] * (stop - begin)
        out.append((begin, there, stop - begin))
    return out
