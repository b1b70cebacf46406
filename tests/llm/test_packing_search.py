from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections import Counter

from cellmill.llm.packing import best_fit_decreasing, complete


def naive(items, capacity):
    """Rooms that are left by best fit decreasing, piece by piece."""
    rooms: list[int] = []
    for x in sorted(items, reverse=True):
        i = bisect_left(rooms, x)
        insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - x)
    return rooms


def test_best_fit_decreasing_piece_by_piece():
    r = random.Random(1)
    for _ in range(300):
        capacity = r.choice([5, 10, 30, 100])
        items = [r.randint(1, capacity) for _ in range(r.randint(0, 60))]
        got = best_fit_decreasing(Counter(items), capacity)
        assert sorted(capacity - sum(p) for p, times in got for _ in range(times)) == naive(items, capacity)
        assert Counter(x for p, times in got for _ in range(times) for x in p) == Counter(items)


def test_not_worse_than_best_fit_with_many_patterns():
    r = random.Random(4)
    items = [r.randint(200, 500) for _ in range(600)]
    got = complete(Counter(items), 1000, tries=5)
    assert len(got) > 64 and sum(times for _, times in got) <= len(naive(items, 1000))
    assert Counter(x for p, times in got for _ in range(times) for x in p) == Counter(items) and all(sum(p) <= 1000 for p, _ in got)
