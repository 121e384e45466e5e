"""Best-fit packing planned over the length histogram; documents take the planned slots by their rank within length."""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame

from brookloom.llm.packing import pack


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns [(count, lengths)] that use every length of ``histogram`` as often as it occurs.

    Lengths are placed longest first, each into the fullest open sequence that has room for it, or a new one. Sequences
    that are alike are one pattern with a count, and a sequence takes as many of a length as it has room for, since it is
    then the fullest: the work is bounded by ``capacity``, not by the rows.
    """
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    rooms: list[int] = []  # ascending, of the open sequences

    def put(count: int, pattern: tuple[int, ...], left: int) -> None:
        if left not in open_:
            bisect.insort(rooms, left)
        open_[left].append((count, pattern))

    def take(at: int) -> tuple[int, tuple[int, ...], int]:
        left = rooms[at]
        count, pattern = open_[left].pop()
        if not open_[left]:
            del open_[left], rooms[at]
        return count, pattern, left

    for length in sorted(histogram, reverse=True):
        need = histogram[length]
        while need:
            at = bisect.bisect_left(rooms, length)
            # a new sequence is one of any count
            count, pattern, left = take(at) if at < len(rooms) else (need, (), capacity)
            each = left // length
            if full := min(count, need // each):
                put(full, pattern + (length,) * each, left - length * each)
                need -= full * each
            if (count := count - full) and need and need < each:
                put(1, pattern + (length,) * need, left - length * need)
                need, count = 0, count - 1
            if count and pattern:
                put(count, pattern, left)
    return [p for left in sorted(open_) for p in open_[left]]


def pack_best_fit(pieces: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset by ``best_fit``; nulls, repeats, clashes and empty tables as ``pack`` says."""
    return pack(pieces, capacity, order, length, plan=best_fit)
