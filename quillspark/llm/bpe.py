"""Byte-pair encoding with a hierarchical-bitmap rank queue.

A pre-token of n bytes is a doubly linked list of nodes. Every pair of
neighbours whose joined bytes are in the vocabulary waits in the bucket of
its merge rank. A bitmap of three levels over the ranks tells the lowest
bucket in use by three find-first-set steps, so a merge costs the same for
a pre-token of ten bytes and for one of a million. Entries are never
removed when a merge makes them wrong: they are skipped when they come up.
"""

from __future__ import annotations

import base64
from heapq import heappop, heappush

_BITS = 6
_LOW = (1 << _BITS) - 1


class RankQueue:
    """Positions by merge rank; ``pop`` gives the leftmost of the lowest rank."""

    __slots__ = ("_buckets", "_leaf", "_mid", "_top")

    def __init__(self) -> None:
        self._top = 0
        self._mid: dict[int, int] = {}
        self._leaf: dict[int, int] = {}
        self._buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self._buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self._buckets[rank] = [position]
        word = rank >> _BITS
        block = word >> _BITS
        self._leaf[word] = self._leaf.get(word, 0) | 1 << (rank & _LOW)
        self._mid[block] = self._mid.get(block, 0) | 1 << (word & _LOW)
        self._top |= 1 << block

    def pop(self) -> tuple[int, int] | None:
        top = self._top
        if not top:
            return None
        block = (top & -top).bit_length() - 1
        mid = self._mid[block]
        word = block << _BITS | (mid & -mid).bit_length() - 1
        leaf = self._leaf[word]
        rank = word << _BITS | (leaf & -leaf).bit_length() - 1
        bucket = self._buckets[rank]
        position = heappop(bucket)
        if not bucket:
            leaf &= leaf - 1
            self._leaf[word] = leaf
            if not leaf:
                mid &= mid - 1
                self._mid[block] = mid
                if not mid:
                    self._top = top & (top - 1)
        return rank, position


class Vocabulary:
    """Byte strings and their ranks, which are also their token ids."""

    def __init__(self, lines: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.longest = max(map(len, self.ranks))

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token; an empty list for no bytes."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        waiting = [-1] * n
        queue = RankQueue()

        def offer(i: int) -> None:
            j = after[i]
            rank = ranks.get(piece[i : after[j]]) if j < n and after[j] - i <= self.longest else None
            if rank is None:
                waiting[i] = -1
            else:
                waiting[i] = rank
                queue.push(rank, i)

        for i in range(n - 1):
            offer(i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if waiting[i] != rank:
                continue
            gone = after[i]
            waiting[gone] = -1
            after[i] = follower = after[gone]
            if follower < n:
                before[follower] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids
