"""Byte-pair merging with ranked merges: a text is cut into pieces, and in each piece the pair of neighbours with the
lowest rank is joined, the leftmost of equals, until no pair has a rank.

A piece of n bytes costs n log n: its parts are a linked list, candidates lie in a heap, and those whose parts
have been joined meanwhile are thrown away when they come up.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import regex

# Fixed value: how texts are cut before merging (contractions, words, numbers, signs with the blank before; blanks).
CUTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces that a worker remembers.
REMEMBERED = 1 << 16


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The vocabulary in the bytes of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Merges:
    """ranks: every byte and every token that a merge makes; special: strings that are one token each."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int] | None = None):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks bytes: {missing[:5]}")
        self.ranks, self.special = ranks, special or {}
        self.known: dict[str, list[int]] = {}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None

    def merged(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if end[i] < 0 or j >= n or end[j] != stop:
                continue  # one of the two has grown or gone
            end[i], end[j], after[i] = stop, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (rank := ranks.get(piece[i : end[after[j]]])) is not None:
                    heapq.heappush(heap, (rank, i, end[after[j]]))
            if before[i] >= 0 and (rank := ranks.get(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (rank, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in CUTS.findall(text):
            ids = self.known.get(piece)
            if ids is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                ids = self.known[piece] = self.merged(piece.encode())
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; none for null."""
        if not text:
            return []
        if not self.marks:
            return self._plain(text)
        out: list[int] = []
        for i, part in enumerate(self.marks.split(text)):
            out += [self.special[part]] if i % 2 else self._plain(part)
        return out


@lru_cache(4)
def loaded(data: bytes, special: tuple[tuple[str, int], ...] = ()) -> Merges:
    """Once in a worker for each vocabulary."""
    return Merges(read_ranks(data), dict(special))
