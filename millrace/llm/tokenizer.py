"""Byte-level BPE over a public vocabulary: priority queue of merge ranks on a linked symbol list."""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from itertools import chain

import regex

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of ASCII alone, where the standard library's engine is faster.
ASCII_PATTERN = PATTERN.replace(r"\s\p{L}\p{N}", r"\sA-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Vocabulary lines ``base64 rank`` as a map from byte string to rank, which is also its id."""
    ranks = {}
    for line in raw.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token.

    Symbols form a doubly linked list; a heap holds (rank, left position, joined bytes). An entry is stale, and
    skipped, when its left symbol is gone or no longer joins with its right neighbour to the bytes it was made for.
    """
    whole = ranks.get(word)
    if whole is not None:
        return (whole,)
    n = len(word)
    symbol = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, j) for i in range(n - 1) if (r := ranks.get(j := word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, joined = heapq.heappop(heap)
        right = after[left]
        if not symbol[left] or right >= n or symbol[left] + symbol[right] != joined:
            continue
        symbol[left], symbol[right] = joined, b""
        follow = after[left] = after[right]
        if follow < n:
            before[follow] = left
            if (r := ranks.get(j := joined + symbol[follow])) is not None:
                heapq.heappush(heap, (r, left, j))
        if (lead := before[left]) >= 0 and (r := ranks.get(j := symbol[lead] + joined)) is not None:
            heapq.heappush(heap, (r, lead, j))
    return tuple(ranks[s] for s in symbol if s)


class Encoder(dict):
    """Map from pre-token to ids, filled on first sight; a memo of at most ``limit`` entries, results don't depend on it."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 400_000):
        super().__init__()
        self.ranks, self.limit = ranks, limit
        self._any, self._ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = merge(token.encode("utf-8"), self.ranks)
        if len(self) >= self.limit:
            self.clear()
        if len(token) <= 64:
            self[token] = ids
        return ids

    def split(self, text: str) -> list[str]:
        return self._ascii(text) if text.isascii() else self._any(text)

    def encode(self, text: str | None) -> array:
        """Ids of a whole text; null and empty texts have none."""
        return array("i", chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else array("i")

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.split(text)))) if text else 0
