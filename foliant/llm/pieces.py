"""A worker's cache from text pieces to token ids, read out for many texts at once."""

from __future__ import annotations

import gc
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import cache
from itertools import chain

import numpy as np


@contextmanager
def no_collector() -> Iterator[None]:
    """Keeps the cycle collector from walking millions of strings; nothing here makes cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@cache
def unassigned() -> re.Pattern:
    """Finds characters that this Python's Unicode tables don't know. What they are then depends on the library's tables."""
    free = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    starts = [c for c, before in zip(free, [-2, *free], strict=False) if c != before + 1]
    ends = [c for c, after in zip(free, [*free[1:], -2], strict=True) if after != c + 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]")


def flattened(lists: Iterable[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists, and all their members."""
    found = list(lists)
    lens = np.fromiter(map(len, found), np.int64, len(found))
    return lens, np.fromiter(chain.from_iterable(found), np.uint32, int(lens.sum()))


class _Slots(dict):
    """Gives each new key the next number; known keys are found at the speed of a dict."""

    def __missing__(self, key: str) -> int:
        slot = self[key] = len(self)
        return slot


class PieceCache:
    """Ids of pieces, kept flat. ``encode`` gets distinct pieces and returns how many ids each has, and all their ids.

    Past ``max_pieces`` pieces the cache starts anew before the next call, so its memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], max_pieces: int = 500_000):
        self._encode, self._max = encode, max_pieces
        self._clear()

    def _clear(self) -> None:
        self._slots, self._known = _Slots(), 0
        self._at, self._len, self._ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self._used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _learn(self) -> None:
        new = list(self._slots)[self._known :] if self._known == 0 else _tail(self._slots, self._known)
        if not new:
            return
        lens, flat = self._encode(new)
        n, k = len(self._slots), self._known
        self._at, self._len, self._ids = self._room(self._at, n), self._room(self._len, n), self._room(self._ids, self._used + len(flat))
        self._len[k:n] = lens
        self._at[k:n] = self._used + np.cumsum(lens) - lens
        self._ids[self._used : self._used + len(flat)] = flat
        self._known, self._used = n, self._used + len(flat)

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (uint32), and where each text's ids begin and end."""
        if len(self._slots) > self._max:
            self._clear()
        slot_of = self._slots.__getitem__
        each = [np.fromiter(map(slot_of, x), np.int64, len(x)) for x in texts]
        self._learn()
        slots = np.concatenate(each) if each else np.zeros(0, np.int64)
        lens = self._len[slots]
        ends = np.cumsum(lens)
        ids = self._ids[np.repeat(self._at[slots] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        return ids, np.concatenate([[0], ends])[bounds]


def _tail(slots: dict, n: int) -> list[str]:
    """The keys that came after the first ``n``; dicts keep the order of insertion."""
    out = []
    for i, key in enumerate(reversed(slots)):
        if i >= len(slots) - n:
            break
        out.append(key)
    return out[::-1]


def in_parts(texts: list[str], max_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``max_chars`` characters, one text at least."""
    start = chars = 0
    for i, x in enumerate(texts):
        if i > start and chars + len(x) > max_chars:
            yield start, i
            start, chars = i, 0
        chars += len(x)
    if start < len(texts):
        yield start, len(texts)
