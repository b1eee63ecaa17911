"""Hashes of word shingles, and sketches of their sets, for many texts at the speed of array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PART = 1 << 20
#: Digits, small letters and all beyond ASCII stay; A-Z become small; all else is a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if 0 not in _powers:
        up, down = np.full(_PART * 2, _BASE, np.uint64), np.full(_PART * 2, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[0] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    line = b" ".join(words)
    up, down = _power_tables()
    if len(line) > len(up):
        n = len(words) - k + 1
        if n == 1:  # a shingle longer than a part
            return np.array([_long(line)], np.uint64)
        return np.concatenate([_hashes(words[: n // 2 + k - 1], k), _hashes(words[n // 2 :], k)])
    raw = np.frombuffer(line, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], gaps + 1])[: len(words) - k + 1], np.concatenate([gaps, [len(line)]])[k - 1 :]
    sums = np.zeros(len(line) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(line)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def _long(s: bytes) -> int:
    h, power = 0, 1
    for c in s:
        h, power = (h + (c + 1) * power) & (1 << 64) - 1, power * _BASE & (1 << 64) - 1
    return int(mixed(np.array([h], np.uint64))[0])


def shingle_hashes(text: str, k: int = 5) -> np.ndarray:
    """A 64-bit hash for each run of ``k`` words, in order; a text of fewer words, but not none, is one run."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    step = 100_000
    return np.concatenate([_hashes(words[i : i + step + k - 1], k) for i in range(0, len(words) - k + 1, step)])


def _multipliers(t: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20))
    return rng.integers(0, 1 << 64, t, np.uint64, False) | np.uint64(1), rng.integers(0, 1 << 64, t, np.uint64, False)


def sketch(hashes: np.ndarray, t: int) -> np.ndarray:
    """``t`` minima of 32 bits; two sets agree in one with a chance of their Jaccard similarity."""
    a, b = _multipliers(t)
    out = np.full(t, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), 2048):
        part = a[:, None] * hashes[None, i : i + 2048] + b[:, None]
        np.minimum(out, (part.min(axis=1) >> np.uint64(32)).astype(np.uint32), out=out)
    return out


def by_group(batches: Iterator[pa.RecordBatch], key: str, once: str | None = None) -> Iterator[pa.Table]:
    """The rows of each key (a column of longs) as a table; rows must come sorted by it. Holds one group at a time, and of rows that agree in
    ``once`` (a column of longs) one of each batch that isn't held yet."""
    held: list[pa.RecordBatch] = []
    seen: set[int] = set()
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held, seen = [], set()
            part = batch.slice(a, b - a)
            if once is not None:
                own = part.column(once).to_pylist()
                fresh = [i not in seen for i in own]
                if held and not all(fresh):
                    part = part.filter(pa.array(fresh, pa.bool_()))
                seen.update(own)
            held.append(part)
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def least_linked(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least id of its component."""
    tops = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        new = np.minimum(tops, np.where(linked, tops[None, :], big).min(axis=1))
        if (new == tops).all():
            return tops
        tops = new
