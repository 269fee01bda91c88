"""Words of many texts at once: NumPy over the UTF-8 bytes of an Arrow array."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SEED = 0x5EED


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Digits, lower-case ASCII letters and every byte of a non-ASCII character.
ALNUM = _byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but blanks (space and 0x09 to 0x0D).
NON_BLANK = ~_byte_set((0x20, 0x20), (0x09, 0x0D))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: Two families of hashes: of each, random numbers for bytes and a base.
_RANDOM = np.random.default_rng(_SEED).integers(1, 2**64, (2, 256), dtype=np.uint64)
#: 3 mod 8, so that differences of powers keep few factors of two.
_BASES = (0x9E3779B97F4A7C13, 0xD1342543DE82EF9B)
_INVERSES = tuple(pow(b, -1, 2**64) for b in _BASES)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, 1 << 21)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if size <= 1 << 21:
            _powers[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset at which each begins (one more at the end)."""
    texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(offsets) == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def prefix_hashes(data: np.ndarray, family: int = 0) -> np.ndarray:
    """Sums from which the hash of any byte range follows; one longer than ``data``."""
    return prefix_sums(_RANDOM[family][data], family)


def prefix_sums(symbols: np.ndarray, family: int = 0) -> np.ndarray:
    """The same for any symbols, given by 64-bit numbers."""
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * _power_table(_BASES[family], len(symbols)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hashes of the ranges; equal ranges have equal hashes."""
    inverse = _power_table(_INVERSES[family], len(sums))
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """``first[d]`` to ``first[d + 1]`` are the words of text ``d``; 0 is never a hash."""

    first: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> Words:
    """Maximal runs of ``members`` bytes within each text, of lower-cased ``data``."""
    inside = members[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    after[lasts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = range_hashes(prefix_hashes(data), starts, ends)
    hashes[hashes == 0] = 1
    return Words(np.searchsorted(starts, offsets), hashes, starts, ends)


_GRAM = np.random.default_rng(_SEED + 1).integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words, whatever texts they lie in."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        total += hashes[i : len(hashes) - n + 1 + i] * _GRAM[i]
    return mix(total)
