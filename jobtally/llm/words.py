"""Words of many texts at once, as byte spans with 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 3  # odd, and 3 modulo 4
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** k`` modulo 2**64 for ``k < n``; kept, and grown when a longer text comes."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = -(-max(n, 1) // (1 << 20)) << 20
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 23:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`window_hash` takes the hash of any run of ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def window_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """``data[starts[k]:ends[k]]`` is word ``k``; ``bounds[i]:bounds[i + 1]`` are the words of text ``i``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        return window_hash(rolling(_BYTE[self.data]), self.starts, self.ends)

    def text(self, first: int, stop: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[first:stop].tolist(), self.ends[first:stop].tolist())]

    def of_text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def split(texts: pa.Array, separators: np.ndarray, lower: bool = False) -> Words:
    """Words are the longest runs of bytes that are no ``separators`` (256 flags, line feed among them).

    Separators are ASCII, so no character is cut. Null texts have no words.
    ``lower`` turns A-Z, and nothing else, into a-z.
    """
    texts = pc.fill_null(texts, "").cast(pa.binary())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), b"\n")[0].as_buffer()
    data = np.frombuffer(joined, np.uint8)
    if lower:
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        data = table[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], separators[data], [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    firsts = np.cumsum(sizes + 1) - (sizes + 1)
    return Words(data, starts, ends, np.append(np.searchsorted(starts, firsts), len(starts)))


def flags(ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


WHITE_SPACE = flags([(0x20, 0x20), (0x09, 0x0D)])
NOT_ALPHANUMERIC = flags([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
