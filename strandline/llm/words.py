"""Words of many texts at once: borders and 64-bit hashes by whole-array arithmetic modulo 2 ** 64."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that mixes all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n odd pseudo-random numbers."""
    with np.errstate(over="ignore"):
        return scramble(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def plain(text: str | None) -> bytes:
    """The text's bytes, A-Z lower-cased."""
    return (text or "").encode().lower()  # bytes.lower() changes A-Z alone


@dataclass
class Words:
    """Words of texts laid side by side; those of text i are borders[i] to borders[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    borders: np.ndarray


class WordHasher:
    """Splits texts at space and 0x09 to 0x0D and hashes the words."""

    def __init__(self) -> None:
        self.byte = constants(1, 256)
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.base = int(constants(4, 1)[0])
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        """Powers of the base and of its inverse, enough for n bytes."""
        inverse = pow(self.base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.full(n + 1, self.base, np.uint64)) * _U(inverse)
            self.down = np.cumprod(np.full(n + 1, inverse, np.uint64)) * _U(self.base)

    def split(self, texts: list[bytes]) -> Words:
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        if len(data) >= len(self.up):
            self._powers(len(data) * 2)
        word = ~self.space.take(data)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte.take(data) * self.up[: len(data)])])
            hashes = scramble((sums[ends] - sums[starts]) * self.down[starts])
        borders = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        return Words(data, starts, ends, hashes, borders)


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The stretches of data as one binary array."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])
