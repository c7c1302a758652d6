"""Words of many texts at once as numpy arrays: offsets and 64-bit polynomial hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U = np.uint64
STEP = 0x9E3779B97F4A7C15
P = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
P_BACK = pow(P, -1, 1 << 64)
#: Most bytes of text hashed in one go; a single longer text goes alone.
CHUNK = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; wraps modulo 2**64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix((np.arange(256, dtype=U) + U(1)) * U(STEP))
BYTE[65:91] = BYTE[97:123]  # A-Z count as a-z
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.cumprod(out, dtype=U)


@dataclass
class Words:
    """All words of a chunk: byte offsets in ``buf``, hash, and index of the text of each."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first_byte: np.ndarray  # of each text


class Hasher:
    """Keeps the power tables between chunks."""

    def __init__(self) -> None:
        self.up = self.down = powers(P, 1)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = powers(P, n), powers(P_BACK, n)

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of ``values[start:end]`` for every pair, independent of where it stands."""
        self.grow(len(values) + 1)
        total = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.up[: len(values)], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start])

    def words(self, texts: list[bytes]) -> Words:
        joined = b"\n".join(texts)
        buf = np.frombuffer(joined, np.uint8)
        first = np.zeros(len(texts), np.int64)
        np.cumsum([len(t) + 1 for t in texts[:-1]], out=first[1:])
        solid = np.zeros(len(buf) + 2, np.int8)
        solid[1:-1] = ~SPACE[buf]
        step = np.diff(solid)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return Words(buf, start, end, self.spans(BYTE[buf], start, end), np.searchsorted(first, start, "right") - 1, first)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) of consecutive texts of about ``CHUNK`` bytes; a null is empty."""
    held, size, at = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > CHUNK:
            yield at, held
            held, size, at = [], 0, i
        held.append(b)
        size += len(b)
    if held:
        yield at, held
