"""Parameters of a dictionary."""

from __future__ import annotations

from dataclasses import asdict, dataclass

MIN_K, MAX_K, MAX_M = 3, 63, 31
#: Bucket sizes up to this are light, above it heavy.
LIGHT_LIMIT = 64


def is_valid_k(k: int) -> bool:
    """Odd k from 3 to 63: an odd k-mer never equals its own reverse complement."""
    return MIN_K <= k <= MAX_K and k % 2 == 1


@dataclass(frozen=True)
class BuildConfig:
    """k-mer length, minimizer length, strand mode, hash seed, and what to do with letters other than ACGT."""

    k: int = 31
    m: int = 19
    canonical: bool = False
    seed: int = 1
    on_invalid: str = "error"

    def __post_init__(self) -> None:
        if not is_valid_k(self.k):
            raise ValueError(f"k must be odd and between {MIN_K} and {MAX_K}, not {self.k}")
        if not 1 <= self.m <= MAX_M or self.m >= self.k:
            raise ValueError(f"m must be between 1 and {MAX_M} and below k, not {self.m}")
        if self.on_invalid not in ("error", "split"):
            raise ValueError("on_invalid must be 'error' or 'split'")

    def asdict(self) -> dict:
        return asdict(self)
