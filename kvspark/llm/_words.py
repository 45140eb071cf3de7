"""Hashes of words and of runs of words, for many texts at once with numpy.

A word is a maximal run of bytes that are no ASCII white space (0x20, 0x09-0x0D).
Hashes are polynomials over the ring of 64-bit integers, taken as differences of
prefix sums, of randomly tabulated bytes, and mixed at the end; they do not
depend on the process, so that all executors agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F)
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (two rounds of shift, xor and odd factors)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
        x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
        return x ^ (x >> U64(33))


class Hasher:
    def __init__(self) -> None:
        self.bytes = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))
        self.powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def power(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of an odd base and of its inverse, from exponent 0."""
        held = self.powers.get(base)
        if held is None or len(held[0]) < n:
            size = max(n, CHUNK // 4)
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                row = np.full(size, b, dtype=U64)
                row[0] = 1
                both.append(np.multiply.accumulate(row))
            if size > 2 * CHUNK:  # one huge text: not kept
                return both[0], both[1]
            self.powers[base] = held = (both[0], both[1])
        return held

    def runs(self, values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
        """Hash of values[start:stop] for each pair."""
        up, down = self.power(base, len(values) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(values) + 1, dtype=U64)
            np.cumsum(values * up[: len(values)], out=sums[1:])
            return mix((sums[stops] - sums[starts]) * down[starts])

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of words of each text)."""
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        starts, stops = edge[0::2], edge[1::2]  # the last byte is white space
        if len(stops) < len(starts):
            starts = starts[: len(stops)]
        bounds = np.cumsum([len(t) + 1 for t in texts])
        counts = np.diff(np.searchsorted(starts, np.concatenate([[0], bounds])))
        return self.runs(self.bytes[raw], starts, stops, BASES[0]), counts

    def windows(self, words: np.ndarray, size: int, base: int = BASES[1]) -> np.ndarray:
        """Hash of each run of ``size`` words; runs may cross the ends of texts."""
        at = np.arange(max(0, len(words) - size + 1))
        return self.runs(words, at, at + size, base)


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def positions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words in order: place within the text, and words that follow in it (itself included)."""
    total = int(counts.sum())
    first = np.repeat(np.cumsum(counts) - counts, counts)
    place = np.arange(total) - first
    return place, np.repeat(counts, counts) - place
