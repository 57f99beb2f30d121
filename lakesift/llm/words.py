"""Whole batches of texts as numpy arrays of word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ODD = 0x9E3779B97F4A7C15  # odd: has an inverse modulo 2**64
INVERSE = pow(ODD, -1, 1 << 64)
MASK = (1 << 64) - 1
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``ODD**i`` and ``ODD**-i`` for i < n at least; grown by doubling and kept per process."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for base in (ODD, INVERSE):
            p, k, b = np.ones(size, np.uint64), 1, base
            while k < size:
                p[k : 2 * k] = p[:k] * np.uint64(b)
                k, b = 2 * k, b * b & MASK
            both.append(p)
        _powers[0] = have = (both[0], both[1])
    return have


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about ``most`` bytes of ``column``, a row at least: bounds what numpy holds at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes, dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b


class Texts:
    """Words of a batch: ``hash`` of each, ``start``/``end`` byte offsets in ``data``, ``first`` word of each text (one more at the end)."""

    def __init__(self, texts: list[str | None], lower: bool = False) -> None:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(raw) + b"\n"
        data = np.frombuffer(self.data, np.uint8)
        blank = BLANK[data]
        before = np.empty_like(blank)
        before[0], before[1:] = True, blank[:-1]
        self.start = np.flatnonzero(before & ~blank)
        self.end = np.flatnonzero(blank & ~before)
        if lower:
            data = LOWER[data]
        self.bytes = data
        there, self._back = powers(len(data) + 1)
        self._total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * there[: len(data)], out=self._total[1:])
        self.hash = self.hash_of(self.start, self.end)
        bounds = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=bounds[1:])
        self.first = np.searchsorted(self.start, bounds)
        self.bounds = bounds

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from ``start`` to ``end``, each."""
        h = (self._total[end] - self._total[start]) * self._back[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def shingles(self, k: int) -> np.ndarray:
        """At each word the hash of the ``k`` words from there (garbage where they pass the text's end)."""
        h = self.hash
        out = np.zeros(len(h), np.uint64)
        for i in range(k):
            out[: len(h) - i] += mix(h[i:], i + 1)
        return mix(out)
