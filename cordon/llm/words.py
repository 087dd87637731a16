"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .line_dedup import U64, mix

#: Texts are hashed in slices of about so many bytes; a word's hash takes some fifty bytes for each of them.
SLICE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix(np.arange(256, dtype=np.uint64), 77) | U64(1)
_STEP = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, by doubling."""
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * U64(pow(base, len(out), 2**64))])
    return out[:n]


_POWERS: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS[:] = [_powers(_STEP, size), _powers(pow(_STEP, -1, 2**64), size)]
    return _POWERS[0], _POWERS[1]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of texts: hash, first byte and end in `raw`, and each text's range of words."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b" ".join([*texts, b""]) + b" ", np.uint8)
        space = _SPACE[self.raw]
        word = ~space
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        up, down = _tables(len(self.raw) + 1)
        with np.errstate(over="ignore"):
            sums = np.cumsum(_VALUE[self.raw] * up[: len(self.raw)], dtype=np.uint64)
            before = np.where(self.start > 0, sums[np.maximum(self.start, 1) - 1], U64(0))
            self.hash = mix((sums[self.end - 1] - before) * down[self.start] + (self.end - self.start).astype(np.uint64), 5)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, np.concatenate([[0], ends])[:-1])
        self.last = np.searchsorted(self.start, ends)
        self.texts = len(texts)


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes each; a longer text is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > SLICE:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def chained(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the pair (a, b), by element."""
    with np.errstate(over="ignore"):
        return mix(a * U64(0xC2B2AE3D27D4EB4F) + b, seed)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n elements in a row (len(h) - n + 1 of them), by doubling."""
    if len(h) < n:
        return h[:0]
    out, have, at, power, m = None, 0, 0, h, 1
    while m <= n:
        if n & m:
            part = power[at:] if out is not None else power
            if out is None:
                out, have = part, m
            else:
                k = min(len(out), len(part))
                out, have = chained(out[:k], part[:k], 100 + have), have + m
            at = have
        if m * 2 <= n:
            power = chained(power[:-m], power[m:], m)
        m *= 2
    return out[: len(h) - n + 1]
