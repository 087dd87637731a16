"""Content-defined overlapping windows of a text: where they are cut, and what each may release.

Cuts and release points depend on the text and the sizes only, never on findings or on how the text arrived
in chunks, so a batch over whole texts and a stream of chunks see the same windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from . import values as V
from .shadow import shadow

_CUT = re.compile(rb"\n|[.!?;](?=[ \t\n\f\r])")
#: Unicode's White_Space property (str.isspace also takes the separators U+001C to U+001F).
_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")


def _is_space(c: str) -> bool:
    return c.isspace() and c not in _SEPARATORS


@dataclass(frozen=True)
class Sizes:
    """Window sizes in bytes."""

    first_min: int = 100
    min: int = 240
    max: int = 800
    overlap: int = V.MAX_CONTEXT

    def __post_init__(self):
        if self.overlap < V.MAX_CONTEXT:
            raise ValueError(f"segment overlap must be at least {V.MAX_CONTEXT}")
        if self.first_min <= self.overlap:
            raise ValueError("segment first_min must be larger than overlap")
        if not self.first_min <= self.min <= self.max:
            raise ValueError("segment sizes must satisfy first_min <= min <= max")


def _is_boundary(raw: bytes, i: int) -> bool:
    return i >= len(raw) or raw[i] & 0xC0 != 0x80


@dataclass
class Window:
    """Bytes [start, cut) of the stream; [start, start + release) goes out if nothing blocks."""

    start: int
    cut: int
    release: int
    last: bool
    text: str
    first: list[int] | None
    end: list[int] | None
    original: bytes = b""

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Bytes of the stream for shadow characters [a, b)."""
        if self.first is None:
            before = len(self.text[:a].encode("utf-8", "surrogatepass"))
            return self.start + before, self.start + before + len(self.text[a:b].encode("utf-8", "surrogatepass"))
        return self.start + self.first[a], self.start + self.end[b - 1]


class Cutter:
    """Takes text piece by piece and gives windows as soon as they are certain."""

    def __init__(self, sizes: Sizes):
        self.sizes, self.buffer, self.base, self.checked, self.first = sizes, b"", 0, 0, True

    def _next_cut(self) -> int | None:
        s, n = self.sizes, len(self.buffer)
        least = s.first_min if self.first else s.min
        if n < least:
            return None
        limit = max(s.max, self.checked + 1)
        m = _CUT.search(self.buffer, max(least - 1, self.checked), min(n, limit + 1))
        if m and m.start() < min(n, limit):
            return m.end()
        if n < limit:
            return None
        while not _is_boundary(self.buffer, limit):
            limit += 1
        return limit if limit <= n else None

    def _release_point(self, raw: bytes, text: str, first: list[int] | None) -> int:
        overlap = self.sizes.overlap
        if first is None:
            if len(raw) <= overlap:
                return 0
            point = len(raw) - overlap
            while not _is_boundary(raw, point):
                point -= 1
        else:
            coded = text.encode("utf-8", "surrogatepass")
            if len(coded) <= overlap:
                return 0
            tail = len(coded) - overlap
            while not _is_boundary(coded, tail):
                tail -= 1
            point = first[len(coded[:tail].decode("utf-8", "surrogatepass"))]
        low = max(0, point - 32)
        while not _is_boundary(raw, low):
            low -= 1
        near, at = raw[low:point].decode("utf-8", "surrogatepass"), point
        for c in reversed(near):
            at -= len(c.encode("utf-8", "surrogatepass"))
            if _is_space(c):
                return at
        return point

    def _window(self, cut: int, last: bool) -> Window:
        raw = self.buffer[:cut]
        text, first, end = shadow(raw.decode("utf-8", "surrogatepass"))
        release = cut if last else self._release_point(raw, text, first)
        out = Window(self.base, self.base + cut, release, last, text, first, end, raw)
        self.buffer, self.base = self.buffer[release:], self.base + release
        self.checked, self.first = cut - release, False
        return out

    def push(self, raw: bytes) -> Iterator[Window]:
        self.buffer += raw
        while (cut := self._next_cut()) is not None:
            yield self._window(cut, False)

    def finish(self) -> Iterator[Window]:
        if self.buffer:
            yield self._window(len(self.buffer), True)


def windows(text: str, sizes: Sizes) -> list[Window]:
    cutter = Cutter(sizes)
    return [*cutter.push(text.encode("utf-8", "surrogatepass")), *cutter.finish()]
