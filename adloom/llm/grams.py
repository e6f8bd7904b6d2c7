"""Numpy helpers on raw bytes: words, rolling hashes and the anchors that mark equal windows.

All hashes are 64-bit polynomials evaluated with prefix sums modulo 2**64, then mixed, so one pass over a buffer gives
the hash of every word or of every fixed-length window without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# The white space of the word contracts, 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
MAX_RUN = 256
SLICE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class _Tables:
    """Powers of the base and of its inverse, grown on demand and kept per worker."""

    up = _powers(_BASE, 1 << 16)
    down = _powers(_INVERSE, 1 << 16)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.up.size:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word (the 64-bit finaliser of the SplitMix generator)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``, one longer than the input."""
    up, _ = _Tables.get(values.size + 1)
    out = np.zeros(values.size + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: values.size], out=out[1:])
    return out


def span_hashes(
    values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0, sums: np.ndarray | None = None
) -> np.ndarray:
    """Hash of ``values[start:end]`` for every pair; equal content has equal hashes wherever it stands.

    ``sums`` are the prefix sums of ``values`` where they are known already.
    """
    sums = prefix(values) if sums is None else sums
    _, down = _Tables.get(values.size + 1)
    length = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt)
    return mix((sums[ends] - sums[starts]) * down[starts] + length)


def window_hashes(values: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive values."""
    n = values.size - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix(values)
    _, down = _Tables.get(values.size + 1)
    return mix((sums[width:] - sums[:n]) * down[:n] + np.uint64(salt))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offset of every word of a byte buffer."""
    inside = np.zeros(data.size + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of every word of ``text``; long texts are worked through in slices that end at white space."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        data = np.frombuffer(text, np.uint8, end - at, at)
        starts, ends = word_bounds(data)
        out.append(span_hashes(data, starts, ends))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    done, n = 1, x.size - width + 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: n], x[rest : rest + n])


def runs(values: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of one sequence: (anchor, first window, number of windows), covering every window once.

    The anchor of a window is the least hash of its ``gram``-long pieces, so equal windows have equal anchors wherever
    they stand, and neighbouring windows mostly share theirs. A run is cut after MAX_RUN windows. A run in which the
    anchor stands twice, as in periodic text, may repeat within itself and is listed twice.
    """
    width = window - gram + 1
    total = values.size - window + 1
    for at in range(0, total, SLICE):
        part = values[at : min(at + SLICE, total) + window - 1]
        pieces = window_hashes(part, gram)
        least = sliding_min(pieces, width)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        length = np.diff(np.append(first, least.size))
        anchors = least[first]
        twice = _repeated(pieces, least, first, width)
        if length.max() > MAX_RUN:
            parts = -(-length // MAX_RUN)
            inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            anchors, whole = np.repeat(anchors, parts), np.repeat(length, parts)
            twice = np.repeat(twice, parts)
            first = np.repeat(first, parts) + inner * MAX_RUN
            length = np.minimum(whole - inner * MAX_RUN, MAX_RUN)
        if twice.any():
            anchors, first, length = (np.concatenate((x, x[twice])) for x in (anchors, first, length))
        yield anchors.view(np.int64), first + at, length


def _repeated(pieces: np.ndarray, least: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Which runs hold two pieces that equal their anchor."""
    edge = np.full(width - 1, np.iinfo(np.uint64).max)
    over = ~sliding_min(np.concatenate((edge, ~least, edge)), width)
    chosen = np.flatnonzero(pieces == over)
    again = np.flatnonzero(pieces[chosen[1:]] == pieces[chosen[:-1]])
    out = np.zeros(first.size, bool)
    for start in (chosen[again], chosen[again + 1] - width + 1):
        at = np.searchsorted(first, np.clip(start, 0, least.size - 1), side="right") - 1
        out[at] = True
    return out
