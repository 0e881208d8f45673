"""Vectorised work on the UTF-8 bytes of many texts at once: words, windows, hashes.

All functions take the bytes of a slice of texts (``buf``) and where each text starts (``offsets``, one more than
texts). Words are ``[^\\x20\\x09-\\x0D]+``; these separators are single bytes in UTF-8, so bytes suffice. Bytes are gone
through in pieces of ``PIECE``, so what is held beside the bytes of a very long text grows with its words only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes or items whose running sums are held at once; more than most slices have.
PIECE = 1 << 21

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_MASK = (1 << 64) - 1
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_VALUES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Upper-case A-Z have the values of a-z.
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """The first PIECE powers of an odd number and of its inverse, modulo 2**64."""
    if not _powers:
        for base in (_ODD, _INVERSE):
            full = np.full(PIECE, base, np.uint64)
            full[0] = 1
            _powers.append(np.cumprod(full, dtype=np.uint64))
    return _powers


def _steps(base: int, n: int) -> np.ndarray:
    """Powers of base ** PIECE for pieces 0 to n."""
    out, step = [1], pow(base, PIECE, 1 << 64)
    for _ in range(n):
        out.append(out[-1] * step & _MASK)
    return np.array(out, np.uint64)


def _unshift(at: np.ndarray) -> np.ndarray:
    """The power that takes a sum that begins at ``at`` back to place 0."""
    if not len(at):
        return np.zeros(0, np.uint64)
    if at.max() < PIECE:
        return powers()[1][at]
    return powers()[1][at % PIECE] * _steps(_INVERSE, int(at.max()) // PIECE)[at // PIECE]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits (splitmix64's last steps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets) of runs of whole texts of about ``most`` bytes."""
    buf, offsets = flat(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(member: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs, within each text, of bytes that ``member`` has; and the first run of each text."""
    n, starts, ends = len(buf), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n, PIECE):
        b = min(a + PIECE, n)
        wide = np.zeros(b - a + 2, bool)
        wide[1:-1] = member[buf[a:b]]
        wide[0] = a > 0 and member[buf[a - 1]]
        wide[-1] = b < n and member[buf[b]]
        inside = wide[1:-1]
        opens, closes = inside & ~wide[:-2], inside & ~wide[2:]
        at = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        opens[at] = inside[at]
        at = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "right")] - 1 - a
        closes[at] = inside[at]
        starts.append(np.flatnonzero(opens) + a)
        ends.append(np.flatnonzero(closes) + a + 1)
    begin = np.concatenate(starts)
    return begin, np.concatenate(ends), np.searchsorted(begin, offsets)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each text."""
    return spans(_WORD, buf, offsets)


def filled_lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of lines with a byte, and the first one of each text."""
    return spans(_LINE, buf, offsets)


def before(member: np.ndarray, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes that ``member`` has stand before each place; places ascend."""
    out, total = np.zeros(len(at), np.int64), 0
    for a in range(0, len(buf) + 1, PIECE):
        own = np.concatenate(([0], np.cumsum(member[buf[a : a + PIECE]])))
        i, j = np.searchsorted(at, (a, a + PIECE))
        out[i:j] = total + own[at[i:j] - a]
        total += int(own[-1])
    return out


def lettered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which spans hold a byte of a word; starts ascend, and so do ends."""
    if len(buf) < PIECE:
        count = np.concatenate(([0], np.cumsum(_WORD[buf], dtype=np.int32)))
        return count[ends] > count[starts]
    return before(_WORD, buf, ends) > before(_WORD, buf, starts)


def _sums(values: np.ndarray, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Running sums of the bytes' values times powers, before each place; places ascend."""
    out, total, step = np.zeros(len(at), np.uint64), np.zeros(1, np.uint64), _steps(_ODD, len(buf) // PIECE)
    for k, a in enumerate(range(0, len(buf) + 1, PIECE)):
        own = np.zeros(min(PIECE, len(buf) - a) + 1, np.uint64)
        np.cumsum(values[buf[a : a + PIECE]] * powers()[0][: len(own) - 1], out=own[1:])
        i, j = np.searchsorted(at, (a, a + PIECE))
        out[i:j] = total + step[k] * own[at[i:j] - a]
        total = total + step[k] * own[-1:]
    return out


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes, wherever it stands; starts ascend, and so do ends."""
    values = _FOLDED if folded else _VALUES
    if len(buf) < PIECE:
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(values[buf] * powers()[0][: len(buf)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * powers()[1][starts])
    return mix((_sums(values, buf, ends) - _sums(values, buf, starts)) * _unshift(starts))


def windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of k items start, and each text's first window. ``first``: each text's first item."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    begin = np.concatenate(([0], np.cumsum(counts)))
    return np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts), begin


class Rolling:
    """Hashes of windows of items (hashes) by one running sum, whatever the windows' lengths."""

    def __init__(self, items: np.ndarray) -> None:
        n = len(items)
        self.sums = np.zeros(n + 1, np.uint64)
        step = _steps(_ODD, n // PIECE)
        for k, a in enumerate(range(0, n, PIECE)):
            part = items[a : a + PIECE]
            np.cumsum(part * powers()[0][: len(part)] * step[k], out=self.sums[a + 1 : a + 1 + len(part)])
            self.sums[a + 1 : a + 1 + len(part)] += self.sums[a]

    def __call__(self, at: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[at + k] - self.sums[at]) * _unshift(at) + np.asarray(k, np.uint64))


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each text's items."""
    sums = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
    return sums[first[1:]] - sums[first[:-1]]
