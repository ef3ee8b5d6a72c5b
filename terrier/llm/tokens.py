"""Words ``[^\\x20\\x09-\\x0D]+`` of a run of texts as arrays: places, 64-bit polynomial hashes, texts of the words that are kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from terrier.llm.shared import flat

_P = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A number for each byte value, so that bytes that differ little don't hash alike.
_LETTER = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes or words that one table of powers spans; longer stretches are taken piece by piece.
PIECE = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers whose every bit depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to 0, 1, ... n - 1, modulo 2 to 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_UP, _DOWN = powers(_P, PIECE + 1), powers(pow(_P, -1, 1 << 64), PIECE + 1)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the words that lie between ``starts`` and ``ends``, which ascend."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        n = int(ends[to - 1]) - base
        if n <= PIECE:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_LETTER[data[base : base + n]] * _UP[:n], out=sums[1:])
            a, b = starts[at:to] - base, ends[at:to] - base
            out[at:to] = (sums[b] - sums[a]) * _DOWN[a]
        else:  # one word, longer than the table
            total, shift = 0, 1
            for i in range(0, n, PIECE):
                part = _LETTER[data[base + i : base + min(i + PIECE, n)]]
                total += int(np.sum(part * _UP[: len(part)])) * shift
                shift = shift * pow(_P, PIECE, 1 << 64) % (1 << 64)
            out[at] = total % (1 << 64)
        at = to
    return mixed(out)


class Tokens:
    """The words of a run of texts (null: none): starts, ends, the row of each, words from each to the end of its row, hashes."""

    def __init__(self, column: pa.LargeBinaryArray):
        self.data, self.offsets = data, offsets = flat(column)
        inside = np.zeros(len(data) + 1, bool)
        np.logical_not(_SPACE[data], out=inside[:-1])
        edge = inside.copy()
        edge[1:] ^= inside[:-1]
        cut = offsets[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        cut = cut[inside[cut] & inside[cut - 1]]  # a text ends and the next begins within word bytes
        marks = np.flatnonzero(edge)
        begins = inside[marks]
        self.starts, self.ends = np.sort(np.concatenate((marks[begins], cut))), np.sort(np.concatenate((marks[~begins], cut)))
        n = len(offsets) - 1
        self.first = np.searchsorted(self.starts, offsets[:-1])
        self.count = np.searchsorted(self.starts, offsets[1:]) - self.first
        self.row = np.repeat(np.arange(n), self.count)
        self.left = np.repeat(self.first + self.count, self.count) - np.arange(len(self.starts))
        self.hash = hashes(data, self.starts, self.ends)

    def kept(self, keep: np.ndarray) -> pa.StringArray:
        """For each row the words that are kept, joined by one space."""
        n = len(self.offsets) - 1
        starts, ends, row = self.starts[keep], self.ends[keep], self.row[keep]
        step = np.zeros(len(self.data) + 1, np.int8)
        step[starts] += 1
        step[ends] -= 1
        stay = np.cumsum(step[:-1], dtype=np.int8) > 0
        out = self.data.copy()
        between = ends[:-1][row[1:] == row[:-1]]  # a space follows in the row, as another word does
        out[between], stay[between] = 0x20, True
        size = np.bincount(row, ends - starts, n).astype(np.int64) + np.bincount(row[1:][row[1:] == row[:-1]], minlength=n)
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size))).astype(np.int32)
        return pa.StringArray.from_buffers(n, pa.py_buffer(at), pa.py_buffer(out[stay]))


def rolling(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2 to 64, of every window of ``width`` neighbours in ``x``."""
    n = max(0, len(x) - width + 1)
    out, piece = np.empty(n, np.uint64), max(PIECE, 4 * width)
    up, down = powers(base, min(len(x), piece + width)), powers(pow(base, -1, 1 << 64), min(n, piece))
    for at in range(0, n, piece):
        part = x[at : at + piece + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        m = len(part) - width + 1
        out[at : at + m] = (sums[width:] - sums[:m]) * down[:m]
    return out


class Stretches:
    """Hashes of any stretch of neighbours in ``x``, from prefix sums."""

    def __init__(self, x: np.ndarray, base: int = _P):
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * powers(base, len(x)), out=self.sums[1:])
        self.down = powers(pow(base, -1, 1 << 64), len(x) + 1)

    def of(self, at: np.ndarray, n) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.down[at]
