"""What is done to one page of pixels: small helpers on arrays that ``pages`` calls for each page of a Spark task."""

from __future__ import annotations

import numpy as np

PAPER = 255
TILES, CLIP = 8, 2.0
#: Rows of pixels that are blended at a time, so that a large page needs little memory.
STRIP = 256


def raster(width: int, height: int, r: np.ndarray) -> np.ndarray:
    """The greys (height, width) of a page of rectangles (rows of ``r``: y0, y1, x0, x1, grey) that don't overlap."""
    step, high = np.zeros((height, width + 1), np.int16), r[1] - r[0]
    of = np.repeat(np.arange(len(high)), high)
    y = r[0][of] + np.arange(len(of)) - np.repeat(np.cumsum(high) - high, high)
    step[y, r[2][of]] += (r[4][of] - PAPER).astype(np.int16)
    step[y, r[3][of]] -= (r[4][of] - PAPER).astype(np.int16)
    return (np.cumsum(step, axis=1, dtype=np.int16)[:, :width] + PAPER).astype(np.uint8)


def covered(width: int, height: int, r: np.ndarray) -> np.ndarray:
    """Which pixels any of the rectangles covers; they may overlap, and are cut at the page's edges."""
    step = np.zeros((height + 1) * (width + 1), np.int32)
    (y0, y1), (x0, x1) = np.clip(r[:2], 0, height) * (width + 1), np.clip(r[2:4], 0, width)
    for y, x, d in ((y0, x0, 1), (y0, x1, -1), (y1, x0, -1), (y1, x1, 1)):
        np.add.at(step, y + x, np.int32(d))
    step = step.reshape(height + 1, width + 1)
    return np.cumsum(np.cumsum(step, axis=0, dtype=np.int32, out=step), axis=1, dtype=np.int32, out=step)[:height, :width] > 0


def strips(width: int, height: int, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`covered` with a row for each strip of rows between which no rectangle begins or ends, and where the strips begin (one more entry: the end)."""
    y = np.clip(r[:2], 0, height)
    at = np.unique(np.append(y, (0, height)))
    return covered(width, len(at) - 1, np.concatenate([np.searchsorted(at, y), r[2:4]])), at


def widened(r: np.ndarray, wide: int, high: int, times: int = 1) -> np.ndarray:
    """Rectangles widened by another, ``times`` over. An even width reaches one pixel further to the right."""
    left, up = (wide - 1 - wide // 2) * times, (high - 1 - high // 2) * times
    return np.stack([r[0] - up, r[1] + high // 2 * times, r[2] - left, r[3] + wide // 2 * times])


def slid(page: np.ndarray, f: np.ufunc, reach: int, axis: int) -> np.ndarray:
    """``f`` (maximum or minimum) over the pixels up to ``reach`` away, cut at the edges; windows of double the length are made of two.

    It goes over rows, which lie one behind the other; columns are made rows for it.
    """
    if axis:
        return np.ascontiguousarray(slid(np.ascontiguousarray(page.T), f, reach, 0).T)
    h, w = page.shape
    padded, span = np.full((h + 2 * reach, w), 0 if f is np.maximum else 255, page.dtype), 1
    padded[reach : reach + h] = page
    while span < 2 * reach + 1:
        k = min(span, 2 * reach + 1 - span)
        padded, span = f(padded[:-k], padded[k:]), span + k
    return padded


def blurred(page: np.ndarray) -> np.ndarray:
    """A page after a 3 by 3 binomial filter, rounded half up; at an edge the pixel before it is that after it."""
    v = page.astype(np.int32)
    for axis in (1, 0):
        sides = [(0, 0), (0, 0)]
        sides[axis] = (1, 1)
        p = np.pad(v, sides, mode="reflect" if v.shape[axis] > 1 else "edge")
        v = p[:, :-2] + 2 * v + p[:, 2:] if axis else p[:-2] + 2 * v + p[2:]
    return (v + 8) >> 4


def threshold(n: np.ndarray) -> int:
    """The grey that parts a histogram (a number for each grey) with the largest variance between the two classes, the first of several."""
    grey = np.flatnonzero(n)
    n1, s1 = np.cumsum(n[grey]).astype(float), np.cumsum(n[grey] * grey).astype(float)
    d, rest = n1[-1] * s1 - n1 * s1[-1], n1 * (n1[-1] - n1)
    return int(grey[np.where(rest > 0, d * (d / np.where(rest > 0, rest, 1.0)), 0.0).argmax()])


def areas(width: int, height: int, r: np.ndarray) -> np.ndarray:
    """The histogram of a page from the areas of its rectangles; what they leave is paper."""
    n = np.zeros(256, np.int64)
    np.add.at(n, r[4], (r[3] - r[2]) * (r[1] - r[0]))
    n[PAPER] += width * height - n.sum()
    return np.maximum(n, 0)


def runs_in(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1) of the runs of true pixels, row by row."""
    edge = np.diff(mask.astype(np.int8), axis=1, prepend=0, append=0)
    y, x0 = np.nonzero(edge == 1)
    return y, x0, np.nonzero(edge == -1)[1]


def labelled(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """For each of the runs, in order and disjoint, the first one that it is connected with; runs that touch at a corner are.

    Runs that touch one of the row above are next to each other, so they are looked up. Labels then sink to the smallest neighbour's.
    """
    side = int(x1.max(initial=0)) + 2
    lo = np.searchsorted(y * side + x1, (y + 1) * side + x0)
    n = np.maximum(np.searchsorted(y * side + x0, (y + 1) * side + x1, side="right") - lo, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = lo[a] + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    label = np.arange(len(y))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    return label


def boxes(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> list[np.ndarray]:
    """x, y, width, height and pixels of the regions of such runs, after the index of each region's first run."""
    label = labelled(y, x0, x1)
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.diff(label[order], prepend=-1))
    if not len(first):
        return [label[:0]] * 6
    x, top = np.minimum.reduceat(x0[order], first), np.minimum.reduceat(y[order], first)
    right, low = np.maximum.reduceat(x1[order], first), np.maximum.reduceat(y[order], first)
    return [label[order][first], x, top, right - x, low + 1 - top, np.add.reduceat((x1 - x0)[order], first)]


def edges(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> list[np.ndarray]:
    """The rows of the regions: the index of the region's first run, y, the outermost pixels, and how many pixels."""
    label = labelled(y, x0, x1)
    order = np.lexsort((x0, y, label))
    label, y, x0, x1 = label[order], y[order], x0[order], x1[order]
    first = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0))
    if not len(first):
        return [label[:0]] * 5
    return [label[first], y[first], np.minimum.reduceat(x0, first), np.maximum.reduceat(x1, first) - 1, np.add.reduceat(x1 - x0, first)]


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """The places ``i`` in a row of ``n`` that goes to and fro, its ends not doubled."""
    m = i % max(2 * n - 2, 1)
    return np.where(m < n, m, 2 * n - 2 - m)


def contrast(page: np.ndarray) -> np.ndarray:
    """A page with its contrast evened out by 8 by 8 tiles, as ``pages.contrasted`` says."""
    h, w = page.shape
    even = w % TILES == 0 and h % TILES == 0
    th, tw = (h if even else h + TILES - h % TILES) // TILES, (w if even else w + TILES - w % TILES) // TILES
    ys, xs, grey = np.arange(th * TILES), np.arange(tw * TILES), np.arange(256)
    tile = (ys // th)[:, None] * TILES + xs // tw
    bins = np.bincount((tile * 256 + page[mirrored(ys, h)][:, mirrored(xs, w)]).ravel(), minlength=TILES * TILES * 256).reshape(-1, 256)
    limit = max(int(th * tw * (CLIP / 256)), 1)
    over = np.maximum(bins - limit, 0).sum(axis=1)[:, None]
    rest = over % 256
    dealt = over // 256 * (grey + 1) + np.where(rest > 0, np.minimum(rest, grey // np.maximum(256 // np.maximum(rest, 1), 1) + 1), 0)
    to = np.minimum(np.rint((np.cumsum(np.minimum(bins, limit), axis=1) + dealt) * 255 / (th * tw)), 255.0).reshape(TILES, TILES, 256)

    def between(i: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = i / n - 0.5
        low = np.floor(at)
        return at - low, np.maximum(low, 0).astype(int), np.minimum(low + 1, TILES - 1).astype(int)

    out, (fx, left, right) = np.empty((h, w), np.int32), between(np.arange(w), tw)
    for y in range(0, h, STRIP):
        v, (fy, up, low) = page[y : y + STRIP], (c[:, None] for c in between(np.arange(y, min(y + STRIP, h)), th))
        across = [to[side, left, v] * (1 - fx) + to[side, right, v] * fx for side in (up, low)]
        out[y : y + STRIP] = np.rint(across[0] * (1 - fy) + across[1] * fy)
    return out
