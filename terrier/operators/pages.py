"""Pages of scans as relations: clean-up, regions and layout as grouped sums, windows and joins.

A page is a set of rectangles of ink (the key's columns, y0, y1, x0, x1, grey; ends exclusive): a run of one grey along a row of pixels, or
along a band of equal rows. What no rectangle covers is paper (255). ``sizes`` has width and height of every page. Pages are
bounded (``MOST_SIDE`` a side), so the rectangles of a page, a number each, meet in one row; no page meets another. What goes over
pixels is done by the helpers in ``raster``, a page at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrier.operators import raster
from terrier.operators.raster import PAPER

KEY = ("doc_id", "sheet")
#: Hue (0 to 180), least saturation and least value of stamp inks: red (two), purple, blue, green.
STAMP_INKS = ((0, 15, 50, 40), (165, 180, 50, 40), (130, 165, 40, 40), (90, 130, 40, 40), (35, 85, 40, 40))
CLOSING, LEAST_STAMP = 7, 300
BACKGROUND = 41
SKEW_STRIP, LEAST_BLOCK, LEAST_SKEW = (35, 3), 200, 0.2
LINE_SHARE, LINE_WIDTH_SHARE, LEAST_LINE_HEIGHT, LINE_PADDING = 0.05, 0.15, 15, 5
HEADER_SHARE = (0.15, 0.35)
GUTTER_SHARE, GUTTER_DEPTH, LEAST_GUTTER_LEFT, GUTTER_REACH, GUTTER_SIGMA = (0.35, 0.65), 0.65, 50, 15, 10
#: Where the parts of a rectangle stand in its number; sides are under 4,096.
BITS = (("y0", 44), ("y1", 32), ("x0", 20), ("x1", 8), ("grey", 0))
#: What each grey (second index) becomes before a background (first).
LIT = np.minimum(np.rint(np.arange(256) * float(PAPER) / np.maximum(np.arange(256), 1)[:, None]), 255).astype(np.int32)
#: Numbers that a task holds of finished pages before it hands them on.
HELD = 1 << 20


def rows_of(runs: DataFrame) -> DataFrame:
    """A rectangle for each row of pixels: y instead of y0 and y1."""
    return runs.select("*", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y")).drop("y0", "y1")


def paged(runs: DataFrame, sizes: DataFrame, work: Callable[[int, int, np.ndarray], list], columns: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, columns) of every page of ``sizes``: the rows that ``work`` (width, height, rectangles) makes of it, a list of arrays.

    ``rectangles`` is an array of five rows: y0, y1, x0, x1, grey. To travel, a rectangle is one number (``BITS``); ``runs`` may bring many as such in an array ``rects``,
    and if they have width and height beside it, each row is a whole page and ``sizes`` isn't asked.
    """
    if {"rects", "width", "height"} <= {*runs.columns}:
        known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
        return _worked(runs.select(*key, "width", "height", F.when(known, F.col("rects")).alias("_r")), work, columns, key)
    parts = F.flatten(F.collect_list("rects")) if "rects" in runs.columns else F.collect_list(reduce(lambda a, b: a + b, (F.shiftleft(F.col(c).cast("long"), n) for c, n in BITS)))
    return _worked(sizes.select(*key, "width", "height").join(runs.groupBy(*key).agg(parts.alias("_r")), [*key], "left"), work, columns, key)


def _worked(whole: DataFrame, work: Callable[[int, int, np.ndarray], list], columns: str, key: tuple[str, ...]) -> DataFrame:
    """What ``work`` makes of every row (key, width, height, rectangles as numbers)."""
    made = StructType.fromDDL(columns)
    types = [pa.list_(pa.int32()) if f.dataType.typeName() == "array" else pa.int64() if f.dataType.typeName() == "long" else pa.int32() for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = [batch.column(k) for k in key], batch.column(len(key) + 2)
            wide, high = (batch.column(len(key) + i).to_numpy() for i in (0, 1))
            n = lists.value_lengths().fill_null(0).to_numpy()
            numbers, ends = lists.flatten().to_numpy(), np.cumsum(n)
            done, at, held = [], [], 0
            for i in range(len(n)):
                r = numbers[ends[i] - n[i] : ends[i]]
                got = work(int(wide[i]), int(high[i]), np.stack([r >> 44, *(r >> s & 4095 for s in (32, 20, 8)), r & 255]))
                done.append([c if isinstance(c, pa.Array) else pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(got, types, strict=True)])
                at.append(np.full(len(done[-1][0]), i))
                held += sum(c.nbytes for c in done[-1]) // 4
                if held >= HELD or i + 1 == len(n):
                    rows = pa.array(np.concatenate(at))
                    yield pa.RecordBatch.from_arrays([*(k.take(rows) for k in keys), *map(pa.concat_arrays, zip(*done, strict=True))], [*key, *made.names])
                    done, at, held = [], [], 0

    return whole.mapInArrow(run, StructType([whole.schema[k] for k in key] + made.fields))


def _lines_of(page: np.ndarray) -> list:
    """A page as columns y, width and v, a row of it each."""
    h, w = page.shape
    return [np.arange(h), np.full(h, w), pa.ListArray.from_arrays(pa.array(np.arange(h + 1, dtype=np.int32) * w), pa.array(page.astype(np.int32).ravel()))]


def binarised(runs: DataFrame, sizes: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, y, threshold, x0, x1): the black runs of every page after smoothing, at the threshold of its own histogram."""

    def work(width, height, r):
        page = raster.blurred(raster.raster(width, height, r))
        t = raster.threshold(np.bincount(page.ravel(), minlength=256))
        y, x0, x1 = raster.runs_in(page <= t)
        return [y, np.full(len(y), t), x0, x1]

    return paged(runs, sizes, work, "y int, threshold int, x0 int, x1 int", key)


def illuminated(runs: DataFrame, sizes: DataFrame, reach: int = BACKGROUND // 2, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, y, width, v): the rows of pixels of every page divided by its background, the paper as a closing leaves it: the sliding maximum, then minimum, over a square.

    The square is cut at the page's edges. Windows of double the length are made of two, so a square of any size costs its logarithm.
    """

    def work(width, height, r):
        page = raster.raster(width, height, r)
        ground = raster.slid(raster.slid(page, np.maximum, reach, 1), np.maximum, reach, 0)
        ground = raster.slid(raster.slid(ground, np.minimum, reach, 0), np.minimum, reach, 1)
        return _lines_of(LIT[ground, page])

    return paged(runs, sizes, work, "y int, width int, v array<int>", key)


def contrasted(runs: DataFrame, sizes: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, y, width, v): the rows of pixels of every page with its contrast evened out locally.

    A page is cut into 8 by 8 tiles (mirrored to the right and below, on both sides if either size isn't a multiple of 8). Of each
    tile's histogram what exceeds the clip limit is dealt to all bins, the rest of the division to every so many; its running sum
    says what a grey becomes in the tile. A pixel is blended from the four tiles round it. Computed in doubles, rounded half to even.
    """
    return paged(runs, sizes, lambda width, height, r: _lines_of(raster.contrast(raster.raster(width, height, r))), "y int, width int, v array<int>", key)


def merged(runs: DataFrame, line: tuple[str, ...]) -> DataFrame:
    """Disjoint runs (line, x0, x1) that cover what ``runs`` do on each line; runs that touch are one. ``line`` names the columns that tell a line of pixels, or a band of equal ones."""
    along = Window.partitionBy(*line).orderBy("x0", "x1")
    fresh = F.coalesce((F.col("x0") > F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    dealt = runs.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return dealt.groupBy(*line, "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def dilated(runs: DataFrame, sizes: DataFrame, wide: int | Column, high: int, times: int = 1, key: tuple[str, ...] = KEY) -> DataFrame:
    """Disjoint runs (key, y, x0, x1) of rectangles widened by another, ``times`` over, and cut at the page's edges. An even width reaches one pixel further to the right.

    Rectangles of one band are merged before the band is taken apart into rows.
    """
    wide = wide if isinstance(wide, Column) else F.lit(wide)
    half, up, down = F.floor(wide / 2), (high - 1 - high // 2) * times, high // 2 * times
    r = runs.join(sizes, [*key])
    r = r.select(
        *key, F.greatest(F.col("x0") - (wide - 1 - half) * times, F.lit(0)).cast("int").alias("x0"), F.least(F.col("x1") + half * times, F.col("width")).cast("int").alias("x1"),
        F.greatest(F.col("y0") - up, F.lit(0)).alias("y0"), F.least(F.col("y1") + down, F.col("height")).alias("y1"),
    )
    return merged(rows_of(merged(r, (*key, "y0", "y1"))), (*key, "y"))


def eroded(rows: DataFrame, sizes: DataFrame, wide: int, high: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """Disjoint runs narrowed to the pixels round which a rectangle (odd sides), cut at the page's edges, is covered."""
    a, b = wide // 2, high // 2
    r = rows.join(sizes, [*key])
    r = r.withColumns({"x0": F.when(F.col("x0") > 0, F.col("x0") + a).otherwise(0), "x1": F.when(F.col("x1") < F.col("width"), F.col("x1") - a).otherwise(F.col("width"))}).filter("x0 < x1")
    r = r.select(*key, "height", "x0", "x1", F.explode(F.sequence(F.greatest(F.col("y") - b, F.lit(0)), F.least(F.col("y") + b, F.col("height") - 1))).alias("y"))
    steps = r.select(*key, "y", "height", F.inline(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))))
    steps = steps.groupBy(*key, "y", "height", "x").agg(F.sum("d").alias("d")).filter("d != 0")
    line = Window.partitionBy(*key, "y").orderBy("x")
    covered = steps.select(*key, "y", F.col("x").alias("x0"), F.lead("x").over(line).alias("x1"), F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("rows"), (F.least(F.col("y") + b, F.col("height") - 1) - F.greatest(F.col("y") - b, F.lit(0)) + 1).alias("need"))
    return covered.filter("rows = need").select(*key, "y", "x0", "x1")


def _labelled(rows: DataFrame, work: Callable, columns: str, key: tuple[str, ...]) -> DataFrame:
    """What ``work`` makes of the disjoint runs of each page, in order."""
    runs = rows.select(*key, F.col("y").alias("y0"), (F.col("y") + 1).alias("y1"), "x0", "x1", F.lit(0).alias("grey"))
    sizes = rows.groupBy(*key).agg(F.max("x1").alias("width"), (F.max("y") + 1).alias("height"))
    return paged(runs, sizes, lambda width, height, r: work(*r[[0, 2, 3]][:, np.lexsort((r[2], r[0]))]), columns, key)


REGION, ROW = "region long, x int, y int, width int, height int, pixels long", "region long, y int, a int, b int, n long"


def regions(rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, region, x, y, width, height, pixels) of the connected regions of disjoint runs that don't touch inside a row; runs that touch at a corner are connected, and a region is named by its first run's number."""
    return _labelled(rows, raster.boxes, REGION, key)


def stamped(runs: DataFrame, hue: str = "hue", saturation: str = "sat", value: str = "val") -> DataFrame:
    """The rectangles whose colour is that of a stamp's ink."""
    inks = [F.col(hue).between(lo, hi) & (F.col(saturation) >= s) & (F.col(value) >= v) for lo, hi, s, v in STAMP_INKS]
    return runs.filter(reduce(lambda a, b: a | b, inks))


def stamps(runs: DataFrame, sizes: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, stamps): for every page how many regions of stamp ink, joined over gaps of less than seven pixels, have over 300 pixels."""

    def work(width, height, r):
        mask = raster.covered(width, height, raster.widened(r, CLOSING, CLOSING))
        for axis in (0, 1):
            mask = raster.slid(mask.astype(np.uint8), np.minimum, CLOSING // 2, axis)
        return [np.array([(raster.boxes(*raster.runs_in(mask))[-1] > LEAST_STAMP).sum()])]

    return paged(stamped(runs), sizes, work, "stamps long", key)


def _dark(width: int, height: int, r: np.ndarray) -> np.ndarray:
    """The rectangles that are no lighter than their page's own threshold."""
    return r[:, r[4] <= raster.threshold(raster.areas(width, height, r))]


def text_lines(runs: DataFrame, sizes: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, line, x, y, width, height) of the lines of writing, from the top: of what is darker than the page's own threshold, the regions after widening by a strip of a twentieth of the page, twice, that are wide and high enough, with five pixels round them.

    Lines of the same top go from the left.
    """

    def work(width, height, r):
        mask, at = raster.strips(width, height, raster.widened(_dark(width, height, r), int(width * LINE_SHARE), 3, 2))
        _, x, top, w, deep, _ = raster.boxes(*raster.runs_in(mask))
        y, h = at[top], at[top + deep] - at[top]
        kept = np.flatnonzero((w > width * LINE_WIDTH_SHARE) & (h > LEAST_LINE_HEIGHT))
        kept = kept[np.lexsort((x[kept], y[kept]))]
        left, top = (np.maximum(c[kept] - LINE_PADDING, 0) for c in (x, y))
        return [np.arange(1, len(kept) + 1), left, top, np.minimum(width - left, w[kept] + 2 * LINE_PADDING), np.minimum(height - top, h[kept] + 2 * LINE_PADDING)]

    return paged(runs, sizes, work, "line int, x int, y int, width int, height int", key)


def hulls(rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, region, pixels, hull) of the connected regions of disjoint runs: the corners of the convex hull of their pixels' centres, once round."""
    return _hulls(_labelled(rows, raster.edges, ROW, key), key)


def _hulls(lines: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The hulls of regions from their rows (key, region, y, a, b, n)."""
    shape = lines.groupBy(*key, "region").agg(F.sum("n").alias("pixels"), F.array_sort(F.collect_list(F.struct("y", "a", "b"))).alias("rows"))
    return shape.select(*key, "region", "pixels", _hull(F.col("rows")).alias("hull"))


def _hull(rows: Column) -> Column:
    """The hull of a region from its rows (y, a, b) in order.

    The outermost pixels of each row are folded into a left and a right chain: a new point takes the place of those behind which the chain would turn outward.
    """

    def chain(side: str, sign: int) -> Column:
        points = F.transform(rows, lambda r: F.struct(r[side].cast("long").alias("x"), r["y"].cast("long").alias("y")))
        turn = lambda o, p, r: ((p["x"] - o["x"]) * (r["y"] - o["y"]) - (p["y"] - o["y"]) * (r["x"] - o["x"])) * sign
        start = F.slice(points, 1, 0)
        return F.reduce(points, start, lambda s, r: F.array_append(F.filter(s, lambda p, i: (i == 0) | (turn(F.get(s, i - 1), p, r) < 0)), r))

    return F.array_distinct(F.concat(chain("a", 1), F.reverse(chain("b", -1))))


def smallest_rectangles(shapes: DataFrame) -> DataFrame:
    """``shapes`` with the angle of the smallest rectangle round ``hull``: of its longer side, in degrees over 0 up to 180, clockwise from the right as rows go down.

    The smallest has a side along one of the hull's; of several it is that of the smallest angle. A single point has none.
    """
    n = F.size("hull")
    way = F.transform("hull", lambda p, i: F.struct((F.get("hull", F.pmod(i + 1, n))["x"] - p["x"]).alias("x"), (F.get("hull", F.pmod(i + 1, n))["y"] - p["y"]).alias("y")))
    # turned by right angles until it points right and down, not straight right
    turned = F.transform(F.filter(way, lambda d: (d["x"] != 0) | (d["y"] != 0)), lambda d: F.when((d["x"] >= 0) & (d["y"] > 0), d).when((d["y"] <= 0) & (d["x"] > 0), F.struct((-d["y"]).alias("x"), d["x"].alias("y"))).when((d["x"] <= 0) & (d["y"] < 0), F.struct((-d["x"]).alias("x"), (-d["y"]).alias("y"))).otherwise(F.struct(d["y"].alias("x"), (-d["x"]).alias("y"))))
    along = lambda d: F.transform("hull", lambda p: p["x"] * d["x"] + p["y"] * d["y"])
    over = lambda d: F.transform("hull", lambda p: p["y"] * d["x"] - p["x"] * d["y"])
    extent = lambda a: F.array_max(a) - F.array_min(a)
    boxes = F.transform(F.array_distinct(turned), lambda d: F.struct(extent(along(d)).alias("w"), extent(over(d)).alias("h"), d["x"].alias("dx"), d["y"].alias("dy")))
    ranked = F.transform(boxes, lambda b: F.struct((b["w"].cast("double") * b["h"] / (b["dx"] * b["dx"] + b["dy"] * b["dy"])).alias("area"), F.degrees(F.atan2(b["dy"].cast("double"), b["dx"].cast("double"))).alias("angle"), (b["w"] < b["h"]).alias("tall")))
    best = F.array_min(ranked)
    return shapes.withColumn("angle", best["angle"] + F.when(best["tall"], 90.0).otherwise(0.0))


def skew_angles(runs: DataFrame, sizes: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, angle): how far every page is turned, the median over its blocks of writing; 0 without any, and below a fifth of a degree.

    Blocks are regions of over 200 pixels of what is darker than the page's threshold, after widening by a strip, twice; of a block the
    longer side of its smallest rectangle counts. Angles over 45 degrees have 180 taken off, as the deeds' service does: 60 becomes
    -120, and only what it reads as under 45 is a turn that can be undone. Holes in a block aren't blocks.
    """

    def work(width, height, r):
        mask, at = raster.strips(width, height, raster.widened(_dark(width, height, r), *SKEW_STRIP, 2))
        region, y, a, b, n = raster.edges(*raster.runs_in(mask))
        high = at[y + 1] - at[y]
        first = np.flatnonzero(np.diff(region, prepend=-1))
        pixels = np.add.reduceat(n * high, first) if len(first) else first
        block, of = pixels > LEAST_BLOCK, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(region))))
        # the first and last row of a strip of equal rows stand for all
        twice = np.repeat(np.flatnonzero(block[of]), 1 + (high > 1)[block[of]])
        last = np.append(False, twice[1:] == twice[:-1])[: len(twice)]
        ends = np.append(0, np.cumsum(np.bincount(of[twice], minlength=len(first))[block])).astype(np.int32)
        if not len(ends[1:]):  # a page without blocks has a row too
            ends = np.zeros(2, np.int32)
        rows = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c.astype(np.int32))) for c in (np.where(last, at[y[twice] + 1] - 1, at[y[twice]]), a[twice], b[twice])]
        return [np.arange(len(ends) - 1), *rows]

    found = paged(runs, sizes, work, "region long, ys array<int>, a array<int>, b array<int>", key)
    blocks = found.select(*key, "region", _hull(F.arrays_zip(F.col("ys").alias("y"), "a", "b")).alias("hull"))
    turned = smallest_rectangles(blocks).withColumn("angle", F.when(F.col("angle") > 45, F.col("angle") - 180).otherwise(F.col("angle")))
    middle = F.median("angle")
    return turned.groupBy(*key).agg(F.when(F.abs(middle) >= LEAST_SKEW, middle).otherwise(0.0).alias("angle"))


def parted(runs: DataFrame, sizes: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, width, height, header_end, gutter) of every page: the row with least ink between 15 and 35 per cent of the height, the first of several, and below it the column with least ink, smoothed, in the middle part, if that is under 65 per cent of the part's mean; else -1."""
    raw = [2.718281828459045 ** (-0.5 * (k / GUTTER_SIGMA) ** 2) for k in range(-GUTTER_REACH, GUTTER_REACH + 1)]
    taps = [k / sum(raw) for k in raw]

    def work(width, height, r):
        y0, y1, x0, x1, grey = r
        down, along = np.zeros(height + 1, np.int64), np.zeros(width + 1, np.int64)
        for y, sign in ((y0, 1), (y1, -1)):
            np.add.at(down, y, (PAPER - grey) * (x1 - x0) * sign)
        a, b = (int(height * s) for s in HEADER_SHARE)
        top, gutter = a + int(np.cumsum(down)[a : max(b, a + 1)].argmin()), -1
        for x, sign in ((x0, 1), (x1, -1)):
            np.add.at(along, x, (PAPER - grey) * np.maximum(y1 - np.maximum(y0, top), 0) * sign)
        a, b = (int(width * s) for s in GUTTER_SHARE)
        if b - a >= LEAST_GUTTER_LEFT:
            p, smooth = np.pad(np.cumsum(along)[a:b].astype(float), GUTTER_REACH, mode="reflect"), 0.0
            for k, tap in enumerate(taps):
                smooth = smooth + p[k : k + b - a] * tap
            at = int(smooth.argmin())
            gutter = a + at if smooth[at] < GUTTER_DEPTH * (np.cumsum(smooth)[-1] / (b - a)) else -1
        return [np.array([v]) for v in (width, height, top, gutter)]

    return paged(runs, sizes, work, "width int, height int, header_end int, gutter int", key)


def layout(runs: DataFrame, sizes: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, region_type, ord, x, y, width, height): the header of every page, then its column or its two, as ``images.regions`` has them."""
    p = parted(runs, sizes, key)
    i = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("int")
    box = lambda kind, o, x, y, w, h: F.struct(F.lit(kind).alias("region_type"), F.lit(o).alias("ord"), i(x).alias("x"), i(y).alias("y"), i(w).alias("width"), i(h).alias("height"))
    w, h, top, cut = F.col("width"), F.col("height"), F.col("header_end"), F.col("gutter")
    head = box("header", 0, 0, 0, w, top)
    one = F.array(head, box("column", 1, 0, top, w, h - top))
    two = F.array(head, box("column", 1, 0, top, cut, h - top), box("column", 2, cut, top, w - cut, h - top))
    return p.select(*key, F.inline(F.when(cut < 0, one).otherwise(two)))
