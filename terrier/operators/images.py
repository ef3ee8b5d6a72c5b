"""Page images as arrays: the kernels that need no image library, and where loaders and recognisers are plugged in.

An image is a row (height, width, content) with one grey byte a pixel, row by row. Decoding files, contrast, noise,
skew, seals and recognition need libraries that aren't assumed; :func:`staged` runs any such function over small Arrow
batches and turns what fails into an error column, so one bad page never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MOST_SIDE = 2400
MARGIN_SHARE, DARK = 0.02, 80
HEADER_SHARE = (0.15, 0.35)
GUTTER_SHARE, GUTTER_DEPTH, LEAST_GUTTER_LEFT = (0.35, 0.65), 0.65, 50
ENTITY_CHUNK, LEAST_ENTITY = 500, 2


def shrunk(page: np.ndarray, most: int = MOST_SIDE) -> np.ndarray:
    """A page no side of which is longer than ``most``, each pixel the mean of those it stands for."""
    h, w = page.shape
    if max(h, w) <= most:
        return page
    scale = most / max(h, w)
    rows, cols = (np.arange(int(n * scale)) * n // int(n * scale) for n in (h, w))
    sums = np.add.reduceat(np.add.reduceat(page.astype(np.int64), rows, axis=0), cols, axis=1)
    sizes = np.diff(np.append(rows, h))[:, None] * np.diff(np.append(cols, w))
    return np.round(sums / sizes).astype(np.uint8)


def margins_whitened(page: np.ndarray) -> np.ndarray:
    """Each margin of 2 per cent made white where it is dark on the whole."""
    page, (h, w) = page.copy(), page.shape
    y, x = int(h * MARGIN_SHARE), int(w * MARGIN_SHARE)
    for part in (np.s_[:y], np.s_[h - y :], np.s_[:, :x], np.s_[:, w - x :]):
        if page[part].size and page[part].mean() < DARK:
            page[part] = 255
    return page


def header_end(page: np.ndarray) -> int:
    """The row with least ink between 15 and 35 per cent of the height, where a stamped header ends."""
    ink = (255 - page.astype(np.int64)).sum(axis=1)
    a, b = (int(len(ink) * s) for s in HEADER_SHARE)
    return a + int(ink[a:b].argmin()) if b > a else a


def column_gutter(page: np.ndarray) -> int | None:
    """The column between two columns of text: the least ink, smoothed, in the middle part, if under 65 per cent of its mean and not at the edge."""
    ink = (255 - page.astype(np.float64)).sum(axis=0)
    a, b = (int(len(ink) * s) for s in GUTTER_SHARE)
    if b - a < LEAST_GUTTER_LEFT:
        return None
    kernel = np.exp(-0.5 * (np.arange(-15, 16) / 10) ** 2)
    smooth = np.convolve(np.pad(ink[a:b], 15, mode="reflect"), kernel / kernel.sum(), mode="valid")
    at = int(smooth.argmin())
    return a + at if smooth[at] < GUTTER_DEPTH * smooth.mean() else None


def regions(page: np.ndarray) -> list[tuple[str, list[int], int]]:
    """(type, [x, y, width, height], order) of a page: the header, then one column or two."""
    h, w = page.shape
    top = header_end(page)
    gutter = column_gutter(page[top:])
    columns = [(0, w)] if gutter is None else [(0, gutter), (gutter, w)]
    return [("header", [0, 0, w, top], 0), *[("column", [a, top, b - a, h - top], i) for i, (a, b) in enumerate(columns, 1)]]


def staged(images: DataFrame, work: Callable[[pd.Series], dict], schema: str) -> DataFrame:
    """The columns of ``schema`` and ``error`` for each row of ``images``: what ``work`` returns for it, or why it failed.

    ``work`` may load a model on its first call; Spark keeps it for the worker's life. Pages are large: set
    spark.sql.execution.arrow.maxRecordsPerBatch to about 8 in a session that runs this.
    """
    names = StructType.fromDDL(schema).names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for _, row in frame.iterrows():
                try:
                    out.append({**work(row), "error": None})
                except Exception as e:  # a page's fault is that row's result
                    out.append({"error": f"{type(e).__name__}: {e}"} | {n: row.get(n) for n in names if n in frame.columns})
            yield pd.DataFrame([[o.get(n) for n in (*names, "error")] for o in out], columns=[*names, "error"], dtype=object)

    return images.mapInPandas(run, schema + ", error string")


def laid_out(images: DataFrame) -> DataFrame:
    """(id, regions, error) of rows (id, height, width, content)."""

    def work(row: pd.Series) -> dict:
        page = np.frombuffer(row["content"], np.uint8).reshape(row["height"], row["width"])
        page = margins_whitened(shrunk(page))
        return {"id": row["id"], "regions": [{"region_type": t, "bbox": b, "ord": o} for t, b, o in regions(page)]}

    return staged(images, work, "id long, regions array<struct<region_type:string,bbox:array<int>,ord:int>>")


#: The steps of a page's clean-up in their order, each with the name that is noted where it was applied.
STEPS = ("resize", "stamps", "illumination", "denoise", "contrast", "skew", "borders", "binarize")
#: How applied steps are called; a page is always loaded and brought to size.
STEP_NAMES = {"illumination": "illumination_normalization", "denoise": "bilateral_denoise", "contrast": "clahe_contrast_enhancement", "borders": "scanner_border_cleaning", "binarize": "otsu_binarization"}
LEAST_SKEW = 0.2


def cleaned(page: np.ndarray, plugged: dict[str, Callable], wanted: tuple[str, ...] = STEPS) -> tuple[np.ndarray, int, float, list[str]]:
    """(page, stamps, skew angle, names of the applied steps) after the steps of ``wanted``, in the order of ``STEPS``.

    ``plugged`` has the functions of steps that need an image library: page to page, but ``stamps`` gives a number, ``skew`` an
    angle and ``deskew`` (page, angle) a page. A step without its function is left out and not noted; size and borders need none.
    """
    stamps, angle, names = 0, 0.0, ["load_and_rasterize"]
    for step in (s for s in STEPS if s in wanted or s == "resize"):
        if step == "resize":
            page = shrunk(page)
            names.append("dimension_normalization")
        elif step == "borders":
            page = margins_whitened(page)
            names.append(STEP_NAMES[step])
        elif step == "stamps" and step in plugged:
            stamps = int(plugged[step](page))
            names += [f"detected_{stamps}_stamps"] * (stamps > 0)
        elif step == "skew" and step in plugged:
            angle = float(plugged[step](page))
            if abs(angle) >= LEAST_SKEW and "deskew" in plugged:
                page = plugged["deskew"](page, angle)
                names.append(f"deskew_{angle:.2f}deg")
        elif step in plugged:
            page = plugged[step](page)
            names.append(STEP_NAMES[step])
    return page, stamps, angle, names


def processed(images: DataFrame, plugged: dict[str, Callable] | None = None, wanted: tuple[str, ...] = STEPS) -> DataFrame:
    """(id, height, width, content, stamps, skew_angle, applied_steps, error) of rows (id, height, width, content): the cleaned pages as a
    column of bytes, to be written as a table beside the originals. A page that can't be read keeps its id and says why."""

    def work(row: pd.Series) -> dict:
        page = np.frombuffer(row["content"], np.uint8).reshape(row["height"], row["width"])
        page, stamps, angle, names = cleaned(page, plugged or {}, wanted)
        return {"id": row["id"], "height": page.shape[0], "width": page.shape[1], "content": np.ascontiguousarray(page).tobytes(), "stamps": stamps, "skew_angle": angle, "applied_steps": names}

    return staged(images, work, "id long, height int, width int, content binary, stamps int, skew_angle double, applied_steps array<string>")


def with_entities(docs: DataFrame, text: str, model: Callable[[], Callable[[str], list[dict]]], column: str = "entities") -> DataFrame:
    """``docs`` with the entities (text, label, confidence) that a model finds in chunks of 500 characters.

    ``model`` makes the function that finds {word, entity_group, score} in a chunk; it is called once in a worker. Pieces of words
    lose their mark, single characters are dropped, scores are rounded to 3 places. A model that can't be made or fails finds nothing.
    """

    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            entities = model()
        except Exception:
            entities = None
        for series in texts:
            yield series.map(lambda t: _entities(entities, t))

    udf = F.pandas_udf(find, "array<struct<text:string,label:string,confidence:double>>")
    return docs.withColumn(column, udf(F.col(text)))


def _entities(find: Callable[[str], list[dict]] | None, text: str | None) -> list[dict]:
    if find is None or not text:
        return []
    out = []
    for at in range(0, len(text), ENTITY_CHUNK):
        try:
            found = find(text[at : at + ENTITY_CHUNK])
        except Exception:
            return []
        for e in found:
            word = e["word"].replace("##", "").strip()
            if len(word) >= LEAST_ENTITY:
                out.append({"text": word, "label": e["entity_group"], "confidence": round(float(e["score"]), 3)})
    return out
