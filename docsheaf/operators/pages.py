"""Whole pages to text: straighten, split, prepare each chunk, recognise, merge.

All that a page's text hangs on lies in its own row, so a page goes through one Arrow pass and leaves
as one row: no raster returns to the JVM, and nothing is read twice, joined or dealt out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docsheaf import config
from docsheaf.operators import kernels
from docsheaf.operators.engines import ENGINES, Engine  # by name: the module would go to executors whole
from docsheaf.operators.merge import merged_text
from docsheaf.operators.steps import ORDER

#: rows read from a batch together; rows and characters of text that leave together
READ, ROWS, PART = 16, 1000, 1 << 20


def dpi(width: int, height: int) -> int:
    """As ``geometry.estimated_dpi``."""
    small, large = min(width, height), max(width, height)
    r = large / small if small else 1.0
    return min(max(int(small / (8.27 if 1.35 < r < 1.50 else 8.5 if 1.25 < r < 1.35 else 8.0)), 72), 600)


def prepare(x: np.ndarray, c: config.Preprocessing, deskew: bool = False) -> tuple[np.ndarray, list[str]]:
    """The raster after the steps that apply, and their names in order. Analysis values are those of
    the input; value range and two-valuedness are those of what the step sees (see ``steps``)."""
    if not c.enabled:
        return x, []
    channels = 1 if x.ndim == 2 else x.shape[2]
    g = kernels.to_gray(x)
    noise, contrast, inverted = kernels.noise_level(g), kernels.michelson(g), c.auto_invert and kernels.is_inverted(g)
    skew = kernels.skew_angle(g) if deskew and c.auto_deskew else 0.0
    resolution, applied = dpi(g.shape[1], g.shape[0]), []

    def when(name, applies, change):
        nonlocal x
        if applies:
            x = change(x)
            applied.append(name)

    when("grayscale", channels == 4 if c.preserve_color else channels != 1, lambda v: v[..., :3] if c.preserve_color else kernels.to_gray(v))
    when("invert", inverted, kernels.invert)
    when("noise_removal", noise > c.noise_threshold, lambda v: kernels.each_channel(v, lambda p: kernels.denoise(p, c.denoise_strength)))
    when("deskew", abs(skew) > c.skew_threshold, lambda v: kernels.each_channel(v, lambda p: kernels.rotate(p, skew)))
    flat = x.ndim == 2
    when("normalization", contrast < c.contrast_threshold or (flat and (int(x.max()) - int(x.min())) / 255 < 0.8), lambda v: kernels.each_channel(v, kernels.stretch))
    binarize = {"otsu": kernels.binarize_otsu, "adaptive": kernels.binarize_adaptive}.get(c.binarization_method)
    two = binarize is not None and x.ndim == 2 and len(np.unique(x)) <= 2
    when("binarization", binarize is not None and not two, lambda v: binarize(kernels.to_gray(v)))
    factor = min(c.target_dpi / resolution, c.max_scale_factor)
    when("scaling", c.max_scale_factor > 1.0 and resolution < c.target_dpi and c.target_dpi / resolution >= 1.1, lambda v: kernels.resize(v, int(v.shape[1] * factor), int(v.shape[0] * factor)))
    return x, applied


def straightened(x: np.ndarray, c: config.Preprocessing) -> tuple[np.ndarray, bool]:
    """The gray page, and whether it was turned: its skew reaches the threshold (``steps.rotates_page``)."""
    g = kernels.to_gray(x)
    skew = kernels.skew_angle(g) if c.auto_deskew else 0.0
    turned = c.auto_deskew and not abs(skew) < c.skew_threshold
    return (kernels.rotate(g, skew) if turned else g), turned


def gaps(ink: np.ndarray, threshold: float, least: int, taps: int = 5) -> list[int]:
    """The rising centres of ``profile.gaps`` of a page's rows."""
    size, top = len(ink), int(ink.max(initial=0))
    sums = np.convolve(ink.astype(np.int64), np.ones(taps, np.int64))[taps // 2 : taps // 2 + size]
    low = sums < threshold * taps * top if top else np.ones(size, bool)
    runs = np.flatnonzero(np.diff(low, prepend=False, append=False)).reshape(-1, 2).tolist()
    found = [(a + (b - a) // 2, b - a) for a, b in runs if b < size]
    return [at for at, width in found if width >= least and size < at * 10 < size * 9]


def grid(h: int, w: int, c: config.Splitting) -> tuple[int, int]:
    """(rows, cols) as ``geometry.grid_size``."""
    edge, mp = min(c.target_chunk_size, c.max_dimension), w * h / 1_000_000.0
    least = math.ceil(math.sqrt(math.ceil(mp / c.max_megapixels))) if mp > c.max_megapixels else 1
    rows, cols = max(math.ceil(h / edge), least, 1), max(math.ceil(w / edge), least, 1)
    if not c.prefer_horizontal_splits or cols == 1:
        return rows, cols
    return (rows * cols, 1) if rows * cols <= 4 else (math.ceil(rows * cols / 2), 2)


def splits(positions: list[int], h: int, k: int, least: int) -> list[int]:
    """As ``profile.by_min_size`` of ``profile.select_nearest``: k positions near the even spacing, of
    which those stay that leave ``least`` on either side."""
    picked = positions
    if len(positions) > k:
        left, picked = list(positions), []
        for i in range(1, k + 1):
            picked.append(min(left, key=lambda p: (abs(p - h * float(i) / float(k + 1)), p)))
            left.remove(picked[-1])
    out, edge = [], 0
    for p in sorted(picked):
        if p - edge >= least and h - p >= least:
            out.append(p)
            edge = p
    return out


def tiles(h: int, w: int, rows: int, cols: int, overlap: float) -> list[tuple]:
    """(row, col, x, y, w, h) as ``geometry.overlapping_tiles``, row-major."""
    base_h, base_w = h / rows, w / cols
    oy, ox = int(base_h * overlap), int(base_w * overlap)
    out = []
    for r in range(rows):
        y0, y1 = max(0, int(r * base_h) - (oy if r else 0)), min(h, int((r + 1) * base_h) + (oy if r < rows - 1 else 0))
        for q in range(cols):
            x0, x1 = max(0, int(q * base_w) - (ox if q else 0)), min(w, int((q + 1) * base_w) + (ox if q < cols - 1 else 0))
            out.append((r, q, x0, y0, x1 - x0, y1 - y0))
    return out


def cut(g: np.ndarray, c: config.Splitting) -> tuple[str, list[tuple]]:
    """(method, tiles): where a page is cut: along gaps of its rows if they leave chunks large enough,
    else by an overlapping grid; a page within the limits is one tile."""
    h, w = g.shape
    if not (c.enabled and (w * h / 1_000_000.0 > c.max_megapixels or max(w, h) > c.max_dimension)):
        return "none", [(0, 0, 0, 0, w, h)]
    rows, cols = grid(h, w, c)
    free = gaps(kernels.ink(g).sum(axis=1), 1 - c.gap_threshold, c.min_gap_pixels)
    found = splits(free, h, rows - 1, c.min_chunk_size)
    if found:
        return "projection", [(i, 0, 0, a, w, b - a) for i, (a, b) in enumerate(zip([0, *found], [*found, h]))]
    return "grid", tiles(h, w, rows, cols, c.overlap_percent)


def page_text(g: np.ndarray, places: list[tuple], c: config.Preprocessing, engine: Engine) -> tuple[str | None, str | None, set[str]]:
    """(merged, error, applied steps) of a page's chunks, as ``engines.process``: prepared and
    recognised one after the other; with a failed chunk there is no text, and the first error."""
    texts, errors, used = [], [], set()
    for i, (row, col, x, y, w, h) in enumerate(places):
        part, applied = prepare(g[y : y + h, x : x + w], c)
        used.update(applied)
        try:
            texts.append((row, -col if engine.right_to_left else col, i, col, engine.read(part.tobytes())[0]))
        except Exception as e:  # noqa: BLE001  an engine's failure belongs to its chunk
            errors.append(f"chunk {i}: {e}")
    if errors:
        return None, min(errors), used
    if engine.name == "got":
        return "\n\n".join(t for *_, t in texts), None, used
    return merged_text([(row, col, t) for row, _, _, col, t in sorted(texts)], engine.right_to_left), None, used


def process(rasters: DataFrame, engine: str, preprocessing: config.Preprocessing | None = None, splitting: config.Splitting | None = None) -> DataFrame:
    """(doc_id, method, n_chunks, applied, merged, error) of each page; ``applied`` is the union of the
    chunks' steps in pipeline order, after ``global_deskew`` if the page was turned. Settings are those
    given, else the engine's, else the global ones. Each page has its row, with a repeated or null id too."""
    prepare_by = preprocessing or config.ENGINE_PREPROCESSING.get(engine, config.GLOBAL_PREPROCESSING)
    split_by = splitting or config.ENGINE_SPLITTING.get(engine, config.GLOBAL_SPLITTING)
    ENGINES.create(engine)  # an unknown one is an error here
    text = [T.StructField(n, T.StringType()) for n in ("applied", "merged", "error")]
    schema = T.StructType([T.StructField("doc_id", rasters.schema["doc_id"].dataType), T.StructField("method", T.StringType()), T.StructField("n_chunks", T.LongType()), *text])
    arrow = to_arrow_schema(schema)

    def page(r, e):
        g, turned = straightened(kernels.decode(r["height"], r["width"], r["channels"], r["data"]), prepare_by)
        method, places = cut(g, split_by)
        merged, error, used = page_text(g, places, prepare_by, e)
        applied = ["global_deskew"] * turned + [s for s in ORDER if s in used]
        return {"doc_id": r["doc_id"], "method": method, "n_chunks": len(places), "applied": ",".join(applied), "merged": merged, "error": error}

    def run(batches):
        e, part, held = ENGINES.create(engine).ready(), [], 0
        for b in batches:
            for at in range(0, b.num_rows, READ):
                for r in b.slice(at, READ).to_pylist():
                    part.append(page(r, e))
                    held += len(part[-1]["merged"] or "")
                    if held >= PART or len(part) >= ROWS:
                        yield pa.RecordBatch.from_pylist(part, schema=arrow)
                        part, held = [], 0
        if part:
            yield pa.RecordBatch.from_pylist(part, schema=arrow)

    return rasters.select("doc_id", "height", "width", "channels", "data").mapInArrow(run, schema)
