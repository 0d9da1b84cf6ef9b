"""Pixel kernels in numpy and one Arrow pass over rasters (doc_id, height, width, channels, data).

Border handling is reflect-101. Edge maps and rotations are approximations of the usual
libraries' (different smoothing and interpolation constants); the others are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docsheaf.config import GLOBAL_PREPROCESSING, Preprocessing
from docsheaf.operators import geometry, steps


def decode(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8)
    return x.reshape(height, width) if channels == 1 else x.reshape(height, width, channels)


def to_gray(x: np.ndarray) -> np.ndarray:
    if x.ndim == 2:
        return x
    return np.rint(x[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _padded(x: np.ndarray, r: int) -> np.ndarray:
    # reflect needs more rows than the radius; a thinner side repeats its edge
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        x = np.pad(x, pad, mode="reflect" if x.shape[axis] > r else "edge")
    return x


def laplacian_variance(g: np.ndarray) -> float:
    """By sums of integers, so that it does not hang on their order."""
    p = _padded(g.astype(np.int64), 1)
    x = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    n, total, squares = x.size, int(x.sum()), int((x * x).sum())
    return float(n * squares - total * total) / float(n * n)


def each_channel(x: np.ndarray, change) -> np.ndarray:
    return change(x) if x.ndim == 2 else np.stack([change(x[..., i]) for i in range(x.shape[2])], axis=-1)


def _box_sum(x: np.ndarray, r: int) -> np.ndarray:
    h, w = x.shape[0] - 2 * r, x.shape[1] - 2 * r
    x = sum(x[i : i + h] for i in range(2 * r + 1))
    return sum(x[:, i : i + w] for i in range(2 * r + 1))


def noise_level(g: np.ndarray, r: int = 2) -> float:
    """Median standard deviation of the boxes around each pixel, over 50; variances are exact integers."""
    x, n = _padded(g.astype(np.int64), r), (2 * r + 1) ** 2
    total, squares = _box_sum(x, r), _box_sum(x * x, r)
    v = (n * squares - total * total).ravel()
    mid = (v.size - 1) // 2, v.size // 2
    v.partition(mid)
    return float(min(1.0, (np.sqrt(v[mid[0]]) + np.sqrt(v[mid[1]])) / (2 * n) / 50))


def michelson(g: np.ndarray) -> float:
    lo, hi = int(g.min()), int(g.max())
    return (hi - lo) / (hi + lo) if hi + lo else 0.0


def brightness(g: np.ndarray) -> float:
    return float(g.mean() / 255)


def otsu_threshold(g: np.ndarray) -> int:
    n = np.bincount(g.ravel(), minlength=256).astype(np.float64)
    w0, m0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    d = m0 * w0[-1] - m0[-1] * w0
    den = w0 * (w0[-1] - w0)
    return int(np.argmax(np.where(den > 0, d * d / np.where(den > 0, den, 1), 0)))


def ink(g: np.ndarray) -> np.ndarray:
    """Inverse Otsu: true where the page is dark."""
    return g <= otsu_threshold(g)


def edges(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Sobel gradient, thinned along its axis, hysteresis by repeated growth."""
    p = _padded(g.astype(np.float64), 1)
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    mag = np.abs(gx) + np.abs(gy)
    m = np.pad(mag, 1)
    across = np.abs(gx) >= np.abs(gy)
    thin = np.where(across, (mag > m[1:-1, :-2]) & (mag >= m[1:-1, 2:]), (mag > m[:-2, 1:-1]) & (mag >= m[2:, 1:-1]))
    weak, out = thin & (mag > low), thin & (mag > high)
    while True:
        grown = dilate(out, 1) & weak
        if (grown == out).all():
            return out
        out = grown


def edge_density(g: np.ndarray) -> float:
    return float(edges(g).mean())


def has_text(g: np.ndarray) -> bool:
    return 0.01 < edge_density(g) < 0.3


def is_inverted(g: np.ndarray) -> bool:
    e = edges(g)
    on = float(g[e].mean()) if e.any() else 128.0
    off = float(g[~e].mean()) if (~e).any() else 128.0
    return on > off + 30


#: width -> ``longest_line``; a plain dict, since functions go to executors by value
_LINES: dict[int, int] = {}


def longest_line(width: int) -> int:
    """At most so many pixels lie on one line (a distance rounded to whole pixels, an angle in whole
    degrees) within 45 degrees of the horizontal, on a page of this width and any height.

    The line takes an interval of y from each column, of length 1 / sin: one pixel of it, and a second
    one if the interval starts within 1 / sin - 1 before a whole number. Starts move by the cotangent from column
    to column, so the columns with two are counted in the fullest window of that length on a circle."""
    if width in _LINES:
        return _LINES[width]
    most = width  # 90 degrees: the rows
    for k in set(range(46, 135)) - {90}:
        t = np.deg2rad(k)
        at = np.sort(np.arange(width) / np.tan(t) % 1)
        ends = np.concatenate((at, at + 1))
        two = np.searchsorted(ends, at + (1 / np.sin(t) - 1 + 1e-6), side="right") - np.arange(width)
        most = max(most, width + min(width, int(two.max(initial=0))))
    _LINES[width] = most
    return most


def skew_angle(g: np.ndarray, least_votes: int = 100, most_lines: int = 50) -> float:
    """Median angle of the strongest straight lines within 45 degrees, 0 if there is none."""
    if longest_line(g.shape[1]) <= least_votes:  # no line within 45 degrees has the votes
        return 0.0
    ys, xs = np.nonzero(edges(g))
    if len(ys) <= least_votes:
        return 0.0
    reach = int(np.hypot(*g.shape)) + 1

    def lines(angles):
        found = []
        for k in angles:
            t = np.deg2rad(k)
            votes = np.bincount(np.rint(xs * np.cos(t) + ys * np.sin(t)).astype(int) + reach, minlength=2 * reach + 1)
            found += [(int(v), k) for v in votes[votes > least_votes]]
        return found

    found = lines(range(46, 135))
    if not found:
        return 0.0
    found = sorted(found + lines([*range(46), *range(135, 180)]), key=lambda x: (-x[0], x[1]))
    angles = [a for a in (k - 90.0 for _, k in found[:most_lines]) if -45 < a < 45]
    return float(np.median(angles)) if angles else 0.0


def dilate(x: np.ndarray, r: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        p = np.pad(x, r)
        x = np.lib.stride_tricks.sliding_window_view(p, (2 * r + 1, 2 * r + 1)).any(axis=(2, 3))
    return x


def regions(g: np.ndarray, least_area: int = 100) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, area) of 8-connected dark regions after two 5x5 dilations."""
    found = components(dilate(ink(g), 2, 2))
    return sorted((r for r in found if r[4] >= least_area), key=lambda r: (r[1], r[0]))


def components(x: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, area) of 8-connected true regions: runs of each row, joined to the
    touching runs of the row above."""
    parent: list[int] = []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    boxes, above = [], []
    for y in range(x.shape[0]):
        d = np.diff(np.concatenate(([0], x[y].astype(np.int8), [0])))
        row = []
        for a, b in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()):
            i = len(parent)
            parent.append(i)
            boxes.append((a, y, b))
            for c, e, j in above:
                if c <= b and a <= e:  # runs [c, e) and [a, b) touch, corners included
                    p, q = root(i), root(j)
                    parent[max(p, q)] = min(p, q)
            row.append((a, b, i))
        above = row
    out: dict[int, list[int]] = {}
    for i, (a, y, b) in enumerate(boxes):
        r = out.setdefault(root(i), [a, y, b, y, 0])
        r[0], r[2], r[3], r[4] = min(r[0], a), max(r[2], b), max(r[3], y), r[4] + b - a
    return [(a, y, b - a, last - y + 1, area) for a, y, b, last, area in out.values()]


def stretch(g: np.ndarray) -> np.ndarray:
    lo, hi = float(g.min()), float(g.max())
    return g.copy() if hi == lo else ((g.astype(np.float32) - np.float32(lo)) * np.float32(255 / (hi - lo))).astype(np.uint8)


def invert(g: np.ndarray) -> np.ndarray:
    return 255 - g


def binarize_otsu(g: np.ndarray) -> np.ndarray:
    return np.where(g > otsu_threshold(g), 255, 0).astype(np.uint8)


def binarize_adaptive(g: np.ndarray, c: float = 11) -> np.ndarray:
    h, w = g.shape
    b = max(11, min(101, min(w, h) // 20))
    b += b % 2 == 0
    r, sigma = b // 2, 0.3 * ((b - 1) * 0.5 - 1) + 0.8
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    p = np.pad(g.astype(np.float64), r, mode="edge")
    p = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, p)
    mean = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, p)
    return np.where(g > np.rint(mean) - c, 255, 0).astype(np.uint8)


def resize(g: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear sampling at pixel centres."""
    h, w = g.shape[:2]
    y, x = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    v = g.astype(np.float64)
    return np.rint((v[y0][:, x0] * (1 - fx) + v[y0][:, x1] * fx) * (1 - fy) + (v[y1][:, x0] * (1 - fx) + v[y1][:, x1] * fx) * fy).astype(np.uint8)


def rotate(g: np.ndarray, degrees: float) -> np.ndarray:
    """By ``-degrees`` about the centre on a canvas that holds the page, white around it."""
    if abs(degrees) < 0.1:
        return g
    h, w = g.shape
    a = np.deg2rad(degrees)
    c, s = np.cos(a), np.sin(a)
    nw, nh = int(h * abs(s) + w * abs(c)), int(h * abs(c) + w * abs(s))
    yy, xx = np.mgrid[:nh, :nw]
    dx, dy = xx - nw / 2, yy - nh / 2
    sx, sy = np.rint(c * dx - s * dy + w / 2).astype(int), np.rint(s * dx + c * dy + h / 2).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    return np.where(ok, g[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 255).astype(np.uint8)


def denoise(g: np.ndarray, strength: float, template: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: weights fall with the mean square difference of neighbourhoods."""
    if strength <= 0:
        return g.copy()
    t, s = template // 2, search // 2
    p = _padded(g.astype(np.float64), s + t)
    h, w = g.shape
    own, total, weight = p[s : s + h + 2 * t, s : s + w + 2 * t], np.zeros((h, w)), np.zeros((h, w))
    for dy in range(search):
        for dx in range(search):
            other = p[dy : dy + h + 2 * t, dx : dx + w + 2 * t]
            d = np.lib.stride_tricks.sliding_window_view((own - other) ** 2, (template, template)).mean(axis=(2, 3))
            k = np.exp(-d / (strength * strength))
            total += k * other[t : t + h, t : t + w]
            weight += k
    return np.rint(total / weight).astype(np.uint8)


METRICS = T.StructType([*[T.StructField(n, T.LongType()) for n in ("doc_id", "width", "height")], *[T.StructField(n, T.DoubleType()) for n in ("blur_score", "noise_level", "contrast_ratio", "brightness", "content_density", "edge_density", "skew_angle")], T.StructField("otsu", T.LongType()), T.StructField("is_inverted", T.BooleanType()), T.StructField("has_text", T.BooleanType()), T.StructField("n_regions", T.LongType())])


def analyse(rasters: DataFrame, c: Preprocessing = GLOBAL_PREPROCESSING) -> DataFrame:
    """One pass, one row of metrics per raster; resolution and the ``needs_*`` decisions are column
    expressions on them."""
    arrow = to_arrow_schema(METRICS)

    def row(r):
        g = to_gray(decode(r["height"], r["width"], r["channels"], r["data"]))
        e = edge_density(g)
        return {"doc_id": r["doc_id"], "width": r["width"], "height": r["height"], "blur_score": round(laplacian_variance(g), 6), "noise_level": round(noise_level(g), 6), "contrast_ratio": michelson(g), "brightness": round(brightness(g), 9), "content_density": float(ink(g).mean()), "edge_density": e, "skew_angle": skew_angle(g), "otsu": otsu_threshold(g), "is_inverted": is_inverted(g), "has_text": 0.01 < e < 0.3, "n_regions": len(regions(g))}

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([row(r) for r in b.to_pylist()], schema=arrow)

    found = rasters.select("doc_id", "height", "width", "channels", "data").mapInArrow(run, METRICS)
    need = steps.flags(c, F.col("noise_level"), F.col("skew_angle"), F.col("contrast_ratio"))
    return found.withColumns({"estimated_dpi": geometry.estimated_dpi(F.col("width"), F.col("height")), "needs_sharpening": F.col("blur_score") < c.blur_threshold, **need})
