"""Page geometry as column expressions: size tests, resolution, grids, tiles, canvas sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ceil_div(a: Column, b) -> Column:
    return F.ceil(a / b).cast("long")


def megapixels(w: Column, h: Column) -> Column:
    return w * h / F.lit(1_000_000.0)


def needs_splitting(w: Column, h: Column, max_mp, max_dim) -> Column:
    return (megapixels(w, h) > max_mp) | (w > max_dim) | (h > max_dim)


def estimated_dpi(w: Column, h: Column) -> Column:
    small, large = F.least(w, h), F.greatest(w, h)
    r = F.when(small == 0, F.lit(1.0)).otherwise(large / F.nullif(small, F.lit(0)))
    inches = F.when((r > 1.35) & (r < 1.50), 8.27).when((r > 1.25) & (r < 1.35), 8.5).otherwise(8.0)
    return F.least(F.greatest((small / inches).cast("long"), F.lit(72)), F.lit(600)).cast("long")


def target_chunks(w: Column, h: Column, max_mp, max_dim) -> Column:
    return F.greatest(ceil_div(megapixels(w, h), max_mp), ceil_div(w, max_dim) * ceil_div(h, max_dim), F.lit(2)).cast("long")


def chunk_grid(n: Column) -> tuple[Column, Column]:
    rows = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return rows, ceil_div(n, rows)


def grid_size(w: Column, h: Column, target: int, max_dim: int, max_mp: float, prefer_horizontal: Column) -> tuple[Column, Column]:
    e = min(target, max_dim)
    least = F.when(megapixels(w, h) > max_mp, F.ceil(F.sqrt(ceil_div(megapixels(w, h), max_mp).cast("double"))).cast("long")).otherwise(1)
    rows, cols = F.greatest(ceil_div(h, e), least), F.greatest(ceil_div(w, e), least)
    total = rows * cols
    wide = prefer_horizontal & (cols > 1)
    two = F.least(cols, F.lit(2))
    out_rows = F.when(wide & (total <= 4), total).when(wide, ceil_div(total, two)).otherwise(rows)
    out_cols = F.when(wide & (total <= 4), 1).when(wide, two).otherwise(cols)
    return F.greatest(out_rows, F.lit(1)).cast("long"), F.greatest(out_cols, F.lit(1)).cast("long")


def overlapping_tiles(df: DataFrame, overlap: float) -> DataFrame:
    """One row per tile of a (width, height, rows, cols) grid; inner edges reach into the neighbour."""
    row, col = F.col("row"), F.col("col")
    t = df.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)))
    base_h, base_w = F.col("height") / F.col("rows"), F.col("width") / F.col("cols")
    oy, ox = (base_h * overlap).cast("long"), (base_w * overlap).cast("long")
    top, bottom = F.when(row > 0, oy).otherwise(0), F.when(row < F.col("rows") - 1, oy).otherwise(0)
    left, right = F.when(col > 0, ox).otherwise(0), F.when(col < F.col("cols") - 1, ox).otherwise(0)
    y0, y1 = F.greatest(F.lit(0), (row * base_h).cast("long") - top), F.least(F.col("height"), ((row + 1) * base_h).cast("long") + bottom)
    x0, x1 = F.greatest(F.lit(0), (col * base_w).cast("long") - left), F.least(F.col("width"), ((col + 1) * base_w).cast("long") + right)
    return t.select("doc_id", (row * F.col("cols") + col).alias("index"), "row", "col", x0.alias("x_offset"), y0.alias("y_offset"), (x1 - x0).alias("w"), (y1 - y0).alias("h"), top.cast("long").alias("overlap_top"), bottom.cast("long").alias("overlap_bottom"), left.cast("long").alias("overlap_left"), right.cast("long").alias("overlap_right"))


def boundary_tiles(df: DataFrame, h_splits: Column, v_splits: Column) -> DataFrame:
    """Tiles between split lines: row-major, edges included."""
    ys, xs = F.concat(F.array(F.lit(0).cast("long")), F.array_sort(h_splits), F.array("height")), F.concat(F.array(F.lit(0).cast("long")), F.array_sort(v_splits), F.array("width"))
    pairs = lambda b: F.zip_with(F.slice(b, 1, F.size(b) - 1), F.slice(b, 2, F.size(b) - 1), lambda p, q: F.struct(p.alias("a"), q.alias("b")))
    t = df.select("doc_id", F.posexplode(pairs(ys)).alias("row", "y"), pairs(xs).alias("xs")).select("doc_id", "row", "y", F.size("xs").alias("n"), F.posexplode("xs").alias("col", "x"))
    return t.select("doc_id", (F.col("row") * F.col("n") + F.col("col")).cast("long").alias("index"), F.col("row").cast("long"), F.col("col").cast("long"), F.col("x.a").alias("x_offset"), F.col("y.a").alias("y_offset"), (F.col("x.b") - F.col("x.a")).alias("w"), (F.col("y.b") - F.col("y.a")).alias("h"))


def suggested_grid(w: Column, h: Column, max_mp: float = 2.0, max_dim: int = 2048) -> tuple[Column, Column]:
    """The older grid proposal from aspect ratio and megapixels."""
    t, a = F.ceil(megapixels(w, h)).cast("long"), w / h
    root = F.ceil(F.sqrt(t.cast("double"))).cast("long")
    wide, tall = F.least(F.lit(4), F.ceil(F.sqrt(t * a)).cast("long")), F.least(F.lit(4), F.ceil(F.sqrt(t / a)).cast("long"))
    need = needs_splitting(w, h, max_mp, max_dim)
    rows = F.when(~need, 1).when(a > 1.5, ceil_div(t, wide)).when(a < 0.67, tall).otherwise(root)
    cols = F.when(~need, 1).when(a > 1.5, wide).when(a < 0.67, ceil_div(t, tall)).otherwise(root)
    return rows.cast("long"), cols.cast("long")


def integer_grid_tiles(df: DataFrame, overlap: float = 0.1) -> DataFrame:
    """The older grid: integer cells, clamped overlap on every side."""
    t = df.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)))
    cw, ch = F.expr("width div cols"), F.expr("height div rows")
    ox, oy = (cw * overlap).cast("long"), (ch * overlap).cast("long")
    x1, y1 = F.greatest(F.lit(0), F.col("col") * cw - ox), F.greatest(F.lit(0), F.col("row") * ch - oy)
    x2, y2 = F.least(F.col("width"), (F.col("col") + 1) * cw + ox), F.least(F.col("height"), (F.col("row") + 1) * ch + oy)
    return t.select("doc_id", "row", "col", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def columns(df: DataFrame, n: int) -> DataFrame:
    """n vertical strips, the last one takes the remainder."""
    t = df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    strip = F.expr(f"width div {n}")
    return t.select("doc_id", "i", (F.col("i") * strip).alias("x1"), F.when(F.col("i") == n - 1, F.col("width")).otherwise((F.col("i") + 1) * strip).alias("x2"), F.col("height").alias("y2"))


def scale_factor(dpi: Column, target: int = 300, cap: float = 3.0, least: float = 1.1) -> Column:
    """1.0 where scaling does not apply."""
    f = F.lit(float(target)) / dpi
    return F.when((F.lit(cap) <= 1.0) | (dpi >= target) | (f < least), F.lit(1.0)).otherwise(F.least(f, F.lit(cap)))


def adaptive_block(w: Column, h: Column) -> Column:
    b = F.greatest(F.lit(11), F.least(F.lit(101), F.floor(F.least(w, h) / 20)))
    return (b + F.when(b % 2 == 0, 1).otherwise(0)).cast("long")


def rotated_canvas(w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    """Canvas that holds the rotated page; sines are rounded so that engines agree."""
    c, s = F.round(F.abs(F.cos(F.radians(degrees))), 9), F.round(F.abs(F.sin(F.radians(degrees))), 9)
    return (h * s + w * c).cast("long"), (h * c + w * s).cast("long")


def scaled(w: Column, h: Column, factor: Column) -> tuple[Column, Column]:
    return (w * factor).cast("long"), (h * factor).cast("long")


def dpi_factor(current: Column, target: int = 300, cap: float = 3.0) -> Column:
    """Direct scaling to a resolution: no least factor, the cap is fixed."""
    return F.when(current >= target, 1.0).otherwise(F.least(F.lit(float(target)) / current, F.lit(cap)))


def split_grid(target: Column, prefer_horizontal: Column) -> tuple[Column, Column]:
    """(rows, cols) for a number of chunks; the longer side goes down the page if preferred."""
    a = F.ceil(F.sqrt(target.cast("double"))).cast("long")
    b = ceil_div(target, a)
    return F.when(prefer_horizontal, a).otherwise(b), F.when(prefer_horizontal, b).otherwise(a)
