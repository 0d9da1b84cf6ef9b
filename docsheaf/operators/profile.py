"""Projection profiles: smoothing, gap runs, choice of split lines, Otsu thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsheaf.functions.text import let


def smoothed(profile: DataFrame, at: str = "y", taps: int = 5) -> DataFrame:
    """(doc_id, at, window_ink, top): the sum over the centred window and the profile's maximum.
    The normalised, smoothed value is window_ink / (taps * top); sums stay integers so that
    comparisons do not hang on the order of additions. Edges count missing values as zero."""
    w = Window.partitionBy("doc_id").orderBy(at).rowsBetween(-(taps // 2), taps // 2)
    top = Window.partitionBy("doc_id")
    return profile.select("doc_id", at, F.sum("ink").over(w).alias("window_ink"), F.max("ink").over(top).alias("top"))


def value(window_ink: Column, top: Column, taps: int = 5) -> Column:
    return F.when(top > 0, window_ink / (top * float(taps))).otherwise(0.0)


def runs(smooth: DataFrame, threshold: float = 0.05, at: str = "y", taps: int = 5) -> DataFrame:
    """(doc_id, first, width, size): maximal runs under the threshold, closed before the end."""
    low = smooth.withColumn("low", F.when(F.col("top") > 0, F.col("window_ink") < F.lit(threshold * taps) * F.col("top")).otherwise(F.lit(True)))
    low = low.withColumn("size", F.count("*").over(Window.partitionBy("doc_id")))
    w = Window.partitionBy("doc_id").orderBy(at)
    islands = low.where("low").withColumn("island", F.col(at) - F.row_number().over(w))
    found = islands.groupBy("doc_id", "island").agg(F.min(at).alias("first"), F.count("*").alias("width"), F.max("size").alias("size"))
    return found.where(F.col("first") + F.col("width") < F.col("size")).drop("island")


def gaps(found: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, center, size): wide runs whose centre keeps a tenth of the size from both edges."""
    center = F.col("first") + F.expr("width div 2")
    ok = (F.col("width") >= least) & (center * 10 > F.col("size")) & (center * 10 < F.col("size") * 9)
    return found.where(ok).select("doc_id", center.alias("center"), "size")


def select_gaps(positions: Column, size: Column, k: int) -> Column:
    """k positions near the even spacing: each ideal takes the nearest one left, the first if tied."""
    return select_nearest(positions, size, F.lit(k))


def select_nearest(positions: Column, size: Column, k: Column) -> Column:
    """``select_gaps`` for a number of positions that is a column."""
    start = F.struct(positions.alias("left"), F.array().cast("array<bigint>").alias("out"))
    ideals = F.when(k > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1)).cast("bigint")), lambda i: size * i.cast("double") / (k + 1).cast("double"))).otherwise(F.array().cast("array<double>"))

    def fold(acc, ideal):
        # positions rise, so the least (distance, position) is the first of the nearest
        pick = F.array_min(F.transform(acc["left"], lambda g: F.struct(F.abs(g - ideal).alias("d"), g.alias("g"))))["g"]
        return F.when(F.size(acc["left"]) == 0, acc).otherwise(F.struct(F.array_except(acc["left"], F.array(pick)).alias("left"), F.concat(acc["out"], F.array(pick)).alias("out")))

    return F.when(F.size(positions) <= k, F.array_sort(positions)).otherwise(F.array_sort(F.aggregate(ideals, start, fold, lambda a: a["out"])))


def by_min_size(splits: Column, size: Column, least: int) -> Column:
    """Greedy: a split stays if it leaves ``least`` on either side, the last kept one being the edge."""
    start = F.struct(F.lit(0).cast("bigint").alias("prev"), F.array().cast("array<bigint>").alias("out"))
    keep = lambda a, s: F.struct(s.alias("prev"), F.concat(a["out"], F.array(s)).alias("out"))
    return F.aggregate(F.array_sort(splits), start, lambda a, s: F.when((s - a["prev"] >= least) & (size - s >= least), keep(a, s)).otherwise(a), lambda a: a["out"])


def _disjoint(occupied: Column) -> Column:
    """The intervals sorted, those that meet or overlap as one."""
    start = F.array().cast("array<struct<first:bigint,last:bigint>>")

    def grow(acc, o):
        now = F.struct(o["first"].cast("bigint").alias("first"), o["last"].cast("bigint").alias("last"))
        held = F.element_at(acc, -1)
        wider = F.struct(held["first"].alias("first"), F.greatest(held["last"], now["last"]).alias("last"))
        return F.when((F.size(acc) > 0) & (now["first"] <= F.get(acc, F.size(acc) - 1)["last"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(acc, F.array(now)))

    return F.aggregate(F.array_sort(F.filter(occupied, lambda o: o["last"] > o["first"])), start, grow)


def free_positions_split(occupied: Column, size: Column, k: int, least: int) -> Column:
    """Split lines on positions no interval covers: each even spacing takes the nearest free one
    (the lowest if tied) within half a spacing, if it keeps ``least`` from edges and other splits.
    ``occupied`` is array<struct<first, last>>, last exclusive. The free position nearest to an
    ideal is the ideal itself or lies at the end of an interval, so only those are looked at."""
    ideals = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: (size / float(k + 1) * i).cast("bigint"))

    def over(taken):
        ends = F.concat(F.transform(taken, lambda o: o["first"] - 1), F.transform(taken, lambda o: o["last"]))
        places = F.filter(ends, lambda p: (p >= 0) & (p < size))

        def fold(acc, ideal):
            def choose(best):
                near, pick = best["d"], best["p"]
                ok = (near < size / float(k + 1) * 0.5) & (pick >= least) & (pick <= size - least) & ~F.exists(acc, lambda s: F.abs(s - pick) < least)
                return F.when(F.coalesce(ok, F.lit(False)), F.concat(acc, F.array(pick))).otherwise(acc)

            # the least (distance, position)
            nearest = F.array_min(F.transform(places, lambda p: F.struct(F.abs(p - ideal).alias("d"), p.alias("p"))))
            inside = F.exists(taken, lambda o: (ideal >= o["first"]) & (ideal < o["last"]))
            return let(F.when(inside, nearest).otherwise(F.struct(F.lit(0).cast("bigint").alias("d"), ideal.alias("p"))), choose)

        return F.aggregate(ideals, F.array().cast("array<bigint>"), fold)

    return F.array_sort(let(_disjoint(occupied), over))


def otsu(histogram: DataFrame) -> DataFrame:
    """(doc_id, threshold) from (doc_id, v, n): the lowest value with the largest variance between
    the classes up to it and above it. Sums are integers, so engines agree."""
    w = Window.partitionBy("doc_id").orderBy("v")
    all_ = Window.partitionBy("doc_id")
    h = histogram.select("doc_id", "v", F.sum("n").over(w).alias("w0"), F.sum(F.col("n") * F.col("v")).over(w).alias("m0"), F.sum("n").over(all_).alias("w"), F.sum(F.col("n") * F.col("v")).over(all_).alias("m"))
    d = (F.col("m0") * F.col("w") - F.col("m") * F.col("w0")).cast("double")
    between = F.when(F.col("w0") < F.col("w"), d * d / (F.col("w0").cast("double") * (F.col("w") - F.col("w0")).cast("double"))).otherwise(0.0)
    best = h.withColumn("b", between).groupBy("doc_id").agg(F.min(F.struct((-F.col("b")).alias("b"), "v")).alias("x"))
    return best.select("doc_id", F.col("x.v").alias("threshold"))
