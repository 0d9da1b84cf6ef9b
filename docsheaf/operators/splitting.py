"""Choice of a splitter per page: none, projection gaps, free rows and columns, or a grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Method names in order of preference.
METHODS = ("projection", "components", "grid")


def choose(needs: Column, projection: Column, components: Column) -> Column:
    """The first splitter in order that finds a split; a grid always does."""
    return F.when(~needs, "none").when(F.size(projection) > 0, "projection").when(F.size(components) > 0, "components").otherwise("grid")


def by_name(method: str, projection: Column, components: Column, grid: Column) -> Column:
    if method not in METHODS:
        raise ValueError(f"Unknown split method: {method}")
    return dict(zip(METHODS, (projection, components, grid)))[method]


def report(projection: Column, components: Column) -> Column:
    """array<struct<method, can_split>> in order; the recommendation is its first that can."""
    can = (F.size(projection) > 0, F.size(components) > 0, F.lit(True))
    return F.array(*[F.struct(F.lit(m).alias("method"), c.alias("can_split")) for m, c in zip(METHODS, can)])


def recommended(found: Column) -> Column:
    return F.get(F.filter(found, lambda x: x["can_split"]), F.lit(0))["method"]
