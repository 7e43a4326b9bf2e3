"""Bounding-box joins.

Both sides carry minx, miny, maxx, maxy.  Boxes are put on a grid and joined on the cell, so the join
is an equi-join that shuffles (or broadcasts, if Spark measures a small side) instead of comparing
all with all.  A pair meets in every cell that both cover; it is kept only in the cell of the larger
of the two lower corners, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDS = ("minx", "miny", "maxx", "maxy")


def _cells(df: DataFrame, prefix: str, size: float) -> DataFrame:
    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(prefix + lo) / size), F.floor(F.col(prefix + hi) / size))

    return df.withColumn("cell_x", F.explode(span("minx", "maxx"))).withColumn("cell_y", F.explode(span("miny", "maxy")))


def overlapping(left: DataFrame, right: DataFrame, cell: float, strict: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs whose boxes meet (strict: share an inner area) and agree in the columns `on`; columns of both with l_ and r_ before them."""
    a = _cells(left.select(*[F.col(c).alias("l_" + c) for c in left.columns]), "l_", cell)
    b = _cells(right.select(*[F.col(c).alias("r_" + c) for c in right.columns]), "r_", cell)

    def before(x: str, y: str) -> Column:
        return F.col(x) < F.col(y) if strict else F.col(x) <= F.col(y)

    for c in on:
        a, b = a.withColumn("on_" + c, F.col("l_" + c)), b.withColumn("on_" + c, F.col("r_" + c))
    keys = ["cell_x", "cell_y", *("on_" + c for c in on)]
    j = a.join(b, keys).where(before("l_minx", "r_maxx") & before("r_minx", "l_maxx") & before("l_miny", "r_maxy") & before("r_miny", "l_maxy"))
    home = (F.floor(F.greatest("l_minx", "r_minx") / cell) == F.col("cell_x")) & (F.floor(F.greatest("l_miny", "r_miny") / cell) == F.col("cell_y"))
    return j.where(home).drop(*keys)


def clipped_box(joined: DataFrame) -> DataFrame:
    """The common box of each pair, as minx..maxy."""
    return joined.select("*", F.greatest("l_minx", "r_minx").alias("minx"), F.greatest("l_miny", "r_miny").alias("miny"), F.least("l_maxx", "r_maxx").alias("maxx"), F.least("l_maxy", "r_maxy").alias("maxy"))
