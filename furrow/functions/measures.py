"""Closed-form geometry on arrays of struct<x, y>, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold(ring: Column, term) -> Column:
    """Sum of term(p, q) over the ring's edges."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), term)
    return F.when(F.size(ring) < 2, 0.0).otherwise(F.aggregate(edges, F.lit(0.0), lambda a, x: a + x))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, counter-clockwise positive; fewer than three points give 0."""
    return F.when(F.size(ring) < 3, 0.0).otherwise(_fold(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2)


def length(ring: Column) -> Column:
    return _fold(ring, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))


def circumradius(a: Column, b: Column, c: Column) -> Column:
    """Of a triangle; infinite if it has no area."""

    def side(p: Column, q: Column) -> Column:
        return F.hypot(q["x"] - p["x"], q["y"] - p["y"])

    area = F.abs((b["x"] - a["x"]) * (c["y"] - a["y"]) - (c["x"] - a["x"]) * (b["y"] - a["y"])) / 2
    return F.when(area <= 0, float("inf")).otherwise(side(a, b) * side(b, c) * side(c, a) / (4 * area))


def min_interior_angle(ring: Column) -> Column:
    """Degrees, over the vertices of a closed ring; edges of no length are skipped; under four points give 180."""
    n = F.size(ring) - 1

    def angle(i: Column) -> Column:
        a, b, c = (F.get(ring, F.pmod(i + k, n)) for k in (-1, 0, 1))
        u, v = F.hypot(a["x"] - b["x"], a["y"] - b["y"]), F.hypot(c["x"] - b["x"], c["y"] - b["y"])
        dot = (a["x"] - b["x"]) * (c["x"] - b["x"]) + (a["y"] - b["y"]) * (c["y"] - b["y"])
        return F.when((u > 0) & (v > 0), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (u * v))))))

    return F.when(F.size(ring) < 4, 180.0).otherwise(F.coalesce(F.array_min(F.transform(F.sequence(F.lit(0), n - 1), angle)), F.lit(180.0)))


def principal_axis(points: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(key, angle): degrees of the main axis of each key's points; one aggregation, combined before the shuffle."""
    angle = F.degrees(0.5 * F.atan2(2 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y)))
    return points.groupBy(key).agg(F.when(F.count("*") < 2, 0.0).otherwise(angle).alias("angle"))


def spaced_positions(values: Column, tolerance: float) -> Column:
    """Sorted values without those within the tolerance of the last one kept."""
    tol = tolerance if tolerance > 0 else 1e-6
    start = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values), start, lambda kept, v: F.when((F.size(kept) == 0) | (v - F.try_element_at(kept, F.lit(-1)) > tol), F.concat(kept, F.array(v))).otherwise(kept))


def split_axes(ring: Column) -> Column:
    """Unit vectors of the ring's first two edges; edges of no length are left out."""

    def unit(i: int) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        n = F.hypot(dx, dy)
        return F.when(n > 0, F.struct((dx / n).alias("x"), (dy / n).alias("y")))

    return F.array_compact(F.array(unit(0), unit(1)))


def reflex_positions(ring: Column, tolerance: float) -> Column:
    """x of the vertices of a closed ring that bend inwards, on multiples of the tolerance, in order of the ring."""
    n = F.size(ring) - 1
    ccw = signed_area(ring) > 0

    def position(i: Column) -> Column:
        a, b, c = (F.get(ring, F.pmod(i + k, n)) for k in (-1, 0, 1))
        z = (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])
        return F.when(F.when(ccw, z < -1e-9).otherwise(z > 1e-9), F.rint(b["x"] / tolerance) * tolerance)

    return F.when(n < 3, F.array().cast("array<double>")).otherwise(F.array_compact(F.transform(F.sequence(F.lit(0), n - 1), position)))
