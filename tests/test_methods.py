"""Coverage methods and lines on shapes whose areas are worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from furrow import kernel
from furrow.config import PlanConfig
from furrow.kernel import call
from furrow.plans import treatment


@pytest.fixture(autouse=True)
def loaded(spark):
    kernel.load(spark)


def box(a, b, c, d):
    return f"POLYGON (({a} {b}, {c} {b}, {c} {d}, {a} {d}, {a} {b}))"


def areas(spark, cfg, *wkts):
    g = spark.createDataFrame(list(enumerate(wkts)), "ord long, wkt string").select("ord", F.lit(0).alias("field"), F.lit(0).alias("cluster"), call("FromWkt", "wkt").alias("geom"))
    return sorted(round(r[0], 6) for r in treatment.cover(g, cfg).select(call("Measure", "geom", F.lit("area"))).collect())


L = "POLYGON ((0 0, 10 0, 10 4, 4 4, 4 10, 0 10, 0 0))"


def test_hulls_of_an_l(spark):
    assert areas(spark, PlanConfig(coverage_method="aabb"), L) == [100.0]
    assert areas(spark, PlanConfig(coverage_method="convex-hull"), L) == [100 - 18]
    assert areas(spark, PlanConfig(coverage_method="mrr"), L) == [100.0]
    # triangles within the bend have circumradius 3 * sqrt(2) or 5 * sqrt(2) at least; a small radius leaves the shape itself
    assert areas(spark, PlanConfig(coverage_method="concave-hull", alpha_shape_radius_m=4.0), L) == [64.0]
    assert areas(spark, PlanConfig(coverage_method="concave-hull", alpha_shape_radius_m=50.0), L) == [82.0]


def test_quadtree_of_a_corner(spark):
    # root 8 x 8; the shape is the lower left 3 x 3 of it and a far corner that makes the box 8 wide
    cfg = PlanConfig(coverage_method="quadtree", quadtree_min_cell_size_m=2.0, quadtree_fill_threshold=0.5, rectangle_max_depth=6)
    # lower left 4 x 4 holds 9 of 16 and stays whole; upper right 4 x 4 goes down to the 2 x 2 cell at (6, 6)
    assert areas(spark, cfg, box(0, 0, 3, 3), box(7, 7, 8, 8)) == [4.0, 16.0]


def test_grid_keeps_cells_by_share(spark):
    cfg = PlanConfig(coverage_method="fixed-grid", grid_cell_size_m=2.0, grid_fill_threshold=0.35)
    # columns 0-2 and 2-4 are full, 4-5 is half of its cell; rows 0-2 full, 2-2.6 holds 0.3 of its cells
    assert areas(spark, cfg, box(0, 0, 5, 2.6)) == [12.0]


def test_strips_along_the_axis(spark):
    # a long bar: its ring with the closing vertex leans a little, strips of 3 m cover it at their full width
    out = areas(spark, PlanConfig(coverage_method="strip-based", strip_width_m=3.0, strip_fill_threshold=0.3), box(0, 0, 60, 3))
    assert 180 <= sum(out) <= 2.2 * 180


def test_closing_fills_a_slit(spark):
    cfg = PlanConfig(coverage_method="morph-closing", weed_buffer_m=1.0)
    closed = areas(spark, cfg, box(0, 0, 10, 4), box(0, 5, 10, 9))  # a slit of 1 m is filled by a radius of 1 m
    assert len(closed) == 1 and closed[0] == pytest.approx(90, abs=0.3)
    assert len(areas(spark, cfg, box(0, 0, 10, 4), box(0, 7, 10, 11))) == 2


def test_cells_of_a_bend(spark):
    # no reflex corner: the shape itself; a bend is cut into bands that overlap by the tolerance and together cover it
    assert areas(spark, PlanConfig(coverage_method="bcd"), box(0, 0, 10, 4)) == [40.0]
    cells = areas(spark, PlanConfig(coverage_method="bcd", merge_distance_m=2.0), L)
    assert len(cells) >= 2 and 64 <= sum(cells) <= 64 * 1.5


def test_rectangles_split_only_for_a_gain(spark):
    near, far = (box(0, 0, 2, 2), box(3, 0, 5, 2)), (box(0, 0, 2, 2), box(30, 30, 32, 32))
    assert areas(spark, PlanConfig(coverage_method="mrr", merge_distance_m=5.0), *near) == [10.0]
    assert areas(spark, PlanConfig(coverage_method="mrr", merge_distance_m=5.0), *far) == [4.0, 4.0]
    assert len(areas(spark, PlanConfig(coverage_method="mrr", merge_distance_m=100.0), *far)) == 1, "the gap is below the merge distance"


def test_line_around_a_hole_and_a_triangle(spark):
    rows = [(0, "POLYGON ((0 0, 20 0, 20 10, 0 10, 0 0), (8 2, 12 2, 12 8, 8 8, 8 2))"), (1, "POLYGON ((0 0, 12 0, 6 9, 0 0))")]
    g = spark.createDataFrame(rows, "id int, wkt string").select("id", call("FromWkt", "wkt").alias("g"))
    lines = {r.id: r for r in g.select("id", call("ToWkt", call("Route", "g", F.lit(3.0), F.lit(0.0))).alias("w"), call("Measure", call("Route", "g", F.lit(3.0), F.lit(0.0)), F.lit("length")).alias("n")).collect()}
    # triangle: rows of 12, 8 and 4 (the top point is no line); connectors along its sides of sqrt(4 + 9)
    assert lines[1].n == pytest.approx(24 + 2 * math.sqrt(13))
    # rows of 20, 8 + 8, 8 + 8 and 20, steps of 3; over the hole the way leads by two outer corners, as only those are way points
    assert lines[0].n == pytest.approx(72 + 9 + (2 * math.sqrt(73) + 20) + (2 * math.sqrt(80) + 20), abs=1e-6)


@pytest.mark.parametrize("depth", [2, 4, 8])
def test_swept_rhos_equal_single_runs(spark, depth):
    """A sweep leaves out only the rhos that change nothing."""
    rng = random.Random(depth)
    corners = [(rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(1, 9), rng.uniform(1, 9)) for _ in range(40)]
    g = spark.createDataFrame([(i, box(x, y, x + w, y + h)) for i, (x, y, w, h) in enumerate(corners)], "ord long, wkt string")
    p = g.select(F.transform(F.array_sort(F.collect_list(F.struct("ord", call("FromWkt", "wkt").alias("g")))), lambda v: v["g"]).alias("p"))
    rhos = [x / 100 for x in range(0, 51, 2)]
    swept = p.select(F.transform(call("Sweep", "p", F.array(*map(F.lit, rhos)), F.lit(depth), F.lit(5.0)), lambda s: call("Measure", s, F.lit("area")))).first()[0]
    parameters = PlanConfig(rectangle_max_depth=depth).cover_parameters()
    single = p.select(F.array(*[call("Measure", call("Union", call("Cover", F.lit("mrr"), "p", F.array(F.lit(r), *map(F.lit, parameters[1:])))), F.lit("area")) for r in rhos])).first()[0]
    last = None
    for a, b in zip(swept, single, strict=True):
        last = a if a is not None else last
        assert last == pytest.approx(b)
    assert None in swept and (depth == 2 or len(set(single)) > 1)
