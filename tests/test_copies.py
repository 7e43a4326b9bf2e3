"""Equal detections travel once through a plan, and count as often as they occur."""

import pytest
from pyspark.sql import functions as F

from furrow import kernel
from furrow.config import PlanConfig
from furrow.kernel import call
from furrow.plans import treatment

METHODS = ["aabb", "concave-hull", "strip-based", "bcd", "convex-hull", "quadtree", "fixed-grid", "morph-closing", "mrr"]
# a slanting row of patches, one off its line; the second number says how often each is listed
PATCHES = [((4 + 5 * i, 6 + 2 * i + (9 if i == 7 else 0), 7 + 5 * i, 9 + 2 * i + (9 if i == 7 else 0)), 1 + (30 if i == 7 else i % 3)) for i in range(10)]


def boxes(spark, rows):
    x = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(rows)], "ord long, minx double, miny double, maxx double, maxy double")
    return x.withColumn("geom", call("Rect", "minx", "miny", "maxx", "maxy"))


def covered(spark, monkeypatch, method):
    """Rows and copies that reach the method, and the areas of its polygons."""
    kernel.load(spark)
    seen, cover = [], treatment.cover

    def watched(parts, cfg):
        out = cover(parts, cfg)
        seen.append((parts.count(), sorted(r[0] for r in out.select(call("Measure", "geom", F.lit("area"))).collect())))
        return out

    monkeypatch.setattr(treatment, "cover", watched)
    weeds = boxes(spark, [b for b, n in PATCHES for _ in range(n)])
    treatment.treat(weeds, boxes(spark, [(0, 0, 60, 60)]), boxes(spark, [(20, 0, 22, 60)]), PlanConfig(coverage_method=method, merge_distance_m=3.0))
    monkeypatch.setattr(treatment, "cover", cover)
    return seen[0]


@pytest.mark.parametrize("method", METHODS)
def test_copies_reach_a_method_once_and_change_nothing(spark, monkeypatch, method):
    n, once = covered(spark, monkeypatch, method)
    assert n == len(PATCHES)
    monkeypatch.setattr(treatment, "collapsed", lambda x: x.withColumn("copies", F.lit(1).cast("long")))
    n, listed = covered(spark, monkeypatch, method)
    assert n == sum(n for _, n in PATCHES)
    assert once == pytest.approx(listed, abs=1e-6) and once


def test_pieces_do_not_hang_on_last_bits(spark, monkeypatch):
    kernel.load(spark)
    # the second loses its right half to the first, larger one, whose edge leaves the common line by a last bit
    shapes = ["POLYGON ((2 -5, 4 -5, 4 1, 2 0.9999999999999, 2 -5))", "POLYGON ((0 0, 4 0, 4 1, 0 1, 0 0))"]
    x = spark.createDataFrame(list(enumerate(shapes)), "piece long, wkt string").select(F.lit(0).alias("field"), F.lit(0).alias("cluster"), "piece", call("FromWkt", "wkt").alias("geom"))
    areas = [r[0] for r in treatment.resolve_overlaps(x, 0.0).select(call("Measure", "geom", F.lit("area")).alias("a")).orderBy("a").collect()]
    assert areas == pytest.approx([2, 12], abs=1e-5)

    def pieces(negative):
        weeds = boxes(spark, [b for b, n in PATCHES for _ in range(n)])
        cfg = PlanConfig(coverage_method="bcd", merge_distance_m=3.0, negative_buffer_m=negative)
        t = treatment.treat(weeds, boxes(spark, [(0, 0, 60, 60)]), boxes(spark, [(20, 0, 22, 60)]), cfg)
        return sorted(r[0] for r in t.select(call("Measure", "geom", F.lit("area"))).collect())

    # a negative buffer simplifies its input, which shifts areas by some thousandths
    allowed = {0.0: 1e-4, PlanConfig().negative_buffer_m: 1e-2}
    once = {d: pieces(d) for d in allowed}
    monkeypatch.setattr(treatment, "collapsed", lambda x: x.withColumn("copies", F.lit(1).cast("long")))
    for d, a in allowed.items():
        assert once[d] == pytest.approx(pieces(d), abs=a) and once[d]
