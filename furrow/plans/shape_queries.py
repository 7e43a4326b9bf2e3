"""Queries on shapes whose results have a closed form, so that plans, lines, metrics and the kernel can be checked by SQL.

Patches are rectangles, one per customer, each in a slot of 10 m of its nation's field; some reach over
the field's edge, some lie under an obstacle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import kernel
from furrow.config import PlanConfig
from furrow.functions import crs, measures
from furrow.kernel import call
from furrow.operators import paths
from furrow.plans import evaluate, reports, treatment
from furrow.plans.queries import PLACES, _rings, _table, clip, fields, query, weeds
from furrow.sources import geojson

PATCH = """c_custkey AS ord, c_nationkey AS nation,
 CAST(c_nationkey * 300 + (c_custkey % 20) * 10 + 1 AS DOUBLE) + CAST(c_custkey % 5 AS DOUBLE) * 0.25 - CASE WHEN c_custkey % 20 = 0 THEN 1.5 ELSE 0.0 END AS minx,
 CAST(floor(c_custkey / 20) AS DOUBLE) * 10 + 1 + CAST(c_custkey % 3 AS DOUBLE) * 0.25 AS miny, 1 + CAST(c_custkey % 7 AS DOUBLE) * 0.5 AS w, 1 + CAST(c_custkey % 4 AS DOUBLE) AS h"""
PLOT = "CAST(n_nationkey AS BIGINT) AS ord, CAST(n_nationkey * 300 AS DOUBLE) AS minx, CAST(0 AS DOUBLE) AS miny, CAST(n_nationkey * 300 + 200 AS DOUBLE) AS maxx, CAST(1000000 AS DOUBLE) AS maxy"
PATCHES = f"""p0 AS (SELECT {PATCH.replace('floor(c_custkey / 20)', 'c_custkey // 20')} FROM customer),
 p AS (SELECT ord, nation AS field_id, ord % 20 AS slot, greatest(minx, nation * 300.0::DOUBLE) AS x0, minx + w AS x1, miny AS y0, miny + h AS y1 FROM p0)"""
RECTANGLES = """, r AS (SELECT field_id, (x1 - x0) * (y1 - CASE WHEN slot = 19 THEN least(greatest(y0, 503.0), y1) ELSE y0 END) AS a FROM p)
 SELECT CAST(field_id AS BIGINT) AS field_id, count(*) AS pieces, round(sum(a), 2) AS area_m2 FROM r WHERE a > 0.01 AND a >= {least} GROUP BY field_id"""
BLOCK = "CAST(n_nationkey AS BIGINT) AS field, 105 + CAST(n_nationkey AS DOUBLE) * 10 AS w, 33 + CAST(n_nationkey AS DOUBLE) * 7 AS h"
SETTINGS = PlanConfig(weed_buffer_m=0.0, merge_distance_m=0.0, negative_buffer_m=0.0, min_polygon_area_m2=2.1)


def rect(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.withColumn(geom, call("Rect", "minx", "miny", "maxx", "maxy"))


def patches(spark, d, dx: float = 0.0, dy: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(detections, fields, obstacles) in metres."""
    kernel.load(spark)
    p = _table(spark, d, "customer", PATCH).selectExpr("cast(ord as long) as ord", "minx", "miny", "minx + w as maxx", "miny + h as maxy")
    f = _table(spark, d, "nation", PLOT)
    o = f.selectExpr("ord", "minx + 190 as minx", "miny", "minx + 195 as maxx", "miny + 500 as maxy")

    def moved(x: DataFrame) -> DataFrame:
        return rect(x.withColumns({c: F.col(c) + (dx if c.endswith("x") else dy) for c in ("minx", "miny", "maxx", "maxy")}))

    return moved(p), moved(f), moved(o)


def _planned(method: str):
    def run(spark, d):
        t = treatment.treat(*patches(spark, d), SETTINGS.replace(coverage_method=method))
        area = F.round(F.sum(call("Measure", "geom", F.lit("area"))), 2).alias("area_m2")
        counted = [F.count("*").alias("pieces")] if method not in ("fixed-grid", "quadtree") else []
        return t.groupBy(F.col("field").alias("field_id")).agg(*counted, area)

    run.__name__ = "plan_" + method.replace("-", "_")
    return run


for _m in ("mrr", "bcd", "convex-hull", "concave-hull", "aabb"):
    query(f", {PATCHES}" + RECTANGLES.format(least=0.0 if _m == "bcd" else 2.1))(_planned(_m))

query(f""", {PATCHES}, gx AS (SELECT *, unnest(generate_series(CAST(floor(x0 / 2) AS BIGINT), CAST(ceil(x1 / 2) AS BIGINT) - 1)) * 2 AS cx FROM p),
 gy AS (SELECT *, unnest(generate_series(CAST(floor(y0 / 2) AS BIGINT), CAST(ceil(y1 / 2) AS BIGINT) - 1)) * 2 AS cy FROM gx),
 c AS (SELECT field_id, 2 * (cy + 2 - CASE WHEN slot = 19 AND cy < 503 THEN least(503, cy + 2) ELSE cy END)::DOUBLE AS a FROM gy
  WHERE (least(x1, cx + 2) - greatest(x0, cx)) * (least(y1, cy + 2) - greatest(y0, cy)) / 4 >= 0.35)
 SELECT CAST(field_id AS BIGINT) AS field_id, round(sum(a), 2) AS area_m2 FROM c WHERE a > 0 GROUP BY field_id""")(_planned("fixed-grid"))

query(f""", {PATCHES}, q AS (SELECT field_id, slot, x0, y0, x1, y1, x0 AS x, y0 AS y, greatest(x1 - x0, y1 - y0) AS side, 0 AS depth FROM p
  UNION ALL SELECT field_id, slot, x0, y0, x1, y1, x + k % 2 * side / 2, y + k // 2 * side / 2, side / 2, depth + 1 FROM q, generate_series(0, 3) t(k)
   WHERE least(x1, x + side) >= greatest(x0, x) AND least(y1, y + side) >= greatest(y0, y) AND depth < 6 AND side > 1
   AND greatest(0, least(x1, x + side) - greatest(x0, x)) * greatest(0, least(y1, y + side) - greatest(y0, y)) / (side * side) < 0.35),
 c AS (SELECT field_id, side * (y + side - CASE WHEN slot = 19 AND y < 503 THEN least(503, y + side) ELSE y END) AS a FROM q
  WHERE least(x1, x + side) >= greatest(x0, x) AND least(y1, y + side) >= greatest(y0, y) AND (depth >= 6 OR side <= 1
   OR greatest(0, least(x1, x + side) - greatest(x0, x)) * greatest(0, least(y1, y + side) - greatest(y0, y)) / (side * side) >= 0.35))
 SELECT CAST(field_id AS BIGINT) AS field_id, round(sum(a), 2) AS area_m2 FROM c WHERE a > 0 GROUP BY field_id""")(_planned("quadtree"))


@query(f""", {PATCHES}, r AS (SELECT field_id, (x1 - x0) * (y1 - CASE WHEN slot = 19 AND y0 < 503 THEN least(503.0, y1) ELSE y0 END) AS a FROM p)
 SELECT CAST(field_id AS INTEGER) AS field_id, 'Field ' || (field_id + 1) AS field_name, round(sum(a), 1) AS area_m2, 0.0::DOUBLE AS merge_distance_m, 'aabb' AS coverage_method FROM r WHERE a >= 2.1 GROUP BY field_id""")
def output_rows(spark, d):
    """Rows of the plan's output: areas after a round trip through degrees."""
    cfg = SETTINGS.replace(coverage_method="aabb")
    rows = treatment.output_rows(treatment.treat(*patches(spark, d, 300_000.0, 9_000_000.0), cfg), 25, True, cfg)
    return rows.drop("geometry").withColumn("area_m2", F.round("area_m2", 1))


@query(f""", {PATCHES}, h AS (SELECT field_id, count(*) AS n FROM p0 JOIN (SELECT n_nationkey AS field_id FROM nation) ON field_id = nation GROUP BY field_id)
 SELECT CAST(n_nationkey AS BIGINT) AS id, 'Field ' || (n_nationkey + 1) AS name, coalesce(n, 0) AS weeds, 20000.0::DOUBLE AS area_ha, n_nationkey * 300 + 300100.0::DOUBLE AS easting, 9500000.0::DOUBLE AS northing FROM nation LEFT JOIN h ON field_id = n_nationkey""")
def field_info(spark, d):
    """Weeds, hectares and centre of each field; the centre's degrees are projected again, by column functions."""
    w, f, _ = patches(spark, d, 300_000.0, 9_000_000.0)
    x = reports.field_info(w, f, 25, True)
    e, n = crs.forward(F.col("centroid_lon"), F.col("centroid_lat"), F.lit(25), F.lit(True))
    return x.select("id", "name", "weeds", F.round("area_ha", 6).alias("area_ha"), F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@query(""", x AS (SELECT c_custkey AS ord, c_nationkey AS field, c_custkey * 5.0::DOUBLE + (c_custkey % 7) * 3 AS x0 FROM customer), g AS (SELECT *, CASE WHEN x0 - lag(x0 + 1) OVER w > 4.25 THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY field ORDER BY x0, ord)),
 c AS (SELECT *, sum(new) OVER (PARTITION BY field ORDER BY x0, ord) AS cluster FROM g)
 SELECT CAST(field AS BIGINT) AS field, CAST(ord AS BIGINT) AS ord, CAST(min(ord) OVER (PARTITION BY field, cluster) AS BIGINT) AS first FROM c""")
def clusters_chain(spark, d):
    """Squares in a row with gaps of quarter metres: clusters are islands between gaps above the merge distance."""
    kernel.load(spark)
    x = _table(spark, d, "customer", "c_custkey AS ord, c_nationkey AS field, CAST(c_custkey AS DOUBLE) * 5 + CAST(c_custkey % 7 AS DOUBLE) * 3 AS minx")
    x = rect(x.selectExpr("cast(ord as long) as ord", "cast(field as long) as field", "minx", "0D as miny", "minx + 1 as maxx", "1D as maxy"))
    c = treatment.clusters(x.select("field", "ord", "geom"), 4.25, 4)
    return c.select("field", "ord", F.expr("min(ord) over (partition by field, cluster)").alias("first"))


def _blocks(spark, d) -> DataFrame:
    kernel.load(spark)
    b = _table(spark, d, "nation", BLOCK)
    return b.withColumn("geom", call("Rect", F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h")))


@query(f", b AS (SELECT {BLOCK} FROM nation), k AS (SELECT *, floor(h / 10) + 1 AS k FROM b) SELECT field, 0 AS part, round(k * w + (k - 1) * 10, 3) AS length, CAST(2 * k AS INTEGER) AS points FROM k")
def flight_lines_rect(spark, d):
    """Zigzag lines over rectangles: one row each 10 m, joined along the edge."""
    lines = evaluate.flight_lines(_blocks(spark, d).select("field", "geom"), None, 10.0, 0.0)
    return lines.select("field", "part", F.round(call("Measure", "line", F.lit("length")), 3).alias("length"), F.size(call("Points", "line")).alias("points"))


@query(f""", b AS (SELECT {BLOCK} FROM nation), k AS (SELECT *, floor(h / 10) + 1 AS k FROM b), m AS (SELECT field % 2 AS method, w * h AS area, 2 * (w + h) AS perimeter, 2 * (k - 1) AS turns, k * w + (k - 1) * 10 AS s, k * w * w + (k - 1) * 100 AS ss, 2 * k - 1 AS n,
  w * least(h, 10 * (k - 1) + 5) AS hit, 5 * w + greatest(0, 10 * (k - 1) + 5 - h) * w + 100 * (k - 1) AS miss FROM k)
 SELECT 'm' || method AS method, count(*) AS num_polygons, round(sum(area) / 1e4, 6) AS total_area_ha, round(sum(area) / sum(perimeter), 6) AS area_perimeter_ratio, round(sum(s) / sum(n), 6) AS mean_straight_length_m, round(sqrt(sum(ss) / sum(n) - (sum(s) / sum(n))**2), 6) AS std_straight_length_m,
 CAST(sum(turns) AS BIGINT) AS num_turns, round(sum(turns) / sum(area) * 1e4, 6) AS turns_per_ha, round(100 * sum(hit) / sum(area), 6) AS target_coverage_pct, round(100 * sum(miss) / sum(area), 6) AS clean_area_waste_pct FROM m GROUP BY method""")
def geometric_metrics_rect(spark, d):
    """Metrics of two methods' lines over rectangles; corridors overlap the edges by half the swath."""
    b = _blocks(spark, d)
    name = F.concat(F.lit("m"), (F.col("field") % 2).cast("string")).alias("method")
    lines = evaluate.flight_lines(b.select("field", "geom"), None, 10.0, 0.0)
    m = evaluate.geometric_metrics(b.select(name, "field", "geom"), lines.select(name, "field", "part", "line"), 10.0)
    return m.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in m.dtypes])


_SWEEP = """, b AS (SELECT 100 + n_nationkey * 10.0::DOUBLE AS w FROM nation), t AS (SELECT sum(w) AS w, count(*) AS n FROM b),
 c AS (SELECT i / 100.0::DOUBLE AS rho_min, d AS max_depth, * FROM t, (SELECT unnest(generate_series(0, 50)) AS i), (SELECT unnest([2, 4, 8]) AS d))"""


@query(_SWEEP + """ SELECT rho_min, max_depth, round(w * 31 / 1e4, 6) AS total_area_ha, n AS final_polygon_count, 100.0::DOUBLE AS coverage_pct, 100.0::DOUBLE AS iou_pct, 20 * n AS total_turns, round((11 * w + 30 * n) / (21 * n), 6) AS mean_straight_line_m, round((11 * w + 30 * n) / 1e3, 6) AS total_flight_length_km FROM c""")
def sensitivity_rect(spark, d):
    """All 153 configurations over one rectangle per file, which none of them splits."""
    s = _swept(spark, d)
    return s.select("rho_min", *[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in s.dtypes if c != "rho_min"])


def _swept(spark, d) -> DataFrame:
    kernel.load(spark)
    w = _table(spark, d, "nation", "CAST(n_nationkey AS BIGINT) AS file, 100 + CAST(n_nationkey AS DOUBLE) * 10 AS w")
    files = w.select("file", F.lit(0).alias("ord"), call("Rect", F.lit(0.0), F.lit(0.0), F.col("w"), F.lit(31.0)).alias("geom"))
    return evaluate.sensitivity(files, [x / 100 for x in range(51)], [2, 4, 8])


@query(_SWEEP + """ SELECT panel, rho_min, max_depth, round(CASE panel WHEN 'total_area_ha' THEN w * 31 / 1e4 WHEN 'final_polygon_count' THEN n WHEN 'iou_pct' THEN 100 ELSE 11 * w + 30 * n END, 6) AS value
 FROM c, (SELECT unnest(['total_area_ha', 'final_polygon_count', 'iou_pct', 'total_flight_length_m']) AS panel)""")
def sensitivity_panels(spark, d):
    """The curves of the four panels of a sensitivity plot."""
    return evaluate.sensitivity_panels(_swept(spark, d)).withColumn("value", F.round("value", 6))


_SIZE = "event_id, 0.5 + CAST(event_id % 7 AS DOUBLE) * 0.5 AS w, 0.5 + CAST(event_id % 5 AS DOUBLE) * 0.5 AS h, CAST(event_id % 1000 AS DOUBLE) AS x, CAST(event_id % 77 AS DOUBLE) AS y"


def _sizes(spark, d) -> DataFrame:
    kernel.load(spark)
    s = _table(spark, d, "events", _SIZE)
    return s.withColumn("geom", call("Rect", F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))


def _area(g) -> Column:
    return F.round(call("Measure", g, F.lit("area")), 6)


@query(f""", s AS (SELECT {_SIZE} FROM events) SELECT event_id, round(w * h + 2 * (w + h) + 8 * sin(pi() / 8), 6) AS round_, round((w + 6) * (h + 6), 6) AS mitre, round(greatest(0, w - 0.5) * greatest(0, h - 0.5), 6) AS shrunk, round(w * 3, 6) AS corridor FROM s""")
def buffers_rect(spark, d):
    """Round, mitred and negative buffers of rectangles, and a flat corridor of their lower edge."""
    s = _sizes(spark, d)
    edge = call("FromWkt", F.format_string("LINESTRING (%s %s, %s %s)", F.col("x").cast("string"), F.col("y").cast("string"), (F.col("x") + F.col("w")).cast("string"), F.col("y").cast("string")))

    def grown(g, by: float, segs: int, style: str):
        return _area(call("Buffer", g, F.lit(by), F.lit(segs), F.lit(style)))

    return s.select("event_id", grown("geom", 1.0, 4, "round").alias("round_"), grown("geom", 3.0, 4, "mitre").alias("mitre"), grown("geom", -0.25, 4, "round").alias("shrunk"), grown(edge, 1.5, 4, "flat").alias("corridor"))


@query(f", s AS (SELECT {_SIZE} FROM events) SELECT event_id, round(w * h * 1.75, 6) AS merged, round(w * h / 4, 6) AS common, round(w * h * 0.75, 6) AS rest, 1 AS parts FROM s")
def overlay_rect(spark, d):
    """Union, intersection and difference of each rectangle and its copy moved by half its size."""
    s = _sizes(spark, d)
    b = call("Rect", F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("x") + F.col("w") * 1.5, F.col("y") + F.col("h") * 1.5)
    merged = call("Union", F.array("geom", b))
    return s.select("event_id", _area(merged).alias("merged"), _area(call("Overlay", "geom", b, F.lit("intersection"))).alias("common"), _area(call("Overlay", "geom", b, F.lit("difference"))).alias("rest"), F.size(call("Polygons", merged)).alias("parts"))


@query(f""", s AS (SELECT {_SIZE} FROM events) SELECT event_id, round(w * h, 6) AS rectangle, round(w * h, 6) AS hull, round(x + w / 2 - h / 2, 6) AS turned_minx, round(y + h / 2 + w / 2, 6) AS turned_maxy, round(x + w / 2, 6) AS cx, round(2 * (w + h), 6) AS perimeter FROM s""")
def shapes_rect(spark, d):
    """Smallest rectangle, hull, centre and perimeter of a rectangle, and its bounds after a quarter turn."""
    s = _sizes(spark, d)
    turned = call("Rotate", "geom", F.lit(90.0), F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2)

    def of(g, what: str):
        return F.round(call("Measure", g, F.lit(what)), 6)

    return s.select("event_id", _area(call("Shape", "geom", F.lit("rectangle"))).alias("rectangle"), _area(call("Shape", "geom", F.lit("hull"))).alias("hull"), of(turned, "minx").alias("turned_minx"), of(turned, "maxy").alias("turned_maxy"), of("geom", "cx").alias("cx"), of("geom", "perimeter").alias("perimeter"))


@query(f""", s AS (SELECT {_SIZE} FROM events) SELECT event_id, round(w * h, 6) AS line_area, round(w * h, 6) AS same, 2 + CAST(event_id % 2 AS INTEGER) AS polygons, 2 AS lines, round(w + h, 6) AS line_length, 8 AS vertices FROM s""")
def geometry_parts(spark, d):
    """A slanted line repaired to its box, a rectangle left as it is, parts of nested collections, vertices of a ring with a hole."""
    s = _sizes(spark, d).select("event_id", "geom", *[F.col(c).cast("string").alias(c) for c in "wh"])
    line = call("FromWkt", F.format_string("LINESTRING (0 0, %s %s)", "w", "h"))
    square = "((0 0, 1 0, 1 1, 0 1, 0 0))"
    more = F.when(F.col("event_id") % 2 == 1, f", GEOMETRYCOLLECTION (POLYGON {square})").otherwise("")
    nested = call("FromWkt", F.concat(F.lit(f"GEOMETRYCOLLECTION (POINT (3 3), MULTIPOLYGON ({square}, ((5 5, 6 5, 6 6, 5 5))), MULTILINESTRING ((0 0, "), F.col("w"), F.lit(" 0), (1 1, 1 1), (0 0, 0 "), F.col("h"), F.lit("))"), more, F.lit(")")))
    parts = call("LineParts", nested)
    ringed = call("FromWkt", F.lit("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 3 2, 3 3, 2 3, 2 2))"))
    length = F.aggregate(F.transform(parts, lambda g: call("Measure", g, F.lit("length"))), F.lit(0.0), lambda a, v: a + v)
    return s.select("event_id", _area(call("Repair", line, F.lit(True))).alias("line_area"), _area(call("Repair", "geom", F.lit(True))).alias("same"), F.size(call("Polygons", nested)).alias("polygons"), F.size(parts).alias("lines"), F.round(length, 6).alias("line_length"), F.size(call("RingPoints", ringed)).alias("vertices"))


@query(""", x AS (SELECT line_id, list(struct_pack(x := x, y := y) ORDER BY seq) AS p FROM route GROUP BY line_id), e AS (SELECT line_id, p, i, p[i + 1].x - p[i].x AS dx, p[i + 1].y - p[i].y AS dy FROM x, (SELECT unnest([1, 2]) AS i) WHERE len(p) >= 2)
 SELECT line_id, count(*) AS n, round(sum(dx / sqrt(dx * dx + dy * dy)), 6) AS sum_x, round(sum(dy / sqrt(dx * dx + dy * dy)), 6) AS sum_y FROM e WHERE dx * dx + dy * dy > 0 GROUP BY line_id""")
def split_axes(spark, d):
    r = _rings(spark, d).select("line_id", measures.split_axes(F.col("ring")).alias("a"))

    def total(c: str):
        return F.round(F.aggregate("a", F.lit(0.0), lambda s, v: s + v[c]), 6)

    return r.select("line_id", F.size("a").cast("long").alias("n"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@query(""", q AS (SELECT field_id, weed_id, (minx + maxx) / 2 * 0.6::DOUBLE + (miny + maxy) / 2 * 0.8::DOUBLE AS position FROM clip)
 SELECT field_id, weed_id, round(position, 6) AS position, row_number() OVER (PARTITION BY field_id ORDER BY position, weed_id) AS nth FROM q""")
def axis_projection(spark, d):
    q = clip(spark, d).selectExpr("field_id", "weed_id", "(minx + maxx) / 2 as cx", "(miny + maxy) / 2 as cy")
    return paths.along_axis(q, "field_id", "cx", "cy", (0.6, 0.8), "weed_id").select("field_id", "weed_id", F.round("position", 6).alias("position"), F.col("nth").cast("long").alias("nth"))


@query(""", o AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY line_id) AS n FROM route),
 t AS (SELECT b.line_id, b.x, (b.x - a.x) * (c.y - b.y) - (b.y - a.y) * (c.x - b.x) AS z, b.x * c.y - c.x * b.y AS s FROM o b JOIN o a ON a.line_id = b.line_id AND a.i = (b.i + b.n - 2) % b.n + 1 JOIN o c ON c.line_id = b.line_id AND c.i = b.i % b.n + 1),
 u AS (SELECT *, sum(s) OVER (PARTITION BY line_id) AS area FROM t)
 SELECT line_id, count(CASE WHEN CASE WHEN area > 0 THEN z < -1e-9 ELSE z > 1e-9 END THEN 1 END) AS n, round(coalesce(sum(CASE WHEN CASE WHEN area > 0 THEN z < -1e-9 ELSE z > 1e-9 END THEN round_even(x / 0.5, 0) * 0.5 END), 0), 3) AS total FROM u GROUP BY line_id""")
def reflex_splits(spark, d):
    r = _rings(spark, d).select("line_id", measures.reflex_positions(F.col("ring"), 0.5).alias("p"))
    return r.select("line_id", F.size("p").cast("long").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


# ---- projections
@query("SELECT event_id, round(lon, 6) AS lon, round(lat, 6) AS lat, true AS same, round(6378137.0 * radians(lon), 3) AS mercator_x, round(6378137.0 * asinh(tan(radians(lat))), 3) AS mercator_y FROM places")
def projection_round_trip(spark, d):
    """There and back through the kernel's UTM, its agreement with the column functions, and spherical Mercator."""
    kernel.load(spark)
    p = _table(spark, d, "events", PLACES).withColumn("g", call("FromWkt", F.format_string("POINT (%s %s)", F.col("lon").cast("string"), F.col("lat").cast("string"))))
    zone, south = crs.zone(F.col("lon")), F.col("lat") < 0
    m = p.withColumns({"m": call("Project", "g", zone, south, F.lit(False)), "z": zone, "s": south, "w": call("Project", "g", F.lit(0), F.lit(False), F.lit(False))})
    m = m.withColumn("b", call("Project", "m", F.col("z"), F.col("s"), F.lit(True)))
    e, n = crs.forward(F.col("lon"), F.col("lat"), F.col("z"), F.col("s"))
    near = (F.abs(call("Measure", "m", F.lit("cx")) - e) < 1e-5) & (F.abs(call("Measure", "m", F.lit("cy")) - n) < 1e-5)
    out = [F.round(call("Measure", g, F.lit(c)), k).alias(a) for g, c, k, a in (("b", "cx", 6, "lon"), ("b", "cy", 6, "lat"), ("w", "cx", 3, "mercator_x"), ("w", "cy", 3, "mercator_y"))]
    return m.select("event_id", *out, near.alias("same"))


@query("SELECT event_id, round(lon, 6) AS lon, round(lat, 6) AS lat, round(lon, 6) AS mid_lon, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(greatest(CAST(floor((lon + 180) / 6) AS INTEGER) + 1, 1), 60) AS own_zone FROM places")
def source_crs(spark, d):
    """Features in five kinds of systems come out in degrees, whatever their file's `crs` says; and the zone of each one's own middle."""
    kernel.load(spark)
    p = _table(spark, d, "events", PLACES)
    zone, south = crs.zone(F.col("lon")), F.col("lat") < 0
    e, n = crs.forward(F.col("lon"), F.col("lat"), zone, south)
    code = (F.when(south, 32700).otherwise(32600) + zone).cast("string")
    kind = F.col("event_id") % 5
    name = F.when(kind == 1, "urn:ogc:def:crs:OGC:1.3:CRS84").when(kind == 2, F.concat(F.lit("EPSG:"), code)).when(kind == 3, F.concat(F.lit("urn:ogc:def:crs:EPSG::"), code)).when(kind == 4, "EPSG:3857")
    x = F.when(kind.isin(2, 3), e).when(kind == 4, 6378137.0 * F.radians("lon")).otherwise(F.col("lon"))
    y = F.when(kind.isin(2, 3), n).when(kind == 4, 6378137.0 * F.asinh(F.tan(F.radians("lat")))).otherwise(F.col("lat"))
    f = p.select("event_id", F.to_json(F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))).alias("geometry"), name.alias("crs"))
    g = geojson.lonlat(f, repair=False).select("event_id", *[call("Measure", "g", F.lit(c)).alias(c) for c in ("cx", "cy")])
    return g.select("event_id", F.round("cx", 6).alias("lon"), F.round("cy", 6).alias("lat"), F.round("cx", 6).alias("mid_lon"), crs.utm_epsg(F.round("cx", 6), F.round("cy", 6), clamp=True).cast("int").alias("own_zone"))


# ---- collections
_BOX = "CAST(event_id % 500 AS DOUBLE) / 1000 - 35 AS lon, CAST(event_id % 300 AS DOUBLE) / 1000 - 6 AS lat"


def feature_texts(spark, d, block: int = 10_000) -> DataFrame:
    """(file, part, text): seven collections, in texts of at most `block` features each, with boxes, two-part boxes, lines, nulls, boxes off the globe, and things that are no features."""
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "user_id % 7 as file", *_BOX.split(", "))

    def ring(x, y) -> Column:
        corners = [(x, y), (x + 0.0005, y), (x + 0.0005, y + 0.0005), (x, y + 0.0005), (x, y)]
        return F.concat(F.lit("[["), F.concat_ws(",", *[F.concat(F.lit("["), a.cast("decimal(12,4)").cast("string"), F.lit(","), b.cast("decimal(12,4)").cast("string"), F.lit("]")) for a, b in corners]), F.lit("]]"))

    lon, lat = F.col("lon"), F.col("lat")
    box = F.concat(F.lit('{"type":"Polygon","coordinates":'), ring(lon, lat), F.lit("}"))
    two = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), ring(lon, lat), F.lit(","), ring(lon + 0.01, lat), F.lit("]}"))
    off = F.concat(F.lit('{"type":"Polygon","coordinates":'), ring(lon + 400, lat), F.lit("}"))
    n = F.col("event_id")
    g = F.when(n % 11 == 0, off).when(n % 13 == 0, '{"type":"Point","coordinates":"none"}').when(n % 17 == 0, "null").when(n % 5 == 0, two).otherwise(box)
    f = F.when(n % 19 == 0, "7").otherwise(F.concat(F.lit('{"type":"Feature","properties":{"id":'), n.cast("string"), F.lit('},"geometry":'), g, F.lit("}")))
    part = F.floor(n / block).alias("part")
    files = e.withColumn("f", f).groupBy("file", part).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "f"))), lambda v: v["f"]).alias("fs"))
    kind = F.when(F.col("file") == 3, '"FeatureCollection","features":7}').otherwise(F.concat(F.lit('"FeatureCollection","features":['), F.array_join("fs", ","), F.lit("]}")))
    return files.select(F.col("file").cast("int").alias("file"), "part", F.concat(F.lit('{"type":'), kind).alias("text"))


_FEATURES = f""", e AS (SELECT event_id, CAST(user_id % 7 AS INTEGER) AS file, {_BOX}, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) - 1 AS pos FROM events),
 f AS (SELECT * FROM e WHERE file <> 3 AND event_id % 19 <> 0 AND NOT (event_id % 17 = 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0))"""


@query(_FEATURES + " SELECT file, CAST(pos AS INTEGER) AS pos, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 11 = 0 THEN 'Polygon' WHEN event_id % 13 = 0 THEN 'Point' WHEN event_id % 5 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind FROM f")
def load_features(spark, d):
    """All files' features in order, without null geometries, things that are no features, and the file that is no collection."""
    f = geojson.parse(feature_texts(spark, d))
    return f.select("file", "pos", geojson.feature_id(F.col("properties")).alias("id"), F.get_json_object("geometry", "$.type").alias("kind"))


@query(_FEATURES + """, g AS (SELECT *, unnest(CASE WHEN event_id % 5 = 0 THEN [0, 1] ELSE [0] END) AS part FROM f WHERE event_id % 11 <> 0 AND event_id % 13 <> 0)
 SELECT row_number() OVER (ORDER BY file, pos, part) - 1 AS ord, round(lon + part * 0.01, 6) AS minx, round(lat, 6) AS miny FROM g""")
def extract_polygons(spark, d):
    """Polygons of the collections in metres, numbered in order; here back in degrees."""
    kernel.load(spark)
    x = treatment.extract(geojson.parse(feature_texts(spark, d)), 25, True)
    back = call("Project", "geom", F.lit(25), F.lit(True), F.lit(True))
    return x.select("ord", *[F.round(call("Measure", back, F.lit(c)), 6).alias(c) for c in ("minx", "miny")])


@query(_FEATURES + """, b AS (SELECT file, round(min(CASE WHEN event_id % 11 = 0 THEN lon + 400 ELSE lon END), 4) AS minx, round(max(CASE WHEN event_id % 11 = 0 THEN lon + 400 WHEN event_id % 5 = 0 THEN lon + 0.01 ELSE lon END) + 0.0005, 4) AS maxx, round(min(lat), 4) AS miny, round(max(lat) + 0.0005, 4) AS maxy
  FROM f WHERE event_id % 11 = 0 OR event_id % 13 <> 0 GROUP BY file) SELECT *, round((miny + maxy) / 2, 6) AS lat, round((minx + maxx) / 2, 6) AS lon FROM b""")
def collection_extent(spark, d):
    """Bounds and middle of each collection."""
    kernel.load(spark)
    x = geojson.extent(geojson.parse(feature_texts(spark, d)))
    return x.select("file", *[F.round(c, 4).alias(c) for c in ("minx", "miny", "maxx", "maxy")], *[F.round(c, 6).alias(c) for c in ("lat", "lon")])


@query("SELECT 32725 AS epsg, 25 AS first_zone, 32723 AS given")
def working_crs(spark, d):
    """The zone of the first detection that parses, and a given system."""
    kernel.load(spark)
    f = geojson.parse(feature_texts(spark, d))
    zone, south = treatment.working_zone(f, PlanConfig())
    given = treatment.working_zone(f, PlanConfig(working_crs="EPSG:32723"))
    return spark.range(1).select(F.lit(32600 + 100 * south + zone).alias("epsg"), F.lit(zone).alias("first_zone"), F.lit(32600 + 100 * given[1] + given[0]).alias("given"))


@query("SELECT CAST(field_id AS BIGINT) AS field_id, count(*) AS weeds FROM clip GROUP BY field_id UNION ALL SELECT f.field_id, 0 FROM fields f WHERE f.field_id NOT IN (SELECT field_id FROM clip)")
def weed_counts(spark, d):
    """Detections that meet each field, by exact intersection."""
    kernel.load(spark)
    w, f = rect(weeds(spark, d)), rect(fields(spark, d)).withColumnRenamed("field_id", "ord")
    return reports.weed_counts(w, f).select(F.col("ord").alias("field_id"), "weeds")
