"""Flight lines, geometric metrics, overlap reports and the sensitivity sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.kernel import call
from furrow.operators.paths import straight_runs, turn_stats


def flight_lines(fields: DataFrame, obstacles: DataFrame | None, distance: float = 2.0, angle: float = 0.0) -> DataFrame:
    """(field, part, line): one zigzag line for each polygon of the fields' union less the obstacles that meet it.

    fields and obstacles: (field, geom) in metres; obstacles carry the field that they may lie in.
    """
    if distance <= 0 or not 0 <= angle < 360:
        raise ValueError("distance must be above 0 and angle from 0 to below 360")
    whole = fields.groupBy("field").agg(call("Union", F.collect_list("geom")).alias("geom"))
    if obstacles is not None:
        o = obstacles.withColumnRenamed("geom", "o").join(whole, "field").where(call("Relate", "geom", "o", F.lit("intersects")))
        whole = whole.join(o.groupBy("field").agg(call("Union", F.collect_list("o")).alias("mask")), "field", "left")
        whole = whole.select("field", call("Repair", call("Overlay", "geom", "mask", F.lit("difference")), F.lit(True)).alias("geom"))
    parts = whole.select("field", F.posexplode(call("Polygons", "geom")).alias("part", "geom"))
    return parts.select("field", "part", call("Route", "geom", F.lit(float(distance)), F.lit(float(angle))).alias("line"))


def line_points(lines: DataFrame) -> DataFrame:
    """(line_id, seq, x, y) of (line_id, line)."""
    p = lines.select("line_id", F.posexplode(call("Points", "line")).alias("seq", "p"))
    return p.select("line_id", "seq", F.get("p", 0).alias("x"), F.get("p", 1).alias("y"))


def geometric_metrics(polygons: DataFrame, lines: DataFrame, swath: float = 2.0) -> DataFrame:
    """One row per method from (method, field, geom) and (method, field, part, line), in metres.

    Turns are those inside lines and one between each two lines of a field; corridors are lines
    buffered by half the swath with flat ends.  Lines without length count for nothing.
    """
    area, perimeter = call("Measure", "geom", F.lit("area")), call("Measure", "geom", F.lit("perimeter"))
    p = polygons.groupBy("method", "field").agg(F.count("*").alias("n"), F.sum(area).alias("area"), F.sum(perimeter).alias("perimeter"), call("Union", F.collect_list("geom")).alias("target"))
    some = lines.where(call("Measure", "line", F.lit("length")) > 0)
    corridor = call("Buffer", "line", F.lit(swath / 2), F.lit(4), F.lit("flat"))
    c = some.groupBy("method", "field").agg(F.count("*").alias("n_lines"), call("Union", F.collect_list(corridor)).alias("corridor"))
    runs = straight_runs(line_points(some.select(F.struct("method", "field", "part").alias("line_id"), "line")))
    r = runs.groupBy("line_id").agg(F.max("run").alias("turns"), F.sum("length").alias("s"), F.sum(F.col("length") ** 2).alias("ss"), F.count("*").alias("k"))
    r = r.groupBy(F.col("line_id.method").alias("method"), F.col("line_id.field").alias("field")).agg(*[F.sum(x).alias(x) for x in ("turns", "s", "ss", "k")])
    x = p.join(c, ["method", "field"], "left").join(r, ["method", "field"], "left").where("corridor is not null")
    hit = F.coalesce(call("Measure", call("Overlay", "corridor", "target", F.lit("intersection")), F.lit("area")), F.lit(0.0))
    miss = F.coalesce(call("Measure", call("Overlay", "corridor", "target", F.lit("difference")), F.lit("area")), F.lit(0.0))
    x = x.withColumns({"hit": hit, "miss": miss, "own": call("Measure", "target", F.lit("area")), "turns": F.col("turns") + F.col("n_lines") - 1})
    t = x.groupBy("method").agg(*[F.sum(n).alias(n) for n in ("n", "area", "perimeter", "turns", "s", "ss", "k", "hit", "miss", "own")])
    mean = F.col("s") / F.col("k")

    def rate(a: str, b: str, scale: float = 1.0):
        return F.coalesce(F.try_divide(F.col(a) * scale, F.col(b)), F.lit(0.0))

    return t.select("method", F.col("n").alias("num_polygons"), (F.col("area") / 1e4).alias("total_area_ha"), rate("area", "perimeter").alias("area_perimeter_ratio"), F.coalesce(mean, F.lit(0.0)).alias("mean_straight_length_m"), F.coalesce(F.sqrt(F.greatest(F.col("ss") / F.col("k") - mean * mean, F.lit(0.0))), F.lit(0.0)).alias("std_straight_length_m"), F.col("turns").cast("long").alias("num_turns"), rate("turns", "area", 1e4).alias("turns_per_ha"), rate("hit", "own", 100).alias("target_coverage_pct"), rate("miss", "own", 100).alias("clean_area_waste_pct"))


SPRAY = "spray"


def spray_lines(lines: DataFrame, group: list[str]) -> DataFrame:
    """The lines of type `spray` (any case) of each group; all of a group that has none."""
    own = F.coalesce(F.lower("line_type") == SPRAY, F.lit(False))
    some = F.max(own).over(Window.partitionBy(*group))
    return lines.withColumns({"_own": own, "_some": some}).where("_own or not _some").drop("_own", "_some")


def common_groups(polygons: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with `field`: kept for methods whose polygons and lines have the same ids (nulls aside), else 0 for all rows of the method.

    Ids are compared as rows: a method is uneven if an id of it has polygons only or lines only.
    """
    ids = [x.where("field is not null").select("method", "field").distinct() for x in (polygons, lines)]
    both = ids[0].withColumn("p", F.lit(1)).join(ids[1].withColumn("l", F.lit(1)), ["method", "field"], "full")
    even = both.groupBy("method").agg((F.count_if(F.col("p").isNull() | F.col("l").isNull()) == 0).alias("even"))

    def keyed(x: DataFrame) -> DataFrame:
        x = x.join(even, "method", "left").withColumn("even", F.coalesce("even", F.lit(False)))
        return x.where("not even or field is not null").withColumn("field", F.when(F.col("even"), F.col("field")).otherwise(F.lit(0))).drop("even")

    return keyed(polygons), keyed(lines)


def weed_capture(layers: DataFrame, weeds: DataFrame) -> DataFrame:
    """(method, weed_capture_pct): the share of the weeds' area that each method's polygons cover, from (method, geom) and (geom).

    A report over one survey: the weeds' union is one row.
    """
    whole = weeds.agg(call("Union", F.collect_list("geom")).alias("all_weeds"))
    u = layers.groupBy("method").agg(call("Union", F.collect_list("geom")).alias("g"))
    hit = F.coalesce(call("Measure", call("Overlay", "g", "all_weeds", F.lit("intersection")), F.lit("area")), F.lit(0.0))
    return u.crossJoin(F.broadcast(whole)).select("method", F.coalesce(F.try_divide(hit * 100, call("Measure", "all_weeds", F.lit("area"))), F.lit(0.0)).alias("weed_capture_pct"))


def iou_report(layers: DataFrame) -> DataFrame:
    """Overlap of every two methods of (method, geom), all in one projection; one row of geometry per method."""
    u = layers.groupBy("method").agg(call("Union", F.collect_list("geom")).alias("g")).withColumn("area", call("Measure", "g", F.lit("area")))
    a = u.select(F.col("method").alias("method1"), F.col("g").alias("g1"), F.col("area").alias("area1_m2"))
    b = u.select(F.col("method").alias("method2"), F.col("g").alias("g2"), F.col("area").alias("area2_m2"))
    both = F.coalesce(call("Measure", call("Overlay", "g1", "g2", F.lit("intersection")), F.lit("area")), F.lit(0.0))
    x = a.join(b, F.col("method1") < F.col("method2")).withColumn("both", both)
    iou = F.coalesce(F.try_divide(F.col("both"), F.col("area1_m2") + F.col("area2_m2") - F.col("both")), F.lit(0.0))
    return x.select("method1", "method2", iou.alias("iou"), F.coalesce(F.try_divide(F.col("both") * 100, F.col("area1_m2")), F.lit(0.0)).alias("agreement_m1_in_m2_pct"), "area1_m2", "area2_m2")


def sensitivity(weeds: DataFrame, rhos: list[float], depths: list[int], merge_distance: float = 5.0, swath: float = 3.0) -> DataFrame:
    """Rotated-rectangle runs over (file, ord, geom) for every rho and depth: area, polygons, coverage, overlap, turns, lengths.

    A file's geometry goes to one row per depth.  There the rhos are swept in turn; most change nothing,
    so that only the different results (with the range of rhos that they hold for) are measured.
    """
    spark = weeds.sparkSession
    rhos = sorted(float(r) for r in rhos)
    grid = spark.createDataFrame([(int(d),) for d in depths], "max_depth int")
    g = weeds.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "geom"))), lambda v: v["geom"]).alias("p"))
    swept = call("Sweep", "p", F.array(*map(F.lit, rhos)), F.col("max_depth"), F.lit(float(merge_distance)))
    x = g.crossJoin(F.broadcast(grid)).repartition("file", "max_depth").select("file", "max_depth", call("Union", "p").alias("truth"), swept.alias("shapes"))
    own = F.filter(F.transform("shapes", lambda v, i: F.struct(i.alias("first"), v.alias("shape"))), lambda v: v["shape"].isNotNull())
    own = F.transform(own, lambda v, k: F.struct(v["first"].alias("first"), F.coalesce(F.get(own, k + 1)["first"], F.lit(len(rhos))).alias("stop"), v["shape"].alias("shape")))
    x = x.select("file", "max_depth", "truth", F.explode(own).alias("o")).select("file", "max_depth", "truth", "o.first", "o.stop", "o.shape")
    both = call("Measure", call("Overlay", "shape", "truth", F.lit("intersection")), F.lit("area"))
    x = x.withColumns({"a": call("Measure", "shape", F.lit("area")), "t": call("Measure", "truth", F.lit("area")), "both": both}).drop("truth")
    key = ["file", "max_depth", "first"]
    r = call("Points", call("Shape", "geom", F.lit("rectangle")))

    def side(i: int):
        return F.get(F.get(r, i + 1), 0) - F.get(F.get(r, i), 0), F.get(F.get(r, i + 1), 1) - F.get(F.get(r, i), 1)

    (ax, ay), (bx, by) = side(0), side(1)
    longer = F.hypot(ax, ay) >= F.hypot(bx, by)
    angle = F.pmod(F.degrees(F.atan2(F.when(longer, ay).otherwise(by), F.when(longer, ax).otherwise(bx))), F.lit(180.0))
    # one pass: parts of a shape, their lines and turns, and back to one row per shape
    parts = x.select(*key, "stop", "a", "t", "both", F.posexplode_outer(call("Polygons", "shape")).alias("part", "geom"))
    parts = parts.withColumn("points", call("Points", call("Route", "geom", F.lit(float(swath)), angle)))
    parts = parts.withColumn("flown", turn_stats(F.col("points")))
    ends = F.when(F.col("flown").isNotNull(), F.struct("part", F.element_at("points", 1).alias("first"), F.element_at("points", -1).alias("last")))
    y = parts.groupBy(*key, "stop").agg(
        *[F.first(c).alias(c) for c in ("a", "t", "both")],
        F.count("part").alias("count"),
        (F.sum("flown.turns") + F.count("flown") - 1).alias("turns"),
        F.sum("flown.length").alias("s"),
        F.sum("flown.runs").alias("k"),
        F.array_sort(F.collect_list(ends)).alias("ends"),
    )
    n = F.greatest(F.size("ends") - 1, F.lit(0))
    hops = F.zip_with(F.slice("ends", 1, n), F.slice("ends", 2, n), lambda p, q: F.hypot(F.get(q["first"], 0) - F.get(p["last"], 0), F.get(q["first"], 1) - F.get(p["last"], 1)))
    y = y.withColumn("hop", F.aggregate(hops, F.lit(0.0), lambda a, v: a + v)).drop("ends")
    rho = F.get(F.array(*map(F.lit, rhos)), F.col("i"))
    y = y.withColumn("i", F.explode(F.sequence("first", F.col("stop") - 1))).withColumn("rho_min", rho)
    y = y.groupBy("rho_min", "max_depth").agg(*[F.sum(c).alias(c) for c in ("a", "t", "both", "count", "turns", "s", "k", "hop")])
    return y.select("rho_min", "max_depth", (F.col("a") / 1e4).alias("total_area_ha"), F.col("count").alias("final_polygon_count"), F.coalesce(F.try_divide(F.col("both") * 100, F.col("t")), F.lit(0.0)).alias("coverage_pct"), F.coalesce(F.try_divide(F.col("both") * 100, F.col("a") + F.col("t") - F.col("both")), F.lit(0.0)).alias("iou_pct"), F.col("turns").cast("long").alias("total_turns"), (F.col("s") / F.col("k")).alias("mean_straight_line_m"), ((F.col("s") + F.col("hop")) / 1e3).alias("total_flight_length_km"))


def sensitivity_panels(swept: DataFrame) -> DataFrame:
    """(panel, rho_min, max_depth, value): the four curves by depth that a plot of sensitivity() shows."""
    panels = {"total_area_ha": F.col("total_area_ha"), "final_polygon_count": F.col("final_polygon_count").cast("double"), "iou_pct": F.col("iou_pct"), "total_flight_length_m": F.col("total_flight_length_km") * 1000}
    values = F.array(*[F.struct(F.lit(k).alias("panel"), v.alias("value")) for k, v in panels.items()])
    return swept.select("rho_min", "max_depth", F.explode(values).alias("v")).select("v.panel", "rho_min", "max_depth", "v.value")
