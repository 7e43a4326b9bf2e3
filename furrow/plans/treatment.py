"""From detections, fields and obstacles to treatment polygons: one lazy plan.

Rows carry WKB and ordinals.  Shuffles: equal detections, the grid join of detections with fields, the clusters of a
field, the polygons of a cluster, and the grid join of a field's polygons.  What the kernel cannot
work on costs its own field only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow import kernel
from furrow.config import SLIVER_ANGLE_DEG, SLIVER_AREA_M2, SMALL_PIECE_METHODS, PlanConfig
from furrow.functions import crs
from furrow.kernel import call
from furrow.operators.spatial_join import BOUNDS, overlapping

MIN_PIECE, MIN_OUTPUT = 0.01, 0.0001


def bounded(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.withColumns({b: call("Measure", geom, F.lit(b)) for b in BOUNDS})


def extract(features: DataFrame, zone: int, south: bool, fix: bool = True) -> DataFrame:
    """(ord, geom, minx..maxy): valid polygons of features in metres, numbered in order.

    Multi-part geometries are taken apart; a part is dropped if its first vertex is off the globe, or without area.
    """
    x = features.select("file", "pos", call("Repair", call("FromJson", "geometry"), F.lit(fix)).alias("g"))
    x = x.select("file", "pos", F.posexplode(call("Polygons", "g")).alias("part", "g"))
    first = F.get(call("Points", "g"), 0)
    x = x.where(F.get(first, 0).between(-180, 180) & F.get(first, 1).between(-90, 90))
    x = x.withColumn("geom", call("Project", "g", F.lit(zone), F.lit(south), F.lit(False))).where(call("Measure", "geom", F.lit("area")) > 0)
    return bounded(numbered(x.select("file", "pos", "part", "geom"), ["file", "pos", "part"]).select("ord", "geom"))


def numbered(df: DataFrame, keys: list[str], block: int = 4096) -> DataFrame:
    """Row numbers from 0 in the order of keys, without one task for all rows or a file's: counts per block of the second key first, then within blocks."""
    x = df.withColumn("_block", F.floor(F.col(keys[1]) / block))
    place, rest = [keys[0], "_block"], [c for c in df.columns if c not in keys]
    x = x.withColumn("_nth", F.row_number().over(Window.partitionBy(*place).orderBy(*keys[1:])))
    # counting with all columns keeps the shuffle the same for both sides, so that Spark runs what is before it once
    n = F.max(F.when(F.struct(*rest).isNotNull() & F.hash(*rest).isNotNull(), F.col("_nth")))
    before = x.groupBy(place).agg(n.alias("_n")).select(*place, (F.sum("_n").over(Window.orderBy(*place)) - F.col("_n")).alias("_before"))
    return x.join(before, place).withColumn("ord", (F.col("_before") + F.col("_nth") - 1).cast("long")).drop("_before", "_nth", "_block")


def working_zone(weeds: DataFrame, cfg: PlanConfig) -> tuple[int, bool]:
    """(UTM zone, south) of the configured CRS, else of the first detection that parses."""
    if cfg.working_crs is not None:
        return crs.parse_epsg(cfg.working_crs)
    g = weeds.select("file", "pos", call("FromJson", "geometry").alias("g")).where("g is not null")
    one = g.select(F.min_by(F.struct(call("Measure", "g", F.lit("cx")).alias("x"), call("Measure", "g", F.lit("cy")).alias("y")), F.struct("file", "pos")).alias("c"))
    return crs.parse_epsg(one.select(crs.utm_epsg(F.col("c.x"), F.col("c.y"))).first()[0])


def collapsed(polygons: DataFrame) -> DataFrame:
    """(ord, geom, minx..maxy, copies): equal polygons as one row, with the first one's place and their number.

    No method's result depends on copies, but for the axis over all vertices, which counts them.
    """
    return polygons.groupBy("geom", *BOUNDS).agg(F.min("ord").alias("ord"), F.count("*").alias("copies"))


def clip_to_fields(weeds: DataFrame, fields: DataFrame, cell: float = 200.0) -> DataFrame:
    """(field, ord, geom, copies): parts of collapsed detections inside fields, in the detections' order."""
    j = overlapping(weeds, fields, cell).where(call("Relate", "l_geom", "r_geom", F.lit("intersects")))
    g = call("Repair", call("Overlay", "l_geom", "r_geom", F.lit("intersection")), F.lit(True))
    x = j.select(F.col("r_ord").alias("field"), F.col("l_ord").alias("weed"), F.col("l_copies").alias("copies"), F.posexplode(call("Polygons", g)).alias("part", "geom"))
    return x.withColumn("ord", F.row_number().over(Window.partitionBy("field").orderBy("weed", "part"))).select("field", "ord", "geom", "copies")


def clusters(parts: DataFrame, distance: float, quad_segs: int) -> DataFrame:
    """parts with `cluster`: connected regions of a field's polygons grown by half the distance; null geom where a field's geometry is broken."""
    parts = _counted(parts)
    if distance <= 0:
        return parts.withColumn("cluster", F.col("ord").cast("int"))
    g = parts.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("ord", "geom", "copies"))).alias("p"))
    label = call("Cluster", F.transform("p", lambda v: v["geom"]), F.lit(float(distance)), F.lit(quad_segs))
    g = g.withColumn("label", label)
    rows = F.when(F.col("label").isNotNull(), F.zip_with("p", "label", lambda v, c: F.struct(v["ord"].alias("ord"), v["geom"].alias("geom"), v["copies"].alias("copies"), c.alias("cluster"))))
    none = F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.lit(None).cast("binary").alias("geom"), F.lit(1).cast("long").alias("copies"), F.lit(-1).alias("cluster")))
    return g.select("field", F.explode(F.coalesce(rows, none)).alias("z")).select("field", "z.ord", "z.geom", "z.copies", "z.cluster")


def _counted(parts: DataFrame) -> DataFrame:
    return parts if "copies" in parts.columns else parts.withColumn("copies", F.lit(1).cast("long"))


def cover(parts: DataFrame, cfg: PlanConfig) -> DataFrame:
    """(field, cluster, piece, geom): the method's polygons of each cluster.

    A field with a geometry that the kernel cannot work on is left out, the others are not touched.
    """
    parameters = F.array(*[F.lit(x) for x in cfg.cover_parameters()])
    # collect_list leaves nulls out, so geometries travel in a struct
    g = _counted(parts).groupBy("field", "cluster").agg(F.array_sort(F.collect_list(F.struct("ord", "geom", "copies"))).alias("v"))
    g = g.select("field", "cluster", F.transform("v", lambda v: v["geom"]).alias("p"), F.transform("v", lambda v: v["copies"]).alias("n"))
    shapes = g.withColumn("shapes", call("CoverCopies", F.lit(cfg.coverage_method), "p", "n", parameters))
    shapes = shapes.withColumn("broken", F.max(F.col("shapes").isNull()).over(Window.partitionBy("field"))).where("not broken")
    return shapes.select("field", "cluster", F.posexplode("shapes").alias("piece", "geom"))


def resolve_overlaps(pieces: DataFrame, min_area: float, cell: float = 100.0) -> DataFrame:
    """Each polygon of a field less all larger ones (ties: earlier ones), then without small parts and slivers.

    Subtracting the originals makes every polygon independent of the others' results: a grid join of
    the field's polygons whose boxes meet, and one union per polygon.
    Areas are ranked and taken away to a millionth of a metre, since small pieces stand or fall by their sharpest
    corner, and without that the last bits of an edge would make one.
    """
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc(F.round(call("Measure", "geom", F.lit("area")), 6)), "cluster", "piece"))
    x = bounded(pieces.withColumn("rank", rank))
    pairs = overlapping(x.select("field", "rank", *BOUNDS), x.select("field", "rank", "geom", *BOUNDS), cell, on=("field",)).where("r_rank < l_rank")
    masks = pairs.groupBy(F.col("l_field").alias("field"), F.col("l_rank").alias("rank")).agg(call("Union", F.collect_list("r_geom")).alias("mask"))
    y = x.join(masks, ["field", "rank"], "left").select("field", "rank", call("Repair", call("Less", "geom", "mask"), F.lit(True)).alias("g"))
    y = y.select("field", "rank", F.posexplode(call("Polygons", "g")).alias("part", "geom")).withColumn("area", call("Measure", "geom", F.lit("area")))
    sliver = (F.col("area") <= SLIVER_AREA_M2) & (call("Measure", "geom", F.lit("min_angle")) < SLIVER_ANGLE_DEG)
    return y.where((F.col("area") > MIN_PIECE) & (F.col("area") >= min_area) & ~sliver).drop("area")


def treat(weeds: DataFrame, fields: DataFrame, obstacles: DataFrame, cfg: PlanConfig) -> DataFrame:
    """(field, rank, part, geom) in metres from polygons in metres (ord, geom, minx..maxy)."""
    clipped = clip_to_fields(collapsed(weeds), fields)
    grown = call("Repair", call("Buffer", "geom", F.lit(float(cfg.weed_buffer_m)), F.lit(cfg.quad_segs), F.lit("round")), F.lit(cfg.fix_invalid_geometries))
    parts = clipped.select("field", "ord", "copies", F.posexplode(call("Polygons", grown)).alias("k", "geom"))
    parts = parts.withColumn("ord", F.row_number().over(Window.partitionBy("field").orderBy("ord", "k"))).drop("k")
    shapes = cover(clusters(parts, cfg.merge_distance_m, cfg.quad_segs), cfg)
    shapes = shapes.withColumn("geom", call("Repair", "geom", F.lit(cfg.fix_invalid_geometries)))
    if cfg.negative_buffer_m > 0:
        shapes = shapes.withColumn("geom", call("Buffer", "geom", F.lit(-float(cfg.negative_buffer_m)), F.lit(cfg.quad_segs), F.lit("round")))
    near = overlapping(obstacles, fields, 200.0).where(call("Relate", "l_geom", "r_geom", F.lit("intersects")))
    keep_off = call("Buffer", "l_geom", F.lit(float(cfg.obstacle_safety_buffer_m)), F.lit(cfg.quad_segs), F.lit("mitre"))
    banned = near.select(F.col("r_ord").alias("field"), keep_off.alias("o")).groupBy("field").agg(call("Union", F.collect_list("o")).alias("banned"))
    shapes = shapes.join(banned, "field", "left").withColumn("geom", call("Repair", call("Overlay", "geom", "banned", F.lit("difference")), F.lit(True)))
    inside = fields.select(F.col("ord").alias("field"), F.col("geom").alias("bound"))
    g = call("Repair", call("Overlay", "geom", "bound", F.lit("intersection")), F.lit(True))
    pieces = shapes.join(inside, "field").select("field", "cluster", "piece", F.posexplode(call("Polygons", g)).alias("k", "geom"))
    least = 0.0 if cfg.coverage_method in SMALL_PIECE_METHODS else float(cfg.min_polygon_area_m2)
    area = call("Measure", "geom", F.lit("area"))
    pieces = pieces.where((area > MIN_PIECE) & (area >= least)).withColumn("piece", F.col("piece") * 100_000 + F.col("k"))
    return resolve_overlaps(pieces, least)


def output_rows(treated: DataFrame, zone: int, south: bool, cfg: PlanConfig) -> DataFrame:
    """geometry (GeoJSON, one polygon or multi-polygon a field), field_id, field_name, area_m2, merge_distance_m, coverage_method."""
    g = treated.groupBy("field").agg(call("Union", F.transform(F.array_sort(F.collect_list(F.struct("rank", "part", "geom"))), lambda v: v["geom"])).alias("m"))
    g = g.withColumn("w", call("Repair", call("Project", "m", F.lit(zone), F.lit(south), F.lit(True)), F.lit(True)))
    area = call("Measure", call("Project", "w", F.lit(zone), F.lit(south), F.lit(False)), F.lit("area"))
    rows = g.where(area > MIN_OUTPUT)
    return rows.select(call("ToJson", "w").alias("geometry"), F.col("field").cast("int").alias("field_id"), F.format_string("Field %d", F.col("field") + 1).alias("field_name"), F.bround(area, 4).alias("area_m2"), F.lit(round(cfg.merge_distance_m, 1)).alias("merge_distance_m"), F.lit(cfg.coverage_method).alias("coverage_method"))


def generate(weeds: DataFrame, obstacles: DataFrame, fields: DataFrame, cfg: PlanConfig) -> DataFrame:
    """Output rows from GeoJSON features (file, pos, geometry, properties)."""
    kernel.load(weeds.sparkSession)
    zone, south = working_zone(weeds, cfg)
    w, o, f = (extract(x, zone, south, cfg.fix_invalid_geometries) for x in (weeds, obstacles, fields))
    return output_rows(treat(w, f, o, cfg), zone, south, cfg)


def bounds_of(boxes: DataFrame, key: str) -> DataFrame:
    """(key, minx, miny, maxx, maxy, n): envelope of each key's boxes; needs no union."""
    least: list[Column] = [F.min(c).alias(c) for c in ("minx", "miny")]
    return boxes.groupBy(key).agg(*least, *[F.max(c).alias(c) for c in ("maxx", "maxy")], F.count("*").alias("n"))
