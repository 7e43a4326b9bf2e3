"""Tables behind the views: field information, dashboard, map layers and the list of methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.config import ALIASES, METHODS
from furrow.functions.text import fixed, html_text, polygon_label
from furrow.kernel import call
from furrow.operators.spatial_join import overlapping

# The order in which methods are offered, their labels, and the parameters that each has of its own.
OFFERED = ("mrr", "bcd", "fixed-grid", "quadtree", "strip-based", "convex-hull", "concave-hull", "aabb", "morph-closing")
LABELS = {
    "mrr": "MRR", "bcd": "Boustrophedon", "fixed-grid": "Fixed Grid", "quadtree": "Quadtree", "strip-based": "Strips",
    "convex-hull": "Convex Hull", "concave-hull": "Concave Hull", "aabb": "AABB", "morph-closing": "Morphological Closing",
}
PARAMETERS = {
    "fixed-grid": ["grid_cell_size_m", "grid_fill_threshold"],
    "quadtree": ["quadtree_min_cell_size_m", "quadtree_fill_threshold"],
    "concave-hull": ["alpha_shape_radius_m"],
    "strip-based": ["strip_width_m", "strip_fill_threshold"],
}
COLOURS = 8


def catalog(spark: SparkSession) -> DataFrame:
    """(place, key, label, parameters, aliases): supported methods, the offered ones first, others by name."""
    order = [m for m in OFFERED if m in METHODS] + sorted(set(METHODS) - set(OFFERED))
    rows = [(i, m, LABELS.get(m, m.replace("-", " ").title()), PARAMETERS.get(m, []), sorted(k for k, v in ALIASES.items() if v == m)) for i, m in enumerate(order)]
    return spark.createDataFrame(rows, "place long, key string, label string, parameters array<string>, aliases array<string>")


def weed_counts(weeds: DataFrame, fields: DataFrame, cell: float = 200.0) -> DataFrame:
    """(ord, weeds): detections (ord, geom, minx..maxy) that meet each field, 0 included."""
    near = overlapping(weeds, fields, cell).where(call("Relate", "l_geom", "r_geom", F.lit("intersects")))
    n = near.groupBy(F.col("r_ord").alias("ord")).agg(F.count("*").alias("weeds"))
    return fields.select("ord").join(n, "ord", "left").select("ord", F.coalesce("weeds", F.lit(0)).alias("weeds"))


def field_info(weeds: DataFrame, fields: DataFrame, zone: int, south: bool) -> DataFrame:
    """(id, name, weeds, area_ha, centroid_lat, centroid_lon) of each field, from polygons in metres."""
    middle = call("Project", call("Shape", "geom", F.lit("centroid")), F.lit(zone), F.lit(south), F.lit(True))
    f = fields.select("ord", (call("Measure", "geom", F.lit("area")) / 10_000).alias("area_ha"), middle.alias("m")).join(weed_counts(weeds, fields), "ord")
    name = F.concat(F.lit("Field "), (F.col("ord") + 1).cast("string"))
    return f.select(F.col("ord").alias("id"), name.alias("name"), "weeds", "area_ha", call("Measure", "m", F.lit("cy")).alias("centroid_lat"), call("Measure", "m", F.lit("cx")).alias("centroid_lon"))


def numbered_pieces(features: DataFrame, order: list[str]) -> DataFrame:
    """features with pid, their number from 0 within their field."""
    return features.withColumn("pid", (F.row_number().over(Window.partitionBy("field_id").orderBy(*order)) - 1).cast("long"))


def dashboard(features: DataFrame, n_weeds: int, n_fields: int) -> DataFrame:
    """One row (weeds, polygons, total_area_ha, mean_area_m2, fields) about features (field_id, area_m2)."""
    total = F.coalesce(F.sum("area_m2"), F.lit(0.0))
    return features.agg(F.lit(n_weeds).cast("long").alias("weeds"), F.count("*").alias("polygons"), (total / 10_000).alias("total_area_ha"), (total / F.greatest(F.count("*"), F.lit(1))).alias("mean_area_m2"), F.lit(n_fields).cast("long").alias("fields"))


def field_details(fields: DataFrame, features: DataFrame) -> DataFrame:
    """(id, name, polygons, area_ha, mean_area_m2) of every field (id), without polygons too."""
    a = features.groupBy(F.col("field_id").alias("id")).agg(F.count("*").alias("n"), F.sum("area_m2").alias("s"))
    x = fields.select("id").join(a, "id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "s": F.coalesce("s", F.lit(0.0))})
    return x.select("id", F.concat(F.lit("Field "), (F.col("id") + 1).cast("string")).alias("name"), F.col("n").alias("polygons"), (F.col("s") / 10_000).alias("area_ha"), (F.col("s") / F.greatest("n", F.lit(1))).alias("mean_area_m2"))


def result_layer(features: DataFrame, min_area: float) -> DataFrame:
    """(field_id, pid, label, area_text, area_ha_text, is_small, colour): what a map shows of features (field_id, pid, area_m2)."""
    small = F.lit(min_area > 0) & (F.col("area_m2") < min_area)
    return features.select("field_id", "pid", polygon_label(F.col("field_id"), F.col("pid"), F.col("area_m2")).alias("label"), fixed(F.col("area_m2"), 0).alias("area_text"), fixed(F.col("area_m2") / 10_000, 4).alias("area_ha_text"), small.alias("is_small"), (F.col("field_id") % COLOURS).cast("long").alias("colour"))


def obstacle_layer(obstacles: DataFrame) -> DataFrame:
    """(pos, tooltip) of obstacles (pos, properties); signs that HTML reads are written out."""
    note = F.coalesce(F.col("properties")["note"], F.lit(""))
    text = F.concat(F.lit("Obstacle "), (F.col("pos") + 1).cast("string"), F.lit(" · Field "), F.coalesce(F.col("properties")["field_id"], F.lit("?")))
    return obstacles.select("pos", html_text(F.when(note == "", text).otherwise(F.concat(text, F.lit(" · "), note))).alias("tooltip"))


def without(features: DataFrame, removed: DataFrame) -> DataFrame:
    """features whose `hash` is not among the removed ones."""
    return features.join(removed.select("hash").distinct(), "hash", "left_anti")


def requested_ids(fields: DataFrame, ids: list[int]) -> DataFrame:
    """(field, known): the requested ids, each with whether a field has it; all fields if none is requested."""
    if not ids:
        return fields.select("field").distinct().withColumn("known", F.lit(True))
    asked = fields.sparkSession.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "field long")
    return asked.join(fields.select("field").distinct().withColumn("known", F.lit(True)), "field", "left").select("field", F.coalesce("known", F.lit(False)).alias("known"))
