"""Command line: python -m furrow.cli COMMAND ..."""

from __future__ import annotations

import argparse
import glob
import json
import os
import re
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import kernel
from furrow.config import METHODS, PlanConfig
from furrow.functions import crs, text
from furrow.kernel import call
from furrow.operators import survey_stats
from furrow.operators.spatial_join import overlapping
from furrow.plans import evaluate, reports, treatment
from furrow.sources import geojson, layout, likert

NUMBERS = ("weed_buffer_m", "merge_distance_m", "obstacle_safety_buffer_m", "negative_buffer_m", "min_polygon_area_m2", "rectangle_min_fill_ratio", "grid_cell_size_m", "grid_fill_threshold", "quadtree_min_cell_size_m", "quadtree_fill_threshold", "alpha_shape_radius_m", "strip_width_m", "strip_fill_threshold")


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("furrow").getOrCreate()
    kernel.load(spark)
    return spark


def _config(a: argparse.Namespace) -> PlanConfig:
    given = {k: v for k, v in vars(a).items() if v is not None and k in PlanConfig.__dataclass_fields__}
    return PlanConfig.load(a.config).replace(**given)


def plan(a: argparse.Namespace) -> None:
    spark, cfg = _session(), _config(a)
    weeds, fields = (geojson.read(spark, layout.comma_paths(x)) for x in (a.weeds, a.fields))
    obstacles = geojson.read(spark, layout.comma_paths(a.obstacles), allow_missing=True) if a.obstacles else geojson.empty(spark)
    if weeds.isEmpty() or fields.isEmpty():
        raise ValueError("no detections or no fields")
    print(geojson.save(treatment.generate(weeds, obstacles, fields, cfg), a.output, ["field_id"]), "fields written to", a.output)


def all_methods(a: argparse.Namespace) -> None:
    folder = a.output
    for m in METHODS:
        plan(argparse.Namespace(**vars(a) | {"coverage_method": m, "output": os.path.join(folder, f"spraying-{m}", f"spraying-{m}.geojson")}))


def _metric(features: DataFrame, key: str = "file") -> DataFrame:
    """features with `g` (degrees), `field` (id or null) and zone, south: the system in metres of their group.

    That of the file if it is in metres, else the UTM zone of the middle of the group's bounds.
    """
    geographic, zone, south = crs.source(F.col("crs"))
    x = geojson.lonlat(features).where("g is not null").withColumn("field", text.field_id(geojson.feature_id(F.col("properties"))))
    own = F.when(~geographic, F.struct(zone.alias("zone"), south.alias("south")))
    middle = [((F.min(call("Measure", "g", F.lit(f"min{c}"))) + F.max(call("Measure", "g", F.lit(f"max{c}")))) / 2).alias(c) for c in "xy"]
    groups = x.groupBy(key).agg(*middle, F.min(own).alias("own")).where("x is not null")
    near = crs.zone(F.col("x"), clamp=True)
    groups = groups.select(key, F.coalesce("own.zone", near).alias("zone"), F.coalesce("own.south", F.col("y") < 0).alias("south"))
    return x.join(groups, key)


def _metres(x: DataFrame, geom: str = "g") -> Column:
    return call("Project", geom, F.col("zone"), F.col("south"), F.lit(False))


def _lines_of(spark: SparkSession, path: str, distance: float, angle: float, ids: list[int], output: str) -> None:
    own, blocked = geojson.split_obstacles(geojson.read(spark, path))
    # every field id has a zone of its own; a file without any id is one group
    fields = geojson.lonlat(own).where("g is not null").withColumn("field", text.field_id(geojson.feature_id(F.col("properties"))))
    if fields.isEmpty():
        raise ValueError(f"{path}: no usable geometry")
    has_ids = not fields.where("field is not null").isEmpty()
    fields = fields.where("field is not null") if has_ids else fields.withColumn("field", F.lit(0).cast("long"))
    if ids and has_ids:
        asked = reports.requested_ids(fields, ids)
        if asked.where("known").isEmpty():
            raise ValueError(f"{path}: none of the fields {sorted(ids)}")
        fields = fields.join(asked.where("known").select("field"), "field", "left_semi")
    middle = [call("Measure", call("Union", F.collect_list("g")), F.lit(c)).alias(c) for c in ("cx", "cy")]
    zones = fields.groupBy("field").agg(*middle).select("field", crs.zone(F.col("cx"), clamp=True).alias("zone"), (F.col("cy") < 0).alias("south"))
    fields = treatment.bounded(fields.select("field", "g"), "g").join(zones, "field")
    obstacles = None
    if not blocked.isEmpty():
        o = treatment.bounded(geojson.lonlat(blocked).where("g is not null").select("g"), "g")
        near = overlapping(o, fields, 0.01)
        obstacles = near.select(F.col("r_field").alias("field"), call("Project", "l_g", F.col("r_zone"), F.col("r_south"), F.lit(False)).alias("geom"))
    lines = evaluate.flight_lines(fields.select("field", _metres(fields).alias("geom")), obstacles, distance, angle).join(zones, "field")
    back = call("Project", "line", F.col("zone"), F.col("south"), F.lit(True))
    out = lines.where(call("Measure", "line", F.lit("length")) > 0).select(call("ToJson", back).alias("geometry"), F.lit("spray").alias("line_type"), F.col("field").cast("int").alias("field_id"), "part")
    print(geojson.save(out, output, ["field_id", "part"], leave_out=["part"]), "lines written to", output)


def lines(a: argparse.Namespace) -> None:
    _lines_of(_session(), a.file, a.distance, a.angle, json.loads(a.fields), a.output or re.sub(r"(\.geojson)?$", "_lines.geojson", a.file, count=1))


def lines_batch(a: argparse.Namespace) -> None:
    spark = _session()
    found = sorted(glob.glob(os.path.join(a.folder, "**" if a.recursive else "", "*.geojson"), recursive=a.recursive))
    if not found:
        raise FileNotFoundError(f"no GeoJSON files in {a.folder}")
    failed = 0
    for path in found:
        try:
            _lines_of(spark, path, a.distance, a.angle, [], os.path.join(a.output, "pulverizacao_" + os.path.basename(path)))
        except Exception as e:  # one bad file does not stop the others
            failed += 1
            print(f"{path}: {e}", file=sys.stderr)
    if failed == len(found):
        raise ValueError("no file could be used")


def _layers(spark: SparkSession, sources: dict[str, list[str]], folder: str) -> DataFrame:
    """Features of all methods' files with `method` and default_field; files that are not JSON are left out."""
    if not sources:
        raise FileNotFoundError(f"no GeoJSON files in {folder}")
    files = [(m, p) for m, paths in sources.items() for p in paths]
    out = None
    for i, (method, path) in enumerate(files):  # a few files per method
        rows = spark.read.text(path, wholetext=True).select(F.lit(i).alias("file"), F.col("value").alias("text"))
        rows = geojson.parse(rows, skip_bad=True).withColumns({"method": F.lit(method), "default_field": F.lit(layout.file_number(path)).cast("long")})
        out = rows if out is None else out.unionByName(rows)
    return out


def _write(df: DataFrame, out: str | None) -> None:
    """A report: small by nature (a row per method or pair)."""
    rows = df.toPandas()
    if out:
        rows.to_csv(out + ".csv", index=False)
        with open(out + ".md", "w", encoding="utf-8") as f:
            f.write("|" + "|".join(rows.columns) + "|\n" + "|-" * len(rows.columns) + "|\n" + "".join("|" + "|".join(map(str, r)) + "|\n" for r in rows.itertuples(index=False)))
    print(rows.to_string(index=False))


def metrics(a: argparse.Namespace) -> None:
    spark = _session()
    polygons = _metric(_layers(spark, layout.polygon_sources(a.polygons), a.polygons), "method")
    zones = polygons.select("method", "zone", "south").distinct()
    polygons = polygons.select("method", "field", F.explode(call("Polygons", _metres(polygons))).alias("geom"))
    lines_ = geojson.lonlat(_layers(spark, layout.line_sources(a.lines), a.lines), repair=False).where("g is not null")
    lines_ = lines_.withColumns({"field": F.coalesce(text.field_id(geojson.feature_id(F.col("properties"))), "default_field"), "line_type": F.col("properties")["line_type"]})
    lines_ = evaluate.spray_lines(lines_, ["method"]).join(zones, "method")
    lines_ = lines_.select("method", "field", "file", "pos", F.posexplode(call("LineParts", _metres(lines_))).alias("k", "line"))
    lines_ = lines_.select("method", "field", F.struct("file", "pos", "k").alias("part"), "line")
    polygons, lines_ = evaluate.common_groups(polygons, lines_)
    _write(evaluate.geometric_metrics(polygons, lines_, a.swath).orderBy("method"), a.output)


def iou(a: argparse.Namespace) -> None:
    spark = _session()

    def metric(x: DataFrame) -> DataFrame:
        x = _metric(x, "method")
        return x.select("method", _metres(x).alias("geom"))

    layers = metric(_layers(spark, layout.polygon_sources(a.polygons), a.polygons))
    if a.weeds:
        weeds = metric(geojson.read(spark, layout.comma_paths(a.weeds)).withColumn("method", F.lit("weeds")))
        _write(evaluate.weed_capture(layers, weeds.select("geom")).orderBy("method"), a.output and a.output + "_weeds")
    _write(evaluate.iou_report(layers).orderBy("method1", "method2"), a.output)


def sensitivity(a: argparse.Namespace) -> None:
    g = _metric(geojson.read(_session(), layout.comma_paths(a.weeds)))
    parts = g.select("file", "pos", F.posexplode(call("Polygons", _metres(g))).alias("k", "geom")).select("file", F.struct("pos", "k").alias("ord"), "geom")
    _write(evaluate.sensitivity(parts, [x / 100 for x in range(51)], [2, 4, 8]).orderBy("rho_min", "max_depth"), a.output)


def survey(a: argparse.Namespace) -> None:
    spark = _session()
    scores = likert.read(spark, a.file) if os.path.exists(a.file) else likert.empty(spark)
    methods = survey_stats.zero_summary(spark) if scores.isEmpty() else survey_stats.method_summary(scores)
    pairs = survey_stats.pair_summary(survey_stats.method_means(scores), list(a.baselines))
    _write(survey_stats.wide_report(methods, pairs), a.output)
    print(survey_stats.report_text(a.file, scores, methods, pairs))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="furrow", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, *arguments: tuple) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for flags, options in arguments:
            c.add_argument(*flags, **options)
        return c

    many = {"nargs": "+", "required": True}
    for name, run in (("plan", plan), ("process-method", plan), ("all-methods", all_methods)):
        c = add(name, run, (["--weeds"], many), (["--fields"], many), (["--obstacles"], {"nargs": "*"}), (["--output"], {"required": True}), (["--config"], {}), (["--coverage-method"], {}), (["--rectangle-max-depth"], {"type": int}), (["--max-polygon-sides"], {"type": int}), (["--working-crs"], {}))
        for n in NUMBERS:
            c.add_argument("--" + n.replace("_", "-"), type=float)
    distance, angle = (["--distance"], {"type": float, "default": 2.0}), (["--angle"], {"type": float, "default": 0.0})
    add("lines", lines, (["file"], {}), distance, angle, (["--fields"], {"default": "[]", "help": "JSON list of ids; [] means all"}), (["--output"], {}))
    add("lines-batch", lines_batch, (["folder"], {}), distance, angle, (["--recursive"], {"action": "store_true"}), (["--output"], {"required": True}))
    add("metrics", metrics, (["polygons"], {}), (["lines"], {}), (["--swath"], {"type": float, "default": 2.0}), (["--output"], {}))
    add("iou", iou, (["polygons"], {}), (["--weeds"], {"nargs": "*", "default": []}), (["--output"], {}))
    add("sensitivity", sensitivity, (["--weeds"], many), (["--output"], {}))
    add("survey", survey, (["file"], {}), (["--baselines"], {"nargs": "*", "default": []}), (["--output"], {}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.run(a)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
