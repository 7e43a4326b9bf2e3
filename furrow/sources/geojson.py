"""GeoJSON as DataFrames: (file, pos, geometry (JSON text), properties (map), crs (name or null)), and back."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions.crs import source as crs_of
from furrow.functions.text import field_id, truth
from furrow.kernel import call

SCHEMA = "file int, pos int, geometry string, properties map<string,string>, crs string"
MAX_MB = 200
DEFAULT_CENTRE = (-15.0, -47.0)
_FEATURE = "struct<type: string, crs: struct<properties: struct<name: string>>, features: array<string>>"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def read(spark: SparkSession, paths: str | list[str], allow_missing: bool = False) -> DataFrame:
    """Features of all files in the order of the paths; what is no feature collection is left out.

    A missing path fails unless allow_missing; a file that is not JSON fails.
    """
    out = None
    for i, path in enumerate([paths] if isinstance(paths, str) else paths):
        try:
            text = spark.read.text(path, wholetext=True)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            if not allow_missing:
                raise FileNotFoundError(path) from e
            continue
        df = parse(text.select(F.lit(i).alias("file"), F.col("value").alias("text")))
        out = df if out is None else out.unionByName(df)
    return out if out is not None else empty(spark)


def parse(files: DataFrame, skip_bad: bool = False) -> DataFrame:
    """Features of (file, text) rows; null geometries and features that are no objects are left out.

    A large collection may come in several texts (file, part, text), each a collection itself; `pos` counts on over
    them in the order of `part`, so that no text has to hold a whole file.
    A text that is not JSON fails, or is left out with skip_bad.
    """
    part = ["part"] if "part" in files.columns else []
    bad = F.raise_error(F.concat(F.lit("not JSON: "), F.substring("text", 1, 80))).cast("string")
    whole = F.when(F.try_parse_json("text").isNull(), F.lit(None).cast("string") if skip_bad else bad).otherwise(F.col("text"))
    x = files.select("file", *part, F.from_json(whole, _FEATURE).alias("fc")).where(F.col("fc.features").isNotNull())
    if part:
        n = F.size("fc.features")
        before = F.sum("_n").over(Window.partitionBy("file").orderBy("part")) - F.col("_n")
        x = x.join(x.select("file", "part", n.alias("_n")).select("file", "part", before.cast("int").alias("_before")), ["file", "part"])
    x = x.select("file", *["_before"] * len(part), F.nullif(F.trim("fc.crs.properties.name"), F.lit("")).alias("crs"), F.posexplode("fc.features").alias("pos", "f"))
    if part:
        x = x.withColumn("pos", F.col("pos") + F.col("_before"))
    geometry, properties = F.get_json_object("f", "$.geometry"), F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>")
    x = x.select("file", "pos", geometry.alias("geometry"), F.coalesce(properties, F.create_map().cast("map<string,string>")).alias("properties"), "crs")
    return x.where("geometry is not null and geometry like '{%'")


def validity(text: Column) -> Column:
    """Why a text is no feature collection that may be loaded; null if it is one."""
    root = F.try_parse_json(text)
    is_list = F.coalesce(F.try_variant_get(root, "$.features", "array<variant>").isNotNull(), F.lit(False))
    kind = F.try_variant_get(root, "$.type", "string")
    return (
        F.when(root.isNull(), "invalid JSON")
        .when(~F.schema_of_variant(root).startswith("OBJECT"), "invalid root JSON")
        .when(F.coalesce(kind != "FeatureCollection", F.lit(True)), "type must be 'FeatureCollection'")
        .when(~is_list, "features must be a list")
    )


_LOADED: dict[tuple, DataFrame] = {}


def load_checked(spark: SparkSession, path: str, label: str) -> DataFrame | None:
    """Features of one local file, remembered by its path, time and size; None if it is missing.

    Fails if the file is larger than MAX_MB, not UTF-8, or no feature collection.
    """
    if not os.path.exists(path):
        return None
    stat = os.stat(path)
    key = (spark.sparkContext.applicationId, os.path.realpath(path), stat.st_mtime_ns, stat.st_size)
    if key in _LOADED:
        return _LOADED[key]
    if stat.st_size > MAX_MB << 20:
        raise ValueError(f"{label}: file too large ({stat.st_size / (1 << 20):.1f} MB)")
    # the version is part of the plan, so that Spark does not take a changed file for the remembered one
    version = F.lit(f"{stat.st_mtime_ns}:{stat.st_size}").alias("version")
    raw = spark.read.format("binaryFile").load(path).select(F.lit(0).alias("file"), version, F.expr("try_validate_utf8(cast(content as string))").alias("text"))
    found = raw.select(F.col("text").isNull().alias("odd"), validity(F.col("text")).alias("why")).first()
    if found.odd or found.why:
        raise ValueError(f"{label}: " + ("invalid encoding, not UTF-8" if found.odd else found.why))
    _LOADED[key] = parse(raw).cache()
    return _LOADED[key]


def records(spark: SparkSession, path: str) -> DataFrame:
    """(pos, geom, properties, crs, assumed) of one file whose type is FeatureCollection: features with a usable geometry, repaired.

    Fails if there is none.  assumed: the file names no coordinate system.
    """
    text = spark.read.text(path, wholetext=True).select(F.lit(0).alias("file"), F.col("value").alias("text"))
    if (why := text.select(validity(F.col("text"))).first()[0]) is not None:
        raise ValueError(f"{path}: empty or invalid GeoJSON file ({why})")
    g = call("Repair", call("FromJson", "geometry"), F.lit(True))
    out = parse(text).select("pos", g.alias("geom"), "properties", F.coalesce("crs", F.lit("EPSG:4326")).alias("crs"), F.col("crs").isNull().alias("assumed"))
    out = out.where("geom is not null").where(~call("ToWkt", "geom").endswith("EMPTY"))
    if out.isEmpty():
        raise ValueError(f"{path}: no valid geometry")
    return out


def by_type(features: DataFrame, parts: str, default_id: int | None = None) -> DataFrame:
    """(file, field, k, geom) of features: their atomic parts (`Polygons` or `LineParts`), with the field id of their properties or the default."""
    own = field_id(feature_id(F.col("properties")))
    return features.select("file", F.coalesce(own, F.lit(default_id).cast("long")).alias("field"), F.posexplode(call(parts, call("FromJson", "geometry"))).alias("k", "geom"))


def lonlat(features: DataFrame, repair: bool = True) -> DataFrame:
    """features with `g`, their geometry in degrees, whatever system their file is in."""
    geographic, zone, south = crs_of(F.col("crs"))
    g = call("FromJson", "geometry")
    g = call("Repair", g, F.lit(True)) if repair else g
    return features.withColumn("g", F.when(geographic, g).otherwise(call("Project", g, zone, south, F.lit(True))))


def split_obstacles(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, obstacles) by the properties `obstacle` or `is_obstacle`."""
    flag = truth(F.coalesce(F.col("properties")["obstacle"], F.col("properties")["is_obstacle"]))
    return features.where(~flag), features.where(flag)


def light_signature(features: DataFrame, key: str = "file") -> DataFrame:
    """(key, signature): number of features and short hashes of the first, middle and last geometry, to tell whether a collection changed."""
    n = features.groupBy(key).agg(F.count("*").alias("n"))
    x = features.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).join(n, key)
    hash_ = F.substring(F.md5(call("Canonical", "geometry")), 1, 8)
    picked = {k: F.max(F.when(F.col("nth") == at, hash_)) for k, at in (("a", F.lit(0)), ("b", F.floor(F.col("n") / 2)), ("c", F.col("n") - 1))}
    s = x.where((F.col("nth") == 0) | (F.col("nth") == F.floor(F.col("n") / 2)) | (F.col("nth") == F.col("n") - 1)).groupBy(key, "n").agg(*[v.alias(k) for k, v in picked.items()])
    return s.select(key, F.concat_ws(":", F.col("n").cast("string"), "a", "b", "c").alias("signature"))


def extent(features: DataFrame, key: str = "file") -> DataFrame:
    """(key, minx, miny, maxx, maxy, lat, lon): bounds of a collection's geometries in degrees and their middle."""
    b = features.select(key, call("FromJson", "geometry").alias("g")).select(key, *[call("Measure", "g", F.lit(c)).alias(c) for c in ("minx", "miny", "maxx", "maxy")])
    b = b.groupBy(key).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    lat, lon = DEFAULT_CENTRE
    return b.select("*", F.coalesce((F.col("miny") + F.col("maxy")) / 2, F.lit(lat)).alias("lat"), F.coalesce((F.col("minx") + F.col("maxx")) / 2, F.lit(lon)).alias("lon"))


def feature_id(properties: Column) -> Column:
    """The first of the id properties that is there."""
    return F.coalesce(*[properties[k] for k in ("Field_id", "field_id", "id", "ID")])


def save(features: DataFrame, path: str, order_by: list[str], leave_out: tuple[str, ...] | list[str] = ()) -> int:
    """One GeoJSON file from the final rows (geometry: JSON text, all other columns: properties); put in place at once.

    Rows stream to the driver partition by partition.  For results beyond one file, write the DataFrame itself.
    """
    names = [c for c in features.columns if c != "geometry" and c not in leave_out]
    rows = features.orderBy(*order_by).select("geometry", F.to_json(F.struct(*names)).alias("p"))
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(os.path.abspath(path)), delete=False) as f:
        f.write('{"type": "FeatureCollection", "features": [')
        for row in rows.toLocalIterator():
            f.write(("," if n else "") + "\n  " + json.dumps({"type": "Feature", "geometry": json.loads(row.geometry), "properties": json.loads(row.p)}, ensure_ascii=False))
            n += 1
        f.write("\n]}\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)
    return n


def download(features: DataFrame, min_area: float) -> DataFrame:
    """Features of at least min_area (if above 0) without the properties that begin with an underscore."""
    x = features.where(F.col("properties")["area_m2"].cast("double") >= min_area) if min_area > 0 else features
    return x.withColumn("properties", F.map_filter("properties", lambda k, _: ~k.startswith("_")))
