"""Files, collections, coordinate systems and the settings of a plan."""

import json

import pytest
from pyspark.sql import functions as F

from furrow import kernel
from furrow.config import ALIASES, METHODS, PlanConfig, method_name
from furrow.functions import crs, text
from furrow.kernel import call
from furrow.plans import treatment
from furrow.sources import geojson, layout, likert


@pytest.fixture(autouse=True)
def loaded(spark):
    kernel.load(spark)


def collection(*geometries, **more):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": {"id": i}} for i, g in enumerate(geometries)]} | more)


SQUARE = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}


def test_load_checked(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.geojson"
    assert geojson.load_checked(spark, str(path), "weeds") is None
    path.write_text(collection(SQUARE))
    first = geojson.load_checked(spark, str(path), "weeds")
    assert first.count() == 1 and geojson.load_checked(spark, str(path), "weeds") is first
    path.write_text(collection(SQUARE, SQUARE))
    assert geojson.load_checked(spark, str(path), "weeds").count() == 2, "a changed file is read again"
    for content, why in ((b"{", "invalid JSON"), (b"[]", "invalid root"), (b'{"type": "Feature"}', "type must"), (b'{"type": "FeatureCollection", "features": {}}', "must be a list"), (b'{"a": "\xff"}', "UTF-8")):
        path.write_bytes(content)
        with pytest.raises(ValueError, match=why):
            geojson.load_checked(spark, str(path), "weeds")
    monkeypatch.setattr(geojson, "MAX_MB", 0)
    path.write_text(collection(SQUARE))
    with pytest.raises(ValueError, match="too large"):
        geojson.load_checked(spark, str(path), "weeds")


def test_records_and_parts(spark, tmp_path):
    path = tmp_path / "r.geojson"
    lines = {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 0]], [[0, 1], [1, 1]]]}
    path.write_text(collection(SQUARE, None, {"type": "Polygon", "coordinates": "x"}, lines))
    out = geojson.records(spark, str(path)).collect()
    assert [(r.pos, r.crs, r.assumed) for r in out] == [(0, "EPSG:4326", True), (3, "EPSG:4326", True)]
    parts = geojson.by_type(geojson.read(spark, str(path)), "LineParts", 9).collect()
    assert [(r.field, r.k) for r in parts] == [(3, 0), (3, 1)]
    for bad in (collection(), collection(None), '{"type": "Feature", "features": []}'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            geojson.records(spark, str(path))


def test_one_bad_file_among_many(spark):
    files = spark.createDataFrame([(0, collection(SQUARE)), (1, "{"), (2, collection(SQUARE, crs={"type": "name", "properties": {"name": "EPSG:32725"}}))], "file int, text string")
    assert [(r.file, r.crs) for r in geojson.parse(files, skip_bad=True).collect()] == [(0, None), (2, "EPSG:32725")]
    with pytest.raises(Exception, match="not JSON"):
        geojson.parse(files).collect()


def test_layout(spark, tmp_path):
    for name in ("mrr/pulverizacao_2.geojson", "mrr/pulverizacao_11.geojson", "mrr/other.geojson", "aabb.geojson", "empty/readme.txt", "polygons/bcd.geojson"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}")
    found = layout.line_sources(str(tmp_path))
    assert list(found) == ["aabb", "mrr", "polygons"] and [p.rsplit("_")[-1] for p in found["mrr"]] == ["11.geojson", "2.geojson"]
    assert list(layout.polygon_sources(str(tmp_path))) == ["bcd"]
    assert layout.file_number("x/pulverizacao_12.geojson") == 12 and layout.file_number("pulverizacao_a.geojson") is None
    assert layout.comma_paths(["a,b", " c ", ",", ""]) == ["a", "b", "c"]


def test_coordinate_systems(spark):
    assert crs.parse_epsg("EPSG:32725") == (25, True) and crs.parse_epsg(31982) == (22, True) and crs.parse_epsg(3857) == (0, False) and crs.parse_epsg("31970") == (16, False)
    with pytest.raises(ValueError):
        crs.parse_epsg(2154)
    one = spark.createDataFrame([("EPSG:2154",)], "crs string").withColumn("geometry", F.lit('{"type":"Point","coordinates":[1,2]}'))
    with pytest.raises(Exception, match="unknown coordinate system"):
        geojson.lonlat(one, repair=False).select("g").collect()


def test_names(spark):
    names = spark.createDataFrame([(k,) for k in (*ALIASES, *METHODS, " Quad_Tree ", "BBOX")], "n string")
    for r in names.select("n", text.coverage_method(F.col("n")).alias("m")).collect():
        assert r.m == method_name(r.n)
    with pytest.raises(ValueError):
        method_name("no such method")


def test_canonical_json(spark):
    rows = [('{"b":[1,2.50,-0.0,1e2,1e-7,12345678901234567890.0],"a":{"d":null,"c":true}}',), ('{"x":"a\\"b"}',), ("{",)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(call("Canonical", "j")).collect()]
    assert got == [json.dumps(json.loads(rows[0][0]), sort_keys=True), json.dumps(json.loads(rows[1][0])), None]


def test_a_broken_geometry_costs_its_own_field(spark):
    good = call("FromWkt", F.lit("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"))
    parts = spark.range(3).select(F.col("id").cast("int").alias("field"), F.lit(1).cast("long").alias("ord"), F.when(F.col("id") == 1, F.lit(b"\x00\x01")).otherwise(good).alias("geom"))
    more = parts.union(parts.where("field = 1").select("field", F.lit(2).cast("long"), good))
    for distance in (0.0, 3.0):
        c = treatment.cover(treatment.clusters(more, distance, 4), PlanConfig(coverage_method="aabb"))
        assert sorted(r.field for r in c.collect()) == [0, 2]


def test_empty_survey_has_the_columns_of_a_read_one(spark, tmp_path):
    (tmp_path / "s.csv").write_text("evaluator,method,coverage\nA,x,3\n")
    assert likert.empty(spark).dtypes == likert.read(spark, str(tmp_path / "s.csv")).dtypes


def test_collection_in_several_texts(spark):
    """Positions count on over a file's texts, things that are no features included; numbers over blocks are those of one order."""
    square = json.dumps({"type": "Feature", "geometry": SQUARE, "properties": {}})
    texts = [(0, 1, [square, "7", square]), (0, 0, ["7", square]), (1, 0, [square]), (0, 5, [square] * 4)]
    rows = [(f, p, '{"type":"FeatureCollection","features":[' + ",".join(x) + "]}") for f, p, x in texts]
    parsed = geojson.parse(spark.createDataFrame(rows, "file int, part long, text string"))
    at = [(0, 1), (0, 2), (0, 4), (0, 5), (0, 6), (0, 7), (0, 8), (1, 0)]
    assert sorted((r.file, r.pos) for r in parsed.select("file", "pos").collect()) == at
    numbered = treatment.numbered(parsed.select("file", "pos", F.lit(0).alias("part"), "geometry"), ["file", "pos", "part"], block=3)
    assert [(r.file, r.pos) for r in sorted(numbered.select("file", "pos", "ord").collect(), key=lambda r: r.ord)] == at
    assert sorted(r.ord for r in numbered.select("ord").collect()) == list(range(8))
