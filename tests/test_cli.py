"""The commands, one after the other, on files of their own."""

import json

import pytest

from furrow.cli import main


def square(x, y, d):
    return {"type": "Polygon", "coordinates": [[[x, y], [x + d, y], [x + d, y + d], [x, y + d], [x, y]]]}


def test_commands(spark, tmp_path, capsys):
    def write(name, geometries):
        features = [{"type": "Feature", "geometry": g, "properties": {"field_id": i + 1}} for i, g in enumerate(geometries)]
        (tmp_path / name).write_text(json.dumps({"type": "FeatureCollection", "features": features}))
        return str(tmp_path / name)

    fields = write("fields.geojson", [square(-35.07, -6.41, 0.001)])
    weeds = write("weeds.geojson", [square(-35.0695, -6.4095, 0.0002), square(-35.0699, -6.4099, 0.0001)])
    plans = tmp_path / "plans"
    for m in ("aabb", "convex-hull"):
        assert main(["plan", "--weeds", weeds, "--fields", fields, "--output", str(plans / m / "out.geojson"), "--coverage-method", m, "--min-polygon-area-m2", "1"]) == 0
    for m in ("aabb", "convex-hull"):
        assert main(["lines", str(plans / m / "out.geojson"), "--distance", "3", "--output", str(tmp_path / "lines" / m / "l.geojson")]) == 0
    assert main(["lines-batch", str(plans), "--recursive", "--distance", "5", "--output", str(tmp_path / "batch")]) == 0
    assert main(["metrics", str(plans), str(tmp_path / "lines"), "--output", str(tmp_path / "m")]) == 0
    assert main(["iou", str(plans)]) == 0
    assert "convex-hull" in capsys.readouterr().out and (tmp_path / "m.csv").read_text().count("\n") == 3
    (tmp_path / "s.csv").write_text("evaluator,method,coverage\nA,x,3\nA,y,4\nB,x,5\nB,y,4\n")
    assert main(["survey", str(tmp_path / "s.csv")]) == 0
    assert main(["plan", "--weeds", str(tmp_path / "no.json"), "--fields", fields, "--output", "x"]) == 1


def test_reports_on_numbered_files_and_projected_polygons(spark, tmp_path, capsys):
    """Numbered line files of a method, transit lines left out, polygons in metres, weed capture, and a survey that is missing."""

    def write(path, features, **more):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": p} for g, p in features]} | more))
        return str(path)

    def line(y):
        return {"type": "LineString", "coordinates": [[300_000, 9_290_000 + y], [300_100, 9_290_000 + y]]}

    utm = {"crs": {"type": "name", "properties": {"name": "EPSG:32725"}}}
    flat = {"type": "Polygon", "coordinates": [[[300_000, 9_290_000], [300_100, 9_290_000], [300_100, 9_290_020], [300_000, 9_290_020], [300_000, 9_290_000]]]}
    polygons = tmp_path / "out"
    write(polygons / "polygons" / "mrr.geojson", [(flat, {"field_id": 7})], **utm)
    (polygons / "polygons" / "bad.geojson").write_text("{")
    write(tmp_path / "lines" / "mrr" / "pulverizacao_7.geojson", [(line(5), {"line_type": "Spray"}), (line(15), {"line_type": "spray"}), (line(100), {"line_type": "transit"})], **utm)
    assert main(["metrics", str(polygons), str(tmp_path / "lines"), "--swath", "10", "--output", str(tmp_path / "m")]) == 0
    header, row = (tmp_path / "m.csv").read_text().strip().split("\n")
    got = dict(zip(header.split(","), row.split(","), strict=True))
    assert got["method"] == "mrr" and got["num_polygons"] == "1" and float(got["total_area_ha"]) == pytest.approx(0.2, abs=1e-6)
    assert float(got["mean_straight_length_m"]) == pytest.approx(100, abs=1e-3) and float(got["target_coverage_pct"]) == pytest.approx(100, abs=1e-3) and got["num_turns"] == "1"
    weeds = write(tmp_path / "w.geojson", [({"type": "Polygon", "coordinates": [[[x, y] for x, y in ((300_000, 9_290_010), (300_100, 9_290_010), (300_100, 9_290_030), (300_000, 9_290_030), (300_000, 9_290_010))]]}, {})], **utm)
    write(polygons / "polygons" / "aabb.geojson", [(flat, {"field_id": 7})], **utm)
    assert main(["iou", str(polygons), "--weeds", weeds, "--output", str(tmp_path / "iou")]) == 0
    assert [round(float(r.split(",")[1]), 3) for r in (tmp_path / "iou_weeds.csv").read_text().strip().split("\n")[1:]] == [50.0, 50.0]
    assert float((tmp_path / "iou.csv").read_text().strip().split("\n")[1].split(",")[2]) == pytest.approx(1)
    assert main(["survey", str(tmp_path / "none.csv"), "--output", str(tmp_path / "s")]) == 0
    assert "no-likert-data" in (tmp_path / "s.csv").read_text() and "Valid rows: 0" in capsys.readouterr().out
    both = write(tmp_path / "two.geojson", [(flat, {"field_id": 1}), ({"type": "Point", "coordinates": [0, 0]}, {"field_id": "x"})], **utm)
    assert main(["lines", both, "--fields", "[2]"]) == 1
    assert main(["lines", both, "--fields", "[1, 2]", "--distance", "5", "--output", str(tmp_path / "l.geojson")]) == 0
    features = json.loads((tmp_path / "l.geojson").read_text())["features"]
    assert [f["properties"] for f in features] == [{"line_type": "spray", "field_id": 1}]
    assert features[0]["geometry"]["coordinates"][0][0] == pytest.approx(-34.8, abs=1)
