"""Queries behind reports, views and files: collections, labels, survey tables, line selection, dashboards."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import kernel
from furrow.config import PlanConfig
from furrow.functions import text
from furrow.kernel import call
from furrow.operators import survey_stats
from furrow.plans import evaluate, reports
from furrow.plans.queries import _PAIRS, _means, _table, query, scores
from furrow.sources import geojson, layout, likert


def _events(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


# ---- collections and files
@query("SELECT CAST(n_nationkey AS BIGINT) AS field_id, n_name AS name, n_nationkey + 0.5::DOUBLE AS x FROM nation")
def geojson_round_trip(spark, d):
    """Features written to one file, put in place at once, and read again."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    g = F.concat(F.lit('{"type":"Point","coordinates":['), (F.col("n_nationkey") + 0.5).cast("double").cast("string"), F.lit(",1.0]}"))
    path = tempfile.mkdtemp(prefix="furrow-") + "/out/fields.geojson"
    geojson.save(n.select(g.alias("geometry"), F.col("n_nationkey").alias("field_id"), F.col("n_name").alias("name")), path, ["field_id"])
    back = geojson.read(spark, f"file://{path}")
    return back.select(text.field_id(geojson.feature_id(F.col("properties"))).alias("field_id"), F.col("properties")["name"].alias("name"), F.get_json_object("geometry", "$.coordinates[0]").cast("double").alias("x"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'invalid root JSON' WHEN 3 THEN 'type must be ''FeatureCollection''' WHEN 4 THEN 'features must be a list' WHEN 5 THEN 'features must be a list' WHEN 6 THEN 'type must be ''FeatureCollection''' END AS why FROM events""")
def feature_validity(spark, d):
    """Why a text may not be loaded as a feature collection."""
    k = F.col("event_id") % 7
    t = F.when(k == 0, '{"type":"FeatureCollection","features":[{"a":1}]}').when(k == 1, '{"type":').when(k == 2, "[1,2]").when(k == 3, '{"type":"Feature","features":[]}')
    t = t.when(k == 4, '{"type":"FeatureCollection","features":{}}').when(k == 5, '{"type":"FeatureCollection"}').otherwise('{"features":[]}')
    return _events(spark, d).select("event_id", geojson.validity(t).alias("why"))


@query("SELECT CAST(NULL AS VARCHAR) AS evaluator, CAST(NULL AS VARCHAR) AS method, CAST(NULL AS DOUBLE) AS coverage, CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS operability, CAST(NULL AS DOUBLE) AS acceptability, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS BIGINT) AS metrics_used WHERE false")
def empty_survey(spark, d):
    """A survey without rows has its columns and types."""
    return likert.empty(spark)


@query("SELECT CAST(NULL AS INTEGER) AS file, CAST(NULL AS INTEGER) AS pos, CAST(NULL AS VARCHAR) AS geometry WHERE false")
def empty_collection(spark, d):
    return geojson.empty(spark).select("file", "pos", "geometry")


@query("""SELECT * FROM (VALUES ('weed_buffer_m', '1.0'), ('merge_distance_m', '7.5'), ('obstacle_safety_buffer_m', '3.0'), ('negative_buffer_m', '0.5'), ('min_polygon_area_m2', '1000.0'), ('fix_invalid_geometries', 'True'), ('rectangle_min_fill_ratio', '0.45'), ('rectangle_max_depth', '6'),
 ('max_polygon_sides', '16'), ('coverage_method', 'quadtree'), ('grid_cell_size_m', '2.0'), ('grid_fill_threshold', '0.35'), ('quadtree_min_cell_size_m', '1.0'), ('quadtree_fill_threshold', '0.35'), ('alpha_shape_radius_m', '20.0'), ('strip_width_m', '3.0'), ('strip_fill_threshold', '0.3'), ('working_crs', 'None')) t(name, value)""")
def config_overlay(spark, d):
    """Defaults with a given mapping over them; unknown names are ignored and method names normalised."""
    cfg = PlanConfig.of({"merge_distance_m": 7.5, "coverage_method": "Quad_Tree", "unknown": 1})
    return spark.createDataFrame([(n, str(getattr(cfg, n))) for n in PlanConfig.__dataclass_fields__], "name string, value string")


_PATHS = "concat('/data/lines/', CASE event_id % 4 WHEN 0 THEN concat('pulverizacao_', CAST(user_id AS VARCHAR(20)), '.geojson') WHEN 1 THEN concat('pulverizacao_', CAST(user_id AS VARCHAR(20)), 'b.geojson') WHEN 2 THEN 'mrr.geojson' ELSE concat('x/pulverizacao_', CAST(event_id AS VARCHAR(20))) END) AS path"


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS BIGINT) WHEN 3 THEN CAST(event_id AS BIGINT) END AS field FROM events")
def line_file_ids(spark, d):
    """The field that a numbered line file belongs to."""
    p = _table(spark, d, "events", "event_id, " + _PATHS)
    return p.select("event_id", layout.default_field_id(F.col("path")).alias("field"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN user_id END AS a, 'name' AS keys FROM events WHERE value >= 10")
def download_features(spark, d):
    """What may be downloaded: features of at least the least area, without private properties."""
    p = F.create_map(F.lit("area_m2"), F.col("value").cast("string"), F.lit("name"), F.lit("n"), F.lit("_pid"), F.lit("1"), F.lit("_hash"), F.lit("x"))
    f = _events(spark, d).select("event_id", "user_id", p.alias("properties"))
    x = geojson.download(f, 10.0)
    keys = F.array_join(F.array_sort(F.filter(F.map_keys("properties"), lambda k: k != "area_m2")), ",")
    return x.select("event_id", F.when(F.col("event_id") % 4 == 0, F.col("user_id")).alias("a"), keys.alias("keys"))


@query("""SELECT event_id, substr(md5('{"coordinates": [' || event_id || ', ' || (user_id % 50) || '.5], "type": "Point"}'), 1, 10) AS hash FROM events""")
def feature_hashes(spark, d):
    """Hashes of geometries do not depend on the order of members, spaces, or how a number is written."""
    kernel.load(spark)
    n, u = F.col("event_id").cast("string"), (F.col("user_id") % 50).cast("string")
    plain = F.concat(F.lit('{"type":"Point","coordinates":['), n, F.lit(","), u, F.lit(".50]}"))
    odd = F.concat(F.lit('{ "coordinates" : [ '), n, F.lit(" ,  "), u, F.lit('.5 ],\n"type" :"Point" }'))
    return _events(spark, d).select("event_id", text.feature_hash(call("Canonical", F.when(F.col("event_id") % 2 == 0, plain).otherwise(odd))).alias("hash"))


@query(""", g AS (SELECT CAST(user_id % 5 AS INTEGER) AS file, event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS nth, count(*) OVER (PARTITION BY user_id % 5) AS n, substr(md5('{"coordinates": [' || event_id || ', 1], "type": "Point"}'), 1, 8) AS h FROM events)
 SELECT file, any_value(n) || ':' || max(h) FILTER (nth = 0) || ':' || max(h) FILTER (nth = n // 2) || ':' || max(h) FILTER (nth = n - 1) AS signature FROM g GROUP BY file""")
def light_signatures(spark, d):
    kernel.load(spark)
    g = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("event_id").cast("string"), F.lit(",1]}"))
    return geojson.light_signature(_events(spark, d).select((F.col("user_id") % 5).cast("int").alias("file"), F.col("event_id").alias("pos"), g.alias("geometry")))


@query("SELECT CAST(user_id AS BIGINT) AS user_id, CASE WHEN count(*) FILTER (event_id % 9 = 0) = 0 THEN '0' ELSE substr(md5(string_agg(DISTINCT CAST(event_id % 9 * event_id AS VARCHAR), '|' ORDER BY CAST(event_id % 9 * event_id AS VARCHAR)) FILTER (event_id % 9 = 0)), 1, 10) END AS signature FROM events GROUP BY user_id")
def removed_signatures(spark, d):
    removed = F.collect_list(F.when(F.col("event_id") % 9 == 0, (F.col("event_id") % 9 * F.col("event_id")).cast("string")))
    return _events(spark, d).groupBy("user_id").agg(text.set_signature(removed).alias("signature"))


# ---- texts
@query("""SELECT event_id, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe FROM (SELECT event_id, event_type || CASE event_id % 3 WHEN 0 THEN ' <b>&amp;</b>' WHEN 1 THEN ' "it''s"' ELSE '' END AS t FROM events)""")
def html_texts(spark, d):
    t = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, " <b>&amp;</b>").when(F.col("event_id") % 3 == 1, ' "it\'s"').otherwise(""))
    return _events(spark, d).select("event_id", text.html_text(t).alias("safe"))


@query("SELECT raw, strip_accents(raw) AS plain FROM (SELECT DISTINCT concat(c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN ' Avaliação' WHEN 1 THEN ' őŁ ǹŝ' WHEN 2 THEN ' crème brûlée' ELSE ' Ωmega' END) AS raw FROM customer)")
def plain_texts(spark, d):
    """Accents of any script's letters taken off."""
    kernel.load(spark)
    k = F.col("c_custkey") % 4
    raw = F.concat("c_mktsegment", F.when(k == 0, " Avaliação").when(k == 1, " őŁ ǹŝ").when(k == 2, " crème brûlée").otherwise(" Ωmega"))
    return spark.read.parquet(f"{d}/customer.parquet").select(raw.alias("raw")).distinct().select("raw", call("Plain", "raw").alias("plain"))


_AREA = "CAST(event_id % 7000 AS DOUBLE) + 0.25"


@query(f"""SELECT field_id, pid, 'F' || (field_id + 1) || ' · P' || (pid + 1) || ' — ' || CAST(CAST(floor(a) AS BIGINT) AS VARCHAR) || ' m² (' || printf('%.4f', round_even(a / 10000, 4)) || ' ha)' AS label, CAST(CAST(floor(a) AS BIGINT) AS VARCHAR) AS area_text, printf('%.4f', round_even(a / 10000, 4)) AS area_ha_text, a < 500 AS is_small, field_id % 8 AS colour
 FROM (SELECT CAST(user_id % 9 AS BIGINT) AS field_id, row_number() OVER (PARTITION BY user_id % 9 ORDER BY event_id) - 1 AS pid, {_AREA} AS a FROM events)""")
def result_layer(spark, d):
    """Labels and marks of the polygons on a map, numbered within their fields."""
    f = _table(spark, d, "events", f"event_id, user_id % 9 AS field_id, {_AREA} AS area_m2")
    return reports.result_layer(reports.numbered_pieces(f, ["event_id"]), 500.0)


@query("""SELECT CAST(event_id AS INTEGER) AS pos, 'Obstacle ' || (event_id + 1) || ' · Field ' || CASE WHEN event_id % 3 = 0 THEN '?' ELSE CAST(user_id AS VARCHAR) END || CASE WHEN event_id % 4 = 1 THEN ' · a &lt;tree&gt;' ELSE '' END AS tooltip FROM events""")
def obstacle_layer(spark, d):
    p = F.map_concat(F.when(F.col("event_id") % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("field_id"), F.col("user_id").cast("string"))), F.when(F.col("event_id") % 4 == 1, F.create_map(F.lit("note"), F.lit("a <tree>"))).otherwise(F.create_map().cast("map<string,string>")))
    return reports.obstacle_layer(_events(spark, d).select(F.col("event_id").cast("int").alias("pos"), p.alias("properties")))


@query("""SELECT * FROM (VALUES (0::BIGINT, 'mrr', 'MRR', 0, 3), (1, 'bcd', 'Boustrophedon', 0, 2), (2, 'fixed-grid', 'Fixed Grid', 2, 4), (3, 'quadtree', 'Quadtree', 2, 1), (4, 'strip-based', 'Strips', 2, 3), (5, 'convex-hull', 'Convex Hull', 0, 1), (6, 'concave-hull', 'Concave Hull', 1, 3), (7, 'aabb', 'AABB', 0, 2), (8, 'morph-closing', 'Morphological Closing', 0, 2)) t(place, key, label, own_parameters, names)""")
def method_catalog(spark, d):
    return reports.catalog(spark).select("place", "key", "label", F.size("parameters").alias("own_parameters"), F.size("aliases").alias("names"))


@query("SELECT event_id, round(least(0.5 + round_even((least(greatest(value, 0.5), 20) - 0.5) / 0.25, 0) * 0.25, 20), 6) AS v FROM events")
def snapped_values(spark, d):
    return _events(spark, d).select("event_id", F.round(text.snap(F.col("value"), 0.5, 20.0, 0.25), 6).alias("v"))


# ---- dashboards
_PIECES = "user_id % 30 AS field_id, event_id, CAST(event_id % 900 AS DOUBLE) + 0.5 AS area_m2"


@query(f"SELECT (SELECT count(*) FROM customer) AS weeds, count(*) AS polygons, round(sum(area_m2) / 1e4, 6) AS total_area_ha, round(avg(area_m2), 6) AS mean_area_m2, 25::BIGINT AS fields FROM (SELECT {_PIECES} FROM events)")
def dashboard(spark, d):
    f = _table(spark, d, "events", _PIECES)
    t = reports.dashboard(f, spark.read.parquet(f"{d}/customer.parquet").count(), 25)
    return t.select("weeds", "polygons", F.round("total_area_ha", 6).alias("total_area_ha"), F.round("mean_area_m2", 6).alias("mean_area_m2"), "fields")


@query(f"""SELECT CAST(n_nationkey AS BIGINT) AS id, 'Field ' || (n_nationkey + 1) AS name, count(area_m2) AS polygons, round(coalesce(sum(area_m2), 0) / 1e4, 6) AS area_ha, round(coalesce(avg(area_m2), 0), 6) AS mean_area_m2 FROM nation LEFT JOIN (SELECT {_PIECES} FROM events WHERE user_id % 30 <> 7) ON field_id = n_nationkey GROUP BY n_nationkey""")
def field_details(spark, d):
    f = _table(spark, d, "events", _PIECES).where("field_id <> 7")
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"))
    x = reports.field_details(n, f)
    return x.select("id", "name", "polygons", F.round("area_ha", 6).alias("area_ha"), F.round("mean_area_m2", 6).alias("mean_area_m2"))


@query("SELECT CAST(c_nationkey * 2 AS BIGINT) AS field, count(*) > 0 AND c_nationkey * 2 < 25 AS known FROM customer GROUP BY c_nationkey")
def requested_ids(spark, d):
    """Requested ids, each with whether there is such a field."""
    f = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("field"))
    asked = [r[0] * 2 for r in spark.read.parquet(f"{d}/customer.parquet").select("c_nationkey").distinct().collect()]
    return reports.requested_ids(f, asked)


# ---- lines
_LINE_TYPES = "event_id, user_id, CASE WHEN user_id % 3 = 0 THEN 'transit' WHEN event_id % 4 = 0 THEN 'SPRAY' WHEN event_id % 4 = 1 THEN 'Spray' WHEN event_id % 4 = 2 THEN 'transit' END AS line_type"


@query(f"""SELECT event_id FROM (SELECT *, lower(coalesce(line_type, '')) = 'spray' AS own, bool_or(lower(coalesce(line_type, '')) = 'spray') OVER (PARTITION BY user_id) AS with_own FROM (SELECT {_LINE_TYPES} FROM events)) WHERE own OR NOT with_own""")
def spray_selection(spark, d):
    """Spray lines of each group; all lines of a group without any."""
    return evaluate.spray_lines(_table(spark, d, "events", _LINE_TYPES), ["user_id"]).select("event_id")


_IDS = "event_type AS method, CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id % 20 END AS field, event_id"


@query(f""", x AS (SELECT {_IDS} FROM events), p AS (SELECT * FROM x WHERE event_id % 2 = 0 AND (method <> 'view' OR coalesce(field, 0) <> 4)), l AS (SELECT * FROM x WHERE event_id % 2 = 1),
 e AS (SELECT method, count(*) FILTER (NOT (a AND b)) = 0 AS even FROM (SELECT method, field, bool_or(side = 1) AS a, bool_or(side = 2) AS b FROM (SELECT method, field, 1 AS side FROM p UNION ALL SELECT method, field, 2 FROM l) WHERE field IS NOT NULL GROUP BY ALL) GROUP BY method)
 SELECT method, side, CASE WHEN even THEN field ELSE 0 END AS field, count(*) AS n FROM (SELECT method, field, 'polygons' AS side FROM p UNION ALL SELECT method, field, 'lines' FROM l) JOIN e USING (method) WHERE NOT even OR field IS NOT NULL GROUP BY ALL""")
def shared_groups(spark, d):
    """Polygons and lines are grouped by field if both have the same ids, else by method."""
    x = _table(spark, d, "events", _IDS)
    p = x.where("event_id % 2 = 0 and (method <> 'view' or coalesce(field, 0) <> 4)")
    both = evaluate.common_groups(p, x.where("event_id % 2 = 1"))
    sides = [b.groupBy("method", F.lit(s).alias("side"), F.col("field").cast("long").alias("field")).agg(F.count("*").alias("n")) for b, s in zip(both, ("polygons", "lines"), strict=True)]
    return sides[0].union(sides[1])


@query(""", t AS (SELECT event_type AS method, min(minx) AS x0, min(miny) AS y0, max(maxx) AS x1, max(maxy) - 100 * (ascii(event_type) - 97) AS y1 FROM (SELECT event_type, event_id AS weed_id FROM events) JOIN weeds USING (weed_id) GROUP BY event_type)
 SELECT method, round(100 * greatest(0, least(x1, 600) - greatest(x0, 100)) * greatest(0, least(y1, 500) - greatest(y0, 100)) / (500 * 400), 4) AS weed_capture_pct FROM t""")
def weed_capture(spark, d):
    """Share of a weed area that each method covers."""
    from furrow.plans.queries import weeds
    from furrow.plans.treatment import bounds_of

    kernel.load(spark)
    e = _events(spark, d).select("event_type", F.col("event_id").alias("weed_id"))
    b = bounds_of(weeds(spark, d).join(e, "weed_id"), "event_type").withColumn("maxy", F.col("maxy") - 100 * (F.ascii("event_type") - 97))
    layers = b.select(F.col("event_type").alias("method"), call("Rect", "minx", "miny", "maxx", "maxy").alias("geom"))
    patches = spark.createDataFrame([(100.0, 100.0, 400.0, 500.0), (300.0, 100.0, 600.0, 500.0)], "a double, b double, c double, d double").select(call("Rect", "a", "b", "c", "d").alias("geom"))
    r = evaluate.weed_capture(layers, patches)
    return r.select("method", F.round("weed_capture_pct", 4).alias("weed_capture_pct"))


# ---- survey
_LABEL = "upper(left({0}, 1)) || substr({0}, 2)"
_FLIPS = """, l AS (SELECT method_a, method_b, list(diff ORDER BY evaluator) AS d, list(evaluator ORDER BY evaluator) AS e FROM p GROUP BY ALL)"""


@query(_PAIRS + f"""{_FLIPS}, r AS (SELECT method, rank() OVER (PARTITION BY evaluator ORDER BY score DESC) + (count(*) OVER (PARTITION BY evaluator, score) - 1) / 2 AS r FROM q WHERE method <> 'view'), k AS (SELECT method, round(avg(r), 3) AS mean_rank FROM r GROUP BY method),
 s1 AS (SELECT method, count(*) AS n, round(avg(score), 3) AS mean_score FROM q GROUP BY method)
 SELECT 'method_summary' AS section, method AS method_id, {_LABEL.format('method')} AS method_label, CAST(n AS VARCHAR) AS n, coalesce(CAST(mean_rank AS VARCHAR), 'NaN') AS mean_rank, '' AS comparison_type, '' AS method_a_id, '' AS method_b_label, '' AS n_pairs, '' AS n_permutations, '' AS wins, '' AS ties, '' AS losses, '' AS paired_evaluators FROM s1 LEFT JOIN k USING (method)
 UNION ALL SELECT 'paired', '', '', '', '', CASE WHEN method_b = 'click' THEN 'mrr_vs_baseline' ELSE 'mrr_vs_other' END, method_a, {_LABEL.format('method_b')}, CAST(len(d) AS VARCHAR), CAST(1 << len(d) AS VARCHAR), CAST(len(list_filter(d, lambda x: x > 1e-12)) AS VARCHAR), CAST(len(list_filter(d, lambda x: abs(x) <= 1e-12)) AS VARCHAR), CAST(len(list_filter(d, lambda x: x < -1e-12)) AS VARCHAR), array_to_string(e, '; ') FROM l""")
def wide_report(spark, d):
    """Both sections of the statistics table as text; a method without ranks has NaN."""
    means = _means(spark, d)
    ranks = survey_stats.mean_rank(means, leave_out="view").withColumn("mean_rank", F.round("mean_rank", 3))
    m = means.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean_score"), F.min("score").alias("ci_low"), F.max("score").alias("ci_high"))
    m = survey_stats.with_mean_rank(m, ranks).withColumns({"label": text.method_label(F.col("method")), "place": F.lit(1).cast("long")})
    w = survey_stats.wide_report(m, survey_stats.pair_summary(means, ["click"]))
    return w.select("section", "method_id", "method_label", "n", "mean_rank", "comparison_type", "method_a_id", "method_b_label", "n_pairs", "n_permutations", "wins", "ties", "losses", "paired_evaluators")


@query("SELECT 'no-likert-data' AS method, 'Likert data unavailable' AS label, 0::BIGINT AS n, 0.0::DOUBLE AS mean_score, 0.0::DOUBLE AS mean_rank, 0::BIGINT AS n_ranked")
def zero_summary(spark, d):
    return survey_stats.zero_summary(spark).select("method", "label", "n", "mean_score", "mean_rank", "n_ranked")


@query(_PAIRS + f"""{_FLIPS}, n AS (SELECT method_a, method_b, d, round(list_avg(d), 6) AS md FROM l)
 SELECT {_LABEL.format('method_a')} AS label_a, {_LABEL.format('method_b')} AS label_b, CASE WHEN md > 0 THEN '+' ELSE '' END || printf('%.2f', round_even(md, 2)) || chr(10) || '(' || len(list_filter(d, lambda x: x > 1e-12)) || 'W, ' || len(list_filter(d, lambda x: abs(x) <= 1e-12)) || 'D, ' || len(list_filter(d, lambda x: x < -1e-12)) || 'L)' AS note FROM n""")
def heatmap_notes(spark, d):
    """The text of each cell of the heatmap."""
    p = survey_stats.pair_summary(_means(spark, d), []).withColumn("mean_difference", F.round("mean_difference", 6))
    return survey_stats.heatmap_notes(p)


@query(", s AS (SELECT *, (coalesce(coverage, 0) + precision_ + operability + acceptability) / (3 + CASE WHEN coverage IS NULL THEN 0 ELSE 1 END) AS score FROM likert) SELECT method, count(*) AS n, round(avg(score), 6) AS mean_score, true AS inside FROM s GROUP BY method")
def bootstrap_means(spark, d):
    """Number and mean of each method's scores; whether the bootstrap interval holds the mean and is as wide as the normal one, within a tenth."""
    s = scores(spark, d)
    b = survey_stats.bootstrap(s).join(s.groupBy("method").agg((2 * 1.959964 * F.stddev_pop("score") / F.sqrt(F.count("*"))).alias("width")), "method")
    inside = F.col("mean_score").between(F.col("ci_low"), F.col("ci_high")) & (F.abs((F.col("ci_high") - F.col("ci_low")) / F.col("width") - 1) < 0.1)
    return b.select("method", "n", F.round("mean_score", 6).alias("mean_score"), inside.alias("inside"))
