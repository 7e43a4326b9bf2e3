"""Registered queries on fixtures derived from the driver's tables, with SQL for those that have a closed form.

The tables hold no geometry: fields are a 5 x 5 grid of squares, detections small rectangles, routes
polylines of a user's events, and survey scores come from events as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow import kernel
from furrow.config import ALIASES, METHODS, PlanConfig
from furrow.functions import crs, measures, text
from furrow.kernel import call
from furrow.operators import paths, survey_stats
from furrow.operators.spatial_join import clipped_box, overlapping
from furrow.plans import evaluate, treatment
from furrow.sources import geojson, likert

FIELDS = """CAST(n_nationkey AS BIGINT) AS field_id, CAST((n_nationkey % 5) * 220 AS DOUBLE) AS minx, CAST(CAST(floor(n_nationkey / 5) AS INT) * 220 AS DOUBLE) AS miny,
 CAST((n_nationkey % 5) * 220 + 200 AS DOUBLE) AS maxx, CAST(CAST(floor(n_nationkey / 5) AS INT) * 220 + 200 AS DOUBLE) AS maxy"""
WEEDS = """event_id AS weed_id, CAST((event_id * 7919) % 4400 AS DOUBLE) * 0.25 - CAST(1 + event_id % 7 AS DOUBLE) * 0.25 AS minx,
 CAST((event_id * 104729) % 4400 AS DOUBLE) * 0.25 - CAST(1 + event_id % 5 AS DOUBLE) * 0.25 AS miny, CAST((event_id * 7919) % 4400 AS DOUBLE) * 0.25 + CAST(1 + event_id % 7 AS DOUBLE) * 0.25 AS maxx,
 CAST((event_id * 104729) % 4400 AS DOUBLE) * 0.25 + CAST(1 + event_id % 5 AS DOUBLE) * 0.25 AS maxy"""
ROUTE = "user_id AS line_id, event_id AS seq, value AS x, CAST(event_id % 97 AS DOUBLE) * CAST(1.37 AS DOUBLE) AS y"
LIKERT = """CAST(user_id % 9 AS VARCHAR(8)) AS evaluator, event_type AS method, CAST(CASE WHEN event_id % 17 = 0 THEN NULL ELSE 1 + (event_id * 3) % 5 END AS DOUBLE) AS coverage,
 CAST(1 + (event_id * 7) % 5 AS DOUBLE) AS precision_, CAST(1 + (event_id * 11 + user_id) % 5 AS DOUBLE) AS operability, CAST(1 + (event_id * 13 + user_id * 3) % 5 AS DOUBLE) AS acceptability"""
PLACES = "event_id, CAST((event_id * 37) % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST((event_id * 53) % 16000 AS DOUBLE) / 100 - 80 AS lat"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WITH = f"""WITH RECURSIVE fields AS (SELECT {FIELDS} FROM nation), weeds AS (SELECT {WEEDS} FROM events), route AS (SELECT {ROUTE} FROM events), likert AS (SELECT {LIKERT} FROM events), places AS (SELECT {PLACES} FROM events),
clip AS (SELECT field_id, weed_id, greatest(w.minx, f.minx) AS minx, greatest(w.miny, f.miny) AS miny, least(w.maxx, f.maxx) AS maxx, least(w.maxy, f.maxy) AS maxy
 FROM weeds w JOIN fields f ON w.minx <= f.maxx AND f.minx <= w.maxx AND w.miny <= f.maxy AND f.miny <= w.maxy)
"""
MEANS = "s AS (SELECT evaluator, method, (coalesce(coverage, 0) + precision_ + operability + acceptability) / (3 + CASE WHEN coverage IS NULL THEN 0 ELSE 1 END) AS score FROM likert), m AS (SELECT evaluator, method, avg(score) AS score FROM s GROUP BY ALL)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = WITH + sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str, select: str) -> DataFrame:
    return spark.sql(f"SELECT {select} FROM {{t}}", t=spark.read.parquet(f"{d}/{name}.parquet"))


def fields(spark, d):
    return _table(spark, d, "nation", FIELDS)


def weeds(spark, d):
    return _table(spark, d, "events", WEEDS)


def route(spark, d):
    return _table(spark, d, "events", ROUTE)


def scores(spark, d):
    s = _table(spark, d, "events", LIKERT).withColumnRenamed("precision_", "precision")
    return likert.scored(s)


def clip(spark, d):
    j = clipped_box(overlapping(weeds(spark, d), fields(spark, d), 220.0))
    return j.select(F.col("r_field_id").alias("field_id"), F.col("l_weed_id").alias("weed_id"), "minx", "miny", "maxx", "maxy")


@query(", x AS (SELECT field_id, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, count(*) AS n FROM clip GROUP BY field_id) SELECT *, round((maxx - minx) * (maxy - miny), 4) AS area FROM x")
def aabb_cover(spark, d):
    """Bounding box of the detections in each field."""
    return treatment.bounds_of(clip(spark, d), "field_id").withColumn("area", F.round((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")), 4))


@query("SELECT f.field_id, count(weed_id) AS weeds FROM fields f LEFT JOIN clip USING (field_id) GROUP BY f.field_id")
def weeds_per_field(spark, d):
    return fields(spark, d).select("field_id").join(clip(spark, d).groupBy("field_id").agg(F.count("*").alias("weeds")), "field_id", "left").select("field_id", F.coalesce("weeds", F.lit(0)).alias("weeds"))


@query("SELECT field_id, weed_id, (maxx - minx) * (maxy - miny) AS area FROM clip WHERE maxx > minx AND maxy > miny")
def clip_rect(spark, d):
    return clip(spark, d).where("maxx > minx and maxy > miny").selectExpr("field_id", "weed_id", "(maxx - minx) * (maxy - miny) as area")


@query("SELECT field_id, weed_id, (maxx - minx) * (maxy - miny) AS area FROM clip WHERE maxx > minx AND maxy > miny")
def kernel_clip(spark, d):
    """The same areas from topology on WKB."""
    kernel.load(spark)
    w, f = (x.withColumn("geom", call("Rect", "minx", "miny", "maxx", "maxy")) for x in (weeds(spark, d), fields(spark, d)))
    j = overlapping(w, f, 220.0).where(call("Relate", "l_geom", "r_geom", F.lit("intersects")))
    area = call("Measure", call("Overlay", "l_geom", "r_geom", F.lit("intersection")), F.lit("area"))
    return j.select(F.col("r_field_id").alias("field_id"), F.col("l_weed_id").alias("weed_id"), area.alias("area")).where("area > 0")


@query(""", c AS (SELECT *, unnest(generate_series(CAST(floor(minx / 2) AS BIGINT), CAST(ceil(maxx / 2) AS BIGINT) - 1)) AS gx FROM clip WHERE maxx > minx AND maxy > miny),
 e AS (SELECT *, unnest(generate_series(CAST(floor(miny / 2) AS BIGINT), CAST(ceil(maxy / 2) AS BIGINT) - 1)) AS gy FROM c),
 o AS (SELECT field_id, weed_id, (least(maxx, gx * 2 + 2) - greatest(minx, gx * 2)) * (least(maxy, gy * 2 + 2) - greatest(miny, gy * 2)) / 4 AS fill FROM e)
 SELECT field_id, weed_id, count(*) AS cells, count(*) * 4.0::DOUBLE AS area FROM o WHERE fill >= 0.35 GROUP BY ALL""")
def fixed_grid_rect(spark, d):
    """Grid cells of 2 m that a detection fills to 35 % or more."""

    def cells(lo: str, hi: str):
        return F.explode(F.sequence(F.floor(F.col(lo) / 2), F.ceil(F.col(hi) / 2) - 1))

    def share(lo: str, hi: str, g: str):
        return F.least(F.col(hi), F.col(g) * 2 + 2) - F.greatest(F.col(lo), F.col(g) * 2)

    c = clip(spark, d).where("maxx > minx and maxy > miny").withColumn("gx", cells("minx", "maxx")).withColumn("gy", cells("miny", "maxy"))
    c = c.where(share("minx", "maxx", "gx") * share("miny", "maxy", "gy") / 4 >= 0.35)
    return c.groupBy("field_id", "weed_id").agg(F.count("*").alias("cells")).withColumn("area", F.col("cells") * F.lit(4.0))


@query(""", q AS (SELECT field_id, weed_id, (minx + maxx) / 2 AS p FROM clip), g AS (SELECT *, row_number() OVER w AS nth, p - lag(p) OVER w AS gap FROM q WINDOW w AS (PARTITION BY field_id ORDER BY p, weed_id)),
 h AS (SELECT *, max(p) OVER v - min(p) OVER v AS spread, max(gap) OVER v AS widest FROM g WINDOW v AS (PARTITION BY field_id)),
 k AS (SELECT *, min(CASE WHEN gap = widest THEN nth END) OVER (PARTITION BY field_id) AS cut FROM h)
 SELECT field_id, count(*) AS n, count(CASE WHEN spread > 0 AND widest / spread >= 0.1 AND widest >= 0.5 AND nth >= cut THEN 1 END) AS n_right FROM k GROUP BY field_id""")
def gap_split(spark, d):
    q = clip(spark, d).selectExpr("field_id", "weed_id", "(minx + maxx) / 2 as p")
    return paths.gap_split(q, "field_id", "p", "weed_id", 0.5).groupBy("field_id").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 1).alias("n_right"))


@query("SELECT line_id, round(degrees(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))), 6) AS angle FROM route GROUP BY line_id")
def principal_axis(spark, d):
    return measures.principal_axis(route(spark, d), "line_id").withColumn("angle", F.round("angle", 6))


def _rings(spark, d) -> DataFrame:
    g = route(spark, d).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    return g.select("line_id", F.concat("p", F.slice("p", 1, 1)).alias("ring"))


@query(""", n AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM route WINDOW w AS (PARTITION BY line_id ORDER BY seq))
 SELECT line_id, round(sum(x * ny - nx * y) / 2, 3) AS area, round(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))), 3) AS length FROM n GROUP BY line_id""")
def ring_area(spark, d):
    return _rings(spark, d).select("line_id", F.round(measures.signed_area(F.col("ring")), 3).alias("area"), F.round(measures.length(F.col("ring")), 3).alias("length"))


@query(""", o AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY line_id) AS n FROM route),
 t AS (SELECT b.line_id, sqrt((a.x - b.x)**2 + (a.y - b.y)**2) AS u, sqrt((c.x - b.x)**2 + (c.y - b.y)**2) AS v, (a.x - b.x) * (c.x - b.x) + (a.y - b.y) * (c.y - b.y) AS dot
  FROM o b JOIN o a ON a.line_id = b.line_id AND a.i = (b.i + b.n - 2) % b.n + 1 JOIN o c ON c.line_id = b.line_id AND c.i = b.i % b.n + 1)
 SELECT line_id, round(min(degrees(acos(greatest(-1.0, least(1.0, dot / (u * v)))))), 4) AS angle FROM t WHERE u > 0 AND v > 0 GROUP BY line_id""")
def min_interior_angle(spark, d):
    return _rings(spark, d).select("line_id", F.round(measures.min_interior_angle(F.col("ring")), 4).alias("angle"))


@query(""", t AS (SELECT *, lag(x, 1) OVER w AS bx, lag(y, 1) OVER w AS by_, lag(x, 2) OVER w AS ax, lag(y, 2) OVER w AS ay FROM route WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
 q AS (SELECT line_id, seq, sqrt((bx - ax)**2 + (by_ - ay)**2) * sqrt((x - bx)**2 + (y - by_)**2) * sqrt((ax - x)**2 + (ay - y)**2) AS abc, abs((bx - ax) * (y - ay) - (x - ax) * (by_ - ay)) / 2 AS s FROM t WHERE ax IS NOT NULL)
 SELECT line_id, seq, round(CASE WHEN abc > 0 THEN 4 * s / abc ELSE 0 END, 9) AS curvature, s <= 0 AS flat FROM q""")
def circumradius(spark, d):
    """All triples of neighbouring points; as 1 / radius, which is stable for nearly straight ones (0 where the radius is infinite)."""
    w = Window.partitionBy("line_id").orderBy("seq")
    p = F.struct("x", "y")
    t = route(spark, d).select("line_id", "seq", p.alias("c"), F.lag(p, 1).over(w).alias("b"), F.lag(p, 2).over(w).alias("a")).where("a is not null")
    t = t.withColumn("radius", measures.circumradius(F.col("a"), F.col("b"), F.col("c")))
    return t.select("line_id", "seq", F.round(1 / F.col("radius"), 9).alias("curvature"), (F.col("radius") == float("inf")).alias("flat"))


_TURNS = """, g AS (SELECT line_id, seq, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM route WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
 h AS (SELECT line_id, seq, sqrt(dx * dx + dy * dy) AS d, degrees(atan2(dy, dx)) AS a FROM g WHERE dx IS NOT NULL AND (dx <> 0 OR dy <> 0)),
 c AS (SELECT *, abs(a - lag(a) OVER (PARTITION BY line_id ORDER BY seq)) AS ch FROM h),
 r AS (SELECT *, sum(CASE WHEN least(ch, 360 - ch) >= 45 THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY seq) AS run FROM c),
 u AS (SELECT line_id, run, sum(d) AS length FROM r GROUP BY ALL)"""


@query(_TURNS + " SELECT line_id, CAST(max(run) AS BIGINT) AS turns, count(*) AS runs, round(sum(length), 3) AS total_length, round(avg(length), 4) AS mean_run, round(stddev_pop(length), 4) AS std_run FROM u GROUP BY line_id")
def turns_runs(spark, d):
    t = paths.turn_summary(route(spark, d))
    return t.select("line_id", "turns", "runs", F.round("total_length", 3).alias("total_length"), F.round("mean_run", 4).alias("mean_run"), F.round("std_run", 4).alias("std_run"))


@query(_TURNS + ", v AS (SELECT line_id, max(run) AS turns, sum(length) AS s FROM u GROUP BY line_id) SELECT CAST(line_id % 5 AS BIGINT) AS method, CAST(sum(turns) AS BIGINT) AS turns, round(sum(s), 2) AS total_length, round(sum(turns) / (sum(s) / 1000), 4) AS turns_per_km FROM v GROUP BY 1")
def method_rollup(spark, d):
    t = paths.turn_summary(route(spark, d)).withColumn("method", F.col("line_id") % 5)
    return t.groupBy("method").agg(F.sum("turns").alias("turns"), F.round(F.sum("total_length"), 2).alias("total_length"), F.round(F.sum("turns") / (F.sum("total_length") / 1000), 4).alias("turns_per_km"))


@query(""", s AS (SELECT line_id, seq, x, CAST(floor(y / 10) AS BIGINT) AS row_ FROM route), n AS (SELECT *, dense_rank() OVER (PARTITION BY line_id ORDER BY row_) AS nth FROM s)
 SELECT line_id, seq, row_number() OVER (PARTITION BY line_id ORDER BY nth, CASE WHEN nth % 2 = 1 THEN x ELSE -x END, seq) AS place FROM n""")
def zigzag_order(spark, d):
    s = route(spark, d).withColumn("row_", F.floor(F.col("y") / 10))
    return paths.zigzag(s, "line_id", "row_", "x", "seq").select("line_id", "seq", F.col("place").cast("long").alias("place"))


@query("""SELECT event_id, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(trunc((lon + 180) / 6) AS INTEGER) + 1 AS epsg,
 CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(greatest(CAST(floor((lon + 180) / 6) AS INTEGER) + 1, 1), 60) AS clamped FROM places""")
def utm_epsg(spark, d):
    p = _table(spark, d, "events", PLACES)
    return p.select("event_id", crs.utm_epsg(F.col("lon"), F.col("lat")).cast("int").alias("epsg"), crs.utm_epsg(F.col("lon"), F.col("lat"), clamp=True).cast("int").alias("clamped"))


def _forward_sql() -> str:
    e = f"{crs.ECCENTRICITY!r}::DOUBLE"
    xs = " + ".join(f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1))
    ys = " + ".join(f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1))
    return f""", a AS (SELECT event_id, radians(lon - ((CAST(trunc((lon + 180) / 6) AS INTEGER) + 1) * 6 - 183)) AS lam, tan(radians(lat)) AS t, lat < 0 AS south FROM places),
 b AS (SELECT *, sinh({e} * atanh({e} * t / sqrt(1 + t * t))) AS s FROM a), c AS (SELECT *, t * sqrt(1 + s * s) - s * sqrt(1 + t * t) AS tc FROM b),
 x AS (SELECT *, atan2(tc, cos(lam)) AS xi, asinh(sin(lam) / sqrt(tc * tc + cos(lam) * cos(lam))) AS eta FROM c)
 SELECT event_id, round(500000 + {crs.RADIUS!r}::DOUBLE * (eta + {ys}), 3) AS easting, round({crs.RADIUS!r}::DOUBLE * (xi + {xs}) + CASE WHEN south THEN 1e7 ELSE 0 END, 3) AS northing FROM x"""


@query(_forward_sql())
def utm_forward(spark, d):
    p = _table(spark, d, "events", PLACES)
    e, n = crs.forward(F.col("lon"), F.col("lat"), crs.zone(F.col("lon")), F.col("lat") < 0)
    return p.select("event_id", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@query(", s AS (SELECT *, (coalesce(coverage, 0) + precision_ + operability + acceptability) / (3 + CASE WHEN coverage IS NULL THEN 0 ELSE 1 END) AS score FROM likert) SELECT evaluator, method, round(score, 6) AS score, CAST(3 + CASE WHEN coverage IS NULL THEN 0 ELSE 1 END AS BIGINT) AS metrics_used, count(*) AS n FROM s GROUP BY ALL")
def likert_row_score(spark, d):
    return scores(spark, d).groupBy("evaluator", "method", F.round("score", 6).alias("score"), "metrics_used").agg(F.count("*").alias("n"))


def _means(spark, d):
    return survey_stats.method_means(scores(spark, d)).withColumn("score", F.round("score", 3))


@query(f", {MEANS}, q AS (SELECT evaluator, method, round(score, 3) AS score FROM m), r AS (SELECT method, rank() OVER (PARTITION BY evaluator ORDER BY score DESC) + (count(*) OVER (PARTITION BY evaluator, score) - 1) / 2 AS r FROM q) SELECT method, round(avg(r), 6) AS mean_rank, count(*) AS n FROM r GROUP BY method")
def mean_rank(spark, d):
    return survey_stats.mean_rank(_means(spark, d)).withColumn("mean_rank", F.round("mean_rank", 6))


_PAIRS = f", {MEANS}, q AS (SELECT evaluator, method, round(score, 3) AS score FROM m), p AS (SELECT a.method AS method_a, b.method AS method_b, a.evaluator, a.score - b.score AS diff FROM q a JOIN q b ON a.evaluator = b.evaluator AND a.method <> b.method)"


@query(_PAIRS + " SELECT method_a, method_b, count(*) AS n_pairs, count(CASE WHEN diff > 1e-12 THEN 1 END) AS wins, count(CASE WHEN abs(diff) <= 1e-12 THEN 1 END) AS ties, count(CASE WHEN diff < -1e-12 THEN 1 END) AS losses, round(avg(diff), 6) AS mean_difference FROM p GROUP BY ALL")
def win_tie_loss(spark, d):
    return survey_stats.win_tie_loss(survey_stats.paired(_means(spark, d))).drop("paired_evaluators").withColumn("mean_difference", F.round("mean_difference", 6))


@query(_PAIRS + """, l AS (SELECT method_a, method_b, list(diff ORDER BY evaluator) AS d FROM p GROUP BY ALL), k AS (SELECT *, unnest(generate_series(0, (1 << len(d)) - 1)) AS mask FROM l),
 z AS (SELECT method_a, method_b, abs(list_sum([CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN -d[i] ELSE d[i] END FOR i IN generate_series(1, len(d))])) / len(d) AS v, abs(list_sum(d)) / len(d) AS o FROM k)
 SELECT method_a, method_b, count(*) AS n_permutations, round(count(CASE WHEN v >= o - 1e-12 THEN 1 END) / count(*), 6) AS p_value FROM z GROUP BY ALL""")
def permutation_p(spark, d):
    return survey_stats.sign_flip_test(survey_stats.paired(_means(spark, d))).withColumn("p_value", F.round("p_value", 6))


@query(""", n AS (SELECT DISTINCT event_type || CASE WHEN user_id % 2 = 0 THEN '-mrr' ELSE '' END AS m FROM events)
 SELECT a.m AS method_a, b.m AS method_b, CASE WHEN b.m = left(a.m, greatest(length(a.m) - 4, 0)) THEN 'mrr_vs_manual' WHEN b.m IN ('view') THEN 'mrr_vs_baseline' WHEN ends_with(b.m, '-mrr') THEN 'mrr_vs_mrr' ELSE 'mrr_vs_other' END AS comparison_type FROM n a JOIN n b ON a.m <> b.m""")
def pair_labels(spark, d):
    n = spark.read.parquet(f"{d}/events.parquet").select(F.concat("event_type", F.when(F.col("user_id") % 2 == 0, "-mrr").otherwise("")).alias("m")).distinct()
    x = n.withColumnRenamed("m", "method_a").join(n.withColumnRenamed("m", "method_b"), F.col("method_a") != F.col("method_b"))
    return x.withColumn("comparison_type", survey_stats.comparison_type(F.col("method_a"), F.col("method_b"), ["view"]))


_RAW_IDS = "event_id, CASE event_id % 8 WHEN 0 THEN CAST(event_id AS VARCHAR(20)) WHEN 1 THEN concat(CAST(event_id AS VARCHAR(20)), '.0') WHEN 2 THEN concat(CAST(event_id AS VARCHAR(20)), '.5') WHEN 3 THEN 'true' WHEN 4 THEN ' Yes ' WHEN 5 THEN '' WHEN 6 THEN 'n' END AS raw"


@query(f", r AS (SELECT {_RAW_IDS} FROM events) SELECT event_id, CASE WHEN try_cast(trim(raw) AS DOUBLE) = floor(try_cast(trim(raw) AS DOUBLE)) THEN CAST(try_cast(trim(raw) AS DOUBLE) AS BIGINT) END AS field_id, CASE WHEN lower(trim(raw)) IN ('1', 'true', 'yes', 'y') THEN true WHEN lower(trim(raw)) IN ('0', 'false', 'no', 'n') THEN false ELSE coalesce(length(raw) > 0, false) END AS truth FROM r")
def norm_field_id(spark, d):
    r = _table(spark, d, "events", _RAW_IDS)
    return r.select("event_id", text.field_id(F.col("raw")).alias("field_id"), text.truth(F.col("raw")).alias("truth"))


_NAMES = "concat(CASE WHEN c_custkey % 3 = 0 THEN 'Spraying_' ELSE ' ' END, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN '__MRR ' ELSE ' (Ávila) utm' END) AS raw"


@query(f""", r AS (SELECT DISTINCT {_NAMES} FROM customer), i AS (SELECT raw, regexp_replace(regexp_replace(regexp_replace(replace(trim(lower(strip_accents(raw))), '_', '-'), '[^a-z0-9-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g') AS id FROM r),
 w AS (SELECT raw, id, [CASE WHEN t IN ('mrr', 'bp', 'mops', 'aabb', 'bcd', 'utm', 'wgs') THEN upper(t) ELSE upper(left(t, 1)) || lower(substr(t, 2)) END FOR t IN string_split(regexp_replace(id, '^spraying-', ''), '-')] AS words FROM i)
 SELECT raw, id, array_to_string(words, ' ') AS label, regexp_replace(lower(strip_accents(raw)), '[^a-z0-9]+', '', 'g') AS key FROM w""")
def label_format(spark, d):
    r = _table(spark, d, "customer", _NAMES).distinct()
    return r.select("raw", text.method_id(F.col("raw")).alias("id"), text.method_label(F.col("raw")).alias("label"), text.column_key(F.col("raw")).alias("key"))


@query("""SELECT * FROM (VALUES ('mrr', 'mrr'), ('minimum-rotated-rectangle', 'mrr'), ('minimum-rotated-rectangles', 'mrr'), ('rotated-rectangle', 'mrr'),
 ('bcd', 'bcd'), ('boustrophedon', 'bcd'), ('boustrophedon-cellular', 'bcd'), ('fixed-grid', 'fixed-grid'), ('grid', 'fixed-grid'), ('grid-fixed', 'fixed-grid'), ('chessboard', 'fixed-grid'),
 ('chessboard-segmentation', 'fixed-grid'), ('quadtree', 'quadtree'), ('quad-tree', 'quadtree'), ('convex-hull', 'convex-hull'), ('convex', 'convex-hull'), ('concave-hull', 'concave-hull'),
 ('concave', 'concave-hull'), ('alpha-shape', 'concave-hull'), ('alphashape', 'concave-hull'), ('aabb', 'aabb'), ('bbox', 'aabb'), ('axis-aligned-bounding-box', 'aabb'),
 ('morph-closing', 'morph-closing'), ('morphological-closing', 'morph-closing'), ('closing', 'morph-closing'), ('strip-based', 'strip-based'), ('swath-aligned', 'strip-based'),
 ('strip-based-merging', 'strip-based'), ('1d-striping', 'strip-based')) t(name, method)""")
def norm_method(spark, d):
    """Every known name, as the coverage method that it stands for."""
    rows = spark.createDataFrame([(k,) for k in (*ALIASES, *METHODS)], "name string")
    return rows.select("name", text.coverage_method(F.upper(F.replace("name", F.lit("-"), F.lit("_")))).alias("method"))


_GEO = "concat('{\"coordinates\":[', CAST(event_id AS VARCHAR(20)), ',', CAST(user_id AS VARCHAR(20)), '],\"type\":\"Point\"}')"


@query(f", h AS (SELECT event_id, substr(md5({_GEO}), 1, 10) AS hash, event_type FROM events) SELECT event_id, hash FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE event_type = 'error')")
def removed_anti(spark, d):
    """Hashes of features that were not removed."""
    h = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", text.feature_hash(F.expr(_GEO.replace("VARCHAR(20)", "STRING"))).alias("hash"))
    return h.join(h.where("event_type = 'error'").select("hash"), "hash", "left_anti").select("event_id", "hash")


@query("SELECT field_id, weed_id, row_number() OVER (PARTITION BY field_id ORDER BY weed_id) - 1 AS pid FROM clip")
def pid_sequence(spark, d):
    w = Window.partitionBy("field_id").orderBy("weed_id")
    return clip(spark, d).select("field_id", "weed_id", (F.row_number().over(w) - 1).cast("long").alias("pid"))


@query("SELECT CAST(count(CASE WHEN event_id % 3 = 0 OR event_id % 5 = 1 THEN 1 END) AS BIGINT) AS obstacles, CAST(count(CASE WHEN NOT (event_id % 3 = 0 OR event_id % 5 = 1) THEN 1 END) AS BIGINT) AS fields FROM events")
def split_obstacles(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    f = e.select(F.lit("{}").alias("geometry"), F.create_map(F.lit("obstacle"), F.when(F.col("event_id") % 3 == 0, "True").when(F.col("event_id") % 5 == 1, "yes").otherwise("no")).alias("properties"))
    a, b = geojson.split_obstacles(f)
    n = a.agg(F.count("*").alias("fields")).crossJoin(b.agg(F.count("*").alias("obstacles")))
    return n.select("obstacles", "fields")


@query(""", p AS (SELECT line_id, list(x ORDER BY x) AS xs FROM route GROUP BY line_id), k AS (SELECT line_id, list_reduce(list_prepend([xs[1]], [[v] FOR v IN xs]), lambda a, v: CASE WHEN v[1] - a[len(a)] > 2.5 THEN list_concat(a, v) ELSE a END) AS kept FROM p)
 SELECT line_id, CAST(len(kept) AS BIGINT) AS n, round(list_sum(kept), 3) AS total FROM k""")
def spaced_positions(spark, d):
    g = route(spark, d).groupBy("line_id").agg(measures.spaced_positions(F.collect_list("x"), 2.5).alias("kept"))
    return g.select("line_id", F.size("kept").cast("long").alias("n"), F.round(F.aggregate("kept", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


@query(""", t AS (SELECT event_type AS method, min(minx) AS x0, min(miny) AS y0, max(maxx) - 10 * (ascii(event_type) - 97) AS x1, max(maxy) AS y1 FROM (SELECT event_type, event_id AS weed_id FROM events) JOIN weeds USING (weed_id) GROUP BY event_type),
 u AS (SELECT a.method AS method1, b.method AS method2, (a.x1 - a.x0) * (a.y1 - a.y0) AS a1, (b.x1 - b.x0) * (b.y1 - b.y0) AS a2, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i FROM t a JOIN t b ON a.method < b.method)
 SELECT method1, method2, round(i / (a1 + a2 - i), 6) AS iou, round(100 * i / a1, 4) AS agreement_m1_in_m2_pct, round(a1, 3) AS area1_m2, round(a2, 3) AS area2_m2 FROM u""")
def iou_pairs(spark, d):
    kernel.load(spark)
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.col("event_id").alias("weed_id"))
    b = treatment.bounds_of(weeds(spark, d).join(e, "weed_id"), "event_type").withColumn("maxx", F.col("maxx") - 10 * (F.ascii("event_type") - 97))
    r = evaluate.iou_report(b.select(F.col("event_type").alias("method"), call("Rect", "minx", "miny", "maxx", "maxy").alias("geom")))
    return r.select("method1", "method2", F.round("iou", 6).alias("iou"), F.round("agreement_m1_in_m2_pct", 4).alias("agreement_m1_in_m2_pct"), F.round("area1_m2", 3).alias("area1_m2"), F.round("area2_m2", 3).alias("area2_m2"))


def metric_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """(detections, fields) as (ord, geom, minx..maxy)."""
    kernel.load(spark)
    out = [x.withColumn("geom", call("Rect", "minx", "miny", "maxx", "maxy")).withColumnRenamed(k, "ord") for x, k in ((weeds(spark, d), "weed_id"), (fields(spark, d), "field_id"))]
    return out[0].drop("weed_id"), out[1].drop("field_id")


CONFIG = PlanConfig(min_polygon_area_m2=5.0, merge_distance_m=3.0, rectangle_max_depth=4)


def _treated(spark, d, method: str) -> DataFrame:
    w, f = metric_inputs(spark, d)
    obstacles = f.select("ord", *[(F.col(c) + (80.0 if c.startswith("min") else -80.0)).alias(c) for c in ("minx", "miny", "maxx", "maxy")])
    obstacles = obstacles.withColumn("geom", call("Rect", "minx", "miny", "maxx", "maxy"))
    return treatment.treat(w, f, obstacles, CONFIG.replace(coverage_method=method))


def _register_methods() -> None:
    for m in METHODS:

        def run(spark, d, m=m):
            t = _treated(spark, d, m)
            area = F.sum(call("Measure", "geom", F.lit("area")))
            return t.groupBy(F.col("field").alias("field_id")).agg(F.count("*").alias("pieces"), F.round(area, 2).alias("area_m2"))

        run.__name__ = "treat_" + m.replace("-", "_")
        query()(run)


_register_methods()


def _lines(spark, d) -> tuple[DataFrame, DataFrame]:
    _, f = metric_inputs(spark, d)
    fields_, hole = f.select(F.col("ord").alias("field"), "geom"), f.select(F.col("ord").alias("field"), call("Rect", F.col("minx") + 80, F.col("miny") + 80, F.col("maxx") - 80, F.col("maxy") - 40).alias("geom"))
    return fields_, evaluate.flight_lines(fields_, hole, 10.0, 0.0)


@query()
def flight_lines(spark, d):
    _, lines = _lines(spark, d)
    return lines.select("field", "part", F.round(call("Measure", "line", F.lit("length")), 3).alias("length"), call("ToJson", "line").alias("geometry"))


@query()
def geometric_metrics(spark, d):
    f, lines = _lines(spark, d)
    return evaluate.geometric_metrics(f.withColumn("method", F.lit("field")), lines.withColumn("method", F.lit("field")), 10.0)


@query()
def sensitivity(spark, d):
    w, _ = metric_inputs(spark, d)
    files = w.select((F.col("ord") % 3).alias("file"), "ord", "geom")
    return evaluate.sensitivity(files, [x / 100 for x in range(51)], [2, 4, 8])


@query()
def bootstrap_ci(spark, d):
    return survey_stats.bootstrap(scores(spark, d))


@query(_PAIRS + """, m2 AS (SELECT method_a, method_b, round(avg(diff), 6) AS md FROM p GROUP BY ALL) SELECT method_a, max(md) FILTER (method_b = 'click') AS click, max(md) FILTER (method_b = 'error') AS error,
 max(md) FILTER (method_b = 'purchase') AS purchase, max(md) FILTER (method_b = 'signup') AS signup, max(md) FILTER (method_b = 'view') AS view FROM m2 GROUP BY method_a""")
def method_heatmap(spark, d):
    r = survey_stats.win_tie_loss(survey_stats.paired(_means(spark, d))).withColumn("mean_difference", F.round("mean_difference", 6))
    return survey_stats.heatmap(r)
