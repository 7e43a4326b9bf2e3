"""Polylines as rows (line, seq, x, y): turns, straight runs, zigzag order, gap splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_DEG = 45.0


def straight_runs(points: DataFrame, key: str = "line_id", seq: str = "seq", turn_deg: float = TURN_DEG) -> DataFrame:
    """(key, run, length): the straight runs between turns of at least turn_deg; runs of no length are dropped.

    Segments of no length never turn and are left out before headings are compared.
    """
    w = Window.partitionBy(key).orderBy(seq)
    seg = points.select(key, seq, (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy")).where("dx is not null")
    seg = seg.select(key, seq, F.hypot("dx", "dy").alias("d"), F.degrees(F.atan2("dy", "dx")).alias("heading")).where("d > 0")
    change = F.abs(F.col("heading") - F.lag("heading").over(w))
    seg = seg.withColumn("turn", F.coalesce((F.least(change, 360 - change) >= turn_deg).cast("int"), F.lit(0)))
    seg = seg.withColumn("run", F.sum("turn").over(w))
    return seg.groupBy(key, "run").agg(F.sum("d").alias("length"))


def turn_stats(points: Column, turn_deg: float = TURN_DEG) -> Column:
    """struct(turns, runs, length) of a polyline given as array of [x, y], as turn_summary() has them; null without a segment of some length.

    For lines that fit into a row: no rows, no windows.
    """
    n = F.size(points)
    x, y = (lambda p, i=i: F.get(p, i) for i in (0, 1))

    def segment(p: Column, q: Column) -> Column:
        return F.struct(F.hypot(x(q) - x(p), y(q) - y(p)).alias("d"), F.degrees(F.atan2(y(q) - y(p), x(q) - x(p))).alias("heading"))

    segments = F.filter(F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), segment), lambda v: v["d"] > 0)
    m = F.size(segments)

    def turns(a: Column, b: Column) -> Column:
        change = F.abs(b["heading"] - a["heading"])
        return (F.least(change, 360 - change) >= turn_deg).cast("long")

    n_turns = F.aggregate(F.zip_with(F.slice(segments, 1, m - 1), F.slice(segments, 2, m - 1), turns), F.lit(0).cast("long"), lambda a, v: a + v)
    length = F.aggregate(segments, F.lit(0.0), lambda a, v: a + v["d"])
    return F.when((n > 1) & (m > 0), F.struct(n_turns.alias("turns"), (n_turns + 1).alias("runs"), length.alias("length")))


def turn_summary(points: DataFrame, key: str = "line_id", seq: str = "seq") -> DataFrame:
    """(key, turns, runs, total_length, mean_run, std_run) per line; std is of the population."""
    runs = straight_runs(points, key, seq)
    return runs.groupBy(key).agg(F.max("run").cast("long").alias("turns"), F.count("*").alias("runs"), F.sum("length").alias("total_length"), F.avg("length").alias("mean_run"), F.stddev_pop("length").alias("std_run"))


def zigzag(segments: DataFrame, key: str, row: str, x: str, tie: str) -> DataFrame:
    """segments with `place`, their order in a zigzag: rows in turn, every second non-empty row backwards."""
    rows = Window.partitionBy(key).orderBy(row)
    s = segments.withColumn("nth_row", F.dense_rank().over(rows))
    back = F.when(F.col("nth_row") % 2 == 1, F.col(x)).otherwise(-F.col(x))
    return s.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("nth_row", back, tie)))


def gap_split(items: DataFrame, key: str, position: str, order: str, merge_distance: float) -> DataFrame:
    """items with `side` (0 or 1): cut at the first largest gap of positions in each key.

    No cut (all 0) if positions do not spread, the gap is under a tenth of the spread, or under merge_distance.
    """
    w = Window.partitionBy(key).orderBy(position, order)
    whole = Window.partitionBy(key)
    x = items.withColumn("nth", F.row_number().over(w)).withColumn("gap", F.col(position) - F.lag(position).over(w))
    x = x.withColumn("spread", F.max(position).over(whole) - F.min(position).over(whole)).withColumn("widest", F.max("gap").over(whole))
    x = x.withColumn("cut", F.min(F.when(F.col("gap") == F.col("widest"), F.col("nth"))).over(whole))
    ok = (F.col("spread") > 0) & (F.col("widest") / F.col("spread") >= 0.1) & (F.col("widest") >= merge_distance)
    return x.withColumn("side", F.when(ok & (F.col("nth") >= F.col("cut")), 1).otherwise(0)).drop("nth", "gap", "spread", "widest", "cut")


def along_axis(items: DataFrame, key: str, x: str, y: str, axis: tuple[float, float], tie: str) -> DataFrame:
    """items with `position` (their point times the axis) and `nth`, their order along it within the key, ties by `tie`."""
    position = F.col(x) * axis[0] + F.col(y) * axis[1]
    return items.withColumn("position", position).withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("position", tie)))
