"""Operator 6: mix sources to target weights by subset-sum budget fitting.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ...; together they get 150 %
of all words, no source more than twice its own words, and what a cap cuts off is shared again by
weight (the limit of that is closed: target = min(2 size, level x weight)).

Per source: the target takes every document `floor(target / size)` times and leaves a budget below
the source's size.  Documents are counted by exact length.  A seeded share of every length's
documents goes into the budget first; the remainder, at most one document of each length, is fitted
by a bounded-knapsack dynamic programme over the documents left.  Its input is one row per (source,
length), so a task sees lengths, never documents.  Then as many documents of each length as were
chosen are selected by seeded hash: a length is dealt over buckets of about BUCKET documents, whole
buckets are taken or left by their counts, and only the documents of one boundary bucket are ranked.
So neither a hot source nor a length that a third of all rows share meets in one task.

Null text has size 0 and is never taken; a source without words has target 0.  Rows with equal
(doc_id, text) are told apart only by their rank among each other; a null doc_id is an id like others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import spare_name, written

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
BUCKET = 4096
DP_WORDS = 1 << 17


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(seed: int, doc_id: str, text: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`"))


def targets(sizes: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """(source, source_size, target), one row per source.

    Water level: with sources ordered by cap/weight, those before the first that stays under the
    level are capped.  One task sees all sources, as a row each.
    """
    s = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    order = Window.orderBy(F.col(source).isNull(), F.col(source))
    s = s.withColumn("w", F.array(*map(F.lit, WEIGHTS))[(F.row_number().over(order) - 1) % len(WEIGHTS)].cast("double"))
    s = s.withColumn("cap", F.col("source_size") * float(CAP))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    ahead = Window.orderBy("ratio", F.col(source).isNull(), F.col(source)).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * SHARE
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(ahead), F.lit(0.0))))
    entire = ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(entire)
    return s.select(source, "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", level * F.col("w"))).alias("target"))


def fit(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to the budget, from below, as the programme can."""
    length, count = length.astype(np.int64), count.astype(np.int64)
    total = int((length * count).sum())
    if budget >= total:
        return count.copy()
    take = (count.astype(object) * budget // max(total, 1)).astype(np.int64)
    left = budget - int((take * length).sum())
    for i in np.argsort(-length, kind="stable"):  # bring what is left into the programme's range, long ones first
        if left <= DP_WORDS:
            break
        n = min(int(count[i] - take[i]), (left - DP_WORDS // 2) // int(length[i])) if length[i] else 0
        take[i] += max(n, 0)
        left -= max(n, 0) * int(length[i])
    for i in np.argsort(-length, kind="stable"):  # still out of range: take what fits, so that the cap leaves nothing out that does
        if left <= DP_WORDS:
            break
        n = min(int(count[i] - take[i]), left // int(length[i]), -((DP_WORDS - left) // int(length[i]))) if length[i] else 0
        take[i] += n
        left -= n * int(length[i])
    return take + _knapsack(length, count - take, min(left, DP_WORDS))


def _knapsack(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum, largest reachable total up to the budget; counts in binary splits."""
    take = np.zeros(len(length), np.int64)
    if budget <= 0:
        return take
    reach, by, items = 1, np.full(budget + 1, -1, np.int64), []
    full = (1 << (budget + 1)) - 1
    for i in np.argsort(-length, kind="stable"):
        n, part = min(int(count[i]), budget // int(length[i])) if length[i] else 0, 1
        while n > 0:
            m = min(part, n)
            n, part = n - m, part * 2
            new = (reach << (m * int(length[i]))) & full & ~reach
            if new:
                reach |= new
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(items)
                items.append((i, m))
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    while at > 0:  # a total was first reached from one that items before it reach
        i, m = items[by[at]]
        take[i] += m
        at -= m * int(length[i])
    return take


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: int = 17) -> DataFrame:
    """(doc_id, h, size, source_size, target, taken, copies): how often each document goes into the mix; h is row_hash()."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), row_hash(seed, doc_id, text).alias("h"))
    d = written(d, "sizes")
    lengths = d.groupBy("source", "size").agg(F.count("*").alias("n"))
    goal = targets(lengths.select("source", (F.col("n") * F.col("size")).alias("size"))).withColumnRenamed("source", "g_source")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        whole = int(target // total) if total else 0
        rest = round(target) - whole * total if total else 0
        rows["whole"] = np.where(rows["size"] > 0, whole, 0)
        rows["extra"] = np.where(rows["size"] > 0, fit(rows["size"].to_numpy(), np.where(rows["size"] > 0, rows["n"], 0), max(rest, 0)), 0) if whole < CAP else 0
        return rows[["source", "size", "n", "source_size", "target", "whole", "extra"]]

    joined = lengths.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).select("source", "size", "n", "source_size", "target")
    plan = joined.groupBy("source").applyInPandas(choose, "source string, size long, n long, source_size long, target double, whole int, extra long")
    plan = written(plan, "plan").withColumnRenamed("source", "p_source").withColumnRenamed("size", "p_size")
    x = d.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).drop("p_source", "p_size")
    # whole lengths need no choice; the rest goes through buckets of a bounded number of documents
    open_ = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    x = x.withColumn("bucket", F.when(open_, F.pmod("h", F.ceil(F.col("n") / F.lit(BUCKET)))))
    key = ["source", "size", "bucket"]
    sums = x.where(open_).groupBy(*key, "extra").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("m")
    sums = sums.select(*[F.col(k).alias("s_" + k) for k in key], F.greatest(F.least(F.col("extra") - before, F.col("m")), F.lit(0)).alias("quota"), "m")
    same = F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")) & (F.col("bucket") == F.col("s_bucket"))
    y = x.where(open_).join(sums, same)
    border = (F.col("quota") > 0) & (F.col("quota") < F.col("m"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id"))
    out = ["doc_id", "h", "size", "source_size", "target", "whole"]
    parts = [
        x.where(~open_).select(*out, (F.col("extra") > 0).cast("int").alias("one")),
        y.where(~border).select(*out, (F.col("quota") > 0).cast("int").alias("one")),
        y.where(border).withColumn("r", rank).select(*out, (F.col("r") <= F.col("quota")).cast("int").alias("one")),
    ]
    copies = (F.col("whole") + F.col("one")).cast("int")
    return parts[0].union(parts[1]).union(parts[2]).select("doc_id", "h", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, seed: int = 17, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them.

    A row is named by its doc_id (null is an id as any other) and text; rows that agree in both are
    taken as often as the one of them that is taken most.
    """
    h, n, d = (spare_name(docs, x) for x in ("h", "n", "d"))
    copies = mix(docs, source, text, doc_id, seed).where("copies > 0").groupBy(F.col("h").alias(h), F.col("doc_id").alias(d)).agg(F.max("copies").alias(n))
    again = docs.withColumn(h, row_hash(seed, doc_id, text)).join(copies, h).where(F.col(f"`{doc_id}`").eqNullSafe(F.col(d)))
    return again.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
