"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations keyed by node.  The node's smallest neighbour is found with a
map-side combined min and joined back, so no neighbour list is ever gathered in one task; nodes with
a thousandth of all edges or more get it by broadcast, so that their edges stay where they are.  Lineage is cut after each round with
a table in the shared folder.  The edges stay distributed; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import forget, join_back, written


def components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge to another node; root: smallest node of its component.

    Rows with a null end and self-loops are ignored; repeated edges count once.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    )
    e = written(e.distinct(), "edges")
    n = e.count()
    if not n:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    for _ in range(max_rounds):
        # large star: for every node, hang its larger neighbours on its smallest neighbour (itself included)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_back(both.where("v > u"), low, ["u"], "n", 2 * n, write=False).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: hang a node and its smaller neighbours on the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        last, e = e, written(small.where("u <> v").distinct(), "edges")
        forget(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        n = now[0]
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
