"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (partial on the map side) and a join that AQE can
split at a hub; each round is written to the shared folder, so a lost executor
costs one round at most. No edge or label reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


def _star(directed: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest of u and its neighbours."""
    low = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(low, "u")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v: long) to (node, root): root is the smallest node of the component.

    Nodes without an edge to another node don't appear. Self-loops and repeated edges are
    allowed; an empty table gives an empty result."""
    spark = edges.sparkSession
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        down = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        then = stage(down.where("u <> v").distinct(), "edges")
        drop_stage(spark, now)
        now = then
    else:
        raise RuntimeError("components didn't settle")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
