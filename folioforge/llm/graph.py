"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import discard, stage

def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest id around itself to its larger neighbours."""
    both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest id around itself to its smaller neighbours and itself."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst")
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    moved = down.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionAll(least.select("src", F.col("m").alias("dst"))).where("src <> dst")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(src, dst); root is the smallest id that links reach.

    Every round is two shuffles on node ids and is written to the shared folder; rounds grow with the logarithm
    of a component's size. Only counts reach the driver.
    """
    now = stage(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct(), "edges")
    sign = None
    for _ in range(most_rounds):
        nxt = stage(_small_star(_large_star(now).distinct()).distinct(), "edges")
        discard(now)
        now = nxt
        row = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(src, dst))")).first()
        if tuple(row) == sign:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionAll(now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
        sign = tuple(row)
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")
