"""Connected components of an undirected graph, by alternating large and small stars.

Every round points nodes at the smallest neighbour they know of. A star's centre is found with
partial aggregation and written before the edges are joined with it: the join then reads two
plain shuffles, and Spark can split a node with very many neighbours. Each round is written
below the shared folder, which also cuts the lineage. Nothing but one checksum a round comes
to the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourlake.llm.common import drop_folder, folder, stored


def _large_star(edges: DataFrame, at: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), f"{at}/large")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, at: str) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")), f"{at}/small")
    moved = down.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root (the smallest node of its component), for every node of edges (a, b)."""
    spark = edges.sparkSession
    at = folder(spark, name)
    now = stored(edges.select("a", "b").where("a <> b").distinct(), f"{at}/0")
    sign = None
    for step in range(1, 200):
        larger = stored(_large_star(now, f"{at}/centres{step}"), f"{at}/larger{step}")
        now = stored(_small_star(larger, f"{at}/centres{step}"), f"{at}/{step}")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        for old in (f"{step - 1}", f"larger{step}", f"centres{step}"):
            drop_folder(spark, f"{at}/{old}")
        if new == sign:
            break
        sign = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
