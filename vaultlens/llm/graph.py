"""Connected components as Spark jobs; no node or link comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.session import scratch_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b).

    Alternating large-star and small-star steps: every node's neighbours are
    hung to the smallest of them until nothing changes. A round is written to
    the shared folder; minima are taken within each task first, and joins on
    nodes with many neighbours can be split.
    """
    spark = edges.sparkSession
    current = _written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    while True:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        following = _written(small)
        if not _differ(current, following):
            break
        current = following
    roots = current.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())


def _written(edges: DataFrame) -> DataFrame:
    folder = scratch_dir(edges.sparkSession, "edges")
    edges.write.parquet(folder)
    return edges.sparkSession.read.parquet(folder)


def _differ(one: DataFrame, other: DataFrame) -> bool:
    """Whether two edge tables differ, by count and sum of hashes."""
    told = lambda f: tuple(f.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    return told(one) != told(other)
