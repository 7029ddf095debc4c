"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds after which the search gives up; each shortens paths by a constant factor, so a real graph needs few.
MOST_ROUNDS = 60


def _kept(df: DataFrame) -> DataFrame:
    """df in a table of the shared folder, or a reliable checkpoint where Spark has a folder for those."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/frameloom-graph-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a vertex to the smallest vertex around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
    # repeated edges may come of it; the small step, which follows, drops them
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a vertex and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionByName(least.select("a", F.col("root").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest vertex that each vertex of an edge can reach. Vertices without edges are left out.

    Alternates two steps that both keep connectivity and pull vertices to the smallest one near them, until the edges
    are stars. Each step is a group-by and a join, so no neighbourhood is gathered in one row; every round goes to a
    table in the shared folder. Null ends, loops and repeated edges are ignored.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = _kept(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(MOST_ROUNDS):
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sign) == state or not sign[0]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select("b", "b").distinct().toDF("id", "component")).distinct()
        state = tuple(sign)
        now = _kept(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
