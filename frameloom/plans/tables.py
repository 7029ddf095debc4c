"""The driver's tables, and the roles that they play for the operators.

Events are observations: an hour since the first of January 2024 is a frame, the user an object, the value a place and
the number in props a score. Parts are candidates on a plane of price and size; orders are items under review.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOURS, DAYS = 720, 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with micros since 2024, hour, day and k (the number in props)."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))")
    rows = table(spark, sf_dir, "events").withColumn("micros", micros)
    rows = rows.withColumn("hour", F.floor(F.col("micros") / 3_600_000_000).cast("int")).withColumn("day", F.floor(F.col("micros") / 86_400_000_000).cast("int"))
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


#: The same in DuckDB, as a common table expression.
EVENTS_SQL = """e AS (SELECT *, epoch_us(ts) - 1704067200000000 AS micros, ((epoch_us(ts) - 1704067200000000) // 3600000000)::INT AS hour,
                      ((epoch_us(ts) - 1704067200000000) // 86400000000)::INT AS day, json_extract_string(props, '$.k')::INT AS k FROM events)"""
