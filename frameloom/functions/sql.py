"""Names for SQL: the driver's tables as views, and functions of the operators for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Expressions that SQL can call by name; none runs Python.
FUNCTIONS = {
    "safe_ratio(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "coalesce(try_divide(a, b), 0D)",
    "clamp(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE": "greatest(low, least(high, x))",
    "nearest_rank(v ARRAY<DOUBLE>, q DOUBLE) RETURNS DOUBLE": "CASE WHEN size(v) = 0 THEN 0D ELSE element_at(array_sort(v), cast(bround((size(v) - 1) * q, 0) AS INT) + 1) END",
    "binary_kappa(observed DOUBLE, pa DOUBLE, pb DOUBLE) RETURNS DOUBLE": "CASE WHEN pa * pb + (1 - pa) * (1 - pb) >= 1 THEN CASE WHEN observed = 1 THEN 1D ELSE 0D END ELSE (observed - pa * pb - (1 - pa) * (1 - pb)) / (1 - pa * pb - (1 - pa) * (1 - pb)) END",
    "balance(tpr DOUBLE, fppi DOUBLE, fppi_limit DOUBLE) RETURNS DOUBLE": "tpr - fppi / fppi_limit",
    "frame_seconds(frame BIGINT, rate DOUBLE) RETURNS DOUBLE": "CASE WHEN rate > 0 THEN frame / rate END",
}


def register(spark: SparkSession) -> None:
    """Makes the functions callable in this session's SQL."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def views(spark: SparkSession, sf_dir: str) -> None:
    """The driver's tables as temporary views."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
