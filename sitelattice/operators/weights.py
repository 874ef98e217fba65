"""Choosing a grid value per group by its mean score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_weight(df: DataFrame, groups: list[str], weight: str, value: str) -> DataFrame:
    """Grid point with the highest mean value per group; the smallest of equals wins."""
    m = df.groupBy(*groups, weight).agg(F.avg(value).alias(value))
    b = m.groupBy(*groups).agg(F.max(F.struct(
        F.col(value), (-F.col(weight)).alias("__w"))).alias("b"))
    return b.select(*groups, (-F.col("b.__w")).alias(weight), F.col(f"b.{value}").alias(value))
