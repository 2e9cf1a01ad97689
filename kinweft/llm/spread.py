"""Spreading rows over the cores before work in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kinweft.session import tasks


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """df in at least as many partitions as keep all cores busy; untouched where it has them."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(max(n * factor, tasks(df.sparkSession)))
