"""Readers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one Parquet table, pruned to ``columns`` when any are given."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scan_parts(df: DataFrame) -> int:
    """Number of tasks that read the tables under ``df``; nothing is run, whatever is done to the rows above."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return sum(leaf.execute().getNumPartitions() for leaf in found)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Give Python stages one task per core and more, where a file arrives as fewer tasks than cores.

    A table that is already read by at least as many tasks as the cluster has cores is left as it is, so large
    inputs are never moved; only files that form too few scan tasks are dealt out round-robin.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if scan_parts(df) >= cores:
        return df
    return df.repartition(cores * 2, *[F.col(c) for c in columns])
