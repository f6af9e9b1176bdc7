"""Parquet tables by name, and CSV reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_load_csv(load: DataFrame, folder: str, sigma: float) -> str:
    """Write (id, records) of a partition load in order of id with a header, as one file for each folder; the folder's path."""
    path = f"{folder.rstrip('/')}/{'uniform' if sigma == 0 else 'skew'}_data.csv"
    load.select("id", "records").coalesce(1).sortWithinPartitions("id").write.mode("overwrite").csv(path, header=True)
    return path
