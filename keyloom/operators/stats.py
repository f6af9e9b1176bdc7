"""Statistics of samples, key frequencies and partition loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.u64 import percentage
from keyloom.operators.partition import histogram


def sample_stats(x: Column) -> list[Column]:
    """mean, median (of two middle values their mean) and population standard deviation; 0 for no samples."""
    zero = F.lit(0.0)
    return [F.coalesce(F.avg(x), zero).alias("mean"), F.coalesce(F.median(x), zero).alias("median"), F.coalesce(F.stddev_pop(x), zero).alias("std")]


def key_frequency(relation: DataFrame, key: str) -> DataFrame:
    """(key, n)."""
    return relation.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("key")).agg(F.count("*").alias("n"))


def partition_load(relation: DataFrame, key: str, p: int) -> DataFrame:
    """(id, records, percent) of every partition; percent has two decimals."""
    total = F.sum("n").over(Window.partitionBy())
    return histogram(relation, key, p).select(F.col("pid").alias("id"), F.col("n").alias("records"), F.round(percentage(F.col("n"), total), 2).alias("percent"))


def critical_path(times: DataFrame) -> DataFrame:
    """(phase, seconds): the slowest worker's sum for each phase, from rows (worker, phase, seconds)."""
    return times.groupBy("worker", "phase").agg(F.sum("seconds").alias("s")).groupBy("phase").agg(F.max("s").alias("seconds"))
