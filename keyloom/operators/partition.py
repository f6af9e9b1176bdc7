"""Radix partitions: the map from key to partition, dense histograms, offsets, chunk matrices, stable layouts.

Keys are BIGINT; null keys belong to no partition and are left out, as an equi-join would leave them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.u64 import is_power_of_two

#: Partition ids are 16 bits wide.
MOST_PARTITIONS = 1 << 16


def check_partitions(p: int) -> int:
    if not is_power_of_two(p) or p > MOST_PARTITIONS:
        raise ValueError(f"the number of partitions must be a power of two up to {MOST_PARTITIONS}, not {p}")
    return p


def partition_id(key: Column, p: int) -> Column:
    """(key xor (key >> 32)) and (p - 1)."""
    check_partitions(p)
    key = key.cast("bigint")
    return key.bitwiseXOR(F.shiftrightunsigned(key, 32)).bitwiseAND(F.lit(p - 1).cast("bigint")).cast("int")


def with_partition(relation: DataFrame, key: str, p: int) -> DataFrame:
    return relation.where(F.col(key).isNotNull()).withColumn("pid", partition_id(F.col(key), p))


def histogram(relation: DataFrame, key: str, p: int) -> DataFrame:
    """(pid, n) of every partition, empty ones with 0."""
    counts = with_partition(relation, key, p).groupBy("pid").agg(F.count("*").alias("n"))
    every = relation.sparkSession.range(p, numPartitions=1).select(F.col("id").cast("int").alias("pid"))
    return every.join(counts, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _before(*order: str) -> Column:
    """Exclusive running sum of n; the frame holds partitions or partitions times chunks, never rows of data."""
    return F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")


def offsets(relation: DataFrame, key: str, p: int) -> DataFrame:
    """(pid, n, begin, end): the half-open range of each partition in the layout."""
    return histogram(relation, key, p).withColumn("begin", _before("pid")).withColumn("end", F.col("begin") + F.col("n"))


def block_of(row_idx: Column, n_rows: int, chunks: int, even: bool = False) -> Column:
    """The chunk of a row: chunks of ceil(n / chunks) rows, or with `even` near-equal blocks of which the first n mod chunks are one longer."""
    if chunks < 1:
        raise ValueError("there must be a chunk at least")
    if not even:
        return F.floor(row_idx / F.lit(max(1, -(-n_rows // chunks)))).cast("int")
    short, longer = divmod(n_rows, chunks)
    border = longer * (short + 1)
    after = F.lit(longer) + F.floor((row_idx - border) / F.lit(max(1, short)))
    return F.when(row_idx < border, F.floor(row_idx / F.lit(short + 1))).otherwise(after).cast("int")


def chunk_matrix(relation: DataFrame, key: str, p: int, chunks: int, row_idx: str = "row_idx", even: bool = False) -> DataFrame:
    """(chunk, pid, n) for every chunk and partition, zeros included."""
    n_rows = relation.count()
    rows = with_partition(relation, key, p).withColumn("chunk", block_of(F.col(row_idx), n_rows, chunks, even))
    counts = rows.groupBy("chunk", "pid").agg(F.count("*").alias("n"))
    every = relation.sparkSession.range(chunks * p, numPartitions=1).select(F.floor(F.col("id") / p).cast("int").alias("chunk"), (F.col("id") % p).cast("int").alias("pid"))
    return every.join(counts, ["chunk", "pid"], "left").select("chunk", "pid", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def chunk_offsets(relation: DataFrame, key: str, p: int, chunks: int, row_idx: str = "row_idx", even: bool = False) -> DataFrame:
    """(chunk, pid, n, offset): where each chunk's rows of a partition begin in the layout."""
    return chunk_matrix(relation, key, p, chunks, row_idx, even).withColumn("offset", _before("pid", "chunk"))


def layout(relation: DataFrame, key: str, p: int, row_idx: str = "row_idx", chunk_rows: int = 1 << 20) -> DataFrame:
    """The relation with pid and position: rows by partition, in input order within each.

    A partition is ordered in chunks of rows, so that one that holds very many rows is spread: a chunk's base comes
    from the counts of (pid, chunk) and only rows of one chunk are ordered in one task.
    """
    rows = with_partition(relation, key, p).withColumn("_chunk", F.floor(F.col(row_idx) / chunk_rows))
    counts = rows.groupBy("pid", "_chunk").agg(F.count("*").alias("_n"))
    in_pid = Window.partitionBy("pid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy("pid").agg(F.sum("_n").alias("n"))
    base = sizes.select("pid", _before("pid").alias("_base"))
    counts = counts.join(F.broadcast(base), "pid").select("pid", "_chunk", (F.col("_base") + F.coalesce(F.sum("_n").over(in_pid), F.lit(0))).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("pid", "_chunk").orderBy(row_idx)) - 1
    return rows.withColumn("_nth", nth).join(counts, ["pid", "_chunk"]).withColumn("position", (F.col("_start") + F.col("_nth")).cast("bigint")).drop("_chunk", "_nth", "_start")


def partitioned(relation: DataFrame, key: str, p: int) -> DataFrame:
    """The relation with pid, physically one Spark partition for each pid."""
    return with_partition(relation, key, p).repartitionById(p, "pid")
