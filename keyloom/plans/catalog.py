"""Registered queries of the join-digest engine and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.u64 import splitmix64, u64, unsigned_string, wrapping
from keyloom.operators import digest, partition, stats
from keyloom.plans import oracle
from keyloom.sources.generator import RelationSpec, generate
from keyloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Makes keys that use the high word, for the partition map.
WIDE = 4294967311
UNIFORM = RelationSpec(n=10_000, seed=42, max_key=5_000, p=256)
CONSTANT = RelationSpec(n=1_000, seed=42, max_key=0, p=4)
SKEWED = RelationSpec(n=10_000, seed=42, max_key=5_000, p=256, sigma=0.95, subset_size=10, crest=2.0)
SKEWED_WIDE = RelationSpec(n=10_000, seed=7, max_key=1 << 40, p=64, sigma=0.9, subset_size=4, crest=2.0)
SKEWED_SMALL = RelationSpec(n=1_000, seed=42, max_key=10, p=256, sigma=0.95, subset_size=10, crest=2.0)


def _digest_of(r: str, r_key: str, s: str, s_key: str, **how) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return digest.shown(digest.join_digest(table(spark, sf_dir, r).select(r_key), table(spark, sf_dir, s).select(s_key), r_key, s_key, **how))

    return run


def join_digest_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return digest.shown(digest.join_digest_by_partition(r, s, "l_orderkey", "o_orderkey", 16))


def join_digest_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return digest.shown(digest.merge_digests(digest.join_digest_by_partition(r, s, "l_orderkey", "o_orderkey", 64)))


def join_digest_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return digest.shown(digest.join_digest(orders.where("o_orderkey < 100"), orders.where("o_orderkey >= 100"), "o_orderkey", "o_orderkey"))


def _brute(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "supplier").select("s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey")


def join_verify_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = _brute(spark, sf_dir)
    return digest.shown(digest.all_pairs_digest(r, s, "s_nationkey", "n_nationkey"))


def join_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = _brute(spark, sf_dir)
    a = digest.join_digest(r, s, "s_nationkey", "n_nationkey")
    b = digest.all_pairs_digest(r, s, "s_nationkey", "n_nationkey")
    same = a.exceptAll(b).unionAll(b.exceptAll(a))
    return same.agg((F.count("*") == 0).alias("equal"))


def splitmix64_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    with wrapping(spark):
        return orders.select("o_orderkey", unsigned_string(splitmix64(F.col("o_orderkey"))).alias("hash"), unsigned_string(splitmix64(F.col("o_orderkey").bitwiseXOR(u64(0x9E3779B97F4A7C15)))).alias("hash2"))


def partition_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    wide = F.col("o_orderkey") * F.lit(WIDE).cast("bigint")
    return orders.select("o_orderkey", partition.partition_id(F.col("o_orderkey"), 16).alias("pid"), partition.partition_id(wide, 1024).alias("pid_wide"))


def partition_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.histogram(table(spark, sf_dir, "lineitem"), "l_partkey", 64)


def partition_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.offsets(table(spark, sf_dir, "lineitem"), "l_partkey", 64).withColumnsRenamed({"begin": "begin_at", "end": "end_at"})


def _numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # o_orderkey is dense from 0, so the key is its own rank; no global sort is needed
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("row_idx"))


def chunk_histogram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.chunk_matrix(_numbered_orders(spark, sf_dir), "o_custkey", 16, 8)


def chunk_histogram_matrix_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.chunk_matrix(_numbered_orders(spark, sf_dir), "o_custkey", 16, 7, even=True)


def chunk_offsets_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.chunk_offsets(_numbered_orders(spark, sf_dir), "o_custkey", 16, 8).withColumnRenamed("offset", "offset_at")


def partition_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.layout(_numbered_orders(spark, sf_dir), "o_custkey", 16, chunk_rows=4096)


def partition_load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.partition_load(table(spark, sf_dir, "events"), "user_id", 64)


def key_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.key_frequency(table(spark, sf_dir, "lineitem"), "l_suppkey")


def _generated(spec: RelationSpec) -> Query:
    return lambda spark, sf_dir: generate(spark, spec)


def _generated_digest(spec: RelationSpec) -> Query:
    return lambda spark, sf_dir: digest.shown(digest.join_digest(generate(spark, spec), generate(spark, spec.other()), "key", "key"))


def generated_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.partition_load(generate(spark, SKEWED), "key", SKEWED.p)


def sample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*stats.sample_stats(F.col("l_quantity")))
    return rows.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


def critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("worker"), F.col("l_returnflag").alias("phase"), F.col("l_quantity").alias("seconds"))
    return stats.critical_path(times)


def relation_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.relation_digest(table(spark, sf_dir, "lineitem"), "l_orderkey").select("n", unsigned_string(F.col("digest")).alias("digest"))


def queries() -> dict[str, Query]:
    return {
        "join_digest": _digest_of("lineitem", "l_orderkey", "orders", "o_orderkey"),
        "join_digest_fk_part": _digest_of("lineitem", "l_partkey", "part", "p_partkey"),
        "join_digest_many_to_many": _digest_of("lineitem", "l_suppkey", "customer", "c_nationkey"),
        "join_digest_events": _digest_of("events", "user_id", "customer", "c_custkey", strategy="pid", p=64),
        "join_digest_broadcast": _digest_of("lineitem", "l_partkey", "part", "p_partkey", strategy="broadcast"),
        "join_digest_merge": _digest_of("lineitem", "l_orderkey", "orders", "o_orderkey", strategy="merge"),
        "join_digest_hash": _digest_of("lineitem", "l_orderkey", "orders", "o_orderkey", strategy="hash"),
        "join_digest_by_partition": join_digest_by_partition,
        "join_digest_merged": join_digest_merged,
        "join_digest_empty": join_digest_empty,
        "join_verify_bruteforce": join_verify_bruteforce,
        "join_self_check": join_self_check,
        "relation_digest": relation_digest,
        "splitmix64_keys": splitmix64_keys,
        "partition_id": partition_id,
        "partition_histogram": partition_histogram,
        "partition_offsets": partition_offsets,
        "chunk_histogram_matrix": chunk_histogram_matrix,
        "chunk_histogram_matrix_even": chunk_histogram_matrix_even,
        "chunk_offsets_matrix": chunk_offsets_matrix,
        "partition_layout": partition_layout,
        "partition_load_report": partition_load_report,
        "key_frequency": key_frequency,
        "generate_uniform": _generated(UNIFORM),
        "generate_constant": _generated(CONSTANT),
        "generate_skewed": _generated(SKEWED),
        "generate_skewed_wide": _generated(SKEWED_WIDE),
        "generate_skewed_small": _generated(SKEWED_SMALL),
        "generated_load": generated_load,
        "synthetic_join_digest_uniform": _generated_digest(UNIFORM),
        "synthetic_join_digest_skewed": _generated_digest(SKEWED),
        "sample_stats": sample_stats,
        "critical_path": critical_path,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.statements(UNIFORM, CONSTANT, SKEWED, SKEWED_WIDE, SKEWED_SMALL)
