"""The size and two checksums of an inner equi-join, without its pairs.

For keys k with m_r rows on one side and m_s on the other: join_count is the sum of m_r m_s, checksum1 that of
splitmix64(k) m_r m_s, checksum2 that of splitmix64(k xor gamma) m_r m_s, all modulo 2^64.

Both sides are counted by key first, partly before the shuffle, so a hot key costs one row a task and the join
sees each key once: its output is bounded by distinct keys.  Null keys match nothing.  A count is a BIGINT.
Strategies:
  key          exchange by key (default); keys of one partition spread over all tasks
  pid          counted keys by partition id, the literal radix layout, for load studies
  broadcast    the smaller counted side goes to all executors, if its rows are at most BROADCAST_KEYS
  merge, hash  exchange by key with a sort-merge or a shuffled hash join
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.u64 import GAMMA, ceil_div, splitmix64, u64, unsigned_string, wrapping
from keyloom.operators.partition import check_partitions, partition_id

STRATEGIES = ("key", "pid", "broadcast", "merge", "hash")
#: Distinct keys (16 bytes each) of a side that may be broadcast.
BROADCAST_KEYS = 1 << 20
#: Rows of the smaller side that all_pairs_digest broadcasts; a larger one is paired in blocks of so many rows.
BROADCAST_ROWS, BLOCK_ROWS = 1 << 17, 1 << 13
#: Pairs that a task compares with a broadcast side, about a second.
TASK_PAIRS = 1 << 28
_DIGEST = ("join_count", "checksum1", "checksum2")


def multiplicities(relation: DataFrame, key: str, name: str = "n") -> DataFrame:
    """(key, n): how often each key occurs."""
    return relation.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("key")).agg(F.count("*").alias(name))


def _sums(weight: Column, key: Column) -> list[Column]:
    terms = (weight, splitmix64(key) * weight, splitmix64(key.bitwiseXOR(u64(GAMMA))) * weight)
    return [F.coalesce(F.sum(t), F.lit(0).cast("bigint")).alias(n) for t, n in zip(terms, _DIGEST, strict=True)]


def matched(r: DataFrame, s: DataFrame, r_key: str, s_key: str, strategy: str = "key", p: int = 256) -> DataFrame:
    """(key, m): each common key and its number of pairs.  Call inside wrapping()."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    if strategy == "pid":
        check_partitions(p)
        a, b = (multiplicities(x, k, n).withColumn("pid", partition_id(F.col("key"), p)).repartitionById(p, "pid") for x, k, n in ((r, r_key, "m_r"), (s, s_key, "m_s")))
        return a.join(b, ["pid", "key"]).select("key", (F.col("m_r") * F.col("m_s")).alias("m"))
    a, b = multiplicities(r, r_key, "m_r"), multiplicities(s, s_key, "m_s")
    if strategy == "broadcast":
        if b.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
            b = F.broadcast(b)
    elif strategy != "key":
        b = b.hint({"merge": "merge", "hash": "shuffle_hash"}[strategy])
    return a.join(b, "key").select("key", (F.col("m_r") * F.col("m_s")).alias("m"))


def join_digest(r: DataFrame, s: DataFrame, r_key: str, s_key: str, strategy: str = "key", p: int = 256) -> DataFrame:
    """One row (join_count, checksum1, checksum2), BIGINT."""
    with wrapping(r.sparkSession):
        return matched(r, s, r_key, s_key, strategy, p).agg(*_sums(F.col("m"), F.col("key")))


def join_digest_by_partition(r: DataFrame, s: DataFrame, r_key: str, s_key: str, p: int) -> DataFrame:
    """(pid, join_count, checksum1, checksum2) of every partition with pairs."""
    with wrapping(r.sparkSession):
        pairs = matched(r, s, r_key, s_key)
        return pairs.groupBy(partition_id(F.col("key"), p).alias("pid")).agg(*_sums(F.col("m"), F.col("key")))


def all_pairs_digest(r: DataFrame, s: DataFrame, r_key: str, s_key: str) -> DataFrame:
    """The digest by comparing all pairs of rows, of sides of any size: its time is the product of their rows."""
    with wrapping(r.sparkSession):
        sides = [x.where(F.col(k).isNotNull()).select(F.col(k).cast("bigint").alias("key")) for x, k in ((r, r_key), (s, s_key))]
        # equal keys count the same from either side, so the larger one may be on the left
        (few, b), (many, a) = sorted(((x.count(), x) for x in sides), key=lambda side: side[0])
        b = b.withColumnRenamed("key", "other")
        if few <= BROADCAST_ROWS:
            tasks = ceil_div(few * many, TASK_PAIRS)
            a, b = a.repartition(tasks) if tasks > 1 else a, F.broadcast(b)
        else:
            a, b = a.repartition(ceil_div(many, BLOCK_ROWS)).hint("shuffle_replicate_nl"), b.repartition(ceil_div(few, BLOCK_ROWS))
        # an equality would be planned as a hash join
        pairs = a.join(b, F.col("key").bitwiseXOR(F.col("other")) == 0)
        return pairs.agg(*_sums(F.lit(1).cast("bigint"), F.col("key")))


def nested_loop_digest(r: DataFrame, s: DataFrame, r_key: str, s_key: str, most: int = 500) -> DataFrame:
    """all_pairs_digest for sides of at most `most` rows, as a quick check of the others; refuses larger ones."""
    for side in (r, s):
        if side.limit(most + 1).count() > most:
            raise ValueError(f"the nested loop is for sides of at most {most} rows")
    return all_pairs_digest(r, s, r_key, s_key)


def relation_digest(r: DataFrame, key: str) -> DataFrame:
    """One row (n, digest): rows and the sum of splitmix64(key) modulo 2^64."""
    with wrapping(r.sparkSession):
        return r.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum(splitmix64(F.col(key).cast("bigint"))), F.lit(0).cast("bigint")).alias("digest"))


def merge_digests(parts: DataFrame) -> DataFrame:
    """The sum of digests (of partitions, of shards) modulo 2^64."""
    with wrapping(parts.sparkSession):
        return parts.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in _DIGEST])


def shown(digest: DataFrame) -> DataFrame:
    """A digest with its values as unsigned decimal strings."""
    return digest.select(*[unsigned_string(F.col(c)).alias(c) if c in _DIGEST else F.col(c) for c in digest.columns])
