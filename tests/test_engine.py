from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions.u64 import GAMMA, MASK, py_splitmix64
from keyloom.operators import digest, partition, stats
from keyloom.sources import generator
from keyloom.sources.generator import RelationSpec, generate, hot_partitions
from keyloom.sources.tables import write_load_csv

# n of both sides, seed, max_key, p, sigma, subset, crest -> join_count, checksum1, checksum2, first keys, digests of both relations
GOLDEN = {
    "tiny": (5, 8, 13, 8, 4, 0.0, 0, 1.0, 5, 3744040016078877703, 7512869560902154691, [1, 3, 4], 17206261429495992345, 16984647953464143407),
    "uniform": (500, 500, 42, 100, 16, 0.0, 4, 2.0, 2514, 8589325813355980921, 7430506178813100720, [91, 64, 62], 7582186838628650285, 14797763300737020276),
    "skewed": (500, 500, 42, 100, 16, 0.95, 4, 2.0, 389, 15716123421758828863, 3138709565836961128, [13, 13, 26], 13232889847034341514, 335799252411525951),
    "constant": (1000, 1000, 42, 0, 4, 0.95, 2, 2.0, 1000000, 14908910223497071040, 18392298694019802368, [0, 0, 0], 5733399573073458072, 5733399573073458072),
    "larger": (10000, 10000, 42, 5000, 256, 0.0, 10, 2.0, 19897, 14851145465319362054, 16959406989676618599, [2291, 764, 4062], 2596924126578571856, 3117702598142417083),
    "larger skewed": (10000, 10000, 42, 5000, 256, 0.95, 10, 2.0, 1687, 8320710605741558432, 10388659387417362944, [1227, 971, 1479], 2588440911090847918, 16180633283713579424),
    "few keys": (1000, 1000, 42, 10, 256, 0.95, 10, 2.0, 135932, 805759886086963363, 10112652669800562590, [3, 4, 6], 9206264597777159909, 6938005855278058284),
    "wide": (2000, 2000, 7, 1099511627776, 64, 0.9, 4, 2.0, 0, 0, 0, [12071891677, 1057647214505, 1010245880628], 9120926852678928877, 14973358281796971304),
    "all hot": (2000, 2000, 7, 5000, 64, 0.9, 64, 1.0, 807, 740474646210373799, 18310953344482555525, [3135, 2901, 3782], 17563930692187992418, 16086376790123789457),
    "empty side": (0, 8, 13, 8, 4, 0.0, 0, 1.0, 0, 0, 0, [], 0, 16984647953464143407),
    "no subset": (300, 300, 42, 100, 16, 0.5, 0, 2.0, 904, 16883564404248922956, 8705194497858483813, [91, 64, 62], 3072306863344603821, 18356615533178913361),
}


def pair(spark, case):
    nr, ns, seed, max_key, p, sigma, subset, crest = GOLDEN[case][:8]
    r = RelationSpec(nr, seed, max_key, p, sigma, subset, crest)
    return generate(spark, r), generate(spark, RelationSpec(ns, seed, max_key, p, sigma, subset, crest).other())


@pytest.mark.parametrize("case", GOLDEN)
def test_goldens(spark, case):
    count, c1, c2, first, dr, ds = GOLDEN[case][8:]
    r, s = pair(spark, case)
    row = digest.join_digest(r, s, "key", "key").first()
    assert (row.join_count & MASK, row.checksum1 & MASK, row.checksum2 & MASK) == (count, c1, c2)
    assert [x.key for x in r.orderBy("row_idx").limit(3).collect()] == first
    assert digest.relation_digest(r, "key").first().digest & MASK == dr
    assert digest.relation_digest(s, "key").first().digest & MASK == ds


def test_hot_partitions():
    def both(seed, p, subset):
        r = RelationSpec(1, seed, 100, p, 0.5, subset)
        return hot_partitions(r), hot_partitions(r.other())

    assert both(42, 16, 4) == ([13, 4, 10, 5], [8, 6, 9, 0])
    assert both(42, 256, 10) == ([203, 114, 20, 117, 192, 224, 199, 166, 223, 160], [242, 64, 163, 78, 145, 150, 3, 226, 58, 33])
    assert both(7, 64, 4) == ([31, 63, 40, 25], [58, 49, 26, 41])


@pytest.mark.parametrize("strategy", digest.STRATEGIES)
def test_strategies_agree_with_the_nested_loop(spark, strategy):
    for case in ("uniform", "skewed"):
        r, s = pair(spark, case)
        expected = digest.nested_loop_digest(r, s, "key", "key").first()
        assert digest.join_digest(r.repartition(3), s.orderBy(F.desc("key")), "key", "key", strategy, 16).first() == expected
        assert digest.join_digest(s, r, "key", "key", strategy, 64).first() == expected


@pytest.mark.parametrize("rows,blocks,joined", [(1 << 17, 1 << 13, "BroadcastNestedLoopJoin"), (100, 300, "CartesianProduct")])
def test_all_pairs_of_sides_of_any_size(spark, monkeypatch, rows, blocks, joined):
    monkeypatch.setattr(digest, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(digest, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(digest, "TASK_PAIRS", 100_000)
    r, s = pair(spark, "few keys")
    nulls = spark.createDataFrame([(None, None)] * 3, "row_idx long, key long")
    for a, b in ((r, s), (s, r), (r, s.limit(700).unionAll(nulls)), (s.limit(501).unionAll(nulls), r)):
        got = digest.all_pairs_digest(a, b, "key", "key")
        assert joined in got._jdf.queryExecution().executedPlan().toString()
        assert got.first() == digest.join_digest(a, b, "key", "key").first()
    count, c1, c2 = GOLDEN["few keys"][8:11]
    row = digest.all_pairs_digest(r, s, "key", "key").first()
    assert (row.join_count & MASK, row.checksum1 & MASK, row.checksum2 & MASK) == (count, c1, c2)
    assert tuple(digest.all_pairs_digest(r.where("false"), s, "key", "key").first()) == (0, 0, 0)


def test_partition_digests_add_up(spark):
    r, s = pair(spark, "larger")
    whole = digest.join_digest(r, s, "key", "key").first()
    for p in (1, 16, 256):
        parts = digest.join_digest_by_partition(r, s, "key", "key", p)
        assert digest.merge_digests(parts).first() == whole
        assert all(0 <= x.pid < p for x in parts.collect())


def test_null_and_negative_keys(spark):
    r = spark.createDataFrame([(None,), (-1,), (-1,), (3,)], "k long")
    s = spark.createDataFrame([(None,), (-1,), (4,)], "k long")
    row = digest.join_digest(r, s, "k", "k").first()
    assert row.join_count == 2
    assert row.checksum1 & MASK == 2 * py_splitmix64(MASK) & MASK
    assert row.checksum2 & MASK == 2 * py_splitmix64(MASK ^ GAMMA) & MASK
    assert digest.shown(digest.join_digest(r, s, "k", "k")).first().checksum1 == str(2 * py_splitmix64(MASK) & MASK)
    empty = digest.join_digest(r.where("false"), s, "k", "k").first()
    assert (empty.join_count, empty.checksum1, empty.checksum2) == (0, 0, 0)


def test_limits(spark):
    with pytest.raises(ValueError):
        partition.check_partitions(3)
    with pytest.raises(ValueError):
        partition.check_partitions(1 << 17)
    with pytest.raises(ValueError):
        digest.nested_loop_digest(spark.range(501), spark.range(1), "id", "id")
    with pytest.raises(ValueError):
        digest.join_digest(spark.range(1), spark.range(1), "id", "id", "sideways")
    with pytest.raises(ValueError):
        partition.block_of(F.lit(1), 1, 0)


def test_plan_shuffles_counts_only(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = digest.join_digest(spark.range(1000), spark.range(1000), "id", "id", "merge")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # one for each side; the join reuses them
    assert plan.count("partial_count") == 2


TINY = [1, 3, 4, 4, 7]


def tiny(spark):
    return spark.createDataFrame(list(enumerate(TINY)), "row_idx long, key long")


def test_tiny_partitions(spark):
    got = partition.offsets(tiny(spark), "key", 4).orderBy("pid").collect()
    assert [(x.n, x.begin, x.end) for x in got] == [(2, 0, 2), (1, 2, 3), (0, 3, 3), (2, 3, 5)]
    for chunk_rows in (1, 2, 100):
        laid = partition.layout(tiny(spark), "key", 4, chunk_rows=chunk_rows).orderBy("position").collect()
        assert [x.key for x in laid] == [4, 4, 1, 3, 7]
        assert [x.position for x in laid] == [0, 1, 2, 3, 4]


def test_prefix_sum_example(spark):
    rows = spark.createDataFrame([(1,)] + [(2,)] * 2 + [(3,)] * 5, "key long")
    assert [x.begin for x in partition.offsets(rows, "key", 4).orderBy("pid").collect()] == [0, 0, 1, 3]


def test_physical_partitions(spark):
    rows = partition.partitioned(generate(spark, RelationSpec(5000, 1, 777, 16)), "key", 16)
    assert rows.where(F.spark_partition_id() != F.col("pid")).count() == 0
    assert rows.rdd.getNumPartitions() == 16


@pytest.mark.parametrize("even", [False, True])
@pytest.mark.parametrize("chunks", [1, 3, 8])
def test_chunk_matrices(spark, even, chunks):
    n, p = 1001, 8
    rows = generate(spark, RelationSpec(n, 3, 500, p))
    keys = [x.key for x in rows.orderBy("row_idx").collect()]
    if even:
        sizes = [n // chunks + (i < n % chunks) for i in range(chunks)]
    else:
        step = -(-n // chunks)
        sizes = [max(0, min(step, n - i * step)) for i in range(chunks)]
    borders = np.cumsum([0, *sizes])
    expected = {}
    for c in range(chunks):
        count = Counter((k ^ k >> 32) & p - 1 for k in keys[borders[c] : borders[c + 1]])
        expected |= {(c, pid): count[pid] for pid in range(p)}
    got = partition.chunk_offsets(rows, "key", p, chunks, even=even).collect()
    assert {(x.chunk, x["pid"]): x.n for x in got} == expected
    at = 0
    for x in sorted(got, key=lambda x: (x["pid"], x.chunk)):
        assert x.offset == at
        at += x.n
    assert at == n


def sequential(spec: RelationSpec) -> list[int]:
    """The relation by walking the stream record by record."""
    hot, at, out = hot_partitions(spec), 0, []

    def nxt():
        nonlocal at
        at += 1
        return py_splitmix64(spec.seed + (at - 1) * GAMMA & MASK)

    for _ in range(spec.n):
        if not (nxt() / float(1 << 64) < spec.sigma and hot):
            out.append(nxt() % spec.max_key)
            continue
        target = hot[min(int((nxt() / float(1 << 64)) ** spec.crest * len(hot)), len(hot) - 1)]
        if spec.max_key < spec.p:
            out.append(target % spec.max_key)
        elif spec.max_key < 1 << 32:
            out.append(nxt() % (spec.max_key // spec.p) * spec.p + target)
        else:
            high = nxt() % (spec.max_key >> 32)
            out.append(high << 32 | nxt() % ((1 << 32) // spec.p) * spec.p + (target ^ high % spec.p))
    return out


@pytest.mark.parametrize("max_key,p", [(5000, 64), (40, 64), (1 << 40, 64)])
@pytest.mark.parametrize("sigma", [0.3, 1.0])
def test_skewed_generation_equals_the_walk(spark, max_key, p, sigma):
    spec = RelationSpec(2500, 11, max_key, p, sigma, 5, 1.5)
    rows = generator._generate_skewed(spark, spec, chunk=512).orderBy("row_idx").collect()
    assert [x.row_idx for x in rows] == list(range(2500))
    keys = [x.key for x in rows]
    assert keys == sequential(spec)
    assert all(0 <= k < max_key for k in keys)
    if sigma == 1.0 and max_key >= p:
        assert {(k ^ k >> 32) & p - 1 for k in keys} <= set(hot_partitions(spec))


def test_sample_stats(spark):
    def of(values):
        return tuple(spark.createDataFrame([(v,) for v in values], "x double").agg(*stats.sample_stats(F.col("x"))).first())

    assert of([]) == (0.0, 0.0, 0.0)
    assert of([1.0, 2.0, 4.0, 9.0])[:2] == (4.0, 3.0)
    assert of([1.0, 3.0]) == (2.0, 2.0, 1.0)


def test_load_report_and_csv(spark, tmp_path):
    load = stats.partition_load(tiny(spark), "key", 4)
    assert [(x.id, x.records, x.percent) for x in load.orderBy("id").collect()] == [(0, 2, 40.0), (1, 1, 20.0), (2, 0, 0.0), (3, 2, 40.0)]
    assert stats.partition_load(tiny(spark).where("false"), "key", 2).agg(F.sum("percent")).first()[0] == 0.0
    path = write_load_csv(load, str(tmp_path), sigma=0.5)
    assert path.endswith("skew_data.csv")
    parts = [p for p in (tmp_path / "skew_data.csv").iterdir() if p.suffix == ".csv"]
    assert len(parts) == 1 and parts[0].read_text().split() == ["id,records", "0,2", "1,1", "2,0", "3,2"]


def test_key_frequency_and_critical_path(spark):
    assert {(x.key, x.n) for x in stats.key_frequency(tiny(spark), "key").collect()} == {(1, 1), (3, 1), (4, 2), (7, 1)}
    times = spark.createDataFrame([(0, "build", 1.0), (0, "build", 2.0), (1, "build", 2.5), (1, "probe", 4.0)], "worker int, phase string, seconds double")
    assert {(x.phase, x.seconds) for x in stats.critical_path(times).collect()} == {("build", 3.0), ("probe", 4.0)}
