from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions.u64 import GAMMA, MASK, is_power_of_two, percentage, py_splitmix64, remainder, signed, splitmix64, to_double, u64, unit_double, unsigned_string, wrapping
from keyloom.sources.shuffle import Twister64, shuffled

EDGES = [0, 1, 42, 1 << 63, GAMMA, MASK, (1 << 63) - 1, 12345678901234567890]


def frame(spark, values):
    return spark.createDataFrame([(signed(v),) for v in values], "x long")


def test_splitmix64_of_known_values(spark):
    # values of keys 0, 1, 42, 2^63, gamma, 2^64 - 1 and of those keys xor gamma
    keys = [0, 1, 42, 1 << 63, GAMMA, MASK]
    first = [16294208416658607535, 10451216379200822465, 13679457532755275413, 5196802822362493915, 7960286522194355700, 16490336266968443936]
    second = [7960286522194355700, 16834447057089888969, 2949826092126892291, 14154714916085338130, 16294208416658607535, 13029008266876403067]
    with wrapping(spark):
        rows = frame(spark, keys).select(unsigned_string(splitmix64(F.col("x"))).alias("a"), unsigned_string(splitmix64(F.col("x").bitwiseXOR(u64(GAMMA)))).alias("b"))
    got = rows.collect()  # runs with the session's own setting
    assert [int(r.a) for r in got] == first
    assert [int(r.b) for r in got] == second
    assert [py_splitmix64(k) for k in keys] == first


def test_wrapping_restores_the_setting(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    with pytest.raises(RuntimeError), wrapping(spark):
        assert spark.conf.get("spark.sql.ansi.enabled") == "false"
        raise RuntimeError
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_remainder_and_doubles(spark):
    for m in (1, 7, 5000, (1 << 40) + 1, (1 << 62) - 1):
        got = [r.y for r in frame(spark, EDGES).select(remainder(F.col("x"), m).alias("y")).collect()]
        assert got == [v % m for v in EDGES]
    got = [r.y for r in frame(spark, EDGES).select(to_double(F.col("x")).alias("y")).collect()]
    assert got == [float(v) for v in EDGES]
    got = [r.y for r in frame(spark, [0, 1 << 63, MASK]).select(unit_double(F.col("x")).alias("y")).collect()]
    assert got == [0.0, 0.5, 1.0]
    with pytest.raises(ValueError):
        remainder(F.lit(1), 1 << 64)


def test_small_functions(spark):
    assert [x for x in range(20) if is_power_of_two(x)] == [1, 2, 4, 8, 16]
    row = spark.range(1).select(percentage(F.lit(1), F.lit(0)).alias("a"), percentage(F.lit(1), F.lit(8)).alias("b")).first()
    assert (row.a, row.b) == (0.0, 12.5)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, MASK))
def test_signed_round_trip(x):
    assert signed(x) & MASK == x
    assert -(1 << 63) <= signed(x) < 1 << 63


def test_twister_and_shuffle():
    t = Twister64(5489)
    for _ in range(9999):
        t()
    assert t() == 9981545732273789042  # the 10000th value that the C++ standard states
    assert shuffled([], Twister64(1)) == [] and shuffled([7], Twister64(1)) == [7]
    for n in range(2, 40):
        assert sorted(shuffled(list(range(n)), Twister64(n))) == list(range(n))


def test_remainder_of_large_moduli(spark):
    values = [0, 1, (1 << 62) - 1, 1 << 62, (1 << 63) - 1, 1 << 63, (1 << 63) + 5, MASK - 1, MASK]
    df = spark.createDataFrame([(signed(v),) for v in values], "x bigint")
    for m in ((1 << 62) - 1, 1 << 62, (1 << 63) + 5, MASK):
        with wrapping(spark):
            got = [r[0] for r in df.select(remainder(F.col("x"), m)).collect()]
        assert got == [signed(v % m) for v in values]
