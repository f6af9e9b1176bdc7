"""Unsigned 64-bit arithmetic as native column expressions.

A BIGINT column holds the two's-complement bits of a value.  Sums and products wrap modulo 2^64, which needs
expressions that are analysed with ANSI mode off; `wrapping` does that for a block and puts the setting back.  The
mode is fixed in a plan when it is analysed, so the plan may run under any setting later.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1

# Fixed values of the splitmix64 generator.
GAMMA = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
# Fixed value: what separates the seed of the second relation from that of the first.
OTHER_SEED = 0xDEADEBDECDEEDEF1

_ANSI = "spark.sql.ansi.enabled"


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """ANSI mode off inside the block; frames made in it must be analysed in it."""
    before = spark.conf.get(_ANSI)
    spark.conf.set(_ANSI, "false")
    try:
        yield
    finally:
        spark.conf.set(_ANSI, before)


def signed(x: int) -> int:
    """The BIGINT with the bits of x mod 2^64."""
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def u64(x: int) -> Column:
    return F.lit(signed(x)).cast("bigint")


def mix(x: Column) -> Column:
    """The finaliser of splitmix64."""
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 30)) * u64(MIX_1)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 27)) * u64(MIX_2)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 31))


def splitmix64(x: Column) -> Column:
    """A stateless hash of x."""
    return mix(x + u64(GAMMA))


def draw(seed: int, n: Column) -> Column:
    """The n-th draw, from 1 on, of the generator that starts from `seed`."""
    return mix(u64(seed) + n * u64(GAMMA))


def remainder(x: Column, m: int) -> Column:
    """x mod m for unsigned x, 0 < m < 2^64."""
    if not 0 < m <= MASK:
        raise ValueError("the modulus must lie in 1 .. 2^64 - 1")
    if m >= 1 << 62:  # halves would overflow
        left = (x.cast("decimal(20,0)") + F.when(x < 0, F.lit(Decimal(1 << 64))).otherwise(F.lit(Decimal(0)))) % F.lit(Decimal(m))
        return (left - F.when(left >= F.lit(Decimal(1 << 63)), F.lit(Decimal(1 << 64))).otherwise(F.lit(Decimal(0)))).cast("bigint")
    m_ = F.lit(m).cast("bigint")
    return ((F.shiftrightunsigned(x, 1) % m_) * 2 + x.bitwiseAND(F.lit(1).cast("bigint"))) % m_


def to_double(x: Column) -> Column:
    """The double nearest to unsigned x."""
    half = F.shiftrightunsigned(x, 1).bitwiseOR(x.bitwiseAND(F.lit(1).cast("bigint")))
    return F.when(x >= 0, x.cast("double")).otherwise(half.cast("double") * 2.0)


def unit_double(x: Column) -> Column:
    """x / 2^64 as a double; 1.0 can occur."""
    return to_double(x) / F.lit(float(1 << 64))


def unsigned_string(x: Column) -> Column:
    """Decimal digits of unsigned x."""
    return F.conv(F.hex(x), 16, 10)


def is_power_of_two(x: int) -> bool:
    return x > 0 and x & (x - 1) == 0


def percentage(n: Column, total: Column) -> Column:
    """100 n / total, 0 where total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(n * 100.0 / total)


def ceil_div(x: int, y: int) -> int:
    return -(-x // y)


# The same on Python integers, for constants and tests.


def py_mix(x: int) -> int:
    x = (x ^ x >> 30) * MIX_1 & MASK
    x = (x ^ x >> 27) * MIX_2 & MASK
    return x ^ x >> 31


def py_splitmix64(x: int) -> int:
    return py_mix(x + GAMMA & MASK)
