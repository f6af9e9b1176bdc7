"""Deterministic relations of 64-bit keys, uniform or skewed towards some partitions.

A relation's records draw from one splitmix64 stream.  A record's first draw decides whether it is skewed; a
plain record takes its key from the second.  A skewed record uses 2 to 4 draws (see `_skewed_key`), so where a record's
draws begin depends on all records before it.  Draw number j of a stream is a closed formula, though, and the place
after a record depends only on the draw at its beginning.  So the axis of draws is cut in chunks, and spans of chunks; for each
span and each way to enter it, its exit and number of records are found in parallel, the driver composes these tables
of four rows a span, and a second parallel pass makes the records.

Uniform relations have two draws a record and are a plain projection of spark.range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.u64 import GAMMA, MASK, MIX_1, MIX_2, OTHER_SEED, ceil_div, draw, remainder, wrapping
from keyloom.operators.partition import check_partitions
from keyloom.shipping import ship
from keyloom.sources.shuffle import Twister64, shuffled

# Fixed value: what separates the seed of the choice of hot partitions from the relation's.
HOT_SEED = 0xDEADBEEF
_WORD = 1 << 32
#: Draws of a chunk, and the most chunks of a span, which is a task's work.
CHUNK = 1 << 20
SPAN = 256


@dataclass(frozen=True)
class RelationSpec:
    """n records with keys under max_key (0: all keys are 0); a share sigma of them goes to subset_size hot partitions of p, by a power law of shape crest."""

    n: int
    seed: int
    max_key: int
    p: int
    sigma: float = 0.0
    subset_size: int = 0
    crest: float = 1.0

    def __post_init__(self):
        check_partitions(self.p)
        if not 0 <= self.n or not 0 <= self.max_key <= MASK:
            raise ValueError("n must not be negative and max_key must lie in 0 .. 2^64 - 1")

    def other(self) -> "RelationSpec":
        """The second relation of a pair."""
        return replace(self, seed=(self.seed ^ OTHER_SEED) & MASK)

    @property
    def skewed(self) -> bool:
        return self.subset_size > 0 and self.sigma > 0 and self.max_key > 0


def hot_partitions(spec: RelationSpec) -> list[int]:
    """The hot partitions, the hottest first."""
    if not spec.skewed:
        return []
    ids = shuffled(list(range(spec.p)), Twister64(spec.seed + HOT_SEED & MASK))
    return ids[: min(spec.subset_size, spec.p)]


def generate(spark: SparkSession, spec: RelationSpec) -> DataFrame:
    """(row_idx, key) of the relation."""
    if not spec.skewed:
        rows = spark.range(spec.n).select(F.col("id").alias("row_idx"))
        if not spec.max_key:
            return rows.select("row_idx", F.lit(0).cast("bigint").alias("key"))
        with wrapping(spark):
            second = draw(spec.seed, F.col("row_idx") * 2 + 2)
            return rows.select("row_idx", remainder(second, spec.max_key).alias("key"))
    return _generate_skewed(spark, spec)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def draws(seed: int, first: int, n: int) -> np.ndarray:
    """Draws number first, first + 1, ... of a stream; the first of all is number 1."""
    with np.errstate(over="ignore"):
        return _mix(np.uint64(seed & MASK) + np.arange(first, first + n, dtype=np.uint64) * np.uint64(GAMMA))


def _unit(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) / float(1 << 64)


def draws_of_skewed(spec: RelationSpec) -> int:
    if spec.max_key >= _WORD:
        return 4
    return 2 if spec.max_key < spec.p else 3


def _walk(long: np.ndarray, entry: int, step: int) -> tuple[np.ndarray, int]:
    """Places in a chunk where records begin if the first begins at `entry`, and how far past the chunk the next one does.

    long[j] tells whether a record that begins at draw j uses `step` draws, not 2.
    """
    n = len(long)
    width = np.where(long, step, 2)
    after = np.minimum(np.arange(n) + width, n + 4)
    # pointer doubling marks all places that the walk from `entry` visits
    visited = np.zeros(n, dtype=bool)
    if entry >= n:
        return np.zeros(0, dtype=np.int64), entry - n
    visited[entry] = True
    at = np.array([entry])
    jump = np.append(np.minimum(after, n), n)
    while True:
        at = jump[np.flatnonzero(visited)]
        at = at[at < n]
        before = int(visited.sum())
        visited[at] = True
        if int(visited.sum()) == before:
            break
        jump = jump[jump]
    places = np.flatnonzero(visited)
    last = int(places[-1])
    return places, last + int(width[last]) - n


def _span_tables(spec: RelationSpec, chunk: int, size: int, n_chunks: int):
    step = draws_of_skewed(spec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for span in pdf["id"].tolist():
                at, records = list(range(4)), [0] * 4
                for c in range(span * size, min((span + 1) * size, n_chunks)):
                    long = _unit(draws(spec.seed, c * chunk + 1, chunk)) < spec.sigma
                    # walks from different entries soon meet, and then are one
                    found = {entry: (len(places), leave) for entry in set(at) for places, leave in [_walk(long, entry, step)]}
                    records = [n + found[x][0] for n, x in zip(records, at, strict=True)]
                    at = [found[x][1] for x in at]
                yield pd.DataFrame({"span": span, "entry": range(4), "records": records, "leave": at})

    return run


def _records(spec: RelationSpec, chunk: int, size: int, n_chunks: int, hot: list[int]):
    step, hot_ = draws_of_skewed(spec), np.array(hot, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for span, entry, first in zip(pdf["span"].tolist(), pdf["entry"].tolist(), pdf["first"].tolist(), strict=True):
                for c in range(span * size, min((span + 1) * size, n_chunks)):
                    if first >= spec.n:
                        break
                    d = draws(spec.seed, c * chunk + 1, chunk + 4)
                    u = _unit(d)
                    places, entry = _walk(u[:chunk] < spec.sigma, entry, step)
                    places = places[: spec.n - first]
                    skewed = u[places] < spec.sigma
                    key = (d[places + 1] % np.uint64(spec.max_key)).astype(np.int64)
                    at = places[skewed]
                    key[skewed] = _skewed_key(spec, d, u, at, hot_)
                    yield pd.DataFrame({"row_idx": np.arange(first, first + len(places)), "key": key})
                    first += len(places)

    return run


def _skewed_key(spec: RelationSpec, d: np.ndarray, u: np.ndarray, at: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Keys that lie in a hot partition, for records that begin at `at`."""
    which = np.minimum((u[at + 1] ** spec.crest * len(hot)).astype(np.int64), len(hot) - 1)
    target = hot[which]
    if spec.max_key < spec.p:
        return target % spec.max_key
    if spec.max_key < _WORD:
        return (d[at + 2] % np.uint64(spec.max_key // spec.p)).astype(np.int64) * spec.p + target
    high = (d[at + 2] % np.uint64(spec.max_key >> 32)).astype(np.int64)
    low = (d[at + 3] % np.uint64(_WORD // spec.p)).astype(np.int64) * spec.p
    # the partition map folds the high word in; its share is taken out beforehand
    return high << 32 | low + (target ^ high % spec.p)


def _generate_skewed(spark: SparkSession, spec: RelationSpec, chunk: int = CHUNK) -> DataFrame:
    ship(spark)
    hot = hot_partitions(spec)
    n_chunks = ceil_div(spec.n * max(2, draws_of_skewed(spec)), chunk)
    size = max(1, min(SPAN, ceil_div(n_chunks, 4 * spark.sparkContext.defaultParallelism)))
    n_spans = ceil_div(n_chunks, size)
    tables = spark.range(n_spans, numPartitions=max(1, n_spans))
    found = tables.mapInPandas(_span_tables(spec, chunk, size, n_chunks), "span long, entry int, records long, leave int").toPandas()  # four rows for each span
    by = {(c, e): (n, x) for c, e, n, x in found.itertuples(index=False)}
    plan, entry, first = [], 0, 0
    for span in range(n_spans):
        if first >= spec.n:
            break
        records, leave = by[span, entry]
        plan.append((span, entry, first))
        entry, first = leave, first + records
    if not plan:
        return spark.createDataFrame([], "row_idx long, key long")
    starts = spark.createDataFrame(plan, "span int, entry int, first long").repartitionById(len(plan), "span")
    return starts.mapInPandas(_records(spec, chunk, size, n_chunks, hot), "row_idx long, key long")
