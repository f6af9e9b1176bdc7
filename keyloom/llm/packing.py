"""Best-fit packing by bin completion over the histogram of piece lengths.

Pieces of one length are alike, so the packing is found for the counts of lengths, at most `capacity` numbers
whatever the corpus: take the longest piece left, enumerate undominated fillings of the space beside it (fewest
and longest pieces first, a filling that another one covers piece by piece is dropped), and apply the chosen
pattern as often as the counts allow.  Best-fit decreasing gives the first incumbent; the search prunes a branch
whose waste already reaches what the incumbent allows, and stops at the lower bound.  The patterns then become
segments (length, ranks) -> (sequence, offset), and each piece finds its place by its rank among the pieces of
its length.

By itself the search has bounds, for it may take any time: NODES nodes, at each FILLINGS fillings, each used as often as
the counts allow.  pack_counts(exact=True) has none.

Only documents longer than the capacity are cut; their first piece is the short one.

Cases: a null or empty text is the end id alone; equal rows are separate documents; pieces of one length take their
places in the order of doc_id, piece and start; a very long text is encoded whole, in one task; columns besides, of any
name, are not read; an empty table packs to nothing.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import lean, materialize, partitions, ship, table
from keyloom.llm.tokens import LOT, default_path, encoder, in_lots

CAPACITY = 2048
END_ID = 0
#: Fillings kept at a node and nodes looked at before the incumbent stands.
FILLINGS = 12
STEPS = 400
NODES = 20_000


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: the longest piece opens a bin, then always the longest piece that still fits."""
    left, out = dict(counts), []
    while left:
        pattern, room = [], capacity
        use: dict[int, int] = {}
        for n in sorted(left, reverse=True):
            k = min(room // n, left[n])
            if k:
                pattern += [n] * k
                use[n] = k
                room -= n * k
        times = min(left[n] // k for n, k in use.items())
        out.append((tuple(pattern), times))
        _take(left, use, times)
    return out


def _take(left: dict[int, int], use: dict[int, int], times: int) -> None:
    for n, k in use.items():
        left[n] -= k * times
        if not left[n]:
            del left[n]


def _give(left: dict[int, int], use: dict[int, int], times: int) -> None:
    for n, k in use.items():
        left[n] = left.get(n, 0) + k * times


def fillings(lengths: list[int], left: dict[int, int], room: int, most: int | None = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings of `room` by the pieces left (lengths descending), the least waste first, then the fewest pieces.

    At most `most` of them, of those that STEPS steps find; all with None.
    """
    if room in left:
        return [(room,)]
    found: list[tuple[int, ...]] = []
    small = lengths[-1] if lengths else room + 1
    steps = 0

    def extend(at: int, rest: int, chosen: tuple[int, ...]) -> bool:
        nonlocal steps
        steps += 1
        if rest < small or (most and steps > STEPS):
            found.append(chosen)
            return bool(most) and (rest == 0 or steps > STEPS)
        if rest in left and left[rest] > chosen.count(rest) and (not chosen or rest <= chosen[-1]):
            found.append((*chosen, rest))
            return bool(most)
        fits = False
        lo = at
        while lo < len(lengths) and lengths[lo] > rest:
            lo += 1
        for i in range(lo, len(lengths)):
            n = lengths[i]
            if left[n] > chosen.count(n):
                fits = True
                if extend(i, rest - n, (*chosen, n)) and most and len(found) >= 1 and sum(found[-1]) == room and len(found) >= most // 2:
                    return True
                if most and len(found) >= 4 * most:
                    return True
        if not fits:
            found.append(chosen)
        return False

    extend(0, room, ())
    found = sorted(set(found), key=lambda x: (room - sum(x), len(x), tuple(-n for n in x)))
    kept: list[tuple[int, ...]] = []
    for x in found:
        if not any(_covers(y, x) for y in kept):
            kept.append(x)
        if most and len(kept) == most:
            break
    return kept or [()]


def _covers(big: tuple[int, ...], small: tuple[int, ...]) -> bool:
    """Whether the pieces of `small` fit piece by piece (or several together) in those of `big`, greedily."""
    rooms = sorted(big, reverse=True)
    for n in small:
        i = next((i for i in range(len(rooms) - 1, -1, -1) if rooms[i] >= n), -1)
        if i < 0:
            return False
        rooms[i] -= n
        rooms.sort(reverse=True)
    return True


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, exact: bool = False) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, as few bins as the search finds.

    `exact` searches to the end, with all undominated fillings used any number of times: as few bins as there can be.
    """
    counts = {int(n): int(k) for n, k in counts.items() if k}
    if any(n > capacity or n <= 0 for n in counts):
        raise ValueError("a piece must have 1 to `capacity` tokens")
    total = sum(n * k for n, k in counts.items())
    fewest = max(-(-total // capacity), sum(k for n, k in counts.items() if 2 * n > capacity))
    best = best_fit(counts, capacity)
    bins = sum(k for _, k in best)
    spent = 0

    left = dict(counts)  # one table for the whole search: what a branch takes it gives back

    def search(used: int, waste: int, done: list[tuple[tuple[int, ...], int]]) -> None:
        nonlocal best, bins, spent
        if not left:
            if used < bins:
                best, bins = list(done), used
            return
        spent += 1
        top = max(left)
        _take(left, {top: 1}, 1)
        options = fillings(sorted(left, reverse=True), left, capacity - top, None if exact else FILLINGS)
        _give(left, {top: 1}, 1)
        for filling in options:
            use: dict[int, int] = {top: 1}
            for n in filling:
                use[n] = use.get(n, 0) + 1
            most = min(left[n] // k for n, k in use.items())
            for times in range(most, 0 if exact else most - 1, -1):
                lost = waste + (capacity - top - sum(filling)) * times
                if (bins - 1) * capacity - total < lost:  # no fewer bins than the incumbent can come of this
                    continue
                _take(left, use, times)
                done.append(((top, *filling), times))
                search(used + times, lost, done)
                done.pop()
                _give(left, use, times)
                if bins <= fewest or (spent > nodes and not exact):
                    return

    if bins > fewest:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 10_000 + 8 * capacity))
        try:
            search(0, 0, [])
        finally:
            sys.setrecursionlimit(limit)
    return best


def segments(packing: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, offset), ascending by rank: ranks run on with the sequences."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for pattern, times in packing:
        offset = 0
        for n in pattern:
            rows.setdefault(n, []).append((given.get(n, 0), sequence, offset))
            given[n] = given.get(n, 0) + times
            offset += n
        sequence += times
    return {n: np.array(x, dtype=np.int64) for n, x in rows.items()}


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, lot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            keys, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for lo, hi in in_lots(texts, lot):
                for key, found in zip(keys[lo:hi], encode.many(texts[lo:hi]), strict=True):
                    ids = np.append(found, np.uint32(END_ID)).astype("<u4")
                    a, b, piece = 0, len(ids) % capacity or min(len(ids), capacity), 0
                    while a < len(ids):
                        out.append((key, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                        a, b, piece = b, b + capacity, piece + 1
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, lot: int = LOT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of docs (doc_id, text), encoded about `lot` characters at once."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(_cut(path, capacity, lot)), _PIECES)


def _place(where: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            rank = pdf["rank"].to_numpy()
            for n, at in pdf.groupby("length", sort=False).indices.items():
                rows = where[int(n)]
                i = np.searchsorted(rows[:, 0], rank[at], "right") - 1
                sequence[at] = rows[i, 1] + rank[at] - rows[i, 0]
                offset[at] = rows[i, 2]
            yield pdf.assign(sequence_id=sequence, offset=offset).drop(columns=["rank"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of pieces (with a length of at most `capacity`) with sequence_id and offset.

    Ranks are dealt in two steps, by length and salt, so that a length shared by very many pieces is spread.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(spark))).cast("int"))
    counts = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where = segments(pack_counts(histogram, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begun"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order) - 1).join(begun.hint("merge"), ["length", "salt"]).withColumn("rank", F.col("begun") + F.col("nth")).select(*pieces.columns, "rank")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInPandas(lean(_place(where)), schema)


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(table(spark, sf_dir, "documents"), default_path()))
