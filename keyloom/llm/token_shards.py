"""Token-id output: shards of raw ids with a minimal perfect hash index from document key to place.

Documents are laid out in ascending doc_id order (null first; equal ids by text).  A task writes the ids of its
range of documents as shards of about SHARD_IDS ids; a document never crosses shards.  A shard is one row of a
Parquet table in the shared folder, so any store that Spark reaches can hold it:

  part, shard   place in the order; `first_key` and `last_key` are the shard's smallest and largest keys
  width         bytes of an id: 2 if the vocabulary fits, else 4, little-endian
  ids           the raw ids of all its documents, each ending with id 0
  keys          the key and the number of ids of each document
  index         the index image: levels of a bit array (minimal perfect hash) with rank samples, then for each slot a
                32-bit fingerprint of its key, its document's first id and number of ids, how many documents share the
                key, and which of the shard's documents is the first of them

A key's shards are those whose range holds it.  Access within a shard is constant time: hash into the levels, rank the
bit, compare the fingerprint, slice the ids.  Equal doc_ids (repeated rows) lie side by side, ordered by text, in one
shard or in shards that follow one another; the index holds the key once, with how many there are.

Cases: null text is the end id alone, as is an empty one; a very long text makes a shard of its own; a null doc_id comes
first, and a doc_id of -2^63 counts as null; other columns, whatever their names, are not read; an empty table gives
no shard.
"""

from __future__ import annotations

import functools
import operator
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import lean, materialize, partitions, ship, table
from keyloom.llm.kernels import U64, mix64
from keyloom.llm.tokens import default_path, encoder, in_lots

SHARD_IDS = 1 << 20
END_ID = 0
#: Bits of a level for each key still without a place.
LEVEL_BITS = 2.0
MAX_LEVELS = 48
NULL_KEY = -(1 << 63)
_MAGIC = b"KLMPH2\0\0"


def _seeded(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(keys.view(np.uint64) + U64(0x9E3779B97F4A7C15) * U64(seed + 1))


class PerfectIndex:
    """A minimal perfect hash of distinct 64-bit keys, with a fingerprint and a payload row for each slot.

    The bits of all levels lie in 64-bit words; `ranks` has the number of bits before each word, so a key's slot is a
    probe a level, one rank and one population count, and loading an image copies nothing.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray, fingerprints: np.ndarray, rows: np.ndarray):
        self.sizes, self.words, self.ranks, self.fingerprints, self.rows = sizes, words, ranks, fingerprints, rows
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    @staticmethod
    def build(keys: np.ndarray, rows: np.ndarray) -> "PerfectIndex":
        """rows: (n, columns) of what each key maps to."""
        left, at, sizes, bits = np.arange(len(keys)), np.zeros(len(keys), dtype=np.int64), [], []
        base = 0
        for level in range(MAX_LEVELS):
            if not len(left):
                break
            size = max(64, int(len(left) * LEVEL_BITS))
            place = (_seeded(keys[left], level) % U64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            lucky = alone[place]
            at[left[lucky]] = base + place[lucky]
            left, base = left[~lucky], base + size
            sizes.append(size)
            bits.append(alone)
        if len(left):
            raise ValueError("keys of an index must be distinct")
        bits = np.concatenate([*bits, np.zeros(-base % 64, dtype=bool)])
        words = np.packbits(bits, bitorder="little").view("<u8")
        ranks = np.cumsum(np.bitwise_count(words), dtype=np.uint32) - np.bitwise_count(words)
        slot = (np.cumsum(bits) - 1)[at] if len(keys) else at
        fingerprints, out = np.zeros(len(keys), dtype=np.uint32), np.zeros(rows.shape, dtype=np.uint32)
        fingerprints[slot] = _seeded(keys, 97).astype(np.uint32)
        out[slot] = rows
        return PerfectIndex(np.array(sizes, dtype=np.int64), words, ranks, fingerprints, out)

    def dump(self) -> bytes:
        head = _MAGIC + struct.pack("<IIII", len(self.sizes), len(self.words), len(self.fingerprints), self.rows.shape[1])
        parts = ((self.sizes, "<i8"), (self.words, "<u8"), (self.ranks, "<u4"), (self.fingerprints, "<u4"), (self.rows, "<u4"))
        return head + b"".join([x.astype(t).tobytes() for x, t in parts])

    @staticmethod
    def load(image: bytes) -> "PerfectIndex":
        if image[:8] != _MAGIC:
            raise ValueError("not an index image")
        levels, n_words, n, columns = struct.unpack_from("<IIII", image, 8)
        at, out = 24, []
        for count, t in ((levels, "<i8"), (n_words, "<u8"), (n_words, "<u4"), (n, "<u4"), (n * columns, "<u4")):
            out.append(np.frombuffer(image, t, count, at))
            at += out[-1].nbytes
        return PerfectIndex(*out[:4], out[4].reshape(n, columns))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the fingerprint tells that it has none."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            place = self.starts[level] + (_seeded(keys[left], level) % U64(size)).astype(np.int64)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            set_ = (word >> bit & U64(1)).astype(bool)
            below = word & ((U64(1) << bit) - U64(1))
            out[left[set_]] = (self.ranks[place >> 6].astype(np.int64) + np.bitwise_count(below))[set_]
            left = left[~set_]
        known = out >= 0
        wrong = self.fingerprints[out[known]] != _seeded(keys[known], 97).astype(np.uint32)
        out[np.flatnonzero(known)[wrong]] = -1
        return out


_SHARDS = "part int, shard int, first_key long, last_key long, n_docs long, n_ids long, width int, ids binary, keys binary, index binary"


def _image(part: int, shard: int, keys: list[int], ids: list[np.ndarray], width: int) -> pa.RecordBatch:
    keys_, sizes = np.array(keys, dtype=np.int64), np.array([len(x) for x in ids], dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys_[1:] != keys_[:-1]]))
    starts = np.cumsum(sizes) - sizes
    rows = np.stack([starts[first], sizes[first], np.diff(np.append(first, len(keys_))), first], axis=1)
    payload = np.concatenate(ids).astype("<u2" if width == 2 else "<u4").tobytes()
    row = [part, shard, keys[0], keys[-1], len(keys), int(sizes.sum()), width, payload, _pack(keys_, sizes), PerfectIndex.build(keys_[first], rows).dump()]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["part", "shard", "first_key", "last_key", "n_docs", "n_ids", "width", "ids", "keys", "index"])


def _pack(keys: np.ndarray, sizes: np.ndarray) -> bytes:
    return keys.astype("<i8").tobytes() + sizes.astype("<u4").tobytes()


def _write(path: str, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        width = 2 if encode.vocab_size <= 1 << 16 else 4
        part, shard, keys, ids, total = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            order, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for lo, hi in in_lots(texts):
                for key, found in zip(order[lo:hi], encode.many(texts[lo:hi]), strict=True):
                    one = np.append(found, np.uint32(END_ID))
                    if total + len(one) > shard_ids and keys:
                        yield _image(part, shard, keys, ids, width)
                        shard, keys, ids, total = shard + 1, [], [], 0
                    keys.append(NULL_KEY if key is None else key)
                    ids.append(one)
                    total += len(one)
        if keys:
            yield _image(part, shard, keys, ids, width)

    return run


def write_token_shards(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards of docs (doc_id, text) and return their table, as read back."""
    spark = docs.sparkSession
    ship(spark)
    laid = docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(laid.mapInArrow(lean(_write(path, shard_ids)), _SHARDS), "token-shards")


def document_ids(shard: dict, key: int | None) -> list[np.ndarray]:
    """The ids of each document of one key in a shard (a row of the table), in its order; empty if it has none."""
    key = NULL_KEY if key is None else key
    slot = int(PerfectIndex.load(shard["index"]).find(np.array([key], dtype=np.int64))[0])
    if slot < 0:
        return []
    start, _, n, first = PerfectIndex.load(shard["index"]).rows[slot].tolist()
    if np.frombuffer(shard["keys"], "<i8", 1, 8 * first)[0] != key:  # another key of the same fingerprint
        return []
    end = start + np.cumsum(np.frombuffer(shard["keys"], "<u4", n, 8 * shard["n_docs"] + 4 * first).astype(np.int64))
    ids = np.frombuffer(shard["ids"], "<u2" if shard["width"] == 2 else "<u4")
    return [ids[a:b] for a, b in zip([start, *end[:-1]], end, strict=True)]


def _looked_up(keys: list[int | None]):
    wanted = np.unique(np.array([NULL_KEY if k is None else k for k in keys], dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                for key in wanted[np.searchsorted(wanted, shard["first_key"]) : np.searchsorted(wanted, shard["last_key"], "right")].tolist():
                    found = document_ids(shard, key)
                    doc_id = None if key == NULL_KEY else key
                    columns = [[doc_id] * len(found), [shard["part"]] * len(found), [shard["shard"]] * len(found), range(len(found)), found]
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "part", "shard", "nth", "ids"])

    return run


def lookup(shards: DataFrame, keys: list[int | None]) -> DataFrame:
    """doc_id, part, shard, nth, ids of every document of the keys; copies of a key may lie in several shards.

    Only shards whose range of keys holds one of the keys are read; Parquet's statistics drop files where there are few keys.
    """
    ship(shards.sparkSession)
    known = [NULL_KEY if k is None else k for k in keys]
    within = (F.col("first_key") <= max(known, default=0)) & (F.col("last_key") >= min(known, default=0))
    if 0 < len(known) <= 64:
        within = functools.reduce(operator.or_, [(F.col("first_key") <= k) & (F.col("last_key") >= k) for k in known])
    read = shards.where(within).select("part", "shard", "first_key", "last_key", "n_docs", "width", "ids", "keys", "index")
    return read.mapInArrow(lean(_looked_up(keys)), "doc_id long, part int, shard int, nth int, ids array<long>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, shard, n_docs, width, ids, keys, image = (batch.column(i)[row].as_py() for i in range(7))
            index = PerfectIndex.load(image)
            key = np.frombuffer(keys, "<i8", n_docs)
            size = np.frombuffer(keys, "<u4", n_docs, 8 * n_docs).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            slots = index.find(key[first])
            found = index.rows[slots].astype(np.int64)
            if (slots < 0).any() or (found[:, 3] != first).any():
                raise ValueError(f"shard {part}.{shard}: the index does not lead to its documents")
            nth = np.arange(n_docs) - np.repeat(first, np.diff(np.append(first, n_docs)))
            which = np.repeat(np.arange(len(first)), np.diff(np.append(first, n_docs)))
            before = np.cumsum(size) - size
            start = found[which, 0] + before - before[first][which]
            everything = np.frombuffer(ids, "<u2" if width == 2 else "<u4").astype("<u4")
            n = np.where(nth == 0, found[which, 1], size)
            crc = [zlib.crc32(everything[a : a + k].tobytes()) for a, k in zip(start.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"part": np.int32(part), "shard": np.int32(shard), "doc_id": pd.array([None if k == NULL_KEY else k for k in key.tolist()], dtype="Int64"), "local": start, "n_tokens": n, "ids_crc32": np.array(crc, dtype=np.int64)}), preserve_index=False)


def read_token_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, by its index entry and its ids in the files."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids_of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids_of_part").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begun = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("shard_start")).join(parts, "part")
    rows = shards.select("part", "shard", "n_docs", "width", "ids", "keys", "index").mapInArrow(lean(_digests), "part int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(begun.hint("merge"), ["part", "shard"]).select("doc_id", (F.col("part_start") + F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_shards(write_token_shards(table(spark, sf_dir, "documents"), default_path()))
