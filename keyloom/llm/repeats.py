"""Suffix-array dedup: remove bytes that lie in a string of `width` bytes that an earlier document has too.

A document's text is its UTF-8 bytes.  A window is a string of `width` (50) bytes inside one document.  Every
window has an anchor, the least of the hashes of its 16-byte grams (the leftmost of equals); consecutive windows
with one anchor make a run.  Equal windows have equal anchors at equal places, so all occurrences of a window lie
in the shard of its anchor's hash, and a shard's suffix array over the windows it owns misses none.

1. Documents are scanned and each run sends (anchor hash, run hash, document, place) to the anchor's shard, packed
   in compressed blocks.  Within a block of documents a run that an earlier document of the block has too is
   decided at once and does not meet the shard, so a passage in very many documents reaches its shard once a block.
2. A shard merges identical runs to one leaf with all its occurrences; those after the first document are repeats in
   full.  Only a leaf's first document goes on, and only if its anchor has several leaves.
3. Those runs' bytes are fetched, and an enhanced suffix array over the leaves of a shard is scanned with a stack
   for maximal repeat groups (suffix_array.py): the left extension of a run's first window counts as diverse, since
   what precedes it belongs to another shard.  An occurrence takes the longest group that has a smaller document.
4. The ranges meet their documents, are joined and cut out.

Order of documents is by doc_id, null first.  Rows of equal doc_id are one document's rows: neither removes from
the other; a doc_id of -2^63 counts as null.  Null or empty texts have nothing to remove; so have texts under `width`
bytes.  Of equal texts the one of least doc_id stays whole.  A document of any length is scanned in pieces.  Two
64-bit hashes decide equality of runs and bytes decide it within suffix arrays.  Columns besides may have any name.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import lean, materialize, partitions, ship, table
from keyloom.llm.kernels import _BASE, _BYTE, U64, gram_hashes, mix64, slabs, sliding_min
from keyloom.llm.suffix_array import NO_LEFT, SuffixArray, repeat_groups

WIDTH = 50
GRAM = 16
#: Bytes of documents in one block.
BLOCK_BYTES = 1 << 23
#: Bytes that are scanned at once, a longer document in pieces; a place in a piece has _PLACE_BITS bits.
PIECE = 1 << 22
_PLACE_BITS = 24
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
NULL_ID = -(1 << 63)


def text_key(text: bytes | np.ndarray) -> int:
    """What tells the texts of equal doc_ids apart."""
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def runs_of(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, run hash, first window, windows) of every run of a slab; places count from the document's start.

    A slab of one document longer than PIECE is scanned in pieces; a run ends where a piece does.
    """
    if len(data) <= PIECE or len(offsets) > 2:
        return _runs_of(data, offsets, width)
    parts = []
    for at in range(0, len(data) - width + 1, PIECE):
        piece = data[at : at + PIECE + width - 1]
        document, gram, run, first, count = _runs_of(piece, np.array([0, len(piece)]), width)
        parts.append((document, gram, run, first + at, count))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _runs_of(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    span = width - GRAM + 1
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < width:
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    gram = gram_hashes(data, GRAM)
    low = U64((1 << _PLACE_BITS) - 1)
    least = sliding_min((gram & ~low) | np.arange(len(gram), dtype=np.uint64), span)
    inside = np.zeros(len(data) + 1, dtype=np.int8)  # windows that end in their document
    begin, last = offsets[:-1], np.maximum(offsets[1:] - width + 1, offsets[:-1])
    np.add.at(inside, begin, 1)
    np.add.at(inside, last, -1)
    window = np.flatnonzero(np.cumsum(inside)[: len(least)])
    if not len(window):
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    anchor = (least[window] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, count = window[new], np.diff(np.append(new, len(window)))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data), _BASE))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * power)])
        shift = np.cumprod(np.full(len(data), _INVERSE))
        run = mix64((total[first + count + width - 1] - total[first]) * shift[first] + count.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    document = np.searchsorted(offsets, first, "right") - 1
    return document, gram[anchor[new]], run, first - offsets[document], count


def _anchors(n_shards: int, width: int):
    """Blocks of documents to rows (shard, block): runs for the shard of their anchor, and runs decided within the block."""

    def send(ids: np.ndarray, texts: np.ndarray, parts: list[tuple[np.ndarray, ...]], nth: int) -> Iterator[tuple[int, bytes]]:
        doc, gram, run, first, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(doc):
            return
        shard = (mix64(gram.copy()) % U64(n_shards)).astype(np.int64)
        both = mix64(gram + mix64(run.copy()))
        order = np.argsort(both)
        g, r = gram[order], run[order]
        new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])]))
        owner = ids[doc[order]]
        decided = np.zeros(len(doc), dtype=bool)
        decided[order] = owner > np.repeat(np.minimum.reduceat(owner, new), np.diff(np.append(new, len(order))))
        shard[decided] = (doc[decided] + nth) % n_shards  # any shard will do
        order = np.argsort(shard.astype(np.uint16) if n_shards <= 1 << 16 else shard, kind="stable")  # rows are by document and place
        cut = np.searchsorted(shard[order], np.arange(n_shards + 1))
        for s in range(n_shards):
            at = order[cut[s] : cut[s + 1]]
            if len(at):
                there, local = np.unique(doc[at], return_inverse=True)
                yield s, _block(ids[there], texts[there], local, gram[at], run[at], first[at], count[at], decided[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, held, ids, texts, parts, size = 0, 0, [], [], [], 0
        for batch in batches:
            key = np.array([NULL_ID if k is None else k for k in batch.column(0).to_pylist()], dtype=np.int64)
            for lo, hi, data, offsets in slabs(batch.column(1)):
                found = runs_of(data, offsets, width)
                ids.append(key[lo:hi])
                texts.append(np.array([text_key(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.int64))
                parts.append((found[0] + held, *found[1:]))
                held, size = held + hi - lo, size + len(data)
                if size >= BLOCK_BYTES:
                    yield _rows(send(np.concatenate(ids), np.concatenate(texts), parts, nth))
                    nth, held, ids, texts, parts, size = nth + held, 0, [], [], [], 0
        if parts:
            yield _rows(send(np.concatenate(ids), np.concatenate(texts), parts, nth))

    return run


def _rows(rows: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "block"])


def _block(ids, texts, local, gram, run, first, count, decided) -> bytes:
    low = zstandard.ZstdCompressor(level=1).compress(
        ids.astype("<i8").tobytes() + texts.astype("<i8").tobytes() + local.astype("<u4").tobytes() + first.astype("<u4").tobytes() + count.astype("u1").tobytes() + np.packbits(decided).tobytes()
    )
    plain = gram.astype("<u8").tobytes() + run.astype("<u8").tobytes()  # hashes do not compress
    return len(ids).to_bytes(4, "little") + len(gram).to_bytes(4, "little") + plain + low


def _unblock(block: bytes) -> tuple[np.ndarray, ...]:
    d, n = int.from_bytes(block[:4], "little"), int.from_bytes(block[4:8], "little")
    gram, run = np.frombuffer(block, "<u8", n, 8), np.frombuffer(block, "<u8", n, 8 + 8 * n)
    low = zstandard.ZstdDecompressor().decompress(block[8 + 16 * n :])
    ids, texts = np.frombuffer(low, "<i8", d), np.frombuffer(low, "<i8", d, 8 * d)
    at = 16 * d
    local, first = np.frombuffer(low, "<u4", n, at), np.frombuffer(low, "<u4", n, at + 4 * n)
    count = np.frombuffer(low, "u1", n, at + 8 * n)
    decided = np.unpackbits(np.frombuffer(low, np.uint8, -1, at + 9 * n), count=n).astype(bool)
    return ids[local], texts[local], gram, run, first.astype(np.int64), count.astype(np.int64), decided


_TEXTS = [T.StructField("doc", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("packed", T.BinaryType())]
_COUNTS = [T.StructField(n, T.LongType()) for n in ("doc_id", "text_key", "n_bytes", "n_removed", "n_spans")]
_RUNS = "doc long, text_key long, first long, windows int, leaf long, gram long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's blocks to its runs that matter: repeats in full (leaf null), and first occurrences of a leaf whose anchor has others."""
    parts = [_unblock(b) for batch in batches for b in batch.column(1).to_pylist()]
    if not parts:
        return
    ids, key, gram, run, first, count, decided = (np.concatenate(x) for x in zip(*parts, strict=True))
    yield _run_rows(ids[decided], key[decided], first[decided], count[decided], None, None)
    at = np.flatnonzero(~decided)
    at = at[np.lexsort((run[at], gram[at]))]
    if not len(at):
        return
    g, r, i = gram[at], run[at], ids[at]
    new_gram = np.concatenate([[True], g[1:] != g[:-1]])
    new_leaf = new_gram | np.concatenate([[True], r[1:] != r[:-1]])
    leaf = np.cumsum(new_leaf) - 1
    later = i > np.minimum.reduceat(i, np.flatnonzero(new_leaf))[leaf]
    yield _run_rows(i[later], key[at][later], first[at][later], count[at][later], None, None)
    group = np.cumsum(new_gram) - 1
    leaves = np.bincount(group[new_leaf])
    start = np.flatnonzero(new_gram)
    several = (leaves > 1) & (np.minimum.reduceat(i, start) < np.maximum.reduceat(i, start))
    on = ~later & several[group]
    yield _run_rows(i[on], key[at][on], first[at][on], count[at][on], r[on], g[on])


def _run_rows(doc, key, first, windows, leaf, gram) -> pa.RecordBatch:
    n = len(doc)
    arrays = [pa.array(doc), pa.array(key.astype(np.int64)), pa.array(first), pa.array(windows.astype(np.int32))]
    arrays += [pa.nulls(n, pa.int64()) if x is None else pa.array(x.astype(np.int64)) for x in (leaf, gram)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc", "text_key", "first", "windows", "leaf", "gram"])


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text_key, packed, other columns): the text's bytes compressed, for the shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
        doc = [NULL_ID if k is None else k for k in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array([text_key(x) for x in texts], pa.int64()), pa.array([pack(x) for x in texts], pa.binary()), *batch.columns[2:]], names=["doc", "text_key", "packed", *batch.schema.names[2:]])


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes data[start : start + length] of every row, end to end."""
    first = np.cumsum(length) - length
    return data[np.repeat(start - first, length) + np.arange(int(length.sum()))]


def _fetch(n_shards: int, width: int):
    """Documents with their runs to the leaves' bytes, compressed by shard and block of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, size = [], 0
        for batch in batches:
            texts = [unpack(x) for x in batch.column(2).to_pylist()]
            wanted = batch.column(3)
            row = np.repeat(np.arange(len(texts)), np.diff(wanted.offsets.to_numpy()))
            wanted = wanted.flatten()
            first, windows, gram = (wanted.field(i).to_numpy().astype(np.int64) for i in range(3))
            begin = np.cumsum([0, *map(len, texts)])[:-1]
            data, at = np.frombuffer(b"".join(texts), np.uint8), begin[row] + first
            left = np.where(first > 0, data[np.maximum(at - 1, 0)], NO_LEFT).astype(np.uint16)
            doc, key = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            held.append((doc, key, first, windows, left, gram, _gather(data, at, windows + width - 1)))
            size += len(held[-1][-1])
            if size > BLOCK_BYTES:
                yield _rows(_leaves(held, n_shards, width))
                held, size = [], 0
        if held:
            yield _rows(_leaves(held, n_shards, width))

    return run


#: What a block of leaves holds of each.
_LEAF = [("doc", "<i8"), ("text_key", "<i8"), ("first", "<u4"), ("windows", "u1"), ("left", "<u2"), ("gram", "<u8")]


def _leaves(held: list[tuple], n_shards: int, width: int) -> Iterator[tuple[int, bytes]]:
    *columns, data = (np.concatenate(x) for x in zip(*held, strict=True))
    length = columns[3] + width - 1
    begin = np.cumsum(length) - length
    shard = (mix64(columns[5].astype(np.uint64)) % U64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(n_shards + 1))
    pack = zstandard.ZstdCompressor(level=1).compress
    for s in range(n_shards):
        at = order[cut[s] : cut[s + 1]]
        if len(at):
            raw = b"".join(c[at].astype(t).tobytes() for c, (_, t) in zip(columns, _LEAF, strict=True))
            yield s, len(at).to_bytes(4, "little") + pack(raw + _gather(data, begin[at], length[at]).tobytes())


def _unpack_leaves(block: bytes) -> tuple[np.ndarray, ...]:
    n, at, out = int.from_bytes(block[:4], "little"), 0, []
    raw = zstandard.ZstdDecompressor().decompress(block[4:])
    for _, t in _LEAF:
        out.append(np.frombuffer(raw, t, n, at).astype(np.uint64 if t == "<u8" else np.int64))
        at += n * np.dtype(t).itemsize
    return *out, np.frombuffer(raw, np.uint8, -1, at)


def _scan(width: int):
    """A shard's leaves to the repeats found by its suffix array: rows (doc, text_key, begin, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_unpack_leaves(b) for batch in batches for b in batch.column(1).to_pylist()]
        if not blocks:
            return
        *columns, data = (np.concatenate(x) for x in zip(*blocks, strict=True))
        del blocks
        length = columns[3] + width - 1
        begin = np.cumsum(length) - length
        # the grams of a shard in slices, so that a suffix array stays small; a gram's leaves stay together
        order = np.argsort(columns[5], kind="stable")
        gram = columns[5][order]
        ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(order))
        total = np.cumsum(columns[3][order])
        lo = 0
        while lo < len(order):
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE))
            hi = int(ends[min(int(np.searchsorted(ends, hi)), len(ends) - 1)])
            at = order[lo:hi]
            yield _repeats(*(c[at] for c in columns[:5]), _gather(data, begin[at], length[at]), width)
            lo = hi

    return run


#: Windows of the leaves of one suffix array, unless one gram has more.
SLICE = 1 << 17


def _repeats(doc, key, first, windows, left, data, width) -> pa.RecordBatch:
    """Repeats among leaves; data has their bytes end to end."""
    end = np.cumsum(windows + width - 1)
    start = end - (windows + width - 1)
    leaf = np.repeat(np.arange(len(doc)), windows)
    at = np.arange(len(leaf)) - np.repeat(np.cumsum(windows) - windows, windows)
    before = np.where(at > 0, data[np.maximum(start[leaf] + at - 1, 0)].astype(np.int64), NO_LEFT)
    # Windows of equal bytes share a prefix of `width`.  Leave out those that no other leaf has, those of one document
    # only and those that can't be extended to the left in more than one way: no part of them can be a maximal repeat.
    window = gram_hashes(data, width)[start[leaf] + at]
    order = np.argsort(window)
    new = np.flatnonzero(np.concatenate([[True], window[order][1:] != window[order][:-1]]))

    def differs(x: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(x, new) != np.maximum.reduceat(x, new)

    side, owner = before[order], doc[leaf[order]]
    keep = differs(owner) & (differs(side) | (side[new] == NO_LEFT))
    chosen = order[np.repeat(keep, np.diff(np.append(new, len(order))))]
    sa = SuffixArray(data, start, end, leaf[chosen], at[chosen])
    before = np.where(sa.at > 0, data[np.maximum(start[sa.leaf] + sa.at - 1, 0)].astype(np.int64), NO_LEFT)
    owner = doc[sa.leaf]
    longest = np.zeros(len(owner), dtype=np.int64)
    for a, b, length in repeat_groups(sa, before, width):
        mine = owner[a : b + 1]
        hit = (mine > mine.min()) & (longest[a : b + 1] == 0)
        longest[a : b + 1][hit] = length
    hit = longest > 0
    begin = first[sa.leaf[hit]] + sa.at[hit]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (owner[hit], key[sa.leaf[hit]], begin, begin + longest[hit])], names=["doc", "text_key", "begin", "end"])


def repeat_ranges(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges): texts (doc, text_key, packed, other columns of docs as they are) and the ranges to remove (doc, text_key, begin, end), which may overlap.

    docs has doc_id and text first.
    """
    spark = docs.sparkSession
    ship(spark)
    n_shards = 2 * partitions(spark)  # a task holds the runs of its shard
    others = docs.schema.fields[2:]
    blocks = docs.select("doc_id", "text").mapInArrow(lean(_anchors(n_shards, width)), "shard int, block binary").repartitionById(n_shards, "shard")
    runs = materialize(blocks.mapInArrow(lean(_merge), _RUNS), "runs")
    texts = docs.mapInArrow(lean(_squeeze), T.StructType([*_TEXTS, *others]))
    wanted = runs.where(F.col("leaf").isNotNull()).groupBy("doc", "text_key").agg(F.collect_list(F.struct("first", "windows", "gram")).alias("wanted"))
    # all columns are read here too, so that both joins can share one shuffle of the texts
    leaves = texts.join(wanted, ["doc", "text_key"]).select("doc", "text_key", "packed", "wanted", *[f.name for f in others]).mapInArrow(lean(_fetch(n_shards, width)), "shard int, block binary")
    found = leaves.repartitionById(n_shards, "shard").mapInArrow(lean(_scan(width)), "doc long, text_key long, begin long, end long")
    full = runs.where(F.col("leaf").isNull()).select("doc", "text_key", F.col("first").alias("begin"), (F.col("first") + F.col("windows") + (width - 1)).alias("end"))
    return texts, full.unionByName(found)


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_cut() with `kept` as text, without what is left of a character that a cut has split."""
    for batch in _cut(batches):
        yield batch.set_column(5, "kept", pa.array([x.decode("utf-8", "ignore") for x in batch.column(5).to_pylist()], pa.string()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        docs, text_keys, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for packed, ranges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            text = unpack(packed)
            spans = join_ranges([(r["begin"], r["end"]) for r in ranges or ()])
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            out.append((len(text), sum(b - a for a, b in spans), len(spans), b"".join(kept)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array([None if d == NULL_ID else d for d in docs], pa.int64()), pa.array(text_keys, pa.int64()), *[pa.array(list(c), pa.int64()) for c in columns[:3]], pa.array(list(columns[3]), pa.binary()), *batch.columns[4:]],
            names=["doc_id", "text_key", "n_bytes", "n_removed", "n_spans", "kept", *batch.schema.names[4:]],
        )


def join_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by ranges, ascending; ranges that touch are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, text_key (of the text's bytes), n_bytes, n_removed, n_spans, kept (the bytes that stay) for every row of docs.

    Columns `carry` of docs follow as _c0, _c1, ...  With `as_text` kept is text.
    """
    names = [f"_c{i}" for i in range(len(carry))]
    docs = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)])
    texts, ranges = repeat_ranges(docs, width)
    ranges = ranges.groupBy("doc", "text_key").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    joined = texts.join(ranges, ["doc", "text_key"], "left").select("doc", "text_key", "packed", "ranges", *names)
    kept = T.StructField("kept", T.StringType() if as_text else T.BinaryType())
    return joined.mapInArrow(lean(_cut_texts if as_text else _cut), T.StructType([*_COUNTS, kept, *docs.schema.fields[2:]]))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The result stated by all windows as hex strings, taken from chunks of 2000 bytes.
OP1_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(doc_id, -9223372036854775808) AS place, hex(encode(coalesce(text, ''))) AS h FROM documents
), chunks AS (
  SELECT id, place, c, substr(h, (4000 * c + 1)::INT, {4000 + 2 * (WIDTH - 1)}) AS h FROM texts, unnest(generate_series(0, len(h) // 4000)) AS s(c)
), windows AS (
  SELECT id, place, 2000 * c + k AS i, substr(h, (2 * k + 1)::INT, {2 * WIDTH}) AS w FROM chunks, unnest(generate_series(0, least(1999, len(h) // 2 - {WIDTH}))) AS s(k)
), repeated AS (
  SELECT id, i, lag(i) OVER (PARTITION BY id ORDER BY i) AS before FROM (SELECT id, i, place, min(place) OVER (PARTITION BY w) AS first FROM windows) WHERE first < place
), spans AS (
  SELECT id, min(i) AS a, max(i) + {WIDTH} AS b FROM (SELECT id, i, sum((before IS NULL OR i - before > {WIDTH})::INT) OVER (PARTITION BY id ORDER BY i) AS span FROM repeated) GROUP BY id, span
), gaps AS (
  SELECT id, a, b, lag(b, 1, 0) OVER (PARTITION BY id ORDER BY a) AS kept_from FROM spans
), parts AS (
  SELECT t.id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, (2 * kept_from + 1)::INT, (2 * (a - kept_from))::INT), '' ORDER BY a) AS head, max(b) AS last
  FROM gaps g JOIN texts t USING (id) GROUP BY t.id
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN p.id IS NULL THEN h ELSE head || substr(h, (2 * last + 1)::INT) END)) AS kept_sha256
FROM texts LEFT JOIN parts p USING (id)
"""
