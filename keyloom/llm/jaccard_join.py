"""N-gram Jaccard join by grouped prefixes, and the classes that its links make.

A document's set is its distinct five-word shingles (64-bit hashes).  Two documents link if 100 * intersection >=
75 * union.  In a fixed order of shingles, linked sets of n shingles share one of their first
n - ceil(0.75 n) + 1, their prefix.

1. The order puts rare shingles first: those that are frequent in some stretch of the documents come last, by their
   count, and before them shingles come by how common their words are.  Both are counted over all documents, stretch
   by stretch; a stretch reports what has at least a fixed share of it, so what has that share of the whole is
   reported.  Any order gives the same links; the lists that are sent to executors are bounded.
2. Documents with an equal prefix and size are one group.  Groups, not documents, are listed under the shingles of
   their prefix.  Lists of one group are dropped where they form.
3. In a list, groups of like size are paired with the list's least (a star), members of a group with the least of
   them.  Pairs pass filters of size, position and a parity sketch (a bound of the symmetric difference), and the rest are
   verified on the whole sets.  What links makes components.
4. Lists that still hold several components are gone through again, every pair across components passing the filters
   first, the sketches too: once to verify each set's likeliest partner outside its component, which joins what
   belongs together, and once, with the components that result, all pairs that are left.  So each pair that shares a
   prefix shingle is rejected by a bound, verified or already connected: no link is lost, and a group of very many near copies
   costs about its size, not its square.  A list of many sets is paired in tiles of two blocks of it, so no task holds a
   list as a whole.
5. Components of all verified links; copies (equal sets) take part once and get their class at the end.  A set's node
   begins with its least doc_id, so a component's least node names its least document.
6. Links lie inside components, so all pairs of a component's sets are verified, in tiles of two blocks of sets, and
   counted or listed.  This is the square of a component's number of different sets; copies count by their number.

Cases: null or empty texts have no set, n_shingles 0, and are components of their own; rows of equal doc_id are
separate documents with that id, repeated rows are copies of one another; a null doc_id comes last; a very long text
is one set like others, held by one task; sets of equal likeness to another are taken by their hash; other columns,
whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import drop_table, lean, materialize, partitions, ship, table
from keyloom.llm.components import components
from keyloom.llm.kernels import LOWER, U64, Lookup, mix64, shingle_sets, slabs, weighed_shingles, word_bounds, word_hashes

SHINGLE = 5
#: Similarity in hundredths.
LIKE = 75
#: A stretch of documents for counting, in shingles; what is reported from it; the longest list of frequent shingles.
STRETCH = 1 << 21
REPORT_AT_LEAST = 4
REPORT_SHARE = 1 / 2000
MOST_FREQUENT = 200_000
#: Words that make up this share of a stretch are reported, so a stretch reports 1 / WORD_SHARE at most; and how many are kept.
WORD_SHARE = 1 / 20_000
MOST_WORDS = 50_000
#: Bytes of the sketch that goes with a list's entry.
LIST_SKETCH = 128
#: Shingles of one batch of prefixes.
BATCH = 1 << 20
#: Sets and shingles of one block of a component, on average, and shingles that a tile compares at once.
BLOCK_SETS = 256
BLOCK_SHINGLES = 1 << 20
COMPARED_AT_ONCE = 4096
#: Pairs looked at and entries of lists held at once.
PAIRS_AT_ONCE = 1 << 18
ENTRIES_AT_ONCE = 50_000
#: Sets of a block of a list: longer lists are paired in tiles of two blocks.  Pairs of a tile that wait for their sketches, and that go out at once.
LIST_SETS = 1024
PAIRS_HELD = 1 << 21
PAIRS_OUT = 1 << 16
#: Documents to verify are picked by a broadcast of their ids up to this many (8 MB), beyond by a filter of 64-bit words (1 MB).
BROADCAST_IDS = 1 << 20
FILTER_WORDS = 1 << 17


def prefix_size(n: int) -> int:
    return n - -(-LIKE * n // 100) + 1 if n else 0


_SHINGLE, _WORD = 0, 1


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def report(sets: list[np.ndarray], words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for kind, found, least in ((_SHINGLE, sets, max(REPORT_AT_LEAST, len(sets) * REPORT_SHARE)), (_WORD, words, max(2, sum(map(len, words)) * WORD_SHARE))):
            hashes, counts = np.unique(np.concatenate(found), return_counts=True)
            often = counts >= least
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(often.sum()), kind, dtype=np.int32)), pa.array(hashes[often].astype(np.int64)), pa.array(counts[often].astype(np.int64))], names=["kind", "hash", "n"])

    sets, words, size = [], [], 0
    for batch in batches:
        for _, _, data, offsets in slabs(batch.column(0)):
            found = shingle_sets(data, offsets, SHINGLE)
            low = LOWER[data]
            words.append(word_hashes(low, *word_bounds(low, offsets)[:2]))
            sets += found
            size += sum(map(len, found))
            if size >= STRETCH:
                yield from report(sets, words)
                sets, words, size = [], [], 0
    if sets:
        yield from report(sets, words)


class Order:
    """The order of shingles: (count if frequent, else 0; how common its words are; hash)."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray, words: np.ndarray, word_counts: np.ndarray):
        self.counts = Lookup(shingles, counts)
        self.levels = Lookup(words, 1 + np.floor(2 * np.log2(np.maximum(1, word_counts / max(1, word_counts.min(initial=1 << 62))))).astype(np.int32))

    def arrange(self, own: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Places of the shingles `own` (ascending) in order."""
        return np.argsort(self.counts(own) * 1024 + weight, kind="stable")  # five levels come to less; equal ones stay by hash


def shingle_order(docs: DataFrame) -> Order:
    """The order that the documents suggest, from at most MOST_FREQUENT shingles and MOST_WORDS words."""
    found = docs.select("text").mapInArrow(lean(_frequent), "kind int, hash long, n long").groupBy("kind", "hash").agg(F.sum("n").alias("n"))
    found = materialize(found, "frequent", few=True)
    out = []
    for kind, most in ((_SHINGLE, MOST_FREQUENT), (_WORD, MOST_WORDS)):
        rows = found.where(F.col("kind") == kind).orderBy(F.desc("n"), "hash").limit(most).toPandas()
        out += [rows["hash"].to_numpy(dtype=np.int64).astype(np.uint64), rows["n"].to_numpy(dtype=np.int64)]
    drop_table(found)
    return Order(*out)


def parity_sketch(shingles: np.ndarray) -> bytes:
    """One bit for each of 2^k places (2^k at least the set's size and 64): whether an odd number of shingles falls there."""
    bits = 1 << max(6, int(max(1, len(shingles)) - 1).bit_length())
    places = mix64(shingles.copy()) & U64(bits - 1)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference, from two sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def folded(sketch: bytes, most: int) -> bytes:
    """A sketch of at most `most` bytes from a longer one."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > most:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def _prefixes(n_shards: int, order: Order):
    """Documents to rows (shard, list, doc...): packed prefix lists for shards, and one member row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[tuple] = []
        shingle, group, size, seen = [], [], [], set()
        total = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in slabs(batch.column(1)):
                for doc_id, (own, weight) in zip(ids[lo:hi], weighed_shingles(data, offsets, SHINGLE, order.levels), strict=True):
                    n = len(own)
                    if not n:
                        members.append((doc_id, None, None, 0, None))
                        continue
                    prefix = own[order.arrange(own, weight)[: prefix_size(n)]]
                    raw = own.tobytes()
                    g = xxhash.xxh3_64_intdigest(prefix.tobytes(), n)
                    members.append((doc_id, xxhash.xxh3_128_digest(raw), g - (1 << 64) if g >> 63 else g, n, parity_sketch(own)))
                    if g not in seen:
                        seen.add(g)
                        shingle.append(prefix)
                        group.append(g)
                        size.append(n)
                        total += len(prefix)
                if total >= BATCH or len(members) >= 10_000:
                    yield _out(members, _lists(n_shards, shingle, group, size))
                    members, shingle, group, size, total, seen = [], [], [], [], 0, set()
        if members:
            yield _out(members, _lists(n_shards, shingle, group, size))

    return run


def _lists(n_shards: int, shingle: list[np.ndarray], group: list[int], size: list[int]) -> list[tuple[int, bytes]]:
    if not shingle:
        return []
    lengths = np.array([len(x) for x in shingle])
    s = np.concatenate(shingle)
    g, n = np.repeat(np.array(group, dtype=np.uint64), lengths), np.repeat(np.array(size, dtype=np.uint32), lengths)
    place = (np.arange(len(s)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint32)
    shard = (mix64(s.copy()) % U64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(n_shards + 1))
    out = []
    pack = zstandard.ZstdCompressor(level=1).compress
    for k in range(n_shards):
        at = order[cut[k] : cut[k + 1]]
        if len(at):
            low = pack(g[at].tobytes() + n[at].tobytes() + place[at].tobytes())
            out.append((k, len(at).to_bytes(4, "little") + s[at].tobytes() + low))
    return out


_OUT = "shard int, list binary, doc_id long, digest binary, grp long, n long, sketch binary"


def _out(members: list[tuple], lists: list[tuple[int, bytes]]) -> pa.RecordBatch:
    m, k = len(members), len(lists)
    columns = list(zip(*members, strict=True))
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    # members go to shards by their group
    shards = [r[0] for r in lists] + [None] * m
    arrays = [pa.array(shards, pa.int32()), pa.array([r[1] for r in lists] + [None] * m, pa.binary())]
    arrays += [pa.concat_arrays([pa.nulls(k, t), pa.array(list(c), t)]) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["shard", "list", "doc_id", "digest", "grp", "n", "sketch"])


_LISTED = "shingle long, grp long, n long, place int, least long"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's lists: (shingle, grp, n, place, least) of the groups that may link with another, least the least group of like size."""
    parts = []
    for batch in batches:
        for block in batch.column(1).to_pylist():
            k = int.from_bytes(block[:4], "little")
            low = zstandard.ZstdDecompressor().decompress(block[4 + 8 * k :])
            parts.append((np.frombuffer(block, "<u8", k, 4), np.frombuffer(low, "<u8", k), np.frombuffer(low, "<u4", k, 8 * k), np.frombuffer(low, "<u4", k, 12 * k)))
    if not parts:
        return
    s, g, n, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((g, s))
    s, g, n, place = s[order], g[order], n[order], place[order]
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (g[1:] != g[:-1])])
    s, g, n, place = s[first], g[first], n[first], place[first]
    which = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
    several = np.bincount(which)[which] > 1
    s, g, n, place, which = s[several], g[several], n[several], place[several], which[several]
    # entries that may link with some other of their list
    order = np.lexsort((n, which))
    s, g, n, place, which = s[order], g[order], n[order], place[order], which[order]
    partnered = np.zeros(len(s), dtype=bool)
    for i, j in _partners(which, n, place):
        partnered[i] = True
        partnered[j] = True
    s, g, n, place = s[partnered], g[partnered], n[partnered], place[partnered]
    # sizes within a factor of 1 / LIKE of each other
    kind = np.floor(np.log(n.astype(np.float64)) / np.log(100 / LIKE) + 1e-9).astype(np.int64)
    order = np.lexsort((g, kind, s))
    s, g, n, place, kind = s[order], g[order], n[order], place[order], kind[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (kind[1:] != kind[:-1])])[: len(s)]
    least = g[np.flatnonzero(new)][np.cumsum(new) - 1] if len(s) else g
    yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(least.astype(np.int64))], names=["shingle", "grp", "n", "place", "least"])


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column in tables of ENTRIES_AT_ONCE or more that hold each of its values as a whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= ENTRIES_AT_ONCE:
            s, before = batch.column(0).to_numpy(), held[-1].column(0)[-1].as_py()
            cut = int(np.searchsorted(s, before, "right")) if s[0] == before else 0
            if cut < len(s):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _across(likeliest: bool):
    """Rows (tile, component, set, n, place, sketch), sorted by tile, to pairs (a, b) of sets of different components that pass the filters.

    With `likeliest` only the pair of least difference of each set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_lists(batches):
            pairs, names = _pairs(t, likeliest)
            for lo in range(0, len(pairs), PAIRS_OUT):
                yield _pair_rows(pairs[lo : lo + PAIRS_OUT], names)

    return run


def _partners(which: np.ndarray, n: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of entries of one list, in arrays, that could_link(); entries are by list and size."""
    n = n.astype(np.int64)
    # an entry's partners are those after it, as far as sizes may link
    reach = np.searchsorted(which.astype(np.int64) << 32 | n, which.astype(np.int64) << 32 | n * 100 // LIKE, "right")
    count = reach - np.arange(len(n)) - 1
    total = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS_AT_ONCE, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), count[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], count[lo:hi])
        ok = could_link(n[i], place[i], n[j], place[j])
        yield i[ok], j[ok]
        lo = hi


def _pairs(t: pa.Table, likeliest: bool) -> tuple[np.ndarray, pa.Array]:
    """Pairs of rows of the sets' names, one in the upper and one in the lower 32 bits, and these names."""
    sets = t.column(2).combine_chunks().dictionary_encode()
    names, x = sets.dictionary, sets.indices.to_numpy()
    of = np.zeros(len(names), dtype=np.int64)  # a row of each set
    of[x] = np.arange(len(x))
    size = t.column(3).to_numpy()[of]
    packed = _equal_width(t.column(5).take(pa.array(of)).to_pylist())
    c = t.column(1).combine_chunks().dictionary_encode().indices.to_numpy()
    s, n, place = (t.column(i).to_numpy() for i in (0, 3, 4))
    order = np.lexsort((n, s))
    s, n, place, x, c = s[order], n[order], place[order], x[order], c[order]

    def alike(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = pairs >> 32, pairs & 0xFFFFFFFF
        differ = _differences(packed, u, v)
        ok = (100 + LIKE) * differ <= (100 - LIKE) * (size[u] + size[v])
        return pairs[ok], differ[ok]

    kept, found = [], [np.zeros(0, dtype=np.int64)]
    for i, j in _partners(np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])), n, place):
        ok = (c[i] != c[j]) & (x[i] != x[j])
        u, v = x[i[ok]].astype(np.int64), x[j[ok]].astype(np.int64)
        found.append(np.unique(np.minimum(u, v) << 32 | np.maximum(u, v)))
        if len(found) > 8:
            found = [np.unique(np.concatenate(found))]
            if len(found[0]) > PAIRS_HELD:
                kept.append(alike(found[0])[0])
                found = [found[0][:0]]
    pairs, differ = alike(np.unique(np.concatenate([*kept, *found])))
    if likeliest and len(pairs):
        u, v = pairs >> 32, pairs & 0xFFFFFFFF
        one, other, d = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([differ, differ])
        by = np.lexsort((other, d, one))
        first = by[np.concatenate([[True], one[by][1:] != one[by][:-1]])]
        pairs = np.unique(pairs[first % len(pairs)])
    return pairs, names


def _equal_width(sketches: list[bytes]) -> dict[int, np.ndarray]:
    """For each width of sketches the rows of all of at least that width, folded to it, as 64-bit words; others are 0.  At 0 the widths."""
    out = {}
    for width in {len(x) for x in sketches}:
        raw = b"".join([folded(x, width) if len(x) >= width else bytes(width) for x in sketches])
        out[width] = np.frombuffer(raw, np.uint64).reshape(len(sketches), width // 8)
    out[0] = np.array([len(x) for x in sketches], dtype=np.int64)
    return out


def _differences(packed: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lower bounds of the symmetric differences of sets i and j."""
    width = np.minimum(packed[0][i], packed[0][j])
    out = np.zeros(len(i), dtype=np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        words = packed[w]
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            out[part] = np.bitwise_count(words[i[part]] ^ words[j[part]]).sum(axis=1, dtype=np.int64)
    return out


def _pair_rows(pairs: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    a, b = names.take(pa.array(pairs >> 32)), names.take(pa.array(pairs & 0xFFFFFFFF))
    return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])


def could_link(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles may link whose first common one is at places i and j of their orders.

    All they have in common lies from there on.  In the list of a later common shingle a pair may well fail.
    """
    n, i, m, j = (x.astype(np.int64) for x in (n, i, m, j))
    return (100 * np.minimum(n, m) >= LIKE * np.maximum(n, m)) & ((100 + LIKE) * np.minimum(n - i, m - j) >= LIKE * (n + m))


def _sketch_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, a_doc, b_doc, a_n, b_n, a_sketch, b_sketch) to (a, b, a_doc, b_doc) of those whose sketches allow a link."""
    for batch in batches:
        n, m = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        differ = np.array([least_difference(p, q) for p, q in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)], dtype=np.int64)
        # linked sets differ in (n + m) * (100 - LIKE) / (100 + LIKE) shingles at most
        yield batch.select([0, 1, 2, 3]).filter(pa.array((100 + LIKE) * differ <= (100 - LIKE) * (n + m)))


def _whole_sets(words: np.ndarray | None):
    """Documents (those that the filter may hold) to (digest, shingles), a set once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            if words is not None:
                h = mix64(np.array([-1 if k is None else k for k in batch.column(0).to_pylist()], dtype=np.int64).astype(np.uint64)) % U64(64 * FILTER_WORDS)
                batch = batch.filter(pa.array((words[(h >> U64(6)).astype(np.int64)] >> (h & U64(63)) & U64(1)).astype(bool)))
            for _, _, data, offsets in slabs(batch.column(1)):
                sets = shingle_sets(data, offsets, SHINGLE)
                raw = {xxhash.xxh3_128_digest(x): x for x in map(np.ndarray.tobytes, sets)}
                raw = {k: x for k, x in raw.items() if k not in seen}
                seen.update(raw)
                yield pa.RecordBatch.from_arrays([pa.array(list(raw), pa.binary()), pa.array(list(raw.values()), pa.binary())], names=["digest", "shingles"])

    return run


def _document_filter(ids: DataFrame) -> np.ndarray:
    """Bits of a bounded filter of document ids, made on executors and merged word by word."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(FILTER_WORDS, dtype=np.uint64)
        for batch in batches:
            h = mix64(np.array([-1 if k is None else k for k in batch.column(0).to_pylist()], dtype=np.int64).astype(np.uint64)) % U64(64 * FILTER_WORDS)
            np.bitwise_or.at(words, (h >> U64(6)).astype(np.int64), U64(1) << (h & U64(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(words[at].astype(np.int64))], names=["at", "word"])

    rows = ids.mapInArrow(bits, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    words = np.zeros(FILTER_WORDS, dtype=np.uint64)
    words[rows["at"].to_numpy(dtype=np.int64)] = rows["word"].to_numpy(dtype=np.int64).astype(np.uint64)
    return words


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * common >= LIKE * (len(x) + len(y) - common))
        yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked pairs (a, b) of candidate pairs of sets, in a table; sets has set, doc_id, n, sketch, one row for each set."""
    a = sets.select(F.col("set").alias("a"), F.col("doc_id").alias("a_doc"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"))
    b = sets.select(F.col("set").alias("b"), F.col("doc_id").alias("b_doc"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch"))
    likely = pairs.join(a, "a").join(b, "b").select("a", "b", "a_doc", "b_doc", "a_n", "b_n", "a_sketch", "b_sketch")
    likely = materialize(likely.mapInArrow(lean(_sketch_filter), "a binary, b binary, a_doc long, b_doc long"), "likely", few=True)
    whole = whole_sets(likely.select(F.col("a_doc").alias("doc_id")).unionAll(likely.select("b_doc")).distinct(), docs)
    x, y = whole.select(F.col("digest").alias("x_digest"), F.col("shingles").alias("x")), whole.select(F.col("digest").alias("y_digest"), F.col("shingles").alias("y"))
    pairs = likely.select("a", "b").join(x, digest_of(F.col("a")) == F.col("x_digest")).join(y, digest_of(F.col("b")) == F.col("y_digest"))
    out = materialize(pairs.select("a", "b", "x", "y").mapInArrow(lean(_alike), "a binary, b binary").distinct(), "linked-pairs", few=True)
    for t in (likely, whole):
        drop_table(t)
    return out


def whole_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(digest, shingles) of the documents of the distinct ids `wanted` and of others; a set may come several times."""
    words, wanted = None, materialize(wanted, "wanted", few=True)
    if wanted.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(wanted.select(F.col("doc_id").alias("_id"))), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    else:
        words = _document_filter(wanted)
    whole = materialize(docs.select("doc_id", "text").mapInArrow(lean(_whole_sets(words)), "digest binary, shingles binary"), "whole-sets")
    drop_table(wanted)
    return whole


@F.pandas_udf(T.BinaryType())
def _folded(sketch: pd.Series) -> pd.Series:
    return sketch.map(lambda x: folded(x, LIST_SKETCH))


def _mixed_lists(entries: DataFrame, placed: DataFrame) -> DataFrame:
    """The entries of lists with sets of several components, and how many blocks a list makes."""
    mark = F.xxhash64("component")
    groups = placed.groupBy("grp").agg(F.min(mark).alias("low"), F.max(mark).alias("high"), F.count("*").alias("k"))
    mixed = entries.join(groups, "grp").groupBy("shingle").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("k").alias("k")).where("low <> high")
    return entries.join(mixed.select("shingle", F.ceil(F.col("k") / LIST_SETS).cast("int").alias("blocks")), "shingle")


def _in_tiles(wide: DataFrame) -> DataFrame:
    """Rows of lists under each tile that they are paired in.  A list of one block is a tile, any other has one for every two of its blocks."""
    block = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    wide = wide.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("beside"))
    tile = F.when(F.col("blocks") == 1, F.col("shingle")).otherwise(F.xxhash64("shingle", F.least("block", "beside"), F.greatest("block", "beside")))
    return wide.select(tile.alias("tile"), "component", "set", "n", "place", "sketch")


_SIGN = -(1 << 63)


def node(doc_id: Column, digest: Column) -> Column:
    """A set's node: whether its least doc_id is null, that id, the set's digest; in the order of bytes."""
    number = F.unhex(F.lpad(F.hex(F.coalesce(doc_id, F.lit(0)).cast("long").bitwiseXOR(F.lit(_SIGN).cast("long"))), 16, "0"))
    return F.concat(F.when(doc_id.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), number, digest)


def digest_of(at: Column) -> Column:
    return F.substring(at, 10, 16)


def doc_id_of(at: Column) -> Column:
    number = F.conv(F.hex(F.substring(at, 2, 8)), 16, 10).cast("decimal(20,0)") + F.lit(_SIGN).cast("decimal(20,0)")
    return F.when(F.substring(at, 1, 1) == F.unhex(F.lit("00")), number.cast("long"))


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (doc_id, text): members (doc_id, digest, n...) of every row, sets (set, digest, doc_id, n, copies...; `set` is the node), and the component of every set that links with another."""
    spark = docs.sparkSession
    ship(spark)
    docs, n_shards = docs.select("doc_id", "text"), partitions(spark)
    rows = materialize(docs.mapInArrow(lean(_prefixes(n_shards, shingle_order(docs))), _OUT), "prefixes")
    lists = rows.where(F.col("list").isNotNull()).select("shard", "list").repartitionById(n_shards, "shard")
    listed = materialize(lists.mapInArrow(lean(_gather), _LISTED), "listed")
    members = materialize(rows.where(F.col("list").isNull()).select("doc_id", "digest", "grp", "n", "sketch"), "members")
    drop_table(rows)
    sets = members.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("grp").alias("grp"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    sets = materialize(sets.withColumn("set", node(F.col("doc_id"), F.col("digest"))), "sets", few=True)
    heads = materialize(sets.groupBy("grp").agg(F.min("set").alias("head"), F.count("*").alias("k")), "heads", few=True)
    star = listed.where(F.col("grp") != F.col("least")).select("grp", "least").distinct()
    star = star.join(heads.select("grp", F.col("head").alias("a")), "grp").join(heads.select(F.col("grp").alias("least"), F.col("head").alias("b")), "least").select("a", "b")
    inner = sets.join(heads.where("k > 1"), "grp").where(F.col("set") != F.col("head")).select(F.col("head").alias("a"), F.col("set").alias("b"))
    links = verified(star.unionAll(inner), sets, docs)
    of = materialize(components(links), "components", few=True)
    drop_table(links)
    # the members of a group share its prefix: a list of their own
    own = sets.join(heads.where("k > 1").select("grp"), "grp").select(F.col("grp").alias("shingle"), "grp", "n", F.lit(0).alias("place")).distinct()
    entries = listed.select("shingle", "grp", "n", "place").unionAll(own)
    mixed = None
    for likeliest in (True, False):
        placed = sets.join(of, F.col("set") == F.col("node"), "left").select("set", "grp", F.coalesce("component", "set").alias("component"), "sketch")
        entries = materialize(_mixed_lists(entries.select("shingle", "grp", "n", "place"), placed), "mixed", few=True)
        drop_table(listed if mixed is None else mixed)
        mixed = entries
        wide = entries.join(placed.withColumn("sketch", _folded("sketch")), "grp").select("shingle", "blocks", "component", "set", "n", "place", "sketch")
        pairs = _in_tiles(wide).repartition(n_shards, "tile").sortWithinPartitions("tile").mapInArrow(lean(_across(likeliest)), "a binary, b binary").distinct()
        more = verified(pairs, sets, docs)
        if not more.isEmpty():
            # what is known of components is a star each, and links may go on from there
            before, of = of, materialize(components(of.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)), "components", few=True)
            drop_table(before)
        drop_table(more)
    drop_table(mixed)
    drop_table(heads)
    return members, sets, of


def _common(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the sets `own` has in common with each of `other`."""
    found, column = np.unique(np.concatenate([*own, *other]), return_inverse=True)
    row = np.repeat(np.arange(len(own) + len(other)), [len(x) for x in [*own, *other]])
    several = np.bincount(column, minlength=len(found)) > 1
    column, row = (np.cumsum(several) - 1)[column[several[column]]], row[several[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(own), len(other)), dtype=np.float32)
    for lo in range(0, int(several.sum()), COMPARED_AT_ONCE):
        a, b = np.searchsorted(column, [lo, lo + COMPARED_AT_ONCE])
        has = np.zeros((len(own) + len(other), COMPARED_AT_ONCE), dtype=np.float32)
        has[row[a:b], column[a:b] - lo] = 1
        out += has[: len(own)] @ has[len(own) :].T
    return out.astype(np.int64)


def _tile(listed: bool):
    """A tile (lo, hi, block, set, doc_id, copies, shingles) to (set, n) or, if listed, to linked pairs (doc_id, other)."""

    def run(t: pa.Table) -> pa.Table:
        rows = list({r["set"]: r for r in t.to_pylist()}.values())
        one = rows[0]["lo"] == rows[0]["hi"]
        parts = [rows, rows] if one else [[r for r in rows if r["block"] == r[k]] for k in ("lo", "hi")]
        own, other = ([np.frombuffer(r["shingles"], np.uint64) for r in part] for part in parts)
        links = np.zeros((len(own), len(other)), dtype=bool)
        if own and other:
            common = _common(own, other)
            n, m = (np.array([len(x) for x in part])[:, None] for part in (own, other))
            links = 100 * common >= LIKE * (n + m.T - common)
        if one:
            np.fill_diagonal(links, False)
        if listed:
            i, j = np.nonzero(np.triu(links) if one else links)
            return pa.table({"doc_id": pa.array([parts[0][k]["doc_id"] for k in i], pa.int64()), "other": pa.array([parts[1][k]["doc_id"] for k in j], pa.int64())})
        copies = [np.array([r["copies"] for r in part], dtype=np.int64) for part in parts]
        name, count = [r["set"] for r in parts[0]], (links @ copies[1]).tolist()
        if not one:
            name, count = name + [r["set"] for r in parts[1]], count + (links.T @ copies[0]).tolist()
        return pa.table({"set": pa.array(name, pa.binary()), "n": pa.array(count, pa.int64())})

    return run


def _tiles(docs: DataFrame, sets: DataFrame, of: DataFrame):
    """All pairs of sets of one component, in tiles."""
    linked = sets.join(of, F.col("set") == F.col("node")).select("component", "set", "digest", "doc_id", "n", "copies")
    linked = materialize(linked, "linked", few=True)
    whole = whole_sets(linked.select("doc_id").distinct(), docs)
    blocks = linked.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = linked.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    placed = placed.select("component", "set", "digest", "doc_id", "copies", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("beside"))
    placed = placed.join(whole, "digest").select("component", F.least("block", "beside").alias("lo"), F.greatest("block", "beside").alias("hi"), "block", "set", "doc_id", "copies", "shingles")
    return placed.groupBy("component", "lo", "hi")


def linked_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of docs (doc_id, text); n_links counts the other rows that it links with, copies too."""
    docs = docs.select("doc_id", "text")
    members, sets, of = _classified(docs)
    counts = _tiles(docs, sets, of).applyInArrow(_tile(False), "set binary, n long").groupBy("set").agg(F.sum("n").alias("others"))
    of_sets = sets.join(of, F.col("set") == F.col("node"), "left").join(counts, "set", "left")
    of_sets = of_sets.select(F.col("digest").alias("of"), doc_id_of(F.coalesce("component", "set")).alias("component_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = members.join(of_sets, F.col("digest") == F.col("of"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def linked_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, other) for every two different sets that link, a set by its least doc_id."""
    docs = docs.select("doc_id", "text")
    _, sets, of = _classified(docs)
    return _tiles(docs, sets, of).applyInArrow(_tile(True), "doc_id long, other long")


def class_heads(docs: DataFrame) -> DataFrame:
    """(head) of each class with words: the node of its least doc_id, null last, and of that one's least set."""
    _, sets, of = _classified(docs.select("doc_id", "text"))
    return sets.join(of, F.col("set") == F.col("node"), "left").where(F.coalesce("component", "set") == F.col("set")).select(F.col("set").alias("head"))


def set_digest(text: Column) -> Column:
    """The digest of a text's set, as node() takes it.

    It passes for nondeterministic, else a filter that Spark puts before a join has it computed a second time, by a second Python worker of each task.
    """

    @F.arrow_udf(T.BinaryType())
    def digests(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_128_digest(x.tobytes()) for _, _, data, offsets in slabs(texts) for x in shingle_sets(data, offsets, SHINGLE)], pa.binary())

    return digests.asNondeterministic()(text)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_classes(table(spark, sf_dir, "documents"))


#: The result stated by all shingles and all pairs that share one.
OP2_SQL = f"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS id, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s FROM texts, unnest(generate_series(1, greatest(1, len(w) - {SHINGLE - 1}))) AS g(i) WHERE len(w) > 0
), sizes AS (
  SELECT id, count(*) AS n FROM shingles GROUP BY id
), common AS (
  SELECT x.id AS a, y.id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common c JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * c.n >= {LIKE} * (x.n + y.n - c.n)
), reached AS (
  SELECT id AS a, id AS b FROM sizes UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), components AS (
  SELECT r.a AS id, min(t.doc_id) AS least FROM reached r JOIN texts t ON t.id = r.b GROUP BY r.a
), counts AS (
  SELECT a AS id, count(*) AS n FROM links GROUP BY a
)
SELECT doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(c.n, 0)::BIGINT AS n_links
FROM texts t LEFT JOIN sizes s ON s.id = t.id LEFT JOIN components m ON m.id = t.id LEFT JOIN counts c ON c.id = t.id
"""
