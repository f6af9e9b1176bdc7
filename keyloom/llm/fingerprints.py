"""Document fingerprints by a canonical exact digest.

Canonical form: NFKC, case folding, NFKC again, runs of white space to one space, none at the ends.  Its UTF-8
bytes go to a 128-bit xxhash.  Documents with equal hashes form a bucket; a bucket's canonical texts are merged byte for byte, in each task
before they are shuffled; if two or more are left, all texts of that bucket get the SHA-256 of their canonical bytes
after the hash, so equal fingerprints mean equal canonical bytes, not merely equal hashes.  The likeness of two
exact digests is 1 or 0.

Cases: null text is empty; an empty text has the digest of the empty string; the document after the last is the
first; equal doc_ids are ordered by text, null first, so repeated rows follow one another; a very long text is
digested as a whole, in one task; other columns, whatever their names, are not read; an empty table gives an empty
result.  Bytes are compared for texts of documents; edited texts go by their 128 bits alone.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import materialize, partitions, ship, table


def canonical(text: str) -> str:
    """One form for texts that differ in Unicode composition, case or white space only."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


class Digest:
    """The fingerprint of a text: hex xxhash of the canonical bytes; hashes in `mixed` carry their SHA-256 too.

    `digits` under 32 shortens the hash, for tests of what happens when hashes collide.
    """

    def __init__(self, digits: int = 32, mixed: frozenset[str] = frozenset()):
        self.digits, self.mixed = digits, mixed

    def __call__(self, text: str) -> str:
        form = canonical(text).encode("utf-8", "surrogatepass")
        h = xxhash.xxh3_128_hexdigest(form)[: self.digits]
        return f"{h}-{hashlib.sha256(form).hexdigest()}" if h in self.mixed else h


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_ROW = "at long, nth long, doc_id long, n_chars long, hash string, edited_sha256 string, edited_hash string, edited_text string, next_hash string, first_text string, last_text string"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _digests(digest: Digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nth = TaskContext.get().partitionId(), 0
        first = last = None
        held: list[tuple] = []

        def row(n, doc_id, text, h, following, next_h):
            e = edited(text, following)
            eh = h if e == text else digest(e)
            return (at, n, doc_id, len(text), h, hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), eh, None, next_h, None, None)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                h = digest(text)
                if last is None:
                    first = (doc_id, text, h)
                else:
                    held.append(row(nth - 1, *last, text, h))
                last = (doc_id, text, h)
                nth += 1
            if held:
                yield _batch(held)
                held = []
        if last is not None:
            yield _batch([(at, nth - 1, last[0], len(last[1]), last[2], None, None, None, None, first[1], last[1])])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)


_CHAIN = "doc_id long, n_chars long, hash string, edited_sha256 string, edited_hash string, next_hash string"


def _close(digest: Digest):
    """The last rows of ranges (doc_id, n_chars, hash, text, following), with what comes of the text that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, new = batch.columns[:3], []
            for text, following in zip(batch.column(3), batch.column(4), strict=True):
                text, following = text.as_py(), following.as_py()
                e = edited(text, following)
                new.append((hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), digest(e), digest(following)))
            new = [pa.array([row[k] for row in new], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, *new], names=[x.split()[0] for x in _CHAIN.split(", ")])

    return run


def fingerprint_chain(docs: DataFrame, digest: Digest) -> DataFrame:
    """doc_id, n_chars, hash, edited_sha256, edited_hash, next_hash: hashes only, buckets not yet compared."""
    spark = docs.sparkSession
    ship(spark)
    laid = docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = materialize(laid.mapInArrow(_digests(digest), _ROW), "digests")
    inner = rows.where(F.col("first_text").isNull()).select("doc_id", "n_chars", "hash", "edited_sha256", "edited_hash", "next_hash")
    ends = rows.where(F.col("first_text").isNotNull())
    # the windows hold a number for each range, not its texts
    after = F.coalesce(F.lead("at").over(Window.orderBy("at")), F.min("at").over(Window.partitionBy()))
    following = ends.select(F.col("at").alias("after"), F.col("first_text").alias("following"))
    ends = ends.select("at", "doc_id", "n_chars", "hash", "last_text").join(ends.select("at", after.alias("after")), "at").join(following, "after")
    return inner.unionAll(ends.select("doc_id", "n_chars", "hash", "last_text", "following").mapInArrow(_close(digest), _CHAIN))


#: 64-bit words of the filter that picks the texts of shared buckets before they are shuffled: at most 1 MB.
FILTER_WORDS = 1 << 17


def _bit(h: str) -> int:
    return int(h[-6:], 16) % (64 * FILTER_WORDS)


def _forms(digest: Digest, words: np.ndarray):
    bits = words.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, forms = [], []
            for text in batch.column(0):
                text = text.as_py() or ""
                h = digest(text)
                at = _bit(h)
                if bits[at >> 6] >> (at & 63) & 1:
                    hashes.append(h)
                    forms.append(canonical(text).encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array(forms, pa.binary())], names=["hash", "form"])

    return run


def mixed_buckets(docs: DataFrame, hashes: DataFrame, digest: Digest) -> DataFrame:
    """(hash) of the buckets whose canonical texts are not all the same bytes.

    A filter of at most FILTER_WORDS words picks the texts of buckets of two or more documents in the scan, and some
    others, which change nothing.  Equal texts are merged before the shuffle, which deals by text, so copies are a row a task.
    """
    shared = hashes.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    bit = F.conv(F.substring("hash", -6, 6), 16, 10).cast("long") % (64 * FILTER_WORDS)
    words = np.zeros(FILTER_WORDS, dtype=np.uint64)
    for r in shared.select((bit / 64).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        words[r["w"]] = r["b"] & (1 << 64) - 1
    forms = docs.select("text").mapInArrow(_forms(digest, words), "hash string, form binary").distinct()
    return forms.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")


def _same(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(0.0)


def fingerprint(docs: DataFrame, digits: int = 32) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    digest = Digest(digits)
    chain = materialize(fingerprint_chain(docs, digest), "fingerprints")
    mixed = frozenset(r["hash"] for r in mixed_buckets(docs, chain.select("hash"), digest).toLocalIterator())  # none, but for 128-bit collisions
    if mixed:
        chain = materialize(fingerprint_chain(docs, Digest(digits, mixed)), "fingerprints")
    out = chain.withColumnsRenamed({"hash": "fingerprint", "edited_hash": "edited_fingerprint"})
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        _same(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), _same(F.col("fingerprint"), F.col("next_hash")).alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
