"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's target is its share of the whole mix by weight, never over MAX_REPEATS times its size; what is cut off
is shared again among the others.  The mix is dealt in equal blocks of words: Sainte-Lague (a seat goes to the
highest quotient weight / (2 seats + 1)) gives whole numbers of blocks first to sources, then to the shards of a
source.  A shard lays its documents out in seeded order; each of its blocks is taken as often as the quota holds
all of them, and a seeded run of blocks once more.  What a document gives follows from where its words lie, so
nothing is listed block by block and a shard is the largest thing one task orders.

Cases: null text has size 0 and gives 0; a source of size 0 has target 0; null is a source like others and the
last; rows of the same id are told apart by source and text, and equal rows have places of their own, so one of them
may be taken once more than another; equal quotients go to the source or shard that comes first; a text of any length
lies whole in one shard; columns besides keep their values, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import lean, materialize, ship, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Words of a block; a source's take misses its target by about half a block.
BLOCK = 16
#: Words of a shard, about.
SHARD = 1 << 19
SEED = 20240607


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Whole seats by highest quotients weight / (2 seats + 1), none above its cap.

    Rounding weight / divisor is such an apportionment for the seats it happens to give; seats are then given to
    the highest or taken from the lowest quotients until the number is right.
    """
    weights, caps = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64)
    out = np.zeros(len(weights), dtype=np.int64)
    seats = min(int(seats), int(caps.sum()))
    total = weights.sum()
    if not total or not seats:
        return out
    out = np.minimum(np.floor(weights * (seats / total) + 0.5).astype(np.int64), caps)
    over = int(out.sum()) - seats
    if over > 0:
        heap = [(w / (2 * s - 1), -i) for i, (w, s) in enumerate(zip(weights.tolist(), out.tolist(), strict=True)) if s]
        heapq.heapify(heap)
        for _ in range(over):
            i = -heapq.heappop(heap)[1]
            out[i] -= 1
            if out[i]:
                heapq.heappush(heap, (weights[i] / (2 * out[i] - 1), -i))
    elif over < 0:
        heap = [(-w / (2 * s + 1), i) for i, (w, s, c) in enumerate(zip(weights.tolist(), out.tolist(), caps.tolist(), strict=True)) if s < c and w]
        heapq.heapify(heap)
        for _ in range(-over):
            if not heap:
                break
            i = heapq.heappop(heap)[1]
            out[i] += 1
            if out[i] < caps[i]:
                heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MAX_REPEATS) -> np.ndarray:
    """Shares of sum(sizes) by weight; a share over `most` times the size stops there and the rest is shared again."""
    sizes = np.asarray(sizes, dtype=float)
    out, capped, left = np.zeros(len(sizes)), np.zeros(len(sizes), dtype=bool), float(sizes.sum())
    while not capped.all():
        share = np.where(capped, 0.0, weights / weights[~capped].sum() * left)
        above = ~capped & (share > most * sizes)
        if not above.any():
            return np.where(capped, out, share)
        out[above] = most * sizes[above]
        capped |= above
        left = float(sizes.sum() - out.sum())
    return out


def _source_quotas(weights: tuple[float, ...], block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(null=pdf["source"].isna(), key=[x.encode() if isinstance(x, str) else b"" for x in pdf["source"]]).sort_values(["null", "key"])
        w = np.resize(np.array(weights, dtype=float), len(pdf))
        t = targets(pdf["source_size"].to_numpy(), w)
        quota = sainte_lague(t, round(t.sum() / block), MAX_REPEATS * -(-pdf["source_size"].to_numpy() // block))
        return pdf.assign(target=t, quota=quota)[["source", "source_size", "target", "quota"]]

    return run


def _shard_quotas(block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        blocks = -(-pdf["shard_size"].to_numpy() // block)
        return pdf.assign(blocks=blocks, shard_quota=sainte_lague(pdf["shard_size"].to_numpy(), pdf["quota"].iloc[0], MAX_REPEATS * blocks))[["source", "shard", "shard_size", "source_size", "target", "blocks", "shard_quota"]]

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shard_words: int = SHARD, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_key, source_size, target, once_more_from, run, wrapped, repeats, taken for every row of docs (doc_id, source, text).

    `repeats` whole copies of the document are taken, `run` words from word `once_more_from` of its text on, and its
    first `wrapped` words, where the run of blocks wraps round the shard.
    """
    ship(docs.sparkSession)
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    quotas = totals.groupBy(F.lit(0).alias("all")).applyInPandas(_source_quotas(weights, block), "source string, source_size long, target double, quota long")
    quotas = materialize(quotas, "mix-quotas")
    same = F.col("d.source").eqNullSafe(F.col("q.source"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("q.source_size") / shard_words))
    placed = sized.alias("d").join(quotas.alias("q"), same).select("d.*", F.pmod(F.xxhash64("d.doc_id", F.lit(seed)), shards).cast("long").alias("shard"), "q.source_size", "q.target", "q.quota")
    shares = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("quota").alias("quota"))
    shares = shares.groupBy("source").applyInPandas(_shard_quotas(block), "source string, shard long, shard_size long, source_size long, target double, blocks long, shard_quota long")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.select("doc_id", "source", "shard", "size", "text_key").withColumn("end", F.sum("size").over(order)).withColumn("begin", F.col("end") - F.col("size"))
    out = laid.alias("d").join(shares.alias("q"), same & (F.col("d.shard") == F.col("q.shard")))
    whole = F.when(F.col("q.blocks") > 0, F.floor(F.col("q.shard_quota") / F.col("q.blocks"))).otherwise(F.lit(0))
    extra = F.col("q.shard_quota") - whole * F.col("q.blocks")
    first = F.when(F.col("q.blocks") > 0, F.pmod(F.xxhash64("q.source", "q.shard", F.lit(seed + 2)), F.col("q.blocks"))).otherwise(F.lit(0))
    out = out.select("d.doc_id", "d.source", "d.size", "d.text_key", "d.begin", "d.end", "q.source_size", "q.target", "q.shard_size", whole.alias("repeats"), (first * block).alias("from"), ((first + extra) * block).alias("to"), (F.col("q.blocks") * block).alias("round"))

    def overlap(lo, hi):
        return F.greatest(F.lit(0), F.least("end", hi) - F.greatest("begin", lo))

    out = out.withColumn("run", overlap(F.col("from"), F.col("to"))).withColumn("wrapped", overlap(F.lit(0), F.col("to") - F.col("round")))
    return out.select(
        "doc_id", "source", "size", "text_key", "source_size", "target",
        F.when(F.col("run") > 0, F.greatest(F.lit(0), F.col("from") - F.col("begin"))).otherwise(F.lit(0)).cast("long").alias("once_more_from"),
        F.col("run").cast("long").alias("run"), F.col("wrapped").cast("long").alias("wrapped"),
        F.col("repeats").cast("long").alias("repeats"),
        (F.col("repeats") * F.col("size") + F.col("run") + F.col("wrapped")).cast("long").alias("taken"),
    )


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_span(text: str, first: int, n: int) -> str:
    """The text from the start of word `first` to the end of the n-th word from there."""
    at = [m.span() for m in itertools.islice(_WORD.finditer(text), first, first + n)]
    return text[at[0][0] : at[-1][1]] if at else ""


def _deal(columns: int, text: int, n_chars: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            own = batch.column(text).to_pylist()
            dealt = zip(*(batch.column(columns + i).to_pylist() for i in range(4)), strict=True)
            for i, (repeats, begin, n, wrapped) in enumerate(dealt):
                parts = [own[i]] * repeats
                if n:
                    parts.append(word_span(own[i], begin, n))
                if wrapped:
                    parts.append(word_span(own[i], 0, wrapped))
                rows += [i] * len(parts)
                texts += parts
            out = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(columns)]
            out[text] = pa.array(texts, batch.column(text).type)
            if n_chars is not None:
                out[n_chars] = pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(batch.column(n_chars).type)
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names[:columns])

    return run


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of docs as often as they are taken, each part of a document as a row with that part's text (and n_chars)."""
    names = [f"_k{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    taken = mix(docs, **how).where("taken > 0").select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("text_key").alias("_text_key"), "repeats", "once_more_from", "run", "wrapped")
    # rows of one id, source and text are told apart by number, the same on every run
    same = Window.partitionBy("_doc", "_source", "_text_key")
    own = docs.toDF(*names).withColumns({"_doc": F.col(at["doc_id"]), "_source": F.col(at["source"]), "_text_key": F.xxhash64(at["text"])})
    a = own.withColumn("_nth", F.row_number().over(same.orderBy(F.xxhash64(*names)))).alias("a")
    b = taken.withColumn("_nth", F.row_number().over(same.orderBy("repeats", "run", "wrapped", "once_more_from"))).alias("b")
    joined = a.join(b, F.col("a._doc").eqNullSafe(F.col("b._doc")) & F.col("a._source").eqNullSafe(F.col("b._source")) & (F.col("a._text_key") == F.col("b._text_key")) & (F.col("a._nth") == F.col("b._nth")))
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)])
    text, n_chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    dealt = joined.select(*[f"a.{n}" for n in names], "b.repeats", "b.once_more_from", "b.run", "b.wrapped")
    return dealt.mapInArrow(lean(_deal(len(names), text, n_chars)), schema).toDF(*docs.columns)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
