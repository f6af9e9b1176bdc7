"""Quality classifier by co-training of two views.

View one is the text's content: its words (hashed), their beginnings and what kinds of characters follow one another.
View two is the page's metadata: lang, source, length, and how the text is laid out (lines, their lengths, repeats,
shares of capitals, digits and signs), without its words.  Each view has a logistic classifier.  In each round both are fitted,
score the pool of unlabelled documents, and each hands its most confident ones, of both classes in the proportion
of the labels, to the other as pseudo-labels.  The pool is all unlabelled rows: executors keep their views in a
table, score it in each round and send the most confident rows alone.  Each view is then calibrated on labelled rows that no fit has
seen, and a logistic function of the two calibrated scores is the score of every document.

Fits are made on the driver from the sparse views of at most MOST_LABELLED labelled rows, those of least crc32 of the
id and a seed, and of the rows handed over, ROUNDS * HAND_OVER a view at most; rows whose crc32(doc_id as text) mod 4
is 2 are not learned from.  All documents are scored.

Cases: null texts are empty and scored by what their metadata says; null lang and source are values like others;
without labels of both kinds all documents score 1 and are kept; equal ids and repeated rows are scored each by its
row; equally confident documents are handed over by their key; a very long text is viewed as a whole, in one task;
columns besides may have any name, the scores' too; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import drop_table, lean, materialize, ship, table
from keyloom.llm.kernels import U64, mix64, slabs, word_bounds, word_hashes

MOST_LABELLED = 12_000
ROUNDS = 3
#: Documents that a view hands over in a round, and the least confidence.
HAND_OVER = 400
CONFIDENT = 0.95
HASHED = 1 << 12
THRESHOLD = 0.5
HELD_OUT = 2

#: Kinds of bytes: white space, lower, upper, digit, stop and comma, other sign, beyond ASCII.
_KIND = np.full(256, 5, dtype=np.int64)
_KIND[[0x20, *range(9, 14)]] = 0
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[44, 46]] = 4
_KIND[128:] = 6
KINDS = 7
META_HASHED = 256
META = 16


def _by_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class Sparse:
    """Rows of hashed columns, of which few are not 0, and then dense ones."""

    __array_ufunc__ = None  # error @ rows comes to __rmatmul__

    def __init__(self, place: np.ndarray, value: np.ndarray, first: np.ndarray, dense: np.ndarray, hashed: int):
        self.place, self.value, self.first, self.dense, self.hashed = place, value, first, dense, hashed
        self.shape = (len(first) - 1, hashed + dense.shape[1])
        self.by_place = None

    def __len__(self) -> int:
        return self.shape[0]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        out = self.dense @ w[self.hashed :]
        some = np.flatnonzero(np.diff(self.first))
        if len(some):
            out[some] += np.add.reduceat(self.value * w[self.place], self.first[some])
        return out

    def __rmatmul__(self, e: np.ndarray) -> np.ndarray:
        if self.by_place is None:
            order = np.argsort(self.place, kind="stable")
            places, first = np.unique(self.place[order], return_index=True)
            self.by_place = places, first, np.repeat(np.arange(len(self)), np.diff(self.first))[order], self.value[order]
        places, first, owner, value = self.by_place
        out = np.zeros(self.hashed, dtype=np.float32)
        if len(places):
            out[places] = np.add.reduceat(value * e[owner], first)
        return np.append(out, e @ self.dense)

    def __getitem__(self, which: np.ndarray) -> Sparse:
        which = np.arange(len(self))[which]
        count = np.diff(self.first)[which]
        first = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.first[which] - first[:-1], count) + np.arange(first[-1])
        return Sparse(self.place[at], self.value[at], first, self.dense[which], self.hashed)

    def squares(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(self.value.astype(np.float64) ** 2)])[self.first]) + (self.dense**2).sum(axis=1)

    def packed(self) -> pa.Array:
        """Each row as bytes: its places, its values, its dense columns, 16 bits each."""
        place, value, dense = self.place.astype(np.uint16), self.value.astype(np.float16), self.dense.astype(np.float16)
        cut = self.first.tolist()
        return pa.array([place[a:b].tobytes() + value[a:b].tobytes() + d.tobytes() for a, b, d in zip(cut, cut[1:], dense, strict=False)], pa.binary())

    @staticmethod
    def unpacked(rows: list[bytes], hashed: int, dense: int) -> Sparse:
        raw = np.frombuffer(b"".join(rows), np.uint16)
        length = np.fromiter(map(len, rows), np.int64, len(rows)) // 2
        start = np.cumsum(length) - length
        count = (length - dense) // 2
        first = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(start - first[:-1], count) + np.arange(first[-1])
        last = raw[(start + 2 * count)[:, None] + np.arange(dense)]
        return Sparse(raw[at].astype(np.int32), raw[at + np.repeat(count, count)].view(np.float16).astype(np.float32), first, last.view(np.float16).astype(np.float32), hashed)


def stacked(a: np.ndarray | Sparse, b: np.ndarray | Sparse) -> np.ndarray | Sparse:
    """The rows of a, then those of b."""
    if isinstance(a, np.ndarray):
        return np.concatenate([a, b])
    first = np.concatenate([a.first, a.first[-1] + b.first[1:]])
    return Sparse(np.concatenate([a.place, b.place]), np.concatenate([a.value, b.value]), first, np.concatenate([a.dense, b.dense]), a.hashed)


def content_view(data: np.ndarray, offsets: np.ndarray) -> Sparse:
    """(documents, HASHED + KINDS^2): log frequencies of hashed words, scaled to length 1, and shares of kind pairs."""
    n = len(offsets) - 1
    out = np.zeros((n, KINDS * KINDS), dtype=np.float32)
    words = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32), np.zeros(n + 1, dtype=np.int64)
    if not len(data):
        return Sparse(*words, out, HASHED)
    starts, ends, first = word_bounds(data, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    if len(starts):
        place = (word_hashes(data, starts, ends) % U64(HASHED)).astype(np.int64)
        key, count = np.unique(doc * HASHED + place, return_counts=True)
        value, owner = np.log1p(count), key // HASHED
        value /= np.sqrt(np.bincount(owner, weights=value**2, minlength=n))[owner]
        words = (key % HASHED).astype(np.int32), value.astype(np.float32), np.searchsorted(owner, np.arange(n + 1))
    kind = _KIND[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    pair = kind[:-1] * KINDS + kind[1:]
    same = owner[:-1] == owner[1:]
    counts = np.bincount(owner[:-1][same] * KINDS * KINDS + pair[same], minlength=n * KINDS * KINDS).reshape(n, KINDS * KINDS)
    out[:] = 4 * np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
    return Sparse(*words, out, HASHED)


def metadata_view(data: np.ndarray, offsets: np.ndarray, lang: list[str | None], source: list[str | None]) -> Sparse:
    """(documents, META_HASHED + META): hashed lang and source, and layout."""
    n = len(offsets) - 1
    out = np.zeros((n, META), dtype=np.float32)
    named = [sorted({zlib.crc32(f"lang={a}".encode()) % META_HASHED, zlib.crc32(f"source={b}".encode()) % META_HASHED}) for a, b in zip(lang, source, strict=True)]
    place = np.array([x for own in named for x in own], dtype=np.int32)
    hashed = place, np.full(len(place), 0.5, dtype=np.float32), np.concatenate([[0], np.cumsum([len(own) for own in named], dtype=np.int64)])
    size = np.maximum(1, np.diff(offsets)).astype(np.float64)
    starts, ends, first = word_bounds(data, offsets)
    words = np.maximum(1, np.diff(first)).astype(np.float64)
    kind = _KIND[data]
    lines = 1 + _by_document(data == 10, offsets)
    out[:, 0] = np.log1p(np.diff(offsets)) / 5
    out[:, 1] = np.log1p(words) / 5
    out[:, 2] = np.log1p(lines) / 3
    out[:, 3] = np.log1p(words / lines) / 3
    for k in range(KINDS):
        out[:, 4 + k] = 2 * np.sqrt(_by_document(kind == k, offsets) / size)
    if len(starts):
        h = word_hashes(data, starts, ends)
        doc = np.repeat(np.arange(n), np.diff(first))
        new = np.unique(mix64(h + doc.astype(np.uint64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
        out[:, 11] = np.bincount(doc[new], minlength=n) / words
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
        out[:, 12] = np.bincount(doc[again], minlength=n) / words
        out[:, 13] = np.bincount(doc, weights=ends - starts, minlength=n) / words / 8
        marked = (_KIND[data[ends - 1]] == 5).astype(np.float64)
        out[:, 14] = np.bincount(doc, weights=marked, minlength=n) / words
        out[:, 15] = np.bincount(doc, weights=(ends - starts == 1) & (_KIND[data[starts]] == 5), minlength=n) / words
    return Sparse(*hashed, out, META_HASHED)


def views(texts: pa.Array, lang: list, source: list) -> Iterator[tuple[int, int, Sparse, Sparse]]:
    """(first, end, content, metadata) for lots of documents."""
    for lo, hi, data, offsets in slabs(texts):
        for a in range(0, hi - lo, 2048):
            b = min(a + 2048, hi - lo)
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            yield lo + a, lo + b, content_view(part, off), metadata_view(part, off, lang[lo + a : lo + b], source[lo + a : lo + b])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray | Sparse, y: np.ndarray, l2: float = 2e-4, steps: int = 250) -> np.ndarray:
    """Logistic weights and intercept by accelerated gradient steps, both classes weighing the same."""
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, dtype=np.float32)
    rate = 4.0 / max(1e-9, float(weight @ ((x.squares() if isinstance(x, Sparse) else np.einsum("ij,ij->i", x, x)) + 1)) + 4 * l2)
    t = 1.0
    for _ in range(steps):
        error = weight * (sigmoid(margin(x, v)) - y)
        g = np.append(error @ x, error.sum()) + l2 * v
        after = (v - rate * g).astype(np.float32)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = after + np.float32((t - 1) / t2) * (after - w)
        w, t = after, t2
    return w


def margin(x: np.ndarray | Sparse, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(slopes..., intercept) of P(y = 1 | margins) by Newton's method, slopes kept from going negative."""
    x = np.column_stack([z, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) / len(y) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + 1e-3 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -3, 3)
    return np.append(np.maximum(w[:-1], 0), w[-1])


class CoTrained:
    def __init__(self, content, metadata, content_scale, metadata_scale, both):
        self.parts = [content, metadata]
        self.scales, self.both = [content_scale, metadata_scale], both

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, content's calibrated score, metadata's)."""
        z = [s[0] * margin(x, w) + s[1] for x, w, s in zip((content, metadata), self.parts, self.scales, strict=True)]
        return sigmoid(np.column_stack(z) @ self.both[:-1] + self.both[-1]), sigmoid(z[0]), sigmoid(z[1])


def wanted(share: float) -> dict[int, int]:
    """How many documents of each label a view hands over in a round."""
    return {1: max(1, round(HAND_OVER * share)), 0: max(1, round(HAND_OVER * (1 - share)))}


class LocalPool:
    """Unlabelled documents whose views are at hand; a document's key is its row."""

    def __init__(self, content, metadata):
        self.views = content, metadata

    def __len__(self) -> int:
        return len(self.views[0])

    def rows(self, v: int, keys: list[int]):
        return self.views[v][np.array(keys, dtype=np.int64)]

    def confident(self, weights: list[np.ndarray], share: float, given: list[dict]) -> list[dict]:
        """For each view what it hands over: labels by key, of documents that the other view has not been given."""
        out: list[dict] = [{}, {}]
        for v in (0, 1):
            p = sigmoid(margin(self.views[v], weights[v]))
            for label, n in wanted(share).items():
                sure, taken = (p if label else 1 - p), 0
                for i in np.argsort(-sure, kind="stable").tolist():
                    if sure[i] < CONFIDENT or taken == n:
                        break
                    if i not in given[1 - v] and i not in out[v]:
                        out[v][i] = float(label)
                        taken += 1
        return out


def _key(doc_id: int | None, content: bytes, metadata: bytes) -> bytes:
    return xxhash.xxh3_128_digest(f"{doc_id}:".encode() + content + metadata)


def _most_confident(weights: list[np.ndarray], share: float, given: list[set[bytes]]):
    """Views (doc_id, content, metadata) to a task's most confident documents (view, label, sure, key, content, metadata)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple]] = {(v, label): [] for v in (0, 1) for label in (1, 0)}
        number = wanted(share)
        least = np.log(CONFIDENT / (1 - CONFIDENT))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, raw = batch.column(0).to_pylist(), [batch.column(i).to_pylist() for i in (1, 2)]
            for v, x in enumerate(unpacked_views(*raw)):
                z = np.round(margin(x, weights[v]).astype(np.float64), 4)
                for label, n in number.items():
                    sure, held = (z if label else -z), {r[1]: r for r in best[v, label]}
                    floor = max(least, best[v, label][-1][0]) if len(held) == n else least
                    most = n + len(given[1 - v])
                    while True:
                        near = max(floor, np.partition(sure, -most)[-most]) if most < len(sure) else floor
                        keys = {_key(ids[i], raw[0][i], raw[1][i]): i for i in np.flatnonzero(sure >= near).tolist()}
                        found = {k: (float(sure[i]), k, raw[0][i], raw[1][i]) for k, i in keys.items() if k not in given[1 - v]}
                        if len(found) >= n or near <= floor:
                            break
                        most *= 2  # repeated rows
                    best[v, label] = sorted((held | found).values(), key=lambda r: (-r[0], r[1]))[:n]
        rows = [(v, label, *r) for (v, label), held in best.items() for r in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()))], names=["view", "label", "sure", "key", "content", "metadata"])

    return run


class StoredPool:
    """All unlabelled documents, their views (doc_id, content, metadata) in a table that executors score."""

    def __init__(self, stored: DataFrame):
        self.stored, self.any = stored, not stored.isEmpty()
        self.held: dict[bytes, tuple[bytes, bytes]] = {}

    def __len__(self) -> int:
        return int(self.any)

    def rows(self, v: int, keys: list[bytes]) -> Sparse:
        return unpacked_views(*zip(*(self.held[k] for k in keys), strict=True) if keys else ([], []))[v]

    def confident(self, weights: list[np.ndarray], share: float, given: list[dict]) -> list[dict]:
        run = _most_confident(weights, share, [set(g) for g in given])
        found = materialize(self.stored.mapInArrow(lean(run), "view int, label int, sure double, key binary, content binary, metadata binary"), "confident")
        out: list[dict] = [{}, {}]
        for v in (0, 1):
            for label, n in wanted(share).items():
                own = found.where((F.col("view") == v) & (F.col("label") == label)).drop("view", "label").distinct()
                for r in own.orderBy(F.desc("sure"), "key").limit(n).toArrow().to_pylist():
                    if r["key"] not in out[v]:
                        out[v][r["key"]] = float(label)
                        self.held[r["key"]] = r["content"], r["metadata"]
        drop_table(found)
        return out


def co_train(labelled: tuple, y: np.ndarray, fold: np.ndarray, pool: tuple | StoredPool, rounds: int = ROUNDS) -> CoTrained:
    """Rows of fold 0 calibrate, the others are fitted; the views exchange confident pseudo-labels from the pool."""
    own = fold != 0
    share = float(y[own].mean())
    pool = LocalPool(*pool) if isinstance(pool, tuple) else pool
    given: list[dict] = [{}, {}]  # pool document -> pseudo-label, for each view
    weights = [None, None]
    for r in range(rounds + 1):
        for v in (0, 1):
            keys = sorted(given[v])
            x = stacked(labelled[v][own], pool.rows(v, keys)) if keys else labelled[v][own]
            weights[v] = fit(x, np.concatenate([y[own], [given[v][k] for k in keys]]).astype(np.float32))
        if r == rounds or not len(pool):
            break
        for v, handed in enumerate(pool.confident(weights, share, given)):
            given[1 - v] |= handed
    z = [margin(labelled[v][~own], weights[v]) for v in (0, 1)]
    held = y[~own]
    scales = [calibrate(x[:, None], held) for x in z]
    both = calibrate(np.column_stack([s[0] * x + s[1] for x, s in zip(z, scales, strict=True)]), held)
    return CoTrained(*weights, *scales, both)


def unpacked_views(content: list[bytes], metadata: list[bytes]) -> tuple[Sparse, Sparse]:
    return Sparse.unpacked(list(content), HASHED, KINDS * KINDS), Sparse.unpacked(list(metadata), META_HASHED, META)


def _views_of(kept: int):
    """(kept columns, text, lang, source) to (kept columns, content, metadata), the views packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, c, m in views(batch.column(kept), batch.column(kept + 1).to_pylist(), batch.column(kept + 2).to_pylist()):
                yield pa.RecordBatch.from_arrays([*[x.slice(lo, hi - lo) for x in batch.columns[:kept]], c.packed(), m.packed()], names=[*batch.schema.names[:kept], "content", "metadata"])

    return run


def unlabelled_views(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, content, metadata of every row of docs that may be learned from and has no label, null ids too."""
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    rows = docs.where(F.coalesce(crc, F.lit(-1)) != HELD_OUT).select("doc_id", "text", "lang", "source")
    return rows.mapInArrow(lean(_views_of(1)), "doc_id long, content binary, metadata binary").join(known, "doc_id", "left_anti")


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> CoTrained | None:
    """The classifier, or None without labels of both kinds.  The driver gets the views of at most `most` documents and of those handed over."""
    ship(docs.sparkSession)
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    order = F.crc32(F.concat_ws(":", F.lit("quality"), F.col("doc_id").cast("string")).cast("binary"))
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc != HELD_OUT)).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    known = known.orderBy(order, "doc_id").limit(most)
    rows = docs.select("doc_id", F.struct("text", "lang", "source").alias("x")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("quality").alias("quality"))
    rows = rows.select("doc_id", "quality", "x.text", "x.lang", "x.source").mapInArrow(lean(_views_of(2)), "doc_id long, quality int, content binary, metadata binary").toArrow().sort_by("doc_id")
    y = (rows.column(1).to_numpy() > 0).astype(np.float32)
    if not len(y) or y.min() == y.max():
        return None
    own = unpacked_views(rows.column(2).to_pylist(), rows.column(3).to_pylist())
    known_ids = rows.column(0).to_pylist()
    del rows
    fold = np.array([zlib.crc32(f"fold:{k}".encode()) % 4 for k in known_ids])
    if len(set(y[fold != 0].tolist())) < 2 or len(set(y[fold == 0].tolist())) < 2:
        fold = np.arange(len(y)) % 4
    if len(set(y[fold != 0].tolist())) < 2 or len(set(y[fold == 0].tolist())) < 2:
        return None
    stored = materialize(unlabelled_views(docs, labels), "views")
    model = co_train(own, y, fold, StoredPool(stored))
    drop_table(stored)
    return model


_SCORES = ("score", "content_score", "metadata_score")


def _score(model: CoTrained | None):
    """A column function of (text, lang, source): the scores.  The other columns of a row stay in the JVM."""

    @F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in _SCORES]))
    def run(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, lang, source in parts:
            out = np.ones((3, len(text)))
            if model is not None:
                for lo, hi, c, m in views(text, lang.to_pylist(), source.to_pylist()):
                    out[:, lo:hi] = model.score(c, m)
            yield pa.StructArray.from_arrays([pa.array(x) for x in out], names=list(_SCORES))

    return run


def score_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), at_least: float | None = None) -> DataFrame:
    """The columns `keep` of every row of docs, then score (near 1: good), content_score and metadata_score.

    With `at_least` only rows of that score or more, without the scores: then `keep` may have columns of these names.
    """
    ship(docs.sparkSession)
    model = learn(docs, labels)
    read = [*keep, *[c for c in ("text", "lang", "source") if c not in keep]]
    own = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(read)])
    own = own.withColumn("_scores", _score(model)(*[F.col(f"_k{read.index(c)}") for c in ("text", "lang", "source")]))
    names = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    if at_least is not None:
        return own.where(F.col("_scores.score") >= at_least).select(*names)
    return own.select(*names, *[F.col(f"_scores.{c}").alias(c) for c in _SCORES])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("kept", F.col("score") >= THRESHOLD)
