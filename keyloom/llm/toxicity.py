"""Toxicity: noisy-channel deobfuscation by Viterbi decoding, then a score of the restored text.

1. A character language model: counts of character triples inside words, over all documents (sums of whole
   numbers, at most SYMBOLS^3 of them).
2. Where a text may hide words, that is where a token has look-alike signs beside letters, runs one letter three
   times or more, or three or more single letters and signs stand in a row, the span becomes a lattice: a sign may stand for itself or
   for letters, a run for one or two of its letters, a gap between single characters for nothing or a space.  The
   most probable path under channel costs and the language model is the restored span.  Other text is its own
   restoration and is not decoded.
3. Features of a text are its distinct restored words and their beginnings of 4 and 5 letters, hashed.  Their
   log-odds come from labelled rows; a logistic function of the strongest ones, fitted on the same rows by
   cross-fitting, is the score.

Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2, at most MOST_LABELLED of them, those
of least crc32 of the id and a seed.  Labels, lang, source and doc_id are no inputs of the score.

Cases: null or empty texts score as texts without evidence; without labels of both kinds all score 0; documents
with equal ids and repeated rows are scored each by its text; of equally probable paths the one found first is taken; a
very long text is scored as a whole, in one task, and its spans of any length are decoded whole; other columns, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import materialize, ship, table
from keyloom.llm.kernels import _BASE, _BYTE, LOWER, U64, mix64, slabs, word_bounds

#: Look-alike signs and the letters that they may stand for.
LOOKALIKES = {"0": "o", "1": "il", "!": "i", "|": "il", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "6": "g", "9": "g", "(": "c", "*": "aeiou"}
#: Costs of the channel, as -log probabilities.
COST_SIGN, COST_STAY, COST_RUN, COST_GAP, COST_BREAK = 1.5, 6.0, 1.0, 0.5, 1.0
#: The language model's alphabet: a-z, other letters of the Latin blocks by code, and the word's edge (0).
SYMBOLS = 64
MOST_LABELLED = 20_000
HELD_OUT = 2
THRESHOLD = 0.3
#: Documents that a feature must be in to count, and the strongest features that the score looks at.
LEAST_DOCS = 5
TOP = 3
#: Steps of the decoder after which what all paths agree in is set down; and the longest span that the memo holds.
SETTLE = 64
LONGEST_HELD = 256
BEGINNINGS = (4, 5)

_SUSPECT = regex.compile(
    r"(?<![^\s])(?:[\p{L}0-9@$!|+(*][ ._-]){2,}[\p{L}0-9@$!|+(*](?![^\s.,!?])"  # single letters and signs in a row
    r"|(?=[^\s]*(?:\p{L}[0-9@$|+(*]|[0-9@$|+(*]\p{L}|\p{L}!+\p{L}|(\p{L})\1\1))[^\s]{3,}"
)
_LETTERS = regex.compile(r"\p{L}")
_SINGLE = regex.compile(r"(?:[\p{L}0-9@$!|+(*][ ._-])+[\p{L}0-9@$!|+(*]?")


def symbol(c: str) -> int:
    """1 to 26 for a-z, 27 to 63 for other letters, 0 for all else."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 37 if c.isalpha() else 0


_BYTE_SYMBOL = np.zeros(256, dtype=np.int64)
_BYTE_SYMBOL[97:123] = np.arange(1, 27)
_BYTE_SYMBOL[65:91] = np.arange(1, 27)


def symbols_of(data: np.ndarray) -> np.ndarray:
    """The symbol at each byte of a slab; -1 at bytes that continue a character."""
    out = _BYTE_SYMBOL[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    lead = lead[lead + 1 < len(data)]
    code = (data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F
    code = np.where((code >= 0xC0) & (code < 0xDF) & (code != 0xD7), code + 0x20, code)  # capitals of Latin-1
    letter = (code >= 0xAA) & (code != 0xD7) & (code != 0xF7) & ((code >= 0xC0) | (code == 0xAA) | (code == 0xB5) | (code == 0xBA))
    out[lead] = np.where(letter, 27 + code % 37, 0)
    out[(data & 0xC0) == 0x80] = -1
    return out


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    for batch in batches:
        for _, _, data, offsets in slabs(batch.column(0)):
            x = symbols_of(data)
            if len(offsets) > 2:  # an edge between documents
                x = np.insert(x, offsets[1:-1], 0)
            x = np.concatenate([[0, 0], x[x >= 0], [0]])
            counts += np.bincount((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["triple", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """-log P(c | a, b) at [a, b, c], from the triples of all documents; smoothed by the pair and the single character."""
    ship(docs.sparkSession)
    rows = docs.select("text").mapInArrow(_triples, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).toPandas()  # at most SYMBOLS^3
    n = np.zeros(SYMBOLS**3)
    n[rows["triple"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = n.sum(axis=(0, 1)) + 0.5
    one /= one.sum()
    two = n.sum(axis=0) + 8 * one
    two /= two.sum(axis=1, keepdims=True)
    three = n + 8 * two[None]
    return -np.log(three / three.sum(axis=2, keepdims=True))


class Restorer:
    """Viterbi decoding of suspect spans; a memo holds spans met before."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.memo: dict[str, str] = {}
        self.stretches: dict[bytes, bytes] = {}

    def __call__(self, text: str) -> str:
        return _SUSPECT.sub(lambda m: self.span(m[0]) if _LETTERS.search(m[0]) else m[0], text)

    def stretch(self, words: bytes) -> bytes:
        """Some words of a text, as UTF-8."""
        out = self.stretches.get(words)
        if out is None:
            if len(self.stretches) > 100_000:
                self.stretches.clear()
            out = self(words.decode()).encode()
            if len(words) < 64:
                self.stretches[words] = out
        return out

    def span(self, span: str) -> str:
        if len(span) > LONGEST_HELD:
            return self.decode(span)
        if span not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[span] = self.decode(span)
        return self.memo[span]

    def stages(self, low: str) -> Iterator[list[tuple[str, float]]]:
        """What each stretch of a span may stand for, and at what cost."""
        single = bool(_SINGLE.fullmatch(low))
        at = 0
        while at < len(low):
            c, run = low[at], 1
            while at + run < len(low) and low[at + run] == c:
                run += 1
            if c in LOOKALIKES:
                if run >= 3:
                    yield [(x, COST_SIGN + COST_RUN) for x in LOOKALIKES[c]] + [(c * run, COST_STAY)]
                else:
                    yield from [[(x, COST_SIGN) for x in LOOKALIKES[c]] + [(c, COST_STAY)]] * run
            elif run >= 3 and symbol(c):
                yield [(c, COST_RUN), (c * 2, COST_RUN)]
            elif single and c in " ._-":
                yield [("", COST_GAP), (" ", COST_BREAK)]
            else:
                yield from [[(c, 0.0)]] * run
            at += run

    def decode(self, span: str) -> str:
        settled: list[str] = []
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for step, choices in enumerate(self.stages(span.lower()), 1):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, path) in best.items():
                for text, price in choices:
                    total, p, q = cost + price, a, b
                    for x in text:
                        s = symbol(x)
                        total += self.model[p][q][s]
                        p, q = q, s
                    old = after.get((p, q))
                    if old is None or total < old[0]:
                        after[(p, q)] = (total, path + text)
            best = after
            if step % SETTLE == 0:
                same = os.path.commonprefix([path for _, path in best.values()])
                settled.append(same)
                best = {k: (cost, path[len(same) :]) for k, (cost, path) in best.items()}
        return "".join(settled) + min((cost + self.model[a][b][0], path) for (a, b), (cost, path) in best.items())[1]


_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[65:91] = True
_LETTER[0xC3:] = True
_LETTER[0x80:0xC0] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature): distinct hashes of the words of letters and of their beginnings, for each document of a slab."""
    data = LOWER[data]
    inside = np.concatenate([[False], _LETTER[data], [False]])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    if not len(start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    doc = np.searchsorted(offsets, start, "right") - 1
    # characters before each byte, to cut beginnings by characters
    with np.errstate(over="ignore"):
        length = end - start
        first = np.cumsum(length) - length
        byte = np.repeat(start, length) + np.arange(int(length.sum())) - np.repeat(first, length)
        own = data[byte]
        place = byte - np.repeat(start, length)
        power = np.cumprod(np.full(int(length.max()), _BASE))
        value = _BYTE[own] * power[place]
        head = (own & 0xC0) != 0x80
        nth = np.cumsum(head)
        nth = nth - np.repeat(nth[first] - head[first], length)  # 1 for the word's first character
        chars = np.maximum.reduceat(nth, first)
        found = [mix64(np.add.reduceat(value, first) + U64(1))]
        owner = [doc]
        for k in BEGINNINGS:
            long = chars >= k
            found.append(mix64(np.add.reduceat(np.where(nth <= k, value, U64(0)), first)[long] + U64(k)))
            owner.append(doc[long])
    d, f = np.concatenate(owner), np.concatenate(found)
    order = np.lexsort((f, d))
    d, f = d[order], f[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (f[1:] != f[:-1])])
    return d[new], f[new]


_SIGN, _GAP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SIGN[list(b"0123456789@$!|+(*")] = True
_GAP[list(b" ._-")] = True


def suspects(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of words of a slab that may hold a suspect span; misses none.

    Looks for a sign beside a letter, three equal letters in a row, or letters or signs and gaps by turns, by characters, and
    takes the words that these lie in, neighbours together.
    """
    none = np.zeros(0, dtype=np.int64)
    x = symbols_of(data)
    head = np.flatnonzero(x >= 0)  # where characters begin
    if len(head) < 3:
        return none, none
    first, beyond = data[head], data[head] >= 0x80
    letter = (x[head] > 0) | beyond  # other scripts may hold letters
    marked = np.zeros(len(head), dtype=bool)
    marked[:-1] = _SIGN[first[:-1]] & letter[1:]
    marked[1:] |= letter[:-1] & _SIGN[first[1:]]
    code = np.where(beyond, (first.astype(np.int64) << 8) | data[np.minimum(head + 1, len(data) - 1)], LOWER[first])
    marked[:-2] |= letter[:-2] & (code[:-2] == code[1:-1]) & (code[1:-1] == code[2:])
    if len(head) > 4:
        gap = _GAP[first]
        single = letter | _SIGN[first]
        turns = single[:-4] & gap[1:-3] & single[2:-2] & gap[3:-1] & single[4:]
        for k in range(5):
            marked[k : len(head) - 4 + k] |= turns
    starts, ends, by = word_bounds(data, offsets)
    word = np.unique(np.searchsorted(starts, head[marked], "right") - 1)
    word = word[word >= 0]
    if not len(word):
        return none, none
    doc = np.searchsorted(by, word, "right")
    apart = (np.diff(word) > 1) | (np.diff(doc) > 0) | (starts[word[1:]] - ends[word[:-1]] != 1)
    return starts[word[np.concatenate([[True], apart])]], ends[word[np.concatenate([apart, [True]])]]


def restored(texts: pa.Array, restore: Restorer) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """slabs() of the restored texts."""
    for lo, hi, data, offsets in slabs(texts):
        raw, parts, at, grown, where = data.tobytes(), [], 0, [], []
        for a, b in zip(*(x.tolist() for x in suspects(data, offsets)), strict=True):
            old = raw[a:b]
            new = restore.stretch(old)
            if new != old:
                parts += [raw[at:a], new]
                at = b
                where.append(b)
                grown.append(len(new) - len(old))
        if parts:
            data = np.frombuffer(b"".join([*parts, raw[at:]]), np.uint8)
            offsets = offsets + np.concatenate([[0], np.cumsum(grown)])[np.searchsorted(where, offsets, "right")]
        yield lo, hi, data, offsets


class Evidence:
    """Log-odds of features, and the logistic function of the strongest ones of a text."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray, scale: np.ndarray):
        order = np.argsort(feature)
        self.feature, self.weight, self.scale = feature[order], weight[order], scale

    def strongest(self, d: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        """(n, TOP): for each of n documents its largest weights, 0 where there are fewer."""
        out = np.zeros((n, TOP))
        if not len(self.feature) or not len(f):
            return out
        at = np.minimum(np.searchsorted(self.feature, f), len(self.feature) - 1)
        known = self.feature[at] == f
        d, w = d[known], self.weight[at[known]]
        order = np.lexsort((-w, d))
        d, w = d[order], w[order]
        rank = np.arange(len(d)) - np.searchsorted(d, d, "left")
        top = (rank < TOP) & (w > 0)
        out[d[top], rank[top]] = w[top]
        return out

    def score(self, strongest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(strongest @ self.scale[:-1] + self.scale[-1], -30, 30)))


def log_odds(feature: np.ndarray, count: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of features in LEAST_DOCS documents or more that speak for toxicity; count and toxic are numbers of documents."""
    weight = np.log((toxic + 0.1) / (n_toxic + 0.2)) - np.log((count - toxic + 0.1) / (n - n_toxic + 0.2))
    keep = (count >= LEAST_DOCS) & (weight > 0)
    return feature[keep], weight[keep]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights and intercept by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + l2 * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


FOLDS = 4


def _feature_counts(model: np.ndarray):
    """Labelled texts (text, toxic, fold) to (feature, fold, n, toxic): numbers of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model)
        for batch in batches:
            toxic, fold = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.int64)
            for lo, hi, data, offsets in restored(batch.column(0), restore):
                d, f = features(data, offsets)
                for k in range(FOLDS):
                    at = fold[lo:hi][d] == k
                    found, which, n = np.unique(f[at], return_inverse=True, return_counts=True)
                    bad = np.bincount(which, weights=toxic[lo:hi][d[at]], minlength=len(found)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(np.full(len(found), k, dtype=np.int32)), pa.array(n.astype(np.int64)), pa.array(bad)], names=["feature", "fold", "n", "toxic"])

    return run


def _strongest_of(model: np.ndarray, parts: list[Evidence]):
    """Labelled texts (text, toxic, fold) to (toxic, strongest weights) by the evidence of the other folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model)
        for batch in batches:
            fold, x = batch.column(2).to_numpy(), np.zeros((batch.num_rows, TOP))
            for lo, hi, data, offsets in restored(batch.column(0), restore):
                d, f = features(data, offsets)
                for k, part in enumerate(parts):
                    at = fold[lo:hi] == k
                    x[lo:hi][at] = part.strongest(d, f, hi - lo)[at]
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(x[:, i].copy()) for i in range(TOP)]], names=["toxic", *[f"x{i}" for i in range(TOP)]])

    return run


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray, most: int = MOST_LABELLED) -> Evidence:
    """Evidence from at most `most` labelled rows that are not held out.  The driver gets counts of features, not texts."""
    ship(docs.sparkSession)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc, F.lit(4)) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.crc32(F.concat_ws(":", F.lit("toxicity"), F.col("doc_id").cast("string")).cast("binary"))
    known = known.orderBy(order, "doc_id").limit(most)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = materialize(sample.select("text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    sizes = {r["fold"]: (r["n"], r["bad"]) for r in sample.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).collect()}
    n, bad = sum(x for x, _ in sizes.values()), sum(x for _, x in sizes.values())
    if not 0 < bad < n:
        return Evidence(np.zeros(0, dtype=np.uint64), np.zeros(0), np.array([0.0] * TOP + [-30.0]))
    counts = sample.mapInArrow(_feature_counts(model), "feature long, fold int, n long, toxic long")
    sums = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS) for c in ("n", "toxic")]
    rows = counts.groupBy("feature").agg(*sums, F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where((F.col("n") >= LEAST_DOCS) & (F.col("toxic") > 0)).orderBy("feature").toPandas()
    rows = {c: rows[c].to_numpy(dtype=np.int64) for c in rows.columns}
    feature = rows["feature"].astype(np.uint64)
    # texts' strongest features by weights that they had no part in
    parts = []
    for k in range(FOLDS):
        own_n, own_bad = sizes.get(k, (0, 0))
        parts.append(Evidence(*log_odds(feature, rows["n"] - rows[f"n{k}"], rows["toxic"] - rows[f"toxic{k}"], n - own_n, bad - own_bad), np.zeros(TOP + 1)))
    held = sample.mapInArrow(_strongest_of(model, parts), ", ".join(["toxic int", *[f"x{i} double" for i in range(TOP)]])).toPandas()
    held = held.sort_values(list(held.columns))  # sums in the fit do not depend on the order of tasks
    scale = fit_logistic(held[[f"x{i}" for i in range(TOP)]].to_numpy(), held["toxic"].to_numpy())
    return Evidence(*log_odds(feature, rows["n"], rows["toxic"], n, bad), scale)


def _scores(model: np.ndarray, evidence: Evidence):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in restored(batch.column(1), restore):
                score[lo:hi] = evidence.score(evidence.strongest(*features(data, offsets), hi - lo))
            crc = [zlib.crc32(str(k).encode()) % 4 == HELD_OUT if k is not None else False for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    model = character_model(docs)
    evidence = learn(docs, labels, model)
    return docs.select("doc_id", "text").mapInArrow(_scores(model, evidence), "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
