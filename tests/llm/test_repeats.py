from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from llm_helpers import documents
from pyspark.sql import functions as F

from keyloom.llm import repeats
from keyloom.llm.kernels import gram_hashes, slabs, sliding_min
from keyloom.llm.repeats import join_ranges, remove_repeats, runs_of
from keyloom.llm.suffix_array import NO_LEFT, SuffixArray, intervals, repeat_groups


def brute(rows, width=50):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, sha256 of what stays)}"""
    texts = [(float("-inf") if d is None else d, d, (t or "").encode()) for d, t in rows]
    earliest = {}
    for key, _, raw in texts:
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            earliest[w] = min(key, earliest.get(w, key))
    out = []
    for key, d, raw in texts:
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for i in range(len(raw) - width + 1):
            if earliest[raw[i : i + width]] < key:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=repr)


def test_against_brute_force(spark, corpus):
    assert result(remove_repeats(documents(spark, corpus).repartition(5))) == brute(corpus)


def test_odd_rows(spark, odd_texts):
    rows = list(enumerate(odd_texts)) + [(3, "q" * 120), (3, "q" * 120), (None, "q" * 60), (None, None), (4, "q" * 49), (50, odd_texts[7])]
    assert result(remove_repeats(documents(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert result(remove_repeats(documents(spark, [(1, "a")]).where("false"))) == []


def test_periodic_and_multibyte(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("é日a") for _ in range(rng.randint(0, 4))) + "éa" * rng.randint(10, 70)) for i in range(30)]
    assert result(remove_repeats(documents(spark, rows))) == brute(rows)


def test_text_result_has_whole_characters(spark):
    shared = "b" * 30 + "日" * 30
    rows = [(1, shared + "é"), (2, "x" + shared + "è")]  # the cut would split the last character
    got = {r.doc_id: r.kept for r in remove_repeats(documents(spark, rows), as_text=True).collect()}
    assert got == {1: shared + "é", 2: "x"}


def test_many_blocks_give_the_same(spark, corpus, monkeypatch):
    import keyloom.llm.repeats as module

    monkeypatch.setattr(module, "BLOCK_BYTES", 500)
    monkeypatch.setattr(module, "SLICE", 64)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in corpus], pa.int64()), pa.array([t for _, t in corpus], pa.string())], names=["doc_id", "text"])
    blocks = {}
    for rows in module._anchors(3, 50)(iter([batch])):
        for s, b in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            blocks.setdefault(s, []).append(b)
    runs = []
    for s, b in blocks.items():
        for rows in module._merge(iter([pa.RecordBatch.from_arrays([pa.array([s] * len(b)), pa.array(b, pa.binary())], names=["shard", "block"])])):
            runs += rows.to_pylist()
    full = {(r["doc"], r["first"]) for r in runs if r["leaf"] is None}
    assert full
    earliest = {}
    for d, t in corpus:
        for i in range(len(t) - 49):
            earliest[t[i : i + 50]] = min(d, earliest.get(t[i : i + 50], d))
    texts = dict(corpus)
    for d, first in full:  # what is decided by equal runs is right
        assert earliest[texts[d][first : first + 50]] < d


@pytest.mark.parametrize("k", [8, 16, 19, 50])
def test_gram_hashes(k):
    data = np.frombuffer(b"abcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcX" * 2, np.uint8)
    h = gram_hashes(data, k)
    grams = [data[i : i + k].tobytes() for i in range(len(data) - k + 1)]
    assert len(h) == len(grams)
    assert len(set(zip(grams, h.tolist(), strict=True))) == len(set(grams)) == len(set(h.tolist()))


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for w in (1, 2, 3, 7, 8, 50, 51):
        assert sliding_min(x, w).tolist() == [int(x[i : i + w].min()) for i in range(50 - w + 1)]


def test_each_window_has_one_run():
    text = ("".join(random.Random(1).choice("ab ") for _ in range(700))).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 30, 330, 379, 700])
    doc, _, _, first, count = runs_of(data, offsets)
    got = sorted((d, f + j) for d, f, c in zip(doc.tolist(), first.tolist(), count.tolist(), strict=True) for j in range(c))
    assert got == [(d, p) for d in range(4) for p in range(offsets[d + 1] - offsets[d] - 49)]


def test_long_documents_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdef ") for _ in range(5000))
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, 5000])
    whole = runs_of(data, offsets)
    monkeypatch.setattr(repeats, "PIECE", 300)
    pieces = runs_of(data, offsets)
    windows = [sorted((f + j, g) for _, g, _, f, c in zip(*(x.tolist() for x in found), strict=True) for j in range(c)) for found in (whole, pieces)]
    assert windows[0] == windows[1] and [p for p, _ in windows[0]] == list(range(4951))
    long = "x" * (1 << 19) + text * 20
    rows = [(1, text[1000:3000]), (2, long), (3, text), (4, long)]
    assert result(remove_repeats(documents(spark, rows))) == brute(rows)


def test_join_ranges():
    assert join_ranges([(5, 9), (0, 3), (3, 4), (8, 12), (20, 21)]) == [(0, 4), (5, 12), (20, 21)]
    assert join_ranges([]) == []


def test_slabs_cover_all_rows():
    import pyarrow as pa

    texts = pa.array(["é" * 10, None, "", "x" * 100, "y"])
    got = [(lo, hi, bytes(d), o.tolist()) for lo, hi, d, o in slabs(texts.slice(1), limit=4)]
    assert b"".join(d for _, _, d, _ in got) == b"x" * 100 + b"y"
    assert [r for lo, hi, _, _ in got for r in range(lo, hi)] == [0, 1, 2, 3]


def all_suffixes(leaves):
    data = np.frombuffer(b"".join(leaves), np.uint8)
    end = np.cumsum([len(x) for x in leaves])
    start = end - [len(x) for x in leaves]
    leaf = np.repeat(np.arange(len(leaves)), end - start)
    at = np.concatenate([np.arange(len(x)) for x in leaves])
    return SuffixArray(data, start, end, leaf, at)


def test_suffix_array_and_maximal_repeats():
    rng = random.Random(11)
    for _ in range(40):
        leaves = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))).encode() for _ in range(rng.randint(1, 5))]
        sa = all_suffixes(leaves)
        suffixes = [leaves[i][p:] for i, p in zip(sa.leaf.tolist(), sa.at.tolist(), strict=True)]
        assert suffixes == sorted(x[p:] for x in leaves for p in range(len(x)))
        common = [0] + [next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y))) for x, y in zip(suffixes, suffixes[1:], strict=False)]
        assert sa.lcp.tolist() == common
        left = np.array([leaves[i][p - 1] if p else NO_LEFT for i, p in zip(sa.leaf.tolist(), sa.at.tolist(), strict=True)])
        for least in (1, 2, 4):
            got = {suffixes[a][:n]: {(sa.leaf[i], sa.at[i]) for i in range(a, b + 1)} for a, b, n in repeat_groups(sa, left, least)}
            # strings that occur twice or more and can't be extended to either side
            expected = {}
            every = {x[i:j] for x in leaves for i in range(len(x)) for j in range(i + least, len(x) + 1)}
            for w in every:
                at = [(i, p) for i, x in enumerate(leaves) for p in range(len(x)) if x.startswith(w, p)]
                after = {leaves[i][p + len(w) : p + len(w) + 1] or (i, p) for i, p in at}
                before = {leaves[i][p - 1 : p] if p else (i, p) for i, p in at}
                if len(at) > 1 and len(after) > 1 and (len(before) > 1):
                    expected[w] = set(at)
            assert got == expected
    assert list(intervals([0, 3, 5, 5, 2, 0, 4], 2)) == [(1, 3, 5), (0, 3, 3), (0, 4, 2), (5, 6, 4)]
