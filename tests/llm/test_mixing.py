from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import documents

from keyloom.llm.mixing import BLOCK, MAX_REPEATS, WEIGHTS, mix, mixed_documents, sainte_lague, targets, word_span


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9)), min_size=1, max_size=7), st.integers(0, 60))
def test_sainte_lague_is_by_highest_quotients(parties, seats):
    weights, caps = [w for w, _ in parties], [c for _, c in parties]
    got = sainte_lague(np.array(weights), seats, np.array(caps)).tolist()
    assert all(0 <= g <= c for g, c in zip(got, caps, strict=True))
    expected = [0] * len(parties)
    for _ in range(seats):
        open_ = [i for i in range(len(parties)) if expected[i] < caps[i] and weights[i]]
        if not open_:
            break
        expected[max(open_, key=lambda i: Fraction(weights[i], 2 * expected[i] + 1))] += 1
    # ties may fall either way: the multiset of quotients that won is the same
    won = lambda s: sorted(Fraction(weights[i], 2 * k + 1) for i in range(len(s)) for k in range(s[i]))
    assert won(got) == won(expected)


def test_targets():
    sizes = np.array([100.0, 10.0, 1000.0, 0.0])
    t = targets(sizes, np.array([5.0, 2.0, 1.0, 5.0]))
    assert abs(t.sum() - sizes.sum()) < 1e-6
    assert (t <= MAX_REPEATS * sizes + 1e-9).all()
    assert t[0] == 300 and t[1] == 30 and t[3] == 0 and abs(t[2] - 780) < 1e-6
    assert targets(np.zeros(2), np.ones(2)).tolist() == [0, 0]


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def rows_of(corpus, odd_texts):
    sources = ["b", "a", "é", None, "Z", "a b", "日"]
    rows = [(d, t, "en", sources[i % 7]) for i, (d, t) in enumerate(corpus)]
    rows += [(5000 + i, t, None, "a") for i, t in enumerate(odd_texts)]
    return rows + [(1, "twice the same", "en", "b")] * 2 + [(1, "but once other", "en", "b"), (None, "no id here", "en", None)]


def test_mix(spark, corpus, odd_texts):
    rows = rows_of(corpus, odd_texts)
    by_source = Counter()
    for _, t, _, s in rows:
        by_source[s] += size(t)
    order = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    t = dict(zip(order, targets(np.array([by_source[s] for s in order]), np.resize(WEIGHTS, len(order))), strict=True))
    got = mix(documents(spark, rows), shard_words=2000).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, size(x)) for d, x, _, s in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == by_source[r.source] and abs(r.target - t[r.source]) < 1e-6
        assert 0 <= r.taken <= MAX_REPEATS * r["size"]
        taken[r.source] += r.taken
    shards = {s: max(1, -(-n // 2000)) for s, n in by_source.items()}
    assert all(abs(taken[s] - t[s]) <= BLOCK * (shards[s] * MAX_REPEATS + 1) for s in by_source)
    again = mix(documents(spark, rows).repartition(7), shard_words=2000).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_mixed_documents(spark, corpus, odd_texts):
    rows = rows_of(corpus, odd_texts)
    docs = documents(spark, rows)
    out = mixed_documents(docs, shard_words=2000)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = out.collect()
    words = Counter()
    for r in got:
        words[r.doc_id, r.source] += size(r.text)
        assert r.n_chars == len(r.text) and r.words == "x"
        assert any(r.text in (t or "") for d, t, _, s in rows if d == r.doc_id and s == r.source)
    expected = Counter()
    for r in mix(docs, shard_words=2000).collect():
        expected[r.doc_id, r.source] += r.taken
    assert +words == +expected


def test_mixed_rows_of_one_id_in_two_sources(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, text, "en", "a"), (1, text, "de", "a"), (1, text, "en", "b"), (1, "other " * 300, "en", "b"), (None, text, "en", None), (2, None, "en", "a")]
    docs = documents(spark, rows)
    words, expected = Counter(), Counter()
    for r in mixed_documents(docs).collect():
        assert (r.doc_id, r.lang, r.source) in {(d, la, s) for d, _, la, s in rows} and r._k0 == r._nth == r.words == "x"
        words[r.doc_id, r.source] += size(r.text)
    for r in mix(docs).collect():
        expected[r.doc_id, r.source] += r.taken
    assert +words == +expected


def test_empty(spark):
    none = documents(spark, [(1, "a")]).where("false")
    assert mix(none).count() == 0 and mixed_documents(none).count() == 0


def test_word_span():
    assert word_span("  one two\nthree  four ", 1, 2) == "two\nthree"
    assert word_span("one", 0, 1) == "one" and word_span("", 0, 3) == ""
