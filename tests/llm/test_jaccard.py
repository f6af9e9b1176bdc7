from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from llm_helpers import documents

from keyloom.llm import components as components_module
from keyloom.llm import jaccard_join
from keyloom.llm.common import materialize
from keyloom.llm.components import components
from keyloom.llm.jaccard_join import could_link, least_difference, linked_classes, parity_sketch, prefix_size

FOLD = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(FOLD)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    of = list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                of[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_against_brute_force(spark, corpus):
    assert result(linked_classes(documents(spark, corpus).repartition(4))) == brute(corpus)


def test_odd_rows(spark, odd_texts):
    rows = list(enumerate(odd_texts)) + [(3, "one two three four five six"), (3, "one two three four five six"), (90, "ONE two\tthree four five six"), (None, "one two"), (None, None)]
    assert result(linked_classes(documents(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert result(linked_classes(documents(spark, [(1, "a")]).where("false"))) == []


def chain(n, words=100, step=3):
    """Texts of which neighbours are alike but far ones are not."""
    rng = random.Random(2)
    own = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        out.append((500 - i, " ".join(own)))
        for _ in range(step):
            own[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
    return out


def test_chains_and_large_groups_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"b{rng.randrange(10**6)}" for _ in range(80)]
    near = []
    for i in range(150):
        own = list(base)
        own[rng.randrange(80)] = f"n{i}"
        if i % 3 == 0:
            own[rng.randrange(80)] = f"m{i}"
        near.append((10_000 + i, " ".join(own)))
    common = " ".join(f"c{i}" for i in range(25))  # a passage that many texts share, no link
    shared = [(20_000 + i, common + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))) for i in range(60)]
    rows = chain(40) + near + shared
    assert result(linked_classes(documents(spark, rows))) == brute(rows)


def test_long_lists_in_tiles(spark, corpus, monkeypatch):
    import keyloom.llm.jaccard_join as module

    rng = random.Random(3)
    common = " ".join(f"c{i}" for i in range(40))
    shared = [(20_000 + i, common + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(8 + i % 9))) for i in range(70)]
    rows = corpus + chain(60) + shared
    monkeypatch.setattr(module, "LIST_SETS", 4)
    # shingles by hash alone: lists of common ones too
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    monkeypatch.setattr(module, "shingle_order", lambda docs: module.Order(*none, *none))
    assert result(linked_classes(documents(spark, rows).repartition(3))) == brute(rows)


def test_pairs_held_in_parts(monkeypatch):
    import keyloom.llm.jaccard_join as module

    rng = np.random.default_rng(6)
    base = rng.choice(2**60, 60, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 60 - k % 12], rng.choice(2**60, k % 12, replace=False).astype(np.uint64)])) for k in range(90)]
    names = pa.array([bytes([k]) for k in range(90)], pa.binary())
    sizes, marks = [len(x) for x in sets], [module.folded(parity_sketch(x), module.LIST_SKETCH) for x in sets]
    t = pa.table({"tile": pa.array([0] * 90, pa.int64()), "component": names, "set": names, "n": pa.array(sizes, pa.int64()), "place": pa.array([0] * 90, pa.int32()), "sketch": pa.array(marks, pa.binary())})
    found = []
    for at_once, held in ((1 << 18, 1 << 21), (50, 60)):
        monkeypatch.setattr(module, "PAIRS_AT_ONCE", at_once)
        monkeypatch.setattr(module, "PAIRS_HELD", held)
        found.append([module._pairs(t, likeliest)[0].tolist() for likeliest in (True, False)])
    assert found[0] == found[1]
    assert len(found[0][1]) > len(found[0][0]) > 0


def test_many_documents_to_verify(spark, corpus, odd_texts, monkeypatch):
    import keyloom.llm.jaccard_join as module

    monkeypatch.setattr(module, "BROADCAST_IDS", 0)
    rows = corpus + [(None, corpus[0][1]), (None, odd_texts[4])]
    assert result(linked_classes(documents(spark, rows))) == brute(rows)


def test_order_of_shingles_does_not_matter(spark, corpus, monkeypatch):
    import keyloom.llm.jaccard_join as module

    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    monkeypatch.setattr(module, "shingle_order", lambda docs: module.Order(*none, *none))
    assert result(linked_classes(documents(spark, corpus))) == brute(corpus)


def test_bounds():
    rng = np.random.default_rng(4)
    for _ in range(300):
        universe = rng.choice(2**40, 400, replace=False).astype(np.uint64)
        a = np.sort(rng.choice(universe, rng.integers(1, 300), replace=False))
        b = np.sort(np.unique(np.concatenate([rng.choice(a, rng.integers(0, len(a) + 1), replace=False), rng.choice(universe, rng.integers(1, 60), replace=False)])))
        common = np.intersect1d(a, b)
        assert least_difference(parity_sketch(a), parity_sketch(b)) <= len(a) + len(b) - 2 * len(common)
        if 100 * len(common) >= 75 * (len(a) + len(b) - len(common)):
            p, q = a[: prefix_size(len(a))], b[: prefix_size(len(b))]
            both = np.intersect1d(p, q)
            assert len(both)
            assert could_link(np.array([len(a)]), np.searchsorted(a, both[:1]), np.array([len(b)]), np.searchsorted(b, both[:1]))[0]
    assert [prefix_size(n) for n in (0, 1, 2, 4, 100)] == [0, 1, 1, 2, 26]


def test_components(spark):
    rng = random.Random(1)
    nodes = list(range(200))
    links = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 460)]
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            of[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in of}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_link_is_counted_and_listed(spark, corpus, monkeypatch):
    import keyloom.llm.jaccard_join as module

    monkeypatch.setattr(module, "BLOCK_SETS", 3)
    monkeypatch.setattr(module, "COMPARED_AT_ONCE", 7)
    rows = corpus + chain(12) + [(None, corpus[0][1]), (9000, ""), (9001, None)]
    sets = [frozenset(shingles(t)) for _, t in rows]

    def link(a, b):
        return bool(a) and 100 * len(a & b) >= 75 * len(a | b)

    expected = [(d, sum(link(a, b) for b in sets) - bool(a)) for (d, _), a in zip(rows, sets, strict=True)]
    docs = documents(spark, rows)
    assert sorted(map(tuple, linked_classes(docs).select("doc_id", "n_links").collect()), key=repr) == sorted(expected, key=repr)
    least = {}
    for (d, _), a in zip(rows, sets, strict=True):
        if d is not None:
            least[a] = min(d, least.get(a, d))
    pairs = {frozenset((least[a], least[b])) for a in least for b in least if a != b and link(a, b)}
    got = [frozenset(r) for r in module.linked_pairs(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


def test_small_tables_are_written_in_few_files(spark, corpus, monkeypatch):
    """However many partitions a session has; every file costs processes that count in an executor's memory."""
    files = {}

    def counted(df, label, *args, **how):
        out = materialize(df, label, *args, **how)
        files[label] = max(files.get(label, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    monkeypatch.setattr(components_module, "materialize", counted)
    many = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    docs = documents(spark, corpus)
    want = sorted(map(tuple, linked_classes(docs).collect()))
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        files.clear()
        got = sorted(map(tuple, linked_classes(docs).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
    small = {"frequent", "sets", "heads", "likely", "wanted", "linked-pairs", "links", "small-star", "components", "mixed", "linked"}
    assert small <= set(files) and max(files[k] for k in small) <= 2 * spark.sparkContext.defaultParallelism, files
