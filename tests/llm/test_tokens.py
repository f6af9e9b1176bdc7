from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from llm_helpers import documents
from tokenizers import Tokenizer

from keyloom.llm import tokens
from keyloom.llm.packing import best_fit, cut_pieces, fillings, pack, pack_counts, segments
from keyloom.llm.token_shards import NULL_KEY, PerfectIndex, document_ids, lookup, read_token_shards, write_token_shards
from keyloom.llm.tokens import default_path, encoder, in_lots


PLAIN = Tokenizer.from_file(default_path())


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_memo_gives_the_librarys_ids(monkeypatch, corpus, odd_texts):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "'s", ".", "1", "é", "\x1c", "　", "\x85", "<|endoftext|>", "ß,", "€", "word", "word.", "word\nNext", "word.\nNext,", "Ġ", "Ċ", "日本"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(4000)] + [t or "" for t in odd_texts] + [t for _, t in corpus]
    e = encoder(default_path())
    for most in (tokens.MEMO_CHUNKS, 300):
        monkeypatch.setattr(tokens, "MEMO_CHUNKS", most)
        got = [x for lo, hi in in_lots(texts, 5000) for x in e.many(texts[lo:hi])]
        assert [g.tolist() for g in got] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(in_lots(["a" * 10, "b", "c" * 99, ""], 11)) == [(0, 2), (2, 3), (3, 4)] or list(in_lots([])) == []


def expected_shards(rows):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = ids_of(t)
        out.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_ids", [1, 300, 1 << 20])
def test_shards_round_trip(spark, corpus, odd_texts, shard_ids):
    rows = corpus + [(2000 + i, t) for i, t in enumerate(odd_texts)] + [(5, "wow! yes"), (5, "wow! yes"), (5, "!"), (5, None), (None, "no id"), (6, "a <|endoftext|> b")]
    shards = write_token_shards(documents(spark, rows), default_path(), shard_ids)
    assert sorted(map(tuple, read_token_shards(shards).collect()), key=repr) == expected_shards(rows)
    found = {}
    for s in shards.orderBy("part", "shard").collect():  # keyed access
        s = s.asDict()
        for key in set(np.frombuffer(s["keys"], "<i8", s["n_docs"]).tolist()):
            found.setdefault(key, []).extend(x.tolist() for x in document_ids(s, key))
        assert document_ids(s, 123456789) == []
    wanted = {}
    for d, t in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode())):
        wanted.setdefault(NULL_KEY if d is None else d, []).append(ids_of(t))
    assert found == wanted
    keys = [5, 6, None, 2003, -8, 10**12]
    got = lookup(shards, keys).orderBy("part", "shard", "nth").collect()
    for key in keys:
        assert [r.ids for r in got if r.doc_id == key] == wanted.get(NULL_KEY if key is None else key, [])


def test_added_tokens_are_the_librarys():
    assert ids_of("a <|endoftext|> b")[2] == 50256
    assert encoder(default_path()).many(["a <|endoftext|> b"])[0].tolist() == ids_of("a <|endoftext|> b")[:-1]


def test_exact_packing_is_optimal():
    def fewest(pieces, capacity):
        best = len(pieces)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(pieces):
                best = len(rooms)
                return
            for r in sorted(set(rooms)):
                if r >= pieces[i]:
                    left = list(rooms)
                    left[left.index(r)] -= pieces[i]
                    place(i + 1, left)
            place(i + 1, [*rooms, capacity - pieces[i]])

        place(0, [])
        return best

    rng = random.Random(6)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        pieces = sorted((rng.randint(2, capacity * 2 // 3) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {n: pieces.count(n) for n in pieces}
        got = pack_counts(counts, capacity, nodes=1, exact=True)
        assert sum(k for _, k in got) == fewest(pieces, capacity)
        assert all(sum(p) <= capacity for p, _ in got) and sum(len(p) * k for p, k in got) == len(pieces)


def test_empty_tables(spark):
    none = documents(spark, [(1, "a")]).where("false")
    assert read_token_shards(write_token_shards(none, default_path())).count() == 0
    assert pack(cut_pieces(none, default_path())).count() == 0


def test_perfect_index():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 5000):
        keys = rng.choice(2**60, n, replace=False).astype(np.int64) - 2**59
        rows = np.stack([np.arange(n), np.arange(n) * 3], axis=1)
        index = PerfectIndex.load(PerfectIndex.build(keys, rows).dump())
        slots = index.find(keys)
        assert sorted(slots.tolist()) == list(range(n))  # minimal and perfect
        assert (index.rows[slots] == rows).all()
        strangers = rng.choice(2**60, 2000).astype(np.int64)
        strangers = strangers[~np.isin(strangers, keys)]
        assert (index.find(strangers) >= 0).mean() < 0.01
    with pytest.raises(ValueError):
        PerfectIndex.build(np.array([1, 1]), np.zeros((2, 1)))
    with pytest.raises(ValueError):
        PerfectIndex.load(b"nonsense")


def check_packing(rows, pieces, capacity):
    by_doc = {}
    for d, t in rows:
        by_doc.setdefault(d, []).append(ids_of(t))
    bins, seen = {}, {}
    for p in pieces:
        assert 1 <= p.length <= capacity
        assert any(crc(ids[p.start : p.start + p.length]) == p.ids_crc32 for ids in by_doc[p.doc_id])
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
        seen[p.doc_id] = seen.get(p.doc_id, 0) + p.length
    assert seen == {d: sum(map(len, x)) for d, x in by_doc.items()}
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_pack(spark, corpus, odd_texts):
    rows = corpus + [(2000 + i, t) for i, t in enumerate(odd_texts)] + [(5, "twice"), (5, "twice")]
    for capacity in (64, 2048):
        pieces = pack(cut_pieces(documents(spark, rows), default_path(), capacity), capacity).collect()
        n = check_packing(rows, pieces, capacity)
        total = sum(len(ids_of(t)) for _, t in rows)
        assert n <= -(-total // capacity) + 1
        for p in pieces:  # only longer documents are cut, the first piece may be shorter
            if p.piece:
                assert p.length == capacity


def fewest(lengths, capacity):
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= lengths[i]:
                place(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1 :])
        place(i + 1, rooms + [capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_pack_counts():
    rng = random.Random(8)
    for _ in range(120):
        capacity = rng.choice([10, 17, 30])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {n: lengths.count(n) for n in lengths}
        for packing in (best_fit(counts, capacity), pack_counts(counts, capacity)):
            used = {}
            for pattern, times in packing:
                assert sum(pattern) <= capacity
                for n in pattern:
                    used[n] = used.get(n, 0) + times
            assert used == counts
        assert sum(k for _, k in pack_counts(counts, capacity)) == fewest(lengths, capacity)
    assert pack_counts({}, 5) == []
    with pytest.raises(ValueError):
        pack_counts({6: 1}, 5)
    big = {n: rng.randint(0, 10**9) for n in range(1, 2049)}
    total = sum(n * k for n, k in big.items())
    fewest_bins = max(total / 2048, sum(k for n, k in big.items() if n > 1024))
    assert sum(k for _, k in pack_counts(big)) <= 1.01 * fewest_bins + 1


def test_fillings_are_undominated():
    left = {5: 1, 4: 2, 3: 1, 2: 5}
    for room in range(1, 12):
        for f in fillings(sorted(left, reverse=True), left, room):
            assert sum(f) <= room and all(f.count(n) <= left[n] for n in f)
    assert fillings([5, 4], {5: 1, 4: 1}, 5) == [(5,)]
    assert fillings([], {}, 5) == [()]


def test_segments():
    where = segments([((5, 3, 3), 4), ((3,), 2)])
    assert where[5].tolist() == [[0, 0, 0]]
    assert where[3].tolist() == [[0, 0, 5], [4, 0, 8], [8, 4, 0]]


def test_packing_looks_at_all_the_nodes_it_may(monkeypatch):
    """For these counts the lower bound is not reached and the search goes on to its limit."""
    import random

    from keyloom.llm import packing

    looked, found = 0, packing.fillings

    def counted(*a, **k):
        nonlocal looked
        looked += 1
        return found(*a, **k)

    monkeypatch.setattr(packing, "fillings", counted)
    rng = random.Random(61)
    capacity = rng.choice([100, 150, 200, 300])
    least = rng.choice([capacity // 6, capacity // 5, capacity // 4])
    packing.pack_counts({rng.randrange(least, capacity * 2 // 3): rng.randrange(1, 4) for _ in range(rng.randrange(15, 40))}, capacity)
    assert looked >= 20_000
