from __future__ import annotations

import hashlib

import pytest
from llm_helpers import documents

from keyloom.llm.fingerprints import Digest, canonical, edited, fingerprint


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode("utf-8", "surrogatepass"))
    rows = sorted(rows, key=key)
    texts = [t or "" for _, t in rows]
    out = []
    for i, (d, _) in enumerate(rows):
        n = len(texts[i]) // 4
        following = texts[(i + 1) % len(texts)]
        e = texts[i][: len(texts[i]) - n] + following[:n]
        out.append((d, len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), float(canonical(e) == canonical(texts[i])), float(canonical(following) == canonical(texts[i]))))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next").collect()), key=repr)


@pytest.mark.parametrize("digits", [32, 2, 1])
def test_against_brute_force(spark, corpus, odd_texts, digits):
    # with few digits nearly all hashes collide, and byte comparison has to tell texts apart
    rows = corpus + [(2000 + i, t) for i, t in enumerate(odd_texts)] + [(7, "tie"), (7, "tie"), (7, None), (None, "no id")]
    got = fingerprint(documents(spark, rows), digits).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=repr) == brute(rows)
    forms = {}
    for r in got:
        for t in {t for d, t in rows if d == r.doc_id and len(t or "") == r.n_chars}:
            forms.setdefault(r.doc_id, set()).add(canonical(t or ""))
    single = {d: next(iter(f)) for d, f in forms.items() if len(f) == 1}
    prints = {r.doc_id: r.fingerprint for r in got if r.doc_id in single}
    for a, fa in prints.items():
        for b, fb in prints.items():
            assert (fa == fb) == (single[a] == single[b])


def test_one_and_no_document(spark):
    assert result(fingerprint(documents(spark, [(1, "abcdefgh")]))) == [(1, 8, hashlib.sha256(b"abcdefab").hexdigest(), 0.0, 1.0)]
    assert result(fingerprint(documents(spark, [(1, "a")]).where("false"))) == []


def test_canonical_form():
    assert canonical("  Straße\u3000ﬁn\tE\u0301 ") == canonical("STRASSE fin É") == "strasse fin é"
    assert canonical("A  B\n") == "a b" and canonical("") == ""
    assert Digest()("A") == Digest()("a") and len(Digest()("x")) == 32
    assert edited("abcdefgh", "XY") == "abcdefXY" and edited("abcdefgh", "X") == "abcdefX" and edited("abc", "X") == "abc"
