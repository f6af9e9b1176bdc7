from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import documents

from keyloom.llm import quality_classifier, toxicity
from keyloom.llm.kernels import slabs


@pytest.fixture(scope="module")
def labelled():
    """Documents with labels: toxic ones hold an insult, plain or hidden; bad ones are noise."""
    rng = random.Random(21)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    insults = ["idiot", "moron", "loser", "scum"]
    hide = [lambda w: w, lambda w: w.replace("o", "0").replace("i", "1"), lambda w: " ".join(w), lambda w: w[:2] + w[2] * 4 + w[3:], str.upper]
    rows, labels = [], []
    for i in range(900):
        body = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        toxic = rng.random() < 0.25
        bad = not toxic and rng.random() < 0.3
        if toxic:
            for _ in range(2):
                body.insert(rng.randrange(len(body)), rng.choice(hide)(rng.choice(insults)))
        if bad:
            body = [w.upper() + "!!" if i % 2 else w + "$$$" for w in body]
        rows.append((i, " ".join(body), "en", "bad" if bad and rng.random() < 0.5 else "s"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return rows, labels


def held_out(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


def test_toxicity(spark, labelled, odd_texts):
    rows, labels = labelled
    odd = [(2000 + i, t) for i, t in enumerate(odd_texts)] + [(None, "idiot"), (5, rows[5][1])]
    frame = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(documents(spark, rows + odd), frame).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {d: t for d, _, t in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and held_out(r.doc_id))
    tested = [(truth[r.doc_id], r.predicted) for r in got if r.doc_id in truth and r.held_out]
    assert sum(p for t, p in tested if t) >= 0.9 * sum(t for t, _ in tested)
    assert sum(p for t, p in tested if not t) <= 0.03 * len(tested)
    assert all(r.predicted == 0 for r in got if r.doc_id is not None and r.doc_id >= 2000)
    # a score is a function of the text alone
    by_text = {}
    for (d, t, *_), r in zip(sorted(rows + odd, key=str), sorted(got, key=lambda r: str(r.doc_id)), strict=False):
        by_text.setdefault(t, set())
    assert len({r.score for r in got if r.doc_id == 5}) == 1


def test_held_out_labels_are_not_learned(spark, labelled):
    rows, labels = labelled
    flipped = [(d, q, 1 - t if held_out(d) else t) for d, q, t in labels]
    docs = documents(spark, rows[:300])
    schema = "doc_id long, quality int, toxic int"
    a, b = (toxicity.score_toxicity(docs, spark.createDataFrame(x, schema)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels_or_documents(spark, labelled):
    rows, labels = labelled
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score_toxicity(documents(spark, rows[:5]), none).collect()} == {0}
    assert toxicity.score_toxicity(documents(spark, rows).where("false"), none).count() == 0


def test_restoration(spark, labelled):
    rows, _ = labelled
    text = " ".join(r[1].lower() for r in rows) + " idiot moron loser stupid" * 200
    restore = toxicity.Restorer(toxicity.character_model(documents(spark, [(1, text)])))
    for hidden in ("1d10t", "i d i o t", "idiooooot", "m0r0n", "l.o.s.e.r", "ID10T"):
        assert restore(f"the {hidden} here") in {f"the {w} here" for w in ("idiot", "moron", "loser")}, hidden
    for plain in ("", "plain words, here!", "seen $5 and 10 more", "A|B|C", "x" * 5000):
        assert len(restore(plain)) <= len(plain)
    assert restore("plain words, here!") == "plain words, here!"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    model = rng.random((toxicity.SYMBOLS,) * 3) * 5
    decode = toxicity.Restorer(model).decode

    def cost(path):
        a = b = 0
        total = 0.0
        for x in [*path, None]:
            s = toxicity.symbol(x) if x else 0
            total += model[a][b][s]
            a, b = b, s
        return total

    for span in ("1d1ot", "m0r0n", "l33t", "c0d3", "7h1s"):
        paths = [("", 0.0)]
        i = 0
        while i < len(span):
            run = 1
            while i + run < len(span) and span[i + run] == span[i]:
                run += 1
            c = span[i]
            for _ in range(run):
                options = [(x, toxicity.COST_SIGN) for x in toxicity.LOOKALIKES.get(c, "")] + [(c, toxicity.COST_STAY if c in toxicity.LOOKALIKES else 0.0)]
                paths = [(p + x, k + price) for p, k in paths for x, price in options]
            i += run
        best = min(paths, key=lambda x: x[1] + cost(x[0]))
        assert decode(span) == best[0]


def test_suspects_miss_nothing(odd_texts):
    rng = random.Random(6)
    parts = ["a", "B", "é", "日", " ", ".", "-", "_", "0", "1", "$", "!", "\n", "word", "ß", "\t", "5s", "ooo", "x y z w", "м", "ééé"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(6000)] + [t or "" for t in odd_texts]
    same = toxicity.Restorer(np.zeros((toxicity.SYMBOLS,) * 3))
    whole = [bytes(d[a:b]).decode() for _, _, d, o in toxicity.restored(pa.array(texts), same) for a, b in zip(o[:-1], o[1:], strict=True)]
    expected = [same(t) for t in texts]
    assert whole == expected and sum(a != b for a, b in zip(texts, expected, strict=True)) > 500


def test_symbols_and_features_of_bytes():
    text = "Añb Éé ß× idiot\nidiotic loweient"
    data = np.frombuffer(text.encode(), np.uint8)
    got = toxicity.symbols_of(data)
    assert got[got >= 0].tolist() == [toxicity.symbol(c) for c in text.lower()]
    (_, _, d, o), = slabs(pa.array([text]))
    doc, feature = toxicity.features(d, o)
    assert len(set(feature.tolist())) == len(feature) and set(doc.tolist()) == {0}
    one, two = (toxicity.features(*list(slabs(pa.array([w])))[0][2:])[1] for w in ("lowei", "loweient"))
    assert len(set(one.tolist()) & set(two.tolist())) == 2  # the beginnings of four and five letters


def test_quality(spark, labelled, odd_texts):
    rows, labels = labelled
    odd = [(2000 + i, t) for i, t in enumerate(odd_texts)] + [(None, "x"), (5, rows[5][1])]
    frame = spark.createDataFrame(labels + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows + odd)
    got = quality_classifier.score_quality(docs, frame).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = {d: q for d, q, _ in labels}
    tested = [(truth[r.doc_id], r.score >= 0.5) for r in got if r.doc_id in truth and held_out(r.doc_id)]
    assert sum(k for q, k in tested if q) >= 0.98 * sum(q for q, _ in tested)
    assert sum(not k for q, k in tested if not q) >= 0.9 * sum(1 - q for q, _ in tested)
    kept = quality_classifier.score_quality(docs, frame, keep=tuple(docs.columns), at_least=0.5)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert kept.count() == sum(r.score >= 0.5 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.score_quality(docs, none).collect()} == {1.0}
    assert quality_classifier.score_quality(docs.where("false"), frame).count() == 0


def test_views_exchange_labels():
    rng = np.random.default_rng(5)
    n = 400
    y = (rng.random(n) < 0.5).astype(np.float32)
    a = rng.normal(size=(n, 4)).astype(np.float32) + 2 * y[:, None]
    b = rng.normal(size=(n, 3)).astype(np.float32) - 2 * y[:, None]
    labelled_rows = np.arange(n) < 60
    model = quality_classifier.co_train((a[labelled_rows], b[labelled_rows]), y[labelled_rows], np.arange(60) % 4, (a[~labelled_rows], b[~labelled_rows]))
    score, one, two = model.score(a[~labelled_rows], b[~labelled_rows])
    truth = y[~labelled_rows] > 0.5
    assert ((score > 0.5) == truth).mean() > 0.97
    assert ((score > 0.5) == truth).mean() >= max(((one > 0.5) == truth).mean(), ((two > 0.5) == truth).mean()) - 0.01


def test_quality_views_take_confident_rows_from_all_unlabelled(spark, labelled):
    """The most confident rows are found among all unlabelled ones, whichever task holds them."""
    rows, labels = labelled
    frame = spark.createDataFrame(labels[:100] + [(500, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows + [(None, rows[3][1])]).repartition(5)
    stored = quality_classifier.unlabelled_views(docs, frame)
    ids = [d for d, *_ in rows if d >= 100 and not held_out(d)] + [None]
    assert sorted((r.doc_id for r in stored.collect()), key=str) == sorted(ids, key=str)
    held = stored.collect()
    views = quality_classifier.unpacked_views([r.content for r in held], [r.metadata for r in held])
    rng = np.random.default_rng(8)
    weights = [rng.normal(size=x.shape[1] + 1).astype(np.float32) * 30 for x in views]
    for x, w in zip(views, weights, strict=True):
        w[-1] -= np.median(quality_classifier.margin(x, w))
    pool = quality_classifier.StoredPool(stored)
    first = pool.confident(weights, 0.01, [{}, {}])
    for v in (0, 1):
        z = quality_classifier.margin(views[v], weights[v])
        for label, n in quality_classifier.wanted(0.01).items():
            sign = 1 if label else -1
            own = sign * quality_classifier.margin(pool.rows(v, [k for k in first[v] if first[v][k] == label]), weights[v])
            best = np.sort(sign * z)[::-1]
            best = best[best >= np.log(19)][:n]
            assert len(best) and np.allclose(np.sort(own)[::-1], best, atol=1e-3)
    again = pool.confident(weights, 0.01, [first[1], first[0]])
    assert not set(again[0]) & set(first[0]) and not set(again[1]) & set(first[1])
    assert (quality_classifier.MOST_LABELLED, quality_classifier.HASHED) == (12_000, 4096)


def test_restoration_of_all_shapes_of_hiding(spark, labelled):
    rows, _ = labelled
    known = ["idiot", "moron", "loser", "ass", "hell", "foo"]
    text = " ".join(r[1].lower() for r in rows if "$" not in r[1]) + (" " + " ".join(known)) * 300
    restore = toxicity.Restorer(toxicity.character_model(documents(spark, [(1, text)])))
    for hidden, word in (("a$$", "ass"), ("he11", "hell"), ("f00", "foo"), ("i d 1 o t", "idiot"), ("m 0 r 0 n", "moron"), ("1.d.1.0.t", "idiot"), ("a s s", "ass")):
        assert restore(f"the {hidden} here") == f"the {word} here", hidden
        raw = np.frombuffer(f"the {hidden} here".encode(), np.uint8)
        assert len(toxicity.suspects(raw, np.array([0, len(raw)]))[0]), hidden
    spaced = " ".join("idiot" * 40)
    assert len(spaced) > 64 and restore(spaced).split() == restore(spaced).replace(" ", "").replace("idiot", "idiot ").split()
    assert restore("in 1 2 3 and 10 20 30") == "in 1 2 3 and 10 20 30"


def test_toxicity_scores_against_a_plain_path(spark, labelled, odd_texts):
    """Log-odds by counting sets of features, scores by looking each word's features up."""
    rows, labels = labelled
    odd = [(2000 + i, t) for i, t in enumerate(odd_texts)]
    docs, frame = documents(spark, rows + odd), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.character_model(docs)
    evidence = toxicity.learn(docs, frame, model)
    restore = toxicity.Restorer(model)

    def found(text):
        out = set()
        for word in re.findall(rb"[A-Za-z\x80-\xBF\xC3-\xFF]+", restore(text or "").encode()):
            out |= set(toxicity.features(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[1].tolist())
        return out

    texts = {r[0]: r[1] for r in rows + odd}
    learned = [(found(texts[d]), t) for d, _, t in labels if not held_out(d)]
    n, bad = len(learned), sum(t for _, t in learned)
    weight = {}
    for f in set().union(*[x for x, _ in learned]):
        count, toxic = sum(f in x for x, _ in learned), sum(t for x, t in learned if f in x)
        w = math.log((toxic + 0.1) / (bad + 0.2)) - math.log((count - toxic + 0.1) / (n - bad + 0.2))
        if count >= toxicity.LEAST_DOCS and toxic and w > 0:
            weight[f] = w
    got = dict(zip(evidence.feature.tolist(), evidence.weight.tolist(), strict=True))
    assert got.keys() == weight.keys() and all(math.isclose(got[f], weight[f]) for f in weight)
    for r in toxicity.score_toxicity(docs, frame).collect():
        top = sorted((weight[f] for f in found(texts[r.doc_id]) if f in weight), reverse=True)[: toxicity.TOP]
        z = sum(a * b for a, b in zip(top, evidence.scale, strict=False)) + evidence.scale[-1]
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-6, abs_tol=1e-9)


def test_quality_scores_against_a_plain_path(spark, labelled, odd_texts):
    """Each row alone, its views as plain vectors."""
    rows, labels = labelled
    every = rows + [(2000 + i, t, None, None) for i, t in enumerate(odd_texts)]
    docs, frame = documents(spark, every), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_classifier.learn(docs, frame)
    by = {r.doc_id: r for r in quality_classifier.score_quality(docs, frame).collect()}
    assert by.keys() == {r[0] for r in every}

    def logistic(z):
        return 1 / (1 + math.exp(-min(30, max(-30, z))))

    for d, text, lang, source in every[:60] + every[len(rows) :]:
        ((_, _, *views),) = quality_classifier.views(pa.array([text], pa.string()), [lang], [source])
        z = []
        for x, w, (slope, intercept) in zip(views, model.parts, model.scales, strict=True):
            row = np.zeros(x.shape[1])
            np.add.at(row, x.place, x.value)
            row[x.hashed :] = x.dense[0]
            z.append(slope * (sum(a * b for a, b in zip(row.tolist(), w.tolist(), strict=False) if a) + float(w[-1])) + intercept)
        expected = [logistic(z[0] * model.both[0] + z[1] * model.both[1] + model.both[2]), logistic(z[0]), logistic(z[1])]
        assert np.allclose([by[d].score, by[d].content_score, by[d].metadata_score], expected, atol=2e-3), (d, expected)
