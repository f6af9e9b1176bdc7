from __future__ import annotations

import random

import corpus_pipeline
import pytest
from llm_helpers import documents
from test_jaccard import brute as classes
from test_repeats import brute as repeats

from keyloom.llm import registry

NAMES = [f"op{n}_" for n in range(1, 11)]


def test_registered():
    queries = registry.queries()
    assert [sum(q.startswith(n) for q in queries) for n in NAMES] == [1] * 10
    assert set(registry.oracle_sql()) <= set(queries)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "suffix_dedup", "mix_sources", "pack"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, corpus, odd_texts):
    rng = random.Random(4)
    rows = [(d, t, "en", "ab"[d % 2]) for d, t in corpus] + [(3000 + i, t, None, None) for i, t in enumerate(odd_texts)]
    rows += [(4000 + i, " ".join(rng.choice("abc") + "$$$" for _ in range(60)), "en", "a") for i in range(60)]
    path = str(tmp_path_factory.mktemp("tables"))
    documents(spark, rows, extra=False).write.parquet(f"{path}/documents.parquet")
    labels = [(d, 1, 0) for d, *_ in rows[:100]] + [(4000 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    good = corpus_pipeline.materialize(stage["quality_classifier"](spark, docs, folder), "a")
    assert good.columns == columns and not good.where("doc_id between 4000 and 4999").count()
    assert good.where("doc_id < 3000").count() >= 115

    single = corpus_pipeline.materialize(stage["jaccard_join"](spark, good, folder), "b")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, _, c in classes(rows) if d == c)

    cut = corpus_pipeline.materialize(stage["suffix_dedup"](spark, single, folder), "c")
    rows = [(r.doc_id, r.text) for r in single.collect()]
    left = {d: n - gone for d, n, gone, *_ in repeats(rows)}
    assert cut.columns == columns
    assert {r.doc_id: len(r.text.encode()) for r in cut.collect() if r.doc_id < 3000} == {d: n for d, n in left.items() if d < 3000}
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    mixed = corpus_pipeline.materialize(stage["mix_sources"](spark, cut, folder), "d")
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in cut.collect()}

    packed = stage["pack"](spark, mixed, folder)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_stages_on_nothing_and_on_repeated_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
    few = docs.where("doc_id > 900 and doc_id < 1100")
    twice = few.unionAll(few)
    kept = corpus_pipeline.keep_one_of_each_class(spark, twice, folder)
    assert kept.count() == kept.select("doc_id").distinct().count() == corpus_pipeline.keep_one_of_each_class(spark, few, folder).count()
    extra = documents(spark, [(r.doc_id, r.text) for r in few.collect()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, folder).columns == extra.columns, name


def test_join_stage_keeps_rows_that_link_with_nothing(spark, folder):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(40)) for c in "wxyz")
    rows = [(None, one), (None, two), (None, two), (5, three), (5, four[:-4]), (3, four), (None, None), (None, " ")]
    got = corpus_pipeline.keep_one_of_each_class(spark, documents(spark, rows), folder)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(None, one), (None, two), (5, three), (3, four), (None, None), (None, " ")], key=repr)


def test_join_stage_computes_a_digest_once(spark, folder):
    """A second evaluation in the same task is a second Python worker on every core of an executor, kept for the stages that follow."""
    kept = corpus_pipeline.keep_one_of_each_class(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
