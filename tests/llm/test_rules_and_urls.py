from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest
from llm_helpers import documents
from pyspark.sql import functions as F

from keyloom.llm import url_filter
from keyloom.llm.quality_rules import SUB_BITS, TAILS, base_counts, bucket, judge, rated, repeated_words, sketches, thresholds


def counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_counts(spark, corpus, odd_texts):
    texts = [t for _, t in corpus] + odd_texts + ["a b c a b c", "x x x x", "a\nb\na\n \n \nb", "#*$ %&|<>", "\n", "l l\nl l\nl  l"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in base_counts(documents(spark, rows)).collect()}
    assert got == {d: counts(t) for d, t in rows}


def test_repeated_words_is_linear_in_long_texts(spark):
    one = spark.createDataFrame([(" ".join(["a", "b"] * 40_000),)], "t string").select(repeated_words(F.split("t", " ")).alias("n")).first()
    assert one.n == 80_000


def test_sketch_merges_and_bounds(spark):
    values = [0, 1, 31, 32, 63, 64, 65, 100, 1000, 1023, 12345, 10**12]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select(bucket(F.col("v")).alias("b")).collect()]
    assert all(b <= v < b + max(1, b >> SUB_BITS) + (b == 0) or b == v for v, b in zip(values, got, strict=True))
    docs = documents(spark, [(i, "w" * (1 + i % 9) + " x" * i, "en", f"s{i % 3}") for i in range(300)])
    rows = rated(base_counts(docs))
    parts = sketches(rows.where("doc_id < 100")).unionAll(sketches(rows.where("doc_id >= 100"))).groupBy("lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))
    assert Counter(map(str, parts.collect())) == Counter(map(str, sketches(rows).collect()))


def test_thresholds_adapt_and_keep_the_usual(spark):
    plain = " ".join(f"w{i}" for i in range(80))
    usual = [(i, f"{plain} {i} {i * i} z{i}", "en", "a") for i in range(300)]
    marked = [(1000 + i, " ".join(f"w{j}{'###' if j % 2 else ''}{i}" for j in range(80)), "en", "b") for i in range(300)]  # here signs are usual
    odd = [(5000, " ".join(f"w{j}#####" for j in range(80)), "en", "a"), (5001, "too short", "en", "a"), (5002, "a b c " * 40, "en", "a"), (5003, None, None, None), (5004, plain, None, None)]
    got = {r.doc_id: r for r in judge(documents(spark, usual + marked + odd)).collect()}
    assert len(got) == 605
    assert all(got[d].kept for d, *_ in usual + marked)
    assert not any(got[d].kept for d in (5000, 5001, 5002, 5003)) and got[5004].kept
    assert [got[d].base_failed for d in (5000, 5001, 5002, 5003, 5004)] == [False, True, True, True, False]
    limits = {r.source: r for r in thresholds(rated(base_counts(documents(spark, usual + marked)))).collect()}
    assert limits["b"].symbol_rate_limit > limits["a"].symbol_rate_limit
    assert set(limits["a"].asDict()) == {"lang", "source"} | {f"{k}_limit" for k in TAILS}


def test_rules_empty(spark):
    assert judge(documents(spark, [(1, "a")]).where("false")).count() == 0


URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/1?q", "https://www.example.org/en/1776.html", "http://example.org/en/2", "http://notexample.org/es/", "https://x.com/fr/1", "https://x.com/de/",
    "https://x.com/de", "http://a.b.cheap-pills.example.com/x", "http://cheap-pills.example.com", "http://me:x@ads-track.example.com.:8080?q", "http://x.com/a//./b", "http://ads-track.example.com:/./x", "http://@:80/",  "http://org/", "http://ORG?x", "ftp://.org/", "x://y://z.org/es/", "http://Éxample.org/é/#t", "https://ads-track.example.com/de/9", "http://host/a\nb",
]


def test_url_filter_against_sql(spark, tmp_path):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[4]), (4, URLS[4])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for name in ("host", "path", "rule", "verdict", "block", "entry", "n"):
        pages = pages.withColumn(name, F.lit("x"))
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame(url_filter.LISTED, "host string, path string")
    got = url_filter.judge_urls(pages, rules, listed)
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    columns = sorted(got.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({url_filter.OP9_SQL})").fetchall()
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(expected)
    assert url_filter.judge_urls(pages.where("false"), rules, listed).count() == 0
    none = url_filter.judge_urls(pages, rules.where("false"), listed.where("false")).collect()
    assert {r.verdict for r in none} == {"allow"} and {r.rule for r in none} == {None}


@pytest.mark.parametrize("broadcast", [True, False])
def test_large_list_has_no_false_hits(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", 0)
    listed = spark.range(3000).select(F.concat(F.lit("h"), F.col("id") * 2, F.lit(".net")).alias("host"), F.lit("/p").alias("path"))
    urls = spark.range(6000).select(F.concat(F.lit("www.h"), "id", F.lit(".net")).alias("host"), F.lit("/p/q").alias("path"))
    got = url_filter.match_listed(urls, listed).select("host", "entry.host").toDF("page", "entry").collect()
    assert sorted(r.page for r in got) == sorted(f"www.h{i}.net" for i in range(0, 6000, 2))
    assert all(r.page == "www." + r.entry for r in got)
