"""Quality rules with adaptive thresholds from mergeable quantile sketches, all in native functions.

Base counts come from the words and lines of the whole text.  Four rates are then judged against thresholds that
follow the data: for each language and source a sketch of each rate is kept, thresholds are read from it, and the
rows are joined with the thresholds of their group.

The sketch is a log-linear histogram of whole numbers: values under 2^SUB_BITS have a bucket each, others share
a bucket with those that agree in the leading SUB_BITS + 1 bits, so a quantile is off by less than 1 part in
2^SUB_BITS.  It is a set of (group, bucket, count) rows: merging is adding counts, so it forms in partial
aggregates, small groups merge with their language's and the whole corpus's sketch, and reruns agree exactly.

For each rate TAILS says which share of rows, in hundredths, is taken for sound.  At that quantile begins the tail; a
sketch's limit lies SPREADS times as far above it as it lies above the median, that distance MIN_SPREAD at least.  The corpus's limit is its
sketch's.  A language's follows its own sketch within the corpus's, a source's within its language's:

* If the median lies above the limit of the level above, such text is what the group is made of, and its own limit
  stands.
* Otherwise it may exceed the upper level's median by twice what the upper limit does: a source that is dirty in part
  can't switch off the rule for itself.
* It counts with the group's rows, the upper level's with PRIOR rows: a group of few rows goes by what is usual.

Cases: null or empty text has no words and fails the base; null lang and source are groups like others; values on a
limit are kept; repeated rows count each; a very long text is judged as a whole, in one task; the judged columns are
picked by name and others, of any name, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import SPACES, let, materialize, table, word_list

MIN_WORDS = 50
MOST_REPEATED = 50
SUB_BITS = 5
PRIOR = 64
#: Rates in thousandths (length_rate: hundredths of a character), and the hundredths of rows that are taken for sound.
TAILS = {"symbol_rate": 90, "line_rate": 98, "repeat_rate": 98, "length_rate": 90}
#: Distances from the median to the tail between the tail and a limit, and the least that counts as one.
SPREADS = 2
MIN_SPREAD = 4

SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of `width` words that occurs twice or more in the array."""

    def starts(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(width)]).alias("h"), i.alias("i")))

        def twice(s: Column) -> Column:
            return F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))

        return F.sort_array(F.transform(let(F.sort_array(windows), twice), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - x, F.lit(width)))), F.lit(0), lambda a, b: a + b)

    return let(words, lambda w: F.when(F.size(w) >= width, let(starts(w), covered)).otherwise(F.lit(0))).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return docs.select(
        "doc_id", "lang", "source",
        let(word_list(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines"))).alias("l"),
    ).select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def rated(counts: DataFrame) -> DataFrame:
    """With base_failed and the rates, whole thousandths (length_rate: hundredths of a character)."""

    def rate(a: str, b: str, scale: int) -> Column:
        return F.when(F.col(b) > 0, F.expr(f"({scale} * {a}) div {b}")).otherwise(F.lit(0)).cast("long")

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counts.withColumns({
        "base_failed": failed, "symbol_rate": rate("n_symbols", "word_chars", 1000), "line_rate": rate("n_dup_lines", "n_lines", 1000),
        "repeat_rate": rate("n_repeat_words", "n_words", 1000), "length_rate": rate("word_chars", "n_words", 100),
    })


def bucket(x: Column) -> Column:
    """The bucket of a whole number from 0 on, by its smallest member."""
    drop = F.greatest(F.lit(0), F.length(F.bin(x)) - (SUB_BITS + 1))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): one mergeable sketch for each language, source and rate."""
    each = F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in TAILS]), F.array(*[F.col(k) for k in TAILS]))).alias("rate", "value")
    return rows.select("lang", "source", each).groupBy("lang", "source", "rate", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def sketch_limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, mid, top, rows) of each merged sketch: its median, its limit, what it counts."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "rate")
    counted = merged.withColumns({"upto": F.sum("n").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "rows": F.sum("n").over(whole)})
    share = F.element_at(F.create_map(*[F.lit(x) for kv in TAILS.items() for x in kv]), F.col("rate"))
    found = counted.groupBy(*keys, "rate").agg(F.min(F.when(2 * F.col("upto") >= F.col("rows"), F.col("bucket"))).alias("mid"), F.min(F.when(100 * F.col("upto") >= share * F.col("rows"), F.col("bucket"))).alias("tail"), F.max("rows").alias("rows"))
    return found.select(*keys, "rate", "mid", (F.col("tail") + SPREADS * F.greatest(F.col("tail") - F.col("mid"), F.lit(MIN_SPREAD))).alias("top"), "rows")


def _within(level: DataFrame, above: DataFrame, keys: list[str], on: Column) -> DataFrame:
    """The limits of a level (l) within those of the level above (u)."""
    bounded = F.when((F.col("l.rows") >= PRIOR) & (F.col("l.mid") > F.col("u.top")), F.col("l.top")).otherwise(F.least(F.col("l.top"), 2 * F.col("u.top") - F.col("u.mid")))
    joined = level.alias("l").join(above.alias("u"), on & (F.col("l.rate") == F.col("u.rate"))).select(*[f"l.{k}" for k in keys], "l.rate", "l.mid", "l.rows", bounded.alias("own"), F.col("u.top").alias("up"))
    return joined.select(*keys, "rate", "mid", "rows", F.expr(f"(rows * own + {PRIOR} * up) div (rows + {PRIOR})").alias("top"))


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, <rate>_limit for each rate) from the sketches of the rows."""
    own = sketches(rows)
    corpus = F.broadcast(sketch_limits(own, []))  # a row for each rate
    by_lang = _within(sketch_limits(own, ["lang"]), corpus, ["lang"], F.lit(True))
    limits = _within(sketch_limits(own, ["lang", "source"]), by_lang, ["lang", "source"], F.col("l.lang").eqNullSafe(F.col("u.lang")))
    return limits.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == k, F.col("top"))).alias(f"{k}_limit") for k in TAILS])


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, base_failed, the group's limits and kept for every row."""
    rows = materialize(rated(base_counts(docs)), "base-counts")
    limits = thresholds(rows.where(~F.col("base_failed")))
    r, t = rows.alias("r"), limits.alias("t")
    joined = r.join(t, F.col("r.lang").eqNullSafe(F.col("t.lang")) & F.col("r.source").eqNullSafe(F.col("t.source")), "left")
    within = F.lit(True)
    for k in TAILS:
        within = within & (F.col(k) <= F.coalesce(F.col(f"{k}_limit"), F.col(k)))
    return joined.select("r.*", *[f"{k}_limit" for k in TAILS], (~F.col("base_failed") & within).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """SQL for DuckDB that states the result of op4_quality_rules."""
    rates = {
        "symbol_rate": "CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END",
        "line_rate": "CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END",
        "repeat_rate": "CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END",
        "length_rate": "CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END",
    }
    values = ", ".join(f"('{k}', {k}, {v})" for k, v in TAILS.items())
    drop = f"greatest(0, length(bin(x)) - {SUB_BITS + 1})"

    def quantile(share: str) -> str:  # the smallest value that so many hundredths of the rows don't exceed, to its bucket
        return f"list_transform([list_sort(list(x))[({share} * count(*) + 99) // 100]], lambda x: (x >> {drop}) << {drop})[1]"

    def level(keys: str) -> str:
        return f"SELECT {keys} rate, mid, tail + {SPREADS} * greatest(tail - mid, {MIN_SPREAD}) AS top, n FROM (SELECT {keys} rate, {quantile('50')} AS mid, {quantile('any_value(share)')} AS tail, count(*) AS n FROM sound GROUP BY {keys} rate)"

    def within(keys: str, on: str) -> str:
        own = f"CASE WHEN l.n >= {PRIOR} AND l.mid > u.top THEN l.top ELSE least(l.top, 2 * u.top - u.mid) END"
        return f"SELECT {keys} l.rate AS rate, l.mid AS mid, (l.n * ({own}) + {PRIOR} * u.top) // (l.n + {PRIOR}) AS top FROM {on}"

    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols
  FROM texts
), windows AS (
  SELECT id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS t FROM words, unnest(generate_series(1, len(w) - 2)) AS s(i)
), twice AS (
  SELECT id, i, lead(i) OVER (PARTITION BY id ORDER BY i) AS following FROM (SELECT id, i, count(*) OVER (PARTITION BY id, t) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT id, sum(least(3, coalesce(following - i, 3))) AS n FROM twice GROUP BY id
), base AS (
  SELECT id, doc_id, lang, source, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM words LEFT JOIN covered USING (id)
), rated AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {", ".join(f"{e} AS {k}" for k, e in rates.items())} FROM base
), sound AS (
  SELECT lang, source, rate, x, share FROM rated, LATERAL (VALUES {values}) AS v(rate, x, share) WHERE NOT base_failed
), of_corpus AS (
  {level("")}
), of_langs AS (
  {level("lang,")}
), of_sources AS (
  {level("lang, source,")}
), langs AS (
  {within("l.lang AS lang,", "of_langs l JOIN of_corpus u ON l.rate = u.rate")}
), limits AS (
  {within("l.lang AS lang, l.source AS source,", "of_sources l JOIN langs u ON l.rate = u.rate AND l.lang IS NOT DISTINCT FROM u.lang")}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (
    SELECT 1 FROM limits l WHERE l.lang IS NOT DISTINCT FROM r.lang AND l.source IS NOT DISTINCT FROM r.source
      AND top < CASE l.rate {" ".join(f"WHEN '{k}' THEN r.{k}" for k in TAILS)} END) AS kept
FROM rated r
"""
