"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a host and a path.  It fits a page whose host is that host or a subdomain of it and whose path
starts with that path; the longest entry wins (host and path characters; on a tie the longer host, then block).
For a page the candidates are its host's label suffixes times the path lengths that occur in the list; each is
probed in one 256-bit block of the filter, and only possible hits reach the exact join, which removes the false
positives.

Rules are held against host and path as the url has them.  The list is held against the canonical URL: the host without
user, port and closing dots, the path with `/` for nothing and single slashes for runs of `/` and `/./`; a list, a
table of any size, must hold canonical entries.

Cases: a null url or one without `://` has empty host and path and fits nothing; an empty list allows all; an empty
table of pages gives an empty result; a very long url is judged as a whole; repeated pages keep their rows; other
columns of the pages, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import partitions, table

#: Bits set for each key, all within one block of four 64-bit words.
PROBES = 6
KEYS_PER_BLOCK = 16
#: Blocks are sent to all executors up to this many (32 bytes each); a larger filter is joined by block.
BROADCAST_BLOCKS = 1 << 18

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: What the method itself lists, besides the rules: hosts of advertising and spam.
LISTED = [("cheap-pills.example.com", "/"), ("ads-track.example.com", "/")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without `://`."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")
    return host, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"/(\.?/)+", "/"))


def _block(host: Column, path: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(n_blocks))


def _bits(host: Column, path: Column) -> list[Column]:
    """Four words with the key's bits set."""
    h = F.xxhash64(F.lit(7919), path, host)
    at = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(PROBES)]
    one = F.lit(1).cast("long")
    words = []
    for w in range(4):
        word = F.lit(0).cast("long")
        for a in at:
            word = word.bitwiseOR(F.when(F.shiftright(a, 6) == w, F.call_function("shiftleft", one, a.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return words


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w3): the filter's blocks that have any bit."""
    keyed = listed.select(_block(F.col("host"), F.col("path"), n_blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("host"), F.col("path")))])
    return keyed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def match_listed(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """For distinct (host, path) rows the longest fitting entry: (host, path, entry), entry a struct of all the entry's columns."""
    stats = listed.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    n_blocks = max(1, -(-stats["n"] // KEYS_PER_BLOCK))
    blocks = bloom_blocks(listed, n_blocks)
    if n_blocks <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = (
        urls.select("host", "path", F.explode(suffixes).alias("p_host"))
        .select("*", F.explode(F.array(*[F.lit(x) for x in stats["lengths"]]) if stats["lengths"] else F.array().cast("array<int>")).alias("p_len"))
        .where(F.length("path") >= F.col("p_len"))
        .select("host", "path", "p_host", F.substring(F.col("path"), F.lit(1), F.col("p_len")).alias("p_path"))
        .withColumn("block", _block(F.col("p_host"), F.col("p_path"), n_blocks))
    )
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col("p_host"), F.col("p_path"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) == b)
    possible = probes.join(blocks, "block").where(hit).select("host", "path", "p_host", "p_path")
    entry = listed.select(F.col("host").alias("p_host"), F.col("path").alias("p_path"), F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), *[F.col(c) for c in listed.columns if c not in ("n", "h")]).alias("entry"))
    return possible.join(entry, ["p_host", "p_path"]).groupBy("host", "path").agg(F.max("entry").alias("entry"))


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, listed.  `rules` has host, path, verdict; `listed` has host, path and blocks what no rule fits."""
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    entries = rules.select("host", "path", "verdict", F.lit(True).alias("is_rule")).unionByName(listed.select("host", "path", F.lit("block").alias("verdict"), F.lit(False).alias("is_rule")))
    entries = entries.groupBy("host", "path").agg(F.max(F.struct("is_rule", "verdict")).alias("x")).select("host", "path", "x.*")
    judged = judged.withColumns(dict(zip(("c_host", "c_path"), canonical(F.col("host"), F.col("path")), strict=True)))
    n = partitions(pages.sparkSession)  # probing is work: few bytes, but many probes

    def distinct(host: str, path: str) -> DataFrame:
        return judged.select(F.col(host).alias("host"), F.col(path).alias("path")).where("host <> ''").repartition(n, "host", "path").distinct()

    best = match_listed(distinct("host", "path"), entries.where("is_rule")).select("host", "path", F.concat("entry.host", "entry.path").alias("rule"), F.col("entry.verdict").alias("by_rule"))
    more = match_listed(distinct("c_host", "c_path"), entries.where("not is_rule")).select(F.col("host").alias("c_host"), F.col("path").alias("c_path"), F.concat("entry.host", "entry.path").alias("listed"))
    return judged.join(best, ["host", "path"], "left").join(more, ["c_host", "c_path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("listed").isNotNull(), "block"), F.lit("allow")).alias("verdict"), "listed"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame(LISTED, "host string, path string")
    return judge_urls(table(spark, sf_dir, "pages"), rules, listed)


OP9_SQL = """
WITH cut AS (
  SELECT page_id, url IS NOT NULL AND contains(url, '://') AS has, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), parts AS (
  SELECT page_id,
    CASE WHEN has THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM cut
), named AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS c_host,
    CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '/(\\.?/)+', '/', 'g') END AS c_path FROM parts
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), listed(h) AS (
  VALUES ('cheap-pills.example.com'), ('ads-track.example.com')
)
SELECT page_id, host, path,
  (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce(
    (SELECT arg_max(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
    CASE WHEN EXISTS (SELECT 1 FROM listed WHERE (c_host = h OR ends_with(c_host, '.' || h)) AND starts_with(c_path, '/')) THEN 'block' ELSE 'allow' END) AS verdict,
  (SELECT max(h || '/') FROM listed WHERE (c_host = h OR ends_with(c_host, '.' || h)) AND starts_with(c_path, '/')) AS listed
FROM named
"""
