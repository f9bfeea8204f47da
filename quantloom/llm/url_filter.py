"""URL rules through a blocked Bloom filter.

The rule list is hashed into a Bloom filter of 256-bit blocks: a key sets all its bits in one block, so a test reads one
block. Every url gives the keys under which a rule could fit it (host suffixes x the path lengths that the list has);
keys that pass the filter go to an exact hash join with the list, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import LOWER, UPPER, read

WORDS, BITS = 4, 6
BITS_PER_KEY = 16
#: Up to this many list rows, blocks and list are broadcast (about 100 bytes a row); beyond it both joins shuffle.
BROADCAST_RULES = 200_000

#: The list that the query judges by.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, i: int) -> Column:
    """The i-th of the key's bit numbers, 0 to 64 * WORDS - 1."""
    return F.pmod(F.xxhash64(key, F.lit(i + 1)), F.lit(64 * WORDS)).cast("int")


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, words): the blocks that have bits, from a column ``key``."""
    bits = keys.select(_block(F.col("key"), blocks).alias("block"), F.explode(F.array(*(_bit(F.col("key"), i) for i in range(BITS)))).alias("bit"))
    word = lambda w: F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long")))
    return bits.groupBy("block").agg(F.array(*(word(w) for w in range(WORDS))).alias("words"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains if the url's path starts with the rule's
    path; the longest rule (host and path together, then the longer host) wins, ``block`` before ``allow`` if the list
    names one rule twice. Urls without a fitting rule get ``default``. Null or malformed urls have an empty host and
    path, which no rule fits. Repeated page_ids are judged row by row.
    """
    rules = rules.select("host", "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(F.concat("host", "path").alias("key"), F.length("host").alias("host_len"), F.length("path").alias("path_len"), F.col("verdict").alias("said"))
    size = rules.count()
    lengths = sorted(r[0] for r in rules.select("path_len").distinct().collect())
    small = size <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda df: df)
    blocks = max(1, -(-size * BITS_PER_KEY // (64 * WORDS)))
    bloom = hint(bloom_blocks(rules, blocks))

    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row_no"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.array(*(F.lit(n) for n in lengths)) if lengths else F.array().cast("array<int>")
    fitting = F.filter(fitting, lambda n: n <= F.length("path"))
    keys = F.flatten(
        F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.struct(F.concat(s, F.substring(F.col("path"), F.lit(1), n)).alias("key"), F.length(s).alias("host_len"), n.alias("path_len"))))
    )
    tried = urls.withColumn("try", F.explode_outer(keys)).select("row_no", "page_id", "host", "path", "try.*").withColumn("block", _block(F.col("key"), blocks))
    probed = tried.join(bloom, "block", "left")
    passes = F.lit(True)
    for i in range(BITS):
        bit = _bit(F.col("key"), i)
        passes = passes & (F.call_function("shiftright", F.get(F.col("words"), F.floor(bit / 64).cast("int")), bit % 64).bitwiseAND(F.lit(1)) == 1)
    possible = probed.withColumn("key", F.when(F.coalesce(passes, F.lit(False)), F.col("key")))
    exact = possible.join(hint(rules), ["key", "host_len", "path_len"], "left")
    hit = F.when(F.col("said").isNotNull(), F.struct((F.col("host_len") + F.col("path_len")).alias("size"), "host_len", "key", "said"))
    best = exact.groupBy("row_no").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(hit).alias("hit"))
    return best.select("page_id", "host", "path", F.col("hit.key").alias("rule"), F.coalesce(F.col("hit.said"), F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES))
    rules = spark.range(1).select(F.inline(listed))
    return judge_urls(read(spark, sf_dir, "pages"), rules)


SQL = r"""
WITH r(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                   ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
u AS (SELECT page_id, translate(regexp_extract(x, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) FILTER (rh IS NOT NULL) AS rule,
       coalesce(arg_max(verdict, length(rh || rp)), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
GROUP BY page_id, host, path
"""
