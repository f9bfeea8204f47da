"""Exact dedup by heavy-hitter split.

Misra-Gries summaries of the digests (``DataFrame.freqItems``, one bounded counter set for each task, merged) name the
digests that may hold more than ``support`` of all rows. An exact count verifies them; the verified winners, at most
``1 / support`` rows, are broadcast, so the rows of large groups find their survivor map-side and are never shuffled.
The rows of all other digests are grouped with an ordinary shuffle of thin rows; text is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import ascii_lower, materialize, read, set_aside

SUPPORT = 0.001
#: Pairs (about 100 bytes each) that are broadcast to drop rows.
BROADCAST_ROWS = 500_000


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The row with the largest doc_id
    stays; null doc_ids sort below all others. Of rows equal in text *and* doc_id exactly one is kept. An empty table
    gives an empty result. Columns other than doc_id and text are ignored.
    """
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = materialize(
        docs.select("doc_id", "text").select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row_no"))
    )
    total = rows.count()
    if not total:
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    candidates = rows.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    survivor = [F.max(F.struct("doc_id", "row_no")).alias("keep"), F.count(F.lit(1)).alias("group_size")]
    winners = rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(*survivor).where(F.col("group_size") >= support * total)
    winners = materialize(winners.coalesce(1))
    hot = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    cold = rest.join(rest.groupBy("text_sha256").agg(*survivor), "text_sha256")
    return hot.unionByName(cold).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("keep.row_no")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``docs``, all columns, without the rows that exact_dedup() does not keep. Rows equal in doc_id and text stay once.

    Extra columns may have any name. Null and empty texts are equal; null doc_ids go before all others; an empty table stays
    empty. Texts are not shuffled while the (doc_id, digest) pairs that go are no more than BROADCAST_ROWS; beyond that, they
    are joined by these pairs, which are all different, so no key is hot.
    """
    found = materialize(exact_dedup(docs, support))
    pairs = found.groupBy(F.col("doc_id").alias("gone_id"), F.unhex("text_sha256").alias("gone_digest")).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("times"))
    pairs = materialize(pairs.where("not stays or times > 1"))
    side = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda table: table
    own, back = set_aside(docs, "doc_id", "text")
    own = own.withColumn("digest", F.unhex(F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)))
    same = own["doc_id"].eqNullSafe(F.col("gone_id")) & (own["digest"] == F.col("gone_digest"))
    again = pairs.where("stays")
    if again.isEmpty():
        return own.join(side(pairs), same, "left_anti").select(*back)
    once = own.join(side(again), same, "left_semi").dropDuplicates(["doc_id", "digest"])
    return own.join(side(pairs), same, "left_anti").unionByName(once).select(*back)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
