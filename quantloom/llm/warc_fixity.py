"""Merkle fixity audit of WARC replicas.

Every record is hashed; records are ordered by their offset in a file. Offset ranges of 64 KiB, then ranges of sixteen of
those, are hashed from what they hold up to the root of each file, and the roots of sixteen files each up to one root.
Nodes are named by offsets, not by counts, so a lost record changes its own branch only. The audit compares roots and
descends through mismatching branches level by level; only leaves below them are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quantloom.llm.shared import materialize, read

LEAF_BYTES, FAN_OUT, OFFSET_LEVELS = 1 << 16, 16, 6
PAGES_PER_FILE = 1000


def warc_record(url: Column, html: Column) -> Column:
    """The bytes of a response record."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def lay_out(pages: DataFrame, **also: Column) -> DataFrame:
    """Index of the files that ``pages`` (page_id, url, html) fill: page_id, file_no, file_part, offset, length, digest,
    and the columns ``also`` of each record.

    A file holds the records of PAGES_PER_FILE consecutive page_ids in order of (page_id, digest); null ids come first in
    the file of id 0. A file with more records (repeated or null ids) is dealt into parts by digest, each laid out alone.
    """
    record = warc_record(F.col("url"), F.col("html"))
    rows = pages.select("page_id", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"), *(c.alias(n) for n, c in also.items()))
    rows = materialize(rows.withColumn("file_no", F.floor(F.coalesce("page_id", F.lit(0)) / PAGES_PER_FILE)))
    parts = rows.groupBy("file_no").agg(F.ceil(F.count(F.lit(1)) / PAGES_PER_FILE).alias("parts"))
    rows = rows.join(parts, "file_no").withColumn("file_part", F.pmod(F.xxhash64("digest", "page_id"), F.col("parts")).cast("long")).drop("parts")
    before = Window.partitionBy("file_no", "file_part").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("page_id", "file_no", "file_part", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest", *also)


def _node(children: list[str]) -> Column:
    """Hash of the ordered children; at most FAN_OUT of them, or what LEAF_BYTES hold."""
    ordered = F.array_sort(F.collect_list(F.struct(*children)))
    return F.sha2(F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", *(c[x].cast("string") for x in children))), "\n"), 256)


def tree(leaves: DataFrame, top: int) -> list[DataFrame]:
    """Levels above the leaves, lowest first: (file_no, file_part, node, digest). ``top`` levels join files. Each is written, so the
    descent reads it instead of hashing the ones below again."""
    lowest = leaves.groupBy("file_no", "file_part", F.floor(F.col("offset") / LEAF_BYTES).alias("node")).agg(_node(["offset", "length", "digest"]).alias("digest"))
    levels = [materialize(lowest)]
    for _ in range(OFFSET_LEVELS - 1):
        child = levels[-1]
        levels.append(materialize(child.groupBy("file_no", "file_part", F.floor(F.col("node") / FAN_OUT).alias("up")).agg(_node(["node", "digest"]).alias("digest")).withColumnRenamed("up", "node")))
    # file parts, then files, then groups of files
    parts = levels[-1].groupBy("file_no", F.floor(F.col("file_part") / FAN_OUT).alias("up")).agg(_node(["file_part", "node", "digest"]).alias("digest"))
    levels.append(materialize(parts.select("file_no", F.col("up").alias("file_part"), F.lit(0).cast("long").alias("node"), "digest")))
    for _ in range(top):
        child = levels[-1]
        up = child.groupBy(F.floor(F.col("file_no") / FAN_OUT).alias("up"), F.floor(F.col("file_part") / FAN_OUT).alias("part")).agg(_node(["file_no", "file_part", "digest"]).alias("digest"))
        levels.append(materialize(up.select(F.col("up").alias("file_no"), F.col("part").alias("file_part"), F.lit(0).cast("long").alias("node"), "digest")))
    return levels


def _parent(df: DataFrame, level: int, size: int) -> DataFrame:
    """``df`` with the name of each node's parent, for a level of ``size`` levels in all."""
    file_no, part, node = F.col("file_no"), F.col("file_part"), F.col("node")
    if level < OFFSET_LEVELS - 1:
        up = (file_no, part, F.floor(node / FAN_OUT))
    elif level == OFFSET_LEVELS - 1:
        up = (file_no, F.floor(part / FAN_OUT), F.lit(0).cast("long"))
    else:
        up = (F.floor(file_no / FAN_OUT), F.floor(part / FAN_OUT), F.lit(0).cast("long"))
    return df.withColumns({"up_file": up[0], "up_part": up[1], "up_node": up[2]})


def audit(reference: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ, from two indexes as lay_out() gives: file_no, file_part, offset, status, moved_to.

    status: moved (the same record stands at the offset ``moved_to`` of the replica's file part), corrupt (other bytes at this
    offset), missing (not in the replica), extra (only there, offset of the replica). So a replica that lost a record and was laid
    out again has one missing record, and those behind it moved; a record that was changed besides has no place to compare, and is
    missing and extra. Equal replicas, also empty ones, give no rows. An offset named several times in an index counts once, with
    the smallest digest.
    """
    key = ["file_no", "file_part", "offset"]
    sides = [df.groupBy(*key).agg(F.min(F.struct("digest", "length")).alias("x")).select(*key, "x.digest", "x.length") for df in (reference, replica)]
    sides = [materialize(df) for df in sides]
    files, parts = sides[0].unionByName(sides[1]).agg(F.max("file_no"), F.max("file_part")).first()
    top = 0
    while max(files or 0, (parts or 0) // FAN_OUT) >= FAN_OUT**top:
        top += 1
    trees = [tree(df, top) for df in sides]
    size = len(trees[0])
    names = ["file_no", "file_part", "node"]
    bad = None
    for level in reversed(range(size)):
        pair = []
        for t in trees:
            nodes = t[level]
            if bad is not None:
                nodes = _parent(nodes, level, size).join(bad, ["up_file", "up_part", "up_node"], "left_semi").select(*names, "digest")
            pair.append(nodes)
        both = pair[0].join(pair[1].withColumnRenamed("digest", "other"), names, "full_outer").where(~F.col("digest").eqNullSafe(F.col("other")))
        bad = materialize(both.select(F.col("file_no").alias("up_file"), F.col("file_part").alias("up_part"), F.col("node").alias("up_node")))
        if bad.isEmpty():
            break
    found = []
    for df in sides:
        placed = df.withColumns({"up_file": F.col("file_no"), "up_part": F.col("file_part"), "up_node": F.floor(F.col("offset") / LEAF_BYTES)})
        found.append(placed.join(bad, ["up_file", "up_part", "up_node"], "left_semi").select(*key, "digest", "length"))
    both = found[0].join(found[1].select(*key, F.col("digest").alias("other"), F.col("length").alias("other_length")), key, "full_outer")
    same = F.col("digest").eqNullSafe(F.col("other")) & F.col("length").eqNullSafe(F.col("other_length"))
    return aligned(materialize(both.where(~same)))


def aligned(differ: DataFrame) -> DataFrame:
    """What became of the records at offsets that differ (file_no, file_part, offset, digest, length, other, other_length; the last two
    are the replica's). Records are paired by file part and digest, equal ones in order of their offsets."""
    part = ["file_no", "file_part"]
    own = differ.where("digest is not null").select(*part, "offset", "digest", "length")
    new = differ.where("other is not null").select(*part, F.col("offset").alias("moved_to"), F.col("other").alias("digest"), F.col("other_length").alias("length"))
    nth = lambda c: F.row_number().over(Window.partitionBy(*part, "digest", "length").orderBy(c))
    pairs = materialize(own.withColumn("nth", nth("offset")).join(new.withColumn("nth", nth("moved_to")), [*part, "digest", "length", "nth"]).select(*part, "offset", "moved_to"))
    taken = pairs.select(*part, F.col("moved_to").alias("offset"), F.lit(True).alias("taken"))
    rows = differ.join(pairs, [*part, "offset"], "left").join(taken, [*part, "offset"], "left")
    left_over = F.col("other").isNotNull() & F.col("taken").isNull()
    moved, lost = F.col("moved_to").isNotNull(), F.col("digest").isNotNull() & F.col("moved_to").isNull()
    here = F.when(moved, "moved").when(lost & left_over, "corrupt").when(lost, "missing")
    says = F.array_compact(F.array(here, F.when(left_over & ~lost, "extra")))
    said = rows.select(*part, "offset", F.explode(says).alias("status"), "moved_to")
    return said.withColumn("moved_to", F.when(F.col("status") == "moved", F.col("moved_to")))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of all pages whose damage the hash of each url decides: one record in 256 has another first
    byte in its payload, one in 256 is lost. One row per page: page_id, file_no, offset, length, digest, status."""
    fate = F.substring(F.sha2(F.coalesce("url", F.lit("")), 256), 1, 2)
    html = F.when(fate == "00", F.overlay("html", F.lit("#"), F.lit(1), F.lit(1))).otherwise(F.col("html"))
    stored = warc_record(F.col("url"), html)
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = materialize(lay_out(pages, stored=F.sha2(stored, 256), stored_length=F.octet_length(stored).cast("long"), lost=fate == "01"))
    replica = index.where(~F.col("lost")).select("page_id", "file_no", "file_part", "offset", F.col("stored_length").alias("length"), F.col("stored").alias("digest"))
    found = audit(index, replica).drop("moved_to")
    return index.join(found, ["file_no", "file_part", "offset"], "left").select("page_id", "file_no", "offset", "length", "digest", F.coalesce("status", F.lit("ok")).alias("status"))


SQL = r"""
WITH p AS (SELECT page_id, page_id // 1000 AS file_no, sha256(coalesce(url, ''))[1:2] AS fate,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM pages)
SELECT page_id, file_no, coalesce(sum(strlen(r)) OVER (PARTITION BY file_no ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset,
       strlen(r) AS length, sha256(r) AS digest, CASE fate WHEN '00' THEN 'corrupt' WHEN '01' THEN 'missing' ELSE 'ok' END AS status
FROM p
"""
