"""Benchmark decontamination by a broadcast hash set of test n-grams.

The windows of the benchmark are normalised and hashed once per task into a sorted hash array with the windows behind
it. Every training text is cut into words, all its windows are hashed with vector operations, the hashes are looked up,
and each hit is verified word by word before it counts. The benchmark side is broadcast only while it has at most
``max_broadcast_windows`` windows; a larger one is cut into parts under that bound, one after the other broadcast and
scanned, with the words hit united per document and written between. The driver holds one part at a time.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import UPPER, materialize, read, set_aside

WINDOW = 10
#: Windows of a piece of a long item.
PIECE = 4096
MAX_BROADCAST_WINDOWS = 2_000_000
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank; other bytes belong to words.
WORD_BYTES = bytes(
    b + 32 if chr(b) in UPPER else b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else 0x20 for b in range(256)
)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def _windows(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    size = min(window, len(words))
    for i in range(len(words) - size + 1 if size else 0):
        yield tuple(words[i : i + size])


class WindowIndex:
    """Hash set of windows by their number of words; bytes hash as this Python process hashes them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        by_size: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            for w in set(_windows(text.split(), window)):
                by_size[len(w)][w].append(item)
        self.sizes = []
        for size, windows in sorted(by_size.items()):
            keys = np.unique(_rolled(np.array([hash(x) for w in windows for x in w], dtype=np.int64).view(np.uint64), size)[::size])
            table = np.zeros(1 << _TABLE_BITS, dtype=bool)
            table[keys >> np.uint64(64 - _TABLE_BITS)] = True
            self.sizes.append((size, table, keys, dict(windows)))

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurring window, and the items of those windows."""
        hit, found = np.zeros(len(words), dtype=bool), set()
        hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
        for size, table, keys, windows in self.sizes:
            if len(words) < size:
                continue
            rolled = _rolled(hashes, size)
            at = np.flatnonzero(table[rolled >> np.uint64(64 - _TABLE_BITS)])
            at = at[keys[np.minimum(np.searchsorted(keys, rolled[at]), len(keys) - 1)] == rolled[at]]
            for i in at.tolist():
                if items := windows.get(tuple(words[i : i + size])):
                    hit[i : i + size] = True
                    found.update(items)
        return hit, found


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` word hashes."""
    n = len(hashes) - size + 1
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        rolled = rolled * _FACTOR + hashes[j : j + n]
    rolled ^= rolled >> np.uint64(29)
    return rolled * _FACTOR


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, text, windows): the items' words, long items in overlapping pieces of at most PIECE windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                words = words_of(text)
                n = max(1, len(words) - window + 1) if words else 0
                for at in range(0, n, PIECE):
                    rows.append((item, b" ".join(words[at : at + PIECE + window - 1]), min(PIECE, n - at)))
            yield pd.DataFrame(rows, columns=["item", "text", "windows"])

    named = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null and item is not null")
    return named.mapInPandas(run, "item string, text binary, windows long")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted item_ids as strings) and hit_runs (first word, one past the last).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is ``window`` consecutive words
    of an item, all words of a shorter one. Null and empty texts have no words; null items and items without words match
    nothing; repeated rows and item_ids are judged row by row. An empty benchmark leaves every document clean. Columns of
    ``docs`` with the names of the added ones give way to them.
    """
    pieces = materialize(_pieces(benchmark, window))
    windows = pieces.agg(F.sum("windows")).first()[0] or 0
    if windows <= max_broadcast_windows:
        return _scan(docs.drop(*_ADDED), pieces, window, False)[0]
    # pieces are small against a part, so hashed parts of half the bound stay below it; the driver holds one part at a time
    parts = -(-2 * windows // max_broadcast_windows)
    found = docs.drop(*_ADDED)
    for k in range(parts):
        found, sent = _scan(found, pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k), window, k > 0)
        found = materialize(found)
        sent.destroy()
    return found


def _scan(docs: DataFrame, pieces: DataFrame, window: int, again: bool) -> tuple[DataFrame, Broadcast]:
    """``docs`` with the columns of _ADDED, those of an earlier scan united if there was one (``again``); and what was broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast([(item, bytes(text)) for item, text in pieces.select("item", "text").toLocalIterator()])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = WindowIndex(sent.value, window)
        for batch in batches:
            rows = []
            earlier = zip(batch["items"], batch["hit_runs"], strict=True) if again else (((), ()) for _ in range(len(batch)))
            for text, (items, runs) in zip(batch["text"], earlier, strict=True):
                words = words_of(text)
                hit, names = index.hits(words)
                for a, b in runs:
                    hit[a:b] = True
                names.update(items)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                rows.append((len(words), int(hit.sum()), sorted(names), edges.reshape(-1, 2).tolist()))
            out = batch.drop(columns=list(_ADDED), errors="ignore")
            for c, values in zip(_ADDED, zip(*rows, strict=True) if rows else [[]] * len(_ADDED), strict=True):
                out[c] = pd.Series(values, index=out.index, dtype=None if rows else object)
            yield out

    added = ", ".join(f"{c} {t}" for c, t in _ADDED.items())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in _ADDED)
    return docs.mapInPandas(scan, f"{fields}, {added}"), sent


_ADDED = {"n_words": "long", "n_hit": "long", "items": "array<string>", "hit_runs": "array<array<int>>"}


def remove_spans(text: str, runs: list[list[int]]) -> str:
    """``text`` without the characters from the first to the last word of each run."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", raw)]
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "drop", **options) -> DataFrame:
    """``docs``, all columns under any names, without contaminated documents (``drop``) or without the passages found (``spans``).
    Null and empty texts stay; rows are judged one by one, null and repeated doc_ids too."""
    own, back = set_aside(docs, "text")
    found = find_contamination(own, benchmark, **options)
    if mode == "drop":
        return found.where("n_hit = 0").select(*back)

    @F.pandas_udf("string")
    def cut(text: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([remove_spans(t, r) if t is not None and len(r) else t for t, r in zip(text, runs, strict=True)])

    return found.withColumn("text", cut("text", "hit_runs")).select(*back)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w FROM b WHERE len(w) > 0),
bk AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bw),
s AS (SELECT DISTINCT n FROM bk),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, s WHERE len(w) >= n),
h AS (SELECT r, i, bk.n, item_id FROM dw JOIN bk ON dw.n = bk.n AND array_to_string(w[i:i + dw.n - 1], ' ') = k),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
g AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN g USING (r)
"""
