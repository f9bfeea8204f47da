"""Centroid clustering by scalar lookup tables.

Components are integers, so a block of vectors holds few values in each dimension. Blocks are written once, as the values
that occur in each dimension and, for every vector, where its component stands among them. In each round a task tabulates
(value - centroid)**2 for each dimension, occurring value and centroid; the distances of all vectors of the block to all
centroids are then sums of rows gathered from these tables, exact in integers. A task returns its sums of each centroid, so
a round shuffles centroids x (dimensions + 1) numbers a task; nothing of the vectors leaves it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import materialize, read
from quantloom.llm.vectors import binary, integers, matrices, packed, usable

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Vectors whose distances are held at a time.
STRIP = 512


def tabulate_block(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values that occur, dimension after dimension; how many in each; and for each dimension the places of the rows' components
    among its values."""
    values, places = zip(*(np.unique(column, return_inverse=True) for column in grid.T), strict=True)
    return np.concatenate(values), np.array([len(v) for v in values]), np.stack(places)


def distances(values: np.ndarray, counts: np.ndarray, places: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of the block's vectors to all centroids, strip by strip."""
    ends = np.cumsum(counts)
    difference = values[:, None] - centroids.T[np.repeat(np.arange(len(counts)), counts)]
    table = difference * difference
    # half the memory where the sums fit 32 bits
    if table.size and float(table.max()) * len(counts) < 2**31:
        table = table.astype(np.int32)
    tables = [table[e - c : e] for e, c in zip(ends, counts, strict=True)]
    for lo in range(0, places.shape[1], STRIP):
        strip = slice(lo, lo + STRIP)
        total = tables[0].take(places[0, strip], axis=0)
        for one, at in zip(tables[1:], places[1:], strict=True):
            total += one.take(at[strip], axis=0)
        yield strip, total


def nearest(values: np.ndarray, counts: np.ndarray, places: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smallest) and squared distance of each vector."""
    cluster, away = np.empty(places.shape[1], np.int64), np.empty(places.shape[1], np.int64)
    for strip, total in distances(values, counts, places, centroids):
        cluster[strip] = total.argmin(1)
        away[strip] = total.min(1)
    return cluster, away


def _unpack(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, counts, places = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("vals", np.int64), ("counts", np.int32), ("places", np.uint16)))
    return values, counts, places.reshape(len(counts), -1)


def _blocks(rows: DataFrame, scale: int, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, grid in matrices(batches, "vector", scale, dim):  # a block has fewer rows than 16 bits count
            values, counts, places = tabulate_block(grid)
            yield pa.RecordBatch.from_arrays([packed(run.column("own_id")), *binary(values, counts.astype(np.int32), places.astype(np.uint16))], ["own_id", "vals", "counts", "places"])

    kind = rows.schema["own_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"own_id array<{kind}>, vals binary, counts binary, places binary"))


def _round(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids moved to the floor of their vectors' means; those without vectors stay."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                values, counts, places = _unpack(batch, i)
                cluster, _ = nearest(values, counts, places, centroids)
                total[:, dim] += np.bincount(cluster, minlength=k)
                for j, start in enumerate(np.cumsum(counts) - counts):
                    # how often each value meets each centroid, times the value
                    met = np.bincount(cluster * counts[j] + places[j], minlength=k * counts[j]).reshape(k, -1)
                    total[:, j] += met @ values[start : start + counts[j]]
        used = np.flatnonzero(total.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.reshape(-1)[used])], ["place", "total"])

    total = np.zeros(k * (dim + 1), np.int64)
    for r in blocks.select("vals", "counts", "places").mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect():
        total[r["place"]] = r["total"]
    total = total.reshape(k, dim + 1)
    return np.where(total[:, dim:] > 0, total[:, :dim] // np.maximum(total[:, dim:], 1), centroids)


def cluster_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id``, cluster int, distance long) of every vector of ``dim`` usable components, and the final centroids.

    Null vectors, those of another length and those with a null, NaN or infinite component are left out. The first centroids
    are the vectors whose sha256 of ``seed:id`` is smallest (null ids last, rows of one id by their components); fewer vectors
    give fewer centroids. Repeated rows count each. Without usable vectors the result is empty. Other columns of any name are
    ignored. Distances are exact; components too large for that (beyond about 2**27 on the grid) are an error.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").alias("own_id"), F.col(f"`{vector}`").alias("vector")).where((F.size("vector") == dim) & usable(F.col("vector")))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("own_id").cast("string")), 256)
    first = rows.select(order.alias("order"), integers(F.col("vector"), scale).alias("grid")).orderBy(F.asc_nulls_last("order"), "grid").limit(k).collect()
    if not first:
        return rows.select(F.col("own_id").alias(vec_id), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dim), np.int64)
    centroids = np.array([r["grid"] for r in first], np.int64)
    blocks = _blocks(rows, scale, dim)
    for _ in range(rounds):
        centroids = _round(blocks, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cluster, away = nearest(*_unpack(batch, i), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("own_id").slice(i, 1).flatten(), pa.array(cluster.astype(np.int32)), pa.array(away)], ["own_id", "cluster", "distance"])

    kind = rows.schema["own_id"].dataType.simpleString()
    found = blocks.mapInArrow(run, f"own_id {kind}, cluster int, distance long")
    return found.withColumnRenamed("own_id", vec_id), centroids


def inertias(clustered: DataFrame) -> DataFrame:
    """``clustered`` with the distance summed over each cluster and over all; clusters are as few as centroids, so both are broadcast."""
    by = clustered.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    return clustered.join(F.broadcast(by), "cluster").join(F.broadcast(by.agg(F.sum("cluster_inertia").alias("inertia"))))


def _digest(centroids: np.ndarray) -> Column:
    return F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster_vectors(read(spark, sf_dir, "embeddings"))
    digest = F.get(_digest(centroids), F.col("cluster")) if len(centroids) else F.lit("")
    return inertias(materialize(found)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _sql() -> str:
    """The rounds unrolled."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS grid
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        """mean0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), grid) - 1 AS cluster, grid AS c FROM kept QUALIFY cluster < 40
)""",
    ]
    for r in range(6):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT row_no, min({{'away': list_sum(list_transform(list_zip(grid, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'cluster': cluster}}) AS b
  FROM kept, mean{r} GROUP BY row_no
)""")
        if r < 5:
            steps.append(f"""mean{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM mean{r} LEFT JOIN (
    SELECT cluster, list(v ORDER BY place) AS m FROM (
      SELECT b.cluster AS cluster, place, CAST(floor(sum(grid[place]) / count(*)) AS BIGINT) AS v
      FROM kept JOIN near{r} USING (row_no), range(1, 65) AS t(place) GROUP BY ALL
    ) GROUP BY cluster
  ) USING (cluster)
)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(b.cluster AS INTEGER) AS cluster, b.away AS distance, CAST(sum(b.away) OVER (PARTITION BY b.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(b.away) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN near5 USING (row_no) JOIN mean5 ON mean5.cluster = near5.b.cluster"""


SQL = _sql()
