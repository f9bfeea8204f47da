"""Vector code compression: codebooks of vector parts, fitted and applied over metric trees of the anchors hierarchy.

Every block of vectors gets one tree for each part position. Trees are built middle-out: anchors take the points that lie
nearer to them than to any other (distances between anchors spare most tests), balls that are still large are divided the
same way, and the balls of one parent are merged in pairs, smallest first. Each ball caches the count and sum of its points.
A round walks the trees of a block from their roots with all codebook entries as candidates; a ball drops the candidates
that no point in it can prefer and hands the rest to its halves. A ball left with one candidate is wholly owned: its cached
sum and count go to that entry without a look at its points. Blocks are rows of a written table, so each round is one scan
that returns a few sums for each task, and a lost executor costs a reread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import materialize, read
from quantloom.llm.vectors import binary, integers, matrices, packed, usable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Balls of at most so many points are not divided.
LEAF = 32
#: Sums by label are broadcast up to so many labels; beyond that, only those of labels with many rows.
BROADCAST_LABELS = 200_000
#: A label with more than this share of the rows has many.
HOT_SHARE = 0.001


@dataclass
class Codebooks:
    """``entries[part, entry, place]``, integers on a grid of ``1 / scale``."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


@dataclass
class Trees:
    """The trees of one block. Points stand in the order of the leaves, ``n`` for each part; a ball is ``count`` of them from ``start``."""

    points: np.ndarray
    rows: np.ndarray
    start: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    sums: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray

    FIELDS = {"points": np.int32, "rows": np.int32, "start": np.int32, "count": np.int32, "radius": np.float64, "sums": np.int64, "left": np.int32, "right": np.int32, "roots": np.int32}

    def to_arrow(self) -> list[pa.Array]:
        return binary(*(getattr(self, f).astype(t) for f, t in self.FIELDS.items()))

    @classmethod
    def from_arrow(cls, batch: pa.RecordBatch, i: int, d: int) -> Trees:
        found = {f: np.frombuffer(batch.column(f)[i].as_buffer(), t) for f, t in cls.FIELDS.items()}
        return cls(**found | {"points": found["points"].reshape(-1, d), "sums": found["sums"].reshape(-1, d)})


def _length(difference: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("...d,...d->...", difference, difference))


def anchors(points: np.ndarray, starts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """An anchor number for every point, in each segment (which begin at ``starts``) from 0 to at most ``most`` - 1.

    All segments take their next anchor at once: the point furthest from its own anchor. It takes over the points nearer to
    it; those closer to their anchor than half the way between both anchors cannot be among them.
    """
    sizes, width = np.diff(np.append(starts, len(points))), int(most.max(initial=1))
    segment = np.repeat(np.arange(len(starts)), sizes)
    at = np.zeros((len(starts), width), np.int64)
    at[:, 0] = starts
    slot = segment * width  # a point's anchor as a place in a table of all anchors
    first = slot.copy()
    own = _length(points - np.repeat(points[starts], sizes, axis=0))
    half = np.full((len(starts), width), np.inf)
    for k in range(1, width):
        top = np.maximum.reduceat(own, starts)
        live = (most > k) & (top > 0)
        if not live.any():
            break
        hits = np.flatnonzero(own == np.repeat(top, sizes))
        at[:, k] = hits[np.searchsorted(segment[hits], np.arange(len(starts)))]
        half[:, :k] = np.where(live[:, None], _length(points[at[:, :k]] - points[at[:, k]][:, None]) / 2, np.inf)
        tried = np.flatnonzero(own > half.ravel().take(slot))
        new = _length(points[tried] - points[at[segment[tried], k]])
        closer = new < own[tried]
        tried = tried[closer]
        slot[tried], own[tried] = first[tried] + k, new[closer]
    return slot - first


def _merged(balls: dict[str, list], parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Merge the balls ``nodes`` of each parent (numbered from 0, ascending in ``parent``) in pairs until one is left, always the
    two whose common ball is smallest; appends the new balls and returns those that are left."""
    size = np.bincount(parent)
    place = np.arange(len(parent)) - np.repeat(np.cumsum(size) - size, size)
    m, s = int(size.max()), np.arange(len(size))
    ids = np.full((len(size), m), -1)
    ids[parent, place] = nodes
    known = ids >= 0
    total, radius, sums = balls["count"][ids].astype(float), balls["radius"][ids], balls["sums"][ids]

    def costs(i: np.ndarray, j: np.ndarray, rows: np.ndarray) -> np.ndarray:
        far = _length(sums[rows, i] / total[rows, i][..., None] - sums[rows, j] / total[rows, j][..., None])
        a, b = total[rows, i], total[rows, j]
        return np.maximum(far * b / (a + b) + radius[rows, i], far * a / (a + b) + radius[rows, j])

    i, j = np.triu_indices(m, 1)
    cost = np.full((len(size), m, m), np.inf)
    cost[:, i, j] = np.where(known[:, i] & known[:, j], costs(i[None], j[None], s[:, None]), np.inf)
    for _ in range(m - 1):
        flat = cost.reshape(len(size), -1)
        best = flat.argmin(1)
        live = np.flatnonzero(np.isfinite(flat[s, best]))
        a, b = best[live] // m, best[live] % m
        left, right = ids[live, a], ids[live, b]
        ids[live, a] = len(balls["count"]) + np.arange(len(live))
        radius[live, a] = flat[live, best[live]]
        total[live, a] += total[live, b]
        sums[live, a] += sums[live, b]
        known[live, b] = False
        _append(balls, count=total[live, a].astype(np.int64), radius=radius[live, a], sums=sums[live, a], left=left, right=right)
        cost[live, b, :] = cost[live, :, b] = np.inf
        others = np.arange(m)
        fresh = np.where(known[live] & (others != a[:, None]), costs(a[:, None], others[None], live[:, None]), np.inf)
        before = others < a[:, None]
        cost[live, :, a] = np.where(before, fresh, np.inf)
        cost[live, a, :] = np.where(before, np.inf, fresh)
    return ids[s, known.argmax(1)]


def _append(balls: dict[str, np.ndarray], **columns: np.ndarray) -> None:
    for name, values in columns.items():
        balls[name] = np.concatenate([balls[name], values])


def grow_trees(grid: np.ndarray, parts: int) -> Trees:
    """One tree for each part of the rows of ``grid``."""
    n, d = len(grid), grid.shape[1] // parts
    whole = np.ascontiguousarray(grid.reshape(n, parts, d).transpose(1, 0, 2)).reshape(-1, d)
    order = np.arange(parts * n)
    starts, ends = [np.arange(parts) * n], [np.arange(1, parts + 1) * n]
    parents, open_ = [np.zeros(0, int)], [np.full(parts, n > LEAF)]
    # downwards: every level divides the balls of the level above that are still large
    while open_[-1].any():
        large = np.flatnonzero(open_[-1])
        at, sizes = starts[-1][large], (ends[-1] - starts[-1])[large]
        inside = np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        mine = order[inside]
        local = np.cumsum(sizes) - sizes
        owner = anchors(whole[mine].astype(float), local, np.ceil(np.sqrt(sizes)).astype(int))
        segment = np.repeat(np.arange(len(large)), sizes)
        sort = np.lexsort((owner, segment))
        order[inside] = mine[sort]
        key = segment[sort] * (int(owner.max()) + 1) + owner[sort]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        begin = inside[first]
        end = begin + np.diff(np.append(first, len(key)))
        siblings = np.bincount(segment[sort][first])
        starts.append(begin), ends.append(end), parents.append(large[segment[sort][first]])
        # a ball without width is whole, however many copies it holds
        open_.append((end - begin > LEAF) & (np.repeat(siblings, siblings) > 1))
    ordered = whole[order]
    closed = [~o for o in open_]
    at = np.concatenate([s[c] for s, c in zip(starts, closed, strict=True)])
    to = np.concatenate([e[c] for e, c in zip(ends, closed, strict=True)])
    by = np.argsort(at)
    at, to = at[by], to[by]
    sums = np.add.reduceat(ordered, at)
    center = np.repeat(sums / (to - at)[:, None], to - at, axis=0)
    none = np.full(len(at), -1)
    balls = {"count": to - at, "radius": np.maximum.reduceat(_length(ordered - center), at), "sums": sums, "left": none, "right": none.copy()}
    # upwards: the balls of one parent are merged in pairs
    node = [np.searchsorted(at, s) for s in starts]
    for level in range(len(starts) - 1, 0, -1):
        large = np.flatnonzero(open_[level - 1])
        node[level - 1][large] = _merged(balls, np.searchsorted(large, parents[level]), node[level])
    return _laid_out(Trees(ordered, order % n, np.concatenate([at, np.full(len(balls["count"]) - len(at), -1)]), balls["count"], balls["radius"], balls["sums"], balls["left"], balls["right"], node[0]), n)


def _laid_out(trees: Trees, n: int) -> Trees:
    """Put the points of every ball in a row: the left half first, then the right one."""
    start = np.full(len(trees.count), -1)
    start[trees.roots] = np.arange(len(trees.roots)) * n
    level = trees.roots
    while len(level := level[trees.left[level] >= 0]):
        left, right = trees.left[level], trees.right[level]
        start[left], start[right] = start[level], start[level] + trees.count[left]
        level = np.concatenate([left, right])
    leaves = np.flatnonzero(trees.left < 0)
    old = _ranges(trees.start[leaves], trees.count[leaves])
    new = _ranges(start[leaves], trees.count[leaves])
    points, rows = np.empty_like(trees.points), np.empty_like(trees.rows)
    points[new], rows[new] = trees.points[old], trees.rows[old]
    trees.points, trees.rows, trees.start = points, rows, start
    return trees


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    largest = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if points.shape[1] * float(2 * largest) ** 2 < 2**50:  # every step is an integer that a double holds
        p, e = points.astype(float), entries.astype(float)
        return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)).astype(np.int64)
    return sum((points[:, None, j].astype(np.int64) - entries[None, :, j]) ** 2 for j in range(points.shape[1]))


def walk(trees: Trees, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Wholly owned balls and their entries; then the places of the points left and their entries (ties to the lower one)."""
    parts, k, _ = entries.shape
    n = len(trees.points) // parts
    ball, lists = trees.roots, np.ones((parts, k), bool)
    owned, by, looked, listed = [], [], [], []
    while len(ball):
        center = trees.sums[ball] / trees.count[ball][:, None]
        far = np.where(lists, _length(center[:, None] - entries[trees.start[ball] // n]), np.inf)
        near = far.min(1, keepdims=True)
        # no point of the ball is nearer to an entry this much further off; the last term is above all rounding
        lists = far <= near + 2 * trees.radius[ball][:, None] + 1e-6 * (1 + near + trees.radius[ball][:, None])
        single, leaf = lists.sum(1) == 1, trees.left[ball] < 0
        owned.append(ball[single]), by.append(lists[single].argmax(1))
        looked.append(ball[leaf & ~single]), listed.append(lists[leaf & ~single])
        ball, lists = ball[~leaf & ~single], lists[~leaf & ~single]
        ball, lists = np.concatenate([trees.left[ball], trees.right[ball]]), np.concatenate([lists, lists])
    looked, listed = np.concatenate(looked), np.concatenate(listed)
    sizes = trees.count[looked]
    places, listed = _ranges(trees.start[looked], sizes), np.repeat(listed, sizes, axis=0)
    codes = np.zeros(len(places), np.int64)
    for part in range(parts):
        mine = np.flatnonzero(places // n == part)
        away = squared_distances(trees.points[places[mine]], entries[part])
        codes[mine] = np.where(listed[mine], away, np.iinfo(np.int64).max).argmin(1)
    return np.concatenate(owned), np.concatenate(by), places, codes


def tally(trees: Trees, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the points of each (part, entry)."""
    parts, k, d = entries.shape
    n = len(trees.points) // parts
    balls, by, places, codes = walk(trees, entries)
    ball_key, key = trees.start[balls] // n * k + by, places // n * k + codes
    count = np.bincount(ball_key, trees.count[balls], parts * k) + np.bincount(key, minlength=parts * k)
    # sums of a block stay far below 2**53, so doubles hold them exactly
    sums = [np.bincount(ball_key, trees.sums[balls, j], parts * k) + np.bincount(key, trees.points[places, j], parts * k) for j in range(d)]
    count, sums = count.astype(np.int64), np.stack(sums, 1).astype(np.int64)
    return count.reshape(parts, k), sums.reshape(parts, k, d)


def assign(trees: Trees, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances of the block's rows, a column for each part."""
    parts = len(entries)
    n = len(trees.points) // parts
    balls, by, places, codes = walk(trees, entries)
    found = np.zeros(parts * n, np.int64)
    found[_ranges(trees.start[balls], trees.count[balls])] = np.repeat(by, trees.count[balls])
    found[places] = codes
    part = np.arange(parts * n) // n
    away = ((trees.points - entries[part, found]) ** 2).sum(1)
    code, distance = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    code[trees.rows, part], distance[trees.rows, part] = found, away
    return code, distance


def _blocks(vectors: DataFrame, keep: list[str], parts: int, scale: int, dim: int) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, grid in matrices(batches, "vector", scale, dim):
            yield pa.RecordBatch.from_arrays([*(packed(rows.column(c)) for c in keep), *grow_trees(grid, parts).to_arrow()], [*keep, *Trees.FIELDS])

    return materialize(vectors.mapInArrow(run, ", ".join([*(f"{c} array<{types[c]}>" for c in keep), *(f"{f} binary" for f in Trees.FIELDS)])))


def _rounds(blocks: DataFrame, entries: np.ndarray, rounds: int) -> np.ndarray:
    """Each round is one scan; every task returns its sums of each entry, at most parts x entries x (dimensions + 1) numbers."""
    parts, k, d = entries.shape
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], entries: np.ndarray = entries) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, k, d + 1), np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    count, sums = tally(Trees.from_arrow(batch, i, d), entries)
                    total += np.concatenate([sums, count[..., None]], axis=2)
            used = np.flatnonzero(total.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.reshape(-1)[used])], ["place", "total"])

        found = blocks.select(*Trees.FIELDS).mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()
        total = np.zeros(parts * k * (d + 1), np.int64)
        for r in found:
            total[r["place"]] = r["total"]
        total = total.reshape(parts, k, d + 1)
        count = total[..., d:]
        entries = np.where(count > 0, total[..., :d] // np.maximum(count, 1), entries)
    return entries


def compress_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks]:
    """(``vec_id``, ``keep``, codes array<int>, error long) of every usable vector, and the fitted codebooks.

    Left out are vectors that are null or empty, hold a null, NaN or infinite component, or have another length than most
    vectors (of equally common lengths, the longest counts). That length must be a multiple of ``parts``. The first entries
    are the parts of the ``entries`` smallest ids, nulls last, rows of one id by their components; fewer vectors give fewer
    entries. Repeated rows count each. Without usable vectors the result is empty and the codebooks have no entries. Other
    columns of any name are ignored. Distances are exact; components too large for them (beyond about 2**28 on the grid) are
    an error.
    """
    chosen = {vec_id: "own_id", vector: "vector"} | {c: f"own_{i}" for i, c in enumerate(keep)}
    rows = vectors.select(*(F.col(f"`{c}`").alias(n) for c, n in chosen.items())).where(usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    names = {n: c for c, n in chosen.items() if n != "vector"}
    if common is None:
        empty = rows.select(*names, F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return empty.withColumnsRenamed(names), Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    dim = common["dim"]
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    rows = rows.where(F.size("vector") == dim)
    grid = integers(F.col("vector"), scale)
    first = rows.select("own_id", grid.alias("grid")).orderBy(F.asc_nulls_last("own_id"), "grid").limit(entries).collect()
    start = np.array([r["grid"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    blocks = _blocks(rows, list(names), parts, scale, dim)
    fitted = _rounds(blocks, start, rounds)
    d = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, away = assign(Trees.from_arrow(batch, i, d), fitted)
                own = [batch.column(c).slice(i, 1).flatten() for c in names]
                offsets = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts)
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1).astype(np.int32))), pa.array(away.sum(1))], [*names, "codes", "error"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = blocks.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in names), "codes array<int>", "error long"]))
    return coded.withColumnsRenamed(names), Codebooks(fitted, scale)


def decode_vectors(coded: DataFrame, books: Codebooks, name: str = "decoded") -> DataFrame:
    """``coded`` with the vectors that the codes stand for in an array<double> column ``name``."""
    parts, _, d = books.entries.shape
    table = F.array(*(F.array(*(F.array(*(F.lit(float(x) / books.scale) for x in e)) for e in part)) for part in books.entries.tolist()))
    one = lambda code, part: F.get(F.get(table, part), code)
    return coded.withColumn(name, F.flatten(F.transform("codes", one)) if parts and d else F.array().cast("array<double>"))


def with_label_sum(rows: DataFrame, label: str = "label", value: str = "error", name: str = "label_error") -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of the same label, nulls together. Sums are broadcast while there are at
    most BROADCAST_LABELS; beyond that, those of labels with more than HOT_SHARE of the rows are (at most 1 / HOT_SHARE) and the
    rows of the other labels are joined by an ordinary shuffle."""
    sums = materialize(rows.groupBy(F.col(label).alias("of_label")).agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("of_n")))
    same = rows[label].eqNullSafe(F.col("of_label"))
    if sums.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(sums.drop("of_n")), same).drop("of_label")
    total = sums.agg(F.sum("of_n")).first()[0]
    hot = F.broadcast(sums.where(F.col("of_n") > HOT_SHARE * total).drop("of_n"))
    rest = sums.where(F.col("of_n") <= HOT_SHARE * total).drop("of_n")
    joined = [rows.join(hot, same), rows.join(hot.select("of_label"), same, "left_anti").join(rest, same)]
    return reduce(DataFrame.unionByName, joined).drop("of_label")


def hex_code(codes: Column) -> Column:
    return F.concat_ws("", F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(read(spark, sf_dir, "embeddings"), keep=("label",))
    coded = materialize(coded.select("vec_id", "label", hex_code(F.col("codes")).alias("code"), "error"))
    return with_label_sum(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds unrolled; a part is a list of integers, a codebook a list of (part, entry) rows."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row_no, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS grid
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
)""",
        "cut AS MATERIALIZED (SELECT row_no, part, grid[part * len(grid) // 8 + 1 : (part + 1) * len(grid) // 8] AS p FROM kept, range(8) AS t(part))",
        "book0 AS MATERIALIZED (SELECT part, row_no - 1 AS entry, p AS e FROM cut WHERE row_no <= 16)",
    ]
    for r in range(7):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT row_no, part, min({{'away': list_sum(list_transform(list_zip(p, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'entry': entry}}) AS b
  FROM cut JOIN book{r} USING (part) GROUP BY row_no, part
)""")
        if r < 6:
            steps.append(f"""mean{r} AS (
  SELECT part, entry, list(m ORDER BY place) AS m FROM (
    SELECT part, b.entry AS entry, place, CAST(floor(sum(p[place]) / count(*)) AS BIGINT) AS m
    FROM cut JOIN near{r} USING (row_no, part), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS place) GROUP BY ALL
  ) GROUP BY part, entry
)""")
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, e) AS e FROM book{r} LEFT JOIN mean{r} USING (part, entry))")
    steps.append("""coded AS (
  SELECT row_no, string_agg(printf('%02x', b.entry), '' ORDER BY part) AS code, CAST(sum(b.away) AS BIGINT) AS error FROM near6 GROUP BY row_no
)""")
    digest = "(SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM book6)"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256
FROM kept JOIN coded USING (row_no)"""


SQL = _sql()
