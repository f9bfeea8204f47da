"""N-gram Jaccard join: grouped prefix join, exact.

Documents become sets of word shingles. Rows with equal sets are one class from the start. A class's prefix is its first
``n - ceil(t * n) + 1`` shingles in an order that puts frequent shingles last; classes that reach the threshold share a
prefix shingle. The join goes on in steps that never emit all pairs within a group:

1. Collapse: classes with identical prefix and size are one group; only groups are in the index, each once.
2. Gather: each group goes to the pivot group (the least one at a shingle) that most of its prefix shingles name. A
   pivot's groups are expanded to their classes in parts of bounded size, each with a class of the pivot's; members are
   compared with it, and those that do not reach it with the rest of the part until one link is found. A further turn
   takes the units of step 3 to some pivots of the largest component at their shingles.
3. Filter group pairs: what is left of a group in one component is a unit. Units of different components that share a
   prefix shingle are paired where sizes, and the shingle's places in both, still allow the threshold if it is the first
   that they share (of a linked pair, the first one is). Then the shared part of both prefixes bounds the shared
   shingles of the pair.
4. Expand and verify: members of the pairs left are compared, bounded part by bounded part, up to one link of two units.

Every pair that reaches the threshold is either verified or already in one component. So the components are exactly those
of all links. Shingles are 63-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.shared import ASCII_LOWER, discard, materialize, read

WORDS, PERCENT = 4, 85
#: How many of the most frequent shingles are put last (8 bytes each, broadcast). It changes the speed only, no link.
FREQUENT = 1 << 18
#: Classes of one part; the share of its shingles by which a group goes to a pivot (fewer wait for step 3); rows (24 bytes
#: each) that are broadcast to find texts, beyond which the join shuffles.
PART, LEAST_VOTES, BROADCAST_ROWS = 256, 0.03, 1_000_000
#: Texts cut into words at a time; units at a shingle that one task pairs with others.
TEXTS, HOT = 128, 4096
#: Further turns of step 2, and pivots of a component in them.
MORE_TURNS, PIVOTS = 1, 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hashes of the words of one batch of texts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], words: int, hashes: _WordHashes) -> Iterator[np.ndarray]:
    """Of each text, sorted distinct hashes of the runs of ``words`` words; of all words, if there are fewer; empty without
    words."""
    for at in range(0, len(texts), TEXTS):
        found = [t.encode().translate(ASCII_LOWER).split() if t else [] for t in texts[at : at + TEXTS]]
        lengths = list(map(len, found))
        h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(found)), dtype=np.uint64, count=sum(lengths))
        rolled = _mix(_rolled(h, words)) if len(h) >= words else h
        end = 0
        for n in lengths:
            start, end = end, end + n
            s = rolled[start : end - words + 1] if n >= words else _mix(_rolled(h[start:end], n)) if n else h[:0]
            s = np.sort(s)
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` hashes, and of the size."""
    n = len(h) - size + 1
    rolled = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        rolled *= _A
        rolled += h[j : j + n]
    return rolled


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - -(-percent * n // 100) + 1


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def frequent_shingles(docs: DataFrame, words: int) -> DataFrame:
    """(h, n): shingles that several documents of a task's batch share, summed; copies within a batch count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush() -> pd.DataFrame:
            names, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= 2
            return pd.DataFrame({"h": _signed(names[often]), "n": n[often]})

        for batch in batches:
            for s in shingle_sets(batch["text"].tolist(), words, hashes):
                if (key := xxhash.xxh3_64_intdigest(s)) not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
                if size > 2_000_000:
                    yield flush()
                    held, seen, size = [], set(), 0
        if held:
            yield flush()

    return docs.select("text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame) -> np.ndarray:
    """Shingles of the highest counts, rarest first: as many whole steps of counts (an eighth of a power of two) as keep within
    FREQUENT. Only the number of shingles at each step and the chosen ones come to the driver."""
    counts = counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int"))
    room, least = FREQUENT, None
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, dtype=np.uint64)
    chosen = counts.where(F.col("step") >= least).select("h", "n").toArrow()
    h, n = chosen["h"].to_numpy(), chosen["n"].to_numpy()
    return h[np.lexsort((h, n))].view(np.uint64)


def ordered_keys(shingles: np.ndarray, names: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Sorted signed keys of a set: below 0 the plain shingles, from 0 the frequent ones by rank. Equal shingles have equal
    keys, and the order is the same in every set."""
    keys = (shingles >> np.uint64(1)).astype(np.int64) + np.iinfo(np.int64).min
    if len(names):
        at = np.minimum(np.searchsorted(names, shingles), len(names) - 1)
        keys = np.where(names[at] == shingles, ranks[at], keys)
    keys.sort()
    return keys


def document_sets(docs: DataFrame, words: int, percent: int, sent) -> DataFrame:
    """``docs`` (doc_id, text, text_hash) as doc_id, text_hash, n, k (hash of the set), g (hash of prefix and size), prefix (array
    of keys; NULL where the same task has given it for the same group, and for texts without words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, ranks = sent.value
        hashes = _WordHashes()
        seen: set[int] = set()
        group_of: dict[int, int] = {}
        for batch in batches:
            n, k, g, prefixes = [], [], [], []
            for s in shingle_sets(batch["text"].tolist(), words, hashes):
                n.append(len(s))
                k.append(key := xxhash.xxh3_64_intdigest(s) - (1 << 63))
                prefix = None
                if key not in group_of:
                    prefix = ordered_keys(s, names, ranks)[: prefix_length(len(s), percent)]
                    group_of[key] = xxhash.xxh3_64_intdigest(prefix, seed=len(s)) - (1 << 63)
                g.append(group := group_of[key])
                prefixes.append(prefix if len(s) and group not in seen else None)
                seen.add(group)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "n": n, "k": k, "g": g, "prefix": prefixes}, columns=["doc_id", "text_hash", "n", "k", "g", "prefix"])

    return docs.mapInPandas(run, "doc_id long, text_hash long, n int, k long, g long, prefix array<long>")


def connected(links: DataFrame) -> DataFrame:
    """(k, comp) of all ends of ``links`` (a, b): the smallest k reachable; minimum labels with pointer jumping, in few rounds."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("k").alias("b"), "comp"), "b").groupBy(F.col("a").alias("k")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "k").select("k", "comp", F.least("comp", "near").alias("to"))
        jump = lower.select(F.col("k").alias("to"), F.col("to").alias("over"))
        new = materialize(lower.join(jump, "to").select("k", "comp", F.least("to", "over").alias("new")))
        changed = new.where("new <> comp").limit(1).count()
        labels = new.select("k", F.col("new").alias("comp"))
        if not changed:
            return labels


def gather(pairs: DataFrame, centres: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of classes in one component, from ``pairs`` (p, k, comp): a pivot, and a class to compare with the pivot's own in
    ``centres`` (p, k, comp; few, of one component). A pivot with many partners is dealt to several parts, each with a copy of its set. Components that
    do not reach the pivot are also tried against the rest of their part, each class up to one link. Links are tied to the row
    that a component began with, so paths stay short."""
    many = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("m"))
    parts = many.select("p", F.greatest(F.lit(1), F.ceil(F.col("m") / PART)).cast("int").alias("parts"))
    dealt = pairs.join(parts, "p").select("p", F.pmod(F.xxhash64("k", "p"), F.col("parts")).cast("int").alias("part"), "k", "comp", F.lit(False).alias("pivot"))
    pivots = parts.join(centres, "p").select("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "k", "comp", F.lit(True).alias("pivot"))
    rows = dealt.unionByName(pivots).join(sets, "k")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pivot", ascending=False, kind="stable")  # the pivot first
        keys, all_sets = group["k"].to_numpy(), [np.frombuffer(s, dtype="<u8") for s in group["shingles"]]
        first: dict[int, int] = {}
        home = [first.setdefault(c, i) for i, c in enumerate(group["comp"].tolist())]
        found = []

        def root(i: int) -> int:
            while home[i] != i:
                home[i] = i = home[home[i]]
            return i

        def tie(i: int, j: int) -> bool:
            x, y = root(i), root(j)
            if x == y or not linked(all_sets[i], all_sets[j], percent):
                return False
            found.append((keys[min(x, y)], keys[max(x, y)]))
            home[max(x, y)] = min(x, y)
            return True

        pivots = int(group["pivot"].sum())
        for i in range(pivots, len(keys)):
            if root(i):
                any(tie(i, j) for j in range(pivots))
        for i in range(pivots, len(keys)):
            if root(i):
                any(tie(i, j) for j in range(pivots, len(keys)) if j != i)
        return pd.DataFrame([x for x in found if x[0] != x[1]], columns=["a", "b"], dtype="int64")

    return rows.groupBy("p", "part").applyInPandas(run, "a long, b long")


def verify(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of linked classes, from ``pairs`` (a, b) of units and their ``members`` (unit, k): all members of a against all
    of b, up to one link of each slice of a with each part of b. Slices and parts are bounded, and no row is emitted for a pair:
    the larger unit of a pair takes the place of a, so its members travel once for a part of all its small partners."""
    sizes = members.groupBy("unit").agg(F.count(F.lit(1)).alias("m"))
    for side in "ab":
        pairs = pairs.join(sizes.select(F.col("unit").alias(side), F.col("m").alias(f"m{side}")), side)
    turn = (F.col("mb") > F.col("ma")) | ((F.col("mb") == F.col("ma")) & (F.col("b") < F.col("a")))
    pairs = pairs.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))
    own = members.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("unit")))
    own = own.withColumn("slices", F.ceil(F.col("m") / PART).cast("int")).withColumn("slice", F.pmod(F.xxhash64("k"), F.col("slices")).cast("int"))
    partners = pairs.join(own.select(F.col("unit").alias("b"), "k"), "b")
    sizes = pairs.select("a").distinct().join(own.groupBy(F.col("unit").alias("a")).agg(F.first("slices").alias("slices")), "a")
    sizes = partners.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).join(sizes, "a")
    centres = own.select(F.col("unit").alias("a"), "slice", "k").join(sizes.drop("slices"), "a")
    centres = centres.select("a", "slice", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "k")
    partners = partners.join(sizes, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.pmod(F.xxhash64("k", "a"), F.col("parts")).cast("int").alias("part"), "b", "k")
    rows = centres.unionByName(partners).join(sets, "k")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        centre = group["b"].isna().to_numpy()
        keys, units = group["k"].to_numpy(), group["b"].to_numpy()
        all_sets = [np.frombuffer(s, dtype="<u8") for s in group["shingles"]]
        inner, done, found = np.flatnonzero(centre).tolist(), set(), []
        for i in np.flatnonzero(~centre).tolist():
            if units[i] in done:
                continue
            j = next((j for j in inner if linked(all_sets[i], all_sets[j], percent)), None)
            if j is not None:
                done.add(units[i])
                found.append((keys[j], keys[i]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("a", "slice", "part").applyInPandas(run, "a long, b long")


def sets_of(own: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(k, shingles) of wanted classes (k, least); each is read from the text of its least row."""
    wanted = materialize(wanted.select("k", F.col("least.doc_id").alias("_id"), F.col("least.text_hash").alias("_hash")))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = own.join(side, (own["text_hash"] == F.col("_hash")) & own["doc_id"].eqNullSafe(F.col("_id"))).select("k", "text")

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(batch["text"].tolist(), words, hashes)]
            yield pd.DataFrame({"k": batch["k"], "shingles": sets}, columns=["k", "shingles"])

    # equal rows repeat a class; one of each is enough
    return materialize(texts.mapInPandas(to_sets, "k long, shingles binary").dropDuplicates(["k"]))


def _gathered(pairs: DataFrame, centres: DataFrame, own: DataFrame, classes: DataFrame, words: int, percent: int, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """All links so far, and (k, comp) of their ends."""
    wanted = pairs.select("k").unionByName(centres.select("k")).distinct()
    sets = sets_of(own, classes.join(wanted, "k", "left_semi"), words)
    new = materialize(gather(pairs, centres, sets, percent))
    discard(sets)
    links = links.unionByName(new) if links is not None else new
    return links, materialize(connected(links))


def _placed(classes: DataFrame, several: DataFrame, comps: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, k, comp) of the classes that are linked or share their group, and the index (h, g, n, pos, comp): one row for each
    unit (g, comp) at each shingle. A group of one class that is linked with nothing so far is its own component."""
    of_class = classes.select("g", "k").join(several.select("g", F.lit(1).alias("several")), "g", "left").join(comps, "k", "left")
    of_class = materialize(of_class.where("comp IS NOT NULL OR several IS NOT NULL").select("g", "k", F.coalesce("comp", "k").alias("comp")))
    units = materialize(of_class.select("g", "comp").distinct())
    side = F.broadcast(units) if units.count() <= BROADCAST_ROWS else units
    return of_class, live.select("h", "g", "n", "pos").join(side, "g", "left").withColumn("comp", F.coalesce("comp", "g"))


def _by_shingle(placed: DataFrame) -> DataFrame:
    """``placed`` at the shingles where several components meet, with the largest of them (top) and the number of rows there
    (rows). Plain shingles travel once; frequent ones, the only hot keys, are summed map-side, at most FREQUENT rows."""
    size, most = F.count(F.lit(1)), F.max(F.struct("m", "comp"))
    of_h = Window.partitionBy("h")
    plain = placed.where("h < 0").repartition("h").withColumn("m", size.over(Window.partitionBy("h", "comp")))
    plain = plain.withColumns({"top": most.over(of_h)["comp"], "rows": size.over(of_h), "_least": F.min("comp").over(of_h), "_most": F.max("comp").over(of_h)})
    frequent = placed.where("h >= 0")
    at_h = frequent.groupBy("h", "comp").agg(size.alias("m")).groupBy("h").agg(most["comp"].alias("top"), F.sum("m").alias("rows"), size.alias("comps")).where("comps > 1")
    frequent = frequent.join(F.broadcast(at_h.drop("comps")), "h")
    return plain.where("_least < _most").drop("m", "_least", "_most").unionByName(frequent)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, keep.

    Two documents link when 100 * shared >= percent * united shingles; component_id is the smallest doc_id reachable by
    links. Null and empty texts, and texts without words, have no shingles and are linked with nothing: their
    component_id is their own doc_id. Null doc_ids never are a component's smallest id unless all its ids are null.
    ``keep`` marks one row of each component (of repeated rows of the smallest id, one); every row without shingles stays.
    """
    own = docs.select("doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    late = most_frequent(materialize(frequent_shingles(own, words)))
    order = np.argsort(late, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((late[order], order.astype(np.int64)))
    rows = materialize(document_sets(own, words, percent, sent).withColumn("row_no", F.monotonically_increasing_id()))
    some = rows.where("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_no", "text_hash")).alias("least")
    classes = materialize(some.groupBy("k").agg(F.first("g").alias("g"), F.first("n").alias("n"), least))

    # 1. groups once each; plain shingles meet by one shuffle; frequent ones, the only hot keys, are summed map-side and their table is broadcast
    groups = materialize(rows.where("prefix IS NOT NULL").select("g", "n", "prefix").dropDuplicates(["g"]))
    entries = groups.select("g", "n", F.posexplode("prefix").alias("pos", "h"))
    pivot = F.min(F.struct("g", "n"))
    of_h = Window.partitionBy("h")
    plain = entries.where("h < 0").withColumns({"pivot": pivot.over(of_h), "_most": F.max("g").over(of_h)}).where(F.col("pivot.g") < F.col("_most"))
    frequent = entries.where("h >= 0")
    met = frequent.groupBy("h").agg(pivot.alias("pivot"), F.max("g").alias("_most")).where(F.col("pivot.g") < F.col("_most"))
    frequent = frequent.join(F.broadcast(met), "h")
    columns = ["h", "g", "n", "pos", F.col("pivot.g").alias("p"), F.col("pivot.n").alias("pn")]
    live = materialize(plain.select(*columns).unionByName(frequent.select(*columns)))

    # 2.
    fits = lambda a, b: F.lit(percent) * F.greatest(a, b) <= F.lit(100) * F.least(a, b)
    votes = live.where((F.col("g") != F.col("p")) & fits(F.col("n"), F.col("pn"))).groupBy("g", "p").agg(F.count(F.lit(1)).alias("votes"), F.first("n").alias("n"))
    votes = votes.where(F.col("votes") >= F.col("n") * LEAST_VOTES)
    best = materialize(votes.groupBy("g").agg(F.max(F.struct("votes", "p")).alias("best")).select("g", "best.p"))
    of_group = classes.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("k").alias("k"))
    several = of_group.where("m > 1").select("g", F.col("g").alias("p"))
    pairs = materialize(classes.select("g", "k").join(best.unionByName(several), "g").select("p", "k", F.col("k").alias("comp")))
    centres = materialize(pairs.select(F.col("p").alias("g")).distinct().join(of_group, "g").select(F.col("g").alias("p"), "k", F.col("k").alias("comp")))
    links, comps = _gathered(pairs, centres, own, classes, words, percent, None)

    # again: each unit goes to the component that is the largest one at most of its shingles, if it has more classes than pivots are taken
    for turn in range(MORE_TURNS):
        of_class, placed = _placed(classes, several, comps, live)
        large = of_class.groupBy(F.col("comp").alias("top")).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PIVOTS).select("top")
        mixed = _by_shingle(placed).where("comp <> top").join(large, "top", "left_semi")
        votes = mixed.groupBy("g", "comp", "top").agg(F.count(F.lit(1)).alias("votes"), F.first("n").alias("n")).where(F.col("votes") >= F.col("n") * LEAST_VOTES)
        best = materialize(votes.groupBy("g", "comp").agg(F.max(F.struct("votes", "top")).alias("best")).select("g", "comp", F.col("best.top").alias("p")))
        of_unit = classes.select("g", "k").join(of_class.select("k", "comp"), "k", "left").withColumn("comp", F.coalesce("comp", "g"))
        pairs = materialize(of_unit.join(best, ["g", "comp"]).select("p", "k", "comp"))
        tops = of_unit.join(best.select(F.col("p").alias("comp")).distinct(), "comp").groupBy("comp", F.pmod(F.xxhash64("k", F.lit(turn)), F.lit(PIVOTS)).alias("nth")).agg(F.min("k").alias("k"))
        centres = materialize(tops.select(F.col("comp").alias("p"), "k", "comp"))
        links, comps = _gathered(pairs, centres, own, classes, words, percent, links)
        discard(of_class, pairs, centres, best)

    # 3.
    of_class, placed = _placed(classes, several, comps, live)
    mixed = materialize(_by_shingle(placed).withColumn("salts", F.ceil(F.col("rows") / HOT).cast("int")).drop("rows"))
    discard(live)
    minor = mixed.where("comp <> top").select("h", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *(F.col(c).alias(f"{c}1") for c in ("g", "n", "pos", "comp")))
    other = mixed.select("h", F.pmod(F.xxhash64("g", "comp"), F.col("salts")).cast("int").alias("salt"), "g", "n", "pos", "comp", (F.col("comp") == F.col("top")).alias("major"))
    at_most = lambda n, pos: F.col(n) - F.col(pos)  # noqa: E731  shared shingles, if the one at pos is the first
    enough = F.least(at_most("n", "pos"), at_most("n1", "pos1")) * (100 + percent) >= (F.col("n") + F.col("n1")) * percent
    once = F.col("major") | (F.struct("g1", "comp1") < F.struct("g", "comp"))
    met = minor.join(other, ["h", "salt"]).where((F.col("comp") != F.col("comp1")) & once & fits(F.col("n"), F.col("n1")) & enough)
    met = met.select(F.least(F.struct("g", "comp"), F.struct(F.col("g1").alias("g"), F.col("comp1").alias("comp"))).alias("a"), F.greatest(F.struct("g", "comp"), F.struct(F.col("g1").alias("g"), F.col("comp1").alias("comp"))).alias("b")).distinct()
    met = materialize(met.select(F.col("a.g").alias("ga"), F.col("a.comp").alias("ca"), F.col("b.g").alias("gb"), F.col("b.comp").alias("cb")))
    discard(mixed)
    if not met.isEmpty():
        side = lambda x: groups.select(F.col("g").alias(f"g{x}"), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"prefix{x}"))
        both = met.join(side("a"), "ga").join(side("b"), "gb")
        # shared shingles up to the lower end of the prefixes are in both; behind it, at most what that set has left
        left = F.when(F.element_at("prefixa", -1) <= F.element_at("prefixb", -1), F.col("na") - F.size("prefixa")).otherwise(F.col("nb") - F.size("prefixb"))
        most = F.size(F.array_intersect("prefixa", "prefixb")) + left
        unit = lambda g, c: F.xxhash64(g, c)
        pairs = materialize(both.where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select(unit("ga", "ca").alias("a"), unit("gb", "cb").alias("b"), "ga", "gb"))

        # 4.
        in_pairs = pairs.select(F.explode(F.array("ga", "gb")).alias("g")).distinct()
        members = classes.select("g", "k").join(in_pairs, "g", "left_semi").join(of_class.select("k", "comp"), "k", "left").select(unit("g", F.coalesce("comp", "g")).alias("unit"), "k")
        in_units = pairs.select(F.explode(F.array("a", "b")).alias("unit")).distinct()
        members = materialize(members.join(in_units, "unit", "left_semi"))
        more = materialize(verify(pairs.select("a", "b"), members, sets_of(own, classes.join(members, "k", "left_semi"), words), percent))
        if not more.isEmpty():
            comps = materialize(connected(links.unionByName(more)))

    named = classes.select("k", "least").join(comps, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    least = named.groupBy("comp").agg(F.min("least").alias("least"))
    of_class = named.select("k", "comp").join(least, "comp").select("k", F.col("least.doc_id").alias("component_id"), F.col("least.row_no").alias("first_row"))
    linked_rows = some.select("doc_id", "n", "k", "row_no").join(of_class, "k")
    linked_rows = linked_rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", (F.col("row_no") == F.col("first_row")).alias("keep"))
    alone = rows.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("keep"))
    return linked_rows.unionByName(alone)


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, with one document of each component. Needs doc_id to name a document: all rows of a doc_id
    stay if one of them is kept. Texts are not shuffled while the ids that go are no more than BROADCAST_ROWS."""
    found = jaccard_components(docs, **options)
    gone = f"gone_{uuid.uuid4().hex}"
    going = materialize(found.groupBy(F.col("doc_id").alias(gone)).agg(F.max("keep").alias("kept")).where(~F.col("kept")).drop("kept"))
    if going.count() <= BROADCAST_ROWS:
        going = F.broadcast(going)
    return docs.join(going, docs["doc_id"].eqNullSafe(F.col(gone)), "left_anti")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS m FROM d UNION SELECT e.b, r.m FROM r JOIN e ON r.v = e.a AND r.m < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.m) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY 1, 2
"""
