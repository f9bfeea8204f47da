"""Vector codes, centroid clusters and quality rules: brute force, SQL twins, odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quantloom.llm import centroid_clusters, quality_rules, vector_codes, vectors

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    """Vectors with columns whose names the operators use themselves."""
    schema = "vec_id long, embedding array<float>, label int, own_id int, vector string, points int, codes int, error int, cluster int"
    return spark.createDataFrame([(i, v, c, 1, "v", 2, 3, 4, 5) for i, v, c in rows], schema)


@pytest.fixture(scope="module")
def rows():
    """Clustered vectors, ties, a big group of copies, repeated rows and ids, and rows that do not count."""
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 0.3, (6, 64))
    made = [(i, (middles[i % 6] + rng.normal(0, 0.01, 64)).tolist(), i % 4 or None) for i in range(300)]
    made += [(300 + i, made[7][1], 2) for i in range(200)]
    made += [(600, [0.5] * 64, None), (601, [-0.5] * 64, 9), (601, [-0.5] * 64, 9), (602, [1e-9] * 64, 9), (3, made[11][1], 1), (None, made[12][1], 1)]
    bad = [(700, None, 1), (701, [], 1), (702, [0.1] * 63 + [None], 1), (703, [0.1] * 63 + [NAN], 1), (704, [INF] + [0.1] * 63, 1), (705, [0.1] * 32, 1)]
    return made + bad


def grid_of(rows, scale):
    return [(i, [math.floor(scale * float(np.float32(x))) for x in v], c) for i, v, c in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]


def k_means(points, centers, rounds):
    """Plain rounds over lists of integers; places of the nearest centers and squared distances."""
    points, centers = np.array(points, dtype=np.int64), np.array(centers, dtype=np.int64)
    for r in range(rounds + 1):
        away = ((points[:, None] - centers[None]) ** 2).sum(2)
        nearest = away.argmin(1)
        if r < rounds:
            for c in range(len(centers)):
                if (nearest == c).any():
                    centers[c] = [int(x) // int((nearest == c).sum()) for x in points[nearest == c].sum(0)]
    return nearest, away.min(1), centers


def codes_by_hand(rows):
    kept = sorted(grid_of(rows, 4096), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    found = [k_means([v[p * 8 : p * 8 + 8] for _, v, _ in kept], [v[p * 8 : p * 8 + 8] for _, v, _ in kept[:16]], 6) for p in range(8)]
    errors = sum(f[1] for f in found)
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += int(e)
    digest = hashlib.sha256(",".join(str(x) for f in found for x in f[2].reshape(-1).tolist()).encode()).hexdigest()
    return sorted(((i, "".join(f"{f[0][n]:02x}" for f in found), int(errors[n]), by_label[c]) for n, (i, _, c) in enumerate(kept)), key=str), digest


@pytest.mark.parametrize("broadcast", [200_000, 1])
def test_vector_codes(spark, rows, broadcast, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", broadcast)
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 0.4)
    want, digest = codes_by_hand(rows)
    coded, books = vector_codes.compress_vectors(frame(spark, rows).repartition(3), keep=("label",))
    got = vector_codes.with_label_sum(coded).collect()
    assert sorted(((r.vec_id, "".join(f"{c:02x}" for c in r.codes), r.error, r.label_error) for r in got), key=str) == want
    assert books.sha256() == digest
    back = vector_codes.decode_vectors(coded, books).select("error", "vec_id", "decoded").collect()
    grids = {(i, tuple(v)) for i, v, _ in grid_of(rows, 4096)}
    for r in back[:20]:
        whole = [round(x * 4096) for x in r.decoded]
        assert any(i == r.vec_id and sum((a - b) ** 2 for a, b in zip(v, whole, strict=True)) == r.error for i, v in grids)


def test_few_or_no_vectors(spark, rows):
    assert vector_codes.compress_vectors(frame(spark, []))[0].collect() == []
    assert vector_codes.compress_vectors(frame(spark, rows[-6:-4]))[0].collect() == []
    assert centroid_clusters.cluster_vectors(frame(spark, rows[-6:]))[0].collect() == []
    few, books = vector_codes.compress_vectors(frame(spark, rows[:3]))
    assert books.entries.shape == (8, 3, 8) and {tuple(r.codes) for r in few.collect()} == {(c,) * 8 for c in range(3)}
    assert few.columns == ["vec_id", "codes", "error"]
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress_vectors(frame(spark, [(1, [1e20] * 64, 1), (2, [0.0] * 64, 1)]))[0].collect()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress_vectors(frame(spark, [(1, [0.5] * 63, 1)]))


def test_balls_cover_and_are_owned():
    """Every ball holds its points; on clustered parts whole balls are owned without a look at their points."""
    rng = np.random.default_rng(2)
    grid = np.concatenate([np.floor(rng.normal(m, 20, (400, 32))) for m in (-3000, 0, 4000)]).astype(np.int64)
    trees = vector_codes.grow_trees(grid, 4)
    assert sorted(trees.rows[:1200].tolist()) == list(range(1200))
    for start, count, radius, sums in zip(trees.start, trees.count, trees.radius, trees.sums, strict=True):
        inside = trees.points[start : start + count]
        assert (inside.sum(0) == sums).all()
        assert np.sqrt(((inside - sums / count) ** 2).sum(1)).max() <= radius + 1e-6
    entries = np.ascontiguousarray(grid[[0, 1, 400, 800, 801]].reshape(5, 4, 8).transpose(1, 0, 2))
    balls, by, places, _ = vector_codes.walk(trees, entries)
    assert trees.count[balls].sum() + len(places) == 4 * 1200
    assert trees.count[balls].sum() >= 4 * 400 and trees.count[balls].max() >= 300
    code, away = vector_codes.assign(trees, entries)
    for p in range(4):
        far = ((grid[:, None, p * 8 : p * 8 + 8] - entries[p]) ** 2).sum(2)
        assert (far.argmin(1) == code[:, p]).all() and (far.min(1) == away[:, p]).all()
    wide = np.array([[2**26 + 1] * 8, [-(2**26)] * 8, [5] * 8])
    assert vector_codes.squared_distances(wide, wide)[0, 1] == 8 * (2**27 + 1) ** 2


def test_centroid_clusters(spark, rows):
    kept = sorted(grid_of(rows, 256), key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    nearest, away, centers = k_means([v for _, v, _ in kept], [v for _, v, _ in kept[:40]], 5)
    found, centroids = centroid_clusters.cluster_vectors(frame(spark, rows).repartition(3))
    got = centroid_clusters.inertias(found).collect()
    inertia = Counter()
    for c, d in zip(nearest, away, strict=True):
        inertia[int(c)] += int(d)
    want = [(i, int(c), int(d), inertia[int(c)], int(away.sum())) for (i, _, _), c, d in zip(kept, nearest, away, strict=True)]
    assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in got), key=str) == sorted(want, key=str)
    assert (centroids == centers).all()


def test_lookup_tables_are_exact():
    rng = np.random.default_rng(4)
    grid = rng.integers(-(2**26), 2**26, (700, 5))
    grid[:300] = grid[0]
    centroids = grid[[0, 5, 400]]
    cluster, away = centroid_clusters.nearest(*centroid_clusters.tabulate_block(grid), centroids)
    far = ((grid[:, None] - centroids) ** 2).sum(2)
    assert (cluster == far.argmin(1)).all() and (away == far.min(1)).all()
    assert vectors.on_grid(np.array([-0.1, 0.1], np.float32), 256, 2).tolist() == [[-26, 25]]


@pytest.mark.parametrize("module, query", [(vector_codes, "op11_vector_codes"), (centroid_clusters, "op12_centroid_clusters")])
def test_equals_sql(spark, module, query):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    found = con.execute(module.SQL)
    got = getattr(module, query)(spark, SF)
    assert got.columns == [c[0] for c in found.description]
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


TEXTS = [
    None, "", " \n\t ", "one two", "a b c a b c", "a a a a", "x\ny\nx\n\n \n \nx\r\nx\r", "Straße élan über #*$%&|<> <b>", "\v\f a\x1cb \x85 c",
    "same line here now\n" * 40, "word " * 70000, "".join(f"w{i} " for i in range(3000)), "1 2 3 4 1 2 3 5 2 3 4",
]


def test_text_counts(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcde") for _ in range(rng.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, counts string, quality int, failed int")
    got = quality_rules.judge(docs, quality_rules.DecisionList()).collect()
    assert len(got) == len(texts)
    for r in got:
        n_words, *_, repeats = want = by_hand(texts[r.doc_id])
        assert tuple(r["counts"])[:5] == want, texts[r.doc_id]
        failed = n_words < 50 or 100 * repeats > 50 * n_words
        assert (r["quality"]["base_failed"], r["quality"]["kept"]) == (failed, not failed)
    assert quality_rules.judge(docs.limit(0), quality_rules.DecisionList()).collect() == []


def test_wide_vocabulary_needs_no_64_bit_key(monkeypatch):
    words = [b"%d" % (i % 2_100_000) for i in range(2_100_003)]
    assert quality_rules.repeated_words(words) == 6


def test_learned_list_equals_its_emitted_expression(spark):
    """Two planted reasons to drop and an exception are found; Spark's verdicts equal those of the rules read one by one."""
    rng = np.random.default_rng(9)
    n = 3000
    x = {"a": rng.random(n), "b": rng.random(n).round(2), "c": rng.random(n)}
    good = ~((x["a"] > 0.8) | ((x["b"] > 0.7) & (x["c"] < 0.3)))
    found = quality_rules.learn(x, good, np.arange(n) % 3 == 0)
    assert 2 <= len(found.rules) <= 8 and found.default
    assert str(found.rules[0]).startswith("drop if ")
    rows = spark.createDataFrame(list(zip(*(v.tolist() for v in x.values()), strict=True)), "a double, b double, c double")
    from pyspark.sql import functions as F

    of = {c: F.col(c) for c in x}
    got = rows.select(found.verdict(of).alias("kept"), found.rule_number(of).alias("rule")).collect()
    by_rule, verdict = np.zeros(n, int), np.full(n, found.default)
    for i in range(len(found.rules), 0, -1):
        hit = found.rules[i - 1].covers(x, n)
        by_rule[hit], verdict[hit] = i, found.rules[i - 1].keep
    assert [r.kept for r in got] == verdict.tolist() and [r.rule for r in got] == by_rule.tolist()
    assert (verdict == good).mean() > 0.98
    again = quality_rules.learn(x, good, np.arange(n) % 3 == 0)
    assert list(map(str, again.rules)) == list(map(str, found.rules))


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(i, f"{i} " + " ".join(map(str, range(60)))) for i in range(9)] + [(None, None)], "doc_id long, text string")
    for labels in ([], [(1, 1), (2, 1), (None, 0), (3, None)], [(99, 0)]):
        fitted = quality_rules.fit_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert not fitted.rules and fitted.default
    for labels in ([(1, 0), (2, 0)],):
        fitted = quality_rules.fit_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert not fitted.rules and not fitted.default
    kept = quality_rules.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert kept.columns == docs.columns and kept.count() == 9


def test_held_out_accuracy_and_few_rows(spark):
    """Learned on four of five labelled rows, right on the fifth; also with the bound on training rows reached."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    for most in (20_000, 1_500):
        fitted = quality_rules.fit_rules(docs, labels.where(~out), max_rows=most)
        held = docs.join(labels.where(out).select("doc_id", F.col("quality").alias("label")), "doc_id")
        got = quality_rules.judge(held, fitted).where("not quality.base_failed").select("label", "quality.kept").collect()
        assert sum(r.kept == (r.label == 1) for r in got) >= 0.97 * len(got)
        assert sum(r.kept for r in got if r.label == 1) >= 0.99 * sum(r.label == 1 for r in got)
