"""The pipeline over a small corpus with planted cases, and the registered queries of this subpackage."""

from __future__ import annotations

import random

import corpus_pipeline
from quantloom.llm import entry

WORDS = "the of and a to in is was for on red blue green old new big small house river stone".split()


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    item = " ".join(f"q{i}" for i in range(30))
    rows, labels = [], []
    for i in range(300):
        t = text(60)
        if i % 5 == 0:
            t += " you vile nasty rotten vile"
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    clean = [r for r in rows if r[0] % 5]
    copy, near, leak = (400, clean[0][1].upper()), (401, clean[1][1] + " end"), (402, text(20) + " " + item)
    rows += [(i, t, "en", "s", len(t)) for i, t in (copy, near, leak)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 402 not in got and 401 not in got and 1 not in got and 400 in got and 2 in got
    assert not any(i % 5 == 0 for i in got if i < 400)
    assert set(got) == {r[0] for r in clean} - {1} | {400}
    assert all(r.decoded_equal and len(r.ids) == r.n_tokens for r in got.values())


def test_near_copies_from_four_fifths(spark):
    words = [f"w{i}" for i in range(300)]
    swap = lambda t, at: [f"x{i}" if i in at else w for i, w in enumerate(t)]
    # five-word similarity 0.831, 0.822, 0.811 (copies) and 0.794 (none); four-word similarity below 0.85 in all cases
    texts = [
        words, words + [f"y{i}" for i in range(60)], [f"a{w}" for w in words], swap([f"a{w}" for w in words], range(100, 125)),
        [f"b{w}" for w in words[:100]], swap([f"b{w}" for w in words[:100]], {30, 60}), [f"c{w}" for w in words], swap([f"c{w}" for w in words], range(100, 130)),
    ]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.jaccard_join_stage(spark, docs, "").collect()) == [0, 2, 4, 6, 7]


def test_odd_rows_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_hit string, _sha string, ids string"
    rows = [(1, None, "en", "s", None, "a", "b", "c"), (2, "", None, None, 0, "a", "b", "c"), (None, "a b c d e f", "en", "s", 11, None, None, None)]
    rows += [(4, "Q1 q2 " * 9, "en", "s", 1, "a", "b", "c")] * 2 + [(5, "only one row", "en", "s", 1, "a", "b", "c")]
    for name, docs, items in [("odd", rows, [(1, " ".join(f"q{i}" for i in range(30))), (2, None), (None, "only one row")]), ("none", [], [])]:
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(None, 1, 1), (1, 1, None)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in got) == ([(0, True), (2, False), (4, True), (5, True)] if docs else [])


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in entry.QUERIES] == list(range(1, 11))
    assert set(entry.ORACLE_SQL) <= set(entry.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
