"""Small fixtures against brute force, and the defined results of the odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quantloom.llm import byte_bpe, decontamination, exact_dedup, jaccard_join, pii_surrogates, pitman_yor, token_output, toxicity, url_filter, warc_fixity

WORDS = "the of and a to in is was for on red blue green old new big small house river stone".split()
SCHEMA = "doc_id long, text string, lang string, k long, p long, n long, comp long, score double"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 4, 5.0) for i, t in rows], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(WORDS) + rng.choice(["", "x", "y", "z", "q"]) for _ in range(rng.choice([1, 3, 8, 40, 120]))) for i in range(60)}
    for i in range(60, 110):
        words = texts[rng.randrange(60)].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "edit"
        texts[i] = " ".join(words)
    texts |= {110: "", 111: None, 112: "  \n ", 113: "Élan ÉLAN", 114: "élan Élan", 115: "word " * 5000, 116: "WORD " * 5000}
    return sorted(texts.items())


def test_exact_dedup(spark, corpus):
    rows = corpus + [corpus[0], (None, "alone"), (None, "alone")]
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    top = lambda ids: max(ids, key=lambda i: (i is not None, i or 0))
    for support in (0.001, 0.02):
        got = exact_dedup.exact_dedup(frame(spark, rows), support).collect()
        assert len(got) == len(rows)
        for r in got:
            assert any(hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.keep_id == top(g) and r.group_size == len(g) and r.doc_id in g for t, g in groups.items())
        assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_copies(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted((lower(r.text) for r in kept.collect())) == sorted(groups)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def sets_by_hand(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return set() if not w else {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_jaccard_components(spark, corpus):
    rows = corpus + [corpus[5], corpus[5]]
    sets = {i: sets_by_hand(t) for i, t in rows}
    component = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) > 0]
    while changed:
        changed = False
        for a, b in links:
            low = min(component[a], component[b])
            changed |= component[a] != low or component[b] != low
            component[a] = component[b] = low
    got = jaccard_join.jaccard_components(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), component[i]) for i in sets}
    kept = [r.doc_id for r in got if r.keep]
    assert sorted(kept) == sorted({component[i] for i in sets if sets[i]} | {i for i in sets if not sets[i]})
    assert sorted({r.doc_id for r in jaccard_join.drop_near_copies(frame(spark, corpus)).collect()}) == sorted(set(kept))
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_jaccard_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = {i: sets_by_hand(t) for i, t in rows}
    component = {i: i for i in sets}

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                component[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == {i: root(i) for i in sets}


def contaminated_by_hand(text, items, n=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(body))
        size = min(n, len(w))
        for j in range(len(w) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == w[j : j + size]:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("bound", [1_000_000, 15])
def test_decontamination(spark, corpus, bound):
    items = [(1, corpus[3][1]), (2, "Old, HOUSE!"), (3, ""), (4, None), (30, " ".join(f"t{i}" for i in range(14))), (5, "élan")]
    rows = corpus + [(200, "x " + " ".join(f"T{i}" for i in range(12)) + " y"), (201, "an old-house, ÉLAN élan"), (None, "old house")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(frame(spark, rows), bench, max_broadcast_windows=bound).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == sorted((str(i), *contaminated_by_hand(t, items)) for i, t in rows)
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(frame(spark, rows), bench, mode="spans").collect()}
    assert cut[200] == "x  t11 y".replace("t11", "") or contaminated_by_hand(cut[200], items)[1] == 0
    clean = decontamination.decontaminate(frame(spark, rows), bench)
    assert clean.columns == frame(spark, []).columns
    assert {r.doc_id for r in clean.collect()} == {i for i, t in rows if not contaminated_by_hand(t, items)[1]}
    assert decontamination.find_contamination(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_byte_bpe_equals_library(spark, corpus):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["  two  blanks ", "\n\n a\tb \u3000 c", "<|endoftext|> 12345 it's", "日本語 🎉 e\u0301", "a" * 3000, " ", "x\n y"]
    rows = corpus + [(300 + i, t) for i, t in enumerate(odd)]
    for r in byte_bpe.encode_documents(frame(spark, rows), ranks, public_tokenizers.PATTERN).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded_equal
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    table = byte_bpe.PerfectHash(list(ranks), list(ranks.values()))
    assert sorted(table.values) == sorted(ranks.values()) and all(table.get(k) == v for k, v in ranks.items())
    assert table.get(b"not a token at all") is None and byte_bpe.PerfectHash([], []).get(b"x") is None


def test_url_rules(spark):
    urls = [None, "", "no host", "http://a.org", "HTTP://X.Example.ORG/es/1?q#f", "http://example.org/en/123", "http://example.org/en/2", "http://myexample.org/es/", "http://b.com/fr/x", "http://b.com/de/", "ftp://com/de/a", "a://b.net/://c", "http://org/", "x://u@org/"]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), *((f"site{i}.net", f"/p{i}/", "block") for i in range(500))]
    pages = spark.createDataFrame([(i % 12, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()

    def by_hand(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = lower(re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"

    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(str, ((i % 12, *by_hand(u)) for i, u in enumerate(urls))))
    assert url_filter.judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string")).where("rule is null and verdict = 'allow'").count() == len(urls)


def test_warc_audit(spark):
    pages = spark.createDataFrame([(i, f"http://x.org/{i}", "body " * (i % 50)) for i in range(3000)] + [(None, None, None)] * 3 + [(7, "again", "z")], "page_id long, url string, html string")
    index = warc_fixity.lay_out(pages).cache()
    assert index.count() == 3004
    assert warc_fixity.audit(index, index).count() == 0
    from pyspark.sql import functions as F

    other = index.where("page_id is null or page_id <> 100").withColumn("digest", F.when(F.col("page_id") == 2500, F.lit("00")).otherwise(F.col("digest")))
    found = warc_fixity.audit(index, other).join(index, ["file_no", "file_part", "offset"]).select("page_id", "status").collect()
    assert sorted(map(tuple, found)) == [(100, "missing"), (2500, "corrupt")]
    back = warc_fixity.audit(other, index).select("status").collect()
    assert sorted(r.status for r in back) == ["corrupt", "extra"]
    empty = index.limit(0)
    assert warc_fixity.audit(empty, empty).count() == 0 and warc_fixity.audit(empty, index).count() == index.select("file_no", "file_part", "offset").distinct().count()


def test_warc_replica_laid_out_again(spark):
    """Of 100 records of equal length one is lost, one changed, one added and two swapped; those behind them are moved, not corrupt."""
    names = [f"{i:04d}" for i in range(100)]

    def index(records):
        return spark.createDataFrame([(0, 0, i * 10_000, 10_000, r) for i, r in enumerate(records)], "file_no long, file_part long, offset long, length long, digest string")

    def found(records):
        return {(r.offset // 10_000, r.status, None if r.moved_to is None else r.moved_to // 10_000) for r in warc_fixity.audit(index(names), index(records)).collect()}

    lost = names[:50] + names[51:]
    assert found(lost) == {(50, "missing", None)} | {(i, "moved", i - 1) for i in range(51, 100)}
    assert found(names[:50] + ["new"] + names[50:]) == {(50, "extra", None)} | {(i, "moved", i + 1) for i in range(50, 100)}
    assert found(["bad" if n == "0007" else n for n in names]) == {(7, "corrupt", None)}
    assert found(names[:3] + [names[4], names[3]] + names[5:]) == {(3, "moved", 4), (4, "moved", 3)}
    both = found(["bad" if n == "0070" else n for n in lost])
    assert both == {(50, "missing", None), (69, "extra", None), (70, "missing", None)} | {(i, "moved", i - 1) for i in range(51, 100) if i != 70}
    # equal records: pairs in order, the one left over is missing
    twins = ["same"] * 3
    got = warc_fixity.audit(index([*twins, "a", "b"]), index([*twins[1:], "a", "b"])).collect()
    assert {(r.offset // 10_000, r.status, r.moved_to) for r in got} == {(2, "missing", None), (3, "moved", 20_000), (4, "moved", 30_000)}


def test_token_blocks(spark, corpus):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.array([7]), np.full(5000, 3), rng.integers(0, 60000, 3000), rng.integers(0, 2**32, 2000), np.arange(700)):
        packed = token_output.pack_ids(ids.astype(np.uint32))
        assert np.array_equal(token_output.unpack_ids(packed), ids.astype(np.uint32))
    assert len(token_output.pack_ids(np.tile(np.arange(40), 2000))) < 80_000 * 6 // 8 // 2  # half of plain 6-bit places
    broken = bytearray(token_output.pack_ids(rng.integers(0, 300, 3000)))
    broken[-500] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_output.unpack_ids(bytes(broken))

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = corpus + [(400, "<|endoftext|> Café e\u0301\u00a0x\u2003y İ ΣΑΣ 12 it's"), (401, "\n\n")]
    with open(path, encoding="utf-8") as f:
        got = {r.doc_id: r for r in token_output.read_token_ids(token_output.write_token_ids(frame(spark, rows), f.read())).collect()}
    start = 0
    for i, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_pii(spark):
    texts = [
        "Write to Anna.Berg@mail.example.com or anna.berg@mail.example.com, call +1 (988) 555-2485.",
        "anna.berg@mail.example.com again; host 10.20.30.40, card 4111 1111 1111 1111 and 4111111111111111.",
        "Mr. John Smith met Mrs Mary Smith and Dr Smith. Г-н нет, Госпожа Анна Иванова да.",
        "clean text with 12 numbers, v1.2.3 and a date 2024-01-02", "", None, "SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00.",
    ]
    rows = [*enumerate(texts), (1, texts[1])]
    got = pii_surrogates.replace_pii(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.text for r in got}
    assert [by[3], by[4], by[5]] == texts[3:6]
    first, again = re.findall(r"\S+@\S+\.com", by[0])
    assert first.lower() == again and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{3}@[a-z]{4}\.[a-z]{7}\.com", first) and first != "Anna.Berg@mail.example.com"
    assert again in by[1]
    spaced, plain = re.search(r"card ((?:\d{4} ?){4}) and (\d{16})", by[1]).groups()
    assert spaced.replace(" ", "") == plain != "4111111111111111" and plain[0] == "4"
    digits = [int(c) for c in plain[::-1]]
    assert (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0
    assert re.search(r"\+1 \([2-9]\d\d\) \d{3}-\d{4}", by[0])
    smiths = re.search(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+) and Dr (\w+)\.", by[2])
    assert smiths[2] == smiths[4] == smiths[5] != "Smith" and smiths[1].endswith("rik") and smiths[3].endswith("lia")
    assert re.search(r"Госпожа [А-Я][а-я]+лия [А-Я][а-я]+ да", by[2])
    assert re.search(r"SSN \d{3}-\d\d-\d{4}, IBAN DE\d\d( \d{4}){4} \d\d\.", by[6]) and "123-45-6789" not in by[6]
    other = {r.doc_id: r.text for r in pii_surrogates.replace_pii(frame(spark, rows), "another").collect()}
    assert other[0] != by[0]
    assert pii_surrogates.replace_pii(frame(spark, [])).count() == 0


def test_pii_names_all_over_a_document(spark):
    texts = [
        "Mr John Smith came. John Smith said so, and Smith (JOHN) left; a smith and Smithson stayed.",
        "Mrs O'Brien, Mr. J. Smith, Dr Anna-Lena Weber and Mr John Ronald Tolkien met Herr von der Leyen; Weber's Tolkien, Ronald, O'Brien.",
        "Dr Γιώργος Παπαδόπουλος here, later Παπαδόπουλος.",
        "Smith and John without any title stay, with 1.2.3.4 beside them.",
    ]
    got = {r.doc_id: r for r in pii_surrogates.replace_pii(frame(spark, list(enumerate(texts)))).collect()}
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. (\w+) (\w+) said so, and (\w+) \((\w+)\) left; a smith and Smithson stayed\.", got[0].text)
    assert m[1] == m[3] != "John" and m[2] == m[4] == m[5] != "Smith" and m[6] == m[1].upper() and got[0].n_entities == 5
    assert not re.search("Brien|Smith|Anna|Lena|Weber|John|Ronald|Tolkien|Leyen", got[1].text)
    n = re.fullmatch(r"Mrs (\w'\w+), Mr\. \w\. (\w+), Dr \w+-\w+ (\w+) and Mr \w+ (\w+) (\w+) met Herr von der \w+; (\w+)'s (\w+), (\w+), \w'(\w+)\.", got[1].text)
    assert n[2] == m[2] and (n[6], n[7], n[8], n[9]) == (n[3], n[5], n[4], n[1][2:])
    g = re.fullmatch(r"Dr ([α-ω]+) ([α-ω]+) here, later ([α-ω]+)\.", got[2].text.lower().replace("dr", "Dr"))
    assert g[2] == g[3] != "παπαδόπουλος"
    assert got[3].text.startswith("Smith and John without any title stay") and got[3].n_entities == 1


def test_pii_one_person_under_all_titles(spark):
    """Genders of given names: the title's, else the document's, else the corpus's; names in capitals; a run without a key."""
    texts = [
        "Dr Mary Smith met Mrs Mary Smith and Mary Smith; later Prof. Mary Smith left.",
        "Dr Mary Jones here.",
        "MR. JOHN SMITH AND MS. ANNA-LENA O'NEIL and Mr John Smith; MS DOS and DR stay.",
        "Mr Andrea Rossi and Mrs Andrea Rossi.",
        "Prof Kim Lee.",
    ]
    got = {r.doc_id: r for r in pii_surrogates.replace_pii(frame(spark, list(enumerate(texts))), "k").collect()}
    m = re.fullmatch(r"Dr (\w+) (\w+) met Mrs (\w+) (\w+) and (\w+) (\w+); later Prof\. (\w+) (\w+) left\.", got[0].text)
    assert m[1] == m[3] == m[5] == m[7] != "Mary" and m[1].endswith("lia") and m[2] == m[4] == m[6] == m[8] != "Smith"
    assert re.match(r"Dr (\w+) ", got[1].text)[1] == m[1]
    n = re.fullmatch(r"MR\. (\w+) (\w+) AND MS\. (\w+-\w+) (\w'\w+) and Mr (\w+) (\w+); MS DOS and DR stay\.", got[2].text)
    assert n[1] == n[5].upper() != "JOHN" and n[2] == n[6].upper() == m[2].upper() and n[3].isupper() and "ANNA" not in n[3] and "NEIL" not in n[4]
    a = re.fullmatch(r"Mr (\w+) \w+ and Mrs (\w+) \w+\.", got[3].text)
    assert a[1].endswith("rik") and a[2].endswith("lia")
    assert re.fullmatch(r"Prof \w+sen \w+\.", got[4].text)
    keyless = [pii_surrogates.replace_pii(frame(spark, [(0, texts[0])])).first().text for _ in range(2)]
    assert keyless[0] != keyless[1] != texts[0]


def test_pii_crowded_addresses(spark):
    """All 26 addresses of one letter: none is free, so replacements get longer."""
    rows = [(i, f"write to {c}@ab.org or {c.upper()}@ab.org") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    got = pii_surrogates.replace_pii(frame(spark, rows), "k").collect()
    found = [re.findall(r"\S+@\S+\.org", r.text) for r in got]
    assert all(len(f) == 2 and f[0].lower() == f[1].lower() for f in found) and len({f[0] for f in found}) == 26
    assert not {f[0] for f in found} & {f"{c}@ab.org" for c in "abcdefghijklmnopqrstuvwxyz"}


def test_pii_surrogates_stay_distinct(spark, monkeypatch):
    keys = spark.createDataFrame([(f"ssn:{i:09d}",) for i in range(400)], "key string")
    real = pii_surrogates.candidate
    from pyspark.sql import functions as F

    # a crowded space: the first attempts give only 30 different replacements, some of them real entities
    monkeypatch.setattr(pii_surrogates, "candidate", lambda k, a, s: F.when(a < 3, F.concat(F.lit("ssn:"), F.lpad(F.pmod(F.xxhash64(k, a), F.lit(30)).cast("string"), 9, "0"))).otherwise(real(k, a, s)))
    got = pii_surrogates.assign(keys, "s").collect()
    assert len(got) == len({r.key for r in got}) == len({r.surrogate for r in got}) == 400
    assert not {r.surrogate for r in got} & {r.key for r in got}


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["nasty", "vile", "you", "rotten"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, ""), (1001, None), (1002, "word " * 20000), (None, "red house")]
    known = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (1000, 1, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    got = toxicity.fit_toxicity(docs, known).score(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [(r.score, r.doc_id % 6 == 0) for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([(s > np.array(good)).mean() for s in bad]) > 0.9
    kept = toxicity.reject_toxic(docs, known)
    assert kept.columns == docs.columns and {1000, 1001, 1002} <= {r.doc_id for r in kept.collect()}
    none = toxicity.fit_toxicity(docs, known.limit(0)).score(docs)
    assert {r.score for r in none.collect()} == {0.0}


def test_pitman_yor(spark, corpus):
    rng = random.Random(9)
    rare = lambda: str(rng.randrange(4000)) if rng.random() < 0.15 else ""
    rows = [(i, " ".join(rng.choice(WORDS) + rare() for _ in range(50))) for i in range(200)] + [(i + 500, t) for i, t in corpus]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    docs = spark.createDataFrame([(i, t, held[i]) for i, t in rows], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r for r in pitman_yor.score_texts(docs).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for i, t in rows}
    counts = {}
    for i in tokens:
        for w in tokens[i] if not held[i] else ():
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    for i, w in tokens.items():
        base = sum(math.log10((counts.get(x, 0) + 0.1) / (total + 0.1 * (len(counts) + 1))) for x in w)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(x in counts for x in w), total)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
    out = [i for i in tokens if held[i]]
    assert sum(got[i].score for i in out) > sum(got[i].base_score for i in out)
    words = spark.createDataFrame([(w.encode() if w else b"", c) for w, c in counts.items()] + [(b"unseen", 0)], "word binary, c long")
    table, unknown = pitman_yor.fit_words(words)
    assert sum(r.p for r in table.where("c > 0").collect()) + unknown == pytest.approx(1.0, abs=1e-6)
    nothing = pitman_yor.score_texts(docs.withColumn("held_out", docs["doc_id"].isNotNull())).collect()
    assert all(r.train_tokens == 0 and r.score <= 0 for r in nothing)
    assert pitman_yor.score_texts(docs.limit(0)).count() == 0


def test_seating_follows_the_restaurant():
    rng = np.random.default_rng(2)
    customers = np.full(4000, 50)
    tables = pitman_yor.seat(customers, np.full(4000, 2.0), 0.5, rng)
    by_hand = []
    for _ in range(1500):
        t = 1
        for i in range(1, 50):
            t += rng.random() < 2.0 / (2.0 + i - 0.5 * t)
        by_hand.append(t)
    assert abs(tables.mean() - np.mean(by_hand)) < 0.25
    assert (tables >= 1).all() and (pitman_yor.seat(np.array([0, 1]), np.ones(2), 0.5, rng) == [0, 1]).all()


def test_pitman_yor_context(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(6)]
    follow = {w: rng.sample(words, 2) for w in words}
    rows = []
    for _ in range(120):
        text = [rng.choice(words)]
        while len(text) < 12:
            text.append(rng.choice(follow[text[-1]]) if rng.random() < 0.9 else rng.choice(words))
        rows.append((len(rows), " ".join(text), False))
    names = [*words, "unseen"]
    asked = ["", *names, *(f"{u} {w}" for u in names for w in names)]
    walk = [words[0]]
    while len(walk) < 12:
        walk.append(follow[walk[-1]][0])
    asked += [" ".join(walk), " ".join(sorted(walk))]
    rows += [(1000 + i, t, True) for i, t in enumerate(asked)]
    got = {r.doc_id: r for r in pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    p = {t: 10 ** got[1000 + i].score for i, t in enumerate(asked)}
    assert p[asked[-2]] > p[asked[-1]] * 100, "the order of the words counts"
    # known words, the unknown one and the end add up to 1 after every word: the largest eigenvalue of the transitions is 1;
    # scaled so that only the probabilities of whole texts are needed
    d = np.sqrt([p[w] for w in names])
    inner = np.array([[p[f"{u} {w}"] for w in names] for u in names]) / np.outer(d, d)
    matrix = np.block([[np.array([[p[""]]]), d[None]], [d[:, None], inner]])
    assert np.abs(np.linalg.eigvals(matrix)).max() == pytest.approx(1.0, abs=1e-4)
    assert all(math.isfinite(r.spelled_score) and r.spelled_score <= r.score + 1e-5 for r in got.values())


def test_pitman_yor_keeps_all_spelling_restaurants(spark):
    rng = np.random.default_rng(6)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", dtype=np.uint8)
    known = [*{bytes(w) for w in letters[rng.integers(0, len(letters), (85000, 9))]}, b"~a~b~c~d~e~f"]
    asked = [b"~a~b~c~d~e~g", known[0][:6]]
    keys = {}
    for w in known:
        spelt = b"    " + w + b" "
        for i in range(4, len(spelt)):
            keys[spelt[i - 4 : i + 1]] = keys.get(spelt[i - 4 : i + 1], 0) + 1
    assert len(keys) > 1 << 19
    dishes, tables_of, customers_of = [], [], []
    for _ in range(5):
        dishes.insert(0, keys)
        tables, customers, keys = {}, {}, {}
        for k, n in dishes[0].items():
            tables[k[:-1]], customers[k[:-1]] = tables.get(k[:-1], 0) + 1, customers.get(k[:-1], 0) + n
            keys[k[1:]] = keys.get(k[1:], 0) + 1
        tables_of.insert(0, tables)
        customers_of.insert(0, customers)

    def written(w):
        spelt, product = b"    " + w + b" ", 1.0
        for i in range(4, len(spelt)):
            p = 1 / 256
            for depth in range(5):
                k = spelt[i - depth : i + 1]
                t, c, n = tables_of[depth].get(k[:-1], 0), customers_of[depth].get(k[:-1], 0), dishes[depth].get(k, 0)
                p = ((n - 0.5) if n else 0.0) / (1 + c) + (1 + 0.5 * t) / (1 + c) * p
            product *= p
        return product

    words = spark.createDataFrame([(w, 1) for w in known] + [(w, 0) for w in asked], "word binary, c long")
    table, _ = pitman_yor.fit_words(words, sweeps=0, burn_in=-1)
    got = {bytes(r.word): r.p for r in table.where("c = 0").collect()}
    new = (1 + 0.95 * len(known)) / (1 + len(known))
    assert [got[w] for w in asked] == pytest.approx([new * written(w) for w in asked], rel=1e-6)


CLASHING = ["_id", "_sha", "_digest", "digest", "gone_id", "_of", "_keys", "_set", "_gone", "n_words", "n_hit", "items", "hit_runs", "_toxicity", "features", "keep", "stays"]


def test_columns_named_like_those_of_the_operators(spark, corpus):
    rows = [(i, t, *[f"{c}{i}" for c in CLASHING]) for i, t in [*corpus, corpus[0], (None, None), (None, "Mr John Smith, old house"), (None, "alone"), (None, "alone")]]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in CLASHING)]))
    bench = spark.createDataFrame([(1, "old house")], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(100)], "doc_id long, quality int, toxic int")
    made = {
        "copies": exact_dedup.drop_copies(docs),
        "near": jaccard_join.drop_near_copies(docs),
        "drop": decontamination.decontaminate(docs, bench),
        "spans": decontamination.decontaminate(docs, bench, mode="spans"),
        "toxic": toxicity.reject_toxic(docs, labels),
        "pii": pii_surrogates.replace_pii(docs),
    }
    for name, got in made.items():
        assert [c for c in got.columns if c != "n_entities"] == docs.columns, name
        found = got.collect()
        assert found, name
        for r in found:
            assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHING), name
    for empty in (docs.limit(0), docs.where("text is null")):
        assert exact_dedup.drop_copies(empty).count() == min(1, empty.count())
        assert decontamination.decontaminate(empty, bench.limit(0)).count() == empty.count()
        assert toxicity.reject_toxic(empty, labels.limit(0)).count() == empty.count()
        assert pii_surrogates.replace_pii(empty).count() == empty.count()


def test_copies_beyond_the_broadcast(spark, corpus, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    rows = [*corpus, corpus[0], (None, "alone"), (None, "alone"), (7, "other text of seven")]
    kept = exact_dedup.drop_copies(frame(spark, rows))
    assert sorted(lower(r.text) for r in kept.collect()) == sorted({lower(t) for _, t in rows})


def test_long_benchmark_items_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 4)
    item = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([("long", " ".join(item)), ("short", "w3 w4")], "item_id string, text string")
    rows = [(i, " ".join(["x", *item[i : i + 12], "y"])) for i in range(28)] + [(50, " ".join(item[5:14]))]
    for bound in (1000, 12):
        got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontamination.find_contamination(frame(spark, rows), bench, max_broadcast_windows=bound).collect()}
        assert got == {i: contaminated_by_hand(t, [("long", " ".join(item)), ("short", "w3 w4")])[1:] for i, t in rows}
