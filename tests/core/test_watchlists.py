"""Watchlists in all forms: written, read back, told apart, refused."""

from __future__ import annotations

import json

import pytest

from quantloom.operators import records
from quantloom.sources import watchlists

SCHEMA = "symbol string, name string, source string, source_file string, board array<string>, held boolean, added_at string"
ROWS = [("600519.SH", 'Big "A", Co', "manual", "", ["x", "y"], True, "2024-01-02"), ("000001.SZ", "平安", "board", "f.blk", [], False, ""), ("430047.BJ", "", "manual", "", [], False, "")]


def read(spark, path, fmt="auto"):
    made, refused = watchlists.read_watchlist(spark, str(path), fmt)
    return {r.symbol: r for r in made.collect()}, sorted(r.raw for r in refused.collect())


def test_round_trips(spark, tmp_path):
    w = spark.createDataFrame(ROWS, SCHEMA)
    lines = {f: [r.value for r in watchlists.export_lines(w, f).collect()] for f in watchlists.FORMATS}
    assert lines["flagged"] == ["1600519", "0000001", "2430047"] and lines["named"] == ['600519 Big "A", Co', "000001 平安", "430047"] and lines["txt"] == [r[0] for r in ROWS]
    assert lines["csv"][0] == '600519.SH,"Big ""A"", Co",manual,,x|y,是,2024-01-02'
    for fmt in watchlists.FORMATS:
        path = tmp_path / fmt
        head = [watchlists.CSV_HEADER] if fmt == "csv" else []
        path.write_text("\n".join(head + lines[fmt]) + "\n", "utf-8-sig" if fmt == "named" else "utf-8")
        found, refused = read(spark, path, fmt)
        assert sorted(found) == sorted(r[0] for r in ROWS) and refused == [], fmt
        a = found["600519.SH"]
        assert a.name == ("" if fmt in ("txt", "flagged") else 'Big "A" Co' if fmt == "named" else ROWS[0][1]), fmt
        assert (a.held, a.board) == ((True, ["x", "y"]) if fmt in ("json", "csv") else (False, [])), fmt
    with pytest.raises(ValueError, match="unknown format"):
        watchlists.export_lines(w, "xml")


def test_forms_are_told_from_the_content(spark, tmp_path):
    cases = {
        "array": (json.dumps(["sh600519", {"symbol": "000001", "name": "n", "held": True}, {"name": "no code"}]), {"600519.SH": "", "000001.SZ": "n"}, 1),
        "object": (json.dumps({"items": [{"code": "600519.SH"}]}), {"600519.SH": ""}, 0),
        "tokens": ("600519, 000001;sz.300750\n\tjunk 600519", {"600519.SH": "", "000001.SZ": "", "300750.SZ": ""}, 1),
        "line": ("Moutai,600519", {}, 0), "empty": ("  \n", {}, 0),
    }
    for name, (text, want, refused) in cases.items():
        (tmp_path / name).write_text(text)
        found, bad = read(spark, tmp_path / name)
        assert {s: r.name for s, r in found.items()} == want and len(bad) == refused, name
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a").write_text("600519\n")
    (tmp_path / "many" / "b").write_text('[{"symbol": "600519", "name": "second file"}, "000001"]')
    found, _ = read(spark, tmp_path / "many")
    assert {s: r.name for s, r in found.items()} == {"600519.SH": "", "000001.SZ": ""}


def test_broker_files(spark, tmp_path):
    """Old encodings, names before or after the code, quotes, flags that stand for exchanges."""
    (tmp_path / "named").write_bytes("代码 名称\n贵州茅台 600519\nsz000001，平安银行\n430047.bj\n".encode("gb18030"))
    found, refused = read(spark, tmp_path / "named", "ths")
    assert {s: r.name for s, r in found.items()} == {"600519.SH": "贵州茅台", "000001.SZ": "平安银行", "430047.BJ": ""} and refused == ["代码 名称"]
    (tmp_path / "flagged").write_text('"1600519"\n0000001\n2430047\n600036\n\nx\n')
    found, refused = read(spark, tmp_path / "flagged", "tdx")
    assert sorted(found) == ["000001.SZ", "430047.BJ", "600036.SH", "600519.SH"] and refused == ["x"]


def test_merging(spark):
    stored = spark.createDataFrame([("600519.SH", "old", True)], "symbol string, name string, held boolean")
    new = spark.createDataFrame([("600519.SH", "new", False), ("000001.SZ", "n", False)], "symbol string, name string, held boolean")
    final, counts = watchlists.merge_watchlist(stored, new)
    assert sorted(map(tuple, final.collect())) == [("000001.SZ", "n", False), ("600519.SH", "old", True)] and tuple(counts.first()) == (1, 1, 2)
    final, counts = watchlists.merge_watchlist(stored, new, "replace")
    assert final.count() == 2 and tuple(counts.first()) == (2, 0, 2)


def test_coverage_counts_other_spellings(spark):
    scopes = spark.createDataFrame([("m", "600519.SH", True), ("m", "sh.600519", False), ("m", "NATION_3", None), ("m", "nation 99", None)], "scope string, symbol string, chip_unknown boolean")
    import datetime as dt

    from pyspark.sql import functions as F

    bars = spark.createDataFrame([("600519.SH", dt.date(2024, 1, 1))], "symbol string, dt date")
    r = records.coverage_report(scopes, bars, bars.select("symbol"), F.lit(dt.date(2024, 1, 2))).first()
    assert (r.symbols, r.with_bars, r.stale, r.without_shares, r.odd_spellings, r.unknown_chips, r.warnings) == (4, 1, 1, 3, 1, 1, "no bars, old bars, no shares, spelling")
