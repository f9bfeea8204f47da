"""Candle variants, technical details, breakouts, steps and gates on small frames with results worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest

from quantloom.operators import patterns, records, rules, waves

DAY = dt.date(2024, 1, 1)
PLAIN = (10.0, 10.2, 9.8, 10.1, 100.0)


def candles(spark, *series):
    """Bars of the symbols A, B, ... from (open, high, low, close, volume)."""
    rows = [("ABCDEFGH"[s], DAY + dt.timedelta(i), *map(float, b)) for s, bars in enumerate(series) for i, b in enumerate(bars)]
    return spark.createDataFrame(rows, "symbol string, dt date, open double, high double, low double, close double, volume double")


GAP = [PLAIN] * 5 + [(10.6, 11.1, 10.5, 11.0, 100), (10.9, 11.0, 10.4, 10.7, 90), (10.7, 11.5, 10.6, 11.3, 110)]
REST = [PLAIN] * 3 + [(10, 11.1, 9.9, 11, 100), (10.9, 11, 10.5, 10.6, 60), (10.6, 10.7, 10.3, 10.4, 70), (10.4, 11.6, 10.3, 11.5, 120)]
STACK = [PLAIN, PLAIN, (10, 10.6, 9.9, 10.5, 100), (10.5, 10.5, 10.1, 10.2, 90), (10.2, 11, 10.15, 10.9, 100), (10.9, 10.9, 10.4, 10.6, 80), (10.6, 11.4, 10.5, 11.3, 100)]
SEVEN = [(9, 9.6, 8.9, 9.5, 100), (9.5, 9.5, 9.2, 9.3, 90), *STACK[2:]]
WAIT = [(10, 10.2, 9.9, 10.1, 100)] * 12 + [(10, 11.1, 9.95, 11, 200), (10.9, 11, 10.6, 10.8, 120), (10.8, 11, 10.6, 10.9, 110)]


def hits(spark, *series):
    found = patterns.combo_details(patterns.candle_flags(candles(spark, *series), list(patterns.DETECTORS)[10:])).collect()
    return {r.symbol: r for r in found if any(r[c] for c in list(patterns.DETECTORS)[10:])}


def test_variants(spark):
    found = hits(spark, GAP, REST, STACK, SEVEN, WAIT, WAIT + [PLAIN], [PLAIN] * 4)
    a, b, c, d, e = (found[s] for s in "ABCDE")
    assert a.gap_duofangpao and (a.gap_low, a.gap_support, a.gap_held, a.gap_later) == (10.2, 10.4, True, 0) and a.gap_pct == pytest.approx(2.94)
    assert b.liangyang_liangyin and (b.rest_ratio, b.rest_shrinks) == (0.65, True) and b.gap_low is None
    assert c.diedie_duofangpao and (c.stack_groups, c.stack_rises, c.stack_gain) == (2, True, 7.62)
    assert d.diedie_duofangpao and (d.stack_groups, d.stack_rises, d.stack_gain) == (3, True, 18.95)
    assert e.duofangpao_pending and (e.confirm_at, e.fail_at) == (11.1, 10.0)
    # a later bar ends the waiting, and closes the gap
    assert not found.get("F") or not found["F"].duofangpao_pending
    later = hits(spark, [*GAP, (11, 11.1, 10.0, 10.3, 100)])["A"]
    assert (later.gap_held, later.gap_support, later.gap_later) == (False, 10.0, 1)


def test_results_of_both_periods(spark):
    days = candles(spark, GAP, [PLAIN] * 3)
    found = {r.symbol: r for r in patterns.candle_result(days, candles(spark, [PLAIN] * 2, STACK), codes=list(patterns.DETECTORS)[10:]).collect()}
    assert (found["A"].n_hits, found["A"].direction, found["A"].summary_daily, found["A"].summary_weekly) == (1, "bull", "gap_duofangpao(01-08 bull)", "-")
    assert (found["B"].n_hits, found["B"].direction, found["B"].summary_daily, found["B"].summary_weekly) == (1, "bull", "-", "diedie_duofangpao(01-07 bull)")
    assert patterns.candle_result(days.limit(0)).count() == 0


def test_technical_detail(spark):
    turns = {"A": [1.0] * 10 + [2.0] * 10, "B": [6.0] * 10 + [3.0] * 10, "C": [None] * 12, "D": [0.0] * 12, "E": [20.0] * 5}
    rows = [(s, DAY + dt.timedelta(i), 9.0 if i == len(v) - 2 else 11.0, 10.0, 2.0 if s == "A" else 1.0, t) for s, v in turns.items() for i, t in enumerate(v)]
    bars = spark.createDataFrame(rows, "symbol string, dt date, close double, ma5 double, volume_ratio double, turn double")
    newest = {r.symbol: r for r in rules.technical_detail(bars).collect() if r.dt == DAY + dt.timedelta(len(turns[r.symbol]) - 1)}
    assert {s: (r.returned_to_ma5, r.chip_turn, r.chip_band, r.chip_trend) for s, r in newest.items()} == {
        "A": (True, 1.5, "dense", "spreading"), "B": (False, 4.5, "fairly dense", "gathering"), "C": (False, None, "missing", "unknown"),
        "D": (False, None, "missing", "unknown"), "E": (False, 20.0, "very loose", "unknown"),
    }


def test_breakout_quality(spark):
    after = {"A": [], "B": [10.5, 10.4], "C": [10.5, 10.1, 10.6], "D": [10.5, 9.8, 11.0]}
    rows = [(s, DAY + dt.timedelta(i), c, 10.0, i == 0) for s, closes in after.items() for i, c in enumerate([10.6, *closes])]
    rows += [("E", DAY, 9.0, 10.0, False)] + [("F", DAY + dt.timedelta(i), 10.6, 10.0, i == 0) for i in range(61)]
    found = rules.breakout_quality(spark.createDataFrame(rows, "symbol string, dt date, close double, upper double, breakout boolean")).collect()
    assert {r.symbol: r.quality for r in found} == {"A": "direct", "B": "direct", "C": "pullback", "D": "false", "E": "none", "F": "none"}


def test_ten_steps(spark):
    schema = "symbol string, trend_ok boolean, wave1_ok boolean, wave2_exists boolean, shrinks boolean, stable boolean, breakout boolean, exhausted boolean, entry double, stop double, failed_hard array<int>"
    yes = dict(trend_ok=True, wave1_ok=True, wave2_exists=True, shrinks=True, stable=True, breakout=True, exhausted=False, entry=10.0, stop=9.0, failed_hard=[])
    cases = {
        "hold": {}, "spent": {"exhausted": True}, "market": {"trend_ok": None, "failed_hard": [1], "breakout": False}, "rules": {"failed_hard": [8]}, "break": {"breakout": False, "exhausted": True},
        "quiet": {"shrinks": False, "breakout": False}, "second": {"wave2_exists": False, "breakout": False}, "bear month": {"breakout": False},
    }
    rows = [tuple({"symbol": s, **yes, **c}.values()) for s, c in cases.items()]
    months = spark.createDataFrame([(s, -1 if s == "bear month" else 1) for s in cases], "symbol string, month_direction int")
    found = {r.symbol: (r.step, r.furthest) for r in waves.reached(waves.ten_steps(spark.createDataFrame(rows, schema), months)).collect()}
    assert found == {"hold": (9, 10), "spent": (10, 10), "market": (1, 10), "rules": (7, 10), "break": (6, 10), "quiet": (5, 10), "second": (4, 10), "bear month": (2, 10)}
    table = [(r.no, r.status, r.flag) for r in waves.step_table(waves.ten_steps(spark.createDataFrame(rows, schema), months)).where("symbol = 'quiet'").orderBy("no").collect()]
    assert table[3:7] == [(4, "passed", True), (5, "current", False), (6, "open", False), (7, "open", False)]


GATES = "symbol string, stock struct<stock_strict:boolean>, market struct<market_up:boolean, position:string>, sector struct<up:boolean>, capital struct<active:boolean>, "


def test_gates_know_what_is_unknown(spark):
    """Threshold and gate mode are the row's own; results without them, or without a resonance, leave gates unknown."""
    kind = "resonance struct<score:double, options:struct<true_threshold:double, high_position_gate:string>>"
    leg = ((True,), (True, "high"), (None,), (False,))
    rows = [("A", *leg, (90.0, (85.0, "hard"))), ("B", *leg, (90.0, (95.0, " Soft"))), ("C", *leg, (90.0, (None, None))), ("D", *leg, (None, (85.0, "off"))), ("E", None, None, None, None, None)]
    nested = spark.createDataFrame(rows, GATES + kind)
    gates = lambda n=nested, **k: {r[0]: tuple(r[1:]) for r in rules.row_gates(n, **k).collect()}
    leg = (False, True, None, True)
    assert gates() == {"A": (True, *leg, False), "B": (False, *leg, True), "C": (None, *leg, False), "D": (None, *leg, True), "E": (None,) * 6}
    assert [gates(force_hard=True)[s][-1] for s in "ABCD"] == [False] * 4
    old = spark.createDataFrame([("A", *rows[0][1:5], (90.0,))], GATES + "resonance struct<score:double>")
    assert gates(old)["A"] == (None, *leg, False)
    assert rules.effective_options(old).collect() == []


def test_option_echo(spark):
    kind = "resonance struct<score:double, options:struct<true_threshold:double, high_position_gate:string, market_mode:string>>"
    nested = spark.createDataFrame([("B", None, (True, "low"), None, None, (1.0, (70.0, None, "yearline"))), ("A", None, (False, None), None, None, (1.0, None)), ("0", None, None, None, None, None)], GATES + kind)
    assert rules.effective_options(nested).collect()[0].asDict() == {"market_mode": "yearline", "true_threshold": 70.0, "capital_min_score": None, "capital_min_volume_ratio": None, "index_max_lag_days": None, "high_position_gate": "hard", "volume_boost_ratio": 1.5}
    assert tuple(rules.market_leg_snapshot(nested).collect()[0]) == (False, "unknown", None, False, None)
    assert tuple(rules.market_leg_snapshot(nested.where("symbol = 'B'")).collect()[0]) == (True, "low", None, False, "yearline")
    assert tuple(rules.market_leg_snapshot(nested.limit(0)).collect()[0]) == (False, "unknown", None, False, None)


def test_stars_and_hammers_need_few_bars(spark):
    """A star may stand on a symbol's first three bars (there is no mean body yet); a hammer needs ten bars before it."""
    star = [(11, 11.1, 9.9, 10, 100), (9.9, 10.0, 9.6, 9.8, 100), (9.9, 10.9, 9.8, 10.8, 100)]
    fallen = [(10, 10.1, 8.9, 9.98, 100)]
    days = candles(spark, star, [PLAIN] * 9 + fallen, [PLAIN] * 10 + fallen)
    found = {(r.symbol, r.code, r.dt) for r in patterns.newest_hits(days, codes=["zaochenzhixing", "chuitouxian"]).collect()}
    assert found == {("A", "zaochenzhixing", DAY + dt.timedelta(2)), ("C", "chuitouxian", DAY + dt.timedelta(10))}
    assert list(patterns.DETECTORS)[2:8] == ["zaochenzhixing", "huanghunzhixing", "hongsanbing", "sanzhiwuya", "chuitouxian", "shejizhixing"]


def test_annotated_alerts(spark):
    alerts = spark.createDataFrame([("A", DAY, "golden"), ("A", DAY, "death"), ("B", DAY, "golden"), ("C", DAY, "golden")], "symbol string, dt date, now string")
    weeks = spark.createDataFrame([(s, DAY + dt.timedelta(7 * i), float(c)) for s, v in {"A": [99, 1, 2, 3, 4, 5], "B": [1, 2, 3, 4]}.items() for i, c in enumerate(v)], "symbol string, dt date, close double")
    held = spark.createDataFrame([("B", True)], "symbol string, held boolean")
    found = {(r.symbol, r.now): (r.held, r.above_5w) for r in records.annotate_alerts(alerts, held, weeks).collect()}
    assert found == {("A", "golden"): (False, True), ("A", "death"): (False, False), ("B", "golden"): (True, False), ("C", "golden"): (False, False)}
