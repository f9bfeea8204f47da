"""Adaptive platforms, boxes, the checklist, accumulation, structures, flags and stored results, against results worked out by hand."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import accumulation, indicators, patterns, relations, results, rules, structure

DAY = dt.date(2024, 1, 1)  # a Monday
BAR = "symbol string, dt date, open double, high double, low double, close double, volume double, turn double"


def frame(spark, series):
    """Bars from closes, or from (close, volume) or (high, low, close); opens are the close before."""
    rows = []
    for s, values in series.items():
        last = None
        for i, v in enumerate(values):
            c, volume, high, low = (v, 100.0, v, v) if not isinstance(v, tuple) else (v[0], v[1], v[0], v[0]) if len(v) == 2 else (v[2], 100.0, v[0], v[1])
            rows.append((s, DAY + dt.timedelta(i), float(last if last is not None else c), float(high), float(low), float(c), float(volume), None))
            last = c
    return spark.createDataFrame(rows, BAR)


def newest(df):
    return {r.symbol: r for r in indicators.latest(df).collect()}


def test_adaptive_windows(spark):
    turns = {"A": [2.0] * 20, "B": [12.0] * 20, "C": [3.0] * 20, "D": [None] * 25, "E": [2.0] * 19, "F": [0.0] * 20, "G": [4.0] * 20, "I": [0.5] * 20}
    rows = [(s, DAY + dt.timedelta(i), t) for s, v in turns.items() for i, t in enumerate(v)]
    found = newest(indicators.adaptive_windows(spark.createDataFrame(rows, "symbol string, dt date, turn double")))
    got = {s: (r.lookback, r.atr_window, r.k) for s, r in found.items()}
    # 70 / 4 is a half: it goes to the even number
    assert got == {"A": (35, 10, 1.5), "B": (10, 10, 2.2), "C": (23, 10, 1.8), "D": (30, 10, 1.8), "E": (30, 10, 1.8), "F": (30, 10, 1.8), "G": (18, 10, 1.8), "I": (60, 14, 1.5)}


def test_adaptive_platform_equals_the_fixed_one_of_its_windows(spark):
    rng = random.Random(2)
    rows = [("300001.SZ" if s else "A", DAY + dt.timedelta(i), *sorted((rng.uniform(9, 11), rng.uniform(9, 11)))[::1], rng.uniform(9, 11), rng.randint(1, 9)) for s in (0, 1) for i in range(90)]
    bars = spark.createDataFrame([(s, d, c, max(h, c), min(lo, c), c, float(v), 2.3) for s, d, lo, h, c, v in rows], BAR).withColumn("open", F.col("low"))
    made = indicators.adaptive_windows(bars)
    wide = {(r.symbol, r.dt): r for r in indicators.adaptive_platform(made).collect()}
    for symbol, limit in (("A", 0.1), ("300001.SZ", 0.2)):
        one = bars.where(F.col("symbol") == symbol)
        with_limit = indicators.true_range_atr(one, 10, limit).withColumn("limit_before", F.coalesce(F.lag("at_limit").over(indicators.whole().orderBy("dt")), F.lit(False)))
        fixed = indicators.poc(with_limit, 30).collect()
        assert len(fixed) == 61
        for r in fixed:
            got = wide[symbol, r.dt]
            assert got.lookback == 30 and got.poc == pytest.approx(r.poc) and got.atr == pytest.approx(r.atr) and got.upper == pytest.approx(r.poc + 1.5 * r.atr)
    assert sum(r.poc is None for r in wide.values()) == 2 * 29 and not any(r.breakout for r in wide.values() if r.poc is None)


def test_boxes_of_weeks(spark):
    """Five weeks at least; the own week counts up to the day; a short week does not count once it is over."""
    bars = [(10 + w * 0.1, 10 - w * 0.1, 10) for w in range(6) for _ in range(7)]
    days = frame(spark, {"A": bars, "B": bars})
    # of B's third week only two days are left
    days = days.where("not (symbol = 'B' and dt between date'2024-01-15' and date'2024-01-19' and dt < date'2024-01-18')").where(F.dayofweek("dt").between(2, 6))
    made = {(r.symbol, r.dt): r for r in rules.period_box(days, "week").collect()}
    at = lambda s, w, d: made[s, DAY + dt.timedelta(7 * w + d)]
    assert at("A", 3, 4).week_box == "unknown" and at("A", 3, 4).week_top is None
    assert at("A", 4, 0).week_top == pytest.approx(10.4) and at("A", 4, 0).week_bottom == pytest.approx(9.6)
    assert at("B", 4, 4).week_box == "unknown" and at("B", 5, 0).week_top == pytest.approx(10.5)
    # a close at the top of the box
    high = frame(spark, {"A": [(10.0, 9.0, 9.5)] * 40 + [(10.0, 9.4, 9.95)], "C": [(10.0, 9.0, 9.5)] * 40 + [(9.3, 9.0, 9.1)]})
    assert {s: r.week_box for s, r in newest(rules.period_box(high, "week")).items()} == {"A": "tests top", "C": "falls to bottom"}


def test_platform_rule(spark):
    base = [("A", 9.9, False, 1.0, 0, None), ("B", 10.05, False, 2.0, 1, None), ("C", 10.05, True, 1.0, 0, 9.0), ("D", 9.5, True, 1.0, 0, 9.0), ("E", 9.5, False, 1.0, 0, 9.0), ("F", 10.45, False, 2.0, 0, None)]
    rows = [(s, DAY + dt.timedelta(i), c if i == 24 else 10.0, brk and i == 24, ratio, cross, poc) for s, c, brk, ratio, cross, poc in base for i in range(25)]
    bars = spark.createDataFrame(rows, "symbol string, dt date, close double, breakout boolean, volume_ratio double, macd_cross int, poc double")
    bars = bars.withColumns({"ma20": F.lit(10.0), "high": F.lit(10.5), "low": F.when(F.col("symbol").isin("D", "E"), 5.0).otherwise(9.8), "upper": F.col("poc") + 1, "lower": F.col("poc") - 1})
    got = {s: (r.platform_state, r.platform_signal, r.buy_flat, r.platform_top) for s, r in newest(rules.platform_rule(bars)).items()}
    assert got == {
        "A": ("sideways", False, False, 10.5),  # narrow, under ma20
        "B": ("confirmed", True, False, 10.5),  # above ma20 on volume with a golden cross
        "C": ("sideways", True, False, 10.0),  # the bands' signal stays, the state does not
        "D": ("confirmed", True, False, 10.0), "E": ("sideways", False, False, 10.0),  # wide: only the bands speak
        "F": ("sideways", False, False, 10.5),  # 6.6 % over the bottom
    }
    few = rules.platform_rule(bars.where("symbol = 'B'").limit(9)).collect()
    assert {r.platform_state for r in few} == {"unknown"}


def test_checklist(spark):
    rows = [(s, DAY + dt.timedelta(i), 10 + 0.01 * i, 10 + 0.01 * i, 9.9, 500.0 if i == 69 else 100.0, 9 + 0.001 * i, 0.02 if i == 69 else -0.1, 0.0, 55.0 + (i == 69), s == "A") for s in "AB" for i in range(70)]
    bars = spark.createDataFrame(rows, "symbol string, dt date, close double, high double, low double, volume double, ma60 double, macd double, macd_signal double, rsi double, sector_up boolean")
    found = newest(rules.main_wave_checklist(bars, F.when(F.col("sector_up"), True)))
    assert [found["A"][c] for c in rules.CHECKS] == [True] * 8 and (found["A"].checks_met, found["A"].checks_share, found["A"].checks_verdict) == (8, 1.0, "likely")
    assert not found["B"].sector_strong and found["B"].checks_met == 7
    early = rules.main_wave_checklist(bars).where("symbol = 'A'").orderBy("dt").collect()
    assert (early[0].checks_met, early[0].checks_verdict) == (0, "not yet") and not early[2].money_flows and early[3].money_flows
    assert not early[58].long_sideways and early[59].long_sideways and not early[63].ma60_rising and early[64].ma60_rising


def test_comprehensive_signal(spark):
    rows = [("A", 90.0, True, "true resonance", True, True), ("B", 90.0, True, "true resonance", True, False), ("C", 72.5, False, "second", True, False), ("D", 99.0, True, "true resonance", False, True), ("E", None, None, "none", True, None), ("F", 50.0, False, "first", None, True)]
    found = rules.comprehensive_signal(spark.createDataFrame(rows, "symbol string, score double, true_resonance boolean, level string, yearline_pass boolean, main_wave boolean")).collect()
    assert {r.symbol: (r.final_score, r.advice.split(":")[0], r.signal_true_resonance) for r in found} == {
        "A": (70.0, "focus strongly", True), "B": (54.0, "focus", True), "C": (43.5, "focus", False), "D": (0.0, "wait", False), "E": (0.0, "wait", False), "F": (0.0, "wait", False),
    }


def test_stages_with_shifts_of_the_poc(spark):
    """A shakeout needs a POC that does not fall, a rally one that rises; an unknown shift speaks against neither."""
    from quantloom.operators import waves

    rally = [10.0] * 40 + [10 + 0.1 * i for i in range(1, 21)]
    shaken = [10.0] * 40 + [10 + 0.1 * i for i in range(1, 16)] + [11.4, 11.3, 11.2, 11.1, 11.0]
    calm = [(c, 50.0 if i >= 55 else 100.0) for i, c in enumerate(shaken)]
    flat = [(10.0, 200.0 if i >= 55 else 100.0) for i in range(60)]
    series = {"rally": rally, "spent": rally, "shaken": calm, "fallen": calm, "flat": flat, "short": rally[:29], "quiet": [10.0] * 60}
    ends = {"rally": 11.0, "spent": 10.1, "shaken": 10.5, "fallen": 9.0, "flat": 10.5, "quiet": None}
    bars = frame(spark, series).withColumn("poc", F.when(F.col("dt") == DAY + dt.timedelta(59), F.coalesce(*(F.when(F.col("symbol") == s, F.lit(v).cast("double")) for s, v in ends.items()))).when(F.col("symbol") != "quiet", 10.0))
    got = {s: (r.stage, r.stage_confidence) for s, r in newest(waves.stage(bars)).items()}
    assert got == {"rally": ("rally", 0.75), "spent": ("consolidation", 0.5), "shaken": ("shakeout", 0.7), "fallen": ("consolidation", 0.5), "flat": ("accumulation", 0.7), "short": ("unknown", 0.0), "quiet": ("consolidation", 0.6)}
    assert newest(waves.stage(bars.drop("poc")))["spent"].stage == "rally"


def test_grades_of_accumulation(spark):
    fall = [20.0] * 60 + [16.0] * 40
    quiet = [(c, 80.0 if i >= 95 else 100.0) for i, c in enumerate(fall)]
    series = {
        "strong": quiet, "under": [(30.0, 100.0)] * 250 + quiet, "usual": fall, "top": [(10.0, 100.0)] * 30 + [(10.0 + 0.01 * i, 100.0 if i < 25 else 200.0) for i in range(30)],
        "rally": [10.0] * 40 + [10 + 0.1 * i for i in range(21)], "short": fall[:29], "pressed": [(20.0, 100.0)] * 60 + [(16.0, 100.0)] * 25 + [(15.0, 150.0)] * 5, "dry": [(c, 30.0 if i >= 95 else 100.0) for i, c in enumerate(fall)],
    }
    found = newest(accumulation.accumulation(frame(spark, series)))
    got = {s: (r.acc_level, r.acc_points, r.acc_stage, r.volume_state) for s, r in found.items()}
    assert got == {
        "strong": ("strong", 78, "consolidation", "settling"), "under": ("medium", 78, "consolidation", "settling"), "usual": ("medium", 53, "consolidation", "usual"),
        "top": ("none", 23, "distribution", "heavy"), "rally": ("none", 8, "rally", "usual"), "short": ("unknown", None, "unknown", "usual"),
        "pressed": ("medium", 75, "pressed accumulation", "mild rise"), "dry": ("medium", 65, "consolidation", "dried up"),
    }
    assert found["strong"].acc_evidence == ["low", "flat", "volume settling", "small range", "stage consolidation"] and found["under"].acc_evidence[-1] == "below year line"
    assert found["strong"].above_year is None and found["strong"].retrace_pct == 20.0 and found["short"].acc_evidence == []
    # what a stock knows beside its bars
    more = accumulation.accumulation(frame(spark, {"A": fall}), stage=F.lit("accumulation"), chip_low=F.lit(True), turnover=F.lit(1.5))
    assert newest(more)["A"].acc_points == 53 + 20 + 20 + 8 and newest(more)["A"].acc_level == "medium"


def test_accumulation_of_results(spark):
    rows = [
        ("A", "accumulation", True, False, 1.5, 8.0, 10.0, True), ("B", "accumulation", True, True, None, None, None, None), ("C", "distribution", True, False, 1.0, 8.0, 10.0, True), ("D", None, None, None, None, None, None, None),
        ("E", "consolidation", False, False, 4.0, 8.4, 10.0, False),
    ]
    found = accumulation.from_results(spark.createDataFrame(rows, "symbol string, stage string, chip_low boolean, chip_low_unknown boolean, turnover_20 double, price double, high_120 double, yearline_pass boolean")).collect()
    assert {r.symbol: (r.acc_level, r.acc_points, r.acc_known) for r in found} == {"A": ("medium", 101, True), "B": ("weak", 43, True), "C": ("none", 58, True), "D": ("none", 0, False), "E": ("medium", 53, True)}


def zigzag(turns, step=4):
    """Closes that go straight from turn to turn in ``step`` bars each."""
    return [a + (b - a) * k / step for a, b in zip(turns, turns[1:], strict=False) for k in range(step)] + [turns[-1]]


def test_strokes_zones_and_summary(spark):
    turns = [10, 14, 11, 13, 10.5, 18, 15]
    bars = frame(spark, {"A": [9, 9.5, *zigzag(turns), 15.5, 16], "B": [1.0, 2.0, 3.0]})
    moves = structure.strokes(bars)
    got = [(r.direction, r.low, r.high, r.confirmed) for r in moves.orderBy("no").collect()]
    assert got == [("down", 11.0, 14.0, False), ("up", 11.0, 13.0, False), ("down", 10.5, 13.0, True), ("up", 10.5, 18.0, True), ("down", 15.0, 18.0, True)]
    areas = structure.zones(moves)
    zone = areas.collect()
    assert [(r.zd, r.zg, r.dd, r.gg, r.n_strokes, r.finished) for r in zone] == [(11.0, 13.0, 10.5, 18.0, 4, True)]
    found = {r.symbol: r for r in structure.summary(bars, moves, areas).collect()}
    a, b = found["A"], found["B"]
    assert (a.direction, a.confirmed, a.place, a.leave, a.stretch, a.in_zone, a.n_strokes, a.n_zones, a.last_zone_finished) == ("down", True, "above", None, 1.5, False, 5, 1, True)
    assert (b.direction, b.place, b.stretch, b.in_zone, b.n_strokes, b.n_zones, b.last_zone_finished) == (None, None, None, False, 0, 0, False)
    tags = structure.zone_tags(moves, areas)
    assert sorted(r.tag for r in tags.collect()) == ["buy2", "buy3"] and structure.newest_tag(tags).first().tag == "buy3"
    # the same stroke up: it leaves the zone
    rising = frame(spark, {"A": [9, 9.5, *zigzag(turns[:6]), 17, 16.8]})
    up = structure.summary(rising, structure.strokes(rising), structure.zones(structure.strokes(rising))).first()
    assert (up.direction, up.place, up.leave, up.stretch) == ("up", "above", "up", 3.75)


def test_newest_tag(spark):
    rows = [("A", "buy1", 0), ("A", "sell3", 2), ("A", "buy3", 1), ("B", "sell2", 0), ("B", None, 1), ("C", None, 0)]
    got = structure.newest_tag(spark.createDataFrame(rows, "symbol string, tag string, seen int")).collect()
    assert {r.symbol: r.tag for r in got} == {"A": "buy3", "B": "sell2"}


def test_scores_and_flags(spark):
    day = spark.createDataFrame([("A", "up", True, None, None, "", True), ("B", "down", True, "below", "sell2", "top", False)], "symbol string, direction string, confirmed boolean, place string, tag string, divergence string, in_zone boolean")
    week = spark.createDataFrame([("B", "up"), ("C", "up")], "symbol string, direction string")
    assert {r.symbol: r.structure_score for r in relations.structure_score(day, week).collect()} == {"A": 67, "B": 2, "C": 50}
    c = F.col
    rows = spark.createDataFrame([("A", 60.0, 80.0, 50, True, "strong", "breakout", True), ("B", 60.0, 80.0, 50, False, "strong", "none", True), ("C", 60.0, None, 50, True, None, "exhaustion", None)], "symbol string, b double, r double, s int, p boolean, e string, g string, l boolean")
    adds = relations.pattern_adjustment(c("e"), c("g"), c("l"))
    parts = (c("b"), c("r"), c("s"), c("p"))
    got = rows.select("symbol", relations.combined_score(*parts).alias("m"), relations.combined_score(*parts, factor=(F.lit(1.1), F.lit(4.0), F.lit(0.0)), patterns=adds).alias("a"), relations.combined_score(*parts, mixed=False).alias("o")).collect()
    assert {r.symbol: (r.m, r.a, r.o) for r in got} == {"A": (63.0, 85.3, 60.0), "B": (0.0, 0.0, 60.0), "C": (43.0, 45.3, 60.0)}
    stored = [("A", 1.0, 8.0, 10.0, "sideways"), ("B", 1.0, 9.5, 10.0, "buy flat"), ("C", 1.0, 9.5, 10.0, None), ("D", None, 5.0, 10.0, None), ("E", 2.0, 5.0, 10.0, None)]
    chips = relations.chip_flags(spark.createDataFrame(stored, "symbol string, turnover_20 double, price double, high_120 double, platform_state string")).collect()
    assert {r.symbol: (r.chip_low, r.chip_quiet, r.chip_low_unknown) for r in chips} == {"A": (True, False, False), "B": (True, False, False), "C": (False, True, False), "D": (False, False, True), "E": (False, False, False)}
    flags = spark.createDataFrame([("A", True, None, "strong", True, "exhaustion", True, "rally", "pullback", False), ("B", None, None, None, None, None, None, None, None, True)], "symbol string, platform_signal boolean, true_resonance boolean, engulfing string, gap_up boolean, gap_type string, low_ground boolean, stage string, quality string, chip_low boolean")
    found = {r.symbol: r for r in relations.classify(flags).collect()}
    assert found["A"].labels == ["band break", "strong engulfing", "exhaustion gap", "low ground volume", "stage rally", "pullback confirmed"] and found["A"].breakout_confirm and not found["A"].true_resonance
    assert found["B"].labels == ["chips low"] and not found["B"].has_breakout


def test_tables_read_single_fields_of_stored_results(spark, tmp_path):
    block = lambda *names: F.struct(*(F.lit(True).alias(n) for n in names))
    nested = spark.range(3).select(
        F.concat(F.lit("S"), "id").alias("symbol"), F.lit(DAY).alias("dt"), F.struct(F.lit("x").alias("name"), F.lit(True).alias("up")).alias("sector"), F.struct(F.lit(1.5).alias("final_score"), F.lit(None).cast("string").alias("advice"), F.lit(True).alias("yearline_pass"), F.lit(None).cast("boolean").alias("anchored"), F.lit(False).alias("po5_fan5"), F.lit(True).alias("main_wave")).alias("signal"),
        block(*results.BLOCKS["yearline"]).alias("yearline"), F.struct(*(F.lit(False).alias(c) for c in rules.CHECKS), F.lit(3).alias("checks_met"), F.lit("watch").alias("checks_verdict")).alias("checklist"),
        F.struct(F.lit(16.0).alias("turnover_20"), F.lit(0.1234).alias("price_pos"), F.lit(True).alias("chip_low"), F.lit(False).alias("chip_quiet"), F.lit(False).alias("chip_low_unknown")).alias("chips"), F.struct(F.struct(F.lit(1).alias("ma5")).alias("ma")).alias("technical"), (F.col("id") == 2).alias("is_index"),
    )
    nested.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    stocks, indexes = results.split_rows(results.scan_table(stored))
    row = stocks.orderBy("symbol").first()
    assert (row.score, row.advice, row.yearline_pass, row.anchored, row.po5_fan5, row.checks_met, row.chip_low, row.turnover_tag, row.style_tag, row.below_high_pct, row.year_arranged, row.wave_rsi_strong) == (1.5, "", "yes", "", "no", 3, "yes", "other", "mixed", 12.3, "yes", "no")
    assert stocks.count() == 2 and [r.symbol for r in indexes.collect()] == ["S2"]
    plan = results.scan_table(stored).select("symbol", "score", "chip_low")._jdf.queryExecution().executedPlan().toString()
    assert "signal:struct<final_score:double>" in plan and "chips:struct<chip_low:boolean>" in plan and "technical" not in plan and "checklist" not in plan
    assert not {"technical", "checklist"} & set(results.slim(stored).columns)
    jobs = spark.createDataFrame([("board", ["A"], None, 5), ("scan", ["A"], [], 5), ("scan", [], [], 5), ("scan", None, None, 5), ("scan", None, None, 0), (None, None, None, None)], "scan_type string, watchlist array<string>, universe array<string>, row_limit int")
    assert [r.scope for r in results.scan_scope(jobs).collect()] == ["board", "watchlist", "sector", "limit", "full", "full"]
