"""Rules over enriched bars; each adds columns for every date, so the newest row of a symbol is its verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.functions.windows import before, lag, last, ratio, so_far, sql_round
from quantloom.operators import quality


def known_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def yearline_filter(bars: DataFrame) -> DataFrame:
    """Seven checks and their verdict: an unknown ma250 fails, an unknown ma60 is passed over."""
    year, close = F.col("ma250"), F.col("close")
    pairs = [(F.col(a) <= F.col(b)) for a, b in (("ma5", "ma10"), ("ma10", "ma20"), ("ma20", "ma60"))]
    order = F.coalesce(F.col("arrangement") == 1, ~reduce(lambda x, y: x | y, (known_true(p) for p in pairs)))
    checks = {"above_ma250": known_true(close >= year), "above_ma60": known_true(close >= F.col("ma60")), "arranged": order}
    checks |= {f"{m}_above_ma250": known_true(F.col(m) > year) for m in ("ma5", "ma10", "ma20", "ma60")}
    over_year = reduce(lambda x, y: x & y, (checks[f"{m}_above_ma250"] for m in ("ma5", "ma10", "ma20", "ma60")))
    passed = checks["above_ma250"] & (checks["above_ma60"] | F.col("ma60").isNull()) & order & over_year
    return bars.withColumns(checks | {"yearline_pass": passed})


def weekly_anchor(weeks: DataFrame, lookback: int = 60) -> DataFrame:
    """For every week: close above the mean of the last min(lookback, weeks) closes, which has not fallen for three weeks."""
    n = F.count(F.lit(1)).over(so_far())
    mean = F.avg("close").over(last(lookback))
    # while there are fewer weeks than the window, only the newest full mean exists, so there is no slope
    weeks = weeks.withColumns({"_n": n, "ma_w": mean})
    slope = F.when(F.col("_n") >= lookback + 3, F.col("ma_w") - lag("ma_w", 3)).otherwise(0.0)
    weeks = weeks.withColumn("ma_w_slope", slope)
    return weeks.withColumn("anchored", (F.col("_n") >= 10) & (F.col("close") > F.col("ma_w")) & (F.col("ma_w_slope") >= -1e-9)).drop("_n")


def break_and_return(bars: DataFrame, lookback: int = 5) -> DataFrame:
    """Back above ma5 at most two bars after a close under it, with ma20 rising over two bars."""
    bars = bars.withColumn("_rn", F.count(F.lit(1)).over(so_far()))
    since = F.col("_rn") - F.max(F.when(F.col("close") < F.col("ma5"), F.col("_rn"))).over(last(lookback))
    slope = F.col("ma20") - lag("ma20", 2)
    back = F.when(F.col("close") > F.col("ma5"), since)
    return bars.withColumns({"days_since_break": back, "po5_fan5": known_true((back <= 2) & (slope > 0))}).drop("_rn")


def main_wave_signal(bars: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """``main_wave`` on bars with yearline_pass and po5_fan5: the year line passed, the symbol's week anchored (``anchors``: symbol,
    anchored; passed over without such a frame, false without a row), and the close above ma5 or just returned to it."""
    if anchors is None:
        bars = bars.withColumn("anchored", F.lit(True))
    else:
        bars = bars.drop("anchored").join(anchors.select("symbol", "anchored"), "symbol", "left").withColumn("anchored", known_true(F.col("anchored")))
    over5 = known_true(F.col("close") > F.col("ma5"))
    return bars.withColumns({"over_ma5": over5, "main_wave": F.col("yearline_pass") & F.col("anchored") & (over5 | F.col("po5_fan5"))})


def technical_detail(bars: DataFrame) -> DataFrame:
    """The return above ma5 on volume, the band of the mean turnover of up to 20 bars, and whether turnover falls within them.

    A mean of 0 or none at all is missing, not dense.
    """
    returned = (lag("close") < lag("ma5")) & (F.col("close") > F.col("ma5")) & (F.col("volume_ratio") > 1.5)
    bars = bars.withColumns({"returned_to_ma5": known_true(returned), "_turns": F.collect_list(F.struct("turn")).over(last(20))})

    def mean(rows: Column) -> Column:
        known = F.filter(rows, lambda x: x["turn"].isNotNull())
        return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x["turn"]), F.size(known))

    exact = mean(F.col("_turns"))
    # rounded, so that a mean at the edge of a band does not depend on the order of adding
    level = sql_round(exact, 9)
    band = F.when(level.isNull() | (level <= 0), "missing").when(level < 2, "dense").when(level < 5, "fairly dense").when(level < 10, "loose").otherwise("very loose")
    # means that differ by the order of adding alone are equal
    late, early = sql_round(mean(F.slice("_turns", -F.least(F.lit(10), F.size("_turns")), F.lit(10))), 9), sql_round(mean(F.slice("_turns", 1, 10)), 9)
    known = (level > 0) & (F.size("_turns") >= 10) & late.isNotNull() & early.isNotNull()
    trend = F.when(~known_true(known), "unknown").when(late < early, "gathering").otherwise("spreading")
    return bars.withColumns({"chip_turn": F.when(level > 0, exact), "chip_band": band, "chip_trend": trend}).drop("_turns")


def breakout_quality(bars: DataFrame, lookback: int = 60, near: float = 1.02, support: float = 0.985) -> DataFrame:
    """Per symbol of platform() bars the newest breakout of the last ``lookback`` bars, its upper band and what became of it:
    none, false (a later close under ``support`` of the band), pullback (a later close at most ``near`` of it), direct."""
    order = F.struct("dt")
    ranked = bars.withColumn("_left", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt"))))
    marks = F.when((F.col("_left") <= lookback) & F.col("breakout"), F.struct("dt", "upper"))
    ranked = ranked.withColumn("_at", F.max(marks).over(Window.partitionBy("symbol")))
    after = F.when(F.col("dt") > F.col("_at.dt"), F.col("close"))
    made = ranked.groupBy("symbol").agg(F.max("_at").alias("_at"), F.min(after).alias("least_after"), F.max(order).alias("_last"))
    level = F.col("_at.upper")
    quality = F.when(F.col("_at").isNull(), "none").when(F.col("least_after") < level * support, "false").when(F.col("least_after") <= level * near, "pullback").otherwise("direct")
    return made.select("symbol", F.col("_last.dt").alias("dt"), F.col("_at.dt").alias("breakout_dt"), level.alias("support"), "least_after", quality.alias("quality"))


def box_place(close: Column, top: Column, bottom: Column, near: float = 0.02) -> Column:
    return (
        F.when(close > top * (1 + near), "above top").when(close >= top * (1 - near), "near top").when(close < bottom * (1 - near), "below bottom")
        .when(close <= bottom * (1 + near), "near bottom").when(top.isNotNull(), "inside").otherwise("unknown")
    )


def period_box(bars: DataFrame, unit: str, lookback: int = 20, least: int = 5) -> DataFrame:
    """``bars`` with the box of the last ``lookback`` weeks or months as each day sees it: full periods before its own, and its own
    one up to that day. Adds <unit>_top, <unit>_bottom and <unit>_box (the state; unknown before ``least`` periods).

    One row for each period is joined by (symbol, period); no day meets the other days of its symbol for that.
    """
    label = F.date_add(F.date_trunc("week", "dt").cast("date"), 4) if unit == "week" else F.last_day("dt")
    rows = bars.withColumn("_period", label)
    periods = rows.where(F.dayofweek("dt").between(2, 6) & F.col("close").isNotNull()).groupBy("symbol", "_period").agg(
        F.max("high").alias("_h"), F.min("low").alias("_l"), F.max_by("close", "dt").alias("_c"), F.count(F.lit(1)).alias("_n")
    )
    # periods with too few bars do not count once they are over
    periods = periods.withColumn("_full", F.col("_n") >= quality.LEAST_BARS[unit])
    full = Window.partitionBy("symbol", "_full").orderBy("_period").rowsBetween(-(lookback - 2), 0)
    periods = periods.withColumn("_box", F.when(F.col("_full"), F.struct(F.max("_h").over(full).alias("top"), F.min("_l").over(full).alias("bottom"), F.col("_c").alias("close"))))
    earlier = Window.partitionBy("symbol").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    periods = periods.select("symbol", "_period", F.last("_box", ignorenulls=True).over(earlier).alias("_box"), F.count_if("_full").over(earlier).alias("_before"))
    own = Window.partitionBy("symbol", "_period").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_top": F.max("high").over(own), "_bottom": F.min("low").over(own)}).join(periods, ["symbol", "_period"], "left")
    known = F.coalesce("_before", F.lit(0)) + 1 >= least
    rows = rows.withColumns({f"{unit}_top": F.when(known, F.greatest("_top", "_box.top")), f"{unit}_bottom": F.when(known, F.least("_bottom", "_box.bottom"))})
    place = box_place(F.col("close"), F.col(f"{unit}_top"), F.col(f"{unit}_bottom"))
    state = (
        F.when(place == "above top", F.when(F.col("_box.close") <= F.col(f"{unit}_top"), "breaks out").otherwise("above top"))
        .when(place == "near top", "tests top").when(place == "near bottom", "falls to bottom").when(place == "below bottom", "breaks down").otherwise(place)
    )
    return rows.withColumn(f"{unit}_box", state).drop("_period", "_top", "_bottom", "_box", "_before")


def platform_rule(bars: DataFrame, amplitude: float = 15.0, boost: float = 1.5, near: float = 5.0) -> DataFrame:
    """The platform's verdict on every date, of bars with adaptive_platform(), ma20, volume_ratio and macd_cross.

    The adaptive bands come first: a break above them confirms, else they say sideways. Then, where the last 20 bars (ten at
    least) stay within ``amplitude`` percent, the state is sideways again (a signal given before stays), unless the close is
    above ma20 on volume with a golden cross, which confirms; or, without any signal, so near the box's bottom that it may be
    bought. platform_top and platform_bottom are the bands, else the box of 20 bars.
    """
    top, bottom = F.max("high").over(last(20)), F.min("low").over(last(20))
    bars = bars.withColumns({"box_top": top, "box_bottom": bottom, "_mean": F.avg("close").over(last(20)), "_n": F.count(F.lit(1)).over(so_far())})
    narrow = known_true((F.col("_n") >= 10) & (F.col("_mean") > 0) & ((F.col("box_top") - F.col("box_bottom")) / F.col("_mean") * 100 < amplitude))
    above = narrow & known_true(F.col("close") > F.col("ma20"))
    confirmed = above & known_true((F.col("volume_ratio") > boost) & (F.col("macd_cross") == 1))
    signal = F.col("breakout") | confirmed
    flat = above & ~signal & known_true((F.col("close") - F.col("box_bottom")) / F.col("box_bottom") * 100 < near)
    state = F.when(confirmed, "confirmed").when(flat, "buy flat").when(narrow, "sideways").when(F.col("breakout"), "confirmed").when(F.col("poc").isNotNull(), "sideways").otherwise("unknown")
    rows = bars.withColumns({"platform_signal": signal, "buy_flat": flat, "platform_state": state})
    return rows.withColumns({"platform_top": F.coalesce("upper", "box_top"), "platform_bottom": F.coalesce("lower", "box_bottom")}).drop("_mean", "_n")


CHECKS = ("long_sideways", "ma60_rising", "breaks_platform", "double_volume", "held_and_golden", "rsi_strong", "money_flows", "sector_strong")


def main_wave_checklist(bars: DataFrame, sector_up: Column | None = None) -> DataFrame:
    """Eight checks of a main wave on every date (CHECKS), how many hold, their share and the verdict, of bars with ma60, macd,
    macd_signal and rsi. What is not known does not hold; ``sector_up`` is the sector's trend, if there is one."""
    n = F.count(F.lit(1)).over(so_far())
    at = lambda k: n >= k
    width = lambda k: (F.max("high").over(last(k)) - F.min("low").over(last(k))) / F.when(F.avg("close").over(last(k)) > 0, F.avg("close").over(last(k))) * 100
    golden = (F.col("macd") > F.col("macd_signal")) & ((lag("macd") <= lag("macd_signal")) | (F.abs("macd") < F.col("close") * 0.01))
    bottom = F.min("low").over(last(20))
    held = (bottom > 0) & (lag("low") >= bottom * 0.98)
    rises = lambda k: F.when(known_true(lag("close", k) / lag("close", k + 1) > 1) if k else known_true(F.col("close") / lag("close") > 1), 1).otherwise(0)
    values = [
        at(60) & (width(60) < 25), at(65) & (F.col("ma60") - lag("ma60", 5) > 0), at(21) & (F.col("close") >= F.max("high").over(last(20))),
        at(21) & (F.col("volume") / F.when(F.avg("volume").over(last(20)) > 0, F.avg("volume").over(last(20))) >= 2), at(2) & held & golden,
        at(6) & (F.col("rsi") > 50) & (F.col("rsi") >= lag("rsi", 5)), at(4) & (rises(0) + rises(1) + rises(2) >= 2), sector_up if sector_up is not None else F.lit(False),
    ]
    rows = bars.withColumns({c: known_true(v) for c, v in zip(CHECKS, values, strict=True)})
    met = reduce(lambda a, b: a + b, (F.col(c).cast("int") for c in CHECKS))
    rows = rows.withColumn("checks_met", met).withColumn("checks_share", F.col("checks_met") / len(CHECKS))
    verdict = F.when(F.col("checks_met") >= 6, "likely").when(F.col("checks_met") >= 4, "possible").when(F.col("checks_met") >= 2, "watch").otherwise("not yet")
    return rows.withColumn("checks_verdict", verdict)


def comprehensive_signal(rows: DataFrame) -> DataFrame:
    """final_score and advice from score, true_resonance, level, yearline_pass and main_wave: 0 where the year line is not passed
    (nothing revives such a row), else six tenths of the resonance score and 16 points for a main wave."""
    passed, wave, real = known_true(F.col("yearline_pass")), known_true(F.col("main_wave")), known_true(F.col("true_resonance"))
    score = F.when(passed, F.bround(F.coalesce("score", F.lit(0.0)) * 0.6 + F.when(wave, 40 * 0.4).otherwise(0.0), 1)).otherwise(0.0)
    by_level = F.when(F.col("level") == "second", "focus").when(F.col("level") == "first", "follow").otherwise("wait")
    advice = F.when(~passed, "wait: year line not passed").when(real & wave, "focus strongly: true resonance in a main wave").when(real, "focus: true resonance").when(wave, "follow: main wave").otherwise(by_level)
    return rows.withColumns({"final_score": score, "advice": advice, "signal_main_wave": passed & wave, "signal_true_resonance": passed & real})


def main_wave_state(bars: DataFrame) -> DataFrame:
    """holding, refuel, strong or watch."""
    over5 = known_true(F.col("close") > F.col("ma5"))
    holding = over5 & (F.count(F.when(over5, 1)).over(last(5)) >= 3)
    n = F.count(F.lit(1)).over(so_far())
    known = F.col("ma5").isNotNull()
    first = F.first("ma5", ignorenulls=True).over(last(5))
    slope = F.when((n >= 5) & (F.count("ma5").over(last(5)) >= 2) & known, (F.col("ma5") - first) / 4).otherwise(0.0)
    amplitude = F.when((F.col("close") > F.col("ma20")) & (n >= 10), (F.max("high").over(last(20)) - F.min("low").over(last(20))) / F.avg("close").over(last(20)) * 100)
    refuel = known_true((amplitude < 15) & (F.col("volume_ratio") < 1))
    bars = bars.withColumns({"_holding": holding, "_refuel": refuel, "ma5_slope4": slope, "amplitude20": amplitude})
    state = F.when(F.col("_holding"), "holding").when(F.col("_refuel"), "refuel").when(F.col("ma5_slope4") > 0, "strong").otherwise("watch")
    return bars.withColumn("wave_state", state).drop("_holding", "_refuel")


def price_view(bars: DataFrame) -> DataFrame:
    """5- and 20-bar changes, distance from ma250, whether the averages stand in order."""
    return bars.withColumns(
        {
            "chg5": (ratio(F.col("close"), lag("close", 5)) - 1) * 100,
            "chg20": (ratio(F.col("close"), lag("close", 20)) - 1) * 100,
            "above_year": F.col("close") > F.col("ma250"),
            "year_distance": (ratio(F.col("close"), F.col("ma250")) - 1) * 100,
            "in_order": (F.col("ma5") >= F.col("ma10")) & (F.col("ma10") >= F.col("ma20")) & (F.col("ma20") >= F.col("ma60")),
        }
    )


def anchor_environment(bars: DataFrame) -> DataFrame:
    """Two anchors of a market: above ma250, and ma5 > ma20 > ma60 > ma250; unknown while one average is."""
    above = F.col("close") > F.col("ma250")
    ordered = (F.col("ma5") > F.col("ma20")) & (F.col("ma20") > F.col("ma60")) & (F.col("ma60") > F.col("ma250"))
    verdict = F.when(above.isNull() | ordered.isNull(), "unknown").when(above & ordered, "bull").when(~above, "warn").otherwise("mixed")
    return bars.withColumn("environment", verdict)


def market_position() -> Column:
    """high, low or middle of the last 120 closes; unknown before or when flat."""
    top, bottom = F.max("close").over(last(120)), F.min("close").over(last(120))
    place = (F.col("close") - bottom) / F.when(top > bottom, top - bottom)
    enough = F.count("close").over(last(120)) == 120
    return F.when(~enough | place.isNull(), "unknown").when(place >= 0.85, "high").when(place <= 0.15, "low").otherwise("middle")


def market_leg(bars: DataFrame, basis: str = "ma", boost: float = 1.5) -> DataFrame:
    """Direction of the market: ``ma`` (both ma20 and ma60), ``yearline`` (ma250 and order) or ``volume_break``.

    The 20-day change counts from the close 19 bars back.
    """
    close, ma20, ma60 = F.col("close"), F.col("ma20"), F.col("ma60")
    sides = [F.when(m.isNull(), "unknown").when(close > m, "above").otherwise("below") for m in (ma20, ma60)]
    bars = bars.withColumns({"ma20_side": sides[0], "ma60_side": sides[1], "position": market_position(), "chg20": (ratio(close, lag("close", 19)) - 1) * 100})
    both = lambda side: (F.col("ma20_side") == side) & (F.col("ma60_side") == side)
    n = F.count(F.lit(1)).over(so_far())
    if basis == "ma":
        trend = F.when(n < 60, "unknown").when(both("above"), "up").when(both("below"), "down").otherwise("swing")
    elif basis == "yearline":
        ordered = (F.col("ma5") > ma20) & (ma20 > ma60) & (ma60 > F.col("ma250"))
        trend = F.when(F.col("ma250").isNull(), "unknown").when(close <= F.col("ma250"), "down").when(ordered, "up").otherwise("swing")
    elif basis == "volume_break":
        mean = F.avg("volume").over(before(5))
        broke = (close > lag("close")) & (mean > 0) & (F.col("volume") >= mean * boost) & (F.col("volume") > mean)
        trend = F.when(n < 6, "unknown").when(broke, "up").when(both("below"), "down").otherwise("swing")
    else:
        raise ValueError(f"no such basis: {basis}")
    return bars.withColumn("market_trend", trend)


def sector_score(bars: DataFrame) -> DataFrame:
    """0 to 25 from the distance to the mean of 20 closes, the change over 9 bars, and the last five amounts by the last 20;
    12.5 before 20 bars. Bars without close or amount are left out first."""
    bars = bars.where(F.col("close").isNotNull() & F.col("amount").isNotNull())
    mean = F.avg("close").over(last(20))
    clip = lambda x, top: F.least(F.lit(top), F.greatest(F.lit(0.0), x))
    bias = clip(F.coalesce(ratio(F.col("close") - mean, mean), F.lit(0.0)) * 100 + 5.0, 10.0)
    change = clip(F.coalesce(ratio(F.col("close"), lag("close", 9)) - 1, F.lit(0.0)) * 100 + 3.75, 7.5)
    money = clip(F.avg("amount").over(last(5)) / (F.avg("amount").over(last(20)) + 1e-6) * 3.75, 7.5)
    enough = F.count(F.lit(1)).over(so_far()) >= 20
    bars = bars.withColumn("sector_score", F.when(enough, bias + change + money).otherwise(12.5))
    return bars.withColumn("sector_up", F.col("sector_score") > 12.5)


def capital_activity(bars: DataFrame, least_score: float = 8.0, least_ratio: float = 1.5) -> DataFrame:
    """Score up to 20 from volume and amount against the five bars before, and the turnover; 0 before six bars."""
    enough = F.count(F.lit(1)).over(so_far()) >= 6
    by_volume = F.col("volume") / (F.avg("volume").over(before(5)) + 1e-8)
    by_amount = ratio(F.col("amount"), F.avg("amount").over(before(5)))
    score = F.when(by_volume >= 1.8, 12).when(by_volume >= 1.5, 8).otherwise(0) + F.when(by_amount >= 1.6, 5).otherwise(0) + F.when(F.col("turn") >= 3, 3).otherwise(0)
    bars = bars.withColumns({"capital_ratio": F.when(enough, by_volume).otherwise(0.0), "capital_score": F.when(enough, F.least(score, F.lit(20))).otherwise(0)})
    return bars.withColumn("capital_active", enough & ((F.col("capital_score") >= least_score) | (F.col("capital_ratio") >= least_ratio)))


GATES = ("score_reached", "capital_active", "market_up", "sector_up", "stock_strict", "market_not_high")


def resonance_score(rows: DataFrame, threshold: float = 85.0, high_gate: str = "hard") -> DataFrame:
    """Score, gates, reasons and level from stock_strict, market_trend, position, sector_up, capital_score, capital_active."""
    market_up, high = F.col("market_trend") == "up", F.col("position") == "high"
    legs = F.when(F.col("stock_strict"), 30).otherwise(0) + F.when(market_up, 25).otherwise(0) + F.when(F.col("sector_up"), 25).otherwise(0) + F.col("capital_score")
    score = F.when(high, F.greatest(F.lit(0), legs - 15)).otherwise(legs) if high_gate != "off" else legs
    rows = rows.withColumn("score", score.cast("double"))
    values = (F.col("score") >= threshold, F.col("capital_active"), market_up, F.col("sector_up"), F.col("stock_strict"), ~high if high_gate == "hard" else F.lit(True))
    gates = F.create_map(*(x for g, v in zip(GATES, values, strict=True) for x in (F.lit(g), known_true(v))))
    rows = rows.withColumn("gates", gates).withColumn("reasons", F.map_keys(F.map_filter("gates", lambda k, v: ~v))).withColumn("true_resonance", F.size("reasons") == 0)
    level = F.when(F.col("true_resonance"), "true resonance").when(F.col("score") >= 70, "second").when(F.col("score") >= 45, "first").otherwise("none")
    return rows.withColumn("level", level)


def period_direction(bars: DataFrame, back: int = 20) -> DataFrame:
    """bull, bear or neutral from ma5, ma10, ma20, and the slope of ma20 over ``back`` bars in percent."""
    bull, bear = (F.col("ma5") > F.col("ma10")) & (F.col("ma10") > F.col("ma20")), (F.col("ma5") < F.col("ma10")) & (F.col("ma10") < F.col("ma20"))
    slope = ratio(F.col("ma20") - lag("ma20", back), lag("ma20", back)) * 100
    return bars.withColumns({"direction": F.when(bull, "bull").when(bear, "bear").when(F.col("ma20").isNotNull(), "neutral"), "ma20_slope_pct": slope})


def period_trend(bars: DataFrame) -> DataFrame:
    """trend of every bar of a period: bull where ma5, ma10 and ma20 fall in order, other, or short before 20 bars."""
    ma = {n: F.when(F.count("close").over(last(n)) == n, F.avg("close").over(last(n))) for n in (5, 10, 20)}
    return bars.withColumn("trend", F.when(ma[20].isNull(), "short").when((ma[5] > ma[10]) & (ma[10] > ma[20]), "bull").otherwise("other"))


def turnover_tag(turn: Column) -> Column:
    """Band of a turnover in percent; bands that no one named are ``other``."""
    return F.when(turn.isNull() | (turn <= 0), "unknown").when(turn >= 70, "flee").when(turn >= 25, "heavy").when(turn.between(8, 15), "inflow").when(turn.between(3, 5), "absorb").otherwise("other")


def style_tag(turn: Column, passed: Column, main_wave: Column) -> Column:
    """sentiment (turnover from 15), trend (year line passed or main wave), mixed or unknown."""
    lively, trend = known_true(turn >= 15), known_true(passed) | known_true(main_wave)
    return F.when(lively & trend, "mixed").when(lively, "sentiment").when(trend, "trend").otherwise("unknown")


def derived_turnover(volume: Column, float_shares: Column) -> Column:
    """Percent of the float that changed hands, four decimals; NULL outside 0 to 80."""
    t = sql_round(ratio(volume * 100, float_shares), 4)
    return F.when((t > 0) & (t < 80), t)


def three_resonance(rows: DataFrame) -> DataFrame:
    """``rows`` (newest bars with all legs) with the loose stock leg, the market's leg, and three_resonance: the strict stock leg with
    sector and market. The loose leg is for show only."""
    loose = known_true(F.col("arrangement") == 1) | known_true(F.col("close") > F.col("ma20"))
    market = known_true(F.col("market_trend") == "up")
    rows = rows.withColumns({"stock_loose": loose, "market_up": market})
    return rows.withColumn("three_resonance", F.col("yearline_pass") & F.col("stock_loose") & known_true(F.col("sector_up")) & F.col("market_up"))


def nested_result(rows: DataFrame) -> DataFrame:
    """One row per symbol as a scan stores it: symbol, dt and the structs stock, market, sector, capital, resonance. Readers that
    select single fields read only these from Parquet."""
    return three_resonance(rows).select(
        "symbol", "dt",
        F.struct("close", "yearline_pass", "stock_loose", "stock_strict").alias("stock"),
        F.struct("market_trend", "market_up", "position").alias("market"),
        F.struct(F.col("sector").alias("name"), F.col("sector_up").alias("up")).alias("sector"),
        F.struct("capital_score", F.col("capital_active").alias("active")).alias("capital"),
        F.struct("score", "three_resonance", "true_resonance", F.col("options") if "options" in rows.columns else options().alias("options")).alias("resonance"),
    )


def flat_result(nested: DataFrame) -> DataFrame:
    """A report's row of a nested result; labels stand for what is missing."""
    yes = lambda c: F.when(F.col(c), "yes").when(~F.col(c), "no").otherwise("-")
    named = {"yearline": "stock.yearline_pass", "strict": "stock.stock_strict", "sector_up": "sector.up", "market_up": "market.market_up", "active": "capital.active", "three": "resonance.three_resonance", "true_three": "resonance.true_resonance"}
    label = lambda c: F.coalesce(c, F.lit("-"))
    return nested.select("symbol", "dt", label("sector.name").alias("sector"), label("market.position").alias("position"), F.col("resonance.score").alias("score"), *(yes(c).alias(n) for n, c in named.items()))


STORED_GATES = ["score_ok", "capital_active", "market_up", "industry_up", "stock_strict", "market_not_high"]


def options(market_mode: str = "ma", true_threshold: float = 85.0, high_position_gate: str = "hard", capital_min_score: float = 8.0, capital_min_volume_ratio: float = 1.5, index_max_lag_days: float | None = None, volume_boost_ratio: float = 1.5) -> Column:
    """The options of an evaluation, as a result stores them."""
    number = lambda v: F.lit(v).cast("double")
    return F.struct(
        F.lit(market_mode).alias("market_mode"), number(true_threshold).alias("true_threshold"), number(capital_min_score).alias("capital_min_score"), number(capital_min_volume_ratio).alias("capital_min_volume_ratio"),
        number(index_max_lag_days).alias("index_max_lag_days"), F.lit(high_position_gate).alias("high_position_gate"), number(volume_boost_ratio).alias("volume_boost_ratio"),
    )


def stored(nested: DataFrame, path: str, kind: str) -> Column:
    """A field of a stored result, NULL where results of its time had no such field."""
    at = nested.schema
    for name in path.split("."):
        if not isinstance(at, StructType) or name not in at.names:
            return F.lit(None).cast(kind)
        at = at[name].dataType
    return F.col(path).cast(kind)


def row_gates(nested: DataFrame, force_hard: bool = False) -> DataFrame:
    """symbol and the six gates of a stored result: true, false, or NULL where the result does not say.

    Threshold and gate mode are those that the row itself was made with: without a threshold it is unknown whether the score
    reaches it; without a mode the gate is hard. Under ``soft`` and ``off`` the high-position gate is open, unless
    ``force_hard`` derives it anew.
    """
    score = stored(nested, "resonance.score", "double") >= stored(nested, "resonance.options.true_threshold", "double")
    mode = F.lower(F.trim(F.coalesce(stored(nested, "resonance.options.high_position_gate", "string"), F.lit("hard"))))
    high = F.when(F.col("resonance").isNull(), F.lit(None).cast("boolean")).when(F.lit(not force_hard) & mode.isin("soft", "off"), F.lit(True)).otherwise(F.col("market.position") != "high")
    values = [score, F.col("capital.active"), F.col("market.market_up"), F.col("sector.up"), F.col("stock.stock_strict"), high]
    return nested.select("symbol", *(v.alias(n) for n, v in zip(STORED_GATES, values, strict=True)))


def effective_options(nested: DataFrame) -> DataFrame:
    """One row: the options that the results were made with, of the first symbol that stores any; no row where none does. Results
    older than a field get what held then: the hard gate, a boost of 1.5."""
    kinds = {"market_mode": "string", "true_threshold": "double", "capital_min_score": "double", "capital_min_volume_ratio": "double", "index_max_lag_days": "double", "high_position_gate": "string", "volume_boost_ratio": "double"}
    old = {"high_position_gate": F.lit("hard"), "volume_boost_ratio": F.lit(1.5)}
    fields = [F.coalesce(v, old[c]).alias(c) if c in old else v.alias(c) for c, k in kinds.items() for v in [stored(nested, f"resonance.options.{c}", k)]]
    known = nested.where(F.coalesce(*(stored(nested, f"resonance.options.{c}", "string") for c in kinds)).isNotNull())
    return known.agg(F.min_by(F.struct(*fields), "symbol").alias("o")).where("o is not null").select("o.*")


def market_leg_snapshot(nested: DataFrame) -> DataFrame:
    """One row: the market's leg that all results of a job share, of the first symbol with a resonance; defaults without any."""
    fields = {
        "market_up": F.coalesce(stored(nested, "market.market_up", "boolean"), F.lit(False)), "position": F.coalesce(stored(nested, "market.position", "string"), F.lit("unknown")),
        "lag_days": stored(nested, "market.lag_days", "long"), "downgraded": F.coalesce(stored(nested, "market.downgraded", "boolean"), F.lit(False)), "market_mode": stored(nested, "resonance.options.market_mode", "string"),
    }
    first = nested.where("resonance is not null").agg(F.min_by(F.struct(*(v.alias(c) for c, v in fields.items())), "symbol").alias("m"))
    return first.select(F.coalesce("m.market_up", F.lit(False)).alias("market_up"), F.coalesce("m.position", F.lit("unknown")).alias("position"), "m.lag_days", F.coalesce("m.downgraded", F.lit(False)).alias("downgraded"), "m.market_mode")
