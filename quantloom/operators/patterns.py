"""Candlestick and chart patterns as columns: true on the bar that completes the pattern.

A detector is a function without arguments that gives a boolean column over bars with ``rn`` (bar number in its symbol,
from 1). DETECTORS maps codes to them; users add their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import SYMBOL, lag, last, ratio, rolling_mean, series, so_far, sql_round
from quantloom.operators.indicators import latest

EPS = 1e-9
LOW_RETRACE, VOLUME_RATIO = 0.15, 1.5


class Bar:
    """The columns of the bar ``back`` bars ago."""

    def __init__(self, back: int = 0):
        of = (lambda c: lag(c, back)) if back else F.col
        self.open, self.high, self.low, self.close, self.volume = map(of, ("open", "high", "low", "close", "volume"))
        self.body = F.abs(self.close - self.open)
        self.range = self.high - self.low
        self.upper = F.greatest(self.high - F.greatest(self.open, self.close), F.lit(0.0))
        self.lower = F.greatest(F.least(self.open, self.close) - self.low, F.lit(0.0))
        self.up, self.down = self.close > self.open + EPS, self.close < self.open - EPS
        self.middle = (self.open + self.close) / 2


def change(n: int) -> Column:
    """Percent against the close ``n`` bars back, 0 where there is none."""
    return F.coalesce(ratio(F.col("close"), F.when(lag("close", n) > 0, lag("close", n))) - 1, F.lit(0.0)) * 100


def height(n: int) -> Column:
    """Place of the close in the range of up to ``n`` bars; 0.5 in a flat one."""
    low, high = F.min("low").over(last(n)), F.max("high").over(last(n))
    return F.when(high - low <= EPS, 0.5).otherwise((F.col("close") - low) / (high - low))


def mean_body(n: int, back: int) -> Column:
    """Mean body of the ``n`` bars that end ``back`` bars ago; 0 with fewer."""
    w = series().rowsBetween(-(n - 1) - back, -back)
    return F.when(F.count("close").over(w) == n, F.avg(F.abs(F.col("close") - F.col("open"))).over(w)).otherwise(0.0)


def two_up_one_down() -> Column:
    a, b, c = Bar(2), Bar(1), Bar()
    volume = F.when(b.volume > 0, c.volume / b.volume).otherwise(0.0)
    return a.up & b.down & c.up & (c.close > a.close) & (c.body >= b.body) & (b.low >= a.open - a.body * 0.5) & (volume >= 1)


def _long_upper(b: Bar) -> Column:
    return (b.upper >= 2 * b.body) & (b.upper >= 0.55 * b.range) & (b.body <= 0.35 * b.range) & (b.lower <= b.upper * 0.35 + EPS)


def pointing_up() -> Column:
    b, mean = Bar(), rolling_mean("close", 20)
    return _long_upper(b) & b.up & (change(20) > 0) & (change(20) < 15) & (height(60) < 0.85) & (b.close >= mean)


def shooting_star() -> Column:
    return _long_upper(Bar()) & ((change(20) >= 15) | (height(60) >= 0.85))


def morning_star() -> Column:
    a, b, c = Bar(2), Bar(1), Bar()
    return a.down & (a.body >= F.greatest(mean_body(10, 2), F.lit(EPS)) * 0.9) & (b.body <= a.body * 0.45) & (b.close <= a.close + EPS) & c.up & (c.close >= a.middle)


def evening_star() -> Column:
    a, b, c = Bar(2), Bar(1), Bar()
    return a.up & (a.body >= F.greatest(mean_body(10, 2), F.lit(EPS)) * 0.9) & (b.body <= a.body * 0.45) & (b.close >= a.close - EPS) & c.down & (c.close <= a.middle)


def three_soldiers() -> Column:
    a, b, c = Bar(2), Bar(1), Bar()
    steps = (b.open >= a.open) & (b.open <= a.close + EPS) & (c.open >= b.open) & (c.open <= b.close + EPS)
    return a.up & b.up & c.up & (a.close < b.close) & (b.close < c.close) & steps & (c.body <= a.body * 2.5)


def three_crows() -> Column:
    a, b, c = Bar(2), Bar(1), Bar()
    return a.down & b.down & c.down & (a.close > b.close) & (b.close > c.close)


def hammer() -> Column:
    b, mean = Bar(), rolling_mean("close", 5)
    shape = (b.lower >= 2 * b.body) & (b.lower >= 0.55 * b.range) & (b.body <= 0.35 * b.range) & (b.upper <= b.lower * 0.35 + EPS)
    return shape & (F.coalesce(b.close < mean, F.lit(False)) | (height(60) <= 0.25))


def bullish_engulfing() -> Column:
    y, t = Bar(1), Bar()
    return y.down & t.up & (t.open <= y.close + EPS) & (t.close >= y.open - EPS)


def bearish_engulfing() -> Column:
    y, t = Bar(1), Bar()
    return y.up & t.down & (t.open >= y.close - EPS) & (t.close <= y.open + EPS)


def gap_two_up_one_down() -> Column:
    """Two up, one down behind a gap that the down bar does not close."""
    before, a, b, c = Bar(3), Bar(2), Bar(1), Bar()
    return a.up & b.down & c.up & (a.low > before.high + EPS) & (c.close > a.close) & (c.body >= b.body) & (b.low >= before.high - EPS)


def two_down_between() -> Column:
    a, b, c, d = Bar(3), Bar(2), Bar(1), Bar()
    return a.up & b.down & c.down & d.up & (d.close > a.close) & (F.least(b.low, c.low) >= a.open - a.body * 0.5) & (a.volume > 0)


def stacked(ups: int = 3) -> Column:
    """``ups`` up bars with rising closes, a down bar between each two."""
    bars = [Bar(k) for k in reversed(range(2 * ups - 1))]
    found = bars[0].up
    for before, down, up in zip(bars[::2], bars[1::2], bars[2::2], strict=False):
        found = found & down.down & up.up & (up.close > before.close + EPS)
    return found


def gathering() -> Column:
    """Two small quiet bars in the upper part of a strong up bar, on the newest bar only; the next bar decides."""
    a, b, c = Bar(2), Bar(1), Bar()
    usual = F.avg("volume").over(series().rowsBetween(-7, -3))
    strong = (a.body >= F.greatest(mean_body(10, 3), F.lit(EPS)) * 1.3) & (ratio(a.volume, usual) >= 1.2)
    quiet = (F.greatest(b.body, c.body) <= a.body * 0.5) & (F.greatest(b.volume, c.volume) <= a.volume * 0.85)
    holds = (F.least(b.close, c.close) >= a.open + a.body * 0.3) & (F.least(b.low, c.low) >= a.low - a.range * 0.1)
    return F.lead(F.lit(1)).over(series()).isNull() & a.up & strong & quiet & holds


#: code -> (detector, direction, bars needed); hits of one day stand in this order. Codes, directions, bars.
DETECTORS: dict[str, tuple[Callable[[], Column], str, int]] = {
    "duofangpao": (two_up_one_down, "bull", 3),
    "xianrenzhilu": (pointing_up, "bull", 21),
    "zaochenzhixing": (morning_star, "bull", 3),
    "huanghunzhixing": (evening_star, "bear", 3),
    "hongsanbing": (three_soldiers, "bull", 3),
    "sanzhiwuya": (three_crows, "bear", 3),
    "chuitouxian": (hammer, "bull", 11),
    "shejizhixing": (shooting_star, "bear", 21),
    "kanzhangtunmo": (bullish_engulfing, "bull", 2),
    "kandietunmo": (bearish_engulfing, "bear", 2),
    "gap_duofangpao": (gap_two_up_one_down, "bull", 6),
    "liangyang_liangyin": (two_down_between, "bull", 5),
    "diedie_duofangpao": (stacked, "bull", 7),
    "duofangpao_pending": (gathering, "neutral", 8),
}


def candle_flags(bars: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """A boolean column for each code; false before the detector's number of bars."""
    bars = bars.withColumn("rn", F.count(F.lit(1)).over(so_far()))
    chosen = {c: DETECTORS[c] for c in (codes or DETECTORS)}
    return bars.withColumns({c: F.coalesce(find() & (F.col("rn") >= need), F.lit(False)) for c, (find, _, need) in chosen.items()})


def newest_hits(bars: DataFrame, lookback: int = 30, keep: int = 3, codes: list[str] | None = None) -> DataFrame:
    """symbol, code, direction, dt: the newest ``keep`` hits of each code within the last ``lookback`` bars of a symbol."""
    codes = list(codes or DETECTORS)
    flags = candle_flags(bars, codes).withColumn("_left", F.max("rn").over(Window.partitionBy(SYMBOL)) - F.col("rn")).where(F.col("_left") < lookback)
    stacked = flags.select("symbol", "dt", F.explode(F.array(*(F.when(F.col(c), F.struct(F.lit(c).alias("code"), F.lit(DETECTORS[c][1]).alias("direction"))) for c in codes))).alias("hit")).where("hit is not null")
    rank = F.row_number().over(Window.partitionBy("symbol", "hit.code").orderBy(F.col("dt").desc()))
    return stacked.withColumn("_rank", rank).where(F.col("_rank") <= keep).select("symbol", "hit.code", "hit.direction", "dt")


def combo_details(bars: DataFrame) -> DataFrame:
    """What to watch behind the last four codes; NULL where the code did not hit. Bars need candle_flags().

    The gap and whether later bars kept it (nothing later: so far); volume of the two down bars against the first; groups, whether
    their lows rise, and the gain of a stack; the close that confirms a gathering and the one that ends it.
    """
    later = series().rowsBetween(1, Window.unboundedFollowing)
    hit = lambda code, value: F.when(F.col(code), value)
    gap, rest, stack, wait = "gap_duofangpao", "liangyang_liangyin", "diedie_duofangpao", "duofangpao_pending"
    support = F.least(Bar(1).low, Bar().low, F.min("low").over(later))
    seven = F.coalesce(stacked(4) & (F.col("rn") >= 7), F.lit(False))
    rest_ratio = (Bar(2).volume + Bar(1).volume) / 2 / Bar(3).volume
    rise = (Bar(1).low > Bar(3).low + EPS) & (~seven | (Bar(3).low > Bar(5).low + EPS))
    return bars.withColumns(
        {
            "gap_low": hit(gap, Bar(3).high), "gap_pct": hit(gap, sql_round((Bar(2).low / Bar(3).high - 1) * 100, 2)), "gap_support": hit(gap, support),
            "gap_held": hit(gap, support >= Bar(3).high - EPS), "gap_later": hit(gap, F.count(F.lit(1)).over(later)),
            "rest_ratio": hit(rest, sql_round(rest_ratio, 2)), "rest_shrinks": hit(rest, rest_ratio <= 0.85),
            "stack_groups": hit(stack, F.when(seven, 3).otherwise(2)), "stack_rises": hit(stack, rise),
            "stack_gain": hit(stack, sql_round((F.col("close") / F.when(seven, Bar(6).close).otherwise(Bar(4).close) - 1) * 100, 2)),
            "confirm_at": hit(wait, F.greatest(Bar(2).high, Bar(1).high, Bar().high)), "fail_at": hit(wait, Bar(2).open),
        }
    )


def hit_summaries(hits: DataFrame, limit: int = 3) -> DataFrame:
    """symbol, n_hits, direction (of the newest hit), summary: the newest hit of each code, the newest ``limit`` codes as text.
    Hits of one day stand in the order of the registry; a group has no more rows than there are codes."""
    place = F.array_position(F.array(*map(F.lit, DETECTORS)), F.col("code"))
    newest = hits.groupBy("symbol", "code", "direction").agg(F.max("dt").alias("dt"), F.count(F.lit(1)).alias("n"))
    entry = F.struct((-F.unix_date("dt")).alias("age"), place.alias("place"), F.concat(F.col("code"), F.lit("("), F.date_format("dt", "MM-dd"), F.lit(" "), F.col("direction"), F.lit(")")).alias("text"), "direction")
    grouped = newest.groupBy("symbol").agg(F.sum("n").alias("n_hits"), F.sort_array(F.collect_list(entry)).alias("_all"))
    return grouped.select("symbol", "n_hits", F.col("_all")[0]["direction"].alias("direction"), F.array_join(F.slice(F.col("_all.text"), 1, limit), ", ").alias("summary"))


def candle_result(days: DataFrame, weeks: DataFrame | None = None, lookback: int = 60, keep: int = 3, codes: list[str] | None = None) -> DataFrame:
    """Per symbol of ``days`` the summaries of both periods, all hits, and the direction of the newest daily hit, else weekly one.
    Without ``weeks`` that period is off; '-' where nothing hit."""
    found = days.select("symbol").distinct()
    for name, bars in (("daily", days), ("weekly", weeks if weeks is not None else days.limit(0))):
        part = hit_summaries(newest_hits(bars, lookback, keep, codes))
        found = found.join(part.select("symbol", *(F.col(c).alias(f"{c}_{name}") for c in ("n_hits", "direction", "summary"))), "symbol", "left")
    dash = F.lit("-")
    hits = F.coalesce("n_hits_daily", F.lit(0)) + F.coalesce("n_hits_weekly", F.lit(0))
    return found.select("symbol", hits.cast("long").alias("n_hits"), F.coalesce("direction_daily", "direction_weekly", dash).alias("direction"), *(F.coalesce(f"summary_{p}", dash).alias(f"summary_{p}") for p in ("daily", "weekly")))


def strong_engulfing(bars: DataFrame) -> DataFrame:
    """Engulfing with its grade: ``strong`` if volume is half as much again and the close is low or above its mean of five."""
    y, t = Bar(1), Bar()
    basic = (y.close < y.open) & (t.close > t.open) & (t.open <= y.close + EPS) & (t.close > y.open)
    fall = 1 - ratio(t.close, F.max("close").over(last(120)))
    strong = (t.volume > y.volume * VOLUME_RATIO) & (F.coalesce(t.close >= rolling_mean("close", 5) - EPS, F.lit(False)) | (fall >= LOW_RETRACE))
    grade = F.when(basic & strong, "strong").when(basic, "basic").otherwise("none")
    return bars.withColumns({"engulfing": grade, "retrace": fall})


def low_ground_volume(bars: DataFrame) -> DataFrame:
    """Far under the 120-bar high with the least volume of 20 bars, under half the mean of 60, which is above that of 20."""
    low = (1 - ratio(F.col("close"), F.max("close").over(last(120)))) >= LOW_RETRACE
    v, m20, m60 = F.col("volume"), F.avg("volume").over(last(20)), F.avg("volume").over(last(60))
    quiet = (v <= F.min("volume").over(last(20)) + EPS) & (v < 0.5 * m60) & (m20 < m60)
    enough = F.count(F.lit(1)).over(so_far()) >= 60
    return bars.withColumns({"is_low": enough & low, "is_quiet": enough & quiet, "low_ground": enough & low & quiet})


def triangle(bars: DataFrame) -> DataFrame:
    """Kind of triangle over the last 30 bars, from a range under 15 % of the mean close that narrows in the second half."""
    enough = F.count(F.lit(1)).over(so_far()) >= 30
    spread = lambda w: F.max("high").over(w) - F.min("low").over(w)
    narrow = spread(last(30)) / F.avg("close").over(last(30)) * 100 < 15
    first, second = spread(series().rowsBetween(-29, -15)), spread(last(15))
    h0, l0, h1, l1 = lag("high", 29), lag("low", 29), F.col("high"), F.col("low")
    kind = F.when((h1 < h0) & (l1 > l0), "symmetric").when((h1 < h0) & (l1 < l0), "descending").when((h1 > h0) & (l1 > l0), "ascending").otherwise("plain")
    found = enough & narrow & (second < first)
    bars = bars.withColumns({"triangle": F.when(found, kind).otherwise("none"), "convergence": F.when(found, (first - second) / first * 100)})
    rising = F.col("close") > lag("close", 4)
    way = F.when(F.col("triangle") == "ascending", "up").when(F.col("triangle") == "descending", "down").when(rising, "up").otherwise("down")
    return bars.withColumn("triangle_way", F.when(found, way))


def wedge(bars: DataFrame, n: int = 25) -> DataFrame:
    """Least-squares slopes of the highs and lows of the last ``n`` bars."""
    bars = bars.withColumn("_x", F.count(F.lit(1)).over(so_far()).cast("double"))
    full = F.count(F.lit(1)).over(last(n)) == n
    slope = lambda c: F.when(full, F.covar_pop(c, "_x").over(last(n)) / F.var_pop("_x").over(last(n)))
    bars = bars.withColumns({"high_slope": slope("high"), "low_slope": slope("low")}).drop("_x")
    h, low = F.col("high_slope"), F.col("low_slope")
    steep = (F.abs(h) > 0.01) | (F.abs(low) > 0.01)
    kind = F.when(steep & (h > 0) & (low > 0), "rising").when(steep & (h < 0) & (low < 0), "falling").when(steep, "mixed").otherwise("none")
    return bars.withColumns({"wedge": kind, "wedge_reliability": F.when(steep, F.least(F.abs(h - low) * 1000, F.lit(80.0)))})


#: Reliability of the shapes that have no measure of their own.
RELIABILITY = {"head and shoulders": 70.0, "double": 75.0, "triangle": 60.0}


def main_pattern(bars: DataFrame) -> DataFrame:
    """symbol, main_pattern, reliability: of the shapes at the newest bar the most reliable one, of equal ones the first in the order
    head and shoulders, double, triangle, wedge; none with 0, and clear where the reliability is above 50."""
    newest = latest(wedge(triangle(bars)))
    for column, found in (("head", head_and_shoulders(bars)), ("double", double_top_bottom(bars))):
        newest = newest.join(found.select("symbol", F.col("kind").alias(f"_{column}")), "symbol", "left")
    there = lambda c: F.coalesce(F.col(c), F.lit("none")) != "none"
    shapes = [
        ("_head", "head and shoulders", F.lit(RELIABILITY["head and shoulders"])), ("_double", "double", F.lit(RELIABILITY["double"])),
        ("triangle", "triangle", F.lit(RELIABILITY["triangle"])), ("wedge", "wedge", F.coalesce("wedge_reliability", F.lit(0.0))),
    ]
    rows = [F.struct(F.when(there(c), value).otherwise(0.0).alias("reliability"), F.lit(-i).alias("place"), F.concat(F.lit(f"{name} "), F.col(c)).alias("name")) for i, (c, name, value) in enumerate(shapes)]
    best = F.array_max(F.array(*rows))
    made = newest.select("symbol", best.alias("best"))
    value = F.col("best.reliability")
    return made.select("symbol", F.when(value > 0, F.col("best.name")).otherwise("none").alias("main_pattern"), value.alias("reliability"), (value > 50).alias("clear"))


def latest_gap(bars: DataFrame) -> DataFrame:
    """One row a symbol: its newest opening above the high before. It hits from 1 % on; older, larger gaps do not count.

    gap_type: breakout after 40 bars within 12 %; exhaustion after 35 % in 20 bars with a gap of 3 %; else continuation.
    unfilled_days: bars from the gap on whose lows stay above the gap's level; three confirm. Fewer than 3 bars: no gap.
    """
    w, whole = Window.partitionBy("symbol").orderBy("dt"), Window.partitionBy("symbol")
    before = w.rowsBetween(-40, -1)
    high, close = F.lag("high").over(w), F.lag("close").over(w)
    mean = F.when(F.count("close").over(w.rowsBetween(-20, -1)) == 20, F.avg("close").over(w.rowsBetween(-20, -1)))
    low = F.min("low").over(before)
    base = F.lag("close", 21).over(w)
    named = {
        "no": F.row_number().over(w), "level": high, "pct": (F.col("open") - high) / high * 100, "range": F.when(low > 0, (F.max("high").over(before) - low) / low).otherwise(999.0),
        "rally": F.coalesce(F.when(base > 0, (close - base) / base), F.lit(0.0)), "up": F.coalesce(close > mean, F.lit(False)),
    }
    gap = F.col("open") > F.col("level") + 1e-6
    b = bars.select("symbol", "dt", "open", "low", *(c.alias(n) for n, c in named.items()), F.count(F.lit(1)).over(whole).alias("n"))
    b = b.withColumn("g", F.max(F.when(gap & (F.col("n") >= 3), F.struct("no", "level", "pct", "range", "rally", "up"))).over(whole))
    filled = F.min(F.when((F.col("no") >= F.col("g.no")) & (F.col("low") <= F.col("g.level") + 1e-6), F.col("no")))
    last = b.groupBy("symbol").agg(F.first("g").alias("g"), F.first("n").alias("n"), filled.alias("filled"))
    hit = F.coalesce(F.col("g.pct") >= 1, F.lit(False))
    kind = F.when(F.col("g.range") < 0.12, "breakout").when((F.col("g.rally") >= 0.35) & (F.col("g.pct") >= 3), "exhaustion").otherwise("continuation")
    unfilled = F.when(hit, F.coalesce("filled", F.col("n") + 1) - F.col("g.no")).otherwise(0)
    return last.select(
        "symbol", hit.alias("gap_up"), F.when(hit, kind).alias("gap_type"), F.coalesce(sql_round("g.pct", 2), F.lit(0.0)).alias("gap_pct"), unfilled.cast("long").alias("unfilled_days"),
        F.when(hit, F.col("g.range") < 0.12).alias("consolidation"), F.when(hit, sql_round(F.col("g.rally") * 100, 1)).alias("rally_pct"), F.when(hit, F.col("g.up")).alias("above_ma20"), F.when(hit, unfilled >= 3).alias("confirmed"),
    )


def pivots(bars: DataFrame, k: int = 2) -> DataFrame:
    """Bars whose high (low) is strictly above (below) that of the ``k`` bars on either side."""
    around = lambda c, n: F.lead(c, n).over(series())
    peak = trough = F.lit(True)
    for i in range(1, k + 1):
        peak = peak & (F.col("high") > lag("high", i)) & (F.col("high") > around("high", i))
        trough = trough & (F.col("low") < lag("low", i)) & (F.col("low") < around("low", i))
    return bars.withColumns({"peak": F.coalesce(peak, F.lit(False)), "trough": F.coalesce(trough, F.lit(False))})




def _newest_frame(bars: DataFrame, n: int, k: int) -> DataFrame:
    """One row per symbol with at least ``n`` bars: dt, the newest ``n`` highs and lows, and where their pivots are."""
    rank = F.row_number().over(Window.partitionBy(SYMBOL).orderBy(F.col("dt").desc()))
    rows = bars.withColumn("_rank", rank).where(F.col("_rank") <= n).groupBy("symbol").agg(F.max("dt").alias("dt"), F.array_sort(F.collect_list(F.struct("dt", "high", "low"))).alias("f")).where(F.size("f") == n)
    rows = rows.select("symbol", "dt", F.col("f.high").alias("h"), F.col("f.low").alias("l"))
    inner = F.sequence(F.lit(2), F.lit(n - 3))

    def turning(c: str, above: bool) -> Column:
        def is_pivot(i: Column) -> Column:
            found = F.lit(True)
            for j in (*range(-k, 0), *range(1, k + 1)):
                here, there = F.get(c, i), F.get(c, i + j)
                found = found & (here > there if above else here < there)
            return found

        return F.filter(inner, is_pivot)

    return rows.withColumns({"peaks": turning("h", True), "troughs": turning("l", False)})


def _first_run(places: str, length: int, fits: Callable[[Column, list[Column]], Column]) -> Column:
    """Number of the first of ``length`` pivots in a row that fit; NULL if none do."""
    starts = F.when(F.size(places) >= length, F.sequence(F.lit(0), F.size(places) - length)).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(starts, lambda q: fits(q, [F.get(places, q + j) for j in range(length)])), F.lit(0))


def head_and_shoulders(bars: DataFrame) -> DataFrame:
    """symbol, dt, kind (top, bottom, none), head, neck, target over the newest 60 bars; tops before bottoms, the first counts.

    Three pivots in a row, more than five bars apart each, the middle one beyond both. The neck is the opposite pivot with
    the middle one's number in its own list.
    """

    def shape(own: str, value: str, opposite: str, sign: int) -> Column:
        def fits(q: Column, i: list[Column]) -> Column:
            a, b, c = (F.get(value, x) * sign for x in i)
            return (i[1] - i[0] > 5) & (i[2] - i[1] > 5) & (b > a) & (b > c) & (q + 1 < F.size(opposite))

        return _first_run(own, 3, fits)

    rows = _newest_frame(bars, 60, 2).withColumns({"top": shape("peaks", "h", "troughs", 1), "bottom": shape("troughs", "l", "peaks", -1)})
    top = F.col("top").isNotNull()
    q = F.coalesce("top", "bottom")
    head = F.when(top, F.get("peaks", q + 1)).otherwise(F.get("troughs", q + 1))
    neck = F.when(top, F.get("l", F.get("troughs", q + 1))).otherwise(F.get("h", F.get("peaks", q + 1)))
    rows = rows.withColumns({"head": head, "neck": neck, "kind": F.when(top, "top").when(q.isNotNull(), "bottom").otherwise("none")})
    target = F.when(top, F.col("neck") - (F.get("h", F.col("head")) - F.col("neck"))).otherwise(F.col("neck") + (F.col("neck") - F.get("l", F.col("head"))))
    return rows.select("symbol", "dt", "kind", "head", "neck", target.alias("target"))


def double_top_bottom(bars: DataFrame) -> DataFrame:
    """symbol, dt, kind, first_at, second_at, neck, target over the newest 40 bars: two pivots in a row, 5 to 15 bars apart and
    less than 5 % from each other; the neck is the opposite price of the bar half way."""

    def shape(own: str, value: str) -> Column:
        def fits(q: Column, i: list[Column]) -> Column:
            a, b = F.get(value, i[0]), F.get(value, i[1])
            return (i[1] - i[0]).between(5, 15) & (F.abs(a - b) / a * 100 < 5)

        return _first_run(own, 2, fits)

    rows = _newest_frame(bars, 40, 1).withColumns({"top": shape("peaks", "h"), "bottom": shape("troughs", "l")})
    top = F.col("top").isNotNull()
    q = F.coalesce("top", "bottom")
    at = lambda j: F.when(top, F.get("peaks", q + j)).otherwise(F.get("troughs", q + j))
    rows = rows.withColumns({"first_at": at(0), "second_at": at(1), "kind": F.when(top, "top").when(q.isNotNull(), "bottom").otherwise("none")})
    half = F.floor((F.col("first_at") + F.col("second_at")) / 2).cast("int")
    rows = rows.withColumn("neck", F.when(top, F.get("l", half)).otherwise(F.get("h", half)))
    target = F.when(top, F.col("neck") - (F.get("h", F.col("first_at")) - F.col("neck"))).otherwise(F.col("neck") + (F.col("neck") - F.get("l", F.col("first_at"))))
    return rows.select("symbol", "dt", "kind", "first_at", "second_at", "neck", target.alias("target"))
