"""Technical columns of the bars of each symbol. All windows share one partitioning, so a chain of them shuffles once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import SYMBOL, crosses, crossing, lag, last, percent_change, ratio, rolling_mean, so_far, sql_round, whole
from quantloom.operators.recurrences import macd as macd

PERIODS = (5, 10, 20, 60, 250, 377, 610)


def moving_averages(bars: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    return bars.withColumns({f"ma{n}": rolling_mean("close", n) for n in periods})


def ma_slopes(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    return bars.withColumns({f"ma{n}_slope": (F.col(f"ma{n}") - lag(f"ma{n}", 5)) / 5 for n in periods})


def ma_arrangement(bars: DataFrame) -> DataFrame:
    """1 if the known of ma5, ma10, ma20, ma60 fall strictly, -1 if they rise, 0 else; NULL with fewer than three."""
    four = [F.col(f"ma{n}") for n in (5, 10, 20, 60)]
    known = F.filter(F.array(*four), lambda x: x.isNotNull())
    steps = F.sequence(F.lit(0), F.size(known) - 2)
    falls = F.forall(steps, lambda i: F.get(known, i) > F.get(known, i + 1))
    rises = F.forall(steps, lambda i: F.get(known, i) < F.get(known, i + 1))
    arrangement = F.when(F.size(known) < 3, None).when(falls, 1).when(rises, -1).otherwise(0)
    pairs = sum((F.when(a > b, 1).otherwise(0) for a, b in zip(four, four[1:], strict=False)), F.lit(0))
    return bars.withColumn("arrangement", arrangement).withColumn("arrangement_strength", F.when(F.col("arrangement") == 1, pairs).when(F.col("arrangement").isNotNull(), 0))


def ma_signals(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"ma_cross": crosses("ma5", "ma10"), "ma20_cross": crosses("close", "ma20")})


def macd_signals(bars: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    over_zero = lambda c: crossing(lag(c), zero, F.col(c), zero)
    return bars.withColumns({"macd_cross": crosses("macd", "macd_signal"), "macd_zero_cross": over_zero("macd"), "macd_hist_cross": over_zero("macd_hist")})


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Simple means of gains and losses; the first change counts as 0 for both."""
    change = F.coalesce(F.col("close") - lag("close"), F.lit(0.0))
    bars = bars.withColumns({"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0))})
    gain, loss = rolling_mean("_gain", n), rolling_mean("_loss", n)
    bars = bars.withColumns({"_gain": gain, "_loss": loss})
    value = F.when(F.col("_loss") == 0, F.when(F.col("_gain") > 0, 100.0)).otherwise(100 - 100 / (1 + ratio(F.col("_gain"), F.col("_loss"))))
    return bars.withColumn("rsi", value).drop("_gain", "_loss")


def rsi_signals(bars: DataFrame, low: float = 30, high: float = 70) -> DataFrame:
    r, r1, r2 = F.col("rsi"), lag("rsi"), lag("rsi", 2)
    cross = F.when((r1 <= low) & (r > low), 1).when((r1 >= high) & (r < high), -1).otherwise(0)
    run = F.when((r2 < r1) & (r1 < r), 1).when((r2 > r1) & (r1 > r), -1).otherwise(0)
    return bars.withColumns({"rsi_cross": cross, "rsi_run": run})


def trend_strength(bars: DataFrame) -> DataFrame:
    """Mean distance from the known averages x 0.7 plus arrangement x 30; then scaled to the whole series (looks ahead)."""
    far = [F.when(F.col(m) != 0, F.abs(F.col("close") - F.col(m)) / F.abs(m) * 100) for m in ("ma5", "ma10", "ma20", "ma60")]
    count = sum((F.when(d.isNotNull(), 1).otherwise(0) for d in far), F.lit(0))
    total = sum((F.coalesce(d, F.lit(0.0)) for d in far), F.lit(0.0))
    strength = F.when(count > 0, total / count * 0.7 + F.coalesce(F.col("arrangement") * 30, F.lit(0))).otherwise(0.0)
    bars = bars.withColumn("trend_strength", strength)
    low, high = F.min("trend_strength").over(whole()), F.max("trend_strength").over(whole())
    return bars.withColumn("trend_scaled", F.when(high > low, (F.col("trend_strength") - low) / (high - low) * 100).otherwise(0.0))


def volume_ratio(bars: DataFrame, n: int = 5) -> DataFrame:
    """Volume by its mean, today included."""
    return bars.withColumn("volume_ratio", ratio(F.col("volume"), rolling_mean("volume", n)))


def turnover_stats(bars: DataFrame) -> DataFrame:
    bars = bars.withColumns({f"turn_ma{n}": rolling_mean("turn", n) for n in (5, 10, 20)})
    t = F.col("turn")
    zone = F.when(t < 1, "dull").when(t < 3, "mild").when(t < 5, "gathering").when(t < 8, "lively").when(t >= 8, "heavy").otherwise("unknown")
    return bars.withColumns({"turn_change": percent_change("turn"), "turn_place": ratio(t - F.col("turn_ma20"), F.col("turn_ma20")) * 100, "turn_zone": zone})


def volume_signals(bars: DataFrame) -> DataFrame:
    """The break upwards is against today's mean, the one downwards against yesterday's."""
    bars = bars.withColumn("_vma20", rolling_mean("volume", 20))
    v, v1, m, m1 = F.col("volume"), lag("volume"), F.col("_vma20"), lag("_vma20")
    level = F.when(F.col("volume_ratio") > 1.5, 1).when(F.col("volume_ratio") < 0.5, -1).otherwise(0)
    known = m.isNotNull() & m1.isNotNull()
    broke = F.when(known & (v1 <= 1.5 * m1) & (v > 1.5 * m), 1).when(known & (v1 >= 0.5 * m1) & (v < 0.5 * m1), -1).otherwise(0)
    return bars.withColumns({"volume_level": level, "volume_break": broke}).drop("_vma20")


def momentum(bars: DataFrame) -> DataFrame:
    bars = bars.withColumns({f"change{n}": percent_change("close", n) for n in (1, 5, 10, 20)})
    bars = bars.withColumns(
        {
            "accel5": F.col("change5") - lag("change5"),
            "accel10": F.col("change10") - lag("change10"),
            "momentum": F.col("change5") * 0.6 + F.col("change10") * 0.4,
            "over_ma20": ratio(F.col("close") - F.col("ma20"), F.col("ma20")) * 100,
            "volatility": F.when(F.count("close").over(last(20)) == 20, F.stddev_samp("close").over(last(20))) / F.col("ma20") * 100,
        }
    )
    m = F.coalesce(F.col("momentum"), F.lit(0.0))
    return bars.withColumn("momentum_state", F.when(m > 5, "strong").when(m > 0, "mild").when(m > -5, "weak").otherwise("dull"))


def price_volume(bars: DataFrame) -> DataFrame:
    """Whether price and volume move together, and on-balance volume with its mean and crosses."""
    up, more = F.col("close") - lag("close"), F.col("volume") - lag("volume")
    fit = F.when((up > 0) & (more > 0), 1).when((up > 0) & (more <= 0), -1).when((up <= 0) & (more > 0), -1).otherwise(0)
    signed = F.when(up > 0, F.col("volume")).when(up < 0, -F.col("volume")).otherwise(0.0)
    bars = bars.withColumns({"pv_fit": fit, "_signed": signed}).withColumn("obv", F.sum("_signed").over(so_far()))
    bars = bars.withColumn("obv_ma", rolling_mean("obv", 20))
    return bars.withColumn("obv_cross", crosses("obv", "obv_ma")).drop("_signed")


def enrich(bars: DataFrame) -> DataFrame:
    """The whole chain but the EMA columns, which macd() adds."""
    for step in (moving_averages, ma_slopes, ma_arrangement, ma_signals, rsi, rsi_signals, trend_strength, volume_ratio, turnover_stats, volume_signals, momentum, price_volume):
        bars = step(bars)
    return bars


def daily_returns(bars: DataFrame) -> DataFrame:
    """symbol, dt, ret: change against the last valid close; bars without a positive close are left out."""
    valid = bars.where("close > 0").select("symbol", "dt", (F.col("close") / lag("close") - 1).alias("ret"))
    return valid.where("ret is not null")


#: Code beginnings of the boards whose daily limit is 20 percent.
WIDE_LIMIT = "^(300|301|688)"


def limit_ratio(symbol: Column) -> Column:
    """The daily limit of a symbol by the digits of its code."""
    return F.when(F.regexp_replace(symbol, r"\D", "").rlike(WIDE_LIMIT), 0.2).otherwise(0.1)


def true_range(bars: DataFrame, limit: float | Column = 0.1) -> DataFrame:
    """True range, and whether the bar closed at the daily limit."""
    c1 = lag("close")
    tr = F.when(c1.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c1), F.abs(F.col("low") - c1)))
    return bars.withColumns({"tr": tr, "at_limit": F.coalesce(F.col("close") >= F.bround(c1 * (1 + limit), 2), F.lit(False))})


def true_range_atr(bars: DataFrame, n: int = 14, limit: float | Column = 0.1) -> DataFrame:
    """True range, whether the bar closed at the daily limit, and the mean of ``n`` true ranges in which a limit bar counts
    with the mean of up to ``n`` true ranges so far."""
    bars = true_range(bars, limit)
    bars = bars.withColumn("_tr", F.when(F.col("at_limit"), F.avg("tr").over(last(n))).otherwise(F.col("tr")))
    return bars.withColumn("atr", rolling_mean("_tr", n)).drop("_tr")


def poc(bars: DataFrame, n: int | str = 30, bins: int = 49, most: int = 60) -> DataFrame:
    """Middle of the price bin with the most volume over the last ``n`` bars, of equal bins the lowest; bars without a full
    window are left out. A bar's volume lies at its core price. ``n`` may be a column of windows up to ``most`` bars; then
    bars without a full window stay, with NULL."""
    fixed = isinstance(n, int)
    frame = F.collect_list(F.struct(core_price().alias("p"), F.col("volume").alias("v"))).over(last(n if fixed else most))
    rows = bars.withColumn("_frame", frame)
    if fixed:
        rows = rows.where(F.size("_frame") == n)
    else:
        rows = rows.withColumn("_frame", F.when(F.size("_frame") >= F.col(n), F.slice("_frame", -F.least(F.col(n), F.size("_frame")), F.col(n))))
    low, high = F.array_min(F.col("_frame.p")), F.array_max(F.col("_frame.p"))
    rows = rows.withColumns({"_low": low, "_step": (high - low) / bins})
    place = lambda x: F.coalesce(F.least(F.floor(ratio(x["p"] - F.col("_low"), F.col("_step"))), F.lit(bins - 1)), F.lit(0)).cast("long")
    by_bin = F.array_sort(F.transform("_frame", lambda x, i: F.struct(place(x).alias("bin"), i.alias("i"), x["v"].alias("v"))))
    # volumes are not negative, so the largest running sum within the bins is that of the fullest bin
    start = F.struct(F.lit(-1).cast("long").alias("bin"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("best"), F.lit(-1.0).alias("top"))

    def step(state: Column, x: Column) -> Column:
        total = F.when(x["bin"] == state["bin"], state["sum"] + x["v"]).otherwise(x["v"].cast("double"))
        better = total > state["top"]
        return F.struct(x["bin"].alias("bin"), total.alias("sum"), F.when(better, x["bin"]).otherwise(state["best"]).alias("best"), F.when(better, total).otherwise(state["top"]).alias("top"))

    best = F.aggregate(by_bin, start, step)["best"]
    value = F.when(F.col("_step") == 0, F.col("_low")).otherwise(F.col("_low") + (best + 0.5) * F.col("_step"))
    return rows.withColumn("poc", value).drop("_frame", "_low", "_step")


#: Bounds of the adaptive windows.
LOOKBACK, ATR_WINDOW = (10, 60), (10, 14)


def adaptive_windows(bars: DataFrame, k_unknown: float = 1.8) -> DataFrame:
    """Look-back (70 by the mean turnover of 20 bars, 30 where that is unknown), ATR window (a quarter of it) and band factor of
    every bar; halves are rounded to the even number."""
    mean = F.when((F.count(F.lit(1)).over(so_far()) >= 20), F.avg("turn").over(last(20)))
    bars = bars.withColumn("turn_mean20", F.when(mean > 0, mean))
    clip = lambda x, lo, hi: F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))
    mean = F.col("turn_mean20")
    n = F.when(mean.isNull(), 30).otherwise(F.bround(clip(70 / mean, *LOOKBACK), 0)).cast("int")
    shown = F.bround("turn_mean20", 2)
    k = F.when(shown >= 10, 2.2).when(shown >= 3, 1.8).when(shown.isNotNull(), 1.5).otherwise(k_unknown)
    bars = bars.withColumns({"lookback": n, "k": k})
    return bars.withColumn("atr_window", clip(F.bround(F.col("lookback") / 4, 0), *ATR_WINDOW).cast("int"))


def adaptive_platform(bars: DataFrame, limit: float | Column | None = None) -> DataFrame:
    """poc, atr, upper, lower and breakout of bars with lookback, atr_window and k (adaptive_windows): each bar by its own
    windows. NULL and no breakout before 30 bars and without a full window."""
    bars = true_range(bars, limit_ratio(F.col("symbol")) if limit is None else limit)
    spans = range(ATR_WINDOW[0], ATR_WINDOW[1] + 1)
    bars = bars.withColumns({f"_tr{m}": F.when(F.col("at_limit"), F.avg("tr").over(last(m))).otherwise(F.col("tr")) for m in spans})
    bars = bars.withColumns({f"_atr{m}": rolling_mean(f"_tr{m}", m) for m in spans} | {"limit_before": F.coalesce(lag("at_limit"), F.lit(False)), "_n": F.count(F.lit(1)).over(so_far())})
    atr = F.coalesce(*(F.when(F.col("atr_window") == m, F.col(f"_atr{m}")) for m in spans))
    bars = poc(bars.withColumn("atr", atr), "lookback", most=LOOKBACK[1])
    known = (F.col("_n") >= 30) & F.col("poc").isNotNull() & F.col("atr").isNotNull()
    bars = bars.withColumn("poc", F.when(known, F.col("poc"))).withColumns({"upper": F.col("poc") + F.col("k") * F.col("atr"), "lower": F.col("poc") - F.col("k") * F.col("atr")})
    broke = (F.col("close") > F.col("upper")) & (F.col("close") > F.col("open")) & (gravity() > 0.5) & ~F.col("limit_before")
    return bars.withColumn("breakout", F.coalesce(broke, F.lit(False))).drop("_n", *(f"_tr{m}" for m in spans), *(f"_atr{m}" for m in spans))


def adaptive_series(bars: DataFrame, newest: int = 120) -> DataFrame:
    """adaptive_platform() of the ``newest`` bars of each symbol, all by the windows of its newest bar."""
    recent = newest_per_symbol(adaptive_windows(bars, k_unknown=1.5), newest)
    own = ["lookback", "k", "atr_window"]
    at_end = F.max_by(F.struct(*own), "dt").over(whole())
    return adaptive_platform(recent.withColumn("_own", at_end).withColumns({c: F.col(f"_own.{c}") for c in own}).drop("_own"))


def core_price() -> Column:
    return F.col("low") + gravity() * (F.col("high") - F.col("low"))


def gravity() -> Column:
    """Where the close lies in the day's range."""
    span = F.col("high") - F.col("low")
    return (F.col("close") - F.col("low")) / F.when(span == 0, 0.001).otherwise(span)


def platform(bars: DataFrame, n: int = 30, atr_n: int = 14, k: float = 1.8) -> DataFrame:
    """Bands of k mean true ranges around the POC, and the break above the upper one."""
    bars = true_range_atr(bars, atr_n).withColumn("limit_before", F.coalesce(lag("at_limit"), F.lit(False)))
    bars = poc(bars, n).withColumns({"upper": F.col("poc") + k * F.col("atr"), "lower": F.col("poc") - k * F.col("atr")})
    broke = (F.col("close") > F.col("upper")) & (F.col("close") > F.col("open")) & (gravity() > 0.5) & ~F.col("limit_before")
    return bars.withColumn("breakout", F.coalesce(broke, F.lit(False)))


def box(bars: DataFrame, n: int = 20, near: float = 0.02) -> DataFrame:
    """Where the close stands in the range of the last ``n`` bars; nothing before five bars."""
    enough = F.count(F.lit(1)).over(so_far()) >= 5
    bars = bars.withColumns({"box_top": F.when(enough, F.max("high").over(last(n))), "box_bottom": F.when(enough, F.min("low").over(last(n)))})
    c, top, bottom = F.col("close"), F.col("box_top"), F.col("box_bottom")
    place = (
        F.when(c > top * (1 + near), "above top").when(c >= top * (1 - near), "near top").when(c < bottom * (1 - near), "below bottom")
        .when(c <= bottom * (1 + near), "near bottom").when(top.isNotNull(), "inside").otherwise("unknown")
    )
    return bars.withColumn("box_place", place)


def average_turnover(bars: DataFrame, n: int = 20, least: int = 15, valid: tuple[float, float] | None = (0.0, 80.0)) -> DataFrame:
    """Mean of the valid turnover of the last ``n`` bars, NULL under ``least`` valid ones, and the 120-bar high. Valid is what lies
    between the bounds, as for a feed's percents; without bounds, what is known."""
    turn = F.col("turn")
    bars = bars.withColumn("_valid", turn if valid is None else F.when((turn > valid[0]) & (turn < valid[1]), turn))
    mean = F.when(F.count("_valid").over(last(n)) >= least, F.avg("_valid").over(last(n)))
    return bars.withColumns({"turn_avg20": mean, "high120": F.max("high").over(last(120))}).drop("_valid")


def fill_gaps(rows: DataFrame, column: str = "turn", longest: int = 5) -> DataFrame:
    """Runs of at most ``longest`` missing values take the valid value before them; leading gaps and longer runs stay."""
    valid = F.col(column).isNotNull()
    rows = rows.withColumn("_island", F.count(F.when(valid, 1)).over(so_far()))
    run = F.count(F.when(~valid, 1)).over(Window.partitionBy(SYMBOL, "_island"))
    filled = F.when(valid, F.col(column)).when((F.col("_island") > 0) & (run <= longest), F.last(column, ignorenulls=True).over(so_far()))
    return rows.withColumn(f"{column}_filled", filled).drop("_island")


def newest_per_symbol(bars: DataFrame, cap: int = 2000) -> DataFrame:
    """The newest ``cap`` bars of each symbol."""
    rank = F.row_number().over(whole().orderBy(F.col("dt").desc()))
    return bars.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def latest(bars: DataFrame) -> DataFrame:
    """The newest bar of each symbol."""
    return newest_per_symbol(bars, 1)


def rounded(df: DataFrame, digits: int = 5, exact: tuple[str, ...] = ("open", "high", "low", "close", "entry", "stop")) -> DataFrame:
    """Computed doubles rounded, so that results do not depend on the order of adding; prices stay as they are."""
    return df.select(*(sql_round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" and f.name not in exact else F.col(f.name) for f in df.schema))


