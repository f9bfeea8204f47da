"""Audits of a whole bar table with samples, the verdict over several market anchors, and the table of sector strengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import lag, last, ratio, sql_round
from quantloom.operators import indicators, rules

#: Days between two bars of a symbol that count as a gap, the share of a day's bars without turnover from which the
#: source is to blame, bars that an anchor needs.
GAP_DAYS, SOURCE_GAP, ANCHOR_BARS = 7, 0.5, 250
CHECKS = ("duplicate_key", "bad_close", "invalid_ohlc", "volume_no_amount", "long_gap", "no_turnover")


def flagged(bars: DataFrame) -> DataFrame:
    """``bars`` with a boolean column for each check but the last. A duplicate key is flagged once for all its rows."""
    same = Window.partitionBy("symbol", "dt")
    # a duplicate stands no day after its twin, so of equal days only one can follow a gap
    marked = bars.withColumns({"_n": F.count(F.lit(1)).over(same), "_i": F.row_number().over(same.orderBy("close")), "_gap": F.datediff("dt", lag("dt"))})
    high, low = F.col("high"), F.col("low")
    broken = (high < low) | (high < F.col("open")) | (high < F.col("close")) | (low > F.col("open")) | (low > F.col("close")) | (F.col("open") <= 0) | (low <= 0) | (high <= 0)
    said = lambda c: F.coalesce(c, F.lit(False))
    checks = {
        "duplicate_key": (F.col("_n") > 1) & (F.col("_i") == 1),
        "bad_close": F.coalesce(F.col("close") <= 0, F.lit(True)),
        "invalid_ohlc": said(broken),
        "volume_no_amount": said((F.col("volume") > 0) & (F.coalesce("amount", F.lit(0.0)) <= 0)),
        "long_gap": said(F.col("_gap") > GAP_DAYS),
    }
    return marked.withColumns(checks).drop("_n", "_i")


def no_turnover() -> Column:
    """A bar with volume whose turnover is unknown or not positive."""
    return F.coalesce((F.coalesce("turn", F.lit(0.0)) <= 0) & (F.col("volume") > 0), F.lit(False))


def _newest_day(bars: DataFrame) -> DataFrame:
    newest = bars.agg(F.max("dt").alias("latest_day"))
    return bars.join(F.broadcast(newest), F.col("dt") == F.col("latest_day"))


def audit_report(bars: DataFrame) -> DataFrame:
    """One row: rows, findings of each check, and of the newest day the bars without turnover, their share, and whether that says
    that the source had none. An empty table has zeros and no newest day."""
    counts = flagged(bars).agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col(c)).alias(c) for c in CHECKS[:-1]))
    day = _newest_day(bars).agg(F.max("latest_day").alias("latest_day"), F.count_if(no_turnover()).alias("no_turnover"), F.count(F.lit(1)).alias("_n"))
    share = F.coalesce(F.try_divide("no_turnover", "_n"), F.lit(0.0))
    # both sides are one row
    return counts.crossJoin(day.select("latest_day", "no_turnover", sql_round(share, 4).alias("no_turnover_ratio"), (share > SOURCE_GAP).alias("source_gap_likely")))


def audit_samples(bars: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` findings of each check by symbol and day: check, symbol, dt, value (the close, the gap in days, the volume
    or the turnover). Each task keeps ``most`` rows a check before they meet."""
    value = {"bad_close": F.col("close"), "invalid_ohlc": F.col("close"), "volume_no_amount": F.col("volume"), "long_gap": F.col("_gap").cast("double")}
    found = F.array_compact(F.array(*(F.when(F.col(c), F.struct(F.lit(c).alias("check"), value.get(c, F.lit(None)).cast("double").alias("value"))) for c in CHECKS[:-1])))
    rows = flagged(bars).select("symbol", "dt", F.explode(found).alias("_f")).select("_f.check", "symbol", "dt", "_f.value")
    late = _newest_day(bars).where(no_turnover()).select(F.lit(CHECKS[-1]).alias("check"), "symbol", "dt", F.col("turn").alias("value"))
    rank = F.row_number().over(Window.partitionBy("check").orderBy("symbol", "dt", "value"))
    return rows.unionByName(late).withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def market_verdict(bars: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row for each anchor (a column symbol) with its newest close, yearly mean, whether it stands above it, whether the means
    are in order, its change over 20 bars, and the verdict over all anchors.

    bull: all above and in order; warn: one below; mixed: all above, not all in order. unknown if an anchor has under 250 bars;
    such an anchor's values are null. Without anchors there are no rows.
    """
    means = indicators.moving_averages(bars.join(F.broadcast(anchors.select("symbol")), "symbol", "left_semi"), (5, 20, 60, 250))
    change = (ratio(F.col("close"), lag("close", 20)) - 1) * 100
    enough = F.count(F.lit(1)).over(last(ANCHOR_BARS)) == ANCHOR_BARS
    ordered = (F.col("ma5") > F.col("ma20")) & (F.col("ma20") > F.col("ma60")) & (F.col("ma60") > F.col("ma250"))
    new = indicators.latest(means.withColumns({"chg20": change, "_enough": enough, "above": F.col("close") > F.col("ma250"), "aligned": ordered}))
    new = new.where(F.col("_enough") & F.col("ma250").isNotNull()).select("symbol", "dt", "close", "ma250", "above", "aligned", "chg20")
    each = anchors.select("symbol").distinct().join(new, "symbol", "left")
    verdict = F.when(F.count("above") < F.count(F.lit(1)), "unknown").when(F.every(F.col("above") & F.col("aligned")), "bull").when(F.some(~F.col("above")), "warn").otherwise("mixed")
    return each.crossJoin(F.broadcast(each.agg(verdict.alias("verdict"))))


def change_of_last(n: int) -> Column:
    """Change in percent over ``n`` bars, or over as many as there are; null without an earlier bar."""
    first = F.first("close").over(last(n + 1))
    return F.when(F.count(F.lit(1)).over(last(2)) == 2, (ratio(F.col("close"), first) - 1) * 100)


def sector_strength(bars: DataFrame) -> DataFrame:
    """Score and changes over 5, 10 and 20 bars of each sector's newest bar, best first, sectors without a score last."""
    scored = rules.sector_score(bars).select("symbol", "dt", "sector_score", *(change_of_last(n).alias(f"chg{n}") for n in (5, 10, 20)))
    return indicators.latest(scored).drop("dt").orderBy(F.desc_nulls_last("sector_score"), "symbol")
