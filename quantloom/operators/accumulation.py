"""Evidence that stock is being gathered: place, flatness, volume and stage, added up to a grade; unknown is never evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import lag, last, ratio, rolling_mean, series, so_far, sql_round

#: Retrace that counts as low, bounds of the volume trend, of a flat 20-bar change and of a small range.
LOW_RETRACE, DRY, SHRINKS, MILD, HEAVY, FLAT_BAND, SMALL_RANGE = 0.15, 0.5, 0.9, 1.1, 1.5, 0.05, 0.2
LEAST_BARS = 30


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def grade(low: Column, flat: Column, volume_state: Column, small_range: Column, stage: Column, chip_low: Column, turnover: Column, above_year: Column) -> tuple[Column, Column]:
    """Points and grade (strong, medium, weak, none). Distribution and rallies are none. Strong needs a low, flat place and volume that
    settles or rises mildly; below the year line it is medium only, an unknown year line changes nothing."""
    points = [
        (low, 30), (flat, 15), (volume_state.isin("settling", "mild rise"), 25), (volume_state == "dried up", 12), (small_range, 8), (stage == "accumulation", 20),
        (stage == "pressed accumulation", 12), (stage == "shakeout", 8), (chip_low, 20), ((turnover < 2) | turnover.between(3, 5), 8),
    ]
    total = sum((F.when(_yes(c), p).otherwise(0) for c, p in points), F.lit(0))
    under = _yes(~above_year)
    strong = _yes(low) & _yes(flat) & _yes(volume_state.isin("settling", "mild rise")) & ~under
    level = F.when(_yes(stage.isin("distribution", "rally")), "none").when((total >= 75) & strong, "strong").when(total >= 45, "medium").when(total >= 20, "weak").otherwise("none")
    return total, level


def accumulation(bars: DataFrame, stage: Column | None = None, chip_low: Column | None = None, turnover: Column | None = None, lookback: int = 120) -> DataFrame:
    """The grade of every bar with its evidence, for stocks, sectors and indexes alike; unknown before 30 bars.

    Adds acc_level, acc_points, acc_stage, retrace_pct, near_low, above_year, volume_trend, volume_state, chg20, amplitude20
    and acc_evidence (codes). ``stage`` is one that is known already; else it follows from price and volume: falling on volume
    is distribution only near the top, near the bottom it is pressed accumulation. Stocks add what they know of chips and turnover.
    """
    n = F.count(F.lit(1)).over(so_far())
    high, low_ = F.max("close").over(last(lookback)), F.min("close").over(last(lookback))
    before = F.avg("volume").over(series().rowsBetween(-24, -5))
    year = rolling_mean("close", 250)
    t20 = F.when(n >= 21, ratio(F.col("close") - lag("close", 20), lag("close", 20)))
    spread = (F.max("high").over(last(20)) - F.min("low").over(last(20))) / F.when(F.avg("close").over(last(20)) > 0, F.avg("close").over(last(20)))
    rows = bars.withColumns(
        {
            "_n": n, "_t20": t20, "_retrace": sql_round(1 - ratio(F.col("close"), high), 4), "_pos": (F.col("close") - low_) / F.when(high - low_ > 1e-9, high - low_),
            "volume_trend": F.when((n >= 25) & (before > 0), sql_round(F.avg("volume").over(last(5)) / before, 3)), "amplitude20": F.when(n >= 20, sql_round(spread, 4)),
            "above_year": F.when(n >= 250, F.col("close") > year),
        }
    )
    v = F.col("volume_trend")
    state = F.when(v < DRY, "dried up").when(v < SHRINKS, "settling").when(v <= MILD, "usual").when(v <= HEAVY, "mild rise").when(v.isNotNull(), "heavy").otherwise("unknown")
    rows = rows.withColumns({"volume_state": state, "near_low": _yes(F.col("_pos") <= 0.2), "_top": _yes(F.col("_pos") >= 0.85), "_more": _yes(v > MILD), "_flat": _yes(F.abs("_t20") <= FLAT_BAND), "_small": _yes(F.col("amplitude20") < SMALL_RANGE)})
    rows = rows.withColumn("_low", _yes(F.col("_retrace") >= LOW_RETRACE) | F.col("near_low"))
    t, top, more, flat, low = (F.col(c) for c in ("_t20", "_top", "_more", "_flat", "_low"))
    inferred = (
        F.when(top & more & (t < 0.05), "distribution").when(t > 0.08, "rally").when(flat & more & low, "accumulation")
        .when(low & (t < -0.03) & more, "pressed accumulation").when(flat & F.col("_small"), "consolidation").otherwise("unknown")
    )
    known = F.lit("unknown") if stage is None else F.coalesce(stage, F.lit("unknown"))
    # turnover is rounded, so that a mean at the edge of a band does not depend on the order of adding
    rows = rows.withColumns({"acc_stage": F.when(known != "unknown", known).otherwise(inferred), "_chip": _yes(chip_low) if chip_low is not None else F.lit(False), "_turn": sql_round(turnover, 9) if turnover is not None else F.lit(None).cast("double")})
    points, level = grade(low, flat, F.col("volume_state"), F.col("_small"), F.col("acc_stage"), F.col("_chip"), F.col("_turn"), F.col("above_year"))
    say = lambda c, text: F.when(_yes(c), F.lit(text))
    evidence = F.array_compact(
        F.array(
            say(low, "low"), say(~low & top, "high"), say(flat, "flat"), F.when(F.col("volume_state") != "unknown", F.concat(F.lit("volume "), "volume_state")), say(F.col("_small"), "small range"),
            F.when(F.col("acc_stage") != "unknown", F.concat(F.lit("stage "), "acc_stage")), say(F.col("_chip"), "chips low"), say(F.col("_turn") < 2, "turnover settles"), say(F.col("_turn").between(3, 5), "turnover gathers"),
            say(~F.col("above_year"), "below year line"), say(F.col("above_year"), "above year line"),
        )
    )
    enough = F.col("_n") >= LEAST_BARS
    rows = rows.withColumns(
        {
            "acc_points": F.when(enough, points), "acc_level": F.when(enough, level).otherwise("unknown"), "acc_evidence": F.when(enough, evidence).otherwise(F.array().cast("array<string>")),
            "retrace_pct": F.when(enough, sql_round(F.col("_retrace") * 100, 2)), "chg20": F.when(enough, sql_round(F.col("_t20") * 100, 2)), "near_low": enough & F.col("near_low"), "acc_stage": F.when(enough, F.col("acc_stage")).otherwise(known),
        }
    )
    return rows.drop("_n", "_t20", "_retrace", "_pos", "_top", "_more", "_flat", "_small", "_low", "_chip", "_turn")


def from_results(results: DataFrame) -> DataFrame:
    """``results`` (stage, chip_low, chip_low_unknown, turnover_20, price, high_120, yearline_pass; any may be NULL) with the grade that
    follows from the stored fields alone: acc_level, acc_points, retrace_pct, acc_known. Unknown chips are not low chips."""
    stage = F.coalesce("stage", F.lit("unknown"))
    chip = _yes(F.col("chip_low")) & ~_yes(F.col("chip_low_unknown"))
    retrace = sql_round(1 - ratio(F.col("price"), F.col("high_120")), 4)
    low = _yes(retrace >= LOW_RETRACE) | chip
    points, level = grade(low, stage.isin("accumulation", "consolidation"), F.lit("usual"), stage == "accumulation", stage, chip, F.col("turnover_20"), F.col("yearline_pass"))
    known = (stage != "unknown") | chip | F.col("turnover_20").isNotNull() | retrace.isNotNull()
    return results.withColumns({"acc_points": points, "acc_level": level, "retrace_pct": sql_round(retrace * 100, 2), "acc_known": known})
