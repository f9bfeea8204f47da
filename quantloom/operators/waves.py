"""Three-wave structure of the newest bars of every symbol, its rules and verdict; direction of periods and their factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import SYMBOL, lag, last, ratio, rolling_mean, series, so_far, sql_round
from quantloom.operators.quality import valid_bars

#: The parameters of the structure.
DEFAULTS = {
    "lookback": 120, "min_bars": 60, "w1_gain": 0.15, "w1_bars": 5, "w1_up": 0.5, "w2_low": 0.3, "w2_high": 0.8, "w2_bars": 5,
    "w2_shrink": 0.85, "w3_expand": 1.5, "chase": 0.05, "chase_bars": 5, "stop": 0.02,
}
#: Base weight of the month by its direction and the sign of its slope.
MONTH_WEIGHT = {
    ("bull", "up"): 1.15, ("bull", "flat"): 1.05, ("bull", "down"): 1.0, ("neutral", "up"): 1.05, ("neutral", "flat"): 1.0,
    ("neutral", "down"): 0.95, ("bear", "up"): 0.95, ("bear", "flat"): 0.85, ("bear", "down"): 0.7,
}
SLOPE_BARS = {"month": 6, "week": 8, "day": 20}


def wave_structure(bars: DataFrame, **changes: float) -> DataFrame:
    """One row per symbol: phase and the numbers of the three waves within its newest ``lookback`` valid bars.

    Each step is one aggregate over the symbol's rows with the turning points of the step before as columns; all steps share
    one partitioning. Of equal lows or highs the first counts.
    """
    p = DEFAULTS | changes
    w = Window.partitionBy(SYMBOL)
    rank = F.row_number().over(w.orderBy(F.col("dt").desc()))
    rows = valid_bars(bars, strict=True).withColumns({"_rank": rank, "_all": F.count(F.lit(1)).over(w)}).where((F.col("_rank") <= p["lookback"]) & (F.col("_all") >= p["min_bars"]))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.col("n") - F.col("_rank"))
    rows = rows.withColumns({"_c1": lag("close"), "_mean20": rolling_mean("close", 20), "_vmax3": F.max("volume").over(last(3))})

    def first(which: Column, best: Column) -> Column:
        return F.min_by("i", F.when(which, F.struct(best, F.col("i")))).over(w)

    at = lambda place, c: F.max(F.when(F.col("i") == F.col(place), F.col(c))).over(w)
    mean = lambda lo, hi, c: F.avg(F.when((F.col("i") > lo) & (F.col("i") <= hi), F.col(c))).over(w)
    i, n = F.col("i"), F.col("n")
    rows = rows.withColumn("i0", first(i < F.greatest(F.lit(1), F.floor(n * 0.5)), F.col("low").alias("best")))
    rows = rows.withColumn("i1", first((i >= F.col("i0") + p["w1_bars"]) & (i <= n - p["w2_bars"] - 1), (-F.col("high")).alias("best")))
    rows = rows.withColumn("i2", first(i >= F.col("i1") + p["w2_bars"], F.col("low").alias("best")))
    rows = rows.withColumns({"l0": at("i0", "low"), "h1": at("i1", "high"), "l2": at("i2", "low")})
    inside = (i > F.col("i0") + 1) & (i <= F.col("i1"))
    rows = rows.withColumns(
        {
            "up_ratio": F.count(F.when(inside & (F.col("close") > F.col("_c1")), 1)).over(w) / F.greatest(F.lit(1), F.count(F.when(inside, 1)).over(w)),
            "v1": mean(F.col("i0"), F.col("i1"), "volume"),
            "v2": mean(F.col("i1"), F.col("i2"), "volume"),
            "i3": F.min(F.when((i > F.col("i2")) & (F.col("close") >= F.col("h1")), i)).over(w),
            "lowest_after": F.min(F.when(i > F.col("i2"), F.col("low"))).over(w),
        }
    )
    # the three bars up to the break, not before the second wave's low
    before_break = (i > F.col("i2")) & (i >= F.col("i3") - 2) & (i <= F.col("i3"))
    rows = rows.withColumns({"break_volume": F.max(F.when(before_break, F.col("volume"))).over(w), "break_close": at("i3", "close")})
    newest = rows.where(F.col("_rank") == 1)
    gain, retrace = F.col("h1") / F.col("l0") - 1, (F.col("h1") - F.col("l2")) / F.when(F.col("h1") > F.col("l0"), F.col("h1") - F.col("l0"))
    known = lambda c: F.coalesce(c, F.lit(False))
    newest = newest.withColumns({"gain": gain, "retrace": retrace})
    w1 = known((F.col("gain") >= p["w1_gain"]) & (F.col("up_ratio") >= p["w1_up"]))
    w2 = w1 & known(F.col("retrace").between(p["w2_low"], p["w2_high"]) & (F.col("l2") > F.col("l0")))
    stop = F.when(w2, F.col("l2") * (1 - p["stop"]))
    newest = newest.withColumns({"wave1_ok": w1, "wave2_exists": w1 & F.col("i2").isNotNull(), "wave2_ok": w2, "stop": stop, "entry": F.when(w2, F.coalesce("break_close", "close"))})
    broke = F.col("wave2_ok") & F.col("i3").isNotNull()
    chase = F.col("entry") / F.col("h1") - 1
    newest = newest.withColumns(
        {
            "breakout": broke,
            "shrinks": F.col("wave1_ok") & known(F.col("v2") / F.col("v1") <= p["w2_shrink"]),
            "stable": F.col("wave2_ok") & known(F.coalesce(F.col("lowest_after") >= F.col("l2") * 0.99, F.lit(True))),
            "expands": broke & known(F.col("break_volume") / F.when(F.col("v2") > 0, F.col("v2")) >= p["w3_expand"]),
            "chase_risk": broke & known((chase > p["chase"]) | (F.col("n") - 1 - F.col("i3") > p["chase_bars"])),
            "exhausted": known(F.col("close") < F.col("_mean20")) | known(F.col("close") < F.col("stop")),
        }
    )
    phase = (
        F.when(~F.col("wave1_ok"), "no first wave").when(F.col("i2").isNull(), "second wave running").when(~F.col("wave2_ok"), "second wave unfit")
        .when(~F.col("breakout"), "waiting for break").otherwise("third wave")
    )
    columns = ["gain", "up_ratio", "retrace", "wave1_ok", "wave2_exists", "wave2_ok", "shrinks", "stable", "breakout", "expands", "chase_risk", "exhausted", "entry", "stop"]
    return newest.select("symbol", "dt", phase.alias("phase"), *columns)


def period_position(bars: DataFrame, unit: str, lookback: int = 60) -> DataFrame:
    """Newest direction (1, 0, -1), slope and place (high, middle, low) of each symbol's bars of a unit; none before 20 bars."""
    b = bars
    for n in (5, 10, 20):
        b = b.withColumn(f"m{n}", rolling_mean("close", n))
    bull = (F.col("m5") > F.col("m10")) & (F.col("m10") > F.col("m20")) & (F.col("close") > F.col("m20"))
    bear = (F.col("m5") < F.col("m10")) & (F.col("m10") < F.col("m20"))
    low, high = F.min("low").over(last(lookback)), F.max("high").over(last(lookback))
    before = lag("m20", SLOPE_BARS[unit])
    b = b.withColumns({"direction": F.when(bull, 1).when(bear, -1).otherwise(0), "slope": ratio(F.col("m20") - before, F.abs(before)) * 100, "place": (F.col("close") - low) / F.when(high > low, high - low), "_n": F.count(F.lit(1)).over(so_far())})
    newest = b.withColumn("_rank", F.row_number().over(Window.partitionBy(SYMBOL).orderBy(F.col("dt").desc()))).where((F.col("_rank") == 1) & (F.col("_n") >= 20))
    zone = F.when(F.col("place").isNull(), "unknown").when(F.col("place") >= 0.8, "high").when(F.col("place") >= 0.3, "middle").otherwise("low")
    return newest.select("symbol", F.lit(unit).alias("unit"), "direction", "slope", zone.alias("zone"))


def alignment(day: DataFrame, week: DataFrame, month: DataFrame) -> DataFrame:
    """Per symbol of any period: directions, whether the trend allows a trade, and the factor of the three periods."""
    named = [df.select("symbol", F.col("direction").alias(f"{u}_direction"), F.col("slope").alias(f"{u}_slope"), F.col("zone").alias(f"{u}_zone")) for u, df in (("day", day), ("week", week), ("month", month))]
    rows = named[0].join(named[1], "symbol", "full_outer").join(named[2], "symbol", "full_outer")
    d, wk, m = (F.col(f"{u}_direction") for u in ("day", "week", "month"))
    known = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in (d, wk, m)), F.lit(0))
    no_bear = ~(F.coalesce(d < 0, F.lit(False)) | F.coalesce(wk < 0, F.lit(False)) | F.coalesce(m < 0, F.lit(False)))
    up = F.coalesce(d == 1, F.lit(False)) | F.coalesce(wk == 1, F.lit(False))
    kind = F.when(m == 1, "bull").when(m == -1, "bear").otherwise("neutral")
    slope = sql_round(F.coalesce("month_slope", F.lit(0.0)), 2)
    sign = F.when(slope > 1, "up").when(slope < -1, "down").otherwise("flat")
    weights = F.create_map(*(F.lit(x) for (a, b), v in MONTH_WEIGHT.items() for x in (f"{a}/{b}", v)))
    weight = F.when(m.isNull(), 1.0).otherwise(F.element_at(weights, F.concat_ws("/", kind, sign)))
    product = lambda a, b: F.coalesce(a * b, F.lit(0))
    pairs = (product(wk, m), product(d, m), product(wk, d))
    bonus = sum((F.when(x == 1, 4.0).otherwise(0.0) for x in pairs), F.lit(0.0))
    penalty = sum((F.when(x == -1, 9.0).otherwise(0.0) for x in pairs), F.lit(0.0))
    return rows.withColumns({"known_periods": known, "trend_ok": (known >= 2) & no_bear & up, "weight": weight, "bonus": bonus, "penalty": penalty})


def apply_factor(score: Column, weight: Column, bonus: Column, penalty: Column) -> Column:
    """A score of 0 or less stays as it is."""
    return F.when(score <= 0, score).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(score * weight + bonus - penalty, 1))))


def rules_and_verdict(waves: DataFrame, positions: DataFrame, strict: bool = False) -> DataFrame:
    """Nine rules (the fourth and sixth soft unless ``strict``), quality in percent and the verdict of every symbol."""
    rows = waves.join(positions.select("symbol", "trend_ok", "known_periods"), "symbol", "left")
    stop_ok = F.coalesce((F.col("stop") > 0) & (F.col("entry") > F.col("stop")), F.lit(False))
    eight = [F.coalesce("trend_ok", F.lit(False)), F.col("wave1_ok"), F.col("wave2_ok"), F.col("shrinks"), F.col("breakout"), F.col("expands"), stop_ok, ~F.col("chase_risk")]
    soft = set() if strict else {3, 5}
    hard = F.forall(F.array(*(c for i, c in enumerate(eight) if i not in soft)), lambda x: x)
    nine = F.array(*eight, hard & F.col("breakout"))
    rows = rows.withColumn("rules", nine)
    failed = F.filter(F.transform("rules", lambda x, i: F.when(~x & ~i.isin(*(soft or {-1})), i + 1)), lambda x: x.isNotNull())
    rows = rows.withColumns({"failed_hard": failed, "quality": sql_round(F.size(F.filter("rules", lambda x: x)) / 9 * 100, 1)})
    verdict = F.when(F.coalesce("known_periods", F.lit(0)) < 2, "avoid").when(F.size("failed_hard") == 0, "candidate").when(F.col("phase").isin("second wave unfit", "no first wave"), "avoid").otherwise("watch")
    return rows.withColumn("verdict", verdict)


NEXT_ACTIONS = [
    "wait until month or week turn up", "look for a clear first wave among the candidates", "confirm the first wave's gain, length and share of rising bars",
    "wait for the second wave, do not chase the first one's top", "watch for a quiet decline that makes no new low", "wait for a close above the first wave's top on volume",
    "enter the third wave in parts by the size formula", "set the stop below the second wave's low", "hold while the trend is not exhausted", "take profit in parts",
]
STEPS = ["market allows", "candidate", "first wave", "second wave", "quiet and stable", "break", "rules kept", "stop set", "hold", "take profit"]


def ten_steps(verdicts: DataFrame, positions: DataFrame) -> DataFrame:
    """``verdicts`` (rules_and_verdict) with the ten flags of the plan, the step that a symbol stands at and its name.

    Step 10 once an exhausted trend follows a break, 9 while a break keeps the rules, else the first open one of the first eight
    (1 if none is). Without a month the candidate flag is off.
    """
    rows = verdicts.join(positions.select("symbol", F.col("month_direction").alias("_month")), "symbol", "left")
    stop_ok = F.coalesce((F.col("stop") > 0) & (F.col("entry") > F.col("stop")), F.lit(False))
    broke, spent = F.col("breakout"), F.col("breakout") & F.col("exhausted")
    flags = [
        F.coalesce("trend_ok", F.lit(False)), F.col("wave1_ok") & F.coalesce(F.col("_month") != -1, F.lit(False)), F.col("wave1_ok"), F.col("wave2_exists"),
        F.col("shrinks") & F.col("stable"), broke, broke & (F.size("failed_hard") == 0), stop_ok, broke & ~spent, spent,
    ]
    rows = rows.withColumn("flags", F.array(*flags))
    at = F.array_position(F.slice("flags", 1, 8), F.lit(False)).cast("int")
    step = F.when(F.col("flags")[9], 10).when(F.col("flags")[5] & F.col("flags")[6], 9).otherwise(F.greatest(at, F.lit(1)))
    rows = rows.withColumn("step", step).drop("_month")
    named = {n: F.element_at(F.array(*map(F.lit, texts)), F.col("step")) for n, texts in (("step_name", STEPS), ("next_action", NEXT_ACTIONS))}
    return rows.withColumns(named)


def step_table(steps: DataFrame) -> DataFrame:
    """symbol, no, name, status (passed, current, open), flag: all ten steps of every row of ten_steps()."""
    rows = steps.select("symbol", "step", F.posexplode("flags").alias("at", "flag")).withColumn("no", F.col("at") + 1)
    status = F.when(F.col("no") < F.col("step"), "passed").when(F.col("no") == F.col("step"), "current").otherwise("open")
    return rows.select("symbol", "no", F.element_at(F.array(*map(F.lit, STEPS)), F.col("no")).alias("name"), status.alias("status"), "flag")


def reached(steps: DataFrame, least: int = 1) -> DataFrame:
    """Rows of ten_steps() at step ``least`` or further, with the furthest step of all rows."""
    furthest = steps.agg(F.max("step").alias("furthest"))
    return steps.join(F.broadcast(furthest)).where(F.col("step") >= least)


def stage(bars: DataFrame) -> DataFrame:
    """Distribution, shakeout, rally, accumulation or consolidation on every date, with a confidence, from changes over 5, 20 and 60
    bars, volume trend, range and place; unknown before 30 bars.

    Bars with a column poc (adaptive_series) also count its shifts over 20 and 60 bars: a shakeout needs a POC that does not
    fall, a rally one that rises, and a rising one stands in for a low place in accumulation. An unknown shift speaks against none.
    """
    change = lambda n, c="close": ratio(F.col(c) - lag(c, n), F.abs(lag(c, n)))
    b = bars.withColumns({"t5": change(5), "t20": change(20), "t60": change(60), "_n": F.count(F.lit(1)).over(so_far()), "_hi": F.max("close").over(last(120)), "_lo": F.min("close").over(last(120))})
    volume = ratio(F.avg("volume").over(last(5)), F.avg("volume").over(series().rowsBetween(-24, -5)))
    b = b.withColumns({"volume_trend": F.when(F.col("_n") >= 25, sql_round(volume, 3)), "amplitude": F.when(F.col("_n") >= 20, sql_round((F.max("high").over(last(20)) - F.min("low").over(last(20))) / F.avg("close").over(last(20)), 4))})
    shift = {n: change(n, "poc") if "poc" in bars.columns else F.lit(None).cast("double") for n in (20, 60)}
    b = b.withColumns({f"poc_shift{n}": v for n, v in shift.items()})
    t5, t20, v, a, p = (F.col(c) for c in ("t5", "t20", "volume_trend", "amplitude", "poc_shift20"))
    top, bottom = F.col("close") >= 0.9 * F.col("_hi"), F.col("close") <= 1.1 * F.col("_lo")
    flat = F.abs(t20) <= 0.05
    known = lambda c: F.coalesce(c, F.lit(False))
    kinds = [
        (F.col("_n") < 30, "unknown", 0.0), (top & ~bottom & (v > 1.1) & (t20 < 0.05), "distribution", 0.7), ((t20 < -0.03) & (v > 1.1), "distribution", 0.7),
        ((t20 > 0.03) & (t5 < -0.01) & (v < 0.9) & (p.isNull() | (p > -0.02)), "shakeout", 0.7), ((t20 > 0.08) & (v.isNull() | (v >= 0.9)) & (p.isNull() | (p > 0.02)), "rally", 0.75),
        (flat & (v > 1.1) & (bottom | known(p > 0)) & (a.isNull() | (a < 0.2)), "accumulation", 0.7), (flat & (a < 0.15), "consolidation", 0.6),
    ]
    name, sure = F.when(F.lit(False), "consolidation"), F.when(F.lit(False), 0.5)
    for test, kind, confidence in kinds:
        name, sure = name.when(test, kind), sure.when(test, confidence)
    return b.withColumns({"stage": name.otherwise("consolidation"), "stage_confidence": sure.otherwise(0.5)}).drop("_n", "_hi", "_lo")
