"""Exponential means as a scan of a linear recurrence.

A run of bars (a year of days, a day of minutes) maps the state before it (both means, the signal, the area) to the state
after it, and that map is affine: its linear part depends only on the number of bars, its constant part is one sum over
the run. So the bars are cut into bounded runs that tasks work on independently, one row for each run is chained along its
symbol by composing the maps, and the bars of each run are then filled from the state before it. A symbol's bars never
meet in one task; only its runs, some hundred times fewer, do. Within a run, means are those of the difference to the
run's first close, so flat prices give exact zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from quantloom.functions.windows import DATE, SYMBOL


def run_of(bars: DataFrame, unit: str | None = None) -> Column:
    """The run that a bar belongs to: years for dates and days for times, unless ``unit`` (of date_trunc) says otherwise. A run
    should hold some hundred bars; above about 2,500 the weights leave the range of doubles."""
    fine = isinstance(bars.schema[DATE].dataType, (TimestampType, TimestampNTZType))
    return F.date_trunc(unit or ("day" if fine else "year"), DATE)


def _decay(share: float, k: Column) -> Column:
    return F.pow(F.lit(1 - share), k)


def _meeting(first: float, then: float, k: Column) -> Column:
    """What a mean of share ``then`` over a mean of share ``first`` keeps, after k bars, of the first one's start."""
    a, d = 1 - first, 1 - then
    return F.lit(then * a / (a - d)) * (F.pow(F.lit(a), k) - F.pow(F.lit(d), k))


def _lasting(share: float, k: Column) -> Column:
    """The sum of a start's weights over k bars."""
    d = 1 - share
    return F.lit(d / (1 - d)) * (1 - F.pow(F.lit(d), k))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, unit: str | None = None) -> DataFrame:
    """EMA difference, its signal line, their difference (not doubled) and the running sum; EMAs start at the first close.

    A bar without a close leaves all of them as they are; before the first close they are NULL. Days of a symbol should be
    unique. One exchange by (symbol, run), none where the bars come partitioned by symbol.
    """
    f, s, g = (2 / (n + 1) for n in (fast, slow, signal))
    if len({fast, slow, signal}) < 3:
        raise ValueError("the three spans must differ")
    run = Window.partitionBy(SYMBOL, "_run").orderBy(DATE)
    up_to = run.rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.withColumn("_run", run_of(bars, unit))
    rows = rows.withColumns({"_k": F.count("close").over(up_to), "_r": F.first("close", ignorenulls=True).over(up_to)})
    y = F.col("close") - F.col("_r")
    # the sum of weighted values, weights growing from 1, times the decay
    part = lambda share, x: F.coalesce(share * _decay(share, F.col("_k")) * F.sum(x * F.pow(F.lit(1 - share), -F.col("_k"))).over(up_to), F.lit(0.0))
    rows = rows.withColumns({"_f": part(f, y), "_s": part(s, y)}).withColumn("_l", F.when(F.col("close").isNotNull(), F.col("_f") - F.col("_s")))
    rows = rows.withColumns({"_g": part(g, F.col("_l")), "_a": F.coalesce(F.sum("_l").over(up_to), F.lit(0.0))})
    before = _states(rows, (f, s, g))
    rows = rows.join(before, [SYMBOL, "_run"])
    k, old = F.col("_k"), lambda c: F.coalesce(F.col(f"_in.{c}"), F.lit(0.0))
    # the state before a symbol's first close is that close; before a run's first close nothing has changed yet
    x, z = (F.when(k > 0, F.coalesce(F.col(f"_in.{c}"), F.col("_r")) - F.col("_r")).otherwise(0.0) for c in ("f", "s"))
    line = F.when(k > 0, _decay(f, k) * x - _decay(s, k) * z + F.col("_f") - F.col("_s")).otherwise(F.col("_in.f") - F.col("_in.s"))
    known = F.when((k > 0) | F.col("_in").isNotNull(), F.lit(0.0))
    mean = known + _decay(g, k) * old("g") + _meeting(f, g, k) * x - _meeting(s, g, k) * z + F.col("_g")
    area = known + old("a") + _lasting(f, k) * x - _lasting(s, k) * z + F.col("_a")
    made = rows.withColumns({"macd": line, "macd_signal": mean, "macd_area": area}).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return made.select(*bars.columns, "macd", "macd_signal", "macd_hist", "macd_area")


def _states(rows: DataFrame, shares: tuple[float, float, float]) -> DataFrame:
    """(symbol, _run, _in): the state before every run, of its symbol's runs before it one after the other."""
    f, s, g = shares
    ends = rows.groupBy(SYMBOL, "_run").agg(F.max_by(F.struct("_k", "_r", "_f", "_s", "_g", "_a"), DATE).alias("m"))
    runs = ends.groupBy(SYMBOL).agg(F.array_sort(F.collect_list(F.struct("_run", "m"))).alias("runs"))

    def step(state: Column, run: Column) -> Column:
        m = run["m"]
        k, r = m["_k"], m["_r"]
        old = F.coalesce(state["now"], F.struct(r.alias("f"), r.alias("s"), F.lit(0.0).alias("g"), F.lit(0.0).alias("a")))
        x, z = old["f"] - r, old["s"] - r
        new = F.struct(
            (r + _decay(f, k) * x + m["_f"]).alias("f"), (r + _decay(s, k) * z + m["_s"]).alias("s"),
            (_decay(g, k) * old["g"] + _meeting(f, g, k) * x - _meeting(s, g, k) * z + m["_g"]).alias("g"),
            (old["a"] + _lasting(f, k) * x - _lasting(s, k) * z + m["_a"]).alias("a"),
        )
        seen = F.concat(state["seen"], F.array(F.struct(run["_run"].alias("_run"), state["now"].alias("_in"))))
        return F.struct(F.when(r.isNull(), state["now"]).otherwise(new).alias("now"), seen.alias("seen"))

    state = "struct<f:double,s:double,g:double,a:double>"
    kind = rows.schema["_run"].dataType.simpleString()
    start = F.struct(F.lit(None).cast(state).alias("now"), F.array().cast(f"array<struct<_run:{kind},_in:{state}>>").alias("seen"))
    chained = runs.select(SYMBOL, F.explode(F.aggregate("runs", start, step, lambda x: x["seen"])).alias("x"))
    return chained.select(SYMBOL, "x._run", "x._in")
