"""Hygiene of bar tables: validity, audits, resampling, upserts, incremental selection and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import SYMBOL, lag, sql_round

#: Bars that a finished week or month needs; fixed values.
LEAST_BARS = {"week": 3, "month": 10}


def normalize_symbol(code: Column) -> Column:
    """``600519.SH`` from 600519, sh.600519, sh600519 or 600519.SH; NULL where no exchange can be told."""
    digits = F.regexp_extract(code, r"(\d{6})", 1)
    named = F.upper(F.regexp_extract(F.lower(code), r"(sh|sz|bj)", 1))
    refused = (named == "") & digits.rlike("^(400|410|420)")
    inferred = F.when(digits.rlike("^(43|83|87|92)"), "BJ").when(digits.rlike("^[569]"), "SH").otherwise("SZ")
    exchange = F.when(named != "", named).otherwise(inferred)
    return F.when((digits != "") & ~refused, F.concat_ws(".", digits, exchange))


def valid_bars(bars: DataFrame, strict: bool = False) -> DataFrame:
    """Without bars that lack a price; ``strict`` also drops prices of 0 or less and highs under lows."""
    bars = bars.dropna(subset=["open", "high", "low", "close"]).fillna(0, subset=[c for c in ("volume", "amount") if c in bars.columns])
    if strict:
        bars = bars.where("open > 0 and high > 0 and low > 0 and close > 0 and high >= low").withColumn("volume", F.greatest("volume", F.lit(0.0)))
    return bars


def valid_turnover(turn: Column) -> Column:
    return F.when((turn > 0) & (turn < 80), turn)


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the last by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))
    return rows.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def resample(bars: DataFrame, unit: str = "week") -> DataFrame:
    """Weeks (label Friday) or months (label last day): weekends dropped, first, max, min, last, sums; a short period is kept
    only as the newest of its symbol; pct_chg is computed after that."""
    label = F.date_add(F.date_trunc("week", "dt").cast("date"), 4) if unit == "week" else F.last_day("dt")
    days = bars.where(F.dayofweek("dt").between(2, 6) & F.col("close").isNotNull())
    made = days.groupBy("symbol", label.alias("period")).agg(
        F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "dt").alias("close"),
        F.sum("volume").alias("volume"), sql_round(F.sum("amount"), 2).alias("amount"), F.coalesce(F.sum("turn"), F.lit(0.0)).alias("turn"), F.count(F.lit(1)).alias("n_bars"),
    )
    newest = F.max("period").over(Window.partitionBy(SYMBOL))
    made = made.withColumn("_newest", newest).where((F.col("n_bars") >= LEAST_BARS[unit]) | (F.col("period") == F.col("_newest"))).drop("_newest").withColumnRenamed("period", "dt")
    return made.withColumn("pct_chg", (F.try_divide(F.col("close"), lag("close")) - 1) * 100)


def pair_up(bars: DataFrame) -> DataFrame:
    """30-minute bars (code, dt, OHLC, volume) as 60-minute ones: pairs within a day, labelled by the second; an odd one stays alone."""
    day = Window.partitionBy("code", F.to_date("dt")).orderBy("dt")
    bars = bars.withColumn("_pair", F.floor((F.row_number().over(day) - 1) / 2))
    made = bars.groupBy("code", F.to_date("dt").alias("_day"), "_pair").agg(
        F.max("dt").alias("dt"), F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "dt").alias("close"), F.sum("volume").alias("volume")
    )
    return made.drop("_day", "_pair")


def audit(bars: DataFrame) -> DataFrame:
    """One row per symbol: rows, duplicate days, bad closes, broken OHLC logic, volume without amount, gaps over seven days."""
    per_day = F.count(F.lit(1)).over(Window.partitionBy("symbol", "dt"))
    bars = bars.withColumns({"_same": per_day, "_gap": F.datediff("dt", lag("dt"))})
    broken = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.col("low"))
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_same") > 1).alias("duplicate_rows"),
        F.count_if(F.coalesce(F.col("close") <= 0, F.lit(True))).alias("bad_close"),
        F.count_if(broken).alias("broken_ohlc"),
        F.count_if((F.col("volume") > 0) & (F.coalesce("amount", F.lit(0.0)) == 0)).alias("no_amount"),
        F.count_if(F.col("_gap") > 7).alias("long_gaps"),
        F.max("_gap").alias("longest_gap"),
        F.min("dt").alias("first_day"),
        F.max("dt").alias("last_day"),
    )


def turnover_coverage(bars: DataFrame, days: int = 20) -> DataFrame:
    """Rows and rows with valid turnover by source over the last ``days`` trading days, taken as days * 1.7 + 3 back."""
    newest = bars.agg(F.max("dt").alias("newest"))
    recent = bars.join(F.broadcast(newest), F.col("dt") >= F.date_sub("newest", int(days * 1.7 + 3)))
    return recent.groupBy(F.coalesce("turn_source", F.lit("null")).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(valid_turnover(F.col("turn")).isNotNull()).alias("valid_rows"))


def freshness(bars: DataFrame, stale_days: int = 3) -> DataFrame:
    """Last day of each symbol, its lag behind the newest day of all, and whether it is fresh."""
    ends = bars.groupBy("symbol").agg(F.max("dt").alias("last_day"), F.count(F.lit(1)).alias("n_rows"))
    newest = ends.agg(F.max("last_day").alias("newest"))
    ends = ends.join(F.broadcast(newest)).withColumn("lag_days", F.datediff("newest", "last_day"))
    return ends.select("symbol", "last_day", "n_rows", "lag_days", (F.col("lag_days") <= stale_days).alias("fresh"))


def delta(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``source`` newer than the symbol's last stored day, for stored symbols only."""
    ends = stored.groupBy("symbol").agg(F.max("dt").alias("_last"))
    return source.join(ends, "symbol").where(F.col("dt") > F.col("_last")).drop("_last")


def upsert(stored: DataFrame, new: DataFrame, key: list[str], keep_old: list[str], order: str | None = None) -> DataFrame:
    """``new`` replaces rows of ``stored`` by key; where it has NULL in a ``keep_old`` column, the old value stays.

    Of rows of ``new`` with one key the one with the highest ``order`` wins (a column of ``new`` that is not stored); without it, the
    one whose other columns sort highest, so that the result never depends on the order of tasks.
    """
    seq = F.col(order).cast("long") if order else F.lit(0).cast("long")
    fresh = new.withColumns({"_new": F.lit(1), "_seq": seq})
    both = stored.withColumns({"_new": F.lit(0), "_seq": F.lit(0).cast("long")}).unionByName(fresh.drop(order) if order else fresh, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc_nulls_last("_seq"), *(F.desc_nulls_last(c) for c in sorted(new.columns) if c not in (*key, order)))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.withColumns({c: F.first(c, ignorenulls=True).over(whole) for c in keep_old})
    return both.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank", "_new", "_seq")


def freshest_source(sources: DataFrame, reference_day: Column) -> DataFrame:
    """Of rows with a ``source_rank`` all of the first source whose last day reaches ``reference_day``, else of the one that
    comes furthest; per symbol."""
    ends = sources.groupBy("symbol", "source_rank").agg(F.max("dt").alias("_end"))
    order = Window.partitionBy("symbol").orderBy((F.col("_end") < reference_day), F.when(F.col("_end") < reference_day, F.datediff(reference_day, F.col("_end"))).otherwise(0), "source_rank")
    chosen = ends.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).select("symbol", "source_rank")
    return sources.join(chosen, ["symbol", "source_rank"], "left_semi")


def as_of(rows: DataFrame, snapshots: DataFrame, value: str) -> DataFrame:
    """``rows`` (symbol, dt) with the ``value`` of the newest snapshot (symbol, as_of) not after dt; one shuffle, no range join."""
    marks = snapshots.select("symbol", F.col("as_of").alias("dt"), F.col(value), F.lit(0).alias("_row"))
    both = rows.drop(value).withColumn("_row", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("dt", "_row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_row = 1").drop("_row")


def step_sample(rows: DataFrame, step: int, start: int, n: int) -> DataFrame:
    """Every ``step``-th symbol in order from ``start``, ``n`` at most: a sampling operator."""
    names = rows.select("symbol").distinct()
    ranked = names.withColumn("_rn", F.row_number().over(Window.orderBy("symbol")))
    chosen = ranked.where(F.pmod(F.col("_rn") - 1 - start, F.lit(step)) == 0).orderBy("_rn").limit(n)
    return rows.join(F.broadcast(chosen.select("symbol")), "symbol", "left_semi")


def latest_jobs(jobs: DataFrame, keep: int = 5) -> DataFrame:
    """The newest ``keep`` jobs of each type."""
    rank = F.row_number().over(Window.partitionBy("scan_type").orderBy(F.col("id").desc()))
    return jobs.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")
