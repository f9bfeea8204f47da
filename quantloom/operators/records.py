"""Records around the bars: normalised labels, projections, filters of scan results, stored tables and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import sql_round
from quantloom.operators.quality import normalize_symbol

#: Spellings of bar periods and of price adjustments, and the flag that each signal name stands for.
FREQUENCIES = {"1d": "1d", "daily": "1d", "d": "1d", "1w": "1w", "weekly": "1w", "w": "1w", "1m": "1M", "monthly": "1M", "m": "1M"}
ADJUSTMENTS = {"qfq": "qfq", "hfq": "hfq", "none": "none", "": "none"}
SIGNALS = {
    "vap_atr": "vap_atr_break", "chip_low": "chip_low", "true_resonance": "true_resonance", "three_resonance": "three_resonance",
    "bull_engulf": "bull_engulf", "gap": "gap_up", "gap_breakout": "gap_breakout", "gap_continuation": "gap_continuation",
    "gap_exhaustion": "gap_exhaustion", "low_ground_volume": "low_ground_volume", "breakout": "has_breakout",
    "breakout_confirm": "breakout_confirm", "false_breakout": "false_breakout",
}


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)


def day(stamp: Column | str) -> Column:
    """The day of a date, a timestamp or a text that begins with one; NULL where there is none."""
    return F.try_to_date(F.substring(F.col(stamp).cast("string") if isinstance(stamp, str) else stamp.cast("string"), 1, 10), "yyyy-MM-dd")


def frequency(label: Column) -> Column:
    """1d, 1w or 1M; NULL for a spelling that names no period."""
    return _lookup(FREQUENCIES, F.lower(F.trim(label)))


def adjustment(label: Column) -> Column:
    """qfq, hfq or none; an unknown spelling stays as it is, in lower case."""
    plain = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.coalesce(_lookup(ADJUSTMENTS, plain), plain)


def as_of(table: DataFrame, last: Column | None, first: Column | None = None, column: str = "dt") -> DataFrame:
    """Rows of ``first`` to ``last``. Every input of a replay (bars, index, sector) goes through here, so none shows later rows."""
    if last is not None:
        table = table.where(F.col(column) <= last)
    return table.where(F.col(column) >= first) if first is not None else table


def stocks_only(instruments: DataFrame) -> DataFrame:
    """Instruments of type 1 or of unknown type that have a name."""
    return instruments.where((F.col("type").isNull() | (F.col("type") == "1")) & (F.trim(F.coalesce("name", F.lit(""))) != ""))


def with_signal(results: DataFrame, signal: str) -> DataFrame:
    """Results whose flag for ``signal`` is true; unknown is not true; an unknown signal name filters nothing."""
    return results.where(F.coalesce(F.col(SIGNALS[signal]), F.lit(False))) if signal in SIGNALS else results


def least_score(results: DataFrame, least: float | None) -> DataFrame:
    """Results of at least that score; results without score go as soon as a score is asked for."""
    return results if least is None else results.where(F.col("score") >= least)


def only_market_mismatch(results: DataFrame) -> DataFrame:
    """Stocks whose strict leg and sector are up while the market alone says no (down, or high); unknown is no match."""
    market_bad = (F.col("market_up") == F.lit(False)) | (F.col("market_not_high") == F.lit(False))
    return results.where(~F.coalesce("is_index", F.lit(False)) & F.coalesce(F.col("stock_strict"), F.lit(False)) & F.coalesce(F.col("industry_up"), F.lit(False)) & F.coalesce(market_bad, F.lit(False)))


def factor_counts(results: DataFrame, factors: list[str]) -> DataFrame:
    """factor, value, n: how often each factor takes each value."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.coalesce(F.col(f).cast("string"), F.lit("null")).alias("value")) for f in factors)))
    return results.select(each.alias("x")).select("x.factor", "x.value").groupBy("factor", "value").agg(F.count(F.lit(1)).alias("n"))


def failure_alert(jobs: DataFrame, least: int = 20, rate: float = 0.02) -> DataFrame:
    """``jobs`` (n_ok, n_fail) with fail_rate and alert: more than ``rate`` of at least ``least`` symbols failed."""
    n = F.col("n_ok") + F.col("n_fail")
    return jobs.withColumn("fail_rate", F.when(n > 0, F.col("n_fail") / n)).withColumn("alert", F.coalesce((n >= least) & (F.col("fail_rate") > rate), F.lit(False)))


def divergence_label(day_value: Column, week_value: Column) -> Column:
    """What daily and weekly divergences (top, bottom or none) say together; the empty text where there is none."""
    known = lambda c: F.coalesce(c, F.lit("")) != ""
    both = F.when(day_value == week_value, F.concat(F.lit("day+week "), day_value)).otherwise(F.concat(F.lit("day "), day_value, F.lit(" / week "), week_value))
    one = F.when(known(day_value), F.concat(F.lit("day "), day_value)).when(known(week_value), F.concat(F.lit("week "), week_value)).otherwise("")
    return F.when(known(day_value) & known(week_value), both).otherwise(one)


def index_lag(bars: DataFrame, index: DataFrame, most: int = 3) -> DataFrame:
    """symbol, last_day, lag_days of the index behind the symbol, and whether the index still says something."""
    ends = bars.groupBy("symbol").agg(F.max("dt").alias("last_day"))
    lagging = ends.join(F.broadcast(index.agg(F.max("dt").alias("_index"))))
    return lagging.withColumn("lag_days", F.datediff("last_day", "_index")).withColumn("index_known", F.coalesce(F.col("lag_days") <= most, F.lit(False))).drop("_index")


def orphans(results: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Results whose job is gone."""
    return results.join(jobs.select(key).distinct(), key, "left_anti")


def enrich(related: DataFrame, results: DataFrame) -> DataFrame:
    """``related`` with the scan results of the same symbol, whatever its spelling: the digits decide."""
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    side = results.withColumn("_digits", digits(F.col("symbol"))).drop("symbol")
    return related.withColumn("_digits", digits(F.col("symbol"))).join(side, "_digits", "left").drop("_digits")


def changed_since(events: DataFrame, known: DataFrame, since: Column) -> DataFrame:
    """symbol, listed: symbols with an event on or after ``since``, and whether the symbol list knows them."""
    found = events.where(F.col("dt") >= since).select("symbol").distinct()
    return found.join(known.select("symbol", F.lit(True).alias("listed")).distinct(), "symbol", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def held_flags(events: DataFrame, watchlist: DataFrame) -> DataFrame:
    """``events`` with held: whether the watchlist says so of their symbol. The watchlist is static, so ``events`` may stream."""
    held = watchlist.groupBy("symbol").agg(F.max("held").alias("held"))
    return events.join(held, "symbol", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def annotate_alerts(alerts: DataFrame, watchlist: DataFrame, weeks: DataFrame) -> DataFrame:
    """``alerts`` (symbol, dt, now) with held, and above_5w: for golden ones, whether the symbol's newest weekly close is above the
    mean of its last five; false for others, fewer weeks and none. Weeks are needed of the alerts' symbols only."""
    golden = alerts.where("now = 'golden'").select("symbol").distinct()
    place = Window.partitionBy("symbol").orderBy(F.desc("dt"))
    newest = weeks.select("symbol", "dt", "close").join(golden, "symbol", "left_semi").withColumn("place", F.row_number().over(place)).where("place <= 5")
    means = newest.groupBy("symbol").agg((F.max(F.when(F.col("place") == 1, F.col("close"))) > F.avg("close")).alias("above"), F.count("close").alias("n"))
    above = means.select("symbol", (F.col("above") & (F.col("n") == 5)).alias("above_5w"))
    found = held_flags(alerts, watchlist).join(above, "symbol", "left")
    return found.withColumn("above_5w", F.coalesce((F.col("now") == "golden") & F.col("above_5w"), F.lit(False)))


def fill_turnover(bars: DataFrame, outside: DataFrame) -> DataFrame:
    """``bars`` whose unknown or derived turn is replaced from ``outside`` (symbol, dt, turn); a feed's own turn stays."""
    open_ = F.col("turn").isNull() | F.coalesce(F.col("turn_source").isin("derived"), F.lit(True))
    both = bars.join(outside.select("symbol", "dt", F.col("turn").alias("_turn")), ["symbol", "dt"], "left")
    take = open_ & F.col("_turn").isNotNull()
    return both.withColumns({"turn": F.when(take, F.col("_turn")).otherwise(F.col("turn")), "turn_source": F.when(take, F.lit("outside")).otherwise(F.col("turn_source"))}).drop("_turn")


def sector_rows(bars: DataFrame, needed: tuple[str, ...] = ("symbol", "dt", "open", "high", "low", "close")) -> DataFrame:
    """Sector bars ready to be stored: unknown volume and amount are 0; a missing column is an error."""
    if missing := [c for c in needed if c not in bars.columns]:
        raise ValueError(f"sector bars lack {', '.join(missing)}")
    return bars.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in bars.columns else F.lit(0.0) for c in ("volume", "amount")})


def newest_snapshots(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` replaces rows of ``stored`` with the same key, whole rows; of several new ones the one with the highest seq stays."""
    both = stored.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    return both.groupBy(*key).agg(F.max_by(F.struct(*(c for c in stored.columns if c not in key)), "seq").alias("_row")).select(*key, "_row.*")


def upsert_relation(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol, sector, is_primary): new rows replace the flag of stored ones."""
    both = stored.join(new.withColumnRenamed("is_primary", "_new"), ["symbol", "sector"], "full_outer")
    return both.select("symbol", "sector", F.coalesce("_new", "is_primary", F.lit(0)).alias("is_primary"))


def json_safe(rows: DataFrame) -> DataFrame:
    """``rows`` as JSON can hold them: NaN and infinite numbers become NULL, dates and times ISO texts."""
    inf = F.lit(float("inf"))

    def safe(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in ("double", "float"):
            return F.when(~F.isnan(c) & (F.abs(c) != inf), c)
        return F.date_format(c, "yyyy-MM-dd") if kind == "date" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else c

    return rows.select(*(safe(f.name, f.dataType.simpleString()).alias(f.name) for f in rows.schema))


def summary_line(rows: DataFrame, label: str, template: str, columns: list[str], order: str) -> DataFrame:
    """One row, one text: the rows' texts in ``order``, a few by contract (markets, indexes, sectors), behind the label."""
    made = rows.select(order, F.format_string(template, *columns).alias("_text")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_text"))), lambda x: x["_text"]), "; ").alias("_all"))
    return made.select(F.concat(F.lit(f"{label}: "), "_all").alias("line"))


def write_shards(rows: DataFrame, path: str, stage: Column) -> None:
    """JSON lines in one folder for each stage."""
    rows.withColumn("stage", stage).write.partitionBy("stage").mode("overwrite").json(path)


def coverage_report(scopes: DataFrame, bars: DataFrame, shares: DataFrame, today: Column) -> DataFrame:
    """One row for each scope of ``scopes`` (scope, symbol): symbols, those with bars, with bars older than ``today``, without
    shares, oddly spelled ones (a code that is normally spelled another way), unknown chips (``chip_unknown`` of ``scopes``, if there is
    such a column), and the warnings that follow."""
    ends = bars.groupBy("symbol").agg(F.max("dt").alias("_last"))
    known = scopes.join(ends, "symbol", "left").join(shares.select("symbol", F.lit(1).alias("_share")).distinct(), "symbol", "left")
    odd = F.coalesce(normalize_symbol(F.col("symbol")) != F.col("symbol"), F.lit(False))
    chips = F.col("chip_unknown") if "chip_unknown" in scopes.columns else F.lit(False)
    made = known.groupBy("scope").agg(
        F.count(F.lit(1)).alias("symbols"), F.count("_last").alias("with_bars"), F.count_if(F.col("_last") < today).alias("stale"),
        F.count_if(F.col("_share").isNull()).alias("without_shares"), F.count_if(odd).alias("odd_spellings"), F.count_if(F.coalesce(chips, F.lit(False))).alias("unknown_chips"),
    )
    warn = lambda test, text: F.when(test, F.lit(text))
    warnings = F.array_compact(F.array(warn(F.col("with_bars") < F.col("symbols"), "no bars"), warn(F.col("stale") > 0, "old bars"), warn(F.col("without_shares") > 0, "no shares"), warn(F.col("odd_spellings") > 0, "spelling")))
    return made.withColumn("warnings", F.array_join(warnings, ", "))


def friday_weeks(bars: DataFrame) -> DataFrame:
    """Weeks up to Friday of sector bars: weekend days count for the next Friday; a week without a close above 0 goes."""
    after = F.pmod(F.lit(11) - F.weekday("dt"), F.lit(7)).cast("int")  # weekday: Monday is 0
    weeks = bars.groupBy("symbol", F.date_add("dt", after).alias("week")).agg(
        F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "dt").alias("close"), F.sum("volume").alias("volume"), sql_round(F.sum("amount"), 2).alias("amount")
    )
    return weeks.where("close > 0").withColumnRenamed("week", "dt")


def checksum(bars: DataFrame) -> DataFrame:
    """symbol, checksum: of the first day, the middle close, the last day, close and volume, the sum of volumes and the count.
    Prices count in ten-thousandths. Without a sort: the middle bar comes from one numbering by symbol."""
    w = Window.partitionBy("symbol").orderBy("dt")
    numbered = bars.withColumns({"_no": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    text = lambda c: F.coalesce(F.round(c * 10000).cast("long").cast("string"), F.lit("None"))
    middle = F.max(F.when(F.col("_no") == F.floor(F.col("_n") / 2) + 1, F.col("close")))
    parts = [F.min("dt").cast("string"), text(middle), F.max("dt").cast("string"), text(F.max_by("close", "dt")), text(F.max_by("volume", "dt")), text(F.sum("volume")), F.count(F.lit(1)).cast("string")]
    return numbered.groupBy("symbol").agg(F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16).alias("checksum"))


def changed(now: DataFrame, stored: DataFrame) -> DataFrame:
    """symbol, recompute: whether a symbol's checksum differs from the stored one, or none is stored."""
    both = now.join(stored.withColumnRenamed("checksum", "_stored"), "symbol", "left")
    return both.select("symbol", (~F.col("checksum").eqNullSafe(F.col("_stored"))).alias("recompute"))
