"""Joins, catalogues, jobs and set operations over instruments, sectors and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import sql_round
from quantloom.operators.waves import apply_factor


def latest_report(financials: DataFrame) -> DataFrame:
    """The newest report of each code; report_date is a label such as 2026-2 and sorts by year, then number."""
    order = Window.partitionBy("code").orderBy(F.substring_index("report_date", "-", 1).cast("int").desc(), F.substring_index("report_date", "-", -1).cast("int").desc())
    return financials.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")


def members(relation: DataFrame, fallback: DataFrame) -> DataFrame:
    """(sector, symbol) of ``relation``; sectors that it lacks come from ``fallback``."""
    return relation.unionByName(fallback.join(relation.select("sector").distinct(), "sector", "left_anti"))


def sector_coverage(relation: DataFrame, bars: DataFrame) -> DataFrame:
    """One row: symbols with a sector, and those one of whose sectors has bars."""
    covered = relation.join(bars.select(F.col("symbol").alias("sector")).distinct(), "sector", "left_semi").select("symbol").distinct().agg(F.count(F.lit(1)).alias("covered"))
    return relation.agg(F.count_distinct("symbol").alias("with_sector")).join(F.broadcast(covered))


def not_done(universe: DataFrame, results: DataFrame) -> DataFrame:
    """Symbols of a universe that a job has no result for."""
    return universe.join(results.select("symbol").distinct(), "symbol", "left_anti")


def merge_spellings(rows: DataFrame, symbol: Column, rank: Column) -> DataFrame:
    """Rows of one symbol and day under several spellings become one: the lowest ``rank`` wins, its NULL turn is taken from the others."""
    named = rows.withColumns({"_symbol": symbol, "_order": rank})
    w = Window.partitionBy("_symbol", "dt").orderBy("_order")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = named.withColumn("turn", F.first("turn", ignorenulls=True).over(every)).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1)
    return named.withColumn("symbol", F.col("_symbol")).drop("_symbol", "_order", "_rank")


def search(names: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Symbols whose code has the text's digits or whose name has the text, whatever the case; the first ``limit`` by symbol."""
    digits = "".join(c for c in text if c.isdigit())
    by_code = F.col("symbol").contains(digits) if digits else F.lit(False)
    return names.where(by_code | F.lower("name").contains(text.lower())).orderBy("symbol").limit(limit)


def sector_scores(bars: DataFrame, lookback: int = 10) -> DataFrame:
    """symbol, score (-2 to 3), bias, change_n, amount_score of each sector with 5 bars or more, at its last bar.

    bias is the distance to the mean of 20 closes in percent (0 where unknown), change_n that to the close ``lookback`` bars
    back, the last bar counted; amount_score is 1 where the amount is half above the mean of the five before.
    """
    w = Window.partitionBy("symbol").orderBy("dt")
    at = lambda a, b: w.rowsBetween(a, b)
    mean = F.when(F.count("close").over(at(-19, 0)) == 20, F.avg("close").over(at(-19, 0)))
    past, before = F.lag("close", lookback - 1).over(w), F.when(F.count("amount").over(at(-5, -1)) == 5, F.avg("amount").over(at(-5, -1)))
    b = bars.select(
        "symbol", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt"))).alias("_rank"), F.row_number().over(w).alias("_n"),
        F.coalesce(F.when(mean > 0, (F.col("close") / mean - 1) * 100), F.lit(0.0)).alias("bias"), F.coalesce(F.when(past > 0, (F.col("close") / past - 1) * 100), F.lit(0.0)).alias("change_n"),
        F.coalesce((F.col("amount") / F.when(before > 0, before) >= 1.5).cast("int"), F.lit(0)).alias("amount_score"),
    )
    bias, change = F.col("bias"), F.col("change_n")
    score = F.when(bias < -5, -2).when(bias < -2, -1).when((bias > 5) & (change > 3), 2 + F.col("amount_score")).when((bias > 2) & (change > 0), 1 + F.col("amount_score")).otherwise(0)
    return b.where("_rank = 1 AND _n >= 5").select("symbol", score.alias("score"), "bias", "change_n", "amount_score")


def strongest_sectors(scores: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` strong sectors (2 or more) of the highest score, then change."""
    return scores.where("score >= 2").orderBy(F.desc("score"), F.desc("change_n"), "symbol").limit(n)


def sector_census(scores: DataFrame) -> DataFrame:
    """Counts of strong (2 or more), weak (-2) and neutral sectors, the trend of them all and its strength (0 to 100)."""
    made = scores.agg(F.count(F.lit(1)).alias("sectors"), F.count_if(F.col("score") >= 2).alias("strong"), F.count_if(F.col("score") <= -2).alias("weak"))
    enough = lambda a, b: (F.col(a) >= F.col(b) + 2) & (F.col(a) >= F.greatest(F.lit(3), F.floor(F.col("sectors") * 0.25)))
    strength = lambda a: F.least(F.lit(100), F.floor(F.col(a) / F.col("sectors") * 100) + 20).cast("int")
    up, down = enough("strong", "weak"), enough("weak", "strong")
    return made.withColumns({"neutral": F.col("sectors") - F.col("strong") - F.col("weak"), "trend": F.when(up, "up").when(down, "down").otherwise("swing"), "strength": F.when(up, strength("strong")).when(down, strength("weak")).otherwise(30)})


def compare_results(one: DataFrame, other: DataFrame, most: float = 1.0) -> DataFrame:
    """symbol, a, b, difference, same for two results (symbol, score); a symbol in one only differs."""
    both = one.select("symbol", F.col("score").alias("a")).join(other.select("symbol", F.col("score").alias("b")), "symbol", "full_outer")
    return both.withColumn("difference", F.abs(F.col("a") - F.col("b"))).withColumn("same", F.coalesce(F.col("difference") <= most, F.col("a").isNull() & F.col("b").isNull()))


def focus_sectors(relation: DataFrame, symbols: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` sectors that most of the given symbols belong to, ties by name."""
    return relation.join(symbols.select("symbol").distinct(), "symbol", "left_semi").groupBy("sector").agg(F.count(F.lit(1)).alias("n_symbols")).orderBy(F.desc("n_symbols"), "sector").limit(n)


def expired(rows: DataFrame, day: str, ages: dict[str, int], kind: str, today: Column) -> DataFrame:
    """Per kind what a cleanup would remove and keep: the dry run of an age rule in days."""
    age = F.element_at(F.create_map(*(F.lit(x) for pair in ages.items() for x in pair)), F.col(kind))
    gone = F.coalesce(F.datediff(today, F.col(day)) > age, F.lit(False))
    return rows.groupBy(kind).agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept"))


def merge_boards(boards: DataFrame, names: DataFrame) -> DataFrame:
    """Boards (board, symbol) under their new names (board, new_name); boards that come to share one are united."""
    named = boards.join(names, "board", "left").withColumn("board", F.coalesce("new_name", "board"))
    return named.groupBy("board").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def membership_changes(members_now: DataFrame, watched: DataFrame) -> DataFrame:
    """symbol, action (kept, added, removed) between board members and the watchlist rows that came from boards."""
    now, old = members_now.select("symbol").distinct().withColumn("_now", F.lit(True)), watched.select("symbol").distinct().withColumn("_old", F.lit(True))
    action = F.when(F.col("_old").isNull(), "added").when(F.col("_now").isNull(), "removed").otherwise("kept")
    return now.join(old, "symbol", "full_outer").select("symbol", action.alias("action"))


def reconcile_shares(stored: DataFrame, new: DataFrame, events: DataFrame, guard: float = 0.03) -> DataFrame:
    """symbol, old, new, action: insert, event, changed (over ``guard``) or skip."""
    both = new.select("symbol", F.col("shares").alias("new")).join(stored.select("symbol", F.col("shares").alias("old")), "symbol", "left").join(events.select("symbol").distinct().withColumn("_event", F.lit(True)), "symbol", "left")
    moved = F.abs(F.try_divide(F.col("new") - F.col("old"), F.col("old"))) > guard
    action = F.when(F.col("old").isNull(), "insert").when(F.col("_event"), "event").when(moved, "changed").otherwise("skip")
    return both.select("symbol", "old", "new", action.alias("action"))


def structure_score(day: DataFrame, week: DataFrame) -> DataFrame:
    """0 to 100 from the newest stroke of day and week, the place against the last zone, tag and divergence; 50 without a day. A day
    whose place is unknown (results of old) counts by its time within the zone, if it has ``in_zone``."""
    d = day.select("symbol", *(F.col(c).alias(f"d_{c}") for c in ("direction", "confirmed", "place", "tag", "divergence")), (F.col("in_zone") if "in_zone" in day.columns else F.lit(False)).alias("d_in_zone"))
    rows = d.join(week.select("symbol", F.col("direction").alias("w_direction")), "symbol", "full_outer")
    has_day = F.col("d_direction").isNotNull()
    score = (
        F.lit(50)
        + F.when((F.col("d_direction") == "up") & F.col("d_confirmed"), 12).when((F.col("d_direction") == "down") & F.col("d_confirmed"), -12).otherwise(0)
        + F.when(F.col("d_place") == "above", 8).when(F.col("d_place") == "in", 2).when(F.col("d_place") == "below", -8).when(F.col("d_in_zone"), 5).otherwise(0)
        + F.when(F.col("w_direction") == F.col("d_direction"), 8).when(F.col("w_direction").isNotNull() & has_day, -8).otherwise(0)
        + F.when(F.col("d_tag").isin("buy1", "buy2", "buy3"), 10).when(F.col("d_tag").isin("sell1", "sell2", "sell3"), -10).otherwise(0)
        + F.when(F.col("d_divergence") == "top", -10).when(F.col("d_divergence") == "bottom", 10).otherwise(0)
    )
    return rows.select("symbol", F.when(has_day, F.least(F.lit(100), F.greatest(F.lit(0), score))).otherwise(50).alias("structure_score"))


#: What patterns add to a score.
PATTERN_WEIGHTS = {"strong": 4.0, "breakout": 4.0, "continuation": 2.0, "exhaustion": -6.0, "low_ground": 4.0}


def pattern_adjustment(engulfing: Column, gap_type: Column, low_ground: Column) -> Column:
    """What a strong engulfing bar, the type of a gap and volume at a low ground add to a score; unknown adds nothing."""
    gap = reduce(lambda c, t: c.when(gap_type == t, PATTERN_WEIGHTS[t]), ("breakout", "continuation", "exhaustion"), F.when(F.lit(False), 0.0)).otherwise(0.0)
    return F.when(engulfing == "strong", PATTERN_WEIGHTS["strong"]).otherwise(0.0) + gap + F.when(low_ground, PATTERN_WEIGHTS["low_ground"]).otherwise(0.0)


def combined_score(base: Column, resonance: Column, structure: Column, passed: Column, mixed: bool = True, factor: tuple[Column, Column, Column] | None = None, patterns: Column | None = None) -> Column:
    """0.55, 0.25 and 0.20 of three scores, one decimal; 0 where the year-line filter vetoes. Without ``mixed`` the base alone.

    ``factor`` (weight, bonus, penalty of the periods) and ``patterns`` (pattern_adjustment) come on top, within 0 and 100; neither
    revives a score of 0.
    """
    score = base
    if mixed:
        score = F.bround(0.55 * F.coalesce(base, F.lit(0.0)) + 0.25 * F.coalesce(resonance, F.lit(0.0)) + 0.2 * structure, 1)
    if factor:
        score = apply_factor(score, *factor)
    if patterns is not None:
        score = F.when(score > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(score + patterns, 1)))).otherwise(score)
    return F.when(~passed, 0.0).otherwise(score) if mixed else score


def chip_flags(results: DataFrame) -> DataFrame:
    """``results`` (turnover_20, price, high_120, platform_state) with price_pos, chip_low, chip_quiet and chip_low_unknown.

    Turnover under 2 percent is low chips at a low place (15 percent under the 120-bar high, or a platform that may be bought),
    quiet elsewhere; an unknown turnover is neither.
    """
    pos = sql_round(1 - F.try_divide(F.col("price"), F.col("high_120")), 4)
    low = F.coalesce(F.col("platform_state") == "buy flat", F.lit(False)) | F.coalesce(pos >= 0.15, F.lit(False))
    quiet = F.coalesce(F.col("turnover_20") < 2, F.lit(False))
    return results.withColumns({"price_pos": pos, "chip_low": quiet & low, "chip_quiet": quiet & ~low, "chip_low_unknown": F.col("turnover_20").isNull()})


#: Label and the flag it stands for, in the order of a result's labels.
RESULT_LABELS = {
    "band break": "vap_atr_break", "chips low": "chip_low", "true resonance": "true_resonance", "strong engulfing": "bull_engulf", "breakout gap": "gap_breakout", "continuation gap": "gap_continuation",
    "exhaustion gap": "gap_exhaustion", "low ground volume": "low_ground_volume",
}
QUALITY_LABELS = {"pullback": "pullback confirmed", "false": "false breakout", "direct": "direct breakout"}


def classify(results: DataFrame) -> DataFrame:
    """Stable flags of results (chip_flags(), platform_signal, true_resonance, engulfing, gap_up, gap_type, low_ground, stage, quality)
    and their labels. Every flag is true or false; unknown is not true."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "vap_atr_break": yes(F.col("platform_signal")), "true_resonance": yes(F.col("true_resonance")), "bull_engulf": yes(F.col("engulfing") == "strong"), "gap_up": yes(F.col("gap_up")),
        "gap_breakout": yes(F.col("gap_type") == "breakout"), "gap_continuation": yes(F.col("gap_type") == "continuation"), "gap_exhaustion": yes(F.col("gap_type") == "exhaustion"), "low_ground_volume": yes(F.col("low_ground")),
        "has_breakout": yes(F.col("quality") != "none"), "breakout_confirm": yes(F.col("quality") == "pullback"), "false_breakout": yes(F.col("quality") == "false"),
    }
    rows = results.withColumns(flags)
    stage = F.when(F.coalesce("stage", F.lit("unknown")) != "unknown", F.concat(F.lit("stage "), "stage"))
    quality = F.element_at(F.create_map(*(F.lit(x) for pair in QUALITY_LABELS.items() for x in pair)), F.col("quality"))
    named = [F.when(F.col(c), F.lit(label)) for label, c in RESULT_LABELS.items()]
    return rows.withColumn("labels", F.array_compact(F.array(*named, stage, F.when(F.col("quality").isNotNull(), quality))))


def signal_labels(flags: dict[str, Column]) -> Column:
    """The names of the flags that are true; unknown is not true."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())), lambda x: x.isNotNull())
