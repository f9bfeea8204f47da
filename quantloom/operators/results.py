"""One nested result for each symbol, assembled once and stored; tables and snapshots are projections of it, which read single fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import sql_round
from quantloom.operators import rules

#: The blocks of a technical snapshot and the columns in each.
SNAPSHOT = {
    "ma": ("arrangement", "arrangement_strength", "ma5", "ma10", "ma20", "ma60", "ma250", "ma5_slope", "ma_cross", "ma20_cross"),
    "po5": ("days_since_break", "po5_fan5"),
    "chip": ("returned_to_ma5", "chip_turn", "chip_band", "chip_trend"),
    "volume_price": ("volume_ratio", "pv_fit", "obv_cross", "volume_level", "volume_break", "momentum_state", "change5", "change20"),
    "turnover": ("turn", "turn_zone", "turn_ma5", "turn_ma10", "turn_ma20", "turn_place"),
    "multi_period": ("week_trend", "month_trend", "week_box", "month_box", "anchored"),
}
#: The other blocks of a result.
BLOCKS = {
    "signal": ("final_score", "advice", "yearline_pass", "anchored", "po5_fan5", "main_wave"),
    "yearline": ("above_ma250", "above_ma60", "arranged", "ma5_above_ma250", "ma10_above_ma250", "ma20_above_ma250", "ma60_above_ma250"),
    "checklist": (*rules.CHECKS, "checks_met", "checks_verdict"),
    "platform": ("platform_state", "platform_signal", "buy_flat", "platform_top", "platform_bottom", "lookback"),
    "chips": ("turnover_20", "price_pos", "chip_low", "chip_quiet", "chip_low_unknown"),
    "stage": ("stage", "quality"),
}


def technical_snapshot(rows: DataFrame) -> Column:
    """The technical blocks of rows as one struct; what a row does not have is NULL in it, as is what its history is too short for."""
    value = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return F.struct(*(F.struct(*(value(c).alias(c) for c in columns)).alias(block) for block, columns in SNAPSHOT.items()))


def assemble(rows: DataFrame) -> DataFrame:
    """``rows`` (newest bars with the columns of all rules) as nested results: rules.nested_result() with the blocks above, the
    technical snapshot and the labels."""
    blocks = [F.struct(*(F.col(c) for c in columns if c in rows.columns)).alias(b) for b, columns in BLOCKS.items()]
    beside = rows.select("symbol", *blocks, technical_snapshot(rows).alias("technical"), F.col("labels") if "labels" in rows.columns else F.array().cast("array<string>").alias("labels"))
    return rules.nested_result(rows).join(beside, "symbol")


def slim(nested: DataFrame) -> DataFrame:
    """A result without its large parts, as lists show it."""
    return nested.drop("technical", "yearline", "checklist")


def scan_table(nested: DataFrame) -> DataFrame:
    """A scan's table, a row for each result: yes, no or nothing for what is unknown; whether it is an index; the tags of turnover and
    style. Reads the fields that it shows and no others."""
    sign = lambda c: F.when(F.col(c), "yes").when(~F.col(c), "no").otherwise("")
    is_index = F.coalesce(F.col("is_index"), F.lit(False)) if "is_index" in nested.columns else F.lit(False)
    turn = F.col("chips.turnover_20")
    return nested.select(
        "symbol", F.when(is_index, "index").otherwise("stock").alias("kind"), F.col("sector.name").alias("sector"), F.col("signal.final_score").alias("score"), F.coalesce("signal.advice", F.lit("")).alias("advice"),
        *(sign(f"signal.{c}").alias(c) for c in ("yearline_pass", "anchored", "po5_fan5")), F.col("checklist.checks_met").alias("checks_met"),
        *(F.when(F.col(f"chips.{c}"), "yes").otherwise("no").alias(c) for c in ("chip_low", "chip_quiet")), rules.turnover_tag(turn).alias("turnover_tag"), rules.style_tag(turn, F.col("signal.yearline_pass"), F.col("signal.main_wave")).alias("style_tag"),
        sql_round(F.col("chips.price_pos") * 100, 1).alias("below_high_pct"), "dt", *(sign(f"yearline.{c}").alias(f"year_{c}") for c in BLOCKS["yearline"]), *(sign(f"checklist.{c}").alias(f"wave_{c}") for c in rules.CHECKS),
    )


def split_rows(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table's stocks and its indexes."""
    return table.where("kind = 'stock'"), table.where("kind = 'index'")


def scan_scope(jobs: DataFrame) -> DataFrame:
    """``jobs`` (scan_type, watchlist array, universe array, row_limit) with what they cover: board, watchlist, sector, limit or full. An
    empty watchlist and a limit of 0 are none; an empty universe is one."""
    scope = (
        F.when(F.col("scan_type") == "board", "board").when(F.coalesce(F.size("watchlist") > 0, F.lit(False)), "watchlist")
        .when(F.col("universe").isNotNull(), "sector").when(F.coalesce(F.col("row_limit") != 0, F.lit(False)), "limit").otherwise("full")
    )
    return jobs.withColumn("scope", scope)
