"""Longer jobs put together from the other operators: turnover back-fill, portfolio evaluation, counterfactual gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import lag, sql_round
from quantloom.operators import indicators, portfolio, quality, rules, waves


def macd_summary(bars: DataFrame) -> DataFrame:
    """Newest dif, dea, doubled histogram, state and cross of every symbol, four decimals; unknown with one bar."""
    made = indicators.macd(bars).withColumns({"_p": lag("macd"), "_q": lag("macd_signal"), "n_bars": F.count(F.lit(1)).over(indicators.whole())})
    dif, dea = F.col("macd"), F.col("macd_signal")
    state = F.when(F.col("n_bars") < 2, "unknown").when(dif > dea, "golden").when(dif < dea, "death").otherwise("flat")
    cross = F.when((F.col("_p") <= F.col("_q")) & (dif > dea), "golden").when((F.col("_p") >= F.col("_q")) & (dif < dea), "death")
    four = lambda c, n: sql_round(F.when(F.col("n_bars") >= 2, c), 4).alias(n)
    return indicators.latest(made.withColumns({"state": state, "cross": cross})).select("symbol", "dt", four(dif, "dif"), four(dea, "dea"), four((dif - dea) * 2, "hist"), "state", "cross", "n_bars")


def backfill_turnover(bars: DataFrame, shares: DataFrame, longest: int = 5) -> DataFrame:
    """``bars`` (with turn, turn_source) with unknown turnover filled: from the newest share snapshot not after the day where
    volume was traded (source ``derived``), then short gaps from the value before (source ``filled``). Known values stay."""
    rows = quality.as_of(bars.withColumn("shares", F.lit(None).cast("double")), shares, "shares")
    made = rules.derived_turnover(F.col("volume"), F.col("shares"))
    derive = F.col("turn").isNull() & (F.col("volume") > 0) & made.isNotNull()
    rows = rows.withColumn("turn_source", F.when(derive, "derived").otherwise(F.col("turn_source"))).withColumn("turn", F.when(derive, made).otherwise(F.col("turn")))
    rows = indicators.fill_gaps(rows, "turn", longest)
    short = F.col("turn").isNull() & F.col("turn_filled").isNotNull()
    return rows.withColumns({"turn_source": F.when(short, "filled").otherwise(F.col("turn_source")), "turn": F.col("turn_filled")}).drop("turn_filled", "shares")


def backfill_counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows, rows with turnover before and after, and rows by the source of what was filled."""
    was = before.agg(F.count(F.lit(1)).alias("n_rows"), F.count("turn").alias("known_before"))
    now = after.agg(F.count("turn").alias("known_after"), F.count_if(F.col("turn_source") == "derived").alias("derived"), F.count_if(F.col("turn_source") == "filled").alias("filled"))
    return was.join(F.broadcast(now))


def counterfactual_gates(rows: DataFrame, threshold: float = 85.0) -> DataFrame:
    """One row: how many rows (gates, score, position) would pass with the high-position gate hard, soft or off; off also gives
    rows in high position their 15 points back."""
    base = F.lit(True)
    for g in rules.GATES:
        if g not in ("market_not_high", "score_reached"):
            base = base & F.coalesce(F.element_at("gates", F.lit(g)), F.lit(False))
    high, score = F.col("position") == "high", F.col("score")
    off = F.when(high, score + 15).otherwise(score)
    return rows.where(base & score.isNotNull()).agg(
        F.count_if(~high & (score >= threshold)).alias("hard_true"), F.count_if(score >= threshold).alias("soft_true"), F.count_if(off >= threshold).alias("off_true")
    )


def evaluate_portfolio(found: DataFrame, returns: DataFrame, equity: float = 1e6, lot: int = 100, **sizing: float) -> DataFrame:
    """``found`` (symbol, entry, stop, verdict) with sizes, and for candidates sizes scaled so that the correlated risk keeps its limit.

    The scale is one row, joined to all; correlations are computed among candidates only.
    """
    sized = portfolio.position_sizes(found, equity=equity, lot=lot, **sizing)
    chosen = sized.where("verdict = 'candidate' and shares > 0")
    rho = portfolio.correlations(returns.join(chosen.select("symbol"), "symbol", "left_semi"))
    scale = portfolio.portfolio_risk(chosen, rho, equity=equity).select("scale")
    rows = sized.join(F.broadcast(scale))
    suggested = F.when((F.col("verdict") == "candidate") & (F.col("shares") > 0), F.floor(F.col("shares") * F.col("scale") / lot) * lot).otherwise(0)
    rows = rows.withColumn("suggested_shares", suggested.cast("long"))
    return rows.withColumn("suggested_risk", sql_round(F.col("suggested_shares") * F.coalesce(F.col("entry") - F.col("stop"), F.lit(0.0)), 2))


def attach_waves(results: DataFrame, evaluated: DataFrame, most: int | None = None, pool: int = 500, top: int = 200) -> DataFrame:
    """``results`` (symbol, score) with the verdict of ``evaluated``: for the best ``most`` by score, or the best ``top`` where the
    pool is larger than ``pool``; others are ``not_evaluated``. The limit is the report's."""
    from pyspark.sql import Window

    keep = most if most is not None else (top if results.count() > pool else None)
    rows = results.join(evaluated.select("symbol", "verdict"), "symbol", "left")
    if keep is not None:
        # one row per symbol
        rows = rows.withColumn("_place", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "symbol")))
        rows = rows.withColumn("verdict", F.when(F.col("_place") <= keep, F.col("verdict"))).drop("_place")
    return rows.withColumn("verdict", F.coalesce("verdict", F.lit("not_evaluated")))


def scan_waves(bars: DataFrame, positions: DataFrame, min_bars: int = 60) -> tuple[DataFrame, DataFrame]:
    """Verdicts of all symbols with enough valid bars, and (symbol, n_bars) of those refused."""
    counts = quality.valid_bars(bars, strict=True).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    return waves.rules_and_verdict(waves.wave_structure(bars), positions), counts.where(F.col("n_bars") < min_bars)
