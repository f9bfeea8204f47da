"""Returns across symbols: correlations, position sizes, portfolio risk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import sql_round


def _pearson(x: str, y: str) -> Column:
    """NULL where one side does not move."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


#: Cells (symbols x days) of a block's matrix; a task holds two blocks and a few products of theirs.
BLOCK_CELLS = 2**20


def _moments(one: pd.DataFrame, other: pd.DataFrame) -> dict[str, np.ndarray]:
    """Days in common and Pearson's rho (NaN where one side does not move) of all rows of ``one`` with all rows of ``other``.

    The matrices hold 0 on days without a return, the masks say which; every sum over common days is one matrix product.
    """
    days = np.unique(np.concatenate([*one["days"], *other["days"]]))

    def filled(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, known = np.zeros((len(rows), len(days))), np.zeros((len(rows), len(days)))
        for i, (d, r) in enumerate(zip(rows["days"], rows["rets"], strict=True)):
            at = np.searchsorted(days, d)
            known[i, at], x[i, at] = 1.0, np.asarray(r, float) - r[0]  # rho does not change, and a series that does not move is 0
        return x, known

    (x, p), (y, q) = filled(one), filled(other)
    n, sx, sy, xx, yy, xy = p @ q.T, x @ q.T, p @ y.T, (x * x) @ q.T, p @ (y * y).T, x @ y.T
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy, c = xx - sx * sx / n, yy - sy * sy / n, xy - sx * sy / n
        # what rounding leaves of a series that does not move on the common days
        moves = (vx > 1e-12 * xx) & (vy > 1e-12 * yy)
        return {"n": n, "rho": np.where(moves, c / np.sqrt(np.where(moves, vx * vy, 1.0)), np.nan)}


def correlations(returns: DataFrame, least: int = 20, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """a, b, n_common, rho, assumed for every pair of symbols a < b, also those that share no day.

    rho is over the shared days, four decimals, within -1 and 1; 0 and assumed where they are fewer than ``least`` or one
    series does not move. ``returns`` has one row for each symbol and day at most; rows without a return are left out.

    A matrix of all symbols is what is asked for, so the work is one matrix product for each pair of blocks of symbols: a
    symbol's history becomes one row, and every block is sent to the pairs that it is part of. Blocks have as many symbols as
    keep a matrix at ``block_cells``; no day is a key, so no busy day makes a task large.
    """
    kind = returns.schema["dt"].dataType.typeName()
    day = F.unix_date("dt") if kind == "date" else F.unix_micros(F.col("dt").cast("timestamp")) if kind.startswith("timestamp") else F.col("dt")
    series = returns.where("ret is not null").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(day.cast("long").alias("d"), F.col("ret").alias("r")))).alias("x"))
    series = series.select("symbol", F.col("x.d").alias("days"), F.col("x.r").alias("rets"))
    size = returns.where("ret is not null").agg(F.approx_count_distinct("symbol").alias("symbols"), F.approx_count_distinct("dt").alias("days")).first()
    n_blocks = max(1, -(-size["symbols"] // max(1, block_cells // max(1, size["days"]))))
    mine = F.pmod(F.xxhash64("symbol"), F.lit(n_blocks)).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))))
    sent = series.withColumn("block", mine).withColumn("pair", pairs).select("pair.i", "pair.j", "block", "symbol", "days", "rets")

    def rho_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        one, other = rows[rows["block"] == i], rows[rows["block"] == j]
        found = _moments(one, other)
        a, b = one["symbol"].to_numpy(), other["symbol"].to_numpy()
        at = np.nonzero(a[:, None] < b[None, :]) if i == j else np.nonzero(np.ones((len(a), len(b)), bool))
        first, second = a[at[0]], b[at[1]]
        swap = first > second
        return pd.DataFrame({"a": np.where(swap, second, first), "b": np.where(swap, first, second), "n_common": found["n"][at].astype(np.int64), "r": found["rho"][at]})

    made = sent.groupBy("i", "j").applyInPandas(rho_of, "a string, b string, n_common long, r double")
    known = (F.col("n_common") >= least) & F.col("r").isNotNull() & ~F.isnan("r")
    value = F.when(known, sql_round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r"))), 4)).otherwise(0.0)
    return made.select("a", "b", "n_common", value.alias("rho"), (~known).alias("assumed"))


def closest_pairs(rho: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` pairs with the highest known correlation, equal ones by name."""
    return rho.where("not assumed").orderBy(F.desc("rho"), "a", "b").limit(top)


def position_sizes(entries: DataFrame, equity: float = 1e6, risk: float = 0.01, most: float = 0.2, lot: int = 100) -> DataFrame:
    """Shares by equity * risk / (entry - stop), in whole lots, at most ``most`` of the equity; reason where it is none."""
    gap = F.col("entry") - F.col("stop")
    by_risk = F.when(gap > 0, F.floor(equity * risk / gap / lot) * lot)
    by_cap = F.floor(equity * most / F.col("entry") / lot) * lot
    shares = F.coalesce(F.least(by_risk, by_cap), F.lit(0)).cast("long")
    reason = F.when(gap.isNull() | (gap <= 0), "stop not below entry").when(by_risk == 0, "risk too small for a lot").when(by_cap < by_risk, "capped by position").otherwise("by risk")
    return entries.withColumns({"shares": shares, "reason": reason}).withColumn("risk", F.col("shares") * F.greatest(gap, F.lit(0.0)))


def portfolio_risk(risks: DataFrame, rho: DataFrame, equity: float = 1e6, limit: float = 0.06) -> DataFrame:
    """One row: the risk sqrt(sum of r_i r_j rho_ij), the plain sum, their ratio, share of the equity and scale down to ``limit``."""
    r = risks.where("risk > 0").select("symbol", "risk")
    own = r.agg(F.coalesce(F.sum(F.col("risk") * F.col("risk")), F.lit(0.0)).alias("own"), F.coalesce(F.sum("risk"), F.lit(0.0)).alias("plain"), F.count(F.lit(1)).alias("n"))
    pairs = rho.join(r.withColumnsRenamed({"symbol": "a", "risk": "ra"}), "a").join(r.withColumnsRenamed({"symbol": "b", "risk": "rb"}), "b")
    cross = pairs.agg(F.coalesce(F.sum(F.col("ra") * F.col("rb") * F.col("rho")) * 2, F.lit(0.0)).alias("cross"))
    both = own.join(F.broadcast(cross))
    total = F.sqrt(F.greatest(F.col("own") + F.col("cross"), F.lit(0.0)))
    return both.select("n", F.col("plain").alias("plain_risk"), total.alias("risk"), F.try_divide(total, F.col("plain")).alias("ratio"), (total / equity * 100).alias("pct_equity"), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(limit * equity), total), F.lit(1.0))).alias("scale"))


def related(closes: DataFrame, sector_returns: DataFrame, relation: DataFrame, least: int = 15, top: int = 5, most: int = 250) -> DataFrame:
    """Per sector the ``top`` members whose closes correlate most with the sector's returns on shared days.

    Levels are set against returns, as the screen that this serves does. ``most`` members of a sector, by symbol, are taken.
    """
    members = relation.withColumn("_rn", F.row_number().over(Window.partitionBy("sector").orderBy("symbol"))).where(F.col("_rn") <= most).drop("_rn")
    rows = closes.select("symbol", "dt", "close").join(members, "symbol").join(sector_returns.select(F.col("symbol").alias("sector"), "dt", "ret"), ["sector", "dt"])
    made = rows.groupBy("sector", "symbol").agg(F.count(F.lit(1)).alias("n_common"), _pearson("close", "ret").alias("rho")).where((F.col("n_common") >= least) & F.col("rho").isNotNull())
    rank = F.row_number().over(Window.partitionBy("sector").orderBy(F.col("rho").desc(), "symbol"))
    return made.withColumn("rank", rank).where(F.col("rank") <= top)
