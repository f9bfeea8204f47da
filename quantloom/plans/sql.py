"""The same bars and columns in SQL, for the queries' twins."""

from __future__ import annotations

TICKS = """ticks AS (SELECT n_name AS symbol, l_shipdate::DATE AS dt, l_extendedprice / l_quantity AS price, l_quantity AS q, l_extendedprice AS a,
  ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
SECTOR_TICKS = TICKS.replace("n_name AS symbol", "r_name AS symbol").replace("n_nationkey)", "n_nationkey JOIN region ON n_regionkey = r_regionkey)")
MARKET_TICKS = """ticks AS (SELECT 'ALL' AS symbol, l_shipdate::DATE AS dt, l_extendedprice / l_quantity AS price, l_quantity AS q, l_extendedprice AS a,
  ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)"""
SUPPLIER_TICKS = MARKET_TICKS.replace("'ALL'", "l_suppkey::VARCHAR")
ALL_DAYS = """alldays AS (SELECT symbol, dt, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close,
  sum(q) AS volume, round(sum(a), 2) AS amount, sum(q) * 100 / 2000 AS turn FROM ticks GROUP BY 1, 2)"""
BARS = "bars AS (SELECT * FROM alldays WHERE isodow(dt) < 6)"
MEAN = "CASE WHEN count({c}) OVER (w ROWS BETWEEN {b} PRECEDING AND CURRENT ROW) = {n} THEN avg({c}) OVER (w ROWS BETWEEN {b} PRECEDING AND CURRENT ROW) END"


def mean(c: str, n: int) -> str:
    return MEAN.format(c=c, n=n, b=n - 1)


def cross(a0: str, b0: str, a1: str, b1: str) -> str:
    return f"CASE WHEN {a0} <= {b0} AND {a1} > {b1} THEN 1 WHEN {a0} >= {b0} AND {a1} < {b1} THEN -1 ELSE 0 END"


W = "WINDOW w AS (PARTITION BY symbol ORDER BY dt)"
IND = f"""i1 AS (SELECT *, {", ".join(f"{mean('close', n)} AS ma{n}" for n in (5, 10, 20, 60, 250, 377, 610))},
  lag(close) OVER w AS c1, lag(volume) OVER w AS v1, {mean("volume", 5)} AS vma5, {mean("volume", 20)} AS vma20,
  {", ".join(f"{mean('turn', n)} AS turn_ma{n}" for n in (5, 10, 20))}, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS rn,
  stddev_samp(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd20,
  {", ".join(f"(close / lag(close, {n}) OVER w - 1) * 100 AS change{n}" for n in (1, 5, 10, 20))},
  greatest(coalesce(close - lag(close) OVER w, 0), 0) AS up, greatest(-coalesce(close - lag(close) OVER w, 0), 0) AS down FROM bars {W}),
ind AS (SELECT *, lag(ma5) OVER w AS ma5p, lag(ma10) OVER w AS ma10p, lag(ma20) OVER w AS ma20p, lag(vma20) OVER w AS vma20p,
  {", ".join(f"(ma{n} - lag(ma{n}, 5) OVER w) / 5 AS ma{n}_slope" for n in (5, 10, 20, 60))},
  CASE WHEN ma20 IS NULL THEN NULL WHEN ma5 > ma10 AND ma10 > ma20 AND (ma60 IS NULL OR ma20 > ma60) THEN 1
       WHEN ma5 < ma10 AND ma10 < ma20 AND (ma60 IS NULL OR ma20 < ma60) THEN -1 ELSE 0 END AS arrangement,
  volume / vma5 AS volume_ratio, {mean("up", 14)} AS gain, {mean("down", 14)} AS loss FROM i1 {W})"""


def over(body: str, *ctes: str, ticks: str = TICKS) -> str:
    """``body`` over the bars and further CTEs."""
    return "WITH " + ", ".join([ticks, ALL_DAYS, BARS, *ctes]) + " " + body


def weeks(unit: str = "week", source: str = "alldays") -> str:
    label = "date_trunc('week', dt)::DATE + 4" if unit == "week" else "last_day(dt)"
    least = 3 if unit == "week" else 10
    return f"""r0 AS (SELECT symbol, {label} AS period, arg_min(open, dt) AS open, max(high) AS high, min(low) AS low, arg_max(close, dt) AS close, sum(volume) AS volume,
  round(sum(amount), 2) AS amount, coalesce(sum(turn), 0) AS turn, count(*) AS n_bars FROM {source} WHERE isodow(dt) < 6 GROUP BY 1, 2),
r1 AS (SELECT *, max(period) OVER (PARTITION BY symbol) AS newest FROM r0),
res AS (SELECT symbol, period::DATE AS dt, open, high, low, close, volume, amount, turn, n_bars FROM r1 WHERE n_bars >= {least} OR period = newest)"""
