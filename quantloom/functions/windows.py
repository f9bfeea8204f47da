"""Column builders over the bars of one symbol, ordered by date."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SYMBOL, DATE = "symbol", "dt"


def series() -> WindowSpec:
    return Window.partitionBy(SYMBOL).orderBy(DATE)


def last(n: int) -> WindowSpec:
    """The last ``n`` rows, the current one included."""
    return series().rowsBetween(-(n - 1), 0)


def before(n: int) -> WindowSpec:
    """The ``n`` rows before the current one."""
    return series().rowsBetween(-n, -1)


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return Window.partitionBy(SYMBOL)


def lag(c: Column | str, n: int = 1) -> Column:
    return F.lag(c, n).over(series())


def rolling_mean(c: str, n: int) -> Column:
    """NULL until ``n`` values that are not NULL stand in the window."""
    return F.when(F.count(c).over(last(n)) == n, F.avg(c).over(last(n)))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def sql_round(c: Column | str, digits: int) -> Column:
    """Doubles rounded as SQL engines do it: scaled, to the nearest whole number (halves away from zero), scaled back. F.round rounds
    the shortest decimal of a double instead, so it differs from them at ties that adding has moved by a last place."""
    c = F.col(c) if isinstance(c, str) else c
    scaled = c * F.lit(10.0**digits)
    return F.when(F.abs(scaled) == float("inf"), c).otherwise(F.round(scaled) / F.lit(10.0**digits))


def percent_change(c: str, n: int = 1) -> Column:
    return (ratio(F.col(c), lag(c, n)) - 1) * 100


def crosses(a: Column | str, b: Column | str) -> Column:
    """1 where ``a`` comes to stand above ``b``, -1 where below, else 0; 0 beside a NULL."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return crossing(lag(a), lag(b), a, b)


def crossing(a0: Column, b0: Column, a1: Column, b1: Column) -> Column:
    return F.when((a0 <= b0) & (a1 > b1), 1).when((a0 >= b0) & (a1 < b1), -1).otherwise(0)
