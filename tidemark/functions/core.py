"""Window and scalar building blocks. Missing values are NULL, never NaN; frames are trailing rows of one symbol."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

YEAR = 252


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def last(n: int) -> WindowSpec:
    """The last n rows, the current one included."""
    return by_symbol().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a), col(b))


def lag(x: Column | str, n: int = 1) -> Column:
    return F.lag(col(x), n).over(by_symbol()) if n >= 0 else F.lead(col(x), -n).over(by_symbol())


def finite(x: Column) -> Column:
    """x, NULL where it is no number or not finite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def full(x: Column | str, n: int, value: Column, at_least: int | None = None) -> Column:
    """value where the last n rows hold at_least (n) values of x, else NULL."""
    return F.when(F.count(col(x)).over(last(n)) >= (n if at_least is None else at_least), value)


def mean(x: Column | str, n: int, at_least: int | None = None) -> Column:
    return full(x, n, F.avg(col(x)).over(last(n)), at_least)


def std(x: Column | str, n: int, at_least: int | None = None) -> Column:
    return full(x, n, F.stddev_samp(col(x)).over(last(n)), at_least)


def total(x: Column | str, n: int, at_least: int | None = None) -> Column:
    return full(x, n, F.sum(col(x)).over(last(n)), at_least)


def highest(x: Column | str, n: int, at_least: int | None = None) -> Column:
    return full(x, n, F.max(col(x)).over(last(n)), at_least)


def lowest(x: Column | str, n: int, at_least: int | None = None) -> Column:
    return full(x, n, F.min(col(x)).over(last(n)), at_least)


def change(x: Column | str, n: int = 1) -> Column:
    """x over its value n rows ago, less one."""
    return div(x, lag(x, n)) - 1


def growth(r: Column | str, over: WindowSpec) -> Column:
    """Product of 1 + r over a frame, by logarithms; 0 once a return has reached -100 %."""
    r = F.coalesce(col(r), F.lit(0.0))
    return F.when(F.min(r).over(over) <= -1, F.lit(0.0)).otherwise(F.exp(F.sum(F.log1p(F.greatest(r, F.lit(-0.999999999999)))).over(over)))
