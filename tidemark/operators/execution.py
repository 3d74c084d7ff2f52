"""Costs of execution as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.core import col, div

#: Coefficients of permanent and temporary impact. Fixed values.
PERMANENT, TEMPORARY = 0.314, 0.142


def _valid(size: Column, volume: Column, volatility: Column, hours: float) -> Column:
    if hours <= 0:
        raise ValueError("the time to trade must be positive")
    return (volume > 0) & (volatility >= 0) & (size >= 0)


def impact_parts(size: Column | str, volume: Column | str, volatility: Column | str, hours: float = 1.0) -> Column:
    """Permanent and temporary impact of an order as a struct of shares of the price; NULL where volume or volatility make no sense."""
    size, volume, volatility = col(size), col(volume), col(volatility)
    part = div(size, volume)
    ok = _valid(size, volume, volatility, hours)
    permanent = PERMANENT * F.sqrt(volatility) * part
    temporary = TEMPORARY * F.sqrt(volatility) * F.pow(part, 0.6) / hours
    return F.when(ok, F.struct(permanent.alias("permanent"), temporary.alias("temporary")))


def impact(size: Column | str, volume: Column | str, volatility: Column | str, hours: float = 1.0) -> Column:
    parts = impact_parts(size, volume, volatility, hours)
    return parts["permanent"] + parts["temporary"]


def execution_cost(value: Column | str, volume: Column | str, volatility: Column | str, commission: float = 1.0, spread_bps: float = 5.0, hours: float = 1.0) -> Column:
    """commission, spread, impact and total cost of an order of that value; volume is in money here."""
    value = col(value)
    spread = value * spread_bps / 10_000 / 2
    moved = value * impact(value, volume, volatility, hours)
    return F.struct(F.lit(commission).alias("commission"), spread.alias("spread"), moved.alias("impact"), (commission + spread + moved).alias("total"))
