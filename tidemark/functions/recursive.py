"""Recursive indicators: exponential means and what is made of them, worked out over a symbol's rows at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


def _ewm(x: pd.Series, span: int, least: int = 0) -> pd.Series:
    return x.ewm(span=span, adjust=False, min_periods=least).mean()


def _tr(d: pd.DataFrame) -> pd.Series:
    before = d.close.shift()
    return pd.concat([d.high - d.low, (d.high - before).abs(), (d.low - before).abs()], axis=1).max(axis=1)


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return a / b.where(b != 0)


def _rsi(x: pd.Series, n: int) -> pd.Series:
    move = x.diff().fillna(0.0)
    up, down = _ewm(move.clip(lower=0), n, n), _ewm(-move.clip(upper=0), n, n)
    return (100 - 100 / (1 + _ratio(up, down))).mask((down == 0) & (up > 0), 100.0)


def _adx(d: pd.DataFrame, n: int) -> pd.Series:
    up, down = d.high.diff(), -d.low.diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    ranged = _ewm(_tr(d), n, n)
    plus, minus = 100 * _ratio(_ewm(plus, n, n), ranged), 100 * _ratio(_ewm(minus, n, n), ranged)
    return _ewm(100 * _ratio((plus - minus).abs(), plus + minus), n, n)


def _macd(x: pd.Series, fast: int, slow: int, signal: int) -> dict[str, pd.Series]:
    line = _ewm(x, fast, fast) - _ewm(x, slow, slow)
    smooth = _ewm(line, signal, signal)
    return {"macd": line, "macd_signal": smooth, "macd_hist": line - smooth}


def _keltner(d: pd.DataFrame, n: int, atr: int, k: float) -> dict[str, pd.Series]:
    middle, width = _ewm(d.close, n), _tr(d).rolling(atr).mean()
    return {"keltner_upper": middle + k * width, "keltner_middle": middle, "keltner_lower": middle - k * width}


def _chaikin(d: pd.DataFrame, n: int, roc: int) -> pd.Series:
    spread = _ewm(d.high - d.low, n)
    return 100 * (_ratio(spread, spread.shift(roc)) - 1)


def _mass(d: pd.DataFrame, n: int, window: int) -> pd.Series:
    once = _ewm(d.high - d.low, n)
    return _ratio(once, _ewm(once, n)).rolling(window).sum()


def _before(x: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each value how many of those before it are below it, and how many equal it: blocks first, then sorted halves that double."""
    n = len(x)
    below, same = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for s in range(0, n, block):
        own = x[s : s + block]
        below[s : s + block] += np.tril(own[None] < own[:, None], -1).sum(axis=1)
        same[s : s + block] += np.tril(own[None] == own[:, None], -1).sum(axis=1)
    width = block
    while width < n:
        for s in range(0, n - width, 2 * width):
            left, right = np.sort(x[s : s + width]), slice(s + width, s + 2 * width)
            low, high = np.searchsorted(left, x[right], "left"), np.searchsorted(left, x[right], "right")
            below[right] += low
            same[right] += high - low
        width *= 2
    return below, same


def _expanding_rank(x: pd.Series, at_least: int) -> pd.Series:
    """Average rank of x among the values so far, from 0 to 1; missing values have none and do not count."""
    here = x.dropna()
    below, same = _before(here.to_numpy(float))
    number = np.arange(1, len(here) + 1)
    rank = pd.Series((below + same / 2) / np.maximum(number - 1, 1), index=here.index)
    return rank.where(number >= max(at_least, 2)).reindex(x.index)


#: Recursive indicators: names of their columns, and a function of a symbol's rows and the parameters.
RECURSIVE: dict[str, tuple[Callable, Callable]] = {
    "ema": (lambda n: [f"ema_{n}"], lambda d, n: {f"ema_{n}": _ewm(d.close, n, n)}),
    "rsi": (lambda n=14: [f"rsi_{n}"], lambda d, n=14: {f"rsi_{n}": _rsi(d.close, n)}),
    "macd": (lambda *a: ["macd", "macd_signal", "macd_hist"], lambda d, fast=12, slow=26, signal=9: _macd(d.close, fast, slow, signal)),
    "atr": (lambda n=14: [f"atr_{n}"], lambda d, n=14: {f"atr_{n}": _ewm(_tr(d), n, n)}),
    "adx": (lambda n=14: [f"adx_{n}"], lambda d, n=14: {f"adx_{n}": _adx(d, n)}),
    "keltner": (lambda *a: ["keltner_upper", "keltner_middle", "keltner_lower"], lambda d, n=20, atr=10, k=2.0: _keltner(d, n, atr, k)),
    "chaikin": (lambda *a: ["chaikin_volatility"], lambda d, n=10, roc=10: {"chaikin_volatility": _chaikin(d, n, roc)}),
    "expanding_rank": (lambda column="close", *a: ["expanding_rank"], lambda d, column="close", at_least=60: {"expanding_rank": _expanding_rank(d[column], at_least)}),
    "mass": (lambda *a: ["mass_index"], lambda d, n=9, window=25: {"mass_index": _mass(d, n, window)}),
}


def with_recursive(df: DataFrame, wanted: list[tuple]) -> DataFrame:
    """df with the columns of recursive indicators, e.g. [("ema", 12), ("macd",)], in one pass over each symbol."""
    names = [n for kind, *args in wanted for n in RECURSIVE[kind][0](*args)]
    schema = StructType([*[f for f in df.schema.fields if f.name not in names], *[StructField(n, DoubleType()) for n in names]])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable")
        for kind, *args in wanted:
            rows = rows.assign(**RECURSIVE[kind][1](rows, *args))
        return rows[schema.fieldNames()]

    return df.groupBy("symbol").applyInPandas(run, schema)
