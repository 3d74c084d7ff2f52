"""Technical indicators: columns over trailing windows, and recursive ones worked out in one grouped pass.

A symbol's rows are exchanged once; all window columns share that order. Exponential means depend on the row before, so they run
as one applyInPandas over a symbol's rows, for all recursive indicators that are asked for together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import YEAR, change, col, div, full, highest, lag, last, lowest, mean, so_far, std, total
from tidemark.functions.recursive import RECURSIVE, with_recursive


def _bar() -> tuple[Column, Column, Column, Column, Column]:
    return tuple(F.col(c) for c in ("open", "high", "low", "close", "volume"))


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3



# ---- windows ----------------------------------------------------------------------------------------------------------------
def sma(n: int, x: Column | str = "close") -> Column:
    return mean(x, n)


def bollinger(n: int = 20, k: float = 2.0, x: Column | str = "close") -> dict[str, Column]:
    middle, width = mean(x, n), std(x, n)
    return {"bb_upper": middle + k * width, "bb_middle": middle, "bb_lower": middle - k * width}


def stochastic(k: int = 14, d: int = 3) -> dict[str, Column]:
    O, H, L, C, V = _bar()  # noqa: E741
    fast = 100 * div(C - lowest(L, k), highest(H, k) - lowest(L, k))
    return {"stoch_k": fast, "stoch_d": mean(fast, d)}


def williams_r(n: int = 14) -> Column:
    O, H, L, C, V = _bar()  # noqa: E741
    return -100 * div(highest(H, n) - C, highest(H, n) - lowest(L, n))


def momentum(n: int = 10, x: Column | str = "close") -> Column:
    return 100 * change(x, n)


def volatility(n: int = 20, x: Column | str = "close", days: int = YEAR) -> Column:
    return std(change(x), n) * F.sqrt(F.lit(float(days)))


def obv(first: float | None = None) -> Column:
    """Running volume signed by the close's move; the first row is `first`."""
    O, H, L, C, V = _bar()  # noqa: E741
    signed = F.signum(C - lag(C)) * V
    return F.when(lag(C).isNull(), F.lit(first).cast("double")).otherwise(F.sum(signed).over(so_far()))


def vwap() -> Column:
    O, H, L, C, V = _bar()  # noqa: E741
    return div(F.sum(typical() * V).over(so_far()), F.sum(V).over(so_far()))


def true_range() -> Column:
    O, H, L, C, V = _bar()  # noqa: E741
    return F.greatest(H - L, F.abs(H - lag(C)), F.abs(L - lag(C)))


def cci(n: int = 20, constant: float = 0.015) -> Column:
    held = F.collect_list(typical()).over(last(n))
    middle = F.avg(typical()).over(last(n))
    deviation = F.aggregate(held, F.lit(0.0), lambda s, v: s + F.abs(v - middle)) / F.size(held)
    return full(typical(), n, div(typical() - middle, constant * deviation))


def mfi(n: int = 14) -> Column:
    O, H, L, C, V = _bar()  # noqa: E741
    move, flow = typical() - lag(typical()), typical() * V
    up = full(typical(), n, F.sum(F.when(move > 0, flow).otherwise(0.0)).over(last(n)))
    down = full(typical(), n, F.sum(F.when(move < 0, flow).otherwise(0.0)).over(last(n)))
    return F.when(down == 0, F.when(up > 0, 100.0)).otherwise(100 - 100 / (1 + div(up, down)))


def ichimoku(conversion: int = 9, base: int = 26, span: int = 52, shift: int = 26) -> dict[str, Column]:
    """chikou looks ahead by `shift` rows; do not use it as a feature of its own row."""
    O, H, L, C, V = _bar()  # noqa: E741
    middle = lambda n: (highest(H, n) + lowest(L, n)) / 2
    return {
        "ichimoku_conversion": middle(conversion), "ichimoku_base": middle(base), "ichimoku_span_a": lag((middle(conversion) + middle(base)) / 2, shift),
        "ichimoku_span_b": lag(middle(span), shift), "ichimoku_chikou": lag(L, -shift),
    }


def garman_klass(n: int = 20) -> Column:
    O, H, L, C, V = _bar()  # noqa: E741
    bar = 0.5 * F.pow(F.log(div(H, L)), 2) - (2 * F.log(F.lit(2.0)) - 1) * F.pow(F.log(div(C, O)), 2)
    return F.sqrt(YEAR * mean(bar, n))


def parkinson(n: int = 20) -> Column:
    O, H, L, C, V = _bar()  # noqa: E741
    return mean(F.sqrt(YEAR * F.pow(F.log(div(H, L)), 2) / (4 * F.log(F.lit(2.0)))), n)


def vortex(n: int = 14) -> dict[str, Column]:
    O, H, L, C, V = _bar()  # noqa: E741
    ranged = total(true_range(), n)
    return {"vortex_plus": div(total(F.abs(H - lag(L)), n), ranged), "vortex_minus": div(total(F.abs(L - lag(H)), n), ranged)}


def donchian(n: int = 20) -> dict[str, Column]:
    O, H, L, C, V = _bar()  # noqa: E741
    up, down = highest(H, n), lowest(L, n)
    return {"donchian_upper": up, "donchian_middle": (up + down) / 2, "donchian_lower": down}


def ultimate(a: int = 7, b: int = 14, c: int = 28) -> Column:
    O, H, L, C, V = _bar()  # noqa: E741
    pressure, ranged = C - F.least(L, lag(C)), F.greatest(H, lag(C)) - F.least(L, lag(C))
    pressure, ranged = F.when(lag(C).isNotNull(), pressure), F.when(lag(C).isNotNull(), ranged)
    part = lambda n: div(total(pressure, n), total(ranged, n))
    return 100 * (4 * part(a) + 2 * part(b) + part(c)) / 7


def kst(rocs: tuple = (10, 15, 20, 30), smooth: tuple = (10, 10, 10, 15), signal: int = 9) -> dict[str, Column]:
    O, H, L, C, V = _bar()  # noqa: E741
    line = sum((i + 1) * mean(100 * change(C, r), s) for i, (r, s) in enumerate(zip(rocs, smooth, strict=True)))
    return {"kst": line, "kst_signal": mean(line, signal)}


def aroon(n: int = 25) -> dict[str, Column]:
    """Rows since the latest extreme of the last n rows, as a share of n."""
    O, H, L, C, V = _bar()  # noqa: E741
    since = lambda x, top: F.array_position(F.reverse(F.collect_list(x).over(last(n))), top) - 1
    up = full(H, n, 100.0 * (n - since(H, F.max(H).over(last(n)))) / n)
    down = full(L, n, 100.0 * (n - since(L, F.min(L).over(last(n)))) / n)
    return {"aroon_up": up, "aroon_down": down, "aroon_oscillator": up - down}


def rolling_stat(x: Column | str, n: int, stat: str) -> Column:
    """mean, std, min, max, sum, var, skew or kurt of full windows; the last two corrected for sample bias."""
    x, w = col(x), last(n)
    plain = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "var": F.var_samp}
    if stat in plain:
        return full(x, n, plain[stat](x).over(w))
    if stat == "skew":
        return full(x, n, F.skewness(x).over(w) * float((n * (n - 1)) ** 0.5 / (n - 2)))
    if stat == "kurt":
        return full(x, n, ((n + 1) * F.kurtosis(x).over(w) + 6) * float((n - 1) / ((n - 2) * (n - 3))))
    raise ValueError(f"unknown statistic: {stat}")


def z_score(x: Column | str, n: int = 252) -> Column:
    return div(col(x) - mean(x, n), std(x, n))


def basic_bundle(df: DataFrame) -> DataFrame:
    """df with the 22 basic columns. Windows come first: the grouped pass then finds each symbol's rows together already."""
    O, H, L, C, V = _bar()  # noqa: E741
    columns = {f"sma_{n}": sma(n) for n in (20, 50, 200)} | {"momentum_10": momentum(10)} | bollinger() | {"volatility_20": volatility(20)} | stochastic()
    columns |= {"williams_r": williams_r(), "obv": obv(), "volume_sma_20": mean(V, 20), "volume_ratio": div(V, mean(V, 20))}
    df = df.select("*", *[v.alias(k) for k, v in columns.items()])
    return with_recursive(df, [("ema", 12), ("ema", 26), ("macd",), ("rsi", 14), ("atr", 14), ("adx", 14)])


def advanced_bundle(df: DataFrame) -> DataFrame:
    """df with the advanced columns."""
    columns = stochastic() | {"williams_r": williams_r(), "cci": cci(), "mfi": mfi(), "obv": obv(0.0)} | ichimoku()
    columns |= {"garman_klass": garman_klass(), "parkinson": parkinson()} | vortex() | donchian() | {"ultimate": ultimate()} | kst() | aroon()
    df = df.select("*", *[v.alias(k) for k, v in columns.items()])
    return with_recursive(df, [("keltner",), ("chaikin",), ("mass",)])


#: Features by name, as a function that makes the column or as a recursive indicator; register() adds to them.
FEATURES: dict[str, Callable[[], Column] | tuple] = {
    "sma_20": lambda: sma(20), "sma_50": lambda: sma(50), "sma_200": lambda: sma(200), "ema_12": ("ema", 12), "ema_26": ("ema", 26), "rsi_14": ("rsi", 14), "rsi_7": ("rsi", 7), "atr_14": ("atr", 14),
    "volatility_20": lambda: volatility(20), "momentum_10": lambda: momentum(10), "returns_1d": lambda: change("close"), "returns_5d": lambda: change("close", 5), "returns_20d": lambda: change("close", 20),
    "volume_ratio": lambda: div("volume", mean("volume", 20)),
}


def register(name: str, feature: Callable[[], Column] | tuple) -> None:
    FEATURES[name] = feature


def features(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """df with named features; an unknown name is an error."""
    names = list(FEATURES) if names is None else names
    if unknown := [n for n in names if n not in FEATURES]:
        raise KeyError(f"unknown features: {unknown}")
    df = df.select("*", *[FEATURES[n]().alias(n) for n in names if not isinstance(FEATURES[n], tuple)])
    recursive = [FEATURES[n] for n in names if isinstance(FEATURES[n], tuple)]
    return with_recursive(df, recursive) if recursive else df


__all__ = ["FEATURES", "RECURSIVE", "advanced_bundle", "basic_bundle", "features", "register", "with_recursive"]
