"""Strategies: rules over indicator columns, their templates, and the signals they give."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import indicators as I  # noqa: N812
from tidemark.functions.core import change, div, lag, mean

COMPARISONS = (">", ">=", "<", "<=", "==", "!=", "cross_above", "cross_below")


@dataclass(frozen=True)
class Rule:
    """indicator, comparison, and a number or another indicator."""

    indicator: str
    operator: str
    value: float | str

    def __post_init__(self):
        if self.operator not in COMPARISONS:
            raise ValueError(f"unknown comparison: {self.operator}")


@dataclass(frozen=True)
class Group:
    """Rules and groups under AND or OR; an empty group is false everywhere."""

    rules: tuple = ()
    logic: str = "and"


@dataclass(frozen=True)
class Strategy:
    name: str
    entry: Group = Group()
    exit: Group = Group()
    universe: Group | None = None
    regime: Group | None = None
    stop_loss: float | None = None
    take_profit: float | None = None
    max_bars: int | None = None
    sizing: str = "fixed"
    parameters: dict = field(default_factory=dict)
    formula: str | None = None
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Strategy:
        raw = json.loads(text)

        def group(g: dict | None) -> Group | None:
            if g is None:
                return None
            return Group(tuple(group(r) if "rules" in r else Rule(r["indicator"], r["operator"], r["value"]) for r in g["rules"]), g["logic"])

        return Strategy(**raw | {k: group(raw[k]) for k in ("entry", "exit", "universe", "regime")})

    def fingerprint(self) -> str:
        """The same for equal strategies, whatever their id."""
        raw = asdict(self)
        raw.pop("id")
        return hashlib.sha256(json.dumps(raw, sort_keys=True).encode()).hexdigest()[:16]

    def clone(self, **changes) -> Strategy:
        return replace(self, id=uuid.uuid4().hex[:12], **changes)

    def with_parameters(self, **parameters) -> Strategy:
        """The template's strategy made anew with these parameters; without a template only the record changes."""
        merged = self.parameters | parameters
        return TEMPLATES[self.name](**merged) if self.name in TEMPLATES else self.clone(parameters=merged)


def _rules(*rules: tuple, logic: str = "and") -> Group:
    return Group(tuple(Rule(*r) for r in rules), logic)


def sma_crossover(fast_period: int = 20, slow_period: int = 50, stop_loss_pct: float = 0.02) -> Strategy:
    fast, slow = f"sma_{fast_period}", f"sma_{slow_period}"
    p = {"fast_period": fast_period, "slow_period": slow_period, "stop_loss_pct": stop_loss_pct}
    return Strategy("sma_crossover", _rules((fast, "cross_above", slow)), _rules((fast, "cross_below", slow)), stop_loss=stop_loss_pct, parameters=p)


def rsi_mean_reversion(rsi_period: int = 14, oversold: float = 30.0, overbought: float = 70.0, stop_loss_pct: float = 0.03) -> Strategy:
    p = {"rsi_period": rsi_period, "oversold": oversold, "overbought": overbought, "stop_loss_pct": stop_loss_pct}
    return Strategy("rsi_mean_reversion", _rules((f"rsi_{rsi_period}", "<", oversold)), _rules((f"rsi_{rsi_period}", ">", overbought)), stop_loss=stop_loss_pct, parameters=p)


def bollinger_breakout(period: int = 20, num_std: float = 2.0, stop_loss_pct: float = 0.02) -> Strategy:
    p = {"period": period, "num_std": num_std, "stop_loss_pct": stop_loss_pct}
    upper, middle = f"bb_upper_{period}_{num_std:g}", f"bb_middle_{period}_{num_std:g}"
    return Strategy("bollinger_breakout", _rules(("close", ">", upper)), _rules(("close", "<", middle)), stop_loss=stop_loss_pct, parameters=p)


def momentum_rotation(lookback: int = 20, holding_period: int = 5, stop_loss_pct: float = 0.05) -> Strategy:
    p = {"lookback": lookback, "holding_period": holding_period, "stop_loss_pct": stop_loss_pct}
    name = f"momentum_{lookback}"
    return Strategy("momentum_rotation", _rules((name, ">", 0.0)), _rules((name, "<", 0.0)), stop_loss=stop_loss_pct, max_bars=holding_period, parameters=p)


def macd_crossover(fast: int = 12, slow: int = 26, signal: int = 9, stop_loss_pct: float = 0.02) -> Strategy:
    p = {"fast": fast, "slow": slow, "signal": signal, "stop_loss_pct": stop_loss_pct}
    return Strategy("macd_crossover", _rules(("macd", "cross_above", "macd_signal")), _rules(("macd", "cross_below", "macd_signal")), stop_loss=stop_loss_pct, parameters=p)


def volatility_breakout(atr_period: int = 14, atr_multiplier: float = 2.0, stop_loss_pct: float = 0.03) -> Strategy:
    p = {"atr_period": atr_period, "atr_multiplier": atr_multiplier, "stop_loss_pct": stop_loss_pct}
    entry = _rules(("returns_1d", ">", 0.02), ("volume_ratio", ">", 1.5))
    return Strategy("volatility_breakout", entry, _rules(("returns_1d", "<", -0.01)), stop_loss=stop_loss_pct, sizing="volatility", parameters=p)


def dual_momentum(abs_momentum_period: int = 252, rel_momentum_period: int = 126, stop_loss_pct: float = 0.1) -> Strategy:
    p = {"abs_momentum_period": abs_momentum_period, "rel_momentum_period": rel_momentum_period, "stop_loss_pct": stop_loss_pct}
    entry = _rules(("returns_20d", ">", 0.0), ("momentum_10", ">", 0.0))
    return Strategy("dual_momentum", entry, _rules(("returns_20d", "<", 0.0), ("momentum_10", "<", 0.0), logic="or"), stop_loss=stop_loss_pct, parameters=p)


def buy_and_hold() -> Strategy:
    return Strategy("buy_and_hold", _rules(("close", ">=", 0.0)))


TEMPLATES = {f.__name__: f for f in (sma_crossover, rsi_mean_reversion, bollinger_breakout, momentum_rotation, macd_crossover, volatility_breakout, dual_momentum, buy_and_hold)}


def template(name: str) -> Strategy:
    if name not in TEMPLATES:
        raise KeyError(f"unknown template: {name}; there are {sorted(TEMPLATES)}")
    return TEMPLATES[name]()


def _names(group: Group | None) -> set[str]:
    if group is None:
        return set()
    return {n for r in group.rules for n in (_names(r) if isinstance(r, Group) else {r.indicator, *([r.value] if isinstance(r.value, str) else [])})}


def with_indicators(df: DataFrame, names: set[str]) -> DataFrame:
    """df with the indicators that rules name, as far as it lacks them; names say the indicator and its period."""
    have = {c.lower() for c in df.columns}
    wanted = sorted(n for n in names if n.lower() not in have)
    recursive, columns = [], []
    for n in wanted:
        if m := re.fullmatch(r"(ema|rsi|atr|adx)_(\d+)", n):
            recursive.append((m[1], int(m[2])))
        elif n in ("macd", "macd_signal", "macd_hist"):
            recursive.append(("macd",))
        elif m := re.fullmatch(r"sma_(\d+)", n):
            columns.append(I.sma(int(m[1])).alias(n))
        elif m := re.fullmatch(r"momentum_(\d+)", n):
            columns.append(I.momentum(int(m[1])).alias(n))
        elif m := re.fullmatch(r"returns_(\d+)d", n):
            columns.append(change("close", int(m[1])).alias(n))
        elif m := re.fullmatch(r"volatility_(\d+)", n):
            columns.append(I.volatility(int(m[1])).alias(n))
        elif m := re.fullmatch(r"(bb_upper|bb_middle|bb_lower)_(\d+)_([\d.]+)", n):
            columns.append(I.bollinger(int(m[2]), float(m[3]))[m[1]].alias(n))
        elif n in ("stoch_k", "stoch_d"):
            columns.append(I.stochastic()[n].alias(n))
        elif n == "williams_r":
            columns.append(I.williams_r().alias(n))
        elif n == "volume_ratio":
            columns.append(div("volume", mean("volume", 20)).alias(n))
        elif n == "obv":
            columns.append(I.obv().alias(n))
        else:
            raise KeyError(f"unknown indicator: {n}")
    df = df.select("*", *columns) if columns else df
    return I.with_recursive(df, list(dict.fromkeys(recursive))) if recursive else df


def _resolve(name: str, columns: list[str]) -> Column:
    if name in columns:
        return F.col(name)
    lowered = {c.lower(): c for c in columns}
    if name.lower() in lowered:
        return F.col(lowered[name.lower()])
    raise KeyError(f"unknown indicator: {name}")


def _rule(rule: Rule, columns: list[str]) -> Column:
    a = _resolve(rule.indicator, columns)
    b = _resolve(rule.value, columns) if isinstance(rule.value, str) else F.lit(float(rule.value))
    before_a, before_b = lag(a), lag(b) if isinstance(rule.value, str) else b
    made = {
        ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b, "!=": a != b,
        "cross_above": (before_a <= before_b) & (a > b), "cross_below": (before_a >= before_b) & (a < b),
    }[rule.operator]
    return F.coalesce(made, F.lit(rule.operator == "!="))


def condition(group: Group | None, columns: list[str]) -> Column:
    if group is None or not group.rules:
        return F.lit(False)
    parts = [condition(r, columns) if isinstance(r, Group) else _rule(r, columns) for r in group.rules]
    return reduce(Column.__or__ if group.logic == "or" else Column.__and__, parts)


def signals(df: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """Bars with the signals of all strategies, in long form: bar columns, strategy_id, entry_signal, exit_signal, and the limits.

    Indicators are worked out once for all strategies; only then rows are multiplied.
    """
    bars = df.columns
    wide = with_indicators(df, set().union(*[_names(g) for s in strategies for g in (s.entry, s.exit, s.universe, s.regime)]))
    columns = wide.columns
    each = []
    for s in strategies:
        allowed = reduce(Column.__and__, [condition(g, columns) for g in (s.universe, s.regime) if g is not None], F.lit(True))
        each.append(
            F.struct(
                F.lit(s.id).alias("strategy_id"), F.lit(s.name).alias("strategy"), (condition(s.entry, columns) & allowed).alias("entry_signal"), condition(s.exit, columns).alias("exit_signal"),
                F.lit(float(s.stop_loss or 0)).alias("stop_loss"), F.lit(float(s.take_profit or 0)).alias("take_profit"), F.lit(int(s.max_bars or 0)).alias("max_bars"),
            )
        )
    wide = wide.select(*bars, F.array(*each).alias("_each"))
    return wide.select(*bars, F.explode("_each").alias("_s")).select(*bars, "_s.*")
