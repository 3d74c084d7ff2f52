"""Backtests: positions from signals, returns after costs, metrics and trades.

Everything is in long form, keyed by (strategy_id, symbol, ts): many strategies are one job. Positions with limits are an ordered
fold over a strategy's bars of one symbol (applyInPandas); all that follows are windows and aggregates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemark.functions.core import YEAR, div, mean
from tidemark.plans.strategy import Strategy, signals

KEY = ["strategy_id", "symbol"]


def by_key() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy("ts")


def key_so_far() -> WindowSpec:
    return by_key().rowsBetween(Window.unboundedPreceding, 0)


def _track(close: np.ndarray, entry: np.ndarray, leave: np.ndarray, stop: float, profit: float, most: int) -> tuple[np.ndarray, list[str]]:
    """Positions 0 or 1, and why each bar left: stop, profit, bars, signal, in that order; no entry on the bar of an exit."""
    held, since, paid = False, 0, 0.0
    out, why = np.zeros(len(close), dtype=np.int64), [""] * len(close)
    for i, price in enumerate(close.tolist()):
        if held:
            gain = price / paid - 1 if paid else 0.0
            if stop and gain <= -stop:
                why[i] = "stop_loss"
            elif profit and gain >= profit:
                why[i] = "take_profit"
            elif most and i - since >= most:
                why[i] = "max_bars"
            elif leave[i]:
                why[i] = "signal"
            held = not why[i]
        elif entry[i]:
            held, since, paid = True, i, price
        out[i] = held
    return out, why


def positions(signalled: DataFrame) -> DataFrame:
    """signalled with position (0 or 1) after each bar and exit_reason."""
    schema = StructType([*signalled.schema.fields, StructField("position", IntegerType()), *StructType().add("exit_reason", "string").fields])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable")
        first = rows.iloc[0]
        held, why = _track(rows.close.to_numpy(float), rows.entry_signal.to_numpy(bool), rows.exit_signal.to_numpy(bool), first.stop_loss, first.take_profit, int(first.max_bars))
        return rows.assign(position=held.astype("int32"), exit_reason=[w or None for w in why])

    return signalled.groupBy(*KEY).applyInPandas(run, schema)


def positions_without_limits(signalled: DataFrame) -> DataFrame:
    """The same in closed form, where no limit is set and entry and exit never fall on one bar: the last signal decides."""
    last = F.last(F.when(F.col("entry_signal"), 1).when(F.col("exit_signal"), 0), ignorenulls=True).over(key_so_far())
    return signalled.withColumn("position", F.coalesce(last, F.lit(0)).cast("int"))


def returns(positioned: DataFrame, commission: float = 0.001, slippage: float = 0.0005, capital: float = 100_000.0) -> DataFrame:
    """positioned with held (the position the bar began with), ret and equity; the first bar's change of position costs nothing."""
    before = F.lag("position").over(by_key())
    move = div("close", F.lag("close").over(by_key())) - 1
    cost = F.coalesce(F.abs(F.col("position") - before), F.lit(0)) * (commission + slippage)
    out = positioned.withColumn("held", F.coalesce(before, F.lit(0)).cast("double")).withColumn("ret", F.coalesce(before * move, F.lit(0.0)) - cost)
    return out.withColumn("equity", capital * F.product(1 + F.col("ret")).over(key_so_far()))


def backtest(bars: DataFrame, strategies: list[Strategy], **costs) -> DataFrame:
    return returns(positions(signals(bars, strategies)), **costs)


def drawdowns(run: DataFrame) -> DataFrame:
    """run with drawdown (from the highest equity so far, at most 0) and run_id of the stretch without a new high."""
    peak = F.max("equity").over(key_so_far())
    out = run.withColumn("drawdown", div(F.col("equity") - peak, peak))
    return out.withColumn("run_id", F.sum(F.when(F.col("drawdown") < 0, 0).otherwise(1)).over(key_so_far()))


def trade_returns(run: DataFrame) -> DataFrame:
    """One row a stretch of bars with a position: strategy_id, symbol, trade, ret; an open one counts to the last bar."""
    islands = run.withColumn("trade", F.sum(F.when(F.col("held") == 0, 1).otherwise(0)).over(key_so_far())).where(F.col("held") != 0)
    return islands.groupBy(*KEY, "trade").agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


def metrics(run: DataFrame, risk_free: float = 0.0, days: int = YEAR) -> DataFrame:
    """The 18 figures of each strategy and symbol. A figure that a zero divisor leaves open is 0; a profit factor without losses is infinite."""
    run = drawdowns(run.where(F.col("ret").isNotNull()))
    # windows within a key need no exchange beyond the one that brings the key together, so all figures come from one aggregation
    before = F.coalesce(F.lag("held").over(by_key()), F.lit(0.0))
    active = F.col("held") != 0
    rows = run.withColumn("started", F.when(F.col("held") > before, 1)).withColumn("trade", F.sum(F.when(active, 0).otherwise(1)).over(key_so_far()))
    rows = rows.withColumn("p5", F.percentile("ret", F.lit(0.05)).over(Window.partitionBy(*KEY)))
    rows = rows.withColumn("stretch", F.count(F.when(F.col("drawdown") < 0, 1)).over(Window.partitionBy(*KEY, "run_id")))
    of_trade = Window.partitionBy(*KEY, "trade", active)
    ends = active & (F.row_number().over(of_trade.orderBy(F.col("ts").desc())) == 1)
    rows = rows.withColumn("gain", F.product(1 + F.col("ret")).over(of_trade) - 1).withColumn("gain", F.when(ends, F.col("gain")))
    won = F.col("gain") > 0
    out = rows.groupBy(*KEY).agg(
        F.count("ret").alias("trading_days"), (F.product(1 + F.col("ret")) - 1).alias("total_return"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"),
        F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("down"), F.abs(F.min("drawdown")).alias("max_drawdown"), F.first("p5").alias("p5"),
        F.skewness("ret").alias("skewness"), F.kurtosis("ret").alias("kurtosis"), F.count("started").alias("num_trades"), F.max("stretch").alias("max_drawdown_duration"),
        F.abs(F.avg(F.when(F.col("ret") <= -F.abs("p5"), F.col("ret")))).alias("tail"),
        F.avg(won.cast("double")).alias("win_rate"), F.sum(F.when(won, F.col("gain"))).alias("gained"), F.abs(F.sum(F.when(~won, F.col("gain")))).alias("lost"),
        F.avg(F.when(won, F.col("gain"))).alias("avg_win"), F.avg(F.when(F.col("gain") < 0, F.col("gain"))).alias("avg_loss"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = out.withColumn("years", F.col("trading_days") / days).withColumn("annualized_return", F.pow(1 + F.col("total_return"), 1 / F.col("years")) - 1)
    root = F.sqrt(F.lit(float(days)))
    gained, lost = zero(F.col("gained")), zero(F.col("lost"))
    return out.select(
        *KEY, "total_return", "annualized_return", zero(F.col("std") * root).alias("volatility"), zero(div(F.col("mean") - risk_free / days, F.col("std")) * root).alias("sharpe_ratio"),
        zero(div("annualized_return", F.col("down") * root)).alias("sortino_ratio"), zero(div("annualized_return", "max_drawdown")).alias("calmar_ratio"), zero(F.col("max_drawdown")).alias("max_drawdown"),
        F.coalesce("max_drawdown_duration", F.lit(0)).alias("max_drawdown_duration"), F.abs("p5").alias("var_95"), F.when(F.col("p5") == 0, 0.0).otherwise(zero(F.col("tail"))).alias("cvar_95"),
        zero(F.when(~F.isnan("skewness"), F.col("skewness"))).alias("skewness"), zero(F.when(~F.isnan("kurtosis"), F.col("kurtosis"))).alias("kurtosis"), "num_trades", zero(F.col("win_rate")).alias("win_rate"),
        F.when(lost > 0, gained / F.when(lost > 0, lost)).when(gained > 0, float("inf")).otherwise(0.0).alias("profit_factor"), zero(F.col("avg_win")).alias("avg_win"), zero(F.col("avg_loss")).alias("avg_loss"),
        "trading_days", "years",
    )


def sharpe(run: DataFrame, risk_free: float = 0.0, days: int = YEAR) -> DataFrame:
    out = run.groupBy(*KEY).agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    return out.select(*KEY, F.coalesce(div(F.col("m") - risk_free / days, "s") * float(np.sqrt(days)), F.lit(0.0)).alias("sharpe_ratio"))


def information_ratio(run: DataFrame, benchmark: DataFrame, days: int = YEAR) -> DataFrame:
    """run and benchmark (ts, ret) meet by time."""
    active = run.join(benchmark.select("ts", F.col("ret").alias("_b")), "ts").withColumn("a", F.col("ret") - F.col("_b"))
    out = active.groupBy(*KEY).agg(F.avg("a").alias("m"), F.stddev_samp("a").alias("s"))
    return out.select(*KEY, F.coalesce(div(F.col("m") * days, F.col("s") * float(np.sqrt(days))), F.lit(0.0)).alias("information_ratio"))


def trades(run: DataFrame) -> DataFrame:
    """One row a trade on one share: a change of position closes what is open and opens by the new sign; an open one ends at the last bar."""
    changed = run.withColumn("changed", (F.coalesce(F.lag("position").over(by_key()), F.lit(0)) != F.col("position")).cast("int"))
    end = Window.partitionBy(*KEY)
    leg = changed.withColumn("leg", F.sum("changed").over(key_so_far())).withColumn("last_ts", F.max("ts").over(end)).withColumn("last_close", F.max_by("close", "ts").over(end))
    legs = leg.groupBy(*KEY, "leg").agg(F.min("ts").alias("entry_ts"), F.min_by("close", "ts").alias("entry_price"), F.first("position").alias("side"), F.first("last_ts").alias("last_ts"), F.first("last_close").alias("last_close"))
    after = Window.partitionBy(*KEY).orderBy("leg")
    legs = legs.withColumn("exit_ts", F.coalesce(F.lead("entry_ts").over(after), "last_ts")).withColumn("exit_price", F.coalesce(F.lead("entry_price").over(after), "last_close"))
    legs = legs.withColumn("exit_signal", F.when(F.lead("leg").over(after).isNull(), "eod").otherwise("signal")).where(F.col("side") != 0)
    pnl = F.signum("side") * (F.col("exit_price") - F.col("entry_price"))
    return legs.select(
        *KEY, "entry_ts", "entry_price", "exit_ts", "exit_price", "exit_signal", pnl.alias("pnl"), div(pnl, "entry_price").alias("pnl_pct"), F.lit(1.0).alias("size"),
        F.greatest(F.lit(1), F.datediff("exit_ts", "entry_ts")).alias("duration"),
    )


def _longest(rows: DataFrame, wins: bool) -> DataFrame:
    by = Window.partitionBy(*KEY).orderBy("entry_ts")
    hit = (F.col("pnl") > 0) if wins else (F.col("pnl") < 0)
    marked = rows.withColumn("hit", hit).withColumn("run", F.sum(F.when(~F.col("hit"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    name = "max_consecutive_wins" if wins else "max_consecutive_losses"
    return marked.where("hit").groupBy(*KEY, "run").count().groupBy(*KEY).agg(F.max("count").alias(name))


def trade_statistics(rows: DataFrame) -> DataFrame:
    """Figures of trades(): counts, rates, sums, streaks and durations."""
    won, lost = F.col("pnl") > 0, F.col("pnl") < 0
    of = lambda c, x="pnl": F.when(c, F.col(x))
    out = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(won).alias("winning_trades"), F.count_if(lost).alias("losing_trades"), F.count_if(F.col("pnl") == 0).alias("breakeven_trades"),
        F.avg(won.cast("double")).alias("win_rate"), F.sum("pnl").alias("total_pnl"), F.coalesce(F.sum(of(won)), F.lit(0.0)).alias("gross_profit"), F.coalesce(F.abs(F.sum(of(lost))), F.lit(0.0)).alias("gross_loss"),
        F.avg("pnl").alias("expectancy"), F.coalesce(F.avg(of(won)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(of(lost)), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.max(of(won)), F.lit(0.0)).alias("largest_win"), F.coalesce(F.min(of(lost)), F.lit(0.0)).alias("largest_loss"), F.avg("pnl_pct").alias("avg_pnl_pct"),
        F.avg("duration").alias("avg_duration"), F.coalesce(F.avg(of(won, "duration")), F.lit(0.0)).alias("avg_win_duration"), F.coalesce(F.avg(of(lost, "duration")), F.lit(0.0)).alias("avg_loss_duration"),
    )
    factor = F.when(F.col("gross_loss") > 0, F.try_divide("gross_profit", "gross_loss")).when(F.col("gross_profit") > 0, float("inf")).otherwise(0.0)
    out = out.withColumn("profit_factor", factor).join(_longest(rows, True), KEY, "left").join(_longest(rows, False), KEY, "left")
    return out.fillna(0, ["max_consecutive_wins", "max_consecutive_losses"])


def trade_summary(rows: DataFrame) -> DataFrame:
    """The short form of trades(): number, share of winners, mean return, sum, and mean days held."""
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("num_trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("pnl_pct").alias("avg_return"), F.sum("pnl").alias("total_pnl"), F.avg("duration").alias("avg_holding_days")
    )


def simple_signal(bars: DataFrame, fast: int = 20, slow: int = 50, margin: float = 0.01) -> DataFrame:
    """bars with signal: 1 or -1 where the fast mean is above or below the slow one by more than a margin, 0 else and before `slow` bars."""
    a, b = mean("close", fast), mean("close", slow)
    return bars.withColumn("signal", F.when(a > b * (1 + margin), 1).when(a < b * (1 - margin), -1).otherwise(0))


# ---- the detailed run: cash, shares and sizing -----------------------------------------------------------------------------
def position_size(value: float, volatility: float | None, method: str = "fixed", cap: float = 0.1, target: float = 0.15) -> float:
    """Money to put into a position: a capped share of the portfolio, less of it when volatility is above target."""
    share = cap * min(1.0, target / volatility) if method == "volatility" and volatility else cap
    return value * share


def detailed(signalled: DataFrame, capital: float = 100_000.0, commission: float = 0.001, slippage: float = 0.0005, sizing: str = "fixed") -> DataFrame:
    """A portfolio for each strategy and symbol: cash, shares, value and ret of each bar. Exits are looked for in the tracker's order."""
    fields = [f for f in signalled.schema.fields if f.name in (*KEY, "ts", "close")]
    schema = StructType([*fields, *[StructField(n, DoubleType()) for n in ("cash", "shares", "value", "ret")]])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable")
        first, close = rows.iloc[0], rows.close.to_numpy(float)
        held, _ = _track(close, rows.entry_signal.to_numpy(bool), rows.exit_signal.to_numpy(bool), first.stop_loss, first.take_profit, int(first.max_bars))
        spread = (rows.close.pct_change(fill_method=None).rolling(20).std() * np.sqrt(YEAR)).fillna(0.2).to_numpy()
        cash, shares, out, before = capital, 0.0, [], capital
        for i, price in enumerate(close):
            if held[i] and not shares:
                paid = price * (1 + slippage)
                money = min(position_size(cash, spread[i], sizing), cash / (1 + commission))
                shares = money / paid if paid else 0.0
                cash -= money * (1 + commission)
            elif shares and not held[i]:
                cash += shares * price * (1 - slippage) * (1 - commission)
                shares = 0.0
            value = cash + shares * price
            out.append((cash, shares, value, value / before - 1 if before else 0.0))
            before = value
        made = pd.DataFrame(out, columns=["cash", "shares", "value", "ret"], index=rows.index)
        return pd.concat([rows[[f.name for f in fields]], made], axis=1)

    return signalled.groupBy(*KEY).applyInPandas(run, schema)


# ---- event-driven execution ------------------------------------------------------------------------------------------------
def fill_probability(aggressiveness: float, queue: float) -> float:
    """Chance that an order fills: by how far its price crosses the market, less for its place in the queue."""
    return (0.95 if aggressiveness > 0.001 else 0.7 if aggressiveness > 0 else 0.5) * (1 - queue / 2)


def event_driven(signalled: DataFrame, seed: int = 42, units: float = 100.0, delay: int = 1, impact: float = 0.1, least_fill: float = 0.1, capital: float = 100_000.0) -> DataFrame:
    """Orders of `units` with a delay in bars, chance of filling, partial fills and price impact; one running quantity per key.

    Random numbers come from a hash of the seed, the key, the bar and the order, so every run of any partitioning gives the same fills, and
    another engine can draw them too.
    """
    fields = [f for f in signalled.schema.fields if f.name in (*KEY, "ts", "close")]
    schema = StructType([*fields, *[StructField(n, DoubleType()) for n in ("quantity", "filled", "fill_price", "value", "ret")]])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable")
        key = f"{seed}|{rows.strategy_id.iloc[0]}|{rows.symbol.iloc[0]}"
        cash, quantity, orders, before, out = capital, 0.0, [], capital, []  # orders: [bar that it is due, units left]
        for i, row in enumerate(rows.itertuples()):
            wanted = quantity + sum(o[1] for o in orders)
            if row.entry_signal and wanted < 1e-9:  # what rounding leaves is nothing
                orders.append([i + delay, units])
            elif row.exit_signal and wanted >= 1e-9:
                orders.append([i + delay, -wanted])
            filled, paid = 0.0, np.nan
            for o in orders:
                if o[0] > i or drawn(key, i, o[0], 0) > fill_probability(0.002, drawn(key, i, o[0], 1)):
                    continue
                most = row.volume * 0.01 * (least_fill + (1 - least_fill) * drawn(key, i, o[0], 2))
                n = float(np.sign(o[1]) * min(abs(o[1]), max(most, 1.0)))
                paid = row.close * (1 + np.sign(n) * impact * abs(n) * row.close / 1e6)
                cash -= n * paid
                quantity, filled, o[1] = quantity + n, filled + n, o[1] - n
            orders, quantity = [o for o in orders if abs(o[1]) >= 1e-9], quantity if abs(quantity) >= 1e-9 else 0.0
            value = cash + quantity * row.close
            out.append((quantity, filled, paid, value, value / before - 1 if before else 0.0))
            before = value
        made = pd.DataFrame(out, columns=["quantity", "filled", "fill_price", "value", "ret"], index=rows.index)
        return pd.concat([rows[[f.name for f in fields]], made], axis=1)

    return signalled.groupBy(*KEY).applyInPandas(run, schema)


def drawn(key: str, bar: int, due: int, number: int) -> float:
    """A number from 0 to 1 for an order on a bar."""
    return int(hashlib.md5(f"{key}|{bar}|{due}|{number}".encode()).hexdigest()[:8], 16) / (1 << 32)


def shortfall(vector: DataFrame, event: DataFrame, most: float = 0.3) -> DataFrame:
    """How much of the vectorised Sharpe ratio the event-driven run loses."""
    a, b = sharpe(vector).withColumnRenamed("sharpe_ratio", "vector_sharpe"), sharpe(event).withColumnRenamed("sharpe_ratio", "event_sharpe")
    out = a.join(b, KEY).withColumn("shortfall", F.coalesce(div(F.col("vector_sharpe") - F.col("event_sharpe"), "vector_sharpe"), F.lit(0.0)))
    return out.withColumn("acceptable", F.col("shortfall") < most)


def halves(bars: DataFrame, share: float = 0.7) -> DataFrame:
    """bars with segment: the first share of each symbol's rows is `train`, the rest `test`."""
    by = Window.partitionBy("symbol")
    number = F.row_number().over(by.orderBy("ts"))
    return bars.withColumn("segment", F.when(number <= F.floor(F.count(F.lit(1)).over(by) * share), "train").otherwise("test"))

