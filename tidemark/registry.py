"""Queries of the strategy engine, one for each operator, over bars made from the driver tables.

Doubles are rounded to six significant digits, and times are text, so that another engine's rows can be compared by value.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import oracle, oracle_parts, oracle_runs, registry_parts
from tidemark.functions import indicators as I  # noqa: N812
from tidemark.functions.core import by_symbol, change, div, lag, last
from tidemark.operators import analysis, backtest, execution, pit, quality, search, validation
from tidemark.plans import dsl, strategy
from tidemark.sources import bars, store
from tidemark.streaming import cusum

MOMENT = "1999-06-30 00:00:00"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six significant digits (0 below 1e-12), times and dates as text."""
    made = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(c))))
            c = F.when(F.abs(c) < 1e-12, 0.0).when(F.abs(c) == float("inf"), c).otherwise(F.floor(c * scale + 0.5) / scale)
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            c = c.cast("string")
        made.append(c.alias(name))
    return df.select(*made)


def _columns(make):
    """A query of bar columns: make() gives names to Columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(bars.bars_lineitem(spark, sf_dir).select("symbol", "ts", *[c.alias(n) for n, c in make().items()]))

    return run


def _recursive(wanted: list[tuple]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [n for kind, *args in wanted for n in I.RECURSIVE[kind][0](*args)]
        return rounded(I.with_recursive(bars.bars_lineitem(spark, sf_dir), wanted).select("symbol", "ts", *names))

    return run


def _on_bars(f):
    return lambda spark, sf_dir: rounded(f(bars.bars_lineitem(spark, sf_dir)))


def _named(s: strategy.Strategy) -> strategy.Strategy:
    from dataclasses import replace

    return replace(s, id=s.name)


def crossover_run(b: DataFrame) -> DataFrame:
    """The moving-average crossover without limits, in closed form."""
    from dataclasses import replace

    s = replace(_named(strategy.sma_crossover()), stop_loss=None)
    return backtest.returns(backtest.positions_without_limits(strategy.signals(b, [s])))


def _on_run(f):
    return lambda spark, sf_dir: rounded(f(crossover_run(bars.bars_lineitem(spark, sf_dir))))


def _formulas(formulas: dict[str, str]):
    return _columns(lambda: {n: dsl.compile_formula(f) for n, f in formulas.items()})


def _on_revisions(f):
    return lambda spark, sf_dir: rounded(f(bars.pit_orders(spark, sf_dir)))


def smooth(b: DataFrame, n: int = 60) -> DataFrame:
    """Bars of mean prices: the prices of single orders jump by so much that transformed ones would leave the range of doubles."""
    return b.select("symbol", "ts", *[F.avg(c).over(last(n)).alias(c) for c in ("open", "high", "low", "close")], "volume")


SCENARIOS = [*validation.HISTORICAL, *validation.SYNTHETIC]
TEMPLATES = [_named(f()) for f in strategy.TEMPLATES.values()]

DSL_ARITHMETIC = {
    "f_add": "add(close, open)", "f_sub": "sub(close, open)", "f_mul": "mul(close, volume)", "f_div": "div(close, open)", "f_abs": "abs(sub(close, open))", "f_neg": "neg(close)",
    "f_log": "log(close)", "f_sqrt": "sqrt(close)", "f_sign": "sign(sub(close, open))", "f_power": "power(returns, 2)", "f_vwap": "mul(vwap, 1)", "f_adj": "sub(adj_close, close)",
}
DSL_WINDOWS = {
    "f_delay": "delay(close, 3)", "f_delta": "delta(close, 5)", "f_mean": "ts_mean(close, 10)", "f_std": "ts_std(close, 10)", "f_min": "ts_min(low, 7)", "f_max": "ts_max(high, 7)",
    "f_sum": "ts_sum(volume, 4)", "f_nested": "ts_mean(ts_max(delta(close, 2), 5), 3)", "f_scale": "scale(returns)", "f_zscore": "zscore(close)",
}
DSL_RANKS = {"f_rank": "ts_rank(close, 20)", "f_argmax": "ts_argmax(close, 12)", "f_argmin": "ts_argmin(close, 12)", "f_long_rank": "rank(volume)"}
DSL_PAIRS = {"f_corr": "ts_corr(close, volume, 20)", "f_cov": "ts_cov(close, volume, 20)"}
DSL_LOGIC = {
    "f_gt": "gt(close, open)", "f_lt": "lt(close, open)", "f_gte": "gte(close, open)", "f_lte": "lte(close, open)", "f_eq": "eq(high, close)", "f_and": "and_(gt(close, open), gt(volume, 500))",
    "f_or": "or_(gt(close, open), gt(returns, 0))", "f_not": "not_(gt(close, open))", "f_if": "if_else(gt(returns, 0), close, open)",
}


def _signals(b: DataFrame) -> DataFrame:
    s = strategy.Strategy("rules", strategy.Group((strategy.Rule("sma_20", "cross_above", "sma_50"), strategy.Group((strategy.Rule("volume", ">", 100.0), strategy.Rule("momentum_10", ">=", 0.0)), "or"))), strategy._rules(("close", "<", "sma_20")), id="rules")
    return strategy.signals(b, [s]).select("strategy_id", "symbol", "ts", "entry_signal", "exit_signal")


def _benchmark(b: DataFrame) -> DataFrame:
    """Mean return of all symbols by day."""
    return b.withColumn("ret", F.coalesce(change("close"), F.lit(0.0))).groupBy("ts").agg(F.avg("ret").alias("ret"))


def _pbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.bars_lineitem(spark, sf_dir).withColumn("r", change("close"))
    ratios = b.groupBy(F.col("symbol").alias("strategy_id"), F.trunc("ts", "year").alias("period")).agg(F.coalesce(div(F.avg("r"), F.stddev_samp("r")), F.lit(0.0)).alias("sharpe"))
    return rounded(validation.pbo(validation.pbo_windows(ratios, 2, 1)).select("pbo", "logit", "mean_logit", "combinations", "rank_correlation"))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = smooth(bars.bars_lineitem(spark, sf_dir))
    return rounded(validation.validate(b, TEMPLATES, scenarios=SCENARIOS, benchmark=_benchmark(b)))


def _spa(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.bars_lineitem(spark, sf_dir)
    run = crossover_run(b)
    pairs = run.join(_benchmark(b).withColumnRenamed("ret", "benchmark"), "ts").select(F.col("symbol").alias("name"), "ts", F.col("ret").alias("strategy"), "benchmark")
    return rounded(validation.spa(pairs))


def _discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.discover(bars.bars_lineitem(spark, sf_dir), size=8, generations=1, warm=["delta(close, 5)", "neg(zscore(close))"])
    rows = [(t.hash, str(t), found.ranks[t.hash], float(found.fitness.get(t.hash, {}).get("train", {}).get("sharpe") or 0.0)) for t in found.population]
    return spark.createDataFrame(rows, "tree_id string, formula string, rank int, train_sharpe double")


def _sweep(b: DataFrame) -> DataFrame:
    space = [search.Parameter("fast_period", 5, 15, 5, whole=True), search.Parameter("slow_period", 30, 50, 20, whole=True)]
    return search.sweep(b, strategy.sma_crossover, search.grid_points(space)).select("strategy_id", "symbol", "sharpe_ratio", "total_return", "max_drawdown")


def _pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = parts.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), (-F.col("p_retailprice")).alias("price"))
    return rounded(search.pareto_front(rows, ["size", "price"]))


def _monitored(b: DataFrame) -> DataFrame:
    r = b.select(F.col("symbol").alias("key"), "ts", F.coalesce(change("close"), F.lit(0.0)).alias("ret"))
    return cusum.alerts(cusum.monitor(r, 6.0)).drop("message")


def _quality(b: DataFrame) -> DataFrame:
    return quality.issues(b.withColumn("ingest_seq", F.unix_timestamp("ts")))


def _lookahead(b: DataFrame) -> DataFrame:
    return quality.lookahead(b, lambda d: d.withColumn("x", F.lead("close", 1).over(by_symbol())), "x", (10, 15, 20))


def _disordered(r: DataFrame) -> DataFrame:
    """Revisions of which the last one of each Monday's observation comes 80 days too early."""
    late = (F.col("revision_number") == 2) & (F.dayofweek("observation_date") == 2)
    return r.withColumn("release_date", F.when(late, F.col("release_date") - F.expr("interval 80 days")).otherwise(F.col("release_date")))


def _impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("v"))
    parts = execution.impact_parts(F.col("q"), F.col("q") * 500.0, F.lit(0.01))
    cost = execution.execution_cost(F.col("v"), F.col("v") * 500.0, F.lit(0.01))
    return rounded(li.select("l_suppkey", parts["permanent"].alias("permanent"), parts["temporary"].alias("temporary"), execution.impact(F.col("q"), F.col("q") * 500.0, F.lit(0.01)).alias("impact"), cost["total"].alias("cost")))


def _rank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = backtest.sharpe(crossover_run(bars.bars_lineitem(spark, sf_dir)))
    return rounded(search.top(m, "sharpe_ratio", 3, "symbol"))


def _pit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    revisions = bars.pit_orders(spark, sf_dir)
    keys = revisions.select("entity_id", F.trunc("observation_date", "month").cast("timestamp").alias("as_of")).distinct()
    return rounded(pit.pit_join(keys, revisions))


def _vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pit.vintages_of(pit.mock_vintages(spark, {"GDP": "Q", "CPI": "M", "RATE": "W"}, "2019-01-01", "2020-12-31", "2020-06-15")))


def _leaders(b: DataFrame) -> DataFrame:
    runs = store.logged_runs(backtest.metrics(crossover_run(b)), {"template": "sma_crossover"}, F.col("num_trades") >= 10)
    return store.leaderboard(runs, "volatility", 3).select("run_id", F.col("metrics")["volatility"].alias("volatility"), F.col("metrics")["num_trades"].alias("num_trades"))


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), "p_retailprice", (F.col("p_partkey") % 4).alias("rank"))
    return rounded(search.population_stats(rows, ["size", "p_retailprice"]))


def queries() -> dict:
    W = {  # noqa: N806
        "returns": lambda: {"ret": change("close"), "log_ret": F.log(div("close", lag("close")))},
        "sma": lambda: {f"sma_{n}": I.sma(n) for n in (20, 50, 200)}, "bollinger": I.bollinger, "stochastic": I.stochastic, "williams_r": lambda: {"williams_r": I.williams_r()},
        "momentum": lambda: {"momentum_10": I.momentum(10)}, "volatility": lambda: {"volatility_20": I.volatility(20)}, "obv": lambda: {"obv": I.obv(), "obv_from_zero": I.obv(0.0)},
        "vwap": lambda: {"vwap": I.vwap()}, "cci": lambda: {"cci": I.cci()}, "mfi": lambda: {"mfi": I.mfi()}, "ichimoku": I.ichimoku, "garman_klass": lambda: {"garman_klass": I.garman_klass()},
        "parkinson": lambda: {"parkinson": I.parkinson()}, "vortex": I.vortex, "donchian": I.donchian, "ultimate": lambda: {"ultimate": I.ultimate()}, "kst": I.kst, "aroon": I.aroon,
        "rolling_stats": lambda: {f"r_{s}": I.rolling_stat("close", 20, s) for s in ("mean", "std", "min", "max", "sum", "var", "skew", "kurt")},
        "z_score": lambda: {"z_score": I.z_score("close", 60)}, 
        "cross_section_rank": lambda: {"cs_rank": dsl.cross_section_rank("close")},
    }
    out = {"flagship_sma_sharpe": _on_run(backtest.sharpe), "bars_daily": lambda s, d: rounded(bars.bars_lineitem(s, d)), "bars_hourly": lambda s, d: rounded(bars.bars_events(s, d))}
    out |= {n: _columns(f) for n, f in W.items()}
    R = {"ema": [("ema", 12), ("ema", 26)], "macd": [("macd",)], "rsi": [("rsi", 14)], "atr": [("atr", 14)], "adx": [("adx", 14)], "keltner": [("keltner",)], "chaikin_volatility": [("chaikin",)], "mass_index": [("mass",)], "expanding_rank": [("expanding_rank", "close", 60)]}  # noqa: N806
    out |= {n: _recursive(w) for n, w in R.items()}
    out |= {
        "indicators_basic": _on_bars(I.basic_bundle), "indicators_advanced": _on_bars(I.advanced_bundle), "features": _on_bars(lambda b: I.features(b)),
        "dsl_arithmetic": _formulas(DSL_ARITHMETIC), "dsl_windows": _formulas(DSL_WINDOWS), "dsl_ranks": _formulas(DSL_RANKS), "dsl_pairs": _formulas(DSL_PAIRS), "dsl_logic": _formulas(DSL_LOGIC),
        "rule_signals": _on_bars(_signals), "positions": _on_run(lambda r: r.select("symbol", "ts", "position")),
        "positions_with_limits": _on_bars(lambda b: backtest.positions(strategy.signals(b, TEMPLATES)).select("strategy_id", "symbol", "ts", "position", "exit_reason")),
        "backtest_returns": _on_run(lambda r: r.select("symbol", "ts", "held", "ret", "equity")), "drawdown": _on_run(analysis.rolling_drawdown), "metrics": _on_run(backtest.metrics),
        "templates_metrics": _on_bars(lambda b: backtest.metrics(backtest.backtest(b, TEMPLATES))), "trades": _on_run(backtest.trades), "trade_statistics": _on_run(lambda r: backtest.trade_statistics(backtest.trades(r))),
        "detailed_backtest": _on_bars(lambda b: backtest.detailed(strategy.signals(b, TEMPLATES))), "event_driven": _on_bars(lambda b: backtest.event_driven(strategy.signals(b, TEMPLATES))),
        "shortfall": _on_bars(lambda b: backtest.shortfall(backtest.backtest(b, TEMPLATES), backtest.event_driven(strategy.signals(b, TEMPLATES)))),
        "information_ratio": lambda s, d: rounded(backtest.information_ratio(crossover_run(b := bars.bars_lineitem(s, d)), _benchmark(b))),
        "monthly_returns": _on_run(analysis.monthly), "yearly_returns": _on_run(analysis.yearly), "best_and_worst": _on_run(analysis.best_and_worst), "rolling_sharpe": _on_run(analysis.rolling_sharpe),
        "regimes": _on_bars(lambda b: analysis.regimes(b).select("symbol", "ts", "realized_vol", "historical_vol", "trend_slope", "return_20", "drawdown", "regime")),
        "regime_attribution": lambda s, d: rounded(analysis.by_regime(crossover_run(b := bars.bars_lineitem(s, d)), analysis.regimes(b))),
        "quality_issues": _on_bars(_quality), "quality_report": _on_bars(quality.report), "lookahead": _on_bars(_lookahead),
        "pit_as_of": _on_bars(lambda b: pit.as_of(b, MOMENT, dt.timedelta(days=1), 30)), "pit_latest": _on_bars(lambda b: pit.latest(b, MOMENT)), "pit_features": _on_bars(lambda b: pit.feature_matrix(b, MOMENT, ["sma_20", "returns_1d", "volume_ratio"])), "vintages": _vintages, "leaderboard": _on_bars(_leaders), "population_stats": _population,
        "pit_returns": _on_bars(lambda b: pit.known_returns(b, MOMENT, 20)),
        "pit_value": _on_revisions(lambda r: pit.pit_value(r, MOMENT)), "pit_join": _pit_join, "latest_revision": _on_revisions(pit.latest_revision),
        "revision_history": _on_revisions(lambda r: pit.revision_history(r, "1-URGENT", "1998-03-02").drop("transaction_time")), "bad_revisions": _on_revisions(lambda r: pit.bad_revisions(_disordered(r)).drop("transaction_time")),
        "rolling_windows": _on_bars(lambda b: pit.rolling_windows(b, 250, 200).groupBy("symbol", "window_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.avg("close").alias("mean_close"))),
        "expanding_windows": _on_bars(lambda b: pit.expanding_sizes(b, 252).select("symbol", "ts", "prefix_rows")),
        "time_split": _on_bars(lambda b: backtest.halves(b).groupBy("symbol", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"))),
        "cpcv_folds": _on_bars(validation.fold_info), "cpcv": _on_run(validation.cpcv), "cpcv_summary": _on_run(lambda r: validation.cpcv_summary(validation.cpcv(r))), "pbo": _pbo,
        "probability_of_loss": _on_run(lambda r: validation.probability_of_loss(validation.cpcv(r))), "deflated_sharpe": _on_run(lambda r: validation.deflated_sharpes(r, 10)), "spa": _spa,
        "stress": _on_bars(lambda b: validation.stress(smooth(b), TEMPLATES, SCENARIOS)), "validation_gates": _on_bars(lambda b: validation.validate(smooth(b), TEMPLATES, scenarios=SCENARIOS)),
        "walk_forward_summary": _on_bars(lambda b: validation.walk_forward_summary(rounded(validation.walk_forward(backtest.backtest(b, TEMPLATES))))), "walk_forward": _on_bars(lambda b: validation.walk_forward(backtest.backtest(b, TEMPLATES))),
        "validation_pipeline": _validated, "market_impact": _impact, "pareto_front": _pareto, "top_strategies": _rank_top, "parameter_sweep": _on_bars(_sweep), "discovery": _discovered, "cusum_alerts": _on_bars(_monitored),
        "hourly_bars_from_events": lambda s, d: rounded(cusum.hourly_bars(s.read.parquet(f"{d}/events.parquet"))),
    }
    return out | registry_parts.queries(_on_bars, _on_run, rounded)


def oracle_sql() -> dict:
    return oracle.statements() | oracle_runs.statements() | oracle_parts.statements()


__all__ = ["Window", "oracle_sql", "queries"]
