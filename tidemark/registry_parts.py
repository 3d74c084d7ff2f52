"""Queries of the parts that the runs do not reach: filters of rules, faults in bars, stores, trees, fronts and figures."""

from __future__ import annotations

import datetime as dt
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.core import by_symbol, change
from tidemark.functions.indicators import sma
from tidemark.operators import analysis, backtest, pit, quality, search, validation
from tidemark.plans import dsl, strategy
from tidemark.sources import bars, store

FORMULAS = (
    "close", "ts_mean(close, 10)", "add(ts_rank(close, 20), neg(ts_corr(close, volume, 15)))", "if_else(gt(returns, 0), close, open)", "power(returns, 2)", "ts_cov(ts_max(delta(close, 2), 5), vwap, 30)",
)
FITNESS = ("delta(close, 5)", "neg(zscore(close))", "div(close, ts_mean(close, 10))", "returns")
#: What the log is given, in this order: kind, id, status, whether it passed.
LOGGED = (("factory", "f1", "running", None), ("factory", "f1", "done", None), ("factory", "f2", "done", None), ("validation", "v1", "pending", None), ("validation", "v1", "done", True), ("validation", "v2", "done", False),
          ("validation", "v3", "pending", None), ("deployment", "d1", "live", None))
TRACK = ((0.5, 0.0, 3.0), (1.2, -0.5, 4.0), (-0.8, 0.3, 3.5), (2.5, 0.0, 6.0))


def _numbered(b: DataFrame) -> DataFrame:
    return b.withColumn("i", F.row_number().over(by_symbol()) - 1)


def filtered_rules(b: DataFrame) -> DataFrame:
    made = strategy.Strategy(
        "filtered", strategy.Group((strategy.Rule("close", "<=", "sma_20"), strategy.Rule("volume", "!=", 0.0))), strategy.Group((strategy.Rule("close", "==", "high"), strategy.Rule("momentum_10", "cross_below", 0.0)), "or"),
        universe=strategy.Group((strategy.Rule("volume", ">", 100.0),)), regime=strategy.Group((strategy.Rule("returns_20d", ">", -0.5),)), id="filtered",
    )
    return strategy.signals(b, [made]).select("strategy_id", "symbol", "ts", "entry_signal", "exit_signal")


def faulty(b: DataFrame) -> DataFrame:
    """The first 40 bars of each symbol with one fault of each kind."""
    at = lambda n, new, old: F.when(F.col("i") == n, new).otherwise(F.col(old))
    rows = _numbered(b).where("i < 40")
    rows = rows.withColumn("high", at(9, F.col("low") - 1, "high")).withColumn("open", at(11, F.lit(None).cast("double"), "open")).withColumn("close", at(13, F.lit(0.0), "close"))
    rows = rows.withColumn("volume", at(17, F.lit(-5.0), "volume")).withColumn("ingest_seq", F.when(F.col("i") == 20, 21).when(F.col("i") == 21, 20).otherwise(F.col("i")).cast("double"))
    return rows.unionByName(rows.where("i = 5").withColumn("volume", F.col("volume") + 1).withColumn("ingest_seq", F.lit(5.5)))


def _path(spark: SparkSession, name: str) -> str:
    return f"{store.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "bars")
    store.write_bars(bars.bars_lineitem(spark, sf_dir), path)
    return store.read_bars(spark, path, ["AF", "NO"], "1998-01-01", "1998-12-31")


def described_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side table after one symbol has been cleared, with whether each still serves."""
    path = _path(spark, "bars")
    store.write_bars(bars.bars_lineitem(spark, sf_dir), path)
    assert store.clear_bars(spark, path, "AF") and not store.clear_bars(spark, path, "none")
    about = store.describe_bars(spark, path, "2024-01-01")
    return about.join(store.fresh_symbols(about, "2001-10-30", "2001-11-10"), "symbol")


def daily_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two daily runs over mock vintages: the second adds what has come out since."""
    rows = pit.vintages_of(pit.mock_vintages(spark, {"GDP": "Q", "CPI": "M"}, "2015-01-01", "2020-12-31", "2020-12-31"))
    empty = bars.pit_orders(spark, sf_dir).where("false")
    twice = pit.daily_sync(pit.daily_sync(empty, rows, "2020-06-15", 12), rows, "2020-08-15", 12)
    return twice.select("indicator_name", "observation_date", "release_date", "value", "revision_number")


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "features")
    store.write_features(bars.bars_lineitem(spark, sf_dir).select("symbol", "ts", sma(20).alias("sma_20")), path)
    return store.read_features(spark, path, "RF").select("symbol", "ts", "sma_20")


def _log(spark: SparkSession) -> DataFrame:
    path = _path(spark, "log")
    for kind, key, status, passed in LOGGED:
        store.append(spark, path, kind, key, status, {} if passed is None else {"passed": passed})
    return spark.read.schema(store.LOG).parquet(path)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark)
    return store.listed(log, "validation").unionByName(store.get(log, "factory", "f1")).select("kind", "id", "status", F.get_json_object("data", "$.passed").alias("passed"))


def compared_runs(run: DataFrame) -> DataFrame:
    runs = store.logged_runs(backtest.metrics(run), {"template": "sma_crossover"}, F.lit(True))
    return store.compare(runs, ["sma_crossover|AF", "sma_crossover|RO"])


def exact_folds(b: DataFrame) -> DataFrame:
    """Rows that train and test each choice of 3 of 6 folds, as one number, and the mean of the tested closes."""
    found = validation.cpcv_exact(b, lambda train, test: len(train) * 100_000.0 + len(test) + round(float(test["close"].mean())) / 1e6, 6, 3)
    return found.withColumnRenamed("sharpe", "score")


def charted(run: DataFrame) -> DataFrame:
    benchmark = run.where("symbol = 'AF'").groupBy("ts").agg(F.max("equity").alias("equity"))
    return analysis.chart(run, benchmark, 300)


def formula_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(str(t), t.size, t.depth, t.complexity, t.hash, str(dsl.parse(str(t))) == str(t)) for t in map(dsl.parse, FORMULAS)]
    return spark.createDataFrame(rows, "formula string, size int, depth int, complexity double, hash string, same_again boolean")


def template_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, make in strategy.TEMPLATES.items():
        s = make()
        rows.append((name, len(s.entry.rules), len(s.exit.rules), float(s.stop_loss or 0), strategy.Strategy.from_json(s.to_json()) == s, s.clone().fingerprint() == s.fingerprint(), s.with_parameters().fingerprint() == s.fingerprint()))
    return spark.createDataFrame(rows, "name string, entry_rules int, exit_rules int, stop_loss double, json_round_trip boolean, clone_is_equal boolean, parameters_kept boolean")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("c_acctbal").alias("balance"))


def ranked_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sorted(tuple(r) for r in _nations(spark, sf_dir).collect())
    x = np.array([[n, -balance] for _, n, balance in rows])
    return spark.createDataFrame([(int(k), int(rank)) for (k, _, _), rank in zip(rows, search.pareto_ranks(x), strict=True)], "nation int, rank int")


def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("double").alias("a"), (F.col("p_retailprice") + F.col("p_partkey") / 1e6).alias("b"), (F.col("p_partkey") % 7).alias("rank"))
    return search.crowding_distances(rows, ["a", "b"]).select("id", "rank", "crowding")


def reference_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([tuple(map(float, p)) for p in search.reference_points(3, 4)], "x double, y double, z double")


def ratio_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f"quick_{n}", validation.quick_expected_max_sharpe(n)) for n in (1, 10, 1000)] + [(f"best_{n}", validation.expected_max_sharpe(n)) for n in (1, 10, 1000)]
    rows += [(f"track_{v:g}", float(validation.minimum_track_record(v, 0.05, g, k))) for v, g, k in TRACK]
    return spark.createDataFrame(rows, "figure string, value double")


def canary_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x["day"], x["leaks"]) for x in quality.isolation(quality.mock_model("2022-06-01"), "2021-01-01")], "day string, leaks boolean")


def causal_features(b: DataFrame) -> DataFrame:
    found = None
    for name, (causal, column) in quality.feature_rules().items():
        part = quality.lookahead(b, lambda d, c=column: d.withColumn("x", c), "x").agg(F.lit(name).alias("feature"), F.lit(causal).alias("is_causal"), (F.count(F.lit(1)) > 0).alias("looks_ahead"))
        found = part if found is None else found.unionByName(part)
    return found


def tested_formulas(b: DataFrame) -> DataFrame:
    return search.formula_fitness(b, [dsl.parse(f) for f in FITNESS]).drop("tree_id")


def selection_pbo(b: DataFrame) -> DataFrame:
    return search.selection_pbo(search.formula_fitness(b, [dsl.parse(f) for f in FITNESS])).select("pbo", "combinations", "rank_correlation")


def funnel_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether cached ranges still serve."""
    day = lambda n: str(dt.date(2024, 1, 31) + dt.timedelta(days=n))
    rows = [(e, w, f, store.is_fresh(day(e), day(w), day(f), day(0))) for e in (-60, -1, 0) for w in (-40, -1) for f in (-5, 0)]
    return spark.createDataFrame([(*r, store.cache_key("SPY", day(r[0]), day(r[1]))) for r in rows], "cached_end int, wanted_end int, fetched int, fresh boolean, cache_key string")


def queries(on_bars, on_run, rounded) -> dict:
    return {
        "rule_filters": on_bars(filtered_rules), "quality_faults": on_bars(lambda b: quality.issues(faulty(b))), "stored_bars": lambda s, d: rounded(stored_bars(s, d)), "stored_features": lambda s, d: rounded(stored_features(s, d)), "described_bars": lambda s, d: rounded(described_bars(s, d)), "daily_sync": lambda s, d: rounded(daily_revisions(s, d)),
        "run_log": run_log, "run_counters": lambda s, d: rounded(store.counters(_log(s))), "compared_runs": on_run(compared_runs), "cpcv_exact": on_bars(exact_folds), "chart": on_run(charted),
        "formula_facts": lambda s, d: rounded(formula_facts(s, d)), "template_facts": lambda s, d: rounded(template_facts(s, d)), "pareto_ranks": ranked_nations, "crowding_distances": lambda s, d: rounded(crowded(s, d)),
        "reference_points": lambda s, d: rounded(reference_grid(s, d)), "ratio_figures": lambda s, d: rounded(ratio_figures(s, d)), "canary_answers": canary_answers, "causal_features": on_bars(causal_features),
        "formula_fitness": on_bars(tested_formulas), "selection_pbo": on_bars(selection_pbo), "cache_freshness": funnel_days,
        "trade_summary": on_run(lambda r: backtest.trade_summary(backtest.trades(r))), "simple_signal": on_bars(lambda b: backtest.simple_signal(b).select("symbol", "ts", "signal")),
        "quick_validation": on_bars(lambda b: validation.quick_validate(b, [strategy.Strategy("buy_and_hold", strategy.buy_and_hold().entry, id="buy_and_hold")])),
        "ohlc_rows": on_bars(lambda b: quality.bad_ohlc(faulty(b)).select("symbol", "ts", "high", "low")),
        "first_of_each": lambda s, d: rounded(search.distinct_first(s.read.parquet(f"{d}/customer.parquet"), "c_nationkey", "c_custkey").select("c_nationkey", "c_custkey")),
    }


__all__ = ["Window", "change", "queries"]
