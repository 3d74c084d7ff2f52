"""Validation against overfitting: deflated Sharpe ratio, combinatorial purged cross-validation, probability of overfitting,
superior predictive ability, stress tests, walk-forward analysis, and the gates over them."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.core import YEAR, by_symbol, change, div
from tidemark.operators.backtest import KEY, backtest, metrics, sharpe
from tidemark.plans.strategy import Strategy
from tidemark.sources.store import stored

NORMAL = NormalDist()
EULER = 0.5772156649015329


# ---- deflated Sharpe ratio --------------------------------------------------------------------------------------------------
def expected_max_sharpe(trials: int) -> float:
    """Of the best of so many worthless trials, in standard deviations."""
    if trials <= 1:
        return 0.0
    quantile = lambda p: NORMAL.inv_cdf(min(max(p, 1e-10), 1 - 1e-10))
    return (1 - EULER) * quantile(1 - 1 / trials) + EULER * quantile(1 - 1 / (trials * math.e))


def quick_expected_max_sharpe(trials: int) -> float:
    return math.sqrt(2 * math.log(trials)) if trials > 1 else 0.0


def sharpe_error(value: float, n: int, skew: float = 0.0, kurtosis: float = 3.0) -> float:
    variance = 1 + value**2 / 2 - skew * value + (kurtosis - 3) / 4 * value**2
    return math.sqrt(max(variance, 0.01) / n)


def deflated_sharpe(value: float, trials: int, n: int, skew: float = 0.0, kurtosis: float = 3.0) -> float:
    """Chance that the ratio is better than the best of `trials` worthless ones."""
    z = (value - expected_max_sharpe(trials)) / sharpe_error(value, n, skew, kurtosis)
    return math.erfc(-z / math.sqrt(2)) / 2  # exact in the tails too


def deflated_sharpes(run: DataFrame, trials: int, days: int = YEAR) -> DataFrame:
    """For each strategy and symbol; the moments are one aggregation, the distribution function one Arrow batch."""
    moments = run.groupBy(*KEY).agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.skewness("ret").alias("g"), F.kurtosis("ret").alias("k")).where(F.col("n") >= 2)
    moments = moments.select(*KEY, "n", F.coalesce(div("m", "s") * float(days**0.5), F.lit(0.0)).alias("sharpe_ratio"), F.coalesce(F.nanvl("g", F.lit(0.0)), F.lit(0.0)).alias("g"), F.coalesce(F.nanvl("k", F.lit(0.0)), F.lit(0.0)).alias("k"))

    @F.pandas_udf("double")
    def probability(v: pd.Series, n: pd.Series, g: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([deflated_sharpe(a, trials, b, c, d + 3) for a, b, c, d in zip(v, n, g, k, strict=True)])

    return moments.select(*KEY, "n", "sharpe_ratio", probability("sharpe_ratio", "n", "g", "k").alias("dsr"))


# ---- combinatorial purged cross-validation ---------------------------------------------------------------------------------
def folds(rows: DataFrame, n: int = 16, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """rows with fold (1 to n): stretches of equal length in time, the first ones longer by one if need be."""
    return rows.withColumn("fold", F.ntile(n).over(Window.partitionBy(*by).orderBy("ts")))


def fold_info(rows: DataFrame, n: int = 16) -> DataFrame:
    return folds(rows, n).groupBy("symbol", "fold").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("rows"))


def combinations(spark: SparkSession, n: int = 16, k: int = 8, most: int | None = None, seed: int = 42) -> DataFrame:
    """combo_id and mask of each choice of k of n folds, or a seeded sample of `most` of them."""
    rows = spark.range(2**n).where(F.bit_count("id") == k).select(F.col("id").cast("int").alias("mask"))
    order = [F.xxhash64("mask", F.lit(seed))] if most is not None else []
    numbered = rows.withColumn("combo_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order, "mask")))
    return numbered if most is None else numbered.where(F.col("combo_id") <= most)


def cpcv(run: DataFrame, n: int = 16, k: int = 8, most: int | None = None, days: int = YEAR) -> DataFrame:
    """Sharpe ratio on the test folds of each choice: strategy_id, symbol, combo_id, mask, sharpe.

    The fast mode: a fold's count, sum and sum of squares are worked out once; a choice adds up those of its folds. What meets
    the choices (a table whose size n and k fix) is n rows a strategy and symbol, as arrays in one row, not the bars.
    """
    parts = folds(run, n, tuple(KEY)).groupBy(*KEY, "fold").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    packed = parts.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("fold", "n", "s", "q"))).alias("f"))
    masks = combinations(run.sparkSession, n, k, most).agg(F.sort_array(F.collect_list(F.struct("combo_id", "mask"))).alias("c"))
    both = packed.join(F.broadcast(masks)).select(*KEY, "f", F.explode("c").alias("c")).select(*KEY, "f", "c.combo_id", "c.mask")
    both = both.withColumn("g", F.filter("f", lambda x: F.getbit(F.col("mask"), x["fold"] - 1) == 1))
    add = lambda field: F.aggregate("g", F.lit(0.0), lambda a, x: a + x[field].cast("double"))
    sums = both.select(*KEY, "combo_id", "mask", add("n").alias("n"), add("s").alias("s"), add("q").alias("q"))
    variance = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    return sums.select(*KEY, "combo_id", "mask", F.coalesce(div(F.col("s") / F.col("n"), F.when(variance > 1e-18, F.sqrt(variance))) * float(days**0.5), F.lit(0.0)).alias("sharpe"))


def cpcv_summary(found: DataFrame) -> DataFrame:
    """mean, population deviation and extremes of the ratios, and the share below zero."""
    return found.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("combinations"), F.avg("sharpe").alias("mean_sharpe"), F.stddev_pop("sharpe").alias("std_sharpe"), F.min("sharpe").alias("min_sharpe"), F.max("sharpe").alias("max_sharpe"),
        F.avg((F.col("sharpe") < 0).cast("double")).alias("probability_of_loss"),
    )


def cpcv_exact(bars: DataFrame, score: Callable[[pd.DataFrame, pd.DataFrame], float], n: int = 16, k: int = 8, most: int | None = None, embargo: float = 0.02, seed: int = 42, at_once: int = 200) -> DataFrame:
    """score(train, test) for each choice (or a seeded sample of `most` of them), on the rows themselves; bars next to a test fold are purged.

    A symbol's rows go to one task once, and all choices are scored there, `at_once` of them in a task.
    """
    numbered = folds(bars, n)
    edge = Window.partitionBy("symbol", "fold")
    numbered = numbered.withColumn("_i", F.row_number().over(edge.orderBy("ts")) - 1).withColumn("_n", F.count(F.lit(1)).over(edge))
    parts = [(c, m) for c, m in _choices(n, k, most, seed)]
    groups = [parts[i : i + at_once] for i in range(0, len(parts), at_once)]
    both = numbered.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable")
        fold, place, size = (rows[c].to_numpy() for c in ("fold", "_i", "_n"))
        margin = np.maximum((size * embargo).astype(int), 1)
        out = []
        for combo, mask in groups[int(rows["_g"].iloc[0])]:
            chosen = np.array([False, *(bool(mask >> f & 1) for f in range(n)), False])
            test = chosen[fold]
            purged = chosen[fold - 1] & (place < margin) | chosen[fold + 1] & (place >= size - margin)
            out.append((rows["symbol"].iloc[0], combo, mask, float(score(rows[~test & ~purged], rows[test]))))
        return pd.DataFrame(out, columns=["symbol", "combo_id", "mask", "sharpe"])

    return both.groupBy("symbol", "_g").applyInPandas(run, "symbol string, combo_id int, mask int, sharpe double").where(~F.isnan("sharpe"))


def _choices(n: int, k: int, most: int | None, seed: int) -> list[tuple[int, int]]:
    """(combo_id, mask) of each choice of k of n folds by mask, or of a seeded sample of `most` of them."""
    masks = sorted(sum(1 << f for f in c) for c in itertools.combinations(range(n), k))
    numbered = list(enumerate(masks, 1))
    return numbered if most is None or most >= len(masks) else sorted(random.Random(seed).sample(numbered, most))


# ---- probability of overfitting --------------------------------------------------------------------------------------------
def pbo(performance: DataFrame) -> DataFrame:
    """performance: combo_id, strategy_id, in_sample, out_sample. The share of choices whose best strategy in sample ranks in the
    lower half out of sample, that share's logit (infinite at 0 and 1), the mean logit of the rank, and the rank correlation over all."""
    by = Window.partitionBy("combo_id")

    def ranked(x: str) -> Column:
        """Average rank, the best first."""
        ties = F.count(F.lit(1)).over(Window.partitionBy("combo_id", x))
        return F.rank().over(by.orderBy(F.col(x).desc())) + (ties - 1) / 2

    rows = performance.withColumn("_r", ranked("out_sample")).withColumn("_i", ranked("in_sample")).withColumn("_n", F.count(F.lit(1)).over(by))
    best = rows.groupBy("combo_id").agg(F.max_by("_r", F.struct("in_sample", -F.hash("strategy_id"))).alias("rank"), F.first("_n").alias("n"))
    place = 1 - F.col("rank") / (F.col("n") + 1)
    figures = best.agg(F.avg((F.col("rank") > F.col("n") / 2).cast("double")).alias("pbo"), F.avg(F.log(place / (1 - place))).alias("mean_logit"), F.count(F.lit(1)).alias("combinations"))
    logit = F.when(F.col("pbo") <= 0, float("-inf")).when(F.col("pbo") >= 1, float("inf")).otherwise(F.log(div("pbo", 1 - F.col("pbo"))))
    # both sides are one row
    return figures.withColumn("logit", logit).crossJoin(F.broadcast(rows.agg(F.corr("_i", "_r").alias("rank_correlation"))))


def pbo_windows(ratios: DataFrame, inside: int, outside: int) -> DataFrame:
    """performance for pbo() from ratios (period, strategy_id, sharpe): means of rolling in-sample windows and of those after them."""
    order = Window.partitionBy("strategy_id").orderBy("period")
    now, after = order.rowsBetween(-(inside - 1), 0), order.rowsBetween(1, outside)
    rows = ratios.withColumn("in_sample", F.avg("sharpe").over(now)).withColumn("out_sample", F.avg("sharpe").over(after))
    whole = (F.count("sharpe").over(now) == inside) & (F.count("sharpe").over(after) == outside)
    return rows.withColumn("_w", whole).where("_w").select(F.col("period").alias("combo_id"), "strategy_id", "in_sample", "out_sample")


def probability_of_loss(ratios: DataFrame, value: str = "sharpe", threshold: float = 0.05) -> DataFrame:
    p = F.avg((F.col(value) < 0).cast("double"))
    return ratios.agg(p.alias("probability"), F.when(p <= 0, float("-inf")).when(p >= 1, float("inf")).otherwise(F.log(p / F.try_subtract(F.lit(1.0), F.when(p < 1, p)))).alias("logit"), (p <= threshold).alias("passed"))


def minimum_track_record(value: float, target: float = 0.05, skew: float = 0.0, kurtosis: float = 3.0) -> float:
    if value == 0:
        return math.inf
    variance = 1 - skew * value + (kurtosis - 1) / 4 * value**2
    return math.ceil(NORMAL.inv_cdf(1 - target) ** 2 * variance / value**2)


# ---- superior predictive ability -------------------------------------------------------------------------------------------
_PRIME = (1 << 31) - 1


def _scattered(seed: int, at: np.ndarray, number: int) -> np.ndarray:
    """Numbers from 0 to 1 by seed and place, from whole-number arithmetic that any engine has."""
    x = (seed * 1_000_003 + at * 7919 + number * 104_729 + 12_345) % _PRIME
    for factor, shift in ((48_271, 13), (69_621, 11), (39_373, 7)):
        x = (x ^ (x >> shift)) * factor % _PRIME
    return x / _PRIME


def _stationary(seed: int, n: int, block: float) -> np.ndarray:
    """Indices of a stationary bootstrap sample: stretches of geometric length, wrapped around."""
    at = np.arange(n, dtype=np.int64)
    fresh = _scattered(seed, at, 0) < 1 / block
    fresh[0] = True
    start = (_scattered(seed, at, 1) * n).astype(np.int64) % n
    begun = np.maximum.accumulate(np.where(fresh, at, 0))
    return (start[begun] + at - begun) % n


def spa(pairs: DataFrame, reps: int = 1000, block: float = 10.0, seed: int = 42) -> DataFrame:
    """Hansen's test that the strategy beats the benchmark, on rows (name, ts, strategy, benchmark) that met by time.

    The series of a name is one array row; replications are spread over tasks, each with a seed of its own, and only their
    exceedances are summed. The consistent recentring keeps the mean unless it is far below zero.
    """
    spark = pairs.sparkSession
    series = pairs.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ts", (F.col("strategy") - F.col("benchmark")).alias("d")))).alias("x")).select("name", F.transform("x", lambda v: v["d"]).alias("d"))
    jobs = spark.range(reps).select((F.col("id") + seed * 1_000_003).alias("seed"), (F.col("id") % 16).alias("part")).groupBy("part").agg(F.collect_list("seed").alias("seeds"))

    def run(batches):
        for batch in batches:
            rows = []
            for name, d, seeds in zip(batch["name"], batch["d"], batch["seeds"], strict=True):
                d = np.asarray(d, dtype=float)
                n, mean = len(d), float(np.mean(d))
                means = np.array([d[_stationary(int(s), n, block)].mean() for s in seeds])
                omega = math.sqrt(max(_long_run_variance(d, block), 1e-24))
                statistic = max(0.0, math.sqrt(n) * mean / omega)
                centre = mean if math.sqrt(n) * mean / omega >= -math.sqrt(2 * math.log(math.log(max(n, 16)))) else 0.0
                boot = np.maximum(0.0, math.sqrt(n) * (means - centre) / omega)
                rows.append((name, statistic, int((boot >= statistic).sum()) if statistic > 0 else len(means), len(means), mean))
            yield pd.DataFrame(rows, columns=["name", "statistic", "above", "n", "mean_difference"])

    found = series.join(F.broadcast(jobs)).mapInPandas(run, "name string, statistic double, above long, n long, mean_difference double")
    return found.groupBy("name").agg(F.first("statistic").alias("statistic"), F.first("mean_difference").alias("mean_difference"), (F.sum("above") / F.sum("n")).alias("p_value"))


def _long_run_variance(d: np.ndarray, block: float) -> float:
    """Variance of the mean's sum under the stationary bootstrap, from autocovariances with its kernel."""
    x, n, q = d - d.mean(), len(d), 1 / block
    out = float(x @ x) / n
    for i in range(1, min(n, int(20 * block))):
        kernel = (n - i) / n * (1 - q) ** i + i / n * (1 - q) ** (n - i)
        out += 2 * kernel * float(x[i:] @ x[:-i]) / n
    return out


# ---- stress ----------------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Scenario:
    """A stretch of time, a transformation that transformed() knows, or one of your own (bars to bars, by symbol), with the least ratio and
    the deepest drawdown that pass."""

    name: str
    kind: str = "period"
    start: str | None = None
    end: str | None = None
    min_sharpe: float = 0.0
    max_drawdown: float = 0.5
    transform: Callable[[DataFrame], DataFrame] | None = None

    def of(self, bars: DataFrame) -> DataFrame:
        if self.transform is not None:
            return self.transform(bars)
        if self.kind != "period":
            return transformed(bars, self.kind)
        return bars.where((F.col("ts") >= F.lit(self.start).cast("timestamp")) & (F.col("ts") < F.lit(self.end).cast("timestamp") + F.expr("interval 1 day")))


#: Transformations that transformed() knows.
SYNTHETIC = (Scenario("volatility_3x", "volatility_3x"), Scenario("gap_risk", "gap_risk"), Scenario("correlation_spike", "correlation_spike"))
#: Crises by their dates. Fixed values.
HISTORICAL = (
    Scenario("2008_financial_crisis", start="2008-09-01", end="2008-12-31"),
    Scenario("2020_covid_crash", start="2020-02-19", end="2020-03-23"),
    Scenario("2022_rate_hikes", start="2022-01-01", end="2022-10-31"),
)


def transformed(bars: DataFrame, kind: str, seed: int = 42) -> DataFrame:
    """Bars with other closes; high, low and open are rebuilt around them (1 % above and below, and the close before).

    Prices stay between e^-600 and e^600 of the first one.
    """
    so_far = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("close").over(so_far)
    ret = F.coalesce(change("close"), F.lit(0.0))
    if kind == "volatility_3x":
        mean = F.avg("_r").over(Window.partitionBy("symbol"))
        new = mean + 3 * (F.col("_r") - mean)
    elif kind == "correlation_spike":
        new = F.avg("_r").over(by_symbol().rowsBetween(-2, 0))
    elif kind == "gap_risk":
        name = lambda salt: F.concat_ws("|", "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(str(seed + salt)))
        chance = lambda salt: F.conv(F.substring(F.md5(name(salt).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
        new = (1 + F.col("_r")) * (1 + F.when(chance(0) < 0.1, F.when(chance(1) < 0.5, -0.05).otherwise(0.05)).otherwise(0.0)) - 1
    else:
        raise ValueError(f"unknown transformation: {kind}")
    rows = bars.withColumn("_r", ret).withColumn("_n", F.greatest(new, F.lit(-0.95)))
    rows = rows.withColumn("_f", first).withColumn("close", F.col("_f") * F.exp(F.greatest(F.lit(-600.0), F.least(F.lit(600.0), F.sum(F.log1p("_n")).over(so_far)))))
    rows = rows.withColumn("high", F.col("close") * 1.01).withColumn("low", F.col("close") * 0.99).withColumn("open", F.coalesce(F.lag("close").over(by_symbol()), "close"))
    return rows.drop("_r", "_n", "_f")


def stress(bars: DataFrame, strategies: list[Strategy], scenarios: list[Scenario]) -> DataFrame:
    """One row per scenario, strategy and symbol: sharpe_ratio, max_drawdown, passed. All scenarios are one job, on bars that are worked out once."""
    rows, bars = None, stored(bars, "stress-bars")
    for s in scenarios:
        part = s.of(bars).withColumn("symbol", F.concat(F.col("symbol"), F.lit(f"|{s.name}")))
        rows = part if rows is None else rows.unionByName(part)
    found = metrics(backtest(rows, strategies)).select("strategy_id", F.split("symbol", r"\|").alias("_p"), "sharpe_ratio", "max_drawdown")
    limits = bars.sparkSession.createDataFrame([(s.name, s.min_sharpe, s.max_drawdown) for s in scenarios], "scenario string, least double, deepest double")
    found = found.select("strategy_id", F.col("_p")[0].alias("symbol"), F.col("_p")[1].alias("scenario"), "sharpe_ratio", "max_drawdown").join(F.broadcast(limits), "scenario")
    return found.withColumn("passed", (F.col("sharpe_ratio") >= F.col("least")) & (F.col("max_drawdown") <= F.col("deepest"))).drop("least", "deepest")


def stress_summary(found: DataFrame, least: float = 0.8) -> DataFrame:
    out = found.groupBy("strategy_id", "symbol").agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"))
    return out.withColumn("passed", F.col("pass_rate") >= least)


# ---- walk forward ----------------------------------------------------------------------------------------------------------
def periods(run: DataFrame, inside: int = 252, outside: int = 63, anchored: bool = False) -> DataFrame:
    """period and segment (in, out) of each row, stepping by the out-of-sample length; a row is in as many periods as hold it."""
    n = F.row_number().over(Window.partitionBy(*KEY).orderBy("ts")) - 1
    rows = run.withColumn("_n", n).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    count = F.floor((F.col("_all") - inside) / outside).cast("int")
    rows = rows.withColumn("_p", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))))
    begin = F.lit(0) if anchored else F.col("_p") * outside
    end = F.col("_p") * outside + inside
    rows = rows.withColumn("segment", F.when((F.col("_n") >= begin) & (F.col("_n") < end), "in").when((F.col("_n") >= end) & (F.col("_n") < end + outside), "out"))
    return rows.where(F.col("segment").isNotNull()).withColumnRenamed("_p", "period").drop("_n", "_all")


def walk_forward(run: DataFrame, inside: int = 252, outside: int = 63, anchored: bool = False, days: int = YEAR) -> DataFrame:
    """For each symbol and period the strategy that is best in sample (all candidates ran in one job), with its ratio in and out of sample."""
    by = periods(run, inside, outside, anchored).groupBy("symbol", "period", "strategy_id", "segment").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    rated = by.withColumn("sharpe", F.coalesce(div("m", "s") * float(days**0.5), F.lit(0.0)))
    wide = rated.groupBy("symbol", "period", "strategy_id").agg(F.max(F.when(F.col("segment") == "in", F.col("sharpe"))).alias("in_sharpe"), F.max(F.when(F.col("segment") == "out", F.col("sharpe"))).alias("out_sharpe"))
    best = wide.groupBy("symbol", "period").agg(F.max_by(F.struct("strategy_id", "in_sharpe", "out_sharpe"), F.struct("in_sharpe", "strategy_id")).alias("b"))
    return best.select("symbol", "period", "b.*").withColumn("degradation", F.col("in_sharpe") - F.col("out_sharpe"))


def walk_forward_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("periods"), F.avg("in_sharpe").alias("in_sharpe"), F.avg("out_sharpe").alias("out_sharpe"), F.avg("degradation").alias("degradation"),
        div(F.avg("out_sharpe"), F.avg("in_sharpe")).alias("efficiency"),
    )


# ---- the pipeline ----------------------------------------------------------------------------------------------------------
def validate(bars: DataFrame, strategies: list[Strategy], trials: int | None = None, run_cpcv: bool = True, scenarios: list[Scenario] | None = None, benchmark: DataFrame | None = None, min_dsr: float = 0.95, min_sharpe: float = 1.0, max_loss: float = 0.05) -> DataFrame:
    """One row per strategy and symbol with the figures of every component that ran, passed, and auto_accept.

    The run is worked out once and written to the folder in spark.checkpoint.dir, where all components read it.
    """
    run = stored(backtest(bars, strategies).select(*KEY, "ts", "ret"), "validation-run")
    out = deflated_sharpes(run, trials or len(strategies))
    gates, accept = [F.col("dsr") >= min_dsr, F.col("sharpe_ratio") >= min_sharpe], [F.col("dsr") >= 0.98, F.col("sharpe_ratio") >= 1.5]
    if run_cpcv:
        out = out.join(cpcv_summary(cpcv(run)).select(*KEY, "mean_sharpe", "probability_of_loss"), KEY, "left")
        gates.append(F.col("probability_of_loss") <= max_loss)
        accept.append(F.col("probability_of_loss") <= 0.02)
    if scenarios:
        out = out.join(stress_summary(stress(bars, strategies, scenarios)).select(*KEY, "pass_rate", F.col("passed").alias("stress_passed")), KEY, "left")
        gates.append(F.col("stress_passed"))
    if benchmark is not None:
        pairs = run.join(benchmark.select("ts", F.col("ret").alias("benchmark")), "ts").select(F.concat_ws("|", *KEY).alias("name"), "ts", F.col("ret").alias("strategy"), "benchmark")
        tested = spa(pairs).select(F.split("name", r"\|")[0].alias("strategy_id"), F.split("name", r"\|")[1].alias("symbol"), F.col("p_value").alias("spa_p_value"))
        out = out.join(tested, KEY, "left")
        gates.append(F.col("spa_p_value") <= 0.05)
    every = lambda conditions: F.coalesce(reduce(Column.__and__, conditions), F.lit(False))
    return out.withColumn("passed", every(gates)).withColumn("auto_accept", every(accept))


def quick_validate(bars: DataFrame, strategies: list[Strategy], trials: int = 1) -> DataFrame:
    return validate(bars, strategies, trials, run_cpcv=False).select(*KEY, "passed", "sharpe_ratio", "dsr")


__all__ = ["cpcv", "deflated_sharpe", "pbo", "sharpe", "spa", "stress", "validate", "walk_forward"]
