"""Attribution by regime and calendar, rolling figures, and the regime of each bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import YEAR, by_symbol, change, div, full, last, so_far
from tidemark.operators.backtest import KEY, by_key, key_so_far

#: Limits that tell regimes apart. Fixed values.
CRISIS_DRAWDOWN, CRISIS_RETURN, HIGH_RATIO, TREND_SLOPE, TREND_RATIO = -0.15, -0.15, 2.0, 0.3, 1.5


def regimes(bars: DataFrame) -> DataFrame:
    """bars with the regime's features, regime and confidence; every row looks at its own past only."""
    ret = change("close")
    out = bars.withColumn("_ret", ret).withColumn("_n", F.row_number().over(by_symbol()).cast("double"))
    realized = full("_ret", 20, F.stddev_samp("_ret").over(last(20))) * float(YEAR**0.5)
    usual = full("_ret", 60, F.stddev_samp("_ret").over(last(60))) * float(YEAR**0.5)
    peak = F.max("close").over(last(50))
    first = F.first("close").over(last(20))
    out = out.select(
        "*", realized.alias("realized_vol"), usual.alias("historical_vol"), div(F.col("close") - peak, peak).alias("_dd"),
        full("close", 20, div(F.regr_slope("close", "_n").over(last(20)), first) * YEAR).alias("trend_slope"), change("close", 20).alias("return_20"),
    )
    out = out.withColumn("drawdown", F.min("_dd").over(so_far())).withColumn("vol_ratio", div("realized_vol", "historical_vol"))
    crisis = (F.col("drawdown") < CRISIS_DRAWDOWN) | (F.col("return_20") < CRISIS_RETURN)
    high, trend = F.col("vol_ratio") > HIGH_RATIO, (F.abs("trend_slope") > TREND_SLOPE) & (F.col("vol_ratio") < TREND_RATIO)
    no = F.lit(False)
    regime = F.when(F.coalesce(crisis, no), "crisis").when(F.coalesce(high, no), "high_vol").when(F.coalesce(trend, no), "trending").otherwise("normal")
    deep = F.least(F.lit(1.0), F.abs(F.least("drawdown", F.coalesce("return_20", F.lit(0.0)))) / 0.3)
    sure = F.when(regime == "crisis", deep).when(regime == "high_vol", F.least(F.lit(1.0), F.col("vol_ratio") / 3)).when(regime == "trending", F.least(F.lit(1.0), F.abs("trend_slope"))).otherwise(0.5)
    return out.withColumn("regime", regime).withColumn("confidence", sure).drop("_ret", "_n", "_dd")


def by_regime(run: DataFrame, labelled: DataFrame) -> DataFrame:
    """Figures of the returns in each regime; regimes without rows do not appear."""
    rows = run.join(labelled.select("symbol", "ts", "regime"), ["symbol", "ts"])
    inside = Window.partitionBy(*KEY, "regime").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_eq", F.product(1 + F.col("ret")).over(inside)).withColumn("_dd", div("_eq", F.max("_eq").over(inside)) - 1)
    return rows.groupBy(*KEY, "regime").agg(
        F.count(F.lit(1)).alias("days"), (F.product(1 + F.col("ret")) - 1).alias("total_return"), F.avg("ret").alias("mean_return"),
        F.coalesce(div(F.avg("ret"), F.stddev_samp("ret")) * float(YEAR**0.5), F.lit(0.0)).alias("sharpe_ratio"), F.min("_dd").alias("max_drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
    )


def monthly(run: DataFrame) -> DataFrame:
    """Compounded return of each calendar month; months without bars give 0."""
    months = run.groupBy(*KEY, F.last_day("ts").alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    span = months.groupBy(*KEY).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    first = F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))
    calendar = span.select(*KEY, F.explode(first).alias("month")).withColumn("month", F.last_day("month"))
    return calendar.join(months, [*KEY, "month"], "left").fillna(0.0, ["ret"])


def yearly(run: DataFrame) -> DataFrame:
    return run.groupBy(*KEY, F.year("ts").alias("year")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


def best_and_worst(run: DataFrame) -> DataFrame:
    m, y = monthly(run), yearly(run)
    pick = lambda t, c, n: t.groupBy(*KEY).agg(F.max_by(c, F.struct("ret", c)).alias(f"best_{n}"), F.min_by(c, F.struct("ret", c)).alias(f"worst_{n}"))
    return pick(m, "month", "month").join(pick(y, "year", "year"), KEY)


def rolling_sharpe(run: DataFrame, n: int = YEAR) -> DataFrame:
    over = by_key().rowsBetween(-(n - 1), 0)
    value = div(F.avg("ret").over(over), F.stddev_samp("ret").over(over)) * float(YEAR**0.5)
    return run.select(*KEY, "ts", F.when(F.count("ret").over(over) >= n, value).alias("rolling_sharpe")).where(F.col("rolling_sharpe").isNotNull())


def rolling_drawdown(run: DataFrame) -> DataFrame:
    peak = F.max("equity").over(key_so_far())
    return run.select(*KEY, "ts", div(F.col("equity") - peak, peak).alias("drawdown"))


def chart(run: DataFrame, benchmark: DataFrame, points: int = 500) -> DataFrame:
    """Equity of run and of benchmark (ts, equity) where both have a row, thinned to about `points` rows a key."""
    both = run.join(benchmark.select("ts", F.col("equity").alias("benchmark")), "ts")
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*KEY)) / points))
    numbered = both.withColumn("_i", F.row_number().over(by_key()) - 1).withColumn("_s", step)
    return numbered.where(F.col("_i") % F.col("_s") == 0).select(*KEY, "ts", "equity", "benchmark")
