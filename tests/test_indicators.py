import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I  # noqa: N812


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(42)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))
    high, low = close * (1 + rng.uniform(0, 0.02, 300)), close * (1 - rng.uniform(0, 0.02, 300))
    return pd.DataFrame({"symbol": "X", "ts": pd.date_range("2020-01-01", periods=300), "open": close, "high": high, "low": low, "close": close, "volume": rng.integers(1000, 9000, 300).astype(float)})


@pytest.fixture(scope="module")
def bars(spark, frame):
    return spark.createDataFrame(frame)


def values(df, name):
    return df.orderBy("ts").toPandas()[name].astype(float).to_numpy()


def test_windows_match_pandas(bars, frame):
    got = bars.select("ts", I.sma(20).alias("sma"), I.volatility(20).alias("vol"), I.rolling_stat("close", 20, "skew").alias("skew"), I.rolling_stat("close", 20, "kurt").alias("kurt"))
    roll = frame.close.rolling(20)
    for name, want in (("sma", roll.mean()), ("vol", frame.close.pct_change().rolling(20).std() * np.sqrt(252)), ("skew", roll.skew()), ("kurt", roll.kurt())):
        np.testing.assert_allclose(values(got, name), want.to_numpy(), rtol=1e-6, atol=1e-8)


def test_recursive_indicators(bars, frame):
    got = I.with_recursive(bars, [("ema", 12), ("macd",), ("rsi", 14)])
    np.testing.assert_allclose(values(got, "ema_12"), frame.close.ewm(span=12, adjust=False, min_periods=12).mean().to_numpy(), rtol=1e-12)
    rsi = values(got, "rsi_14")
    assert np.isnan(rsi[:13]).all() and ((rsi[13:] >= 0) & (rsi[13:] <= 100)).all()


def test_rsi_without_losses_is_100(spark):
    rising = pd.DataFrame({"symbol": "X", "ts": pd.date_range("2020-01-01", periods=30), "open": 1.0, "high": 1.0, "low": 1.0, "close": np.arange(1.0, 31.0), "volume": 1.0})
    assert values(I.with_recursive(spark.createDataFrame(rising), [("rsi", 14)]), "rsi_14")[-1] == 100


def test_bundles_have_their_columns(bars):
    basic = I.basic_bundle(bars).columns
    assert len(basic) == 7 + 22 and {"sma_200", "macd_hist", "adx_14", "volume_ratio"} <= set(basic)
    advanced = I.advanced_bundle(bars)
    assert {"aroon_up", "kst_signal", "mass_index", "vortex_plus", "ichimoku_chikou"} <= set(advanced.columns)
    assert advanced.count() == 300


def test_bounds(bars):
    row = bars.select(*[c.alias(n) for n, c in (I.stochastic() | I.aroon() | {"w": I.williams_r(), "m": I.mfi()}).items()])
    worst = row.agg(*[F.min(c).alias(f"{c}_a") for c in row.columns], *[F.max(c).alias(f"{c}_b") for c in row.columns]).first()
    assert worst["stoch_k_a"] >= 0 and worst["stoch_k_b"] <= 100 and worst["w_a"] >= -100 and worst["w_b"] <= 0 and worst["m_b"] <= 100 and worst["aroon_up_b"] <= 100


def test_unknown_feature_is_an_error(bars):
    with pytest.raises(KeyError):
        I.features(bars, ["nothing"])


def test_empty_bars(bars):
    assert I.basic_bundle(bars.where("false")).count() == 0
