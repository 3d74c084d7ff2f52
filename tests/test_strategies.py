import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import analysis, backtest, execution, pit, quality, search, validation
from tidemark.plans import strategy
from tidemark.sources import bars as sources
from tidemark.sources import store
from tidemark.streaming import cusum


def make(spark, close, symbol="X", **columns):
    close = [float(c) for c in close]
    frame = pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2020-01-01", periods=len(close)), "open": close, "high": close, "low": close, "close": close, "volume": 1000.0} | columns)
    return spark.createDataFrame(frame)


def signalled(spark, close, entry, leave, stop=0.0, profit=0.0, most=0):
    b = make(spark, close).toPandas()
    b["strategy_id"], b["strategy"], b["entry_signal"], b["exit_signal"], b["stop_loss"], b["take_profit"], b["max_bars"] = "s", "s", entry, leave, stop, profit, most
    return spark.createDataFrame(b)


def held(df):
    return [r["position"] for r in backtest.positions(df).orderBy("ts").collect()]


def test_position_limits(spark):
    close = [100, 100, 90, 100, 120, 120]
    always, never = [True] * 6, [False] * 6
    assert held(signalled(spark, close, always, never)) == [1] * 6
    assert held(signalled(spark, close, always, never, stop=0.05)) == [1, 1, 0, 1, 1, 1]
    assert held(signalled(spark, close, always, never, profit=0.1)) == [1, 1, 1, 1, 0, 1]
    assert held(signalled(spark, close, always, never, most=2)) == [1, 1, 0, 1, 1, 0]
    assert held(signalled(spark, close, [True] + [False] * 5, [False, False, True, False, False, False])) == [1, 1, 0, 0, 0, 0]


def test_returns_and_costs(spark):
    run = backtest.returns(backtest.positions(signalled(spark, [100, 110, 121, 121], [True] + [False] * 3, [False, False, True, False])), commission=0.01, slippage=0.0)
    assert [round(r["ret"], 6) for r in run.orderBy("ts").collect()] == [0.0, 0.1, 0.09, 0.0]


def test_templates_and_rules(spark, sf_dir):
    b = sources.bars_lineitem(spark, sf_dir)
    runs = backtest.metrics(backtest.backtest(b, [f() for f in strategy.TEMPLATES.values()]))
    assert runs.select("strategy_id").distinct().count() == 8
    assert runs.where("max_drawdown < 0 or win_rate > 1").count() == 0
    with pytest.raises(KeyError):
        strategy.signals(b, [strategy.Strategy("x", strategy._rules(("nothing", ">", 1.0)))])
    with pytest.raises(ValueError):
        strategy.Rule("close", "~", 1.0)
    s = strategy.template("rsi_mean_reversion")
    assert strategy.Strategy.from_json(s.to_json()) == s
    assert s.clone().fingerprint() == s.fingerprint() and s.clone().id != s.id
    assert s.with_parameters(rsi_period=7).entry.rules[0].indicator == "rsi_7"


def test_trade_statistics(spark):
    run = backtest.returns(backtest.positions(signalled(spark, [10, 12, 12, 9, 8, 8], [True, False, False, True, False, False], [False, False, True, False, True, False])))
    rows = backtest.trades(run)
    assert [round(r["pnl"], 6) for r in rows.orderBy("entry_ts").collect()] == [2.0, -1.0]
    stats = backtest.trade_statistics(rows).first()
    assert (stats["total_trades"], stats["winning_trades"], stats["profit_factor"], stats["max_consecutive_wins"]) == (2, 1, 2.0, 1)


def test_regimes(spark):
    rng = np.random.default_rng(45)
    close = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.01, 252)))
    close[200:] *= np.linspace(1, 0.5, 52)
    found = analysis.regimes(make(spark, close))
    assert found.orderBy(F.col("ts").desc()).first()["regime"] == "crisis"


def test_point_in_time(spark, sf_dir):
    revisions = sources.pit_orders(spark, sf_dir)
    one = revisions.orderBy("observation_date", "entity_id").first()
    day = one["observation_date"]
    for lag, want in ((29, None), (30, 0), (60, 1), (90, 2)):
        at = pd.Timestamp(day) + pd.Timedelta(days=lag)
        row = pit.pit_value(revisions.where((F.col("entity_id") == one["entity_id"]) & (F.col("observation_date") == F.lit(day))), str(at)).first()
        assert (row and row["revision_number"]) == want
    assert pit.bad_revisions(revisions).count() == 0
    with pytest.raises(ValueError):
        pit.insert(revisions, revisions.limit(1).withColumn("revision_number", F.lit(9)).withColumn("release_date", F.lit("1990-01-01").cast("timestamp")))
    b = sources.bars_lineitem(spark, sf_dir)
    last = pit.as_of(b, "1998-01-01", lookback=5).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("t"))
    assert {r["n"] for r in last.collect()} == {5} and last.where("t > '1998-01-01'").count() == 0


def test_quality(spark):
    b = make(spark, [10, 10, 30, 30, 30], high=[10.0, 9.0, 30.0, 30.0, 30.0], volume=[1.0, 1.0, 1.0, -5.0, 100.0])
    names = {r["check_name"] for r in quality.issues(b).collect()}
    assert {"ohlc_consistency", "price_sanity", "volume_sanity", "negative_values"} <= names
    assert "duplicate_timestamps" in {r["check_name"] for r in quality.issues(b.unionByName(b)).collect()}
    with pytest.raises(ValueError):
        quality.require_quality(b)
    assert quality.report(make(spark, [10, 10, 10])).first()["issues"] == 0


def test_lookahead_guard(spark):
    from tidemark.functions.core import by_symbol

    b = make(spark, range(1, 60))
    quality.require_causal(b, lambda d: d.withColumn("x", F.avg("close").over(by_symbol().rowsBetween(-4, 0))), "x")
    with pytest.raises(ValueError):
        quality.require_causal(b, lambda d: d.withColumn("x", F.avg("close").over(by_symbol().rowsBetween(-2, 2))), "x")
    with pytest.raises(ValueError):
        quality.require_causal(b, lambda d: d.withColumn("x", F.lead("close").over(by_symbol())), "x")
    assert quality.lookahead(b, lambda d: d.withColumn("x", F.lead("close").over(by_symbol())), "x", (10,)).count() == 2
    assert quality.leaking_canaries(lambda q: "Argentina won", "2022-01-01") == [quality.CANARIES[3][1]]
    with pytest.raises(ValueError):
        quality.require_text_feature(b, lambda d: d, quality.mock_model("2024-01-01"), "ts", "2020-01-01")
    texts = spark.createDataFrame([("2020-01-01", "abc"), ("2020-01-02", "a")], "ts string, t string")
    assert sorted(r["sentiment"] for r in quality.text_feature(texts, len, "t", "ts", "2021-01-01").collect()) == [1.0, 3.0]
    found = quality.text_events(spark.createDataFrame([("2020-01-01", "merger"), ("2020-01-02", None)], "ts string, t string"), lambda t: (t, 0.9), "t", "ts", "2021-01-01")
    assert {(r["event_type"], r["confidence"]) for r in found.collect()} == {("merger", 0.9), ("none", 0.0)}


def test_deflated_sharpe():
    assert validation.expected_max_sharpe(1) == 0
    assert validation.deflated_sharpe(2.0, 1, 252) > validation.deflated_sharpe(2.0, 1000, 252)
    assert validation.minimum_track_record(0) == math.inf
    assert validation.quick_expected_max_sharpe(100) == pytest.approx(math.sqrt(2 * math.log(100)))


def test_cpcv_matches_direct(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"strategy_id": "s", "symbol": "X", "ts": pd.date_range("2020-01-01", periods=100), "ret": rng.normal(0, 0.01, 100)})
    found = validation.cpcv(spark.createDataFrame(frame), n=6, k=3)
    assert found.count() == math.comb(6, 3)
    chunks = np.array_split(frame.ret.to_numpy(), 6)
    for r in found.collect():
        x = np.concatenate([c for i, c in enumerate(chunks) if r["mask"] >> i & 1])
        assert r["sharpe"] == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252), rel=1e-6)


def test_cpcv_exact_purges(spark):
    b = make(spark, range(1, 101))
    found = validation.cpcv_exact(b, lambda train, test: float(len(train)), n=4, k=1, most=10)
    assert sorted(r["sharpe"] for r in found.collect()) == [73.0, 73.0, 74.0, 74.0]


def test_pbo_extremes(spark):
    rows = [(c, f"s{s}", float(s), float(s)) for c in range(10) for s in range(5)]
    same = spark.createDataFrame(rows, "combo_id int, strategy_id string, in_sample double, out_sample double")
    assert validation.pbo(same).first()["pbo"] == 0 and validation.pbo(same).first()["rank_correlation"] == pytest.approx(1.0)
    assert validation.pbo(same.withColumn("out_sample", -F.col("out_sample"))).first()["pbo"] == 1
    p = validation.probability_of_loss(spark.createDataFrame([(1.0,), (-0.5,), (0.8,), (-0.2,)], "sharpe double")).first()
    assert p["probability"] == 0.5 and p["logit"] == pytest.approx(0.0)


def test_spa(spark):
    rng = np.random.default_rng(1)
    days = pd.date_range("2020-01-01", periods=250)
    noise = rng.normal(0, 0.01, 250)
    frame = pd.concat([pd.DataFrame({"name": n, "ts": days, "strategy": noise + d, "benchmark": 0.0}) for n, d in (("good", 0.004), ("bad", -0.004))])
    found = {r["name"]: r["p_value"] for r in validation.spa(spark.createDataFrame(frame), reps=200).collect()}
    assert found["good"] < 0.05 < found["bad"]


def test_stress_and_walk_forward(spark, sf_dir):
    b = sources.bars_lineitem(spark, sf_dir)
    found = validation.stress(b, [strategy.buy_and_hold()], [*validation.SYNTHETIC, validation.Scenario("then", start="1996-01-01", end="1997-01-01")])
    assert {r["scenario"] for r in found.select("scenario").collect()} == {"volatility_3x", "gap_risk", "correlation_spike", "then"}
    halved = validation.Scenario("halved", "own", transform=lambda rows: rows.withColumn("close", F.col("close") / 2))
    same, own = (validation.stress(b, [strategy.buy_and_hold()], [s]).orderBy("symbol").collect() for s in (validation.Scenario("all", start="1990-01-01", end="2010-01-01"), halved))
    assert [r["sharpe_ratio"] for r in own] == pytest.approx([r["sharpe_ratio"] for r in same])
    forward = validation.walk_forward(backtest.backtest(b, [strategy.sma_crossover(), strategy.buy_and_hold()]), 100, 50)
    assert forward.count() > 0 and forward.where("degradation is null").count() == 0


def test_pareto(spark):
    rows = [(1, 1.0, 5.0), (2, 2.0, 4.0), (3, 1.0, 4.0), (4, 2.0, 4.0), (5, 0.0, 0.0)]
    front = search.pareto_front(spark.createDataFrame(rows, "id int, a double, b double"), ["a", "b"])
    assert sorted(r["id"] for r in front.collect()) == [1, 2, 4]
    rng = np.random.default_rng(3)
    many = [(i, float(a), float(-a + rng.integers(0, 3)), float(rng.integers(0, 4))) for i, a in enumerate(rng.integers(0, 60, 400))]
    df = spark.createDataFrame(many, "id int, a double, b double, c double").repartition(4)
    want = sorted(r[0] for r, out in zip(many, search._beaten(np.array(many)[:, 1:]), strict=True) if not out)
    for most in (20_000, 25):
        assert sorted(r["id"] for r in search.pareto_front(df, ["a", "b", "c"], most_broadcast=most).collect()) == want
    x = np.array([[r[1], r[2]] for r in rows])
    assert search.pareto_ranks(x).tolist() == [0, 0, 1, 0, 2]


def test_discovery_is_reproducible(spark, sf_dir):
    b = sources.bars_lineitem(spark, sf_dir).where("symbol = 'NO'")
    a, c = (search.discover(b, size=4, generations=1, seed=7) for _ in range(2))
    assert [str(t) for t in a.population] == [str(t) for t in c.population] and len(a.history) == 2
    seen = []
    own = search.discover(b, size=4, generations=0, seed=7, own={"busy": lambda f: seen.append(f["trades"]) or f["trades"]})
    assert seen and own.pbo(spark).first()["combinations"] == 1 and len(own.strategies()) == len(own.zoo)


@pytest.mark.parametrize("sampler", ["tpe", "random", "grid"])
def test_samplers(spark, sf_dir, sampler):
    b = sources.bars_lineitem(spark, sf_dir).where("symbol = 'NO'")
    space = [search.Parameter("fast_period", 5, 15, 5, whole=True), search.Parameter("slow_period", 20, 40, whole=True)]
    found = search.optimise(b, strategy.sma_crossover, space, trials=4, batch=2, sampler=sampler)
    assert len(found) == 4 and [v for _, v in found] == sorted((v for _, v in found), reverse=True)
    assert all(5 <= p["fast_period"] <= 15 and 20 <= p["slow_period"] <= 40 for p, _ in found)


def test_proposals_follow_what_was_good():
    import random

    space = [search.Parameter("x", 0.0, 10.0), search.Parameter("k", choices=("a", "b"))]
    rng = random.Random(1)
    done = [(p, -abs(p["x"] - 7) - (p["k"] == "a")) for p in search.random_points(space, 60, 2)]
    drawn = [search._proposed(space, done, rng) for _ in range(40)]
    assert abs(np.mean([p["x"] for p in drawn]) - 7) < 1.5 and sum(p["k"] == "b" for p in drawn) > 30


def test_evolution_of_templates(spark, sf_dir):
    b = sources.bars_lineitem(spark, sf_dir).where("symbol = 'NO'")
    templates = {"sma": (strategy.sma_crossover, [search.Parameter("fast_period", 5, 20, whole=True)]), "rsi": (strategy.rsi_mean_reversion, [search.Parameter("oversold", 10.0, 40.0)])}
    found = search.evolve(b, templates, size=4, generations=1)
    assert [v for _, v in found] == sorted((v for _, v in found), reverse=True) and len({s.id for s, _ in found}) == len(found)


def test_expanding_rank_counts():
    from tidemark.functions.recursive import _before, _expanding_rank

    x = np.random.default_rng(4).integers(0, 40, 1500).astype(float)
    below, same = _before(x, 64)
    assert all(below[i] == (x[:i] < x[i]).sum() and same[i] == (x[:i] == x[i]).sum() for i in range(0, 1500, 37))
    assert _expanding_rank(pd.Series([3.0, None, 1.0, 2.0]), 2).fillna(-1).tolist() == [-1, -1, 0.0, 0.5]


def test_shell(spark, sf_dir, capsys):
    from tidemark import __main__ as shell

    shell.main(["templates"])
    shell.main(["backtest", sf_dir, "--tables", "--symbols", "NO", "--template", "buy_and_hold"])
    shell.main(["query", "bars_daily", sf_dir])
    said = capsys.readouterr().out
    assert "sma_crossover" in said and "sharpe_ratio" in said and "symbol" in said


def test_parameters():
    p = search.Parameter("n", 5, 15, 5, whole=True)
    assert p.grid() == [5, 10, 15]
    assert len(search.grid_points([p, search.Parameter("k", choices=("a", "b"))])) == 6
    with pytest.raises(ValueError):
        search.grid_points([p, p])
    made = search.factory({"sma": (strategy.sma_crossover, [search.Parameter("fast_period", 5, 20, whole=True)])}, 5)
    assert len({s.fingerprint() for s in made}) == len(made) == 5


def test_impact(spark):
    row = spark.range(1).select(execution.impact(F.lit(1e5), F.lit(5e7), F.lit(0.01)).alias("x"), execution.impact(F.lit(1e5), F.lit(0.0), F.lit(0.01)).alias("y")).first()
    assert 0 < row["x"] < 0.001 and row["y"] is None
    with pytest.raises(ValueError):
        execution.impact(F.lit(1.0), F.lit(1.0), F.lit(1.0), hours=0)


def test_event_driven_is_seeded(spark):
    s = signalled(spark, range(100, 140), [True] * 40, [False] * 40)
    a, c = (backtest.event_driven(s).orderBy("ts").collect() for _ in range(2))
    assert a == c and a[-1]["quantity"] > 0


def test_stores(spark, tmp_path):
    b = make(spark, range(1, 11)).unionByName(make(spark, range(1, 6), symbol="Y"))
    store.write_bars(b, f"{tmp_path}/bars")
    assert store.read_bars(spark, f"{tmp_path}/bars", ["Y"], "2020-01-02", "2020-01-03").count() == 2
    with pytest.raises(ValueError):
        store.read_bars(spark, f"{tmp_path}/bars", ["Z"])
    store.write_features(b, f"{tmp_path}/features")
    assert store.read_features(spark, f"{tmp_path}/features", "X").count() == 10 and store.read_features(spark, f"{tmp_path}/none", "X") is None
    for status in ("pending", "done"):
        store.append(spark, f"{tmp_path}/log", "validation", "a", status, {"passed": True, "x": float("nan")})
    log = spark.read.parquet(f"{tmp_path}/log")
    assert store.get(log, "validation", "a").first()["status"] == "done" and store.counters(log).first()["passed"] == 1


def test_service(spark, sf_dir, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from tidemark.service import Service

    service = Service(spark, sources.bars_lineitem(spark, sf_dir), f"{tmp_path}/log")
    server = service.server()
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data)) as answer:
                return answer.status, json.loads(answer.read())
        except urllib.error.HTTPError as e:
            return e.code, None

    try:
        assert call("/")[1]["status"] == "running" and len(call("/api/templates")[1]) == 8 and call("/api/strategies") == (200, [])
        assert call("/api/validate/none")[0] == call("/nothing")[0] == 404 and call("/api/validate", {"template_name": "x"})[0] == 400
        started = [call("/api/validate", {"symbol": "NO", "template_name": "buy_and_hold", "run_cpcv": False}), call("/api/factory", {"symbol": "NO", "population_size": 3, "generations": 0}), call("/api/discovery", {"symbol": "NO", "population_size": 3, "n_generations": 0}), call("/api/validate", {"symbol": "none"})]
        assert all(s == 200 and r["status"] == "pending" for s, r in started)
        for job in service.jobs:
            job.join()
        first, made, found, bad = (r for _, r in started)
        done = call(f"/api/validate/{first['validation_id']}")[1]
        assert done["status"] == "done" and done["metrics"][0]["trading_days"] > 0
        assert len(call(f"/api/factory/{made['factory_id']}")[1]["strategies"]) == 3 and call(f"/api/discovery/{found['discovery_id']}")[1]["history"]
        assert [s["name"] for s in call("/api/strategies")[1] if s["id"] == first["validation_id"]] == ["buy_and_hold"]
        assert call("/api/pipeline-stats")[1]["generated"] == 1 and call("/api/metrics/latest")[1]["validations"] >= 1 and call("/api/system/status")[1]["running"] == 0
    finally:
        server.shutdown()


def test_pace():
    now, slept = [0.0], []
    pace = store.Pace(30, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        pace.wait()
    now[0] += 10
    pace.wait()
    assert slept == [2.0, 2.0]


def test_monitor_batch_equals_stream(spark, tmp_path):
    rng = np.random.default_rng(5)
    rets = np.concatenate([rng.normal(0.002, 0.01, 100), rng.normal(-0.01, 0.01, 100)])
    frame = pd.DataFrame({"key": "k", "ts": pd.date_range("2020-01-01", periods=200), "ret": rets})
    rows = spark.createDataFrame(frame)
    batch = cusum.monitor(rows, 1.0).orderBy("ts").toPandas()
    assert {"alarm", "normal"} <= set(batch.level) and cusum.alerts(spark.createDataFrame(batch.drop(columns="message"))).count() > 0
    for n, part in enumerate((frame[:70], frame[70:])):
        spark.createDataFrame(part).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = cusum.monitor_stream(stream, 1.0).writeStream.format("memory").queryName("cusum_out").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    streamed = spark.table("cusum_out").orderBy("ts").toPandas()
    np.testing.assert_allclose(streamed.statistic, batch.statistic)
    assert streamed.level.tolist() == batch.level.tolist()


def test_queries_have_sql(spark):
    from tidemark import registry

    assert set(registry.queries()) - set(registry.oracle_sql()) == {"discovery", "validation_pipeline"} and set(registry.oracle_sql()) <= set(registry.queries())
