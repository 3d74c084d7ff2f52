"""SQL for runs of strategies with limits: the fold over a strategy's bars is a recursive query, one step a bar."""

from __future__ import annotations

from tidemark.oracle import BARS, EACH, RET, SO_FAR, TIME, div, ewm, full, lag, last, r

#: What the rules of the templates name.
INDICATORS = f"""b0 AS (SELECT *, {full("avg", "close", 20)} AS sma_20, {full("avg", "close", 50)} AS sma_50, ({full("avg", "close", 20)}) + 2 * ({full("stddev_samp", "close", 20)}) AS bb_upper, {RET} AS returns_1d,
    {div("close", lag("close", 20))} - 1 AS returns_20d, 100 * ({div("close", lag("close", 10))} - 1) AS momentum_10, 100 * ({div("close", lag("close", 20))} - 1) AS momentum_20, {div("volume", full("avg", "volume", 20))} AS volume_ratio,
    greatest(coalesce(close - pc, 0), 0) AS gain, -least(coalesce(close - pc, 0), 0) AS loss FROM n),
b1 AS (SELECT *, {ewm("gain", 14)} AS up, {ewm("loss", 14)} AS dn, CASE WHEN i >= 25 THEN {ewm("close", 12)} - {ewm("close", 26)} END AS macd FROM b0),
b2 AS (SELECT *, CASE WHEN i < 13 THEN NULL WHEN dn = 0 THEN CASE WHEN up > 0 THEN 100 END ELSE 100 - 100 / (1 + up / nullif(dn, 0)) END AS rsi_14, CASE WHEN i >= 33 THEN {ewm("macd", 9, "(i - 25)")} END AS macd_signal FROM b1),
ind AS (SELECT *, lag(sma_20) OVER w AS sma_20_b, lag(sma_50) OVER w AS sma_50_b, lag(macd) OVER w AS macd_b, lag(macd_signal) OVER w AS macd_signal_b FROM b2 WINDOW w AS ({EACH}))"""

#: name: entry, exit, stop loss, most bars.
RULES = {
    "sma_crossover": ("sma_20_b <= sma_50_b AND sma_20 > sma_50", "sma_20_b >= sma_50_b AND sma_20 < sma_50", 0.02, 0),
    "rsi_mean_reversion": ("rsi_14 < 30", "rsi_14 > 70", 0.03, 0),
    "bollinger_breakout": ("close > bb_upper", "close < sma_20", 0.02, 0),
    "momentum_rotation": ("momentum_20 > 0", "momentum_20 < 0", 0.05, 5),
    "macd_crossover": ("macd_b <= macd_signal_b AND macd > macd_signal", "macd_b >= macd_signal_b AND macd < macd_signal", 0.02, 0),
    "volatility_breakout": ("coalesce(returns_1d > 0.02, false) AND coalesce(volume_ratio > 1.5, false)", "returns_1d < -0.01", 0.03, 0),
    "dual_momentum": ("coalesce(returns_20d > 0, false) AND coalesce(momentum_10 > 0, false)", "coalesce(returns_20d < 0, false) OR coalesce(momentum_10 < 0, false)", 0.1, 0),
    "buy_and_hold": ("close >= 0", "false", 0.0, 0),
}


def tracked(rules: dict[str, tuple[str, str, float, int]], indicators: str = INDICATORS, source: str = "ind") -> str:
    """CTEs sig (signals in long form) and track (position and reason of exit), for symbols named `strategy|symbol`."""
    each = " UNION ALL ".join(
        f"SELECT '{name}|' || symbol AS symbol, ts, i, close, pc, coalesce({entry}, false) AS entry, coalesce({leave}, false) AS leave, {stop!r}::DOUBLE AS stop, {most} AS most FROM {source}" for name, (entry, leave, stop, most) in rules.items()
    )
    why = """CASE WHEN t.held THEN CASE WHEN s.stop > 0 AND s.close / nullif(t.paid, 0) - 1 <= -s.stop THEN 'stop_loss' WHEN s.most > 0 AND s.i - t.since >= s.most THEN 'max_bars' WHEN s.leave THEN 'signal' END END"""
    return f"""{indicators}, sig AS MATERIALIZED ({each}),
fold AS (SELECT symbol, i, entry AS held, i AS since, close AS paid, CAST(NULL AS VARCHAR) AS reason FROM sig WHERE i = 0
    UNION ALL SELECT symbol, i, CASE WHEN was THEN reason IS NULL ELSE entry END AS held, CASE WHEN was THEN since ELSE i END AS since, CASE WHEN was THEN paid ELSE close END AS paid, reason
    FROM (SELECT s.symbol, s.i, s.entry, s.close, t.held AS was, t.since, t.paid, {why} AS reason FROM fold t JOIN sig s ON s.symbol = t.symbol AND s.i = t.i + 1)),
track AS (SELECT sig.*, CAST(held AS INTEGER) AS position, reason FROM sig JOIN fold USING (symbol, i))"""


RUN = f"""h AS (SELECT *, lag(position) OVER ({EACH}) AS before FROM track),
run0 AS (SELECT *, CAST(coalesce(before, 0) AS DOUBLE) AS held, coalesce(before * ({RET}), 0.0) - coalesce(abs(position - before), 0) * 0.0015 AS ret FROM h),
run1 AS (SELECT *, 100000.0 * product(1 + ret) OVER {SO_FAR} AS equity FROM run0),
run2 AS (SELECT *, (equity - max(equity) OVER {SO_FAR}) / max(equity) OVER {SO_FAR} AS drawdown FROM run1),
run AS (SELECT *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER {SO_FAR} AS run_id FROM run2)"""
NAMES = "split_part(symbol, '|', 1) AS strategy_id, split_part(symbol, '|', 2) AS symbol"


def with_track(rules: dict, select: str, bars: str = BARS, indicators: str = INDICATORS) -> str:
    return f"WITH RECURSIVE {bars}, {tracked(rules, indicators)} {select}"


def _zero(x: str) -> str:
    return f"coalesce({x}, 0)"


def figures(select: str) -> str:
    """CTEs after RUN that end in j, the raw figures of each symbol, and a select from it."""
    return f"""longest AS (SELECT symbol, max(c) AS d FROM (SELECT symbol, run_id, count(*) AS c FROM run WHERE drawdown < 0 GROUP BY ALL) GROUP BY symbol),
st AS (SELECT *, CASE WHEN held > coalesce(lag(held) OVER ({EACH}), 0) THEN 1 END AS started, sum(CASE WHEN held = 0 THEN 1 ELSE 0 END) OVER {SO_FAR} AS trade FROM run),
base AS (SELECT symbol, count(ret) AS days, product(1 + ret) - 1 AS total, avg(ret) AS m, stddev_samp(ret) AS s, stddev_samp(ret) FILTER (ret < 0) AS down, abs(min(drawdown)) AS dd, quantile_cont(ret, 0.05) AS p5,
    (avg(ret*ret*ret) - 3 * avg(ret) * avg(ret*ret) + 2 * pow(avg(ret), 3)) / nullif(pow(avg(ret*ret) - pow(avg(ret), 2), 1.5), 0) AS g, kurtosis_pop(ret) AS k, count(started) AS trades FROM st GROUP BY symbol),
tail AS (SELECT run.symbol, abs(avg(ret)) AS t FROM run JOIN base ON run.symbol = base.symbol WHERE ret <= -abs(p5) GROUP BY run.symbol),
tr AS (SELECT symbol, trade, product(1 + ret) - 1 AS ret FROM st WHERE held <> 0 GROUP BY ALL),
ts AS (SELECT symbol, avg(CAST(ret > 0 AS INT)) AS wr, sum(ret) FILTER (ret > 0) AS gained, abs(sum(ret) FILTER (ret <= 0)) AS lost, avg(ret) FILTER (ret > 0) AS aw, avg(ret) FILTER (ret < 0) AS al FROM tr GROUP BY symbol),
j AS (SELECT base.*, longest.d, tail.t, wr, gained, lost, aw, al, days / 252 AS years, pow(1 + total, 252 / days) - 1 AS annual FROM base LEFT JOIN longest USING (symbol) LEFT JOIN tail USING (symbol) LEFT JOIN ts USING (symbol))
{select}"""


SHARPE = _zero("m / nullif(s, 0) * sqrt(252)")
FIGURES = f"""{r("total", "total_return")}, {r("annual", "annualized_return")}, {r(_zero("s * sqrt(252)"), "volatility")}, {r(SHARPE, "sharpe_ratio")},
    {r(_zero("annual / nullif(down * sqrt(252), 0)"), "sortino_ratio")}, {r(_zero("annual / nullif(dd, 0)"), "calmar_ratio")}, {r(_zero("dd"), "max_drawdown")}, coalesce(d, 0) AS max_drawdown_duration, {r("abs(p5)", "var_95")},
    {r("CASE WHEN p5 = 0 THEN 0 ELSE coalesce(t, 0) END", "cvar_95")}, {r(_zero("g"), "skewness")}, {r(_zero("CASE WHEN s > 0 THEN k END"), "kurtosis")}, trades AS num_trades, {r(_zero("wr"), "win_rate")},
    {r("CASE WHEN coalesce(lost, 0) > 0 THEN coalesce(gained, 0) / lost WHEN coalesce(gained, 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END", "profit_factor")}, {r(_zero("aw"), "avg_win")}, {r(_zero("al"), "avg_loss")},
    days AS trading_days, {r("years", "years")}"""

#: P(Z <= z) for a standard normal Z: Simpson's rule near 0, Laplace's continued fraction in the tails.
_PHI = "exp(-{z} * {z} / 2) / sqrt(2 * pi())"
NORMAL = (
    "CASE WHEN abs({z}) > 4 THEN CASE WHEN {z} < 0 THEN {tail} ELSE 1 - {tail} END ELSE 0.5 + {z} / 600 * list_sum(list_transform(range(0, 601), lambda q: CASE WHEN q IN (0, 600) THEN 1 WHEN q % 2 = 1 THEN 4 ELSE 2 END * {phi}))  / 3 END"
)


def normal(z: str) -> str:
    tail = f"({_PHI.format(z=f'({z})')} / list_reduce(list_prepend(80.0::DOUBLE, list_transform(range(80, -1, -1), lambda q: CAST(q AS DOUBLE))), lambda f, q: CASE WHEN q = 80 THEN abs({z}) ELSE abs({z}) + (q + 1) / f END))"
    return NORMAL.format(z=f"({z})", tail=tail, phi=_PHI.format(z=f"(({z}) * q / 600)"))


#: Bars of mean prices.
SMOOTH = BARS.replace("bars AS (", "raw AS (").replace("\nn AS (", f"""
bars AS (SELECT symbol, ts, {", ".join(f"avg({c}) OVER {last(60)} AS {c}" for c in ("open", "high", "low", "close"))}, volume FROM raw),
n AS (""")


def _stressed(bars: str = SMOOTH) -> str:
    """Bars of the six scenarios, whose symbols are `symbol|scenario`."""
    periods = {"2008_financial_crisis": ("2008-09-01", "2008-12-31"), "2020_covid_crash": ("2020-02-19", "2020-03-23"), "2022_rate_hikes": ("2022-01-01", "2022-10-31")}
    chance = lambda seed: f"CAST(CAST('0x' || substr(md5(symbol || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|{seed}'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
    new = {
        "volatility_3x": "avg(q) OVER (PARTITION BY symbol) + 3 * (q - avg(q) OVER (PARTITION BY symbol))",
        "correlation_spike": f"avg(q) OVER {last(3)}",
        "gap_risk": f"(1 + q) * (1 + CASE WHEN {chance(42)} < 0.1 THEN CASE WHEN {chance(43)} < 0.5 THEN -0.05 ELSE 0.05 END ELSE 0.0 END) - 1",
    }
    made = "".join(f""", {k}_0 AS (SELECT *, greatest({x}, -0.95) AS nr FROM moves), {k}_1 AS (SELECT symbol, ts, volume, first_value(close) OVER {SO_FAR} * exp(greatest(-600.0, least(600.0, sum(ln(1 + nr)) OVER {SO_FAR}))) AS close FROM {k}_0),
    {k} AS (SELECT symbol || '|{k}' AS symbol, ts, coalesce(lag(close) OVER ({EACH}), close) AS open, close * 1.01 AS high, close * 0.99 AS low, close, volume FROM {k}_1)""" for k, x in new.items())  # fmt: skip
    past = " UNION ALL ".join(f"SELECT symbol || '|{k}' AS symbol, ts, open, high, low, close, volume FROM bars WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}' + INTERVAL 1 DAY" for k, (a, b) in periods.items())
    every = " UNION ALL ".join(f"SELECT * FROM {k}" for k in new)
    plain, numbered = bars.split("\nn AS (")
    return f"{plain} moves AS (SELECT *, coalesce({div('close', lag('close'))} - 1, 0.0) AS q FROM bars){made}, scenarios AS ({past} UNION ALL {every}),\nn AS (" + numbered.replace("FROM bars", "FROM scenarios")


STRESS_NAMES = "split_part(symbol, '|', 1) AS strategy_id, split_part(symbol, '|', 2) AS symbol, split_part(symbol, '|', 3) AS scenario"


def statements() -> dict[str, str]:
    from tidemark.oracle import from_run

    out = {"positions_with_limits": with_track(RULES, f"SELECT {NAMES}, {TIME}, position, reason AS exit_reason FROM track")}
    run = f", {RUN}, "
    out["templates_metrics"] = with_track(RULES, run + figures(f"SELECT {NAMES}, {FIGURES} FROM j"))
    stressed = f"SELECT {STRESS_NAMES}, {r(SHARPE, 'sharpe_ratio')}, {r(_zero('dd'), 'max_drawdown')}, {SHARPE} >= 0.0 AND coalesce(dd, 0) <= 0.5 AS passed FROM j"
    out["stress"] = with_track(RULES, run + figures(stressed), _stressed())
    out["walk_forward"] = with_track(
        RULES,
        run + f"""w0 AS (SELECT symbol, i, ret, count(*) OVER (PARTITION BY symbol) AS n_all FROM run), w1 AS (SELECT *, unnest(range(0, CAST(floor((n_all - 252) / 63) AS BIGINT))) AS period FROM w0 WHERE n_all >= 315),
        w2 AS (SELECT symbol, period, CASE WHEN i >= period * 63 AND i < period * 63 + 252 THEN 'in' WHEN i >= period * 63 + 252 AND i < period * 63 + 315 THEN 'out' END AS segment, ret FROM w1),
        w3 AS (SELECT symbol, period, segment, {_zero("avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252)")} AS sharpe FROM w2 WHERE segment IS NOT NULL GROUP BY ALL),
        w4 AS (SELECT split_part(symbol, '|', 1) AS strategy_id, split_part(symbol, '|', 2) AS symbol, period, max(sharpe) FILTER (segment = 'in') AS a, max(sharpe) FILTER (segment = 'out') AS b FROM w3 GROUP BY ALL)
        SELECT symbol, CAST(period AS INTEGER) AS period, strategy_id, {r("a", "in_sharpe")}, {r("b", "out_sharpe")}, {r("a - b", "degradation")} FROM w4 QUALIFY row_number() OVER (PARTITION BY symbol, period ORDER BY a DESC, strategy_id DESC) = 1""",
    )
    out["walk_forward_summary"] = f"""SELECT symbol, count(*) AS periods, {r("avg(in_sharpe)", "in_sharpe")}, {r("avg(out_sharpe)", "out_sharpe")}, {r("avg(degradation)", "degradation")}, {r("avg(out_sharpe) / nullif(avg(in_sharpe), 0)", "efficiency")}
        FROM ({out["walk_forward"]}) GROUP BY symbol"""
    sweep = {f"point-{n}": (f"f{a}_b <= s{b}_b AND f{a} > s{b}", f"f{a}_b >= s{b}_b AND f{a} < s{b}", 0.02, 0) for n, (a, b) in enumerate([(a, b) for a in (5, 10, 15) for b in (30, 50)])}
    means = [("f", 5), ("f", 10), ("f", 15), ("s", 30), ("s", 50)]
    columns = f"c0 AS (SELECT *, {', '.join(f'{full("avg", "close", k)} AS {x}{k}' for x, k in means)} FROM n), ind AS (SELECT *, {', '.join(f'lag({x}{k}) OVER w AS {x}{k}_b' for x, k in means)} FROM c0 WINDOW w AS ({EACH}))"
    out["parameter_sweep"] = with_track(sweep, run + figures(f"SELECT {NAMES}, {r(SHARPE, 'sharpe_ratio')}, {r('total', 'total_return')}, {r(_zero('dd'), 'max_drawdown')} FROM j"), indicators=columns)
    out["detailed_backtest"] = with_track(
        RULES,
        f""", cash AS (SELECT symbol, i, CASE WHEN position = 1 THEN 100000.0::DOUBLE - 10000.0 * 1.001 ELSE 100000.0::DOUBLE END AS cash, CASE WHEN position = 1 THEN 10000.0 / (close * 1.0005) ELSE 0.0::DOUBLE END AS shares FROM track WHERE i = 0
            UNION ALL SELECT t.symbol, t.i, CASE WHEN t.position = 1 AND c.shares = 0 THEN c.cash - least(0.1 * c.cash, c.cash / 1.001) * 1.001 WHEN t.position = 0 AND c.shares <> 0 THEN c.cash + c.shares * t.close * 0.9995 * 0.999 ELSE c.cash END,
                CASE WHEN t.position = 1 AND c.shares = 0 THEN least(0.1 * c.cash, c.cash / 1.001) / (t.close * 1.0005) WHEN t.position = 0 THEN 0.0 ELSE c.shares END FROM cash c JOIN track t ON t.symbol = c.symbol AND t.i = c.i + 1),
        worth AS (SELECT track.symbol, ts, close, cash, shares, cash + shares * close AS value FROM track JOIN cash USING (symbol, i))
        SELECT {NAMES}, {TIME}, {r("close", "close")}, {r("cash", "cash")}, {r("shares", "shares")}, {r("value", "value")}, {r(f"value / coalesce(lag(value) OVER ({EACH}), 100000.0) - 1", "ret")} FROM worth""",
    )
    moments = f"""m0 AS (SELECT {{key}}, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s, (avg(ret*ret*ret) - 3 * avg(ret) * avg(ret*ret) + 2 * pow(avg(ret), 3)) / nullif(pow(avg(ret*ret) - pow(avg(ret), 2), 1.5), 0) AS g, kurtosis_pop(ret) AS k FROM run GROUP BY ALL),
        m1 AS (SELECT *, {SHARPE} AS sharpe, coalesce(g, 0) AS g0, coalesce(CASE WHEN s > 0 THEN k END, 0) AS k0 FROM m0),
        m2 AS (SELECT *, (sharpe - {{best}}) / sqrt(greatest(1 + sharpe * sharpe / 2 - g0 * sharpe + k0 / 4 * sharpe * sharpe, 0.01) / n) AS z FROM m1 WHERE n >= 2), deflated AS (SELECT *, {normal("z")} AS dsr FROM m2)"""

    def best_of(trials: int) -> float:
        """Expected maximum of so many standard normal values, by the two quantiles of the published formula."""
        from math import e
        from statistics import NormalDist

        q = NormalDist().inv_cdf
        return (1 - 0.5772156649015329) * q(1 - 1 / trials) + 0.5772156649015329 * q(1 - 1 / (trials * e))

    out["deflated_sharpe"] = from_run(f", {moments.format(key='strategy_id, symbol', best=best_of(10))} SELECT strategy_id, symbol, n, {r('sharpe', 'sharpe_ratio')}, {r('dsr', 'dsr')} FROM deflated").replace("FROM run2) ,", "FROM run2),")
    folds = """f AS (SELECT *, ntile(16) OVER (PARTITION BY symbol ORDER BY ts) AS fold FROM run), g AS (SELECT symbol, fold, count(ret) AS c, sum(ret) AS s, sum(ret * ret) AS q FROM f GROUP BY ALL),
        masks AS (SELECT CAST(range AS INTEGER) AS mask FROM range(65536) WHERE bit_count(CAST(range AS INTEGER)) = 8), z AS (SELECT symbol, mask, sum(c) AS c, sum(s) AS s, sum(q) AS q FROM g JOIN masks ON (mask >> CAST(fold - 1 AS INTEGER)) & 1 = 1 GROUP BY ALL),
        y AS (SELECT *, (q - s * s / c) / (c - 1) AS v FROM z), ratios AS (SELECT symbol, coalesce(s / c / CASE WHEN v > 1e-18 THEN sqrt(v) END * sqrt(252), 0) AS sharpe FROM y),
        choices AS (SELECT symbol, avg(sharpe) AS mean_sharpe, avg(CAST(sharpe < 0 AS INT)) AS loss FROM ratios GROUP BY symbol)"""
    passes = f"""rates AS (SELECT strategy_id || '|' || symbol AS symbol, avg(CAST(passed AS INT)) AS rate FROM ({out["stress"]}) GROUP BY ALL)"""
    out["validation_gates"] = with_track(
        RULES,
        run + f"""{moments.format(key="symbol", best=best_of(8))}, {folds}, {passes},
        v AS (SELECT deflated.*, mean_sharpe, loss, rate FROM deflated LEFT JOIN choices USING (symbol) LEFT JOIN rates USING (symbol))
        SELECT {NAMES}, n, {r("sharpe", "sharpe_ratio")}, {r("dsr", "dsr")}, {r("mean_sharpe", "mean_sharpe")}, {r("loss", "probability_of_loss")}, {r("rate", "pass_rate")}, rate >= 0.8 AS stress_passed,
            coalesce(dsr >= 0.95 AND sharpe >= 1.0 AND loss <= 0.05 AND rate >= 0.8, false) AS passed, coalesce(dsr >= 0.98 AND sharpe >= 1.5 AND loss <= 0.02, false) AS auto_accept FROM v""",
        SMOOTH,
    )
    # event-driven: cash, quantity and the open orders [due, left] are the state of one bar
    u = lambda k: f"CAST(CAST('0x' || substr(md5('42|' || symbol || '|' || i || '|' || o.due || '|{k}'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
    size = f"sign(o.remaining) * least(abs(o.remaining), greatest(volume * 0.01 * (0.1 + 0.9 * ({u(2)})), 1.0))"
    filled = f"list_transform(orders, lambda o: CASE WHEN o.due > i OR ({u(0)}) > 0.95 * (1 - ({u(1)}) / 2) THEN 0.0::DOUBLE ELSE CAST({size} AS DOUBLE) END)"
    price = "close * (1 + sign(f) * 0.1 * abs(f) * close / 1e6::DOUBLE)"
    event = f"""sig2 AS MATERIALIZED (SELECT sig.*, n.volume FROM sig JOIN n ON split_part(sig.symbol, '|', 2) = n.symbol AND sig.i = n.i),
        ev AS (SELECT symbol, CAST(-1 AS BIGINT) AS i, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS quantity, CAST([] AS STRUCT(due BIGINT, remaining DOUBLE)[]) AS orders, 0.0::DOUBLE AS filled, CAST(NULL AS DOUBLE) AS paid FROM sig WHERE i = 0
            UNION ALL SELECT symbol, i, cash - coalesce(list_sum(list_transform(fills, lambda f: f * ({price}))), 0), CASE WHEN abs(quantity + coalesce(list_sum(fills), 0)) >= 1e-9 THEN quantity + coalesce(list_sum(fills), 0) ELSE 0.0::DOUBLE END,
                list_filter(list_transform(orders, lambda o, j: struct_pack(due := o.due, remaining := o.remaining - fills[j])), lambda o: abs(o.remaining) >= 1e-9), coalesce(list_sum(fills), 0),
                list_last(list_transform(list_filter(fills, lambda f: f <> 0), lambda f: {price}))
            FROM (SELECT *, {filled} AS fills FROM (SELECT symbol, i, close, volume, cash, quantity,
                CASE WHEN entry AND quantity + waiting < 1e-9 THEN list_append(orders, struct_pack(due := i + 1, remaining := 100.0::DOUBLE)) WHEN leave AND quantity + waiting >= 1e-9 THEN list_append(orders, struct_pack(due := i + 1, remaining := -(quantity + waiting))) ELSE orders END AS orders
                FROM (SELECT s.*, e.cash, e.quantity, e.orders, coalesce(list_sum(list_transform(e.orders, lambda o: o.remaining)), 0) AS waiting FROM ev e JOIN sig2 s ON s.symbol = e.symbol AND s.i = e.i + 1)))),
        events_ AS (SELECT ev.symbol, sig2.ts, ev.i, sig2.close, ev.quantity, filled, paid, cash + ev.quantity * sig2.close AS value FROM ev JOIN sig2 USING (symbol, i)),
        events_run AS (SELECT *, value / coalesce(lag(value) OVER ({EACH}), 100000.0) - 1 AS ret FROM events_)"""
    out["event_driven"] = with_track(RULES, f", {event} SELECT {NAMES}, {TIME}, {r('close', 'close')}, {r('quantity', 'quantity')}, {r('filled', 'filled')}, {r('paid', 'fill_price')}, {r('value', 'value')}, {r('ret', 'ret')} FROM events_run")
    ratio = _zero("avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252)")
    out["shortfall"] = with_track(
        RULES,
        run + f"""{event}, va AS (SELECT symbol, {ratio} AS a FROM run GROUP BY symbol), eb AS (SELECT symbol, {ratio} AS b FROM events_run GROUP BY symbol), lost AS (SELECT symbol, a, b, coalesce((a - b) / nullif(a, 0), 0) AS x FROM va JOIN eb USING (symbol))
        SELECT {NAMES}, {r("a", "vector_sharpe")}, {r("b", "event_sharpe")}, {r("x", "shortfall")}, x < 0.3 AS acceptable FROM lost""",
    )
    def scattered(number: int) -> str:
        x = f"((rep + 42000126) * 1000003 + i * 7919 + {number * 104_729 + 12_345}) % 2147483647"
        for factor, shift in ((48_271, 13), (69_621, 11), (39_373, 7)):
            x = f"(list_transform([{x}], lambda y: xor(y, y >> {shift}) * {factor})[1]) % 2147483647"
        return x

    out["spa"] = from_run(
        f""", bench AS (SELECT ts, avg(coalesce({RET}, 0)) AS b FROM n GROUP BY ts), d AS MATERIALIZED (SELECT run.symbol AS name, CAST(row_number() OVER (PARTITION BY run.symbol ORDER BY run.ts) - 1 AS BIGINT) AS i, ret - b AS d FROM run JOIN bench ON run.ts = bench.ts),
        c AS MATERIALIZED (SELECT name, count(*) AS n, avg(d) AS m FROM d GROUP BY name), dev AS (SELECT d.name, i, d - m AS x, n FROM d JOIN c USING (name)),
        auto AS (SELECT a.name, b.i - a.i AS k, sum(a.x * b.x) / any_value(a.n) AS g FROM dev a JOIN dev b ON a.name = b.name AND b.i - a.i BETWEEN 0 AND least(a.n, 200) - 1 GROUP BY ALL),
        omega AS (SELECT auto.name, sqrt(greatest(sum(CASE WHEN k = 0 THEN g ELSE 2 * g * ((n - k) / n * pow(0.9::DOUBLE, k) + k / n * pow(0.9::DOUBLE, n - k)) END), 1e-24)) AS w FROM auto JOIN c USING (name) GROUP BY auto.name),
        u AS (SELECT name, n, rep, i, i = 0 OR ({scattered(0)}) / 2147483647.0::DOUBLE < 0.1::DOUBLE AS fresh, CAST(floor(({scattered(1)}) / 2147483647.0::DOUBLE * n) AS BIGINT) % n AS start FROM d JOIN c USING (name), range(1000) t(rep)),
        v AS (SELECT name, n, rep, i, max(CASE WHEN fresh THEN i * 100000 + start END) OVER (PARTITION BY name, rep ORDER BY i ROWS UNBOUNDED PRECEDING) AS packed FROM u),
        means AS (SELECT v.name, rep, avg(d.d) AS mean FROM v JOIN d ON d.name = v.name AND d.i = (packed % 100000 + v.i - packed // 100000) % n GROUP BY ALL),
        s AS (SELECT name, n, m, w, greatest(0.0, sqrt(n) * m / w) AS statistic, CASE WHEN sqrt(n) * m / w >= -sqrt(2 * ln(ln(greatest(n, 16)))) THEN m ELSE 0 END AS centre FROM c JOIN omega USING (name))
        SELECT s.name, {r("statistic", "statistic")}, {r("m", "mean_difference")}, {r("avg(CASE WHEN statistic > 0 THEN CAST(greatest(0.0, sqrt(n) * (mean - centre) / w) >= statistic AS INT) ELSE 1 END)", "p_value")} FROM means JOIN s USING (name) GROUP BY s.name, statistic, m"""
    ).replace("FROM run2) ,", "FROM run2),")
    out["lookahead"] = f"""WITH {BARS}, cuts AS (SELECT symbol, CAST(floor(count(*) / 2) AS BIGINT) AS cut FROM n GROUP BY symbol UNION ALL SELECT DISTINCT symbol, unnest([10, 15, 20]) FROM n),
        ahead AS (SELECT symbol, ts, i, lead(close) OVER ({EACH}) AS later FROM n)
        SELECT symbol, CAST(cut AS INTEGER) AS prefix_rows, {TIME}, CAST(NULL AS DOUBLE) AS prefix_value, {r("later", "full_value")} FROM ahead JOIN cuts USING (symbol) WHERE i + 1 = cut AND later IS NOT NULL"""
    out["cusum_alerts"] = f"""WITH RECURSIVE {BARS}, x AS MATERIALIZED (SELECT symbol, ts, i, coalesce({RET}, 0.0) AS ret FROM n),
        w AS MATERIALIZED (SELECT *, CASE WHEN i < 9 THEN 6.0 WHEN stddev_pop(ret) OVER {last(63)} > 1e-12 THEN avg(ret) OVER {last(63)} / stddev_pop(ret) OVER {last(63)} * sqrt(252.0::DOUBLE) ELSE 0.0 END AS ratio FROM x),
        s AS (SELECT symbol, CAST(-1 AS BIGINT) AS i, 0.0::DOUBLE AS z, 0.0::DOUBLE AS shown, 0.0::DOUBLE AS s, CAST(0 AS BIGINT) AS c FROM w WHERE i = 0
            UNION ALL SELECT symbol, i, z, shown, CASE WHEN shown >= 7 THEN 0.0 ELSE shown END, CASE WHEN shown >= 7 THEN 0 ELSE c END
            FROM (SELECT *, greatest(0.0::DOUBLE, before - z - 0.5) AS shown FROM (SELECT w.symbol, w.i, s.s AS before, s.c + 1 AS c, (w.ratio - 6.0) * sqrt(CAST(greatest(least(s.c + 1, 63), 10) AS DOUBLE)) AS z FROM s JOIN w ON w.symbol = s.symbol AND w.i = s.i + 1))),
        l AS (SELECT s.symbol, w.ts, z, shown, CASE WHEN shown >= 7 THEN 'alarm' WHEN shown >= 5 THEN 'warning' WHEN shown >= 3 THEN 'watch' ELSE 'normal' END AS level FROM s JOIN w USING (symbol, i))
        SELECT symbol AS key, {TIME}, {r("z", "z_score")}, {r("shown", "statistic")}, level FROM l QUALIFY level <> lag(level, 1, 'normal') OVER ({EACH})"""
    return out
