"""SQL with the same rows as the queries, for another engine to run on the same tables."""

from __future__ import annotations

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
BARS = f"""priced AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, l_extendedprice / l_quantity AS price, * FROM lineitem),
bars AS (SELECT symbol, ts, first(price ORDER BY {_KEY}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {_KEY}) AS close, sum(l_quantity) AS volume FROM priced GROUP BY symbol, ts),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, (high + low + close) / 3 AS tp, lag(close) OVER s AS pc, lag(high) OVER s AS ph, lag(low) OVER s AS pl
    FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts))"""
TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
EACH = "PARTITION BY symbol ORDER BY ts"
SO_FAR = f"({EACH} ROWS UNBOUNDED PRECEDING)"


def last(n: int) -> str:
    return f"({EACH} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(f: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {last(n)} >= {n if least is None else least} THEN {f}({x}) OVER {last(n)} END"


def r(x: str, name: str) -> str:
    """x to six significant digits."""
    scale = "pow(10.0::DOUBLE, 5 - floor(log10(abs(v))))"
    return f"list_transform([CAST({x} AS DOUBLE)], lambda v: CASE WHEN abs(v) < 1e-12 THEN 0.0::DOUBLE WHEN isinf(v) THEN v ELSE floor(v * {scale} + 0.5::DOUBLE) / {scale} END)[1] AS {name}"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({EACH})"


def ewm(x: str, span: int, i: str = "i") -> str:
    """Closed form of the recursion, for series without gaps from i = 0 on."""
    a = 2 / (span + 1)
    q = 1 - a
    return f"(pow({q!r}::DOUBLE, {i}) * sum(CASE WHEN {i} = 0 THEN {x} WHEN {i} > 0 THEN {a!r}::DOUBLE * ({x}) * pow({q!r}::DOUBLE, -({i})) END) OVER {SO_FAR})"


def _near(x: str, span: int) -> str:
    """The recursion over the last 400 rows only, for spans whose weights further back are below 1e-40."""
    a = 2 / (span + 1)
    held = f"list({x}) OVER {last(400)}"
    return f"list_reduce({held}, lambda y, v: {1 - a!r}::DOUBLE * y + {a!r}::DOUBLE * v)"


def from_bars(columns: dict[str, str], stages: str = "", source: str = "n") -> str:
    """stages: more CTEs; columns: name to expression over the last of them."""
    return f"WITH {BARS}{', ' + stages if stages else ''} SELECT symbol, {TIME}, {', '.join(r(x, k) for k, x in columns.items())} FROM {source}"


TR = "greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low))"
RET = div("close", "pc") + " - 1"

CROSS = f"""a AS (SELECT *, {full("avg", "close", 20)} AS s20, {full("avg", "close", 50)} AS s50 FROM n),
x AS (SELECT *, coalesce(lag(s20) OVER w <= lag(s50) OVER w AND s20 > s50, false) AS up, coalesce(lag(s20) OVER w >= lag(s50) OVER w AND s20 < s50, false) AS down FROM a WINDOW w AS ({EACH})),
p AS (SELECT *, coalesce(last_value(CASE WHEN up THEN 1 WHEN down THEN 0 END IGNORE NULLS) OVER {SO_FAR}, 0) AS position FROM x),
h AS (SELECT *, lag(position) OVER ({EACH}) AS before FROM p),
run0 AS (SELECT *, CAST(coalesce(before, 0) AS DOUBLE) AS held, coalesce(before * ({RET}), 0.0) - coalesce(abs(position - before), 0) * 0.0015 AS ret FROM h),
run1 AS (SELECT *, 100000.0 * product(1 + ret) OVER {SO_FAR} AS equity FROM run0),
run2 AS (SELECT *, (equity - max(equity) OVER {SO_FAR}) / max(equity) OVER {SO_FAR} AS drawdown FROM run1),
run AS (SELECT 'sma_crossover' AS strategy_id, *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER {SO_FAR} AS run_id FROM run2)"""


def from_run(select: str) -> str:
    return f"WITH {BARS}, {CROSS} {select}"


def _skew(x: str, w: str) -> str:
    """Population skewness by raw moments."""
    return f"(avg(({x})*({x})*({x})) OVER {w} - 3 * avg({x}) OVER {w} * avg(({x})*({x})) OVER {w} + 2 * pow(avg({x}) OVER {w}, 3)) / nullif(pow(avg(({x})*({x})) OVER {w} - pow(avg({x}) OVER {w}, 2), 1.5), 0)"


def _dsl_rank(x: str, n: int) -> str:
    held = f"list({x}) OVER {last(n)}"
    return f"CASE WHEN len({held}) >= 2 THEN CAST(len(list_filter({held}, lambda v: v < {x})) AS DOUBLE) / (len({held}) - 1) END"


def _trades(select: str) -> str:
    return from_run("") + f""",
t1 AS (SELECT *, sum(CASE WHEN coalesce(before, 0) <> position THEN 1 ELSE 0 END) OVER {SO_FAR} AS leg FROM run),
t2 AS (SELECT symbol, leg, min(ts) AS entry_ts, arg_min(close, ts) AS entry_price, any_value(position) AS side FROM t1 GROUP BY ALL),
ends AS (SELECT symbol, max(ts) AS last_ts, arg_max(close, ts) AS last_close FROM run GROUP BY symbol),
t3 AS (SELECT t2.*, coalesce(lead(entry_ts) OVER w, last_ts) AS exit_ts, coalesce(lead(entry_price) OVER w, last_close) AS exit_price, CASE WHEN lead(leg) OVER w IS NULL THEN 'eod' ELSE 'signal' END AS exit_signal
    FROM t2 JOIN ends USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY leg)),
trades AS (SELECT symbol, entry_ts, entry_price, exit_ts, exit_price, exit_signal, exit_price - entry_price AS pnl, (exit_price - entry_price) / entry_price AS pnl_pct,
    greatest(1, date_diff('day', entry_ts, exit_ts)) AS duration FROM t3 WHERE side <> 0)
{select}"""


PIT = """totals AS (SELECT o_orderpriority AS entity_id, CAST(o_orderdate AS DATE) AS observation_date, sum(o_totalprice) AS total FROM orders GROUP BY ALL),
pit AS (SELECT entity_id, 'order_total' AS indicator_name, observation_date, CAST(observation_date + CAST(30 * (k + 1) AS INTEGER) AS TIMESTAMP) AS release_date, total * [0.98, 0.99, 1.0][k + 1] AS value, CAST(k AS INTEGER) AS revision_number,
    'orders' AS source, CASE WHEN k < 2 THEN CAST(observation_date + CAST(30 * (k + 2) AS INTEGER) AS TIMESTAMP) END AS valid_to FROM totals, range(3) t(k))"""
_D = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def statements() -> dict[str, str]:
    w = f"({EACH})"
    vol = "volume"
    out = {
        "bars_daily": from_bars({c: c for c in ("open", "high", "low", "close", "volume")}),
        "bars_hourly": f"""WITH bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
            CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2) SELECT symbol, {TIME}, {", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume"))} FROM bars""",
        "returns": from_bars({"ret": RET, "log_ret": f"ln({div('close', 'pc')})"}),
        "sma": from_bars({f"sma_{k}": full("avg", "close", k) for k in (20, 50, 200)}),
        "bollinger": from_bars({"bb_upper": "m + 2 * s", "bb_middle": "m", "bb_lower": "m - 2 * s"}, f"b AS (SELECT *, {full('avg', 'close', 20)} AS m, {full('stddev_samp', 'close', 20)} AS s FROM n)", "b"),
        "stochastic": from_bars(
            {"stoch_k": "k", "stoch_d": full("avg", "k", 3)},
            f"b AS (SELECT *, 100 * {div(f'close - {full("min", "low", 14)}', f'({full("max", "high", 14)}) - ({full("min", "low", 14)})')} AS k FROM n)", "b",
        ),
        "williams_r": from_bars({"williams_r": f"-100 * {div(f'({full("max", "high", 14)}) - close', f'({full("max", "high", 14)}) - ({full("min", "low", 14)})')}"}),
        "momentum": from_bars({"momentum_10": f"100 * ({div('close', lag('close', 10))} - 1)"}),
        "volatility": from_bars({"volatility_20": f"({full('stddev_samp', 'ret', 20)}) * sqrt(252)"}, f"b AS (SELECT *, {RET} AS ret FROM n)", "b"),
        "obv": from_bars({"obv": f"CASE WHEN pc IS NOT NULL THEN sum(sign(close - pc) * volume) OVER {SO_FAR} END", "obv_from_zero": f"CASE WHEN pc IS NOT NULL THEN sum(sign(close - pc) * volume) OVER {SO_FAR} ELSE 0 END"}),
        "vwap": from_bars({"vwap": f"sum(tp * volume) OVER {SO_FAR} / sum(volume) OVER {SO_FAR}"}),
        "cci": from_bars(
            {"cci": f"CASE WHEN i >= 19 THEN {div('tp - m', '0.015 * d')} END"},
            f"b AS (SELECT *, avg(tp) OVER {last(20)} AS m, list(tp) OVER {last(20)} AS l FROM n), c AS (SELECT *, list_sum(list_transform(l, lambda v: abs(v - m))) / len(l) AS d FROM b)", "c",
        ),
        "mfi": from_bars(
            {"mfi": "CASE WHEN i < 13 THEN NULL WHEN dn = 0 THEN CASE WHEN up > 0 THEN 100 END ELSE 100 - 100 / (1 + up / nullif(dn, 0)) END"},
            f"b AS (SELECT *, tp - lag(tp) OVER {w} AS mv, tp * volume AS fl FROM n), c AS (SELECT *, sum(CASE WHEN mv > 0 THEN fl ELSE 0 END) OVER {last(14)} AS up, sum(CASE WHEN mv < 0 THEN fl ELSE 0 END) OVER {last(14)} AS dn FROM b)", "c",
        ),
        "ichimoku": from_bars(
            {"ichimoku_conversion": "c9", "ichimoku_base": "c26", "ichimoku_span_a": lag("(c9 + c26) / 2", 26), "ichimoku_span_b": lag("c52", 26), "ichimoku_chikou": f"lead(low, 26) OVER {w}"},
            f"b AS (SELECT *, {', '.join(f'(({full("max", "high", k)}) + ({full("min", "low", k)})) / 2 AS c{k}' for k in (9, 26, 52))} FROM n)", "b",
        ),
        "garman_klass": from_bars({"garman_klass": f"sqrt(252 * ({full('avg', 'g', 20)}))"}, "b AS (SELECT *, 0.5 * pow(ln(high / low), 2) - (2 * ln(2.0::DOUBLE) - 1) * pow(ln(close / open), 2) AS g FROM n)", "b"),
        "parkinson": from_bars({"parkinson": full("avg", "g", 20)}, "b AS (SELECT *, sqrt(252 * pow(ln(high / low), 2) / (4 * ln(2.0::DOUBLE))) AS g FROM n)", "b"),
        "vortex": from_bars(
            {"vortex_plus": div(f"{full('sum', 'vp', 14)}", f"{full('sum', 'tr', 14)}"), "vortex_minus": div(f"{full('sum', 'vm', 14)}", f"{full('sum', 'tr', 14)}")},
            f"b AS (SELECT *, {TR} AS tr, abs(high - pl) AS vp, abs(low - ph) AS vm FROM n)", "b",
        ),
        "donchian": from_bars({"donchian_upper": full("max", "high", 20), "donchian_middle": f"(({full('max', 'high', 20)}) + ({full('min', 'low', 20)})) / 2", "donchian_lower": full("min", "low", 20)}),
        "ultimate": from_bars(
            {"ultimate": "100 * (" + " + ".join(f"{k} * {div(full('sum', 'bp', m), full('sum', 'rg', m))}" for k, m in ((4, 7), (2, 14), (1, 28))) + ") / 7"},
            "b AS (SELECT *, CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END AS bp, CASE WHEN pc IS NOT NULL THEN greatest(high, pc) - least(low, pc) END AS rg FROM n)", "b",
        ),
        "kst": from_bars(
            {"kst": "k", "kst_signal": full("avg", "k", 9)},
            f"b AS (SELECT *, {', '.join(f'100 * ({div("close", lag("close", k))} - 1) AS r{k}' for k in (10, 15, 20, 30))} FROM n), "
            f"c AS (SELECT *, {' + '.join(f'{m} * ({full("avg", f"r{k}", s)})' for m, (k, s) in enumerate(((10, 10), (15, 10), (20, 10), (30, 15)), 1))} AS k FROM b)", "c",
        ),
        "aroon": from_bars(
            {"aroon_up": "u", "aroon_down": "d", "aroon_oscillator": "u - d"},
            f"b AS (SELECT *, list_reverse(list(high) OVER {last(25)}) AS lh, list_reverse(list(low) OVER {last(25)}) AS ll FROM n), "
            "c AS (SELECT *, CASE WHEN i >= 24 THEN 100.0 * (25 - (list_position(lh, list_max(lh)) - 1)) / 25 END AS u, CASE WHEN i >= 24 THEN 100.0 * (25 - (list_position(ll, list_min(ll)) - 1)) / 25 END AS d FROM b)", "c",
        ),
        "z_score": from_bars({"z_score": div(f"close - ({full('avg', 'close', 60)})", full("stddev_samp", "close", 60))}),
        "expanding_rank": from_bars(
            {"expanding_rank": "CASE WHEN i >= 59 THEN (len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) - 1) / 2.0::DOUBLE) / (len(l) - 1) END"}, f"b AS (SELECT *, list(close) OVER {SO_FAR} AS l FROM n)", "b",
        ),
        "cross_section_rank": from_bars({"cs_rank": "percent_rank() OVER (PARTITION BY ts ORDER BY close)"}),
        "ema": from_bars({f"ema_{k}": f"CASE WHEN i >= {k - 1} THEN {ewm('close', k)} END" for k in (12, 26)}),
        "macd": from_bars(
            {"macd": "m", "macd_signal": "CASE WHEN i >= 33 THEN s END", "macd_hist": "CASE WHEN i >= 33 THEN m - s END"},
            f"b AS (SELECT *, CASE WHEN i >= 25 THEN {ewm('close', 12)} - {ewm('close', 26)} END AS m FROM n), c AS (SELECT *, {ewm('m', 9, '(i - 25)')} AS s FROM b)", "c",
        ),
        "rsi": from_bars(
            {"rsi_14": "CASE WHEN i < 13 THEN NULL WHEN dn = 0 THEN CASE WHEN up > 0 THEN 100 END ELSE 100 - 100 / (1 + up / nullif(dn, 0)) END"},
            f"b AS (SELECT *, greatest(coalesce(close - pc, 0), 0) AS g, -least(coalesce(close - pc, 0), 0) AS l FROM n), c AS (SELECT *, {ewm('g', 14)} AS up, {ewm('l', 14)} AS dn FROM b)", "c",
        ),
        "atr": from_bars({"atr_14": f"CASE WHEN i >= 13 THEN {ewm('tr', 14)} END"}, f"b AS (SELECT *, {TR} AS tr FROM n)", "b"),
        "keltner": from_bars(
            {"keltner_upper": "m + 2 * k", "keltner_middle": "m", "keltner_lower": "m - 2 * k"}, f"b AS (SELECT *, {TR} AS tr FROM n), c AS (SELECT *, {ewm('close', 20)} AS m, {full('avg', 'tr', 10)} AS k FROM b)", "c",
        ),
        "chaikin_volatility": from_bars({"chaikin_volatility": f"100 * ({div('e', lag('e', 10))} - 1)"}, f"b AS (SELECT *, {ewm('(high - low)', 10)} AS e FROM n)", "b"),
        "mass_index": from_bars(
            {"mass_index": full("sum", "q", 25)}, f"b AS (SELECT *, {ewm('(high - low)', 9)} AS e FROM n), c AS (SELECT *, {ewm('e', 9)} AS e2 FROM b), d AS (SELECT *, {div('e', 'e2')} AS q FROM c)", "d",
        ),
        "dsl_arithmetic": from_bars(
            {"f_add": "close + open", "f_sub": "close - open", "f_mul": "close * volume", "f_div": div("close", "open"), "f_abs": "abs(close - open)", "f_neg": "-close", "f_log": "ln(greatest(close, 1e-10))",
             "f_sqrt": "sqrt(greatest(close, 0))", "f_sign": "sign(close - open)", "f_power": f"pow({RET}, 2)", "f_vwap": "tp", "f_adj": "close - close"},
        ),
        "dsl_windows": from_bars(
            {"f_delay": lag("close", 3), "f_delta": f"close - {lag('close', 5)}", "f_mean": f"avg(close) OVER {last(10)}", "f_std": f"stddev_samp(close) OVER {last(10)}", "f_min": f"min(low) OVER {last(7)}",
             "f_max": f"max(high) OVER {last(7)}", "f_sum": f"sum(volume) OVER {last(4)}", "f_nested": f"avg(mx) OVER {last(3)}",
             "f_scale": f"CASE WHEN count(ret) OVER {last(252)} >= 20 THEN {div('ret', f'sum(abs(ret)) OVER {last(252)}')} END", "f_zscore": f"CASE WHEN i >= 19 THEN {div(f'close - avg(close) OVER {last(252)}', f'stddev_samp(close) OVER {last(252)}')} END"},
            f"b AS (SELECT *, {RET} AS ret, close - {lag('close', 2)} AS d2 FROM n), c AS (SELECT *, max(d2) OVER {last(5)} AS mx FROM b)", "c",
        ),
        "dsl_ranks": from_bars(
            {"f_rank": "CASE WHEN len(a) >= 2 THEN CAST(len(list_filter(a, lambda v: v < close)) AS DOUBLE) / (len(a) - 1) END", "f_argmax": "len(b) - list_position(b, list_max(b))", "f_argmin": "len(b) - list_position(b, list_min(b))",
             "f_long_rank": "CASE WHEN len(d) >= 2 THEN CAST(len(list_filter(d, lambda v: v < volume)) AS DOUBLE) / (len(d) - 1) END"},
            f"z AS (SELECT *, list(close) OVER {last(20)} AS a, list(close) OVER {last(12)} AS b, list(volume) OVER {last(252)} AS d FROM n)", "z",
        ),
        "dsl_pairs": from_bars({"f_corr": f"CASE WHEN i >= 9 THEN corr(close, volume) OVER {last(20)} END", "f_cov": f"CASE WHEN i >= 9 THEN covar_samp(close, volume) OVER {last(20)} END"}),
        "dsl_logic": from_bars(
            {"f_gt": "CAST(close > open AS INT)", "f_lt": "CAST(close < open AS INT)", "f_gte": "CAST(close >= open AS INT)", "f_lte": "CAST(close <= open AS INT)", "f_eq": "CAST(high = close AS INT)",
             "f_and": "CAST(close > open AND volume > 500 AS INT)", "f_or": "CAST(close > open OR coalesce(ret > 0, false) AS INT)", "f_not": "CAST(NOT (close > open) AS INT)", "f_if": "CASE WHEN ret > 0 THEN close ELSE open END"},
            f"b AS (SELECT *, {RET} AS ret FROM n)", "b",
        ),
        "rule_signals": f"""WITH {BARS}, b AS (SELECT *, {full("avg", "close", 20)} AS s20, {full("avg", "close", 50)} AS s50, 100 * ({div("close", lag("close", 10))} - 1) AS m FROM n)
            SELECT 'rules' AS strategy_id, symbol, {TIME}, coalesce(lag(s20) OVER w <= lag(s50) OVER w AND s20 > s50, false) AND (volume > 100 OR coalesce(m >= 0, false)) AS entry_signal, coalesce(close < s20, false) AS exit_signal FROM b WINDOW w AS {w}""",
        "positions": from_run(f"SELECT symbol, {TIME}, CAST(position AS INTEGER) AS position FROM run"),
        "backtest_returns": from_run(f"SELECT symbol, {TIME}, {r('held', 'held')}, {r('ret', 'ret')}, {r('equity', 'equity')} FROM run"),
        "drawdown": from_run(f"SELECT strategy_id, symbol, {TIME}, {r('drawdown', 'drawdown')} FROM run"),
        "flagship_sma_sharpe": from_run(f"SELECT strategy_id, symbol, {r('coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0)', 'sharpe_ratio')} FROM run GROUP BY ALL"),
        "top_strategies": from_run(f"SELECT strategy_id, symbol, {r('coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0)', 'sharpe_ratio')} FROM run GROUP BY ALL ORDER BY 3 DESC, 2 LIMIT 3"),
        "yearly_returns": from_run(f"SELECT strategy_id, symbol, CAST(year(ts) AS INTEGER) AS year, {r('product(1 + ret) - 1', 'ret')} FROM run GROUP BY ALL"),
        "monthly_returns": from_run(
            f""", m AS (SELECT strategy_id, symbol, last_day(ts) AS month, product(1 + ret) - 1 AS ret FROM run GROUP BY ALL),
            span AS (SELECT strategy_id, symbol, date_trunc('month', min(month)) AS a, date_trunc('month', max(month)) AS b FROM m GROUP BY ALL),
            cal AS (SELECT strategy_id, symbol, last_day(CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE)) AS month FROM span)
            SELECT cal.strategy_id, cal.symbol, CAST(cal.month AS VARCHAR) AS month, {r("coalesce(m.ret, 0)", "ret")} FROM cal LEFT JOIN m ON cal.symbol = m.symbol AND cal.month = m.month"""
        ).replace("FROM run2) ,", "FROM run2),"),
        "rolling_sharpe": from_run(f"SELECT strategy_id, symbol, {TIME}, {r(f'avg(ret) OVER {last(252)} / stddev_samp(ret) OVER {last(252)} * sqrt(252)', 'rolling_sharpe')} FROM run QUALIFY count(ret) OVER {last(252)} >= 252 AND stddev_samp(ret) OVER {last(252)} > 0"),
        "trades": _trades(f"SELECT 'sma_crossover' AS strategy_id, symbol, {_D.format('entry_ts')}, {r('entry_price', 'entry_price')}, {_D.format('exit_ts')}, {r('exit_price', 'exit_price')}, exit_signal, {r('pnl', 'pnl')}, {r('pnl_pct', 'pnl_pct')}, {r('1', 'size')}, CAST(duration AS INTEGER) AS duration FROM trades"),
        "cpcv_folds": f"WITH {BARS}, f AS (SELECT symbol, ts, CAST(ntile(16) OVER {w} AS INTEGER) AS fold FROM n) SELECT symbol, fold, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS rows FROM f GROUP BY symbol, fold",
        "time_split": f"""WITH {BARS}, f AS (SELECT symbol, ts, CASE WHEN i + 1 <= floor(count(*) OVER (PARTITION BY symbol) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS segment FROM n)
            SELECT symbol, segment, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM f GROUP BY symbol, segment""",
        "expanding_windows": f"WITH {BARS} SELECT symbol, {TIME}, CAST(i + 1 AS INTEGER) AS prefix_rows FROM n WHERE i >= 251",
        "rolling_windows": f"""WITH {BARS}, c AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS rows_n FROM n), k AS (SELECT symbol, ts, close, i, unnest(range(0, CAST(floor((rows_n - 250) / 200) AS BIGINT) + 1)) AS window_id FROM c WHERE rows_n >= 250)
            SELECT symbol, CAST(window_id AS INTEGER) AS window_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, {r("avg(close)", "mean_close")} FROM k WHERE i >= window_id * 200 AND i < window_id * 200 + 250 GROUP BY symbol, window_id""",
        "pit_as_of": f"WITH {BARS} SELECT symbol, {TIME}, {', '.join(r(c, c) for c in ('open', 'high', 'low', 'close', 'volume'))} FROM n WHERE ts + INTERVAL 1 DAY <= TIMESTAMP '1999-06-30' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n.ts DESC) <= 30",
        "pit_latest": f"WITH {BARS} SELECT symbol, {TIME}, {', '.join(r(c, c) for c in ('open', 'high', 'low', 'close', 'volume'))} FROM n WHERE ts <= TIMESTAMP '1999-06-30' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n.ts DESC) = 1",
        "pit_returns": f"""WITH {BARS}, k AS (SELECT * FROM n WHERE ts <= TIMESTAMP '1999-06-30' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 21), m AS (SELECT symbol, ts, {div("close", lag("close"))} - 1 AS ret FROM k)
            SELECT symbol, {TIME}, {r("ret", "ret")} FROM m WHERE ret IS NOT NULL""",
        "pit_value": f"""WITH {PIT} SELECT entity_id, indicator_name, CAST(observation_date AS VARCHAR) AS observation_date, {r("value", "value")}, {_D.format("release_date")}, revision_number FROM pit
            WHERE release_date <= TIMESTAMP '1999-06-30' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1999-06-30') QUALIFY row_number() OVER (PARTITION BY entity_id, observation_date ORDER BY pit.release_date DESC, revision_number DESC) = 1""",
        "pit_join": f"""WITH {PIT}, q AS (SELECT DISTINCT entity_id, CAST(date_trunc('month', observation_date) AS TIMESTAMP) AS as_of FROM pit),
            j AS (SELECT q.entity_id, q.as_of, pit.observation_date, pit.value, row_number() OVER (PARTITION BY q.entity_id, q.as_of ORDER BY pit.observation_date DESC NULLS LAST, revision_number DESC) AS k
                FROM q LEFT JOIN pit ON pit.entity_id = q.entity_id AND pit.release_date <= q.as_of)
            SELECT entity_id, {_D.format("as_of")}, CAST(observation_date AS VARCHAR) AS observation_date, {r("value", "value")} FROM j WHERE k = 1""",
        "latest_revision": f"WITH {PIT} SELECT entity_id, indicator_name, CAST(observation_date AS VARCHAR) AS observation_date, {r('value', 'value')}, revision_number FROM pit WHERE revision_number = 2",
        "revision_history": f"WITH {PIT} SELECT entity_id, indicator_name, CAST(observation_date AS VARCHAR) AS observation_date, {_D.format('release_date')}, {r('value', 'value')}, revision_number, source, {_D.format('valid_to')} FROM pit WHERE entity_id = '1-URGENT' AND observation_date = DATE '1998-03-02'",
        "market_impact": f"""WITH s AS (SELECT l_suppkey, sum(l_quantity) AS q, sum(l_extendedprice) AS v FROM lineitem GROUP BY l_suppkey),
            i AS (SELECT *, 0.314::DOUBLE * sqrt(0.01::DOUBLE) * (q / (q * 500.0)) AS p, 0.142::DOUBLE * sqrt(0.01::DOUBLE) * pow(q / (q * 500.0), 0.6::DOUBLE) AS t FROM s)
            SELECT l_suppkey, {r("p", "permanent")}, {r("t", "temporary")}, {r("p + t", "impact")}, {r("1.0 + v * 5.0 / 10000 / 2 + v * (p + t)", "cost")} FROM i""",
        "pareto_front": f"""WITH x AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size, -p_retailprice AS price FROM part)
            SELECT id, {r("size", "size")}, {r("price", "price")} FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.size >= x.size AND y.price >= x.price AND (y.size > x.size OR y.price > x.price))""",
    }
    out["hourly_bars_from_events"] = out["bars_hourly"]
    out["rolling_stats"] = from_bars(
        {f"r_{k}": full(f, "close", 20) for k, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("sum", "sum"), ("var", "var_samp"), ("skew", "skewness"), ("kurt", "kurtosis"))}
    )
    zero = lambda x: f"coalesce({x}, 0)"
    out["metrics"] = from_run(
        f""", longest AS (SELECT symbol, max(c) AS d FROM (SELECT symbol, run_id, count(*) AS c FROM run WHERE drawdown < 0 GROUP BY ALL) GROUP BY symbol),
        st AS (SELECT *, CASE WHEN held > coalesce(lag(held) OVER {w}, 0) THEN 1 END AS started, sum(CASE WHEN held = 0 THEN 1 ELSE 0 END) OVER {SO_FAR} AS trade FROM run),
        base AS (SELECT symbol, count(ret) AS days, product(1 + ret) - 1 AS total, avg(ret) AS m, stddev_samp(ret) AS s, stddev_samp(ret) FILTER (ret < 0) AS down, abs(min(drawdown)) AS dd, quantile_cont(ret, 0.05) AS p5,
            (avg(ret*ret*ret) - 3 * avg(ret) * avg(ret*ret) + 2 * pow(avg(ret), 3)) / nullif(pow(avg(ret*ret) - pow(avg(ret), 2), 1.5), 0) AS g, kurtosis_pop(ret) AS k, count(started) AS trades FROM st GROUP BY symbol),
        tail AS (SELECT run.symbol, abs(avg(ret)) AS t FROM run JOIN base ON run.symbol = base.symbol WHERE ret <= -abs(p5) GROUP BY run.symbol),
        tr AS (SELECT symbol, trade, product(1 + ret) - 1 AS ret FROM st WHERE held <> 0 GROUP BY ALL),
        ts AS (SELECT symbol, avg(CAST(ret > 0 AS INT)) AS wr, sum(ret) FILTER (ret > 0) AS gained, abs(sum(ret) FILTER (ret <= 0)) AS lost, avg(ret) FILTER (ret > 0) AS aw, avg(ret) FILTER (ret < 0) AS al FROM tr GROUP BY symbol),
        j AS (SELECT base.*, longest.d, tail.t, wr, gained, lost, aw, al, days / 252 AS years, pow(1 + total, 252 / days) - 1 AS annual FROM base LEFT JOIN longest USING (symbol) LEFT JOIN tail USING (symbol) LEFT JOIN ts USING (symbol))
        SELECT 'sma_crossover' AS strategy_id, symbol, {r("total", "total_return")}, {r("annual", "annualized_return")}, {r(zero("s * sqrt(252)"), "volatility")}, {r(zero("m / nullif(s, 0) * sqrt(252)"), "sharpe_ratio")},
            {r(zero("annual / nullif(down * sqrt(252), 0)"), "sortino_ratio")}, {r(zero("annual / nullif(dd, 0)"), "calmar_ratio")}, {r(zero("dd"), "max_drawdown")}, coalesce(d, 0) AS max_drawdown_duration, {r("abs(p5)", "var_95")},
            {r("CASE WHEN p5 = 0 THEN 0 ELSE coalesce(t, 0) END", "cvar_95")}, {r(zero("g"), "skewness")}, {r(zero("k"), "kurtosis")}, trades AS num_trades, {r(zero("wr"), "win_rate")},
            {r("CASE WHEN coalesce(lost, 0) > 0 THEN coalesce(gained, 0) / lost WHEN coalesce(gained, 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END", "profit_factor")}, {r(zero("aw"), "avg_win")}, {r(zero("al"), "avg_loss")},
            days AS trading_days, {r("years", "years")} FROM j"""
    ).replace("FROM run2) ,", "FROM run2),")
    sums = "f AS (SELECT *, ntile(16) OVER (PARTITION BY symbol ORDER BY ts) AS fold FROM run), g AS (SELECT symbol, fold, count(ret) AS c, sum(ret) AS s, sum(ret * ret) AS q FROM f GROUP BY ALL), masks AS (SELECT CAST(range AS INTEGER) AS mask, CAST(row_number() OVER (ORDER BY range) AS INTEGER) AS combo_id FROM range(65536) WHERE bit_count(CAST(range AS INTEGER)) = 8)"
    picked = "z AS (SELECT symbol, combo_id, mask, sum(c) AS c, sum(s) AS s, sum(q) AS q FROM g JOIN masks ON (mask >> CAST(fold - 1 AS INTEGER)) & 1 = 1 GROUP BY ALL), y AS (SELECT *, (q - s * s / c) / (c - 1) AS v FROM z), ratios AS (SELECT symbol, combo_id, mask, coalesce(s / c / CASE WHEN v > 1e-18 THEN sqrt(v) END * sqrt(252), 0) AS sharpe FROM y)"
    out["cpcv"] = from_run(f", {sums}, {picked} SELECT 'sma_crossover' AS strategy_id, symbol, combo_id, mask, {r('sharpe', 'sharpe')} FROM ratios").replace("FROM run2) ,", "FROM run2),")
    out["cpcv_summary"] = from_run(
        f", {sums}, {picked} SELECT 'sma_crossover' AS strategy_id, symbol, count(*) AS combinations, {r('avg(sharpe)', 'mean_sharpe')}, {r('stddev_pop(sharpe)', 'std_sharpe')}, {r('min(sharpe)', 'min_sharpe')}, {r('max(sharpe)', 'max_sharpe')}, "
        f"{r('avg(CAST(sharpe < 0 AS INT))', 'probability_of_loss')} FROM ratios GROUP BY symbol"
    ).replace("FROM run2) ,", "FROM run2),")
    out["trade_statistics"] = _trades("").rstrip() + f""",
        runs AS (SELECT *, sum(CASE WHEN NOT (pnl > 0) THEN 1 ELSE 0 END) OVER t AS w, sum(CASE WHEN NOT (pnl < 0) THEN 1 ELSE 0 END) OVER t AS l FROM trades WINDOW t AS (PARTITION BY symbol ORDER BY entry_ts ROWS UNBOUNDED PRECEDING)),
        cw AS (SELECT symbol, max(c) AS c FROM (SELECT symbol, w, count(*) AS c FROM runs WHERE pnl > 0 GROUP BY ALL) GROUP BY symbol), cl AS (SELECT symbol, max(c) AS c FROM (SELECT symbol, l, count(*) AS c FROM runs WHERE pnl < 0 GROUP BY ALL) GROUP BY symbol),
        b AS (SELECT symbol, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl < 0) AS losing_trades, count(*) FILTER (pnl = 0) AS breakeven_trades, {r("avg(CAST(pnl > 0 AS INT))", "win_rate")}, {r("sum(pnl)", "total_pnl")},
            {r("coalesce(sum(pnl) FILTER (pnl > 0), 0)", "gross_profit")}, {r("coalesce(abs(sum(pnl) FILTER (pnl < 0)), 0)", "gross_loss")}, {r("avg(pnl)", "expectancy")}, {r("coalesce(avg(pnl) FILTER (pnl > 0), 0)", "avg_win")},
            {r("coalesce(avg(pnl) FILTER (pnl < 0), 0)", "avg_loss")}, {r("coalesce(max(pnl) FILTER (pnl > 0), 0)", "largest_win")}, {r("coalesce(min(pnl) FILTER (pnl < 0), 0)", "largest_loss")}, {r("avg(pnl_pct)", "avg_pnl_pct")},
            {r("avg(duration)", "avg_duration")}, {r("coalesce(avg(duration) FILTER (pnl > 0), 0)", "avg_win_duration")}, {r("coalesce(avg(duration) FILTER (pnl < 0), 0)", "avg_loss_duration")},
            {r("CASE WHEN sum(pnl) FILTER (pnl < 0) < 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / abs(sum(pnl) FILTER (pnl < 0)) WHEN sum(pnl) FILTER (pnl > 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END", "profit_factor")} FROM trades GROUP BY symbol)
        SELECT 'sma_crossover' AS strategy_id, b.*, coalesce(cw.c, 0) AS max_consecutive_wins, coalesce(cl.c, 0) AS max_consecutive_losses FROM b LEFT JOIN cw ON b.symbol = cw.symbol LEFT JOIN cl ON b.symbol = cl.symbol"""
    out["adx"] = from_bars(
        {"adx_14": f"CASE WHEN i >= 26 THEN {ewm('dx', 14, '(i - 13)')} END"},
        f"b AS (SELECT *, {TR} AS tr, CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS dp, CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS dm FROM n), "
        f"c AS (SELECT *, 100 * {div(ewm('dp', 14), ewm('tr', 14))} AS p, 100 * {div(ewm('dm', 14), ewm('tr', 14))} AS m FROM b), d AS (SELECT *, CASE WHEN i >= 13 THEN 100 * {div('abs(p - m)', 'p + m')} END AS dx FROM c)", "d",
    )

    def joined(names: list[str], columns: str = "*") -> str:
        """Rows of several statements side by side."""
        return f"SELECT {columns} FROM ({out[names[0]]})" + "".join(f" JOIN ({out[n]}) AS t_{n} USING (symbol, ts)" for n in names[1:])

    out["_volume"] = from_bars({"volume_sma_20": full("avg", "volume", 20), "volume_ratio": div("volume", full("avg", "volume", 20))})
    out["_more_returns"] = from_bars({f"returns_{k}d": f"{div('close', lag('close', k))} - 1" for k in (1, 5, 20)})
    out["_rsi_7"] = from_bars(
        {"rsi_7": "CASE WHEN i < 6 THEN NULL WHEN dn = 0 THEN CASE WHEN up > 0 THEN 100 END ELSE 100 - 100 / (1 + up / nullif(dn, 0)) END"},
        f"b AS (SELECT *, greatest(coalesce(close - pc, 0), 0) AS g, -least(coalesce(close - pc, 0), 0) AS l FROM n), c AS (SELECT *, {_near('g', 7)} AS up, {_near('l', 7)} AS dn FROM b)", "c",
    )
    out["indicators_basic"] = joined(["bars_daily", "ema", "macd", "rsi", "atr", "adx", "sma", "momentum", "bollinger", "volatility", "stochastic", "williams_r", "obv", "_volume"], "* EXCLUDE (obv_from_zero)")
    out["indicators_advanced"] = joined(
        ["bars_daily", "keltner", "chaikin_volatility", "mass_index", "stochastic", "williams_r", "cci", "mfi", "obv", "ichimoku", "garman_klass", "parkinson", "vortex", "donchian", "ultimate", "kst", "aroon"], "* EXCLUDE (obv, obv_from_zero), obv_from_zero AS obv"
    )
    out["features"] = joined(["bars_daily", "ema", "rsi", "_rsi_7", "atr", "sma", "volatility", "momentum", "_more_returns", "_volume"], "* EXCLUDE (volume_sma_20)")
    regime = f"""q0 AS (SELECT *, {RET} AS r1, {div("close", lag("close", 20))} - 1 AS return_20, {div(f"close - max(close) OVER {last(50)}", f"max(close) OVER {last(50)}")} AS dd0 FROM n),
        q1 AS (SELECT *, ({full("stddev_samp", "r1", 20)}) * sqrt(252) AS realized_vol, ({full("stddev_samp", "r1", 60)}) * sqrt(252) AS historical_vol,
            CASE WHEN i >= 19 THEN {div(f"regr_slope(close, i + 1) OVER {last(20)}", f"first_value(close) OVER {last(20)}")} * 252 END AS trend_slope, min(dd0) OVER {SO_FAR} AS worst FROM q0),
        q2 AS (SELECT *, realized_vol / nullif(historical_vol, 0) AS vr FROM q1),
        regimes AS (SELECT *, CASE WHEN coalesce(worst < -0.15 OR return_20 < -0.15, worst < -0.15, false) THEN 'crisis' WHEN coalesce(vr > 2, false) THEN 'high_vol' WHEN coalesce(abs(trend_slope) > 0.3 AND vr < 1.5, false) THEN 'trending' ELSE 'normal' END AS regime FROM q2)"""
    out["regimes"] = f"WITH {BARS}, {regime} SELECT symbol, {TIME}, {r('realized_vol', 'realized_vol')}, {r('historical_vol', 'historical_vol')}, {r('trend_slope', 'trend_slope')}, {r('return_20', 'return_20')}, {r('worst', 'drawdown')}, regime FROM regimes"
    out["regime_attribution"] = from_run(
        f""", {regime}, rr AS (SELECT run.symbol, run.ts, run.ret, regimes.regime FROM run JOIN regimes ON run.symbol = regimes.symbol AND run.ts = regimes.ts),
        e0 AS (SELECT *, product(1 + ret) OVER (PARTITION BY symbol, regime ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM rr), e1 AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol, regime ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e0)
        SELECT 'sma_crossover' AS strategy_id, symbol, regime, count(*) AS days, {r("product(1 + ret) - 1", "total_return")}, {r("avg(ret)", "mean_return")}, {r("coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0)", "sharpe_ratio")},
            {r("min(dd)", "max_drawdown")}, {r("avg(CAST(ret > 0 AS INT))", "win_rate")} FROM e1 GROUP BY symbol, regime"""
    ).replace("FROM run2) ,", "FROM run2),")
    issue = lambda name, severity, message, rows, value, most: f"""SELECT '{name}' AS check_name, '{severity}' AS severity, '{message}' AS message, symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, {r(value, 'value')} FROM {rows}
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts, {value}) <= {most}"""  # noqa: E731
    found = f"""g0 AS (SELECT *, {RET} AS mv, (epoch(ts) - epoch(lag(ts) OVER {w})) / 86400 AS gap, median(volume) OVER (PARTITION BY symbol) AS mvol FROM n), g1 AS (SELECT *, median(gap) OVER (PARTITION BY symbol) AS mgap FROM g0),
        issues AS (({issue("price_sanity", "WARNING", "price moved by more than half (per cent)", "(SELECT * FROM g1 WHERE abs(mv) > 0.5)", "mv * 100", 10)}) UNION ALL ({issue("volume_sanity", "INFO", "volume is a multiple of its median", "(SELECT * FROM g1 WHERE volume / nullif(mvol, 0) > 10)", "volume / nullif(mvol, 0)", 5)})
        UNION ALL ({issue("large_gaps", "WARNING", "rows are far apart (days)", "(SELECT * FROM g1 WHERE gap > 5 * mgap)", "gap", 5)}))"""
    out["quality_issues"] = f"WITH {BARS}, {found} SELECT * FROM issues"
    out["quality_report"] = f"""WITH {BARS}, {found} SELECT s.symbol, count(check_name) AS issues, coalesce(max(severity = 'CRITICAL'), false) AS has_critical, coalesce(max(severity IN ('CRITICAL', 'ERROR', 'WARNING')), false) AS has_errors
        FROM (SELECT DISTINCT symbol FROM n) s LEFT JOIN issues ON s.symbol = issues.symbol GROUP BY s.symbol"""
    out["information_ratio"] = from_run(
        f""", bench AS (SELECT ts, avg(coalesce({RET}, 0)) AS b FROM n GROUP BY ts), act AS (SELECT symbol, ret - b AS a FROM run JOIN bench ON run.ts = bench.ts)
        SELECT 'sma_crossover' AS strategy_id, symbol, {r("coalesce(avg(a) * 252 / nullif(stddev_samp(a) * sqrt(252), 0), 0)", "information_ratio")} FROM act GROUP BY symbol"""
    ).replace("FROM run2) ,", "FROM run2),")
    out["probability_of_loss"] = from_run(
        f", {sums}, {picked}, pl AS (SELECT avg(CAST(sharpe < 0 AS INT)) AS p FROM ratios) SELECT {r('p', 'probability')}, {r("CASE WHEN p <= 0 THEN '-inf'::DOUBLE WHEN p >= 1 THEN 'inf'::DOUBLE ELSE ln(p / (1 - p)) END", 'logit')}, p <= 0.05 AS passed FROM pl"
    ).replace("FROM run2) ,", "FROM run2),")
    out["pbo"] = f"""WITH {BARS}, y0 AS (SELECT symbol, date_trunc('year', ts) AS period, {RET} AS rr FROM n), y1 AS (SELECT symbol, period, coalesce(avg(rr) / nullif(stddev_samp(rr), 0), 0) AS sharpe FROM y0 GROUP BY ALL),
        y2 AS (SELECT symbol, period, avg(sharpe) OVER a AS ins, lead(sharpe) OVER p AS outs, count(sharpe) OVER a AS ca FROM y1 WINDOW p AS (PARTITION BY symbol ORDER BY period), a AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
        y3 AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY outs DESC) + (count(*) OVER (PARTITION BY period, outs) - 1) / 2.0::DOUBLE AS ro, rank() OVER (PARTITION BY period ORDER BY ins DESC) + (count(*) OVER (PARTITION BY period, ins) - 1) / 2.0::DOUBLE AS ri,
            count(*) OVER (PARTITION BY period) AS cnt FROM y2 WHERE ca = 2 AND outs IS NOT NULL), y4 AS (SELECT period, arg_max(ro, ins) AS rk, any_value(cnt) AS cnt FROM y3 GROUP BY period)
        SELECT {r("avg(CAST(rk > cnt / 2 AS INT))", "pbo")}, {r("CASE WHEN avg(CAST(rk > cnt / 2 AS INT)) <= 0 THEN '-inf'::DOUBLE WHEN avg(CAST(rk > cnt / 2 AS INT)) >= 1 THEN 'inf'::DOUBLE ELSE ln(avg(CAST(rk > cnt / 2 AS INT)) / (1 - avg(CAST(rk > cnt / 2 AS INT)))) END", "logit")}, {r("avg(ln((1 - rk / (cnt + 1)) / (rk / (cnt + 1))))", "mean_logit")}, count(*) AS combinations, (SELECT {r("corr(ri, ro)", "x")} FROM y3) AS rank_correlation FROM y4"""
    out["best_and_worst"] = from_run(
        """, m AS (SELECT symbol, last_day(ts) AS month, product(1 + ret) - 1 AS ret FROM run GROUP BY ALL), span AS (SELECT symbol, date_trunc('month', min(month)) AS a, date_trunc('month', max(month)) AS b FROM m GROUP BY ALL),
        cal AS (SELECT symbol, last_day(CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE)) AS month FROM span),
        mm AS (SELECT cal.symbol, cal.month, coalesce(m.ret, 0) AS ret FROM cal LEFT JOIN m ON cal.symbol = m.symbol AND cal.month = m.month),
        bm AS (SELECT symbol, first(month ORDER BY ret DESC, month DESC) AS bm, first(month ORDER BY ret, month) AS wm FROM mm GROUP BY symbol),
        yy AS (SELECT symbol, CAST(year(ts) AS INTEGER) AS y, product(1 + ret) - 1 AS ret FROM run GROUP BY ALL), by_ AS (SELECT symbol, first(y ORDER BY ret DESC, y DESC) AS best_y, first(y ORDER BY ret, y) AS worst_y FROM yy GROUP BY symbol)
        SELECT 'sma_crossover' AS strategy_id, bm.symbol, CAST(bm AS VARCHAR) AS best_month, CAST(wm AS VARCHAR) AS worst_month, best_y AS best_year, worst_y AS worst_year FROM bm JOIN by_ ON bm.symbol = by_.symbol"""
    ).replace("FROM run2) ,", "FROM run2),")
    out["pit_features"] = f"""WITH {BARS}, k AS (SELECT * FROM n WHERE ts <= TIMESTAMP '1999-06-30'), f AS (SELECT symbol, ts, {full("avg", "close", 20)} AS a, {RET} AS b, {div("volume", full("avg", "volume", 20))} AS c FROM k)
        SELECT symbol, {TIME}, {r("a", "sma_20")}, {r("b", "returns_1d")}, {r("c", "volume_ratio")} FROM f WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"""
    step = {"GDP": ("3 MONTH", 30), "CPI": ("1 MONTH", 15), "RATE": ("7 DAY", 0)}
    dates = " UNION ALL ".join(f"SELECT '{k}' AS series_id, CAST(d AS DATE) AS observation_date FROM generate_series(TIMESTAMP '2019-01-01', TIMESTAMP '2020-12-31', INTERVAL {s}) t(d) WHERE CAST(d AS DATE) + {g} <= DATE '2020-06-15'" for k, (s, g) in step.items())
    out["vintages"] = f"""WITH d AS ({dates}), v AS (SELECT *, 100 * CAST(CAST('0x' || substr(md5(series_id || '_' || CAST(observation_date AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS value FROM d)
        SELECT series_id, CAST(observation_date AS VARCHAR) AS observation_date, CAST(observation_date + CAST(30 * (k + 1) AS INTEGER) AS VARCHAR) AS release_date, {r("value * [0.98, 0.99, 1.0][k + 1]", "value")}, CAST(k AS INTEGER) AS revision_number FROM v, range(3) t(k)"""
    out["leaderboard"] = f"SELECT 'sma_crossover|' || symbol AS run_id, volatility, CAST(num_trades AS DOUBLE) AS num_trades FROM ({out['metrics']}) WHERE num_trades >= 10 ORDER BY volatility DESC, 1 LIMIT 3"
    out["population_stats"] = f"""SELECT count(*) AS size, count(DISTINCT p_partkey) AS unique, count(*) FILTER (p_partkey % 4 = 0) AS front, {", ".join(r(f"{f}({x})", f"{f}_{n}") for x, n in (("p_size", "size"), ("p_retailprice", "p_retailprice")) for f in ("min", "max", "avg"))} FROM part"""
    out["bad_revisions"] = f"WITH {PIT}, off AS (SELECT * REPLACE (CASE WHEN revision_number = 2 AND dayofweek(observation_date) = 1 THEN release_date - INTERVAL 80 DAY ELSE release_date END AS release_date) FROM pit) SELECT entity_id, indicator_name, CAST(observation_date AS VARCHAR) AS observation_date, {_D.format('release_date')}, {r('value', 'value')}, revision_number, source, {_D.format('valid_to')} FROM off QUALIFY off.release_date < lag(off.release_date) OVER (PARTITION BY entity_id, observation_date ORDER BY revision_number)"
    del vol
    return {k: v for k, v in out.items() if not k.startswith("_")}
