"""SQL for the queries of registry_parts."""

from __future__ import annotations

from tidemark.oracle import BARS, EACH, RET, TIME, _trades, div, from_run, full, lag, last, r, statements as run_statements

FAULTY = f"""few AS (SELECT symbol, ts, i, CASE WHEN i = 11 THEN NULL ELSE open END AS open, CASE WHEN i = 9 THEN low - 1 ELSE high END AS high, low, CASE WHEN i = 13 THEN 0.0 ELSE close END AS close, CASE WHEN i = 17 THEN -5.0 ELSE volume END AS volume,
    CAST(CASE i WHEN 20 THEN 21 WHEN 21 THEN 20 ELSE i END AS DOUBLE) AS seq FROM n WHERE i < 40),
faulty AS (SELECT * FROM few UNION ALL SELECT symbol, ts, i, open, high, low, close, volume + 1, 5.5 FROM few WHERE i = 5)"""
BAD = "(high < low OR high < open OR high < close OR low > open OR low > close)"


def _flat(text: str) -> str:
    return text.replace("FROM run2) ,", "FROM run2),")


def _fitness() -> str:
    """CTEs that end in fitness (formula, simplicity, segment, sharpe, drawdown, turnover, trades)."""
    z = f"CASE WHEN i >= 19 THEN {div(f'close - avg(close) OVER {last(252)}', f'stddev_samp(close) OVER {last(252)}')} END"
    values = {
        "delta(close, 5)": (f"close - {lag('close', 5)}", 3, 2), "neg(zscore(close))": (f"-({z})", 3, 3), "div(close, ts_mean(close, 10))": (f"{div('close', f'avg(close) OVER {last(10)}')}", 5, 3), "returns": (RET, 1, 1),
    }
    each = " UNION ALL ".join(f"SELECT '{f}' AS formula, {-(size / 50 + depth / 8)!r}::DOUBLE AS simplicity, symbol, ts, i, n_all, coalesce({RET}, 0.0) AS q, CAST({x} AS DOUBLE) AS v FROM c" for f, (x, size, depth) in values.items())
    own, past = "PARTITION BY formula, symbol ORDER BY ts", "(PARTITION BY formula, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    return f"""c AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_all FROM n), v AS ({each}),
    s AS (SELECT *, CASE WHEN i + 1 <= floor(n_all * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS segment, CASE WHEN count(v) OVER {past} >= 20 THEN {div(f"v - avg(v) OVER {past}", f"stddev_samp(v) OVER {past}")} END AS z FROM v),
    p AS (SELECT *, CASE WHEN z > 0.5 THEN 1 WHEN z < -0.5 THEN -1 ELSE 0 END AS pos FROM s), t AS (SELECT *, coalesce(lag(pos) OVER ({own}), 0) AS before FROM p),
    m AS (SELECT *, abs(pos - before) AS turn, before * q - 0.001::DOUBLE * abs(pos - before) AS rr FROM t),
    e AS (SELECT *, sum(rr) OVER (PARTITION BY formula, symbol, segment ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM m), d AS (SELECT *, eq - max(eq) OVER (PARTITION BY formula, symbol, segment ORDER BY ts ROWS UNBOUNDED PRECEDING) AS dd FROM e),
    fitness AS (SELECT formula, simplicity, segment, coalesce(avg(rr) / nullif(stddev_samp(rr), 0) * sqrt(252.0::DOUBLE), 0) AS sharpe, min(dd) AS drawdown, -10 * avg(turn) AS turnover, CAST(sum(turn) AS BIGINT) AS trades FROM d GROUP BY ALL)"""


def statements() -> dict[str, str]:
    from tidemark.registry_parts import FORMULAS, LOGGED, TRACK

    w = f"({EACH})"
    out = {
        "rule_filters": f"""WITH {BARS}, b AS (SELECT *, {full("avg", "close", 20)} AS s20, 100 * ({div("close", lag("close", 10))} - 1) AS m, {div("close", lag("close", 20))} - 1 AS r20 FROM n)
            SELECT 'filtered' AS strategy_id, symbol, {TIME}, coalesce(close <= s20, false) AND volume <> 0 AND volume > 100 AND coalesce(r20 > -0.5, false) AS entry_signal, close = high OR coalesce(lag(m) OVER {w} >= 0 AND m < 0, false) AS exit_signal FROM b""",
        "stored_bars": f"WITH {BARS} SELECT symbol, {TIME}, {', '.join(r(c, c) for c in ('open', 'high', 'low', 'close', 'volume'))} FROM n WHERE symbol IN ('AF', 'NO') AND ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '1999-01-01'",
        "stored_features": f"WITH {BARS}, f AS (SELECT symbol, ts, {full('avg', 'close', 20)} AS x FROM n) SELECT symbol, {TIME}, {r('x', 'sma_20')} FROM f WHERE symbol = 'RF'",
        "described_bars": f"""WITH {BARS} SELECT symbol, count(*) AS rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end", '2024-01-01' AS fetched,
            CAST(max(ts) AS DATE) >= DATE '2001-10-30' AND (DATE '2001-11-10' - DATE '2001-10-30' > 30 OR DATE '2001-11-10' - DATE '2024-01-01' <= 1) AS fresh FROM n WHERE symbol <> 'AF' GROUP BY symbol""",
        "daily_sync": f"""WITH d AS (SELECT 'GDP' AS s, CAST(x AS DATE) AS o FROM generate_series(TIMESTAMP '2015-01-01', TIMESTAMP '2020-12-31', INTERVAL 3 MONTH) t(x) WHERE CAST(x AS DATE) + 30 <= DATE '2020-12-31'
                UNION ALL SELECT 'CPI', CAST(x AS DATE) FROM generate_series(TIMESTAMP '2015-01-01', TIMESTAMP '2020-12-31', INTERVAL 1 MONTH) t(x) WHERE CAST(x AS DATE) + 15 <= DATE '2020-12-31'),
            v AS (SELECT s, o, k, o + CAST(30 * (k + 1) AS INTEGER) AS rel, 100 * CAST(CAST('0x' || substr(md5(s || '_' || CAST(o AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE * [0.98, 0.99, 1.0][k + 1] AS value FROM d, range(3) t(k)),
            days AS (SELECT * FROM (VALUES (DATE '2020-06-15'), (DATE '2020-08-15')) t(day)), seen AS (SELECT v.*, dense_rank() OVER (PARTITION BY day, s ORDER BY o DESC) AS n FROM v JOIN days ON rel <= day)
            SELECT DISTINCT s AS indicator_name, CAST(o AS VARCHAR) AS observation_date, strftime(CAST(rel AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS release_date, {r("value", "value")}, CAST(k AS INTEGER) AS revision_number FROM seen WHERE n <= 12""",
        "ohlc_rows": f"WITH {BARS}, {FAULTY} SELECT symbol, {TIME}, {r('high', 'high')}, {r('low', 'low')} FROM faulty WHERE {BAD}",
        "first_of_each": "SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey",
        "simple_signal": f"""WITH {BARS}, b AS (SELECT symbol, ts, {full("avg", "close", 20)} AS f, {full("avg", "close", 50)} AS s FROM n) SELECT symbol, {TIME}, CASE WHEN f > s * 1.01::DOUBLE THEN 1 WHEN f < s * 0.99::DOUBLE THEN -1 ELSE 0 END AS signal FROM b""",
        "causal_features": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {c}, {not c})" for n, c in (("rolling_mean", True), ("centred_mean", False), ("expanding_mean", True), ("full_mean", False), ("lag", True), ("lead", False), ("rolling_z_score", True), ("full_z_score", False))) + ") t(feature, is_causal, looks_ahead)",
        "canary_answers": "SELECT * FROM (VALUES ('2021-08-08', true), ('2022-02-24', true), ('2022-12-18', false), ('2023-03-10', false)) t(day, leaks)",
        "reference_points": f"SELECT {r('i / 4.0', 'x')}, {r('j / 4.0', 'y')}, {r('(4 - i - j) / 4.0', 'z')} FROM range(5) a(i), range(5) b(j) WHERE i + j <= 4",
        "crowding_distances": f"""WITH x AS (SELECT p_partkey AS id, CAST(p_partkey AS DOUBLE) AS a, p_retailprice + p_partkey / 1e6::DOUBLE AS b, p_partkey % 7 AS rank FROM part),
            y AS (SELECT *, {", ".join(f"CASE WHEN lead({o}) OVER w{o} IS NULL OR lag({o}) OVER w{o} IS NULL THEN 'inf'::DOUBLE ELSE (lead({o}) OVER w{o} - lag({o}) OVER w{o}) / (max({o}) OVER (PARTITION BY rank) - min({o}) OVER (PARTITION BY rank)) END AS d{o}" for o in "ab")}
                FROM x WINDOW wa AS (PARTITION BY rank ORDER BY a), wb AS (PARTITION BY rank ORDER BY b)) SELECT id, rank, {r("da + db", "crowding")} FROM y""",
        "pareto_ranks": """WITH RECURSIVE x AS (SELECT c_nationkey AS nation, CAST(count(*) AS DOUBLE) AS n, -avg(c_acctbal) AS b FROM customer GROUP BY 1),
            beats AS (SELECT p.nation AS winner, q.nation AS loser FROM x p JOIN x q ON p.n >= q.n AND p.b >= q.b AND (p.n > q.n OR p.b > q.b)),
            chain AS (SELECT nation, 0 AS d FROM x UNION SELECT loser, d + 1 FROM chain JOIN beats ON winner = nation) SELECT nation, CAST(max(d) AS INTEGER) AS rank FROM chain GROUP BY nation""",
        "cpcv_exact": f"""WITH {BARS}, f AS (SELECT symbol, ts, close, CAST(ntile(6) OVER {w} AS INTEGER) AS fold FROM n), g AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY symbol, fold) AS c FROM f),
            masks AS (SELECT CAST(range AS INTEGER) AS mask, CAST(row_number() OVER (ORDER BY range) AS INTEGER) AS combo_id FROM range(64) WHERE bit_count(CAST(range AS INTEGER)) = 3),
            h AS (SELECT g.*, combo_id, mask, (mask >> (fold - 1)) & 1 = 1 AS test, greatest(CAST(floor(c * 0.02::DOUBLE) AS BIGINT), 1) AS margin FROM g, masks),
            p AS (SELECT *, (fold > 1 AND (mask >> greatest(fold - 2, 0)) & 1 = 1 AND k < margin) OR (fold < 6 AND (mask >> fold) & 1 = 1 AND k >= c - margin) AS purged FROM h)
            SELECT symbol, combo_id, mask, {r("count(*) FILTER (NOT test AND NOT purged) * 100000.0 + count(*) FILTER (test) + round(avg(close) FILTER (test)) / 1e6", "score")} FROM p GROUP BY ALL""",
        "formula_fitness": f"WITH {BARS}, {_fitness()} SELECT formula, segment, {r('simplicity', 'simplicity')}, {r('sharpe', 'sharpe')}, {r('drawdown', 'drawdown')}, {r('turnover', 'turnover')}, trades FROM fitness",
        "selection_pbo": f"""WITH {BARS}, {_fitness()}, k AS (SELECT formula, max(sharpe) FILTER (segment = 'train') AS a, max(sharpe) FILTER (segment = 'test') AS b FROM fitness GROUP BY formula),
            o AS (SELECT *, rank() OVER (ORDER BY b DESC) AS ro, rank() OVER (ORDER BY a DESC) AS ra, count(*) OVER () AS c FROM k)
            SELECT {r("CASE WHEN arg_max(ro, a) > max(c) / 2 THEN 1 ELSE 0 END", "pbo")}, CAST(1 AS BIGINT) AS combinations, {r("corr(ra, ro)", "rank_correlation")} FROM o""",
    }
    issue = lambda name, severity, message, when, value, most=10: f"""SELECT '{name}' AS check_name, '{severity}' AS severity, '{message}' AS message, symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, {r(value, 'value')} FROM g1 WHERE {when}
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts, {value}) <= {most}"""  # noqa: E731
    checks = [
        issue("duplicate_timestamps", "CRITICAL", "time appears again", "copy > 1", "copy"), issue("temporal_ordering", "CRITICAL", "time goes back", "came_after > ts", "seq"), issue("ohlc_consistency", "ERROR", "prices contradict each other", BAD, "close"),
        issue("missing_data", "WARNING", "values are missing", "open IS NULL", "1"), issue("price_sanity", "WARNING", "price moved by more than half (per cent)", "abs(mv) > 0.5", "mv * 100"),
        issue("volume_sanity", "INFO", "volume is a multiple of its median", "volume / nullif(mvol, 0) > 10", "volume / nullif(mvol, 0)", 5), issue("large_gaps", "WARNING", "rows are far apart (days)", "gap > 5 * mgap", "gap", 5),
        issue("zero_prices", "ERROR", "a price is zero", "close = 0", "close"), issue("negative_values", "CRITICAL", "a value is negative", "volume < 0", "least(open, high, low, close, volume)"),
    ]
    out["quality_faults"] = f"""WITH {BARS}, {FAULTY}, g0 AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY close, volume) AS copy, lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS came_after,
        {div("close", "lag(close) OVER (PARTITION BY symbol ORDER BY ts, close, volume)")} - 1 AS mv, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, close, volume))) / 86400 AS gap, median(volume) OVER (PARTITION BY symbol) AS mvol FROM faulty),
        g1 AS (SELECT *, median(gap) OVER (PARTITION BY symbol) AS mgap FROM g0) {" UNION ALL ".join(f"({c})" for c in checks)}"""
    newest = {(k, i): (s, p) for k, i, s, p in LOGGED}
    text = lambda p: "NULL" if p is None else f"'{str(p).lower()}'"
    shown = [(k, i, s, p) for (k, i), (s, p) in newest.items() if k == "validation" or (k, i) == ("factory", "f1")]
    out["run_log"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{i}', '{s}', {text(p)})" for k, i, s, p in shown) + ") t(kind, id, status, passed)"
    rows = ", ".join(f"({n}, '{k}', '{i}', '{s}', {text(p)})" for n, (k, i, s, p) in enumerate(LOGGED))
    out["run_counters"] = f"""WITH log AS (SELECT * FROM (VALUES {rows}) t(n, kind, id, status, passed) QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY n DESC) = 1),
        c AS (SELECT count(*) FILTER (kind = 'factory') AS generated, count(*) FILTER (kind = 'validation' AND status <> 'pending') AS validated, count(*) FILTER (kind = 'validation' AND passed = 'true') AS passed, count(*) FILTER (kind = 'deployment') AS deployed FROM log)
        SELECT *, {r("100.0 * validated / greatest(1, generated)", "validated_rate")}, {r("100.0 * passed / greatest(1, validated)", "passed_rate")}, {r("100.0 * deployed / greatest(1, passed)", "deployed_rate")} FROM c"""
    metrics = run_statements()["metrics"]
    out["compared_runs"] = f"SELECT strategy_id || '|' || symbol AS run_id, sharpe_ratio, total_return, max_drawdown, win_rate, CAST(num_trades AS DOUBLE) AS num_trades FROM ({metrics}) WHERE symbol IN ('AF', 'RO')"
    out["chart"] = _flat(from_run(
        f""", bench AS (SELECT ts, max(equity) AS benchmark FROM run WHERE symbol = 'AF' GROUP BY ts), both_ AS (SELECT strategy_id, run.symbol, run.ts, equity, benchmark FROM run JOIN bench ON run.ts = bench.ts),
        k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS m, greatest(1, floor(count(*) OVER (PARTITION BY symbol) / 300)) AS step FROM both_)
        SELECT strategy_id, symbol, {TIME}, {r("equity", "equity")}, {r("benchmark", "benchmark")} FROM k WHERE m % step = 0"""
    ))
    out["trade_summary"] = _trades(
        f"SELECT 'sma_crossover' AS strategy_id, symbol, count(*) AS num_trades, {r('avg(CAST(pnl > 0 AS INT))', 'win_rate')}, {r('avg(pnl_pct)', 'avg_return')}, {r('sum(pnl)', 'total_pnl')}, {r('avg(duration)', 'avg_holding_days')} FROM trades GROUP BY ALL"
    )
    listed = ", ".join(f"('{f}')" for f in FORMULAS)
    out["formula_facts"] = f"""WITH f AS (SELECT * FROM (VALUES {listed}) t(formula)), s AS (SELECT formula, len(regexp_extract_all(formula, '[a-z_]+|[0-9]+')) AS size, string_split(formula, '') AS chars FROM f),
        d AS (SELECT *, list_max(list_transform(range(1, len(chars) + 1), lambda j: len(list_filter(chars[1 : j], lambda c: c = '(')) - len(list_filter(chars[1 : j], lambda c: c = ')')))) + 1 AS depth, len(regexp_extract_all(formula, 'ts_corr|ts_cov|ts_rank')) AS heavy FROM s)
        SELECT formula, CAST(size AS INTEGER) AS size, CAST(depth AS INTEGER) AS depth, {r("size / 50 + depth / 8 + 0.1 * heavy", "complexity")}, substr(md5(formula), 1, 12) AS hash, true AS same_again FROM d"""
    facts = (("sma_crossover", 1, 1, 0.02), ("rsi_mean_reversion", 1, 1, 0.03), ("bollinger_breakout", 1, 1, 0.02), ("momentum_rotation", 1, 1, 0.05), ("macd_crossover", 1, 1, 0.02), ("volatility_breakout", 2, 1, 0.03), ("dual_momentum", 2, 2, 0.1), ("buy_and_hold", 1, 0, 0.0))
    out["template_facts"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b}, {s}::DOUBLE, true, true, true)" for n, a, b, s in facts) + ") t(name, entry_rules, exit_rules, stop_loss, json_round_trip, clone_is_equal, parameters_kept)"
    from math import e
    from statistics import NormalDist

    # the greatest of n normal values, from the two quantiles of the published formula
    q = NormalDist().inv_cdf
    best = {1: 0.0} | {n: (1 - 0.5772156649015329) * q(1 - 1 / n) + 0.5772156649015329 * q(1 - 1 / (n * e)) for n in (10, 1000)}
    figures = [(f"quick_{n}", f"CASE WHEN {n} > 1 THEN sqrt(2 * ln({n}.0::DOUBLE)) ELSE 0 END") for n in (1, 10, 1000)] + [(f"best_{n}", repr(best[n])) for n in best]
    figures += [(f"track_{v:g}", f"ceil(pow(1.6448536269514722::DOUBLE, 2) * (1 - {g} * {v} + ({k} - 1) / 4 * {v} * {v}) / ({v} * {v}))") for v, g, k in TRACK]
    out["ratio_figures"] = " UNION ALL ".join(f"SELECT '{n}' AS figure, {r(x, 'value')}" for n, x in figures)
    out["cache_freshness"] = """WITH x AS (SELECT * FROM (VALUES (-60), (-1), (0)) a(cached_end), (VALUES (-40), (-1)) b(wanted_end), (VALUES (-5), (0)) c(fetched))
        SELECT *, cached_end >= wanted_end AND (-wanted_end > 30 OR -fetched <= 1) AS fresh, substr(md5('SPY_' || CAST(DATE '2024-01-31' + cached_end AS VARCHAR) || '_' || CAST(DATE '2024-01-31' + wanted_end AS VARCHAR)), 1, 12) AS cache_key FROM x"""
    hold = f"""held AS (SELECT symbol, CASE WHEN i = 0 THEN 0.0 ELSE {RET} END AS ret FROM n), m0 AS (SELECT symbol, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s,
        (avg(ret*ret*ret) - 3 * avg(ret) * avg(ret*ret) + 2 * pow(avg(ret), 3)) / nullif(pow(avg(ret*ret) - pow(avg(ret), 2), 1.5), 0) AS g, kurtosis_pop(ret) AS k FROM held GROUP BY symbol), m1 AS (SELECT *, coalesce(m / nullif(s, 0) * sqrt(252), 0) AS sharpe FROM m0),
        m2 AS (SELECT *, sharpe / sqrt(greatest(1 + sharpe * sharpe / 2 - g * sharpe + k / 4 * sharpe * sharpe, 0.01) / n) AS z FROM m1)"""
    from tidemark.oracle_runs import normal

    out["quick_validation"] = f"WITH {BARS}, {hold}, p AS (SELECT symbol, sharpe, {normal('z')} AS dsr FROM m2) SELECT 'buy_and_hold' AS strategy_id, symbol, dsr >= 0.95 AND sharpe >= 1.0 AS passed, {r('sharpe', 'sharpe_ratio')}, {r('dsr', 'dsr')} FROM p"
    return out
