"""python -m tidemark: the queries and operators from a shell.

data, backtest and validate work on a folder of stored bars (sources/store.py) or, with --tables, on the bars of the driver tables.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from tidemark import registry
from tidemark.operators import backtest, validation
from tidemark.plans import strategy
from tidemark.sources import bars, store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("data", "backtest", "validate"):
        one = commands.add_parser(name)
        one.add_argument("path", help="stored bars, or a folder of tables with --tables")
        one.add_argument("--tables", action="store_true")
        one.add_argument("--symbols", nargs="*")
        one.add_argument("--start")
        one.add_argument("--end")
        if name != "data":
            one.add_argument("--template", default="sma_crossover", choices=sorted(strategy.TEMPLATES))
            one.add_argument("--parameters", type=json.loads, default={}, help="JSON")
        if name == "backtest":
            one.add_argument("--log", help="append the run to this table of runs")
    commands.add_parser("templates")
    board = commands.add_parser("leaderboard")
    board.add_argument("path", help="a table of runs")
    board.add_argument("--metric", default="sharpe_ratio")
    board.add_argument("--n", type=int, default=10)
    funnel = commands.add_parser("info")
    funnel.add_argument("path", nargs="?", help="a log of runs, for its counters")
    query = commands.add_parser("query")
    query.add_argument("name", choices=sorted(registry.queries()))
    query.add_argument("path")
    return out


def _bars(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.tables:
        rows = bars.bars_lineitem(spark, args.path)
        for condition in (f"symbol in ({', '.join(map(repr, args.symbols))})" if args.symbols else None, f"ts >= '{args.start}'" if args.start else None, f"ts < '{args.end}'" if args.end else None):
            rows = rows.where(condition) if condition else rows
        return rows
    return store.read_bars(spark, args.path, args.symbols, args.start, args.end)


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "data":
        return _bars(spark, args).groupBy("symbol").agg({"ts": "min", "close": "avg", "volume": "sum", "*": "count"})
    if args.command in ("backtest", "validate"):
        made = strategy.template(args.template).with_parameters(**args.parameters)
        if args.command == "validate":
            return validation.validate(_bars(spark, args), [made], scenarios=list(validation.SYNTHETIC))
        found = backtest.metrics(backtest.backtest(_bars(spark, args), [made]))
        if args.log:
            store.logged_runs(found, {k: str(v) for k, v in made.parameters.items()}, found["sharpe_ratio"] > 0).write.mode("append").parquet(args.log)
        return found
    if args.command == "templates":
        return spark.createDataFrame([(n, json.dumps(f().parameters)) for n, f in strategy.TEMPLATES.items()], "template string, parameters string")
    if args.command == "leaderboard":
        return store.leaderboard(spark.read.schema(store.RUNS).parquet(args.path), args.metric, args.n)
    if args.command == "info":
        return store.counters(spark.read.schema(store.LOG).parquet(args.path)) if args.path else spark.createDataFrame([(spark.version, len(registry.queries()))], "spark string, queries int")
    return registry.queries()[args.name](spark, args.path)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    result(SparkSession.builder.getOrCreate(), args).show(50, truncate=False)


if __name__ == "__main__":
    main()
