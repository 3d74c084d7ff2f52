"""The engine over HTTP, with the standard library alone: jobs run in threads, their state is in the run log (sources/store.py).

    Service(spark, "/shared/bars", "/shared/log").serve(8000)

GET / and /api/system/status; POST /api/validate, /api/factory, /api/discovery start a job and give its id; GET on the same path with
/<id> gives its state and result; GET /api/strategies, /api/templates, /api/pipeline-stats, /api/metrics/latest.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backtest, search, validation
from tidemark.plans import strategy
from tidemark.sources import store


class Service:
    def __init__(self, spark: SparkSession, bars: str | DataFrame, log: str):
        self.spark, self.log, self.jobs = spark, log, []
        self.of_bars = bars if isinstance(bars, DataFrame) else None
        self.path = bars

    def bars(self, request: dict) -> DataFrame:
        """Bars of the request's symbol (all, if it names none) from start_date to end_date."""
        symbols, start, end = [request["symbol"]] if request.get("symbol") else None, request.get("start_date"), request.get("end_date")
        if self.of_bars is None:
            return store.read_bars(self.spark, self.path, symbols, start, end)
        rows = self.of_bars if symbols is None else self.of_bars.where(F.col("symbol").isin(symbols))
        rows = rows if start is None else rows.where(F.col("ts") >= start)
        return rows if end is None else rows.where(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1))

    # ---- jobs
    def validate(self, request: dict) -> dict:
        made = strategy.template(request.get("template_name", "sma_crossover")).with_parameters(**request.get("parameters", {}))
        bars, n_trials = self.bars(request), int(request.get("n_trials", 1))
        found = validation.validate(bars, [made], n_trials, run_cpcv=bool(request.get("run_cpcv", True)), scenarios=list(validation.SYNTHETIC) if request.get("run_stress") else None)
        rows = [r.asDict() for r in found.collect()]
        figures = [r.asDict() for r in backtest.metrics(backtest.backtest(bars, [made])).collect()]
        return {"strategy_name": made.name, "passed": bool(rows) and all(r["passed"] for r in rows), "auto_accept": bool(rows) and all(r["auto_accept"] for r in rows), "validation": rows, "metrics": figures}

    def factory(self, request: dict) -> dict:
        fast, slow, low = search.Parameter("fast_period", 5, 30, whole=True), search.Parameter("slow_period", 40, 120, whole=True), search.Parameter("oversold", 15.0, 40.0)
        templates = {"sma_crossover": (strategy.sma_crossover, [fast, slow]), "rsi_mean_reversion": (strategy.rsi_mean_reversion, [low])}
        bars = self.bars(request)
        found = search.evolve(bars, templates, int(request.get("population_size", 30)), int(request.get("generations", 5)))
        best = [s for s, _ in found[: int(request.get("validate_top_n", 5))]]
        checked = {r["strategy_id"]: bool(r["ok"]) for r in validation.quick_validate(bars, best, len(found)).groupBy("strategy_id").agg(F.min("passed").alias("ok")).collect()}
        return {"strategies": [{"id": s.id, "name": s.name, "parameters": s.parameters, "fitness": v, "passed": checked.get(s.id)} for s, v in found[: int(request.get("target_strategies", 50))]]}

    def discovery(self, request: dict) -> dict:
        found = search.discover(self.bars(request), int(request.get("population_size", 100)), int(request.get("n_generations", 20)), min_sharpe=float(request.get("min_sharpe", 0.5)), max_complexity=float(request.get("max_complexity", 0.7)))
        figures = found.pbo(self.spark)
        return {"zoo": found.zoo, "weights": found.weights(), "history": found.history, "pbo": figures.first()["pbo"] if figures is not None else None}

    def start(self, kind: str, work: Callable[[dict], dict], request: dict) -> dict:
        key = uuid.uuid4().hex[:12]
        store.append(self.spark, self.log, kind, key, "pending", {"request": request})

        def run() -> None:
            try:
                store.append(self.spark, self.log, kind, key, "done", work(request))
            except Exception as e:  # a job's failure is its result
                store.append(self.spark, self.log, kind, key, "failed", {"error": str(e)[:1000]})

        job = threading.Thread(target=run, daemon=True)
        self.jobs.append(job)
        job.start()
        return {f"{kind}_id": key, "status": "pending"}

    # ---- lookups
    def rows(self) -> DataFrame:
        return self.spark.read.schema(store.LOG).parquet(self.log)

    def state(self, kind: str, key: str) -> dict | None:
        found = store.get(self.rows(), kind, key).first()
        return found and {f"{kind}_id": key, "status": found["status"], **json.loads(found["data"])}

    def strategies(self) -> list[dict]:
        """Validations that are done, with the mean of their figures over symbols."""
        out = []
        for r in store.listed(self.rows(), "validation").where("status = 'done'").collect():
            data = json.loads(r["data"])
            mean = lambda rows, k: sum(x[k] or 0.0 for x in rows) / max(1, len(rows))
            out.append({"id": r["id"], "name": data["strategy_name"], "type": "Template", "status": "approved" if data["passed"] else "rejected", "sharpe": mean(data["metrics"], "sharpe_ratio"), "dsr": mean(data["validation"], "dsr"), "annual_return": mean(data["metrics"], "annualized_return")})
        return out

    def get(self, path: str) -> tuple[int, object]:
        parts = path.strip("/").split("/")
        kinds = {"validate": "validation", "factory": "factory", "discovery": "discovery"}
        try:
            if parts == [""]:
                return 200, {"name": "tidemark", "status": "running"}
            if parts[:1] == ["api"] and len(parts) == 3 and parts[1] in kinds:
                found = self.state(kinds[parts[1]], parts[2])
                return (200, found) if found else (404, {"error": "no such id"})
            if path == "/api/templates":
                return 200, [{"name": n, "parameters": f().parameters} for n, f in strategy.TEMPLATES.items()]
            if path == "/api/strategies":
                return 200, self.strategies()
            if path == "/api/pipeline-stats":
                return 200, store.counters(self.rows()).first().asDict()
            if path == "/api/metrics/latest":
                done = self.strategies()
                return 200, {"validations": len(done), "approved": sum(s["status"] == "approved" for s in done), "best_sharpe": max((s["sharpe"] for s in done), default=None)}
            if path == "/api/system/status":
                return 200, {"spark": self.spark.version, "running": sum(j.is_alive() for j in self.jobs)}
        except AnalysisException:  # nothing has been logged yet
            return (404, {"error": "no such id"}) if len(parts) == 3 else (200, [] if path == "/api/strategies" else {})
        return 404, {"error": "no such path"}

    def post(self, path: str, request: dict) -> tuple[int, object]:
        works = {"/api/validate": ("validation", self.validate), "/api/factory": ("factory", self.factory), "/api/discovery": ("discovery", self.discovery)}
        if path not in works:
            return 404, {"error": "no such path"}
        if path == "/api/validate" and request.get("template_name", "sma_crossover") not in strategy.TEMPLATES:
            return 400, {"error": "unknown template"}
        return 200, self.start(*works[path], request)

    def server(self, port: int = 0) -> ThreadingHTTPServer:
        service = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self, status: int, body: object) -> None:
                text = json.dumps(body, default=str).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(text)))
                self.end_headers()
                self.wfile.write(text)

            def do_GET(self) -> None:
                self.answer(*service.get(self.path.split("?")[0]))

            def do_POST(self) -> None:
                try:
                    request = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                except ValueError:
                    return self.answer(400, {"error": "no JSON"})
                return self.answer(*service.post(self.path, request))

            def log_message(self, *_) -> None:
                pass

        return ThreadingHTTPServer(("127.0.0.1", port), Handler)

    def serve(self, port: int) -> None:
        self.server(port).serve_forever()
