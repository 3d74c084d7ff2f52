"""Stored tables: bars and features by symbol, and append-only logs of runs whose latest row counts."""

from __future__ import annotations

import atexit
import hashlib
import json
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BARS = StructType().add("symbol", "string").add("ts", "timestamp").add("open", "double").add("high", "double").add("low", "double").add("close", "double").add("volume", "double")
LOG = StructType().add("kind", "string").add("id", "string").add("ts", "timestamp").add("status", "string").add("data", "string")
RUNS = "run_id string, ts timestamp, params map<string,string>, metrics map<string,double>, tags map<string,string>"


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: spark.checkpoint.dir. Only a local master without it gets a temporary folder, for as long as Python runs."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext not in _LOCAL:
        _LOCAL[spark.sparkContext] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _LOCAL[spark.sparkContext], ignore_errors=True)
    return _LOCAL[spark.sparkContext]


_LOCAL: dict = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df worked out once, as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """By symbol; a symbol that is written again replaces its own partition only."""
    bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """One scan; symbols prune partitions, dates (both included) reach the Parquet filters. Having no row is an error."""
    rows = spark.read.parquet(path)
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin(*symbols))
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("ts") < F.lit(end).cast("timestamp") + F.expr("interval 1 day"))
    rows = rows.select(*BARS.fieldNames())
    if not rows.take(1):
        raise ValueError(f"no bars for {symbols} from {start} to {end}")
    return rows


def _path(spark: SparkSession, path: str):
    """A path of any store that Spark reads, and its file system."""
    out = spark._jvm.org.apache.hadoop.fs.Path(path)
    return out, out.getFileSystem(spark._jsc.hadoopConfiguration())


def clear_bars(spark: SparkSession, path: str, symbol: str | None = None) -> bool:
    """Deletes the bars of a symbol, or of all; whether there were any."""
    where, files = _path(spark, path if symbol is None else f"{path}/symbol={symbol}")
    return bool(files.delete(where, True))


def describe_bars(spark: SparkSession, path: str, fetched: str) -> DataFrame:
    """The side table of stored bars, `<path>.about`, written anew: of each symbol its rows, first and last time, and when it was fetched."""
    about = spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end")).withColumn("fetched", F.lit(fetched))
    about.coalesce(1).write.mode("overwrite").json(f"{path}.about")
    return spark.read.schema(about.schema).json(f"{path}.about")


def fresh_symbols(about: DataFrame, wanted_end: str, today: str, expiry_days: int = 1) -> DataFrame:
    """symbol and fresh: is_fresh() for each symbol of a side table."""
    old, lately = F.datediff(F.lit(today), F.lit(wanted_end)) > 30, F.datediff(F.lit(today), F.col("fetched")) <= expiry_days
    return about.select("symbol", ((F.to_date("end") >= F.lit(wanted_end).cast("date")) & (old | lately)).alias("fresh"))


class Pace:
    """At most so many calls a minute: wait() sleeps until the next one may start."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next = 60 / per_minute, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def cache_key(symbol: str, start: str, end: str) -> str:
    return hashlib.md5(f"{symbol}_{start}_{end}".encode()).hexdigest()[:12]


def is_fresh(cached_end: str, wanted_end: str, fetched: str, today: str, expiry_days: int = 1) -> bool:
    """Whether a cached range still serves: it reaches the wanted end, and is old history or was fetched lately."""
    from datetime import date

    day = date.fromisoformat
    if day(cached_end) < day(wanted_end):
        return False
    return (day(today) - day(wanted_end)).days > 30 or (day(today) - day(fetched)).days <= expiry_days


def write_features(features: DataFrame, path: str, feature_set: str = "default") -> None:
    rows = features.withColumn("feature_set", F.lit(feature_set))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature_set", "symbol").parquet(path)


def read_features(spark: SparkSession, path: str, symbol: str, feature_set: str = "default") -> DataFrame | None:
    """None if there are none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path).where((F.col("feature_set") == feature_set) & (F.col("symbol") == symbol))
    except AnalysisException:
        return None
    return rows if rows.take(1) else None


def append(spark: SparkSession, path: str, kind: str, key: str, status: str, data: dict) -> None:
    """A row of the log; get() and listed() see the latest of each id."""
    text = json.dumps(data, default=str, allow_nan=True).replace("NaN", "null").replace("-Infinity", "null").replace("Infinity", "null")
    spark.range(1).select(F.lit(kind).alias("kind"), F.lit(key).alias("id"), F.current_timestamp().alias("ts"), F.lit(status).alias("status"), F.lit(text).alias("data")).write.mode("append").parquet(path)


def latest(log: DataFrame) -> DataFrame:
    newest = Window.partitionBy("kind", "id").orderBy(F.col("ts").desc())
    return log.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def get(log: DataFrame, kind: str, key: str) -> DataFrame:
    return latest(log.where((F.col("kind") == kind) & (F.col("id") == key)))


def listed(log: DataFrame, kind: str) -> DataFrame:
    return latest(log.where(F.col("kind") == kind)).orderBy(F.col("ts").desc())


def counters(log: DataFrame) -> DataFrame:
    """The funnel of a run log: how many of each stage there are, and each as a share of the one before (in per cent)."""
    own = latest(log)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = own.agg(
        count(F.col("kind") == "factory").alias("generated"), count((F.col("kind") == "validation") & (F.col("status") != "pending")).alias("validated"),
        count((F.col("kind") == "validation") & (F.get_json_object("data", "$.passed") == "true")).alias("passed"), count(F.col("kind") == "deployment").alias("deployed"),
    )
    rate = lambda a, b: (100.0 * F.col(a) / F.greatest(F.lit(1), F.col(b))).alias(f"{a}_rate")
    return out.select("*", rate("validated", "generated"), rate("passed", "validated"), rate("deployed", "passed"))


def logged_runs(metrics: DataFrame, params: dict[str, str], passed: Column, tags: dict[str, str] | None = None) -> DataFrame:
    """Rows for the table of runs (RUNS) from metrics of strategies: one run per strategy and symbol, tagged with whether it passed."""
    names = [n for n, kind in metrics.dtypes if kind in ("double", "bigint", "int")]
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    fixed = [x for k, v in (tags or {}).items() for x in (F.lit(k), F.lit(v))]
    return metrics.select(
        F.concat_ws("|", "strategy_id", "symbol").alias("run_id"), F.current_timestamp().alias("ts"), F.create_map(*[F.lit(x) for kv in params.items() for x in kv]).alias("params"),
        F.create_map(*pairs).alias("metrics"), F.create_map(F.lit("passed"), passed.cast("string"), *fixed).alias("tags"),
    )


def leaderboard(runs: DataFrame, metric: str = "sharpe_ratio", n: int = 10, passed: bool = True) -> DataFrame:
    rows = runs.where(F.col("tags")["passed"] == "true") if passed else runs
    return rows.orderBy(F.col("metrics")[metric].desc_nulls_last(), "run_id").limit(n)


def compare(runs: DataFrame, ids: list[str], metrics: tuple[str, ...] = ("sharpe_ratio", "total_return", "max_drawdown", "win_rate", "num_trades")) -> DataFrame:
    return runs.where(F.col("run_id").isin(*ids)).select("run_id", *[F.col("metrics")[m].alias(m) for m in metrics])
