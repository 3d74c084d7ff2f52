"""Point-in-time views: what was known at a moment, from bars and from revised observations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import by_symbol, change, lag
from tidemark.functions.indicators import features

_SERIES = ["entity_id", "indicator_name", "observation_date"]


def as_of(bars: DataFrame, moment, delay: dt.timedelta = dt.timedelta(0), lookback: int | None = None) -> DataFrame:
    """Rows known at the moment: released by then (release_ts where it exists, else ts plus the delay); the last `lookback` of a symbol."""
    known = F.coalesce("release_ts", F.col("ts") + F.lit(delay)) if "release_ts" in bars.columns else F.col("ts") + F.lit(delay)
    rows = bars.where(known <= F.lit(moment).cast("timestamp"))
    if lookback is None:
        return rows
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= lookback).drop("_r")


def latest(bars: DataFrame, moment, delay: dt.timedelta = dt.timedelta(0)) -> DataFrame:
    """The last known row of each symbol, by one aggregation."""
    rest = [c for c in bars.columns if c not in ("symbol",)]
    picked = as_of(bars, moment, delay).groupBy("symbol").agg(F.max_by(F.struct(*rest), "ts").alias("_row"))
    return picked.select("symbol", "_row.*")


def known_returns(bars: DataFrame, moment, lookback: int = 252, logs: bool = False) -> DataFrame:
    rows = as_of(bars, moment, lookback=lookback + 1)
    value = F.log(F.try_divide(F.col("close"), lag("close"))) if logs else change("close")
    return rows.select("symbol", "ts", value.alias("ret")).where(F.col("ret").isNotNull())


def features_as_of(bars: DataFrame, moment, names: list[str] | None = None, lookback: int | None = None, delay: dt.timedelta = dt.timedelta(0)) -> DataFrame:
    """Named features of what was known at the moment: the cut comes first, so windows see no row after it."""
    return features(as_of(bars, moment, delay, lookback), names)


def feature_matrix(bars: DataFrame, moment, names: list[str], dropna: bool = True) -> DataFrame:
    """symbol, ts and the features; rows that lack one are left out unless dropna is False."""
    rows = features_as_of(bars, moment, names).select("symbol", "ts", *names)
    return rows.dropna() if dropna else rows


def rolling_windows(bars: DataFrame, size: int, step: int = 1) -> DataFrame:
    """Every sliding window as rows: window_id and the bars in it. Only windows that a row is in are listed for it."""
    n = F.row_number().over(by_symbol()) - 1
    rows = bars.withColumn("_n", n).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    first = F.greatest(F.lit(0), F.ceil((F.col("_n") - size + 1) / step)).cast("int")
    last = F.least(F.floor(F.col("_n") / step), F.floor((F.col("_all") - size) / step)).cast("int")
    return rows.where(F.col("_all") >= size).withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last)))).drop("_n", "_all")


def expanding_sizes(bars: DataFrame, at_least: int = 252) -> DataFrame:
    """The expanding prefixes, left lazy: each row with how many rows its prefix has, from at_least on."""
    return bars.withColumn("prefix_rows", F.row_number().over(by_symbol())).where(F.col("prefix_rows") >= at_least)


def pit_value(revisions: DataFrame, moment) -> DataFrame:
    """The value of each observation as known at the moment: released by then, not replaced yet, the latest release and revision."""
    at = F.lit(moment).cast("timestamp")
    known = revisions.where((F.col("release_date") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    order = F.struct("release_date", "revision_number")
    return known.groupBy(*_SERIES).agg(F.max_by("value", order).alias("value"), F.max_by("release_date", order).alias("release_date"), F.max_by("revision_number", order).alias("revision_number"))


def pit_join(keys: DataFrame, revisions: DataFrame) -> DataFrame:
    """For rows (entity_id, as_of): the newest observation known then. One shuffle by entity: releases and questions are merged in order
    of time, and the last release carries over; nothing is paired."""
    asked = keys.select("entity_id", F.col("as_of").alias("_t"), F.lit(1).alias("_q"), F.lit(None).cast("struct<observation_date:date,revision_number:int,value:double>").alias("_v"))
    told = revisions.select("entity_id", F.col("release_date").alias("_t"), F.lit(0).alias("_q"), F.struct("observation_date", "revision_number", "value").alias("_v"))
    order = Window.partitionBy("entity_id").orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(told).withColumn("_best", F.max("_v").over(order))
    return both.where(F.col("_q") == 1).select("entity_id", F.col("_t").alias("as_of"), F.col("_best.observation_date").alias("observation_date"), F.col("_best.value").alias("value"))


def latest_revision(revisions: DataFrame) -> DataFrame:
    """The last revision of each observation; looks ahead, not for backtests."""
    return revisions.groupBy(*_SERIES).agg(F.max_by("value", "revision_number").alias("value"), F.max("revision_number").alias("revision_number"))


def revision_history(revisions: DataFrame, entity: str, observed) -> DataFrame:
    return revisions.where((F.col("entity_id") == entity) & (F.col("observation_date") == F.lit(observed).cast("date"))).orderBy("release_date", "revision_number")


def bad_revisions(revisions: DataFrame) -> DataFrame:
    """Rows that break the order of times: recorded before their release, or released before what they revise."""
    order = Window.partitionBy(*_SERIES).orderBy("revision_number")
    before = F.lag("release_date").over(order)
    return revisions.withColumn("_before", before).where((F.col("transaction_time") < F.col("release_date")) | (F.col("release_date") < F.col("_before"))).drop("_before")


def insert(store: DataFrame, rows: DataFrame) -> DataFrame:
    """store with rows appended, after a check of all of them."""
    out = store.unionByName(rows)
    if bad := bad_revisions(out).take(1):
        raise ValueError(f"revision out of order: {bad[0]}")
    return out


#: Days after which a macro series is released, by its frequency. Fixed values.
RELEASE_LAG = {"Q": 30, "M": 15, "D": 0, "W": 0}


def mock_vintages(spark, series: dict[str, str], start: str, end: str, vintage: str) -> DataFrame:
    """Deterministic observations (series_id, observation_date, value) that a vintage date knows; series: id to frequency D, W, M or Q."""
    step = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month", "Q": "interval 3 months"}
    out = None
    for name, frequency in series.items():
        dates = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', {step[frequency]})")).alias("observation_date"))
        known = dates.where(F.date_add("observation_date", RELEASE_LAG[frequency]) <= F.lit(vintage).cast("date"))
        place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}_"), F.col("observation_date").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double")
        rows = known.select(F.lit(name).alias("series_id"), "observation_date", (100 * place / 2.0**32).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def vintages_of(rows: DataFrame) -> DataFrame:
    """The three releases of each quarterly observation, after 30, 60 and 90 days, at 98, 99 and 100 % of the value."""
    releases = F.explode(F.array(*[F.struct(F.lit(30 * (n + 1)).alias("days"), F.lit(f).alias("factor"), F.lit(n).alias("revision_number")) for n, f in enumerate((0.98, 0.99, 1.0))]))
    rows = rows.select("*", releases.alias("_r"))
    return rows.select(
        *[c for c in rows.columns if c not in ("_r", "value")], F.date_add("observation_date", F.col("_r.days")).alias("release_date"), (F.col("value") * F.col("_r.factor")).alias("value"), F.col("_r.revision_number").alias("revision_number")
    )


def synced(store: DataFrame, rows: DataFrame, entity: str = "US_MACRO", source: str = "VINTAGES") -> DataFrame:
    """store with vintages (series_id, observation_date, release_date, value, revision_number) appended as revisions."""
    new = rows.select(
        F.lit(entity).alias("entity_id"), F.col("series_id").alias("indicator_name"), "observation_date", F.col("release_date").cast("timestamp").alias("release_date"),
        F.col("release_date").cast("timestamp").alias("transaction_time"), "value", "revision_number", F.lit(source).alias("source"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    return insert(store, new)


def latest_vintages(rows: DataFrame, day: str, most: int = 36) -> DataFrame:
    """What a daily run takes up: of vintages (series_id, observation_date, release_date, ...) that are out on a day, each series' last `most` observations."""
    out = rows.where(F.col("release_date") <= F.lit(day).cast("date"))
    newest = F.dense_rank().over(Window.partitionBy("series_id").orderBy(F.col("observation_date").desc()))
    return out.withColumn("_n", newest).where(F.col("_n") <= most).drop("_n")


def daily_sync(store: DataFrame, rows: DataFrame, day: str, most: int = 36, entity: str = "US_MACRO") -> DataFrame:
    """store with the revisions of latest_vintages() that it does not hold yet."""
    key = ["indicator_name", "observation_date", "revision_number"]
    held = store.where(F.col("entity_id") == entity).select(F.col("indicator_name").alias("series_id"), *key[1:])
    return synced(store, latest_vintages(rows, day, most).join(held, ["series_id", *key[1:]], "left_anti"), entity)
