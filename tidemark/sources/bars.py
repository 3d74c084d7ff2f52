"""Bars from the driver tables, and macro-style revisions from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR = ["open", "high", "low", "close", "volume"]


def bars_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by return flag and line status; the price is the unit price, the order key says which comes first."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.date_trunc("day", "l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("q"), key.alias("key"),
    )
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("price", "key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "key").alias("close"), F.sum("q").alias("volume")
    )


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars by event type; the price is the event's value."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("hour"), F.col("value").alias("price"), F.struct("ts", "event_id").alias("key")
    )
    return rows.groupBy("symbol", F.col("hour").alias("ts")).agg(
        F.min_by("price", "key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "key").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


def pit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three releases of the day's order total by priority: 98, 99 and 100 % of it after 30, 60 and 90 days; each is valid until the next."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    total = orders.groupBy(F.col("o_orderpriority").alias("entity_id"), F.to_date("o_orderdate").alias("observation_date")).agg(F.sum("o_totalprice").alias("total"))
    revisions = F.explode(F.array(*[F.struct(F.lit(n).alias("revision_number"), F.lit(30 * (n + 1)).alias("lag"), F.lit(f).alias("factor")) for n, f in enumerate((0.98, 0.99, 1.0))]))
    rows = total.select("entity_id", "observation_date", "total", revisions.alias("r"))
    released = F.date_add("observation_date", F.col("r.lag"))
    return rows.select(
        "entity_id", F.lit("order_total").alias("indicator_name"), "observation_date", released.cast("timestamp").alias("release_date"), released.cast("timestamp").alias("transaction_time"),
        (F.col("total") * F.col("r.factor")).alias("value"), F.col("r.revision_number").alias("revision_number"), F.lit("orders").alias("source"),
        F.when(F.col("r.revision_number") < 2, F.date_add(released, 30).cast("timestamp")).alias("valid_to"),
    )
