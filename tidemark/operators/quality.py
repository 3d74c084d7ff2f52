"""Checks of bars, as one table of issues, and guards against looking ahead."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import by_symbol, change, div, lag

PRICES = ("open", "high", "low", "close")


def bad_ohlc_condition() -> Column:
    o, h, l, c = (F.col(p) for p in PRICES)  # noqa: E741
    return (h < l) | (h < o) | (h < c) | (l > o) | (l > c)


def bad_ohlc(df: DataFrame) -> DataFrame:
    return df.where(bad_ohlc_condition())


@dataclass(frozen=True)
class Check:
    """A check of rows: where it fires, the value it reports, and how many rows of a symbol it reports at most.

    Conditions see the row and the columns that _facts() adds.
    """

    name: str
    severity: str
    message: str
    when: Callable[[], Column]
    value: Callable[[], Column]
    most: int = 10


def _facts(df: DataFrame, sequence: str = "ingest_seq") -> DataFrame:
    """df with what the checks compare: the copy's number of a time, the time before in order of arrival, moves, gaps and medians."""
    whole = Window.partitionBy("symbol")
    arrived = F.lag("ts").over(whole.orderBy(sequence)) if sequence in df.columns else F.lit(None).cast("timestamp")
    out = df.withColumn("_copy", F.row_number().over(Window.partitionBy("symbol", "ts").orderBy("close", "volume"))).withColumn("_came_after", arrived)
    out = out.withColumn("_sequence", F.col(sequence).cast("double") if sequence in df.columns else F.lit(0.0))
    out = out.withColumn("_move", change("close")).withColumn("_gap", F.unix_timestamp("ts") - F.unix_timestamp(lag("ts")))
    return out.withColumn("_usual_gap", F.median("_gap").over(whole)).withColumn("_usual_volume", F.median("volume").over(whole))


def checks(most_move: float = 0.5, volume_times: float = 10.0, gap_times: float = 5.0) -> tuple[Check, ...]:
    col = lambda name: lambda: F.col(name)
    gone = lambda: sum((F.col(c).isNull().cast("int") for c in (*PRICES, "volume")), F.lit(0))
    least = lambda: F.least(*[F.col(c) for c in (*PRICES, "volume")])
    ratio = lambda: F.col("volume") / F.when(F.col("_usual_volume") != 0, F.col("_usual_volume"))
    return (
        Check("duplicate_timestamps", "CRITICAL", "time appears again", lambda: F.col("_copy") > 1, col("_copy")),
        Check("temporal_ordering", "CRITICAL", "time goes back", lambda: F.col("_came_after") > F.col("ts"), col("_sequence")),
        Check("ohlc_consistency", "ERROR", "prices contradict each other", bad_ohlc_condition, col("close")),
        Check("missing_data", "WARNING", "values are missing", lambda: gone() > 0, gone),
        Check("price_sanity", "WARNING", "price moved by more than half (per cent)", lambda: F.abs("_move") > most_move, lambda: F.col("_move") * 100),
        Check("volume_sanity", "INFO", "volume is a multiple of its median", lambda: ratio() > volume_times, ratio, 5),
        Check("large_gaps", "WARNING", "rows are far apart (days)", lambda: F.col("_gap") > gap_times * F.col("_usual_gap"), lambda: F.col("_gap") / 86400, 5),
        Check("zero_prices", "ERROR", "a price is zero", lambda: sum((F.coalesce((F.col(p) == 0).cast("int"), F.lit(0)) for p in PRICES), F.lit(0)) > 0, col("close")),
        Check("negative_values", "CRITICAL", "a value is negative", lambda: least() < 0, least),
    )


def issues(df: DataFrame, wanted: tuple[Check, ...] | None = None) -> DataFrame:
    """All checks in one pass: check_name, severity, message, symbol, date, value of the first rows of each symbol that each check finds."""
    wanted = checks() if wanted is None else wanted
    found = [F.when(c.when(), F.struct(F.lit(c.name).alias("check_name"), F.lit(c.severity).alias("severity"), F.lit(c.message).alias("message"), F.lit(c.most).alias("most"), c.value().cast("double").alias("value"))) for c in wanted]
    rows = _facts(df).select("symbol", "ts", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("symbol", "ts", "i.*")
    first = Window.partitionBy("symbol", "check_name").orderBy("ts", "value")
    rows = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= F.col("most"))
    return rows.select("check_name", "severity", "message", "symbol", F.col("ts").cast("date").alias("date"), "value")


def report(df: DataFrame) -> DataFrame:
    """Issues by symbol, with has_critical and has_errors (which warnings count as)."""
    found = issues(df).groupBy("symbol").agg(F.count(F.lit(1)).alias("issues"), F.max(F.col("severity") == "CRITICAL").alias("has_critical"), F.max(F.col("severity").isin("CRITICAL", "ERROR", "WARNING")).alias("has_errors"))
    return df.select("symbol").distinct().join(found, "symbol", "left").fillna(0, ["issues"]).fillna(False, ["has_critical", "has_errors"])


def require_quality(df: DataFrame, allow_warnings: bool = True) -> DataFrame:
    """df, or an error if a check is critical (or, when strict, an error or a warning)."""
    bad = issues(df).where(F.col("severity").isin(*(["CRITICAL"] if allow_warnings else ["CRITICAL", "ERROR", "WARNING"]))).take(1)
    if bad:
        raise ValueError(f"data quality: {bad[0]['check_name']} of {bad[0]['symbol']}: {bad[0]['message']}")
    return df


# ---- looking ahead ----------------------------------------------------------------------------------------------------------
def lookahead(df: DataFrame, feature: Callable[[DataFrame], DataFrame], column: str, prefixes: tuple[int, ...] = (), tolerance: float = 1e-6) -> DataFrame:
    """Rows where a feature on a prefix differs from the same row on all data; none for a causal feature.

    feature adds `column`. The prefixes are half the rows of each symbol and the given numbers of rows; all their rows are compared. A
    value on one side that is missing on the other is a difference: the prefix holds the whole past of its rows.
    """
    by = Window.partitionBy("symbol")
    numbered = df.withColumn("_n", F.row_number().over(by_symbol())).withColumn("_half", F.floor(F.count(F.lit(1)).over(by) / 2))
    whole = feature(numbered).select("symbol", "ts", F.col(column).cast("double").alias("_whole"))
    found = None
    for cut in (F.col("_half"), *map(F.lit, prefixes)):
        part = feature(numbered.where(F.col("_n") <= cut)).select("symbol", "ts", F.col(column).cast("double").alias("_part"), F.max("_n").over(by).alias("prefix_rows"))
        apart = F.coalesce(F.abs(F.col("_part") - F.col("_whole")) > tolerance, F.col("_part").isNull() != F.col("_whole").isNull())
        rows = part.join(whole, ["symbol", "ts"]).where(apart)
        found = rows if found is None else found.unionByName(rows)
    return found.select("symbol", F.col("prefix_rows").cast("int"), "ts", F.col("_part").alias("prefix_value"), F.col("_whole").alias("full_value"))


def feature_rules(column: str = "close", n: int = 20) -> dict[str, tuple[bool, Column]]:
    """Pairs of features by name: whether it is causal, and its column over by_symbol(). The second of each pair looks ahead."""
    w, everything = by_symbol(), Window.partitionBy("symbol")
    trailing, centred = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-(n // 2), (n - 1) // 2)
    z = lambda over: div(F.col(column) - F.avg(column).over(over), F.stddev_samp(column).over(over))
    return {
        "rolling_mean": (True, F.avg(column).over(trailing)), "centred_mean": (False, F.avg(column).over(centred)),
        "expanding_mean": (True, F.avg(column).over(w.rowsBetween(Window.unboundedPreceding, 0))), "full_mean": (False, F.avg(column).over(everything)),
        "lag": (True, F.lag(column).over(w)), "lead": (False, F.lead(column).over(w)),
        "rolling_z_score": (True, z(trailing)), "full_z_score": (False, z(everything)),
    }


def require_causal(df: DataFrame, feature: Callable[[DataFrame], DataFrame], column: str) -> None:
    if bad := lookahead(df, feature, column, (10, 15, 20)).take(1):
        raise ValueError(f"{column} looks ahead: {bad[0]}")


# ---- language models --------------------------------------------------------------------------------------------------------
#: Questions whose answers were not known before a date: date, question, answer. Fixed values of our own.
CANARIES = (
    ("2020-11-07", "Who won the United States presidential election of 2020?", "Joe Biden"),
    ("2021-08-08", "Which country won most gold medals at the Tokyo Olympics?", "United States"),
    ("2022-02-24", "On which day did the Russian invasion of Ukraine begin?", "February 24, 2022"),
    ("2022-12-18", "Which team won the football World Cup in Qatar?", "Argentina"),
    ("2023-03-10", "Which large Californian bank failed in March 2023?", "Silicon Valley Bank"),
)


def knows_future(response: str, answer: str) -> bool:
    """Whether the response has as many of the answer's words of more than three letters as half of all its words."""
    words = answer.lower().split()
    return bool(words) and sum(len(w) > 3 and w in response.lower() for w in words) * 2 >= len(words)


def isolation(ask: Callable[[str], str], cutoff: str, canaries=CANARIES) -> list[dict]:
    """For each question about what happened after the cutoff: what the model says, and whether it knows."""
    return [{"day": day, "question": q, "response": (said := ask(q)), "leaks": knows_future(said, answer)} for day, q, answer in canaries if day > cutoff]


def mock_model(known_until: str, canaries=CANARIES) -> Callable[[str], str]:
    """A stand-in for a model: it answers what happened up to a day, and says of the rest that it does not know."""
    known = {q: answer for day, q, answer in canaries if day <= known_until}
    return lambda question: known.get(question, "I do not know.")


def leaking_canaries(ask: Callable[[str], str], cutoff: str, canaries=CANARIES) -> list[str]:
    """Questions about what happened after the cutoff that a model answers."""
    return [x["question"] for x in isolation(ask, cutoff, canaries) if x["leaks"]]


def require_temporal_safety(ask: Callable[[str], str], cutoff: str) -> None:
    if leaks := leaking_canaries(ask, cutoff):
        raise ValueError(f"the model knows what came after {cutoff}: {leaks}")


def text_feature(df: DataFrame, score: Callable, text: str, ts: str, cutoff: str, name: str = "sentiment") -> DataFrame:
    """df with a model's score of a text column, by Arrow batches; texts later than the model's cutoff are an error."""
    if df.where(F.col(ts) > F.lit(cutoff).cast("timestamp")).take(1):
        raise ValueError(f"texts are later than the model's cutoff {cutoff}")

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(score).astype(float)

    return df.withColumn(name, scored(text))


def text_events(df: DataFrame, extract: Callable[[str], tuple[str, float]], text: str, ts: str, cutoff: str) -> DataFrame:
    """df with event_type and confidence that a model finds in a text column, by Arrow batches; null texts have the event `none`."""
    if df.where(F.col(ts) > F.lit(cutoff).cast("timestamp")).take(1):
        raise ValueError(f"texts are later than the model's cutoff {cutoff}")

    @F.pandas_udf("event_type string, confidence double")
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([("none", 0.0) if t is None else extract(t) for t in texts], columns=["event_type", "confidence"])

    return df.withColumn("_event", found(text)).select("*", "_event.event_type", "_event.confidence").drop("_event")


def require_text_feature(df: DataFrame, feature: Callable[[DataFrame], DataFrame], ask: Callable[[str], str], ts: str, cutoff: str) -> DataFrame:
    """feature(df), if the model behind it knows nothing of what came after its cutoff."""
    require_temporal_safety(ask, cutoff)
    return feature(df)
