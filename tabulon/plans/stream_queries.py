"""Queries of the streaming forms, run over the events that are there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.values import number, text
from tabulon.operators.criteria import averageifs, countifs, criterion, sumifs
from tabulon.plans.formula import with_formula
from tabulon.streaming.windows import drain, read_stream, windowed


def _instant(column: str) -> Column:
    """A time without zone as the instant that reads the same in UTC, whatever the session's zone is."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, their time as an instant."""
    like = spark.read.parquet(f"{sf_dir}/events.parquet")
    return read_stream(spark, sf_dir, "events.parquet", like).withColumn("ts", _instant("ts"))


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas row by row on a stream."""
    rows = with_formula(_events(spark, sf_dir), "shown", '=IF(v>=50,UPPER(kind)&"!",ROUND(v,1))', {"v": number("value"), "kind": text("event_type")})
    return drain(rows.select("event_id", "shown", F.col("shown_error").alias("error")))


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUMIFS, COUNTIFS and AVERAGEIFS by day and kind, over all windows that are closed."""
    big = criterion(F.col("value"), "number", ">=50")
    mean = averageifs(F.col("value").cast("double"), big)
    closed = windowed(
        _events(spark, sf_dir), "ts", width="1 day", late="2 hours", by=["event_type"],
        total=F.round(sumifs(F.col("value"), big), 4), n=countifs(big), mean=F.round(mean.v, 9), error=mean.e,
    )
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg((F.max(_instant("ts")) - F.expr("INTERVAL 2 HOURS")).alias("_mark"))
    found = drain(closed)
    # what a batch closes depends on the watermark, which is known: windows that end by it
    return found.join(F.broadcast(last), F.col("end") <= F.col("_mark")).select(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("start") / 86400).cast("int")).cast("string").alias("day"), "event_type", "total", "n", "mean", "error")


_HOURS_SQL = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, round(coalesce(sum(value) FILTER (WHERE value >= 50), 0), 4) AS total, count(*) FILTER (WHERE value >= 50) AS n,
       round(avg(value) FILTER (WHERE value >= 50), 9) AS mean, CASE WHEN count(*) FILTER (WHERE value >= 50) = 0 THEN '#DIV/0!' END AS error
FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY 1, 2
"""
_AMOUNTS_SQL = """
SELECT event_id, CASE WHEN value >= 50 THEN upper(event_type) || '!' ELSE replace(rtrim(printf('%.1f', round(value::DECIMAL(18,6), 1)), '0') || ';', '.;', '') END AS shown, NULL::VARCHAR AS error FROM events
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"stream_formula": _amounts, "stream_daily_sumifs": _hours}


def oracle_sql() -> dict[str, str]:
    return {"stream_formula": _AMOUNTS_SQL.replace("';', '.;', '')", "';', '.;', ''), ';', '')").replace("ELSE replace(", "ELSE replace(replace("), "stream_daily_sumifs": _HOURS_SQL}
