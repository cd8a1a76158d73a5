"""Where queries and their SQL twins are collected, and the views that both read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone; the session's zone does not matter."""
    return F.expr("1").cast("long") * F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as tidy samples: event_id, stream, us, t (epoch seconds), value, k (the number in props), user_id."""
    us = micros(F.col("ts"))
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("stream"), us.alias("us"), (us / F.lit(1e6)).alias("t"), "value",
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"), "user_id",
    )


#: The same as a common table expression.
E = """e AS (SELECT event_id, event_type AS stream, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, user_id FROM events)"""


def events_as_flares(spark: SparkSession, sf_dir: str, least: float = 100.0) -> DataFrame:
    """Samples of value ``least`` or more as catalogue rows: t_start, t_peak, t_end (k minutes on), flux, rank, bits."""
    d = streams(spark, sf_dir).where(F.col("value") >= least)
    return d.select("event_id", "stream", "value", "k", F.col("t").alias("t_start"), (F.col("t") + F.lit(20.0) * F.col("k")).alias("t_peak"), (F.col("t") + F.lit(60.0) * F.col("k")).alias("t_end"))


FLARES = """f AS (SELECT event_id, stream, value, k, t AS t_start, t + 20.0 * k AS t_peak, t + 60.0 * k AS t_end FROM e WHERE value >= 100.0)"""


def r6(c: Column | str) -> Column:
    return F.round(c, 6)
