"""Landed JSON as a stream: broken records set aside, duplicates across files once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feeds import FEED_SCHEMA, normalize_feed

CORRUPT = "corrupt_record"


def landed_stream(spark: SparkSession, path: str, schema: str = FEED_SCHEMA, files: int | None = None, array: bool = False) -> tuple[DataFrame, DataFrame]:
    """Streams (records, broken) over the JSON files that land in ``path``: one record a line or, with ``array``, one array a file.

    A record that is no JSON, or has a value of another type, is in ``broken`` with its text, its file and the fields that could be read (``partial``), and only there.
    """
    reader = spark.readStream.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE")
    if array:
        reader = reader.option("multiLine", "true")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    raw = reader.json(path).withColumn("file", F.col("_metadata.file_name"))
    return raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT), raw.where(F.col(CORRUPT).isNotNull()).select(CORRUPT, "file", F.struct(*[c for c in raw.columns if c not in (CORRUPT, "file")]).alias("partial"))


def once(records: DataFrame, time: str = "t", keys: Sequence[str] = ("stream", "t"), delay: str = "1 hour") -> DataFrame:
    """``records`` without repeats of ``keys`` within ``delay``; what is later than the watermark is left out, as are rows without a time."""
    d = records.where(F.col(time).isNotNull()).withColumn("event_ts", F.timestamp_micros((F.col(time) * 1e6).cast("long"))).withWatermark("event_ts", delay)
    return d.dropDuplicatesWithinWatermark(list(keys)).drop("event_ts")


def feed_stream(spark: SparkSession, path: str, delay: str = "1 hour", files: int | None = None, array: bool = False) -> tuple[DataFrame, DataFrame]:
    """Feed records as tidy samples, each (stream, t) once; and what is broken."""
    good, broken = landed_stream(spark, path, files=files, array=array)
    d = normalize_feed(good).withColumn("stream", F.concat_ws("-", F.col("satellite").cast("string"), "channel"))
    return once(d, delay=delay), broken
