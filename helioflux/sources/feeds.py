"""Readers and adapters of feeds: JSON, CSV, time scans, and sources that stand in for one another."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import QC_BITS
from ..functions import scalar as X

FEED_SCHEMA = "time_tag string, satellite int, flux double, observed_flux double, electron_correction double, electron_contaminaton boolean, energy string"
ALIASES = {"t": ("t", "time", "time_tag", "timestamp"), "sxr": ("sxr", "sxr_long", "S", "soft", "solexs"), "sxr_short": ("sxr_short", "short"), "hxr": ("hxr", "H", "hard", "hel1os", "hxr_8_30")}


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A cached feed: one JSON array per file."""
    return spark.read.schema(FEED_SCHEMA).json(path, multiLine=True)


def write_feed(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def parse_time(c: Column) -> Column:
    """Epoch seconds of an ISO time; without a zone it is UTC. Null if it is no time."""
    text = F.regexp_replace(c, r"(Z|[+-]00:?00)$", "")
    ntz = F.coalesce(*[F.try_to_timestamp(F.concat(F.regexp_replace(text, "[T ]", " "), F.lit("+00:00")), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mmXXX")])
    return F.unix_micros(ntz) / F.lit(1e6)


def normalize_feed(raw: DataFrame) -> DataFrame:
    """Feed records as tidy samples: channel, quantity, value (the observed flux, else the flux), unit, qc; rows without a value go.

    Records of the long channel carry the class of their value, ``goes_class``; those of the short one have none.
    """
    long = F.col("energy").startswith("0.1")
    value = F.coalesce("observed_flux", "flux")
    d = raw.withColumns({
        "t": parse_time(F.col("time_tag")),
        "channel": F.when(long, "long").otherwise("short"),
        "quantity": F.when(long, "SXR_LONG").otherwise("SXR_SHORT"),
        "value": value,
        "unit": F.lit("W m^-2"),
        "qc": F.when(F.coalesce("electron_contaminaton", F.lit(False)), QC_BITS["SUSPECT"]).otherwise(QC_BITS["GOOD"]).cast("int"),
    })
    return d.where(F.col("value") > 0).withColumn("goes_class", F.when(long, X.goes_class(F.col("value"))))


def normalize_generic(raw: DataFrame, time: str = "t", value: str = "value", stream: str = "generic", unit: str = "counts/s", quantity: str = "HXR") -> DataFrame:
    """Any flat table with a time (epoch seconds or ISO text) and a value."""
    t = F.col(time).cast("double") if dict(raw.dtypes)[time] != "string" else F.coalesce(F.col(time).try_cast("double"), parse_time(F.col(time)))
    return raw.select(F.lit(stream).alias("stream"), t.alias("t"), F.col(value).cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(quantity).alias("quantity"), F.lit(1).alias("qc"))


def light_curve(df: DataFrame) -> DataFrame:
    """A wide light curve under its standard names, whichever known header it came with."""
    lower = {c.lower(): c for c in df.columns}
    out = []
    for name, known in ALIASES.items():
        have = [F.col(lower[a.lower()]) for a in known if a.lower() in lower]
        if have:
            out.append(F.coalesce(*have).alias(name))
    return df.select(*out)


def read_light_curve(spark: SparkSession, path: str) -> DataFrame:
    """A light curve file or folder (.csv with a header, else JSON lines) under its standard names: t in epoch seconds, channels as doubles.

    Rows without a time go; a file without a time column is an error.
    """
    raw = spark.read.option("header", "true").csv(path) if path.rstrip("/").lower().endswith(".csv") else spark.read.json(path)
    d = light_curve(raw)
    if "t" not in d.columns:
        raise ValueError(f"{path} has no time column")
    t = F.col("t").cast("string")
    return d.select(F.coalesce(t.try_cast("double"), parse_time(t)).alias("t"), *[F.col(c).cast("string").try_cast("double").alias(c) for c in d.columns if c != "t"]).where("t is not null")


def time_scan(df: DataFrame, t0: float, t1: float, t: str = "t") -> DataFrame:
    """Rows with t0 <= t < t1; on Parquet with a plain time column the bounds reach the row groups."""
    return df.where((F.col(t) >= t0) & (F.col(t) < t1))


def mission_seconds(t: Column, mjdref: float, timezero: float = 0.0) -> Column:
    """Unix seconds of a mission clock that starts at a modified Julian date."""
    return F.lit((mjdref - 40587.0) * 86400.0 + timezero) + t


def first_available(sources: Sequence[Callable[[], DataFrame]], errors: tuple[type[Exception], ...] = (Exception,)) -> DataFrame:
    """The first source that can be read and has rows; the last error if there is none."""
    last: Exception | None = None
    for make in sources:
        try:
            df = make()
            if df.take(1):  # a whole row, so that what breaks in any column is seen
                return df
        except errors as x:
            last = x
    raise last or LookupError("no source has rows")
