"""Records of the catalogue, of alerts and of samples, and summaries of detections against truth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalar as X

#: Peak counts a second that the hard band adds for a flare of each class.
HARD_SCALE = {"A": 200.0, "B": 600.0, "C": 2.0e3, "M": 1.2e4, "X": 6.0e4}


# --- reads -----------------------------------------------------------------------------------------------------------------
def by_class(events: DataFrame, letter: str, cls: str = "goes_class") -> DataFrame:
    """Events whose class starts with the letter, upper or lower case."""
    return events.where(F.upper(F.substring(cls, 1, 1)) == letter[:1].upper())


def get(events: DataFrame, event_id: object, key: str = "event_id") -> DataFrame:
    return events.where(F.col(key) == event_id)


def all_events(events: DataFrame) -> DataFrame:
    return events.orderBy("t_peak", "event_id")


def count(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("n"))


def in_order(samples: DataFrame, t: str = "t", stream: str = "stream") -> DataFrame:
    """Samples by time, those of one time by stream."""
    return samples.orderBy(t, stream)


def union_in_order(a: Column, b: Column) -> Column:
    """The elements of both lists, each once, where it comes first; a null list is empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def event_fields(events: DataFrame) -> DataFrame:
    """Events of any shape with t_peak, goes_class (``cls`` where there is none, C1.0 without either), t_start and t_end."""
    have = set(events.columns)
    if "t_peak" not in have:
        raise ValueError("events need a column t_peak")
    known = [F.col(c).cast("string") for c in ("goes_class", "cls") if c in have]
    bound = lambda c: (F.col(c) if c in have else F.lit(None)).cast("double")
    return events.withColumns({"t_peak": F.col("t_peak").cast("double"), "goes_class": F.coalesce(*known, F.lit("C1.0")), "t_start": bound("t_start"), "t_end": bound("t_end")})


def event_list(events: DataFrame, least: str = "C1.0", cls: str = "fl_goescls", observatory: str = "obs_observatory") -> DataFrame:
    """Rows of an event list whose class comes after ``least`` as text (so M10.0 comes before M2.0), of the GOES observatory, with the known columns."""
    wanted = ("event_starttime", "event_peaktime", "event_endtime", cls, "hpc_x", "hpc_y", "ar_noaanum")
    d = events.where((F.col(cls) > least) & (F.col(observatory) == "GOES"))
    return d.select(*[c for c in wanted if c in events.columns])


# --- records -----------------------------------------------------------------------------------------------------------------
def nest_catalogue(flat: DataFrame) -> DataFrame:
    """Flat catalogue rows as nested events: seconds, sub-records of the bands that detected, flags, detectors and reference."""
    on = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    seconds = lambda c: (F.col(c) / 1000.0).alias(c)
    return flat.select(
        "event_id", seconds("t_start"), seconds("t_peak"), seconds("t_end"), "goes_class",
        F.when(on("soft_detected"), F.struct(F.lit(True).alias("detected"), "peak_flux_goes_equiv", "detector_used")).alias("soft"),
        F.when(on("hard_detected"), F.struct(F.lit(True).alias("detected"), F.col("hxr_peak_counts").alias("peak_counts"))).alias("hard"),
        F.struct(on("soft_detected").alias("soft"), on("hard_detected").alias("hard"), on("neupert_consistent").alias("neupert_consistent")).alias("flags"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce(F.from_json("detectors", "array<string>"), F.array().cast("array<string>")).alias("detectors"),
        F.when(F.col("ref_catalog").isNotNull(), F.struct(F.col("ref_catalog").alias("catalog"), F.col("ref_id").alias("id"))).alias("ref_match"),
    )


def alerts(found: DataFrame, kind: str = "nowcast") -> DataFrame:
    """Alert records, as JSON in ``alert``, of detector rows (stream, band, onset, peak, end, onset_time, statistic, goes_class, peak_flux, detectors)."""
    severity = F.upper(F.substring(F.when(F.col("goes_class") != "", F.col("goes_class")), 1, 1))
    record = F.struct(
        F.lit(kind).alias("kind"), "stream", "band", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("onset", "peak", "end")], "onset_time", "statistic", "goes_class", "peak_flux",
        severity.alias("severity"), F.coalesce("detectors", F.array().cast("array<string>")).alias("detectors"), F.col("onset_time").alias("t"),
    )
    return found.withColumn("severity", severity).withColumn("alert", F.to_json(record, {"ignoreNullFields": "false"}))


def latest_alert(alerts_: DataFrame, stream: str | None = None) -> DataFrame:
    """The newest alert of a stream, or of all where that stream has none; one row at most."""
    own = alerts_.where(F.col("stream") == stream) if stream else alerts_.where("false")
    best = lambda d, rank: d.agg(F.max_by(F.struct(*alerts_.columns), F.struct("onset_time", "alert")).alias("_r")).where("_r is not null").withColumn("_k", F.lit(rank))
    return best(own, 0).unionByName(best(alerts_, 1)).orderBy("_k").limit(1).select("_r.*")


def to_samples(df: DataFrame, stream: str, quantity: str, payload: str | None = None) -> DataFrame:
    """A light curve (t, value and whatever else) as tidy samples; the other columns go into the map ``meta`` as text."""
    if not {"t", "value"} <= set(df.columns):
        raise ValueError("samples need the columns t and value")
    unit = K.CANONICAL_UNITS["SXR_LONG"] if quantity in ("SXR_LONG", "SXR_SHORT") else K.CANONICAL_UNITS["HXR"]
    extra = [c for c in df.columns if c not in ("t", "value")]
    meta = F.create_map(*[x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]) if extra else F.lit(None).cast("map<string,string>")
    source = f"AdityaL1-{payload}" if payload else "AdityaL1"
    return df.select(
        F.lit(stream).alias("stream"), F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(source).alias("source"),
        F.lit(quantity).alias("quantity"), F.lit(None).cast("string").alias("cls"), F.lit(K.QC_BITS["GOOD"]).alias("qc"), meta.alias("meta"),
    )


# --- summaries -----------------------------------------------------------------------------------------------------------------
def pod_by_letter(rows: DataFrame, cls: str = "truth_class", hit: str = "matched") -> DataFrame:
    """Per class letter of the truth: how many were there, how many detected, and the share; rows without a class are false alarms."""
    d = rows.where(F.col(cls).isNotNull()).groupBy(F.upper(F.substring(cls, 1, 1)).alias("letter"))
    return d.agg(F.count("*").alias("n_truth"), F.count_if(hit).alias("n_detected")).withColumn("pod", F.col("n_detected") / F.col("n_truth"))


def detection_summary(rows: DataFrame, cls: str = "truth_class", hit: str = "matched", false_alarm: str = "false_alarm") -> DataFrame:
    """Truth, matches and false alarms over all rows, probability of detection and false-alarm ratio (0 where nothing is there)."""
    real = F.col(cls).isNotNull()
    n = rows.agg(F.count_if(real).alias("n_truth"), F.count_if(real & F.col(hit)).alias("n_match"), F.count_if(false_alarm).alias("n_false"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return n.withColumns({"pod": ratio(F.col("n_match"), F.col("n_truth")), "far": ratio(F.col("n_false"), F.col("n_false") + F.col("n_match"))})


def class_mix(weights: DataFrame, cls: str = "letter", weight: str = "weight") -> DataFrame:
    """Shares of the classes, weakest class first in ``place``; one row per class."""
    w = Window.partitionBy()
    place = F.instr(F.lit(K.LADDER), F.substring(F.upper(cls), 1, 1)) - 1
    return weights.select(F.upper(cls).alias("letter"), (F.col(weight) / F.sum(weight).over(w)).alias("share"), place.alias("place"))


def drawn_class(share_of: Mapping[str, float], u: Column) -> Column:
    """The class letter that a number in (0, 1) falls on, weakest class first."""
    total, acc, out = sum(share_of.values()), 0.0, None
    letters = sorted(share_of, key=lambda c: K.LADDER.find(c.upper()))
    for c in letters[:-1]:
        acc += share_of[c] / total
        out = F.when(u < acc, c.upper()) if out is None else out.when(u < acc, c.upper())
    last = F.lit(letters[-1].upper())
    return last if out is None else out.otherwise(last)


def hard_scale(cls: Column) -> Column:
    return F.coalesce(X.lookup(HARD_SCALE, F.upper(F.substring(cls, 1, 1))), F.lit(1.0e3))


def pulse_bounds(pulse: DataFrame, by: Sequence[str] = ("id",), t: str = "t", value: str = "value", amplitude: str = "amplitude") -> DataFrame:
    """Start and end of each clean pulse: the first time at 5 % of the amplitude before its top, the first at half of it or less after.

    Where there is no such time, the first or the last of the pulse.
    """
    w = Window.partitionBy(*by)  # one pulse; no table of tops that a join could send through the driver
    d = pulse.withColumns({"_top": F.max_by(t, F.struct(F.col(value), -F.col(t))).over(w), "_lo": F.min(t).over(w), "_hi": F.max(t).over(w)})
    a, x = F.col(amplitude), F.col(value)
    start = F.min(F.when((F.col(t) <= F.col("_top")) & (x >= 0.05 * a), F.col(t)))
    end = F.min(F.when((F.col(t) >= F.col("_top")) & (x <= 0.5 * a), F.col(t)))
    return d.groupBy(*by).agg(F.coalesce(start, F.first("_lo")).alias("t_start"), F.coalesce(end, F.first("_hi")).alias("t_end"))


#: The nested catalogue record, as JSON holds it.
RECORD = (
    "event_id string, t_start double, t_peak double, t_end double, goes_class string, soft struct<detected: boolean, peak_flux_native: double, peak_flux_goes_equiv: double, detector_used: string>, "
    "hard struct<detected: boolean, peak_counts: double>, flags map<string, string>, confidence double, detectors array<string>, ref_match struct<catalog: string, id: string, dt_s: double>"
)


def to_json_record(events: DataFrame) -> DataFrame:
    """``events`` (columns of RECORD, as far as they are there) as one JSON object a row, ``json``; what is null is left out."""
    have = [f for f in ("event_id", "t_start", "t_peak", "t_end", "goes_class", "soft", "hard", "flags", "confidence", "detectors", "ref_match") if f in events.columns]
    return events.select(F.to_json(F.struct(*have)).alias("json"))


def from_json_record(dump: DataFrame) -> DataFrame:
    """The records of a dump (``json``): confidence 0, no flags and no detectors where they are not given; what is no JSON is an error."""
    r = F.from_json("json", RECORD, {"mode": "FAILFAST"})
    d = dump.select(r.alias("r")).select("r.*")
    none = F.create_map().cast("map<string,string>")
    return d.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "flags": F.coalesce("flags", none), "detectors": F.coalesce("detectors", F.array().cast("array<string>"))})
