"""Queries of catalogue records, alerts, summaries and of what the other modules leave."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import events as V
from ..operators import records as R
from ..state import machines as S
from .registry import FLARES, E, events_as_flares, query, r6, streams

CLS = "CASE WHEN value >= 300 THEN 'X' WHEN value >= 150 THEN 'm' ELSE 'C' END || (k % 9 + 1) || '.0'"


def _classed(spark, d):
    letter = F.when(F.col("value") >= 300, "X").when(F.col("value") >= 150, "m").otherwise("C")
    return events_as_flares(spark, d).withColumn("goes_class", F.concat(letter, (F.col("k") % 9 + 1).cast("string"), F.lit(".0")))


@query("cat_by_class", f"WITH {E}, {FLARES}, c AS (SELECT *, {CLS} AS goes_class FROM f) SELECT event_id, goes_class FROM c WHERE upper(goes_class[1]) = 'M'")
def cat_by_class(spark, d):
    return R.by_class(_classed(spark, d), "m").select("event_id", "goes_class")


@query("cat_get", f"WITH {E}, {FLARES}, m AS (SELECT min(event_id) AS i, count(*) AS n FROM f) SELECT event_id, round(t_peak - 1704067200.0, 3) AS t_peak, n FROM f, m WHERE event_id = i")
def cat_get(spark, d):
    f = events_as_flares(spark, d)
    i = f.agg(F.min("event_id")).first()[0]
    return R.get(f, i).join(F.broadcast(R.count(f))).select("event_id", F.round(F.col("t_peak") - 1704067200.0, 3).alias("t_peak"), "n")


@query("cat_all", f"WITH {E}, {FLARES} SELECT event_id, round(t_peak - 1704067200.0, 3) AS t_peak FROM f ORDER BY t_peak, event_id")
def cat_all(spark, d):
    return R.all_events(events_as_flares(spark, d)).select("event_id", F.round(F.col("t_peak") - 1704067200.0, 3).alias("t_peak"))


@query("samples_in_order", f"WITH {E} SELECT event_id, stream, us FROM e ORDER BY t, stream")
def samples_in_order(spark, d):
    return R.in_order(streams(spark, d)).select("event_id", "stream", "us")


@query("cat_nest", f"""WITH {E}, {FLARES} SELECT event_id, round(round_even(t_peak * 1000, 0) / 1000.0 - 1704067200.0, 3) AS t_peak, CASE WHEN stream = 'view' THEN value END AS soft_peak, CASE WHEN stream = 'click' THEN value END AS hard_peak,
    stream = 'view' AS soft, stream = 'click' AS hard, TRUE AS neupert, 'cusum,' || stream AS detectors, CASE WHEN k % 2 = 0 THEN 'HEK' END AS ref_catalog FROM f""")
def cat_nest(spark, d):
    s = F.col("stream")
    soft = F.struct((s == "view").alias("detected"), F.col("value").alias("peak_flux_native"), F.col("value").alias("peak_flux_goes_equiv"), F.lit("SDD1").alias("detector_used"))
    hard = F.struct((s == "click").alias("detected"), F.col("value").alias("peak_counts"))
    flags = F.struct(F.lit(False).alias("data_gap_during"), F.lit(0).alias("spike_rejected"), F.lit(True).alias("neupert_consistent"))
    ref = F.struct(F.when(F.col("k") % 2 == 0, "HEK").alias("catalog"), F.col("event_id").cast("string").alias("id"))
    f = events_as_flares(spark, d).select("event_id", "t_start", "t_peak", "t_end", F.lit("M1.0").alias("goes_class"), soft.alias("soft"), hard.alias("hard"), flags.alias("flags"), F.lit(0.9).alias("confidence"), F.array(F.lit("cusum"), s).alias("detectors"), ref.alias("ref_match"))
    n = R.nest_catalogue(V.flatten_catalogue(f))
    return n.select(
        "event_id", F.round(F.col("t_peak") - 1704067200.0, 3).alias("t_peak"), F.col("soft.peak_flux_goes_equiv").alias("soft_peak"), F.col("hard.peak_counts").alias("hard_peak"),
        "flags.soft", "flags.hard", F.col("flags.neupert_consistent").alias("neupert"), F.array_join("detectors", ",").alias("detectors"), F.col("ref_match.catalog").alias("ref_catalog"),
    )


@query("alert_record", f"""WITH {E}, {FLARES}, c AS (SELECT *, {CLS} AS goes_class FROM f) SELECT event_id, upper(goes_class[1]) AS severity, 'nowcast' AS kind, stream, TRUE AS onset, FALSE AS "end", goes_class, value AS peak_flux, 'cusum' AS detector FROM c""")
def alert_record(spark, d):
    f = _classed(spark, d).select(
        "event_id", "stream", F.lit("soft").alias("band"), F.lit(True).alias("onset"), F.lit(None).cast("boolean").alias("peak"), F.lit(False).alias("end"), F.col("t_start").alias("onset_time"),
        F.lit(0.0).alias("statistic"), "goes_class", F.col("value").alias("peak_flux"), F.array(F.lit("cusum")).alias("detectors"),
    )
    kinds = "kind string, stream string, onset boolean, end boolean, goes_class string, peak_flux double, severity string, detectors array<string>"
    a = R.alerts(f).select("event_id", F.from_json("alert", kinds).alias("a"))
    return a.select("event_id", "a.severity", "a.kind", "a.stream", "a.onset", "a.end", "a.goes_class", "a.peak_flux", F.get("a.detectors", F.lit(0)).alias("detector"))


@query("alert_latest", f"WITH {E}, {FLARES}, o AS (SELECT * FROM f WHERE stream = 'click') SELECT stream, round(t_start - 1704067200.0, 3) AS onset FROM o ORDER BY t_start DESC LIMIT 1")
def alert_latest(spark, d):
    f = events_as_flares(spark, d).select("stream", F.col("t_start").alias("onset_time"), F.col("event_id").cast("string").alias("alert"))
    return R.latest_alert(f, "click").select("stream", F.round(F.col("onset_time") - 1704067200.0, 3).alias("onset"))


@query("src_to_samples", f"WITH {E} SELECT round(t - 1704067200.0, 3) AS t, value, 'W m^-2' AS unit, 'AdityaL1-SoLEXS' AS source, CAST(k AS VARCHAR) AS meta_k FROM e")
def src_to_samples(spark, d):
    s = R.to_samples(streams(spark, d).select("t", "value", "k"), "solexs-sxr", "SXR_LONG", "SoLEXS")
    return s.select(F.round(F.col("t") - 1704067200.0, 3).alias("t"), "value", "unit", "source", F.col("meta")["k"].alias("meta_k"))


@query("src_event_list", f"WITH {E}, {FLARES}, c AS (SELECT event_id, {CLS} AS fl_goescls, CASE WHEN k % 3 = 0 THEN 'SDO' ELSE 'GOES' END AS o FROM f) SELECT fl_goescls, event_id AS ar_noaanum FROM c WHERE fl_goescls > 'C4.0' AND o = 'GOES'")
def src_event_list(spark, d):
    c = _classed(spark, d).select(F.col("goes_class").alias("fl_goescls"), F.col("event_id").alias("ar_noaanum"), F.when(F.col("k") % 3 == 0, "SDO").otherwise("GOES").alias("obs_observatory"))
    return R.event_list(c, "C4.0")


@query("list_union", f"WITH {E} SELECT event_id, stream || ',cusum' || CASE WHEN stream <> 'view' THEN ',view' ELSE '' END AS both FROM e")
def list_union(spark, d):
    u = R.union_in_order(F.array("stream", F.lit("cusum")), F.array(F.lit("view"), F.lit("cusum")))
    return streams(spark, d).select("event_id", F.array_join(u, ",").alias("both"))


MATCHED = "r AS (SELECT CASE WHEN k % 7 > 0 THEN " + CLS + " END AS truth_class, k % 3 > 0 AS matched, k % 7 = 0 AS false_alarm FROM f)"


def _matched(spark, d):
    k = F.col("k")
    return _classed(spark, d).select(F.when(k % 7 > 0, F.col("goes_class")).alias("truth_class"), (k % 3 > 0).alias("matched"), (k % 7 == 0).alias("false_alarm"))


@query("pod_by_letter", f"WITH {E}, {FLARES}, {MATCHED} SELECT upper(truth_class[1]) AS letter, count(*) AS n_truth, count(*) FILTER (matched) AS n_detected, round(count(*) FILTER (matched) / count(*), 6) AS pod FROM r WHERE truth_class IS NOT NULL GROUP BY 1")
def pod_by_letter(spark, d):
    return R.pod_by_letter(_matched(spark, d)).withColumn("pod", r6("pod"))


@query("detection_summary", f"""WITH {E}, {FLARES}, {MATCHED}, n AS (SELECT count(truth_class) AS n_truth, count(*) FILTER (matched AND truth_class IS NOT NULL) AS n_match, count(*) FILTER (false_alarm) AS n_false FROM r)
    SELECT *, round(n_match / n_truth, 6) AS pod, round(n_false / (n_false + n_match), 6) AS far FROM n""")
def detection_summary(spark, d):
    return R.detection_summary(_matched(spark, d)).withColumns({"pod": r6("pod"), "far": r6("far")})


@query("class_mix", f"WITH {E}, w AS (SELECT CASE stream WHEN 'view' THEN 'b' WHEN 'click' THEN 'C' WHEN 'error' THEN 'm' ELSE 'x' END AS c, count(*) AS n FROM e GROUP BY 1) SELECT upper(c) AS letter, round(n / sum(n) OVER (), 6) AS share, strpos('ABCMX', upper(c)) - 1 AS place FROM w")
def class_mix(spark, d):
    c = F.when(F.col("stream") == "view", "b").when(F.col("stream") == "click", "C").when(F.col("stream") == "error", "m").otherwise("x")
    return R.class_mix(streams(spark, d).groupBy(c.alias("letter")).agg(F.count("*").alias("weight"))).select("letter", r6("share").alias("share"), F.col("place").cast("long").alias("place"))


@query("gen_class_draw", f"WITH {E}, c AS (SELECT event_id, CASE WHEN (k + 0.5) / 100 < 0.3 THEN 'B' WHEN (k + 0.5) / 100 < 0.75 THEN 'C' WHEN (k + 0.5) / 100 < 0.95 THEN 'M' ELSE 'X' END AS letter FROM e) SELECT *, CASE letter WHEN 'B' THEN 600.0::DOUBLE WHEN 'C' THEN 2000.0::DOUBLE WHEN 'M' THEN 12000.0::DOUBLE ELSE 60000.0::DOUBLE END AS hard FROM c")
def gen_class_draw(spark, d):
    letter = R.drawn_class({"M": 0.2, "B": 0.3, "X": 0.05, "C": 0.45}, (F.col("k") + 0.5) / 100)
    return streams(spark, d).select("event_id", letter.alias("letter")).withColumn("hard", R.hard_scale(F.col("letter")))


@query("win_prior_max", f"WITH {E} SELECT event_id, coalesce(max(value) OVER (PARTITION BY stream ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS top FROM e")
def win_prior_max(spark, d):
    w = Window.partitionBy("stream").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return streams(spark, d).select("event_id", F.coalesce(F.max("value").over(w), F.lit(-1.0)).alias("top"))


@query("scan_leaky", f"""WITH RECURSIVE {E}, x AS MATERIALIZED (SELECT event_id, stream, value - 60 AS v, row_number() OVER (PARTITION BY stream ORDER BY t, event_id) AS n FROM e),
    w AS (SELECT event_id, stream, n, greatest(0.0::DOUBLE, 62.831853072::DOUBLE * v) AS f FROM x WHERE n = 1 UNION ALL SELECT x.event_id, x.stream, x.n, greatest(0.0::DOUBLE, w.f + 62.831853072::DOUBLE * (x.v - w.f / 240.0::DOUBLE)) FROM w JOIN x ON x.stream = w.stream AND x.n = w.n + 1)
    SELECT event_id, round(f, 4) AS level FROM w""")
def scan_leaky(spark, d):
    """With a step of 60 s many levels end on a 5 behind the places that are rounded to, where two ways to round part; with this one they do not."""
    f = D.leaky(streams(spark, d).withColumn("value", F.col("value") - 60), dt=62.831853072)
    return f.select("event_id", F.round("level", 4).alias("level"))


@query("event_schema", f"WITH {E}, {FLARES} SELECT event_id, {CLS} AS goes_class, round(t_start - 1704067200.0, 3) AS t_start FROM f")
def event_schema(spark, d):
    f = R.event_fields(_classed(spark, d).withColumnRenamed("goes_class", "cls"))
    return f.select("event_id", "goes_class", F.round(F.col("t_start") - 1704067200.0, 3).alias("t_start"))


@query("band_flares")
def band_flares(spark, d):
    """Bursts of both bands, from onset to end, with peak and what is open at the end of the data."""
    s = streams(spark, d)
    return D.band_flares(s.where("stream = 'view'"), "soft", 1300.0).unionByName(D.band_flares(s.where("stream = 'click'"), "hard", 1300.0))


@query("fuse_quantity")
def fuse_quantity(spark, d):
    """Hourly cells of all streams as sources of one quantity, fused by the filter with registry fall-backs."""
    from ..operators.fusion import fuse_quantity as fuse

    s = streams(spark, d).groupBy(F.col("stream").alias("source_id"), F.floor(F.col("t") / 3600).cast("long").alias("cell")).agg(F.avg("value").alias("value"), F.stddev_pop("value").alias("sigma"), F.count("*").alias("n"))
    flag = F.when(F.col("n") == 1, "INTERPOLATED").when(F.col("n") == 2, "FILLED").otherwise("GOOD")
    known = spark.createDataFrame([("view", 0.9, 5.0), ("click", 0.8, 8.0)], "source_id string, reliability double, typical_sigma double")
    return fuse(s.withColumn("flag", flag), known, "SXR_LONG", 3600.0)


@query("pipeline_forecast")
def pipeline_forecast(spark, d):
    """Held-out forecasts of one stream's next hour by the whole offline pipeline."""
    from ..operators.model import offline_forecast

    return offline_forecast(streams(spark, d), events_as_flares(spark, d))


@query("pipeline_forecast_report")
def pipeline_forecast_report(spark, d):
    """The battery of those forecasts and their skill against climatology, persistence and the Hawkes rate."""
    from ..operators.model import offline_report

    return offline_report(streams(spark, d), events_as_flares(spark, d))
