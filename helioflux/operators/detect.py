"""Detectors over tables: recurrences as blocked scans, detectors with resets by blocks, gated detectors as grouped state machines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalar as X
from ..state import machines as S
from .blocks import affine_scan, ema, sequential, settle


def lindley(df: DataFrame, step: Column, by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id")) -> DataFrame:
    """Cumulative sum kept above zero, without alarms, as a blocked scan."""
    return affine_scan(df, step, 1.0, 0.0, 0.0, by, order, "cusum").drop("cusum_before")


def matched_filter(df: DataFrame, value: str = "value", slow: float = 0.98, fast: float = 0.8, by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id")) -> DataFrame:
    """Slow less fast exponential mean after each row, both from 0."""
    d = ema(ema(df, value, slow, False, by, order, "_slow").drop("_slow_before"), value, fast, False, by, order, "_fast").drop("_fast_before")
    return d.withColumn("matched", F.col("_slow") - F.col("_fast")).drop("_slow", "_fast")


def leaky(df: DataFrame, value: str = "value", dt: float = 60.0, tau: float = K.DECAY_TAU_S, gain: float = 1.0, by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id")) -> DataFrame:
    """Leaky integral by steps of ``dt`` (below ``tau``) as a blocked scan: gains ``gain`` times the value, loses with ``tau``, never below zero."""
    return affine_scan(df, F.col(value) * (dt * gain), 1 - dt / tau, 0.0, 0.0, by, order, "level").drop("level_before")


def cusum(df: DataFrame, base: float, sigma: float = 1.0, k: float = K.CUSUM_K, h: float = K.CUSUM_H, by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id"), key: str = "event_id") -> DataFrame:
    """Rows (by, key, statistic, alarm, onset) of the cumulative sum that an alarm resets, blocks settled by their entry states."""
    return _alarms(df, lambda: S.Cusum(k, h), lambda m, r: m.update(r["value"], base, sigma, r["t"]), by, order, key)


def poisson_cusum(df: DataFrame, mu0: float, ratio: float = K.POISSON_RATIO, h: float = K.POISSON_H, by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id"), key: str = "event_id") -> DataFrame:
    """The same of counts against a raised rate."""
    return _alarms(df, lambda: S.PoissonCusum(ratio, h), lambda m, r: m.update(r["value"], mu0, r["t"]), by, order, key)


def adaptive_latch(df: DataFrame, base: float, sigma: float, by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id"), key: str = "event_id") -> DataFrame:
    """Rows (by, key, z, started, latched): M of N samples high switch on, one low switches off; blocks settled by their entry states."""

    def step(m: S.Adaptive, r: dict) -> list[tuple]:
        z, started = m.update(r["value"], base, sigma)
        return [(r[key], z, started, m.on)]

    return _settled(df, S.Adaptive, step, "z double, started boolean, latched boolean", by, order, key)


def flare_fsm(df: DataFrame, by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id"), key: str = "event_id") -> DataFrame:
    """Rows (by, key, onset, peak, end, active) of the start-peak-end machine, which forgets with every end."""

    def step(m: S.FlareFsm, r: dict) -> list[tuple]:
        out = m.step(r["value"], r["t"])
        return [(r[key], out.get("onset"), out.get("peak"), out.get("end"), m.active)]

    return _settled(df, S.FlareFsm, step, "onset double, peak double, end double, active boolean", by, order, key)


def _settled(df: DataFrame, make: Callable, step: Callable, schema: str, by: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    cols = list(dict.fromkeys([*by, key, *order, "t", "value"]))
    return settle(df.select(*cols), make, step, f"{key} {df.schema[key].dataType.simpleString()}, {schema}", by, order)


def _alarms(df: DataFrame, make: Callable, update: Callable, by: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    def step(m, r: dict) -> list[tuple]:
        s, onset = update(m, r)
        return [(r[key], s, onset is not None, onset)]

    return _settled(df, make, step, "statistic double, alarm boolean, onset double", by, order, key)


def run_machine(df: DataFrame, make: Callable[[], object], step: Callable[[object, float, float], tuple], schema: str, by: str = "stream", order: Sequence[str] = ("t", "event_id"), key: str = "event_id") -> DataFrame:
    """One state machine per stream over its samples in order; rows (key, by, *schema).

    A stream is one task's, since its state runs through all of it, and comes to it a batch at a time; streams spread over the cluster.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    cols = list(dict.fromkeys([key, by, *order, "t", "value"]))

    def run(m: object, g: pd.DataFrame) -> list[tuple]:
        return [(k, *step(m, x, t)) for k, x, t in zip(g[key], g["value"], g["t"], strict=True)]

    return sequential(df.select(*cols), make, run, f"{key} {dict(df.dtypes)[key]}, {schema}", by, order).select(key, by, *names)


def step_band(m, x: float, t: float) -> tuple:
    r = m.update(x, t)
    return (float(r["statistic"]), float(r["baseline"]), bool(r["in_event"]), bool(r["spike"]), r.get("onset"), r.get("peak"), r.get("end"), r.get("peak_value"))


BAND = "statistic double, baseline double, in_event boolean, spike boolean, onset double, peak double, end double, peak_value double"


def soft_band(df: DataFrame, cadence: float = 1.0, **how) -> DataFrame:
    return run_machine(df, lambda: S.SoftBand(cadence), step_band, BAND, **how)


def hard_band(df: DataFrame, cadence: float = 1.0, **how) -> DataFrame:
    return run_machine(df, lambda: S.HardBand(cadence), step_band, BAND, **how)


def band_flares(df: DataFrame, band: str, cadence: float = 1.0, by: str = "stream") -> DataFrame:
    """Bursts of a band (soft or hard) per stream: onset, peak (the onset where none was told), end, peak_value, spikes, band.

    A burst that is open after the last sample comes out as it is then, without an end.
    """

    def make() -> list:
        return [(S.SoftBand if band == "soft" else S.HardBand)(cadence), S.Collector(band)]

    def step(m: list, g: pd.DataFrame) -> list[tuple]:
        done = [m[1].push(m[0].update(x, t), x, t) for x, t in zip(g["value"], g["t"], strict=True)]
        return [d for d in done if d]

    def close(m: list) -> list[tuple]:
        last = m[1].flush()
        return [last] if last else []

    d = sequential(df.select("event_id", by, "t", "value"), make, step, "onset double, peak double, end double, peak_value double, spikes long", by, ("t", "event_id"), close)
    d = d.withColumn("peak", F.coalesce("peak", "onset"))
    return d.withColumn("band", F.lit(band))


def detections(soft: DataFrame, hard: DataFrame) -> DataFrame:
    """Onsets of both bands as rows for the associator: id, band, onset, peak."""
    s = soft.where("onset is not null").select(F.col("event_id").alias("id"), F.lit("soft").alias("band"), "onset", F.col("peak"))
    h = hard.where("onset is not null").select(F.col("event_id").alias("id"), F.lit("hard").alias("band"), "onset", F.col("onset").alias("peak"))
    return s.unionByName(h)


def detection_records(flares: DataFrame, band: str, scale: float = 1.0) -> DataFrame:
    """Bursts of a band (id, onset, peak, end, peak_value and, where known, detectors, spikes, data_gap) as enriched detections.

    id, band, onset, peak (the onset where none was told), end (soft bursts: the peak where it is open), peak_value, goes_class of
    ``scale`` times the value (soft), detector_used (soft), energy_band (hard), detectors, spike_rejected, data_gap.
    """
    have, soft = set(flares.columns), band == "soft"
    own = lambda c, kind, none: F.coalesce(F.col(c), none).cast(kind) if c in have else none.cast(kind)
    peak = F.coalesce("peak", "onset")
    default = F.array(F.lit("CUSUM" if soft else "FOCuS"))
    named = own("detectors", "array<string>", default)
    return flares.select(
        "id", F.lit(band).alias("band"), "onset", peak.alias("peak"), (F.coalesce("end", "peak") if soft else F.col("end")).alias("end"), "peak_value",
        (X.goes_class(F.col("peak_value") * F.lit(scale)) if soft else F.lit(None).cast("string")).alias("goes_class"), F.lit("SDD1" if soft else None).cast("string").alias("detector_used"),
        F.lit(None if soft else "8-30keV").cast("string").alias("energy_band"), F.when(F.size(named) > 0, named).otherwise(default).alias("detectors"), own("spikes", "long", F.lit(0)).alias("spike_rejected"), own("data_gap", "boolean", F.lit(False)).alias("data_gap"),
    )


def kalman(cells: DataFrame, dt: float, by: str = "quantity") -> DataFrame:
    """Fused flux per cell of (by, cell, sensors array<struct<lv, sigma, rel>> in order of application)."""

    def step(m: list, g: pd.DataFrame) -> list[tuple]:
        k, rows = m[0], []
        for c, s in zip(g["cell"], g["sensors"], strict=True):
            f = k.step([(x["lv"], x["sigma"], x["rel"]) for x in s], dt if m[1] else 0.0)
            m[1] += 1
            if k.ready:
                rows.append((c, *f))
        return rows

    return sequential(cells.select(by, "cell", "sensors"), lambda: [S.Kalman(), 0], step, "cell long, value double, sigma double, rejected long", by, ("cell",))
