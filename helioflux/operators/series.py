"""Operators over ordered series: rolling statistics, grids, gaps, islands. All are window functions or joins that Catalyst plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import constants as K
from .common import cut, let
from .selection import SORTED, largest_group, quantiles


def ordered(by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id")) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


# --- rolling statistics -------------------------------------------------------------------------------------------------
def hampel(x: Column, w: WindowSpec, width: int = K.HAMPEL_WIDTH, k: float = K.HAMPEL_K) -> tuple[Column, Column, Column]:
    """(is outlier, cleaned value, median) against the ``width`` samples before; fewer than two of them judge nothing."""
    prior = F.collect_list(x).over(w.rowsBetween(-width, -1))
    mid = let(F.array_sort(prior), _median)
    # The median is bound before the lambda, which would sort the window again for each element.
    dev = let(mid, lambda m: let(F.array_sort(F.transform(prior, lambda v: F.abs(v - m))), _median))
    bad = F.coalesce((F.size(prior) >= 2) & F.when(dev > 0, F.abs(x - mid) > k * 1.4826 * dev).otherwise(x != mid), F.lit(False))
    return bad, F.when(bad, mid).otherwise(x), mid


def _median(s: Column) -> Column:
    n = F.size(s)
    at = lambda i: F.get(s, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def slope(x: Column, t: Column, w: WindowSpec, width: int) -> Column:
    """Least-squares slope of the last ``width`` samples; 0 where it is not defined."""
    return F.coalesce(F.regr_slope(x, t).over(w.rowsBetween(-(width - 1), 0)), F.lit(0.0))


def rolling_corr(x: Column, y: Column, w: WindowSpec, width: int = K.RING) -> Column:
    """Correlation of the last ``width`` rows, 0 where one of the two stands still (``corr`` then divides by zero, an error in ANSI mode)."""
    f = w.rowsBetween(-(width - 1), 0)
    c = F.try_divide(F.covar_pop(x, y).over(f), F.sqrt(F.var_pop(x).over(f)) * F.sqrt(F.var_pop(y).over(f)))
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))))


def m_of_n(on: Column, w: WindowSpec, m: int = K.M_OF, n: int = K.N_OF) -> Column:
    return F.sum(on.cast("int")).over(w.rowsBetween(-(n - 1), 0)) >= m


def rise_rule(x: Column, w: WindowSpec, samples: int = K.RISE_SAMPLES, ratio: float = K.RISE_RATIO) -> Column:
    """Whether the last ``samples`` values rise strictly and the last is ``ratio`` times the first (any rise from zero or less)."""
    back = [F.lag(x, i).over(w) for i in range(samples - 1, 0, -1)] + [x]
    up = F.lit(True)
    for a, b in zip(back, back[1:], strict=False):
        up = up & (b > a)
    return F.coalesce(up & ((back[0] <= 0) | (x >= ratio * back[0])), F.lit(False))


def gap_gate(t: Column, w: WindowSpec, cadence: float, factor: float = 3.0) -> Column:
    return F.coalesce(t - F.lag(t).over(w) > factor * cadence, F.lit(False))


def derivative(x: Column, t: Column, w: WindowSpec) -> Column:
    """Central differences, one-sided at the ends; 0 where time stands still."""
    x1, x0 = F.coalesce(F.lead(x).over(w), x), F.coalesce(F.lag(x).over(w), x)
    t1, t0 = F.coalesce(F.lead(t).over(w), t), F.coalesce(F.lag(t).over(w), t)
    return F.when(t1 > t0, (x1 - x0) / (t1 - t0)).otherwise(0.0)


def flatline(x: Column, w: WindowSpec, width: int = 8, eps: float = 0.0) -> Column:
    """Whether some full window of ``width`` samples around this one spans no more than ``eps``."""
    ahead = w.rowsBetween(0, width - 1)
    starts = (F.count(x).over(ahead) == width) & (F.max(x).over(ahead) - F.min(x).over(ahead) <= eps)
    return starts


def islands(df: DataFrame, start: Column, by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id"), name: str = "island") -> DataFrame:
    """Number the runs of rows; ``start`` is true where a new run begins."""
    d = df.withColumn("_start", F.coalesce(start, F.lit(True)).cast("int"))
    return d.withColumn(name, F.sum("_start").over(ordered(by, order).rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def runs_of(df: DataFrame, flag: str, by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id")) -> DataFrame:
    """Rows where ``flag`` holds, with the run they belong to and their place in it (from 1)."""
    w = ordered(by, order)
    d = df.withColumn("_n", F.row_number().over(w)).where(flag)
    d = d.withColumn("run", F.col("_n") - F.row_number().over(w))
    return d.withColumn("place", F.row_number().over(ordered((*by, "run"), order))).drop("_n")


def sessions(df: DataFrame, gap: float, t: str = "t", block: float = 86400.0) -> DataFrame:
    """``df`` with ``session``: numbered runs of rows no more than ``gap`` apart in time, over the whole table.

    Rows are put in order within blocks of time; blocks hand on their last time and their number of runs, one row each,
    so no task orders the table. Rows without a time are left out.
    """
    d = df.where(F.col(t).isNotNull()).withColumn("_block", F.floor(F.col(t) / block))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    last = d.groupBy("_block").agg(F.max(t).alias("_last")).select("_block", F.max("_last").over(before).alias("_prior"))
    inside = Window.partitionBy("_block").orderBy(t)
    d = d.join(last, "_block").withColumn("_new", F.coalesce(F.col(t) - F.coalesce(F.lag(t).over(inside), F.col("_prior")) > gap, F.lit(True)).cast("long"))
    base = d.groupBy("_block").agg(F.sum("_new").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    d = d.withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(base, "_block")
    return d.withColumn("session", F.col("_base") + F.col("_run")).drop("_block", "_prior", "_new", "_run", "_base")


# --- grids ----------------------------------------------------------------------------------------------------------------
def build_grid(spark, t0: float, t1: float, dt: float = K.GRID_DT_S) -> DataFrame:
    """Cells t0, t0 + dt, ... up to t1."""
    import math

    return spark.range(math.floor((t1 - t0) / dt + 1e-9) + 1).select(F.col("id").alias("cell"), (F.lit(t0) + F.col("id") * F.lit(dt)).alias("t"))


def snap_to_grid(df: DataFrame, g0: float, dt: float, tol: float, by: Sequence[str] = ("stream",), value: str = "value", sigma: str | None = None, bits: str | None = None) -> DataFrame:
    """Inverse-variance mean of the samples within ``tol`` of each cell: value, sigma, n, bits, flag per (by, cell).

    Cell k stands at g0 + k dt; samples before ``g0`` have cells below 0.
    """
    cell = F.rint((F.col("t") - g0) / dt).cast("long")
    s = F.col(sigma) if sigma else F.lit(None).cast("double")
    w = F.when(s > 0, 1 / (s * s)).otherwise(1.0)
    b = F.col(bits) if bits else F.lit(0)
    d = df.withColumn("cell", cell).where(F.abs(F.col("t") - (g0 + F.col("cell") * dt)) <= tol)
    d = d.groupBy(*by, "cell").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("value"), F.sqrt(1 / F.sum(w)).alias("sigma"), F.count("*").alias("n"), F.bit_or(b).alias("bits"))
    flag = F.when(F.col("bits").bitwiseAND(K.QC_BITS["BAD"]) > 0, "BAD").when(F.col("bits").bitwiseAND(K.QC_BITS["SUSPECT"]) > 0, "SUSPECT").otherwise("GOOD")
    return d.withColumn("flag", flag).withColumn("bits", F.when(F.col("bits") == 0, 1).otherwise(F.col("bits")))


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], cols: Sequence[str], t: str = "t", order: Sequence[str] = (), max_age: float | None = None, slack: float = 1e-9) -> DataFrame:
    """``left`` with the last row of ``right`` at or before its time, per ``by``: one shuffle of the union, no range join.

    ``order`` breaks ties among right rows. Columns come as ``cols`` and ``held_t``.
    """
    held = F.struct(F.col(t).alias("held_t"), *[F.col(c) for c in cols])
    r = right.select(*by, (F.col(t) - slack).alias("_t"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], held.alias("_held"))
    lcols = [c for c in left.columns if c not in by]
    d = left.select(*by, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_left"))
    u = r.unionByName(d, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", "_side", *[f"_o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_held", F.last("_held", ignorenulls=True).over(w)).where("_side = 1")
    if max_age is not None:
        u = u.withColumn("_held", F.when(F.col("_t") - F.col("_held.held_t") <= max_age, F.col("_held")))
    return u.select(*by, *[F.col(f"_left.{c}").alias(c) for c in lcols], "_held.held_t", *[F.col(f"_held.{c}").alias(c if c not in lcols else f"held_{c}") for c in cols])


def zero_order_hold(cells: DataFrame, samples: DataFrame, by: Sequence[str] = ("stream",), cadence: float = 1.0, max_age: float | None = None, order: Sequence[str] = ("event_id",)) -> DataFrame:
    """Last sample at or before each cell; its sigma grows with its age."""
    d = asof(cells, samples.select(*by, "t", *order, "value", "sigma"), by, ["value", "sigma"], order=order, max_age=max_age)
    age = F.col("t") - F.col("held_t")
    return d.withColumn("age_s", age).withColumn("sigma", F.col("sigma") * (1 + age / max(cadence, 1e-9)))


def interpolate(cells: DataFrame, max_gap_s: float, log: bool = False, by: Sequence[str] = ("stream",), keep_out: Column | None = None) -> DataFrame:
    """Fill null values between two measured cells no further apart than ``max_gap_s``; sigma is blended and raised by half.

    ``cells`` has by, t, value, sigma. Rows for which ``keep_out`` holds (hard X-rays) stay as they are.
    """
    w = Window.partitionBy(*by).orderBy("t")
    side = F.when(F.col("value").isNotNull(), F.struct("t", "value", "sigma"))
    d = cells.withColumn("_l", F.last(side, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    back = Window.partitionBy(*by).orderBy(F.desc("t"))  # backwards, as a frame that grows is kept and one that shrinks is computed anew
    d = d.withColumn("_r", F.last(side, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    span = F.col("_r.t") - F.col("_l.t")
    ok = F.col("value").isNull() & (span <= max_gap_s + 1e-9)
    if keep_out is not None:
        ok = ok & ~keep_out
    a, b = F.col("_l.value"), F.col("_r.value")
    frac = (F.col("t") - F.col("_l.t")) / span
    if log:
        ok = ok & (a > 0) & (b > 0)
        y = F.pow(F.lit(10.0), F.log10(a) + frac * (F.log10(b) - F.log10(a)))
    else:
        y = a + frac * (b - a)
    sl, sr = F.col("_l.sigma"), F.col("_r.sigma")
    s = 1.5 * F.coalesce((1 - frac) * sl + frac * sr, sl, sr)
    ok = F.coalesce(ok, F.lit(False))
    return d.withColumns({"value": F.when(ok, y).otherwise(F.col("value")), "sigma": F.when(ok, s).otherwise(F.col("sigma")), "interpolated": ok}).drop("_l", "_r")


def gap_cause(flag: Column, bits: Column, value: Column) -> Column:
    """Why a cell counts as a gap; null if it does not."""
    b = K.QC_BITS
    return F.when(value.isNull(), "missing").when(flag == "BAD", "bad").when(flag == "SUSPECT", "suspect").when(bits.bitwiseAND(b["SATURATED"]) > 0, "saturated").when(bits.bitwiseAND(b["DATA_GAP"]) > 0, "missing")


def detect_gaps(cells: DataFrame, by: Sequence[str] = ("stream",), width: int = 8, eps: float = 0.0) -> DataFrame:
    """Gap intervals (by, start_cell, end_cell, start_t, end_t, n_cells, cause of the first cell) of by, cell, t, value, flag, bits."""
    d = gap_cells(cells, by, width, eps).withColumn("_gap", F.col("cause").isNotNull())
    r = runs_of(d, "_gap", by, ("cell",))
    return r.groupBy(*by, "run").agg(F.min("cell").alias("start_cell"), F.max("cell").alias("end_cell"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n_cells"), F.min_by("cause", "cell").alias("cause")).drop("run")


def gap_cells(cells: DataFrame, by: Sequence[str] = ("stream",), width: int = 8, eps: float = 0.0) -> DataFrame:
    """``cells`` with the cause that makes each a gap, flatlines included."""
    w = Window.partitionBy(*by).orderBy("cell")
    d = cells.withColumn("cause", gap_cause(F.col("flag"), F.col("bits"), F.col("value"))).withColumn("_flat", flatline(F.col("value"), w, width, eps))
    d = d.withColumn("_flat", F.max("_flat").over(w.rowsBetween(-(width - 1), 0)))
    return d.withColumn("cause", F.coalesce("cause", F.when(F.col("_flat"), "flatline"))).drop("_flat")


def fill_gaps(cells: DataFrame, fillers: DataFrame, resid_log: float = 0.10, by: Sequence[str] = ("stream",)) -> DataFrame:
    """Gap cells of ``cells`` take the first valid filler by ``priority``; provenance tells what each cell holds.

    ``fillers``: cell, source, priority, value, sigma, flag, reliability. A filler is valid unless it is null or BAD.
    """
    import math

    g = gap_cells(cells, by)
    ok = fillers.where(F.col("value").isNotNull() & (F.col("flag") != "BAD"))
    best = ok.groupBy("cell").agg(F.min_by(F.struct("source", "value", "sigma", "reliability"), "priority").alias("f"))
    d = g.join(best, "cell", "left")
    use = F.col("cause").isNotNull() & F.col("f").isNotNull()
    v = F.col("f.value")
    base = F.when(F.col("f.sigma") > 0, F.col("f.sigma")).otherwise(F.abs(v) * 0.1)
    total = F.hypot(base / F.sqrt(F.greatest(F.col("f.reliability"), F.lit(1e-3))), F.lit(math.log(10.0)) * F.abs(v) * resid_log)
    own = F.when(F.col("flag") == "GOOD", "measured").otherwise(F.lower("flag"))
    return d.withColumns({
        "provenance": F.when(use, F.concat(F.lit("filled:"), F.col("f.source"))).when(F.col("cause").isNotNull(), F.concat(F.lit("gap:"), F.col("cause"))).otherwise(own),
        "sigma": F.when(use, total).otherwise(F.col("sigma")),
        "bits": F.when(use, F.col("bits").bitwiseAND(~K.QC_BITS["DATA_GAP"]).bitwiseOR(K.QC_BITS["FILLED"])).otherwise(F.col("bits")),
        "value": F.when(use, v).otherwise(F.col("value")),
        "flag": F.when(use, "FILLED").otherwise(F.col("flag")),
    }).drop("f", "cause")


def coverage(cells: DataFrame, by: Sequence[str] = ("stream",)) -> DataFrame:
    """Share of cells with a value that is neither BAD nor SUSPECT."""
    good = F.col("value").isNotNull() & ~F.col("flag").isin("BAD", "SUSPECT")
    return cells.groupBy(*by).agg(F.avg(good.cast("double")).alias("coverage"))


def despike(df: DataFrame, value: str = "value", k: float = 5.0, passes: int = 3, by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id")) -> DataFrame:
    """Median and MAD clipping in ``passes`` rounds; outliers take the last good value (the median where there is none).

    Groups that have converged stop moving by themselves: their next round finds nothing. The limits of a round are a
    small table, so that no round is computed again by the next. Medians of large groups are selected, not sorted (``quantiles``).
    """
    limits: list[DataFrame] = []
    most = largest_group(df, by)

    def flagged() -> DataFrame:
        """The rows with whether some round so far has found them; each round left a row per group."""
        d, spike = df, F.lit(False)
        for i, lim in enumerate(limits):
            d = d.join(lim.select(*by, F.col("m").alias(f"_m{i}"), F.col("thr").alias(f"_t{i}")), list(by), "left")
            spike = spike | F.coalesce((F.col(f"_t{i}") > 0) & (F.abs(F.col(value) - F.col(f"_m{i}")) > F.col(f"_t{i}")), F.lit(False))
        return d.select(*df.columns, spike.alias("spike"))

    for _ in range(passes):
        kept = flagged().where(~F.col("spike"))
        med = cut(quantiles(kept, value, 0.5, by, "m", most))
        dev = kept.join(med, list(by)).withColumn("_d", F.abs(F.col(value) - F.col("m")))
        if most <= SORTED:
            dev = dev.groupBy(*by).agg(F.first("m").alias("m"), F.median("_d").alias("mad"), F.avg("_d").alias("mean"))
        else:
            dev = dev.groupBy(*by).agg(F.first("m").alias("m"), F.avg("_d").alias("mean")).join(quantiles(dev, "_d", 0.5, by, "mad", most), list(by))
        sig = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(1.2533 * F.col("mean"))
        limits.append(cut(dev.select(*by, "m", (k * sig).alias("thr"))))
    d = flagged()
    last = cut(quantiles(d.where(~F.col("spike")), value, 0.5, by, "_m", most))
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(last, list(by), "left").withColumn("clean", F.coalesce(F.last(F.when(~F.col("spike"), F.col(value)), ignorenulls=True).over(w), F.col("_m")))
    return d.drop("_m")
