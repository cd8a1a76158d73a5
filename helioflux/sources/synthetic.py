"""Light curves rendered from a table of pulses: every pulse is laid out over the ticks that it reaches and ticks are summed, so work
spreads by pulse and no task holds a scene. Random draws are hashes of the row, the same wherever and whenever they are asked for."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.records import drawn_class, hard_scale
from .feeds import QC_BITS

#: A pulse is laid out so many rise times before its peak and decay times after it; beyond, it is below 1e-12 of its amplitude.
BEFORE, AFTER = 8.0, 28.0
#: Pulses of a task.
PULSES = 10_000


def fred(t: Column, t_peak: Column, amplitude: Column, rise: Column, decay: Column) -> Column:
    """Half-Gaussian rise and exponential decay."""
    d = t - t_peak
    return amplitude * F.when(d < 0, F.exp(F.lit(-0.5) * F.pow(d / rise, F.lit(2.0)))).otherwise(F.exp(-d / decay))


def spread(pulses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``pulses`` in partitions of about ``PULSES`` rows, by key or, without one, by stretches of time.

    A small table of pulses is one partition, and its ticks would all be one task's. The number is counted, not left to sizes in
    bytes: those of pulses say nothing of their ticks.
    """
    n = max(pulses.sparkSession.sparkContext.defaultParallelism, -(-pulses.count() // PULSES))
    return pulses.repartition(n, *by) if by else pulses.repartitionByRange(n, "t_peak")


def lay_out(pulses: DataFrame, dt: float, by: Sequence[str] = ()) -> DataFrame:
    """``pulses`` (t_peak, amplitude, rise, decay, ...) with a row per tick they reach: tick, t = tick * dt, value. They are spread first, by ``by``."""
    lo, hi = F.floor((F.col("t_peak") - BEFORE * F.col("rise")) / dt), F.ceil((F.col("t_peak") + AFTER * F.col("decay")) / dt)
    d = spread(pulses, by).withColumn("tick", F.explode(F.sequence(lo, hi))).withColumn("t", F.col("tick") * F.lit(float(dt)))
    return d.withColumn("value", fred(F.col("t"), F.col("t_peak"), F.col("amplitude"), F.col("rise"), F.col("decay")))


def render(pulses: DataFrame, dt: float, base: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by, tick, t, flux): ``base`` and the sum of the pulses, for each tick that some pulse of ``by`` reaches.

    Pulses of one stretch of time are one task's, which sums their ticks before the shuffle and holds no more than these.
    """
    return lay_out(pulses, dt).groupBy(*by, "tick").agg(F.min("t").alias("t"), (F.lit(float(base)) + F.sum("value")).alias("flux"))


def impulsive_train(pulses: DataFrame, dt: float, spikes: str | Column = "n_spikes", lead: str | Column = "lead_s", width: float = 25.0, by: Sequence[str] = ("id",)) -> DataFrame:
    """The hard bursts of each pulse: rows (by, tick, t, hard).

    The base is the rise of the pulse from tick to tick, over time, where it rises. ``spikes`` narrow bells stand at evenly spaced places of the
    rising ticks that end ``lead`` before the peak tick, four times as high as the base there with it, and reach four widths.
    Pulses are shuffled, their ticks are not: all is windows of one pulse.
    """
    by = list(by)
    n_spikes, lead_s = (F.col(c) if isinstance(c, str) else c for c in (spikes, lead))
    d = lay_out(pulses.withColumn("_n", n_spikes.cast("long")).withColumn("_lead", lead_s.cast("double")), dt, by)
    d = d.select(*by, "tick", "t", "value", "_n", "_lead")
    w, own = Window.partitionBy(*by).orderBy("tick"), Window.partitionBy(*by)  # one pulse
    # Ends by the one-sided, inner ticks by the central difference.
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    span = F.when(before.isNull() | after.isNull(), dt).otherwise(2 * dt)
    d = d.withColumn("base", F.greatest(F.lit(0.0), (F.coalesce(after, F.col("value")) - F.coalesce(before, F.col("value"))) / span))
    top = F.max_by("t", F.struct(F.col("value"), -F.col("tick"))).over(own)
    d = d.withColumn("_rising", ((F.col("t") <= top - F.col("_lead")) & (F.col("base") > 0)).cast("long"))
    d = d.withColumn("_at", F.sum("_rising").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("_m", F.sum("_rising").over(own))
    # Bells may share a tick where there are fewer rising ones than bells.
    place = lambda k: F.least(F.col("_m") - 1, F.floor((k + 0.5) / F.col("_n") * F.col("_m")))
    times = F.size(F.filter(F.expr("sequence(0L, _n - 1)"), lambda k: place(k) == F.col("_at")))
    bell = F.when((F.col("_rising") == 1) & (F.col("_n") > 0), F.when(times > 0, F.struct(F.col("tick").alias("c"), (times * (3.0 * F.col("base") + 1e-12)).alias("h"))))
    sigma = max(width, dt)
    reach = max(1, int(4.0 * sigma / dt))
    d = d.withColumn("_bells", F.collect_list(bell).over(own))

    def add(s: Column, b: Column) -> Column:
        x = (F.col("tick") - b["c"]) * F.lit(float(dt))
        return s + F.when(F.abs(F.col("tick") - b["c"]) <= reach, b["h"] * F.exp(-x * x / (2 * sigma * sigma))).otherwise(0.0)

    return d.select(*by, "tick", "t", (F.col("base") + F.aggregate("_bells", F.lit(0.0), add)).alias("hard"))


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) from the seed and the columns: the same wherever and whenever it is asked for."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *cols: Column) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, *cols))) * F.cos(2 * math.pi * uniform(seed + 1, *cols))


def draw_pulses(keys: DataFrame, key: str, t0: float, t1: float, mix: dict[str, float], seed: int = 42) -> DataFrame:
    """``keys`` with the parameters of a pulse each: letter, t_peak, amplitude, rise, decay, lead_s, n_spikes, hard_scale.

    The class is drawn by ``mix``; larger classes are longer and lead by more. All draws are hashes of the key.
    """
    u = lambda k, a, b: F.lit(a) + uniform(seed + k, F.col(key)) * F.lit(b - a)
    d = keys.withColumn("letter", drawn_class(mix, uniform(seed, F.col(key))))
    rank = F.when(F.col("letter") == "X", 4.0).when(F.col("letter") == "M", 3.0).when(F.col("letter") == "C", 2.0).otherwise(1.0)
    grow = F.greatest(F.lit(1.0), rank / 3)
    floor = F.when(F.col("letter") == "X", 1e-4).when(F.col("letter") == "M", 1e-5).when(F.col("letter") == "C", 1e-6).otherwise(1e-7)
    top = F.when(F.col("letter") == "X", 20.0).otherwise(9.9)
    return d.withColumns({
        "t_peak": u(1, t0, t1), "amplitude": floor * (1 + uniform(seed + 2, F.col(key)) * (top - 1)), "rise": u(3, 60.0, 300.0) * grow, "decay": u(4, 300.0, 1800.0) * grow,
        "lead_s": u(5, 60.0, 180.0) * grow, "n_spikes": F.greatest(F.lit(1), F.rint(u(6, 1.0, 2.0) * rank)).cast("long"), "hard_scale": hard_scale(F.col("letter")),
    })


def counts(rate: Column, seed: int, *cols: Column) -> Column:
    """Counts with the mean and the spread of a Poisson draw: normal from 30 on, below by walking the distribution, a fixed number of steps."""
    u = uniform(seed, *cols)
    steps = F.sequence(F.lit(1), F.lit(90))
    walk = F.aggregate(steps, F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("n")), lambda a, i: F.struct((a["p"] * rate / i).alias("p"), (a["c"] + a["p"] * rate / i).alias("c"), (a["n"] + (u > a["c"]).cast("int")).alias("n")))
    return F.when(rate < 30, walk["n"].cast("double")).otherwise(F.greatest(F.lit(0.0), F.rint(rate + F.sqrt(rate) * normal(seed + 1, *cols))))


def noisy(df: DataFrame, seed: int, value: str = "flux", key: Sequence[str] = ("tick",), spread: float = 0.02, spike_rate: float = 0.002, gap_rate: float = 0.01, gap_ticks: int = 10) -> DataFrame:
    """``df`` with Gaussian noise on ``value``, rare spikes of ten times the value (flag ``spike``, bits in ``qc``), and gaps of ``gap_ticks`` ticks left out."""
    k = [F.col(c) for c in key]
    spike = uniform(seed + 5, *k) < spike_rate
    gap = uniform(seed + 9, *k[:-1], F.floor(k[-1] / gap_ticks)) < gap_rate
    x = F.col(value) * (1 + spread * normal(seed, *k)) * F.when(spike, 10.0).otherwise(1.0)
    qc = F.when(spike, QC_BITS["SPIKE_REJECTED"]).otherwise(QC_BITS["GOOD"]).cast("int")
    return df.where(~gap).withColumn(value, x).withColumn("spike", spike).withColumn("qc", qc)
