"""Forecast verification, labels, cross-validation folds, baselines and lead times."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .blocks import numbered

Y = "cast(y >= 0.5 as int)"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, theta: float, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn of p >= theta against y, and pod, far (a ratio of alarms), pofd, tss, hss; 0 where a rate has no base."""
    y, a = F.expr(Y) == 1, F.col("p") >= theta
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    d = df.groupBy(*by).agg(n(y & a).alias("tp"), n(~y & a).alias("fp"), n(y & ~a).alias("fn"), n(~y & ~a).alias("tn"))
    return scores(d)


def scores(d: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    pod, pofd = _ratio(tp, tp + fn), _ratio(fp, fp + tn)
    return d.withColumns({"pod": pod, "far": _ratio(fp, fp + tp), "pofd": pofd, "tss": pod - pofd, "hss": _ratio(2 * (tp * tn - fp * fn), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))})


def brier(df: DataFrame, by: Sequence[str] = (), p_clim: float | None = None) -> DataFrame:
    """Mean squared error of p, and skill against a constant (the clamped base rate unless given)."""
    d = df.groupBy(*by).agg(F.avg(F.expr("(p - y) * (p - y)")).alias("brier"), F.avg("y").alias("m"), F.avg(F.expr("y * y")).alias("m2"))
    c = F.lit(p_clim) if p_clim is not None else F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("m")))
    clim = c * c - 2 * c * F.col("m") + F.col("m2")
    return d.withColumn("bss", F.when(clim > 0, 1 - F.col("brier") / clim).otherwise(0.0)).drop("m", "m2")


def by_score(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: what all curves are made of. One shuffle, combined before it."""
    return df.groupBy(*by, "p").agg(F.sum(F.expr(Y)).alias("pos"), F.sum(F.expr(f"1 - {Y}")).alias("neg"))


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank statistic with ties at their mean rank; 0.5 where a class is missing."""
    w = Window.partitionBy(*by).orderBy("p")
    d = by_score(df, by).withColumn("below", F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.groupBy(*by).agg(F.sum(F.expr("pos * (below + neg / 2)")).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return d.select(*by, F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("u") / (F.col("np") * F.col("nn"))).otherwise(0.5).alias("roc_auc"))


def pr_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoids over distinct scores from high to low; precision is 1 at recall 0."""
    w = Window.partitionBy(*by).orderBy(F.desc("p"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = by_score(df, by).withColumns({"tp": F.sum("pos").over(run), "n": F.sum(F.expr("pos + neg")).over(run), "np": F.sum("pos").over(Window.partitionBy(*by))})
    d = d.withColumns({"recall": F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0), "precision": F.col("tp") / F.col("n")})
    step = (F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0))) * (F.col("precision") + F.coalesce(F.lag("precision").over(w), F.lit(1.0))) / 2
    return d.withColumn("step", step).groupBy(*by).agg(F.sum("step").alias("pr_auc"))


def reliability(df: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Per bin of p (clamped to [0, 1]): mean forecast, observed frequency, count."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p")))
    b = F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.avg(p).alias("mean_pred"), F.avg("y").alias("obs_freq"), F.count("*").alias("n"))


def ece(df: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    return reliability(df, bins, by).groupBy(*by).agg((F.sum(F.expr("n * abs(mean_pred - obs_freq)")) / F.sum("n")).alias("ece"))


def best_threshold(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold of the highest TSS among the scores and a step above the highest; the lowest of equals."""
    w = Window.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    d = by_score(df, by).withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w), "np": F.sum("pos").over(all_), "nn": F.sum("neg").over(all_)})
    d = d.withColumn("tss", _ratio(F.col("tp"), F.col("np")) - _ratio(F.col("fp"), F.col("nn")))
    d = d.groupBy(*by).agg(F.max_by(F.struct("tss", "p"), F.struct("tss", -F.col("p"))).alias("b"), F.max("p").alias("top"))
    none = F.col("b.tss") < 0
    return d.select(*by, F.when(none, F.col("top") + 1e-9).otherwise(F.col("b.p")).alias("theta"), F.when(none, 0.0).otherwise(F.col("b.tss")).alias("tss"))


def report(df: DataFrame, theta: float | None = None, baselines: Sequence[str] = ()) -> DataFrame:
    """One row with the whole battery; for each column of ``baselines`` also its <name>_brier, <name>_tss and <name>_theta (at its best
    threshold), and <name>_skill_vs: 1 less the ratio of the Brier scores, 0 where the baseline's is 0."""
    one = df.select("y", "p", *baselines).withColumn("g", F.lit(0))
    if theta is None:
        theta = best_threshold(one, ["g"]).first()["theta"]  # one number
    d = confusion(one, theta, ["g"])
    for part in (brier(one, ["g"]), roc_auc(one, ["g"]), pr_auc(one, ["g"]), ece(one, 10, ["g"])):
        d = d.join(part, "g")
    for name in baselines:
        b = one.select("g", "y", F.col(name).alias("p"))
        t = best_threshold(b, ["g"]).select("g", F.col("theta").alias(f"{name}_theta"), F.col("tss").alias(f"{name}_tss"))
        d = d.join(brier(b, ["g"]).select("g", F.col("brier").alias(f"{name}_brier")), "g").join(t, "g")
        d = d.withColumn(f"{name}_skill_vs", F.when(F.col(f"{name}_brier") > 0, 1 - F.col("brier") / F.col(f"{name}_brier")).otherwise(0.0))
    n = one.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.expr(Y)).alias("n_pos"), F.avg(F.expr(Y)).alias("base_rate"))
    return d.join(n, "g").withColumn("theta", F.lit(theta)).drop("g")


# --- labels and folds -----------------------------------------------------------------------------------------------------
def labels(times: DataFrame, events: DataFrame, horizon_min: float, by: Sequence[str] = (), drop_inside: bool = True) -> DataFrame:
    """``times`` with y = 1 if some event of ``events`` (t_peak, t_start, t_end) peaks in (t, t + horizon].

    The next peak is found in one ordered union of times and peaks. Negatives inside an event go, unless told otherwise;
    an event without bounds covers ten minutes on either side of its peak.
    """
    h = horizon_min * 60.0
    cols = [c for c in times.columns if c not in by]
    p = events.select(*by, F.col("t_peak").alias("_t"), F.lit(0).alias("_s"), F.col("t_peak").alias("_p"))
    q = times.select(*by, F.col("t").alias("_t"), F.lit(1).alias("_s"), F.struct(*cols).alias("_r"))
    # Backwards in time, as a frame that grows is kept and one that shrinks is computed anew for each row.
    w = Window.partitionBy(*by).orderBy(F.desc("_t"), F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    d = p.unionByName(q, allowMissingColumns=True).withColumn("_n", F.last("_p", ignorenulls=True).over(w)).where("_s = 1")
    d = d.withColumn("y", F.coalesce(((F.col("_n") > F.col("_t")) & (F.col("_n") - F.col("_t") <= h)).cast("int"), F.lit(0))).select(*by, "_r.*", "y")
    if not drop_inside:
        return d
    lo, hi = F.coalesce("t_start", F.col("t_peak") - 600), F.coalesce("t_end", F.col("t_peak") + 600)
    return in_event(d, events.select(*by, lo.alias("lo"), hi.alias("hi")), by).where("not in_event or y = 1").drop("in_event")


def in_event(times: DataFrame, spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``times`` with whether t lies in some span [lo, hi]: the running end of spans that began, in one ordered union."""
    cols = [c for c in times.columns if c not in by]
    s = spans.select(*by, F.col("lo").alias("_t"), F.lit(0).alias("_s"), F.col("hi").alias("_hi"))
    q = times.select(*by, F.col("t").alias("_t"), F.lit(1).alias("_s"), F.struct(*cols).alias("_r"))
    w = Window.partitionBy(*by).orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    d = s.unionByName(q, allowMissingColumns=True).withColumn("_end", F.max("_hi").over(w)).where("_s = 1")
    return d.select(*by, "_r.*", F.coalesce(F.col("_t") <= F.col("_end"), F.lit(False)).alias("in_event"))


def blocked_folds(df: DataFrame, folds: int, embargo_min: float = K.EMBARGO_MIN, order: Sequence[str] = ("t",), group: str | None = None) -> DataFrame:
    """Rolling-origin folds: rows (fold, role, ...) with role train or test.

    The rows, in order, are cut at round(i n / (k + 1)) half to even; fold i tests on part i and trains on rows that lie
    more than the embargo before its first test time. Groups that a fold tests on leave its training rows. Folds without
    training or test rows are left out. Rows are numbered by counts per stretch of the order, not in one task.
    """
    n = df.count()
    bounds = [round(i * n / (folds + 1)) for i in range(folds + 2)]
    part = F.lit(0)
    d = numbered(df, order, "_n")
    for i in range(1, folds + 1):
        part = F.when(F.col("_n") >= bounds[i], i).otherwise(part)
    d = d.withColumn("_part", part)
    first = d.where("_part > 0").groupBy(F.col("_part").alias("fold")).agg(F.min("t").alias("_t0"))
    test = d.where("_part > 0").withColumn("fold", F.col("_part")).withColumn("role", F.lit("test"))
    train = d.join(F.broadcast(first), F.col("t") < F.col("_t0") - embargo_min * 60.0).withColumn("role", F.lit("train")).drop("_t0")  # as many rows as folds
    if group:
        purge = test.select("fold", group).distinct()
        train = train.join(purge, ["fold", group], "left_anti")
    out = train.unionByName(test).drop("_n", "_part")
    live = out.groupBy("fold").agg(F.size(F.collect_set("role")).alias("_k")).where("_k = 2").select("fold")
    return out.join(F.broadcast(live), "fold")


# --- baselines -------------------------------------------------------------------------------------------------------------
def climatology(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.avg("y"))).alias("p"))


def persistence(ratio: Column) -> Column:
    return F.when(ratio >= 1.5, 0.999).otherwise(0.001)


def persistence_decayed(history: Column, tau_min: float = 360.0) -> Column:
    scale = max(tau_min / (K.HISTORY_TAU_S / 60.0), 1e-6)
    return F.least(F.lit(0.999), F.greatest(F.lit(0.001), 1 - F.exp(-F.greatest(history, F.lit(0.0)) / scale)))


def hawkes_rate(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Events per minute over their span; 1e-4 where there are fewer than two."""
    span = (F.max("t") - F.min("t")) / 60
    return events.groupBy(*by).agg(F.when((F.count("*") >= 2) & (span > 0), F.greatest(F.count("*") / span, F.lit(1e-9))).otherwise(1e-4).alias("mu_per_min"))


def hawkes(mu: Column, history: Column, horizon_min: Column, alpha: float = 0.5) -> Column:
    lam = mu * (1 + alpha * F.greatest(history, F.lit(0.0)))
    n = F.when(horizon_min > 0, horizon_min).otherwise(30.0)
    return F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), 1 - F.exp(-lam * n)))


# --- lead times --------------------------------------------------------------------------------------------------------------
def confirmed(df: DataFrame, theta: float, by: Sequence[str] = (), k: int = K.K_OF_M[0], m: int = K.K_OF_M[1], order: Sequence[str] = ("t", "p")) -> DataFrame:
    """Rows with whether p >= theta here and in k of the m samples from here on; equal times go by p."""
    w = Window.partitionBy(*by).orderBy(*order)
    on = F.col("p") >= theta
    return df.withColumn("on", on).withColumn("confirmed", on & (F.sum(on.cast("int")).over(w.rowsBetween(0, m - 1)) >= k))


def episodes(df: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("t", "p")) -> DataFrame:
    """Alert time of each run of ``on``: its first confirmed sample; runs without one raise none. Equal times go by p."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_n", F.row_number().over(w)).where("on").withColumn("_run", F.col("_n") - F.row_number().over(w))
    return d.groupBy(*by, "_run").agg(F.min(F.when(F.col("confirmed"), F.col("t"))).alias("t_alert")).where("t_alert is not null").drop("_run")


def lead_times(df: DataFrame, peaks: DataFrame, theta: float, window_s: float = K.LEAD_WINDOW_S, by: Sequence[str] = ()) -> DataFrame:
    """``peaks`` (t_peak) with lead_s: from the first confirmed crossing in the window before the peak, null if there is none."""
    from .events import range_join

    c = confirmed(df, theta, by).where("confirmed").select(*by, F.col("t").alias("_t"))
    spots = peaks.select(*by, "t_peak").distinct()  # peaks at one time share their first crossing
    hit = range_join(spots, c, "t_peak", "_t", window_s, 0.0, by).where("_t < t_peak")
    first = hit.groupBy(*by, "t_peak").agg(F.min("_t").alias("_t"))
    return peaks.join(first, [*by, "t_peak"], "left").withColumn("lead_s", F.col("t_peak") - F.col("_t")).select(*peaks.columns, "lead_s")


def lead_report(leads: DataFrame, by: Sequence[str] = (), buckets: Sequence[int] = K.LEAD_BUCKETS_MIN) -> DataFrame:
    q = F.percentile("lead_s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    share = [F.coalesce(F.avg(F.when(F.col("lead_s").isNotNull(), (F.col("lead_s") >= b * 60.0).cast("double"))), F.lit(0.0)).alias(f"frac_ge_{b}") for b in buckets]
    d = leads.groupBy(*by).agg(q.alias("q"), F.count("lead_s").alias("n_hit"), F.count("*").alias("n"), *share)
    return d.select(*by, F.col("q")[1].alias("median_lead_s"), (F.col("q")[2] - F.col("q")[0]).alias("iqr_lead_s"), "n_hit", (F.col("n") - F.col("n_hit")).alias("n_miss"), (F.col("n_hit") / F.col("n")).alias("tpr"), *[f"frac_ge_{b}" for b in buckets])


def lead_vs_far(df: DataFrame, peaks: DataFrame, thetas: Sequence[float], window_s: float = K.LEAD_WINDOW_S, by: Sequence[str] = ()) -> DataFrame:
    """Per threshold: median lead, share of peaks with an alert before them, share of alerts without a peak after them.

    All thresholds go through one plan, as a key of the data.
    """
    from .events import range_join

    th = F.explode(F.array(*[F.lit(float(x)) for x in thetas])).alias("theta")
    keys = ["theta", *by]
    d = df.select(*df.columns, th)
    w = Window.partitionBy(*keys).orderBy("t", "p")
    on = F.col("p") >= F.col("theta")
    d = d.withColumn("on", on).withColumn("confirmed", on & (F.sum(on.cast("int")).over(w.rowsBetween(0, K.K_OF_M[1] - 1)) >= K.K_OF_M[0]))
    pk = peaks.select(*peaks.columns, th)
    at, spots = [*keys, "t_peak"], pk.select(*keys, "t_peak").distinct()  # what holds for a time holds for all peaks at it
    cross = d.where("confirmed").select(*keys, F.col("t").alias("_t"))
    hit = range_join(spots, cross, "t_peak", "_t", window_s, 0.0, keys).where("_t < t_peak").groupBy(*at).agg(F.min("_t").alias("_t"))
    med = pk.join(hit, at).groupBy("theta").agg(F.median(F.col("t_peak") - F.col("_t")).alias("median_lead_s"))
    alerts = episodes(d, keys)
    good = range_join(alerts.distinct(), spots, "t_alert", "t_peak", 0.0, window_s, keys).select(*keys, "t_alert").distinct().withColumn("ok", F.lit(1))
    far = alerts.join(good, [*keys, "t_alert"], "left").groupBy("theta").agg((1 - F.count("ok") / F.count("*")).alias("far"))
    seen = range_join(spots, alerts.distinct(), "t_peak", "t_alert", window_s, 0.0, keys).where("t_alert < t_peak").select(*at).distinct().withColumn("ok", F.lit(1))
    tpr = pk.join(seen, at, "left").groupBy("theta").agg((F.count("ok") / F.count("*")).alias("tpr"))
    out = tpr.join(far, "theta", "left").join(med, "theta", "left")
    return out.select("theta", "median_lead_s", "tpr", F.coalesce("far", F.lit(0.0)).alias("far"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("math",)]
