"""Operators over events with a duration: merging, matching, voting, catalogue lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalar as X
from .blocks import in_order
from .common import cut


def range_join(left: DataFrame, right: DataFrame, lt: str, rt: str, before: float, after: float, by: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Pairs with lt - before <= rt <= lt + after, by way of time buckets: an equi-join, never a nested loop.

    Each left row is laid out over the buckets its window touches (two or three), each right row has one bucket, so no
    pair comes twice. ``how`` is inner, left_semi or left_anti; for the last two the left rows come back as they were,
    repeated ones as often and nulls in any column included. A row whose time or key is null matches nothing.
    """
    if how != "inner":
        each = left.groupBy(*left.columns).agg(F.count("*").alias("_times"))
        hit = range_join(each, right.select(*by, rt).distinct(), lt, rt, before, after, by).select(*each.columns).distinct()
        hit = hit if how == "left_semi" else each.subtract(hit)  # a set difference, so nulls are equal
        return hit.select(*left.columns, F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).drop("col")
    width = max(before + after, 1e-9)
    r = right.withColumn("_b", F.floor(F.col(rt) / width))
    l = left.withColumn("_b", F.explode(F.sequence(F.floor((F.col(lt) - before) / width), F.floor((F.col(lt) + after) / width))))
    keys = ["_b", *by]
    cond = (F.col(f"l.{lt}") - before <= F.col(f"r.{rt}")) & (F.col(f"r.{rt}") <= F.col(f"l.{lt}") + after)
    for k in keys:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    rcols = [c for c in r.columns if c not in keys]
    return l.alias("l").join(r.alias("r"), cond).select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in rcols if c not in left.columns])


def merge_chains(events: DataFrame, guard: float = K.GUARD_S, by: Sequence[str] = (), start: str = "t_start", end: str = "t_end", order: Sequence[str] = ("event_id",)) -> DataFrame:
    """``events`` with the number of the chain they merge into: a new one starts more than ``guard`` after all before it.

    Without ``by`` the one order of the table is cut into stretches, which hand on the latest end and the number of chains before them.
    """
    if by:
        d, own = events, list(by)
        before = Window.partitionBy(*own).orderBy(start, *order).rowsBetween(Window.unboundedPreceding, -1)
        latest = F.max(end).over(before)
    else:
        d, own = in_order(events, [start, *order]), ["_part"]
        prior = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
        d = d.join(cut(d.groupBy("_part").agg(F.max(end).alias("_e")).select("_part", F.max("_e").over(prior).alias("_e"))), "_part")
        latest = F.greatest(F.max(end).over(Window.partitionBy("_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.col("_e"))
    w = Window.partitionBy(*own).orderBy(*([start, *order] if by else ["_i"]))
    d = d.withColumn("_new", F.coalesce(F.col(start) > latest + guard, F.lit(True)).cast("int")).withColumn("chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if not by:
        base = d.groupBy("_part").agg(F.sum("_new").alias("_k")).select("_part", F.coalesce(F.sum("_k").over(prior), F.lit(0)).alias("_k"))
        d = d.join(cut(base), "_part").withColumn("chain", F.col("chain") + F.col("_k"))
    return d.select(*[F.col(f"`{c}`") for c in events.columns if c != "chain"], "chain")


def deduplicate(events: DataFrame, guard: float = K.GUARD_S, by: Sequence[str] = ("stream",)) -> DataFrame:
    """One row per chain: span, peak of the strongest (the earliest of equals), sums, unions and first identity."""
    d = merge_chains(events, guard, by)
    first = F.struct("t_start", "event_id")
    strongest = F.struct(F.col("value"), -F.col("t_start"), -F.col("event_id"))
    return d.groupBy(*by, "chain").agg(
        F.min_by("event_id", first).alias("event_id"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"),
        F.max_by("t_peak", strongest).alias("t_peak"), F.max("value").alias("value"), F.count("*").alias("n"), F.sum("k").cast("long").alias("k_sum"),
    )


def nearest_event(points: DataFrame, events: DataFrame, t: str = "t", peak: str = "t_peak", key: Sequence[str] = ("event_id",)) -> DataFrame:
    """The event whose peak is nearest in time (the earlier of equals), without pairing points and events.

    Looks at the last event at or before and the first event after each point, both from one ordered union.
    """
    e = F.struct(F.col(peak).alias("peak"), *[F.col(k) for k in key])
    u = events.select(F.col(peak).alias("_t"), F.lit(0).alias("_s"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], e.alias("_e"))
    p = points.select(F.col(t).alias("_t"), F.lit(1).alias("_s"), F.struct(*points.columns).alias("_p"))
    d = u.unionByName(p, allowMissingColumns=True).withColumn("_day", F.floor(F.col("_t") / 86400.0))
    # Days carry their last and first event over to their neighbours, so that no window spans the whole table.
    days = d.where("_s = 0").groupBy("_day").agg(F.max("_e").alias("_last"), F.min("_e").alias("_first"))
    w = Window.orderBy("_day")  # one row per day
    alldays = d.select("_day").distinct().join(days, "_day", "left")
    alldays = alldays.withColumn("_before", F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    alldays = alldays.withColumn("_after", F.last("_first", ignorenulls=True).over(Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)))
    d = d.join(alldays.select("_day", "_before", "_after"), "_day")
    order = Window.partitionBy("_day").orderBy("_t", "_s", *[f"_k{i}" for i in range(len(key))])
    d = d.withColumn("_l", F.coalesce(F.last("_e", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before")))
    # The first event after a point, as the last one before it in the reverse order: such a frame only grows.
    back = Window.partitionBy("_day").orderBy(*[F.desc(c) for c in ("_t", "_s", *[f"_k{i}" for i in range(len(key))])])
    d = d.withColumn("_r", F.coalesce(F.last("_e", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.col("_after"))).where("_s = 1")
    left_near = F.col("_r").isNull() | (F.col("_t") - F.col("_l.peak") <= F.col("_r.peak") - F.col("_t"))
    best = F.when(F.col("_l").isNotNull() & left_near, F.col("_l")).otherwise(F.col("_r"))
    return d.withColumn("_b", best).select("_p.*", *[F.col(f"_b.{k}").alias(f"near_{k}") for k in key], F.col("_b.peak").alias("near_peak"))


def history(points: DataFrame, events: DataFrame, by: Sequence[str] = (), t: str = "t", onset: str = "t_start", window: float = K.HISTORY_TAU_S, tau: float = K.HISTORY_TAU_S) -> DataFrame:
    """Per point, over the events at or before it: their number in the last ``window`` seconds, the sum of exp(-age / tau) over
    all of them, and minutes since the last one (1440 at most, also where there is none).

    One ordered union of points and events, in blocks of 50 tau: within a block running sums, from before it one row per
    block. Events that are two blocks or more away add less than exp(-50) each to the decayed sum and are left out of it.
    """
    block = 50.0 * tau
    blk = lambda c: F.floor(c / block).cast("long")
    on = F.col(onset)
    w0 = F.exp((on - blk(on) * block) / tau)
    begun = events.select(*by, on.alias("_t"), F.lit(0).alias("_s"), F.lit(1).alias("_one"), w0.alias("_w"), on.alias("_on"))
    # An event leaves the count after ``window`` seconds, behind the points of that moment.
    ended = events.select(*by, (on + window).alias("_t"), F.lit(2).alias("_s"), F.lit(-1).alias("_one"))
    asked = points.select(*by, F.col(t).alias("_t"), F.lit(1).alias("_s"), F.struct(*[c for c in points.columns if c not in by]).alias("_p"))
    u = begun.unionByName(ended, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True).withColumn("_b", blk(F.col("_t")))
    total = u.groupBy(*by, "_b").agg(F.sum("_one").alias("_n"), F.sum("_w").alias("_w"), F.max("_on").alias("_on"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    last = Window.partitionBy(*by).orderBy("_b")
    near = F.when(F.lag("_b").over(last) == F.col("_b") - 1, F.lag("_w").over(last))
    prior = total.select(*by, "_b", F.sum("_n").over(before).alias("_n0"), near.alias("_w0"), F.max("_on").over(before).alias("_on0"))
    run = Window.partitionBy(*by, "_b").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    d = u.withColumns({"_n": F.sum("_one").over(run), "_ws": F.sum("_w").over(run), "_last": F.max("_on").over(run)}).where("_s = 1")
    cond = F.col("u._b") == F.col("v._b")
    for c in by:
        cond = cond & F.col(f"u.{c}").eqNullSafe(F.col(f"v.{c}"))
    d = d.alias("u").join(prior.alias("v"), cond, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    decayed = F.exp(-(F.col("_t") - F.col("u._b") * block) / tau) * (zero("_ws") + zero("_w0") * F.exp(F.lit(-block / tau)))
    since = F.least(F.lit(K.CAP_MIN), (F.col("_t") - F.coalesce("_last", "_on0")) / 60)
    n = F.coalesce("_n", F.lit(0)) + F.coalesce("_n0", F.lit(0))
    cols = [F.col(f"u.{c}").alias(c) if c in by else F.col(f"_p.{c}").alias(c) for c in points.columns]
    return d.select(*cols, n.cast("long").alias("n_events"), decayed.alias("decayed"), F.coalesce(since, F.lit(K.CAP_MIN)).alias("minutes_since"))


def consensus_vote(entries: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Votes per cluster: each catalogue counts once with its reliability against that of all catalogues."""
    rho = entries.groupBy("catalog").agg(F.max("rho").alias("rho")).agg(F.sum("rho").alias("all"))
    one = entries.groupBy(cluster, "catalog").agg(F.max("rho").alias("rho"), F.count("*").alias("m"), F.sum("t_peak").alias("t"), F.max("is_hxr").alias("h"), F.max("is_sxr").alias("s"))
    d = one.groupBy(cluster).agg(F.count("*").alias("n_catalogs"), F.sum("rho").alias("votes"), (F.sum("t") / F.sum("m")).alias("t_peak"), F.max("h").alias("any_hxr"), F.max("s").alias("any_sxr"))
    d = d.join(F.broadcast(rho)).withColumn("confidence", F.col("votes") / F.col("all"))  # one row
    status = F.when(F.col("confidence") >= K.CONFIRM, "confirmed").when(F.col("confidence") < K.REJECT, "rejected").otherwise("candidate")
    weak = F.col("any_hxr") & ~F.col("any_sxr")
    return d.withColumn("status", F.when(weak & (status == "candidate"), "confirmed").otherwise(status)).drop("votes", "all")


# --- catalogue -----------------------------------------------------------------------------------------------------------
def at(events: DataFrame, t: float, width: float = K.BUCKET_S) -> DataFrame:
    return events.where(X.bucket_of(F.col("t_peak"), width) == int(t // width))


def within(events: DataFrame, t0: float, t1: float) -> DataFrame:
    t0, t1 = min(t0, t1), max(t0, t1)
    return events.where(F.col("t_peak").between(t0, t1))


def neighbors(events: DataFrame, t: float, width: float = K.BUCKET_S) -> DataFrame:
    b = int(t // width)
    return events.where(X.bucket_of(F.col("t_peak"), width).isin(b, b - 1))


def query_range(events: DataFrame, t0: float, t1: float, min_class: str | None = None, limit: int | None = None, cls: str = "goes_class") -> DataFrame:
    """Peaks in [t0, t1] by milliseconds, of a class rank at least that of ``min_class``, newest first."""
    d = events.where(X.epoch_ms(F.col("t_peak")).between(round(t0 * 1000), round(t1 * 1000)))
    if min_class:
        d = d.where(X.class_rank(F.col(cls)) >= X.class_rank(F.lit(min_class)))
    d = d.orderBy(F.desc("t_peak"), "event_id")
    return d.limit(limit) if limit else d


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str] = ("event_id",), seq: str = "seq") -> DataFrame:
    """Rows of both; of equal keys the one of highest ``seq`` (later wins)."""
    cols = [c for c in old.columns if c not in key]
    return old.unionByName(new).groupBy(*key).agg(F.max_by(F.struct(*cols), seq).alias("_r")).select(*key, "_r.*")


def latest(samples: DataFrame, by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id")) -> DataFrame:
    """Newest sample per stream; equal times go by the later arrival."""
    rest = [c for c in samples.columns if c not in by]
    return samples.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def flatten_catalogue(events: DataFrame) -> DataFrame:
    """Nested catalogue rows as the flat 17-column table (times in milliseconds, flags as 0/1, bits 128 and 256)."""
    ms, flag = lambda c: X.epoch_ms(F.col(c)), lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    bits = F.when(F.col("flags.data_gap_during"), 128).otherwise(0) + F.when(F.coalesce("flags.spike_rejected", F.lit(0)) > 0, 256).otherwise(0)
    return events.select(
        "event_id", ms("t_start").alias("t_start"), ms("t_peak").alias("t_peak"), ms("t_end").alias("t_end"), "goes_class",
        F.col("soft.peak_flux_native").alias("peak_flux_native"), F.col("soft.peak_flux_goes_equiv").alias("peak_flux_goes_equiv"), F.col("hard.peak_counts").alias("hxr_peak_counts"),
        F.col("soft.detector_used").alias("detector_used"), flag("soft.detected").alias("soft_detected"), flag("hard.detected").alias("hard_detected"),
        flag("flags.neupert_consistent").alias("neupert_consistent"), "confidence", F.to_json("detectors").alias("detectors"), bits.alias("qc_bitmask"),
        F.col("ref_match.catalog").alias("ref_catalog"), F.col("ref_match.id").alias("ref_id"),
    )
