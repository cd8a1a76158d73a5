"""Exact quantiles of large groups by distributed selection: buckets of the value range, then of the bucket that holds the rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Buckets of a round, and the rows of a bucket (or of a group) that may be sorted in one cell.
BUCKETS, SORTED = 4096, 100_000


def largest_group(df: DataFrame, by: Sequence[str] = ()) -> int:
    """Rows of the largest group: one number."""
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def _scale(v):
    """A map that grows with ``v`` and makes equal parts of equal ratios, on either side of 0."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.ln(F.abs(v)) + 800.0))


def _finite(value: str):
    v = F.col(value).cast("double")
    return F.when(v.between(-1.7976931348623157e308, 1.7976931348623157e308), v).when(v.isNotNull(), F.raise_error(F.lit("a value of the quantile is not finite")).cast("double"))


def quantiles(df: DataFrame, value: str, q: float = 0.5, by: Sequence[str] = ("stream",), name: str = "m", most: int | None = None, limit: int = SORTED, buckets: int = BUCKETS, weight: str | None = None) -> DataFrame:
    """Rows (by, ``name``): the exact quantile of ``value`` per group, interpolated between its two neighbours as ``percentile`` does.

    Groups of at most ``limit`` rows (``most``, counted where it is not given) use ``percentile``. Else a round counts, per group and rank
    asked for, the values in each of ``buckets`` parts of the range that is left, combined before the shuffle, and keeps the
    bucket of the rank with its own least and greatest value; that goes on until a bucket is one value or at most ``limit`` rows. Parts
    are equal in ratio where the range is wide and equal in size where it is not, so a few rounds do for any spread of values. Nulls are
    left out, a group of nulls gives null; values that are not finite are an error in large groups. Null keys are a group. A row counts
    ``weight`` (long) times.
    """
    by, c = list(by), F.lit(1).cast("long") if weight is None else F.col(weight)
    if (largest_group(df, by) if most is None else most) <= limit:
        return df.groupBy(*by).agg(F.percentile(value, F.lit(q), c).alias(name))
    d = df.select(F.struct(*by).alias("_g") if by else F.lit(0).alias("_g"), _finite(value).alias("_v"), c.alias("_c")).where("_v is not null")
    ends = d.groupBy("_g").agg(F.sum("_c").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    place = (F.col("n") - 1) * F.lit(float(q))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor(place).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(place).alias("rank")))).alias("s")
    asked = cut(ends.select("_g", (place - F.floor(place)).alias("share"), "lo", "hi", F.lit(0).cast("long").alias("base"), F.col("n").alias("left"), sides).select("_g", "share", "lo", "hi", "base", "left", "s.*"))
    while not asked.where((F.col("lo") < F.col("hi")) & (F.col("left") > limit)).isEmpty():
        wide = asked.where((F.col("lo") < F.col("hi")) & (F.col("left") > limit))
        x = d.join(wide.select(F.col("_g").alias("_k"), "side", "lo", "hi"), (F.col("_g") == F.col("_k")) & F.col("_v").between(F.col("lo"), F.col("hi")))
        v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
        even = (v / 2 - lo / 2) / (hi / 2 - lo / 2)  # halves do not overflow
        part = F.when((lo > 0) & (hi <= 4 * lo) | (hi < 0) & (lo >= 4 * hi), even).otherwise((_scale(v) - _scale(lo)) / (_scale(hi) - _scale(lo)))
        x = x.groupBy("_k", "side", F.least(F.lit(buckets - 1), F.floor(part * buckets)).alias("b")).agg(F.sum("_c").alias("c"), F.min("_v").alias("blo"), F.max("_v").alias("bhi"))
        upto = F.sum("c").over(Window.partitionBy("_k", "side").orderBy("b"))  # a row a bucket
        x = x.withColumn("before", upto - F.col("c")).join(wide.select(F.col("_g").alias("_k"), "side", "rank", "base", "share"), ["_k", "side"])
        hit = x.where((F.col("rank") >= F.col("base") + F.col("before")) & (F.col("rank") < F.col("base") + F.col("before") + F.col("c")))
        hit = hit.select(F.col("_k").alias("_g"), "share", F.col("blo").alias("lo"), F.col("bhi").alias("hi"), (F.col("base") + F.col("before")).alias("base"), F.col("c").alias("left"), "side", "rank")
        asked = cut(asked.where((F.col("lo") >= F.col("hi")) | (F.col("left") <= limit)).unionByName(hit))
    few = asked.where("lo < hi").select(F.col("_g").alias("_k"), "side", "lo", "hi", "base", "rank", "share")
    upto = F.sum("_c").over(Window.partitionBy("_k", "side").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))  # of at most ``limit``
    got = d.join(few, (F.col("_g") == F.col("_k")) & F.col("_v").between(F.col("lo"), F.col("hi"))).withColumn("_u", upto).withColumn("_at", F.col("rank") - F.col("base"))
    got = got.where((F.col("_u") > F.col("_at")) & (F.col("_u") - F.col("_c") <= F.col("_at"))).select(F.col("_k").alias("_g"), "share", "side", F.col("_v").alias("x"))
    both = got.unionByName(asked.where("lo >= hi").select("_g", "share", "side", F.col("lo").alias("x")))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("x")))
    both = both.groupBy("_g").agg(((1 - F.max("share")) * pick(0) + F.max("share") * pick(1)).alias(name))
    if not by:
        return both.select(name)
    every = df.select(F.struct(*by).alias("_every")).distinct()  # keys may have any name, ``_g`` too
    return every.join(both, F.col("_every") == F.col("_g"), "left").select("_every.*", name)


def median_and_mad(df: DataFrame, value: str, by: Sequence[str], most: int, weight: str, limit: int = SORTED) -> DataFrame:
    """Rows (by, m, mad): the exact median of ``value`` per group, and that of the distances from it, in two passes over large groups.

    The first pass counts the values in buckets of equal ratio, combined before the shuffle. They bound the median by the values of a
    bucket, and the distances' median by those from all medians it may be; the second pass takes the rows within these bounds, and counts those before them.
    Where more than ``limit`` rows of a group are in them, both are selected one after the other (``quantiles``). A row counts ``weight``
    times; nulls are left out, as are null keys and groups without a value. ``most`` is the rows of the largest group.
    """
    by, v, c = list(by), F.col(value), F.col(weight)
    if most <= limit:
        m = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5), c).alias("m"))
        d = df.join(m, by).withColumn("_d", F.abs(v - F.col("m")))
        return d.groupBy(*by).agg(F.first("m").alias("m"), F.percentile("_d", F.lit(0.5), c).alias("mad")).where("m is not null")
    d = df.select(*by, _finite(value).alias("_v"), c.alias("_c")).where(" and ".join(["_v is not null", *(f"`{k}` is not null" for k in by)]))
    fine = max(256, min(8192, 20 * most // limit))  # buckets of a factor e
    h = cut(d.groupBy(*by, F.floor(_scale(F.col("_v")) * fine).alias("_at")).agg(F.sum("_c").alias("c"), F.count("*").alias("rows"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    own = Window.partitionBy(*by)  # a row a bucket
    upto = lambda o: F.sum("c").over(own.orderBy(o).rowsBetween(Window.unboundedPreceding, 0))
    h = h.withColumn("n", F.sum("c").over(own)).withColumn("_u", upto("_at")).withColumn("k0", F.expr("(n - 1) div 2")).withColumn("k1", F.expr("n div 2"))
    h = h.withColumn("mlo", F.min(F.expr("CASE WHEN _u > k0 THEN lo END")).over(own)).withColumn("mhi", F.min(F.expr("CASE WHEN _u > k1 THEN hi END")).over(own))
    h = h.withColumn("near", F.expr("greatest(0D, lo - mhi, mlo - hi)")).withColumn("far", F.expr("greatest(hi - mlo, mhi - lo)"))
    h = h.withColumn("_n", upto("near")).withColumn("_f", upto("far"))
    h = h.withColumn("dlo", F.min(F.expr("CASE WHEN _n > k0 THEN near END")).over(own)).withColumn("dhi", F.min(F.expr("CASE WHEN _f > k1 THEN far END")).over(own))
    within = F.expr("hi >= mlo AND lo <= mhi OR far >= dlo AND near <= dhi")
    ends = cut(h.groupBy(*by).agg(*[F.first(k).alias(k) for k in ("n", "k0", "k1", "mlo", "mhi", "dlo", "dhi")], F.sum(F.when(within, F.col("rows"))).alias("rows")))
    if (ends.agg(F.max("rows")).first()[0] or 0) > limit:
        m = cut(quantiles(df, value, 0.5, by, "m", most, limit, weight=weight).where("m is not null"))
        mad = quantiles(df.join(m, by).withColumn("_d", F.abs(v - F.col("m"))), "_d", 0.5, by, "mad", most, limit, weight=weight)
        return m.join(mad, by)
    x = d.join(ends.drop("rows"), by).withColumn("near", F.expr("greatest(0D, _v - mhi, mlo - _v)")).withColumn("far", F.expr("greatest(_v - mlo, mhi - _v)"))
    kept = F.expr("CASE WHEN _v BETWEEN mlo AND mhi OR far >= dlo AND near <= dhi THEN _v END").alias("_s")  # the others are only counted
    x = x.groupBy(*by, kept, F.expr("_v < mlo").alias("_low"), F.expr("far < dlo").alias("_close")).agg(F.sum("_c").alias("c"), *[F.first(k).alias(k) for k in ("k0", "k1", "mlo", "mhi")])
    x = x.withColumn("_in", F.coalesce(F.expr("_s BETWEEN mlo AND mhi"), F.lit(False)))

    def two(o: str, among: str, before: str) -> list:
        """Values of ``o`` at both middle ranks, from the rows ``among`` and the count of those ``before``."""
        base = F.sum(F.expr(f"IF({before}, c, 0L)")).over(own)
        u = base + F.sum(F.expr(f"IF({among}, c, 0L)")).over(own.orderBy(o).rowsBetween(Window.unboundedPreceding, 0))
        return [F.when(F.expr(among) & (u > F.col(k)), F.col(o)) for k in ("k0", "k1")]

    half = lambda a, b: F.when(F.col("k0") == F.col("k1"), a).otherwise(0.5 * a + 0.5 * b)
    a, b = two("_s", "_in", "_low")
    x = x.withColumn("a", a).withColumn("b", b).withColumn("m", half(F.min("a").over(own), F.min("b").over(own)))
    x = x.withColumn("_d", F.expr("IF(_close, NULL, abs(_s - m))"))
    a, b = two("_d", "_d IS NOT NULL", "_close")
    x = x.withColumn("a", a).withColumn("b", b).groupBy(*by).agg(F.first("m").alias("m"), F.min("a").alias("a"), F.min("b").alias("b"), F.first("k0").alias("k0"), F.first("k1").alias("k1"))
    return x.select(*by, "m", half(F.col("a"), F.col("b")).alias("mad"))
