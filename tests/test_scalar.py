import math

import pytest
from pyspark.sql import functions as F

from helioflux.functions import scalar as X


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("flux", "want"), [(2.5e-5, "M2.5"), (1e-4, "X1.0"), (9.9e-5, "M9.9"), (1.2e-3, "X12.0"), (5e-8, "A5.0"), (1e-9, "A0.1"), (0.0, "A0.0"), (-1.0, "A0.0"), (9.96e-6, "C10.0")])
def test_classify_flux(spark, flux, want):
    assert one(spark, X.classify_flux(F.lit(flux))) == want


@pytest.mark.parametrize(("cls", "want"), [("M2.5", 2.5e-5), ("X1.0", 1e-4), ("C5", 5e-6), ("M", 1e-5), ("m2", 2e-5), ("Q1", None), ("Mx", None)])
def test_class_to_flux(spark, cls, want):
    got = one(spark, X.class_to_flux(F.lit(cls)))
    assert got is None if want is None else math.isclose(got, want)


def test_class_orders_differ(spark):
    assert one(spark, X.class_rank(F.lit("M0.5"))) < one(spark, X.class_rank(F.lit("M")))
    assert one(spark, X.class_at_least(F.lit("M0.5"), "M"))
    assert one(spark, X.class_rank(F.lit(""))) == -1


def test_unknown_platform_raises(spark):
    with pytest.raises(Exception, match="unknown platform"):
        one(spark, X.platform_radius(F.lit("Nowhere")))
    assert math.isclose(one(spark, X.ltt_delta(X.platform_radius(F.lit(" solar  orbiter ")))), 0.5 * 1.495978707e8 / 299792.458)


def test_noisy_or_clamps(spark):
    assert one(spark, X.noisy_or(F.array(F.lit(0.5), F.lit(0.5)))) == 0.75
    assert one(spark, X.noisy_or(F.array(F.lit(2.0), F.lit(-1.0)))) == 1.0
    assert one(spark, X.noisy_or(F.array().cast("array<double>"))) == 0.0


def test_match_score_is_asymmetric(spark):
    s = lambda a, b: one(spark, X.match_score(F.lit(a), F.lit(b), F.lit(1100.0), F.lit(990.0)))
    assert math.isclose(s(1000.0, 940.0), 0.7 * (1 - 60 / 300) + 0.3)
    assert s(1000.0, 850.0) < s(1000.0, 1150.0)
    assert math.isclose(s(1000.0, 2000.0), 0.3)


def test_hms(spark):
    assert one(spark, X.hms(F.lit(90061.4))) == "25:01:01"
    assert one(spark, X.hms(F.lit(-61.0))) == "-00:01:01"


def test_time_parsing(spark):
    from helioflux.sources.feeds import parse_time

    for text in ("2024-01-01T00:00:00Z", "2024-01-01 00:00:00", "2024-01-01T00:00:00+00:00"):
        assert one(spark, parse_time(F.lit(text))) == 1704067200.0
    assert one(spark, parse_time(F.lit("no time"))) is None


def test_rounded_is_round(spark):
    odd = [0.0, -0.0, 0.5, 2.675, -2.675, 1.000005, -1.000005, 0.1234565, 1.0000005, 1e-9, -1e-9, 999999.999995, 1e6, 123456789.123456789, 1e300, -1e300, math.inf, -math.inf, math.nan, None]
    d = spark.createDataFrame([(x,) for x in odd], "x double").unionByName(spark.range(20_000).select(((F.xxhash64("id") % 10**12) / 7e7).alias("x"))).unionByName(spark.range(4001).select(((F.col("id") - 2000) / 2e5).alias("x")))
    for places in (5, 6):
        text = lambda c: c.cast("string")
        assert d.where(~text(X.rounded("x", places)).eqNullSafe(text(F.round("x", places)))).count() == 0
