import math

from pyspark.sql import functions as F


def test_sql_functions(spark):
    from helioflux.functions.sql import register

    assert "class_rank" in register(spark)
    r = spark.sql("SELECT class_letter(2.5e-5D) a, class_to_flux('M2.5') b, class_to_flux('Mx') c, class_rank('X12.0') d, class_rank('M') e, bucket_of(7250D) f, match_score(1000D, 940D, 1100D, 990D) g, class_rank('Mx') h").first()
    assert r["a"] == "M" and math.isclose(r["b"], 2.5e-5) and r["c"] is None and math.isclose(r["d"], 5.2) and math.isclose(r["e"], 3.1) and r["f"] == 2
    assert math.isclose(r["g"], 0.7 * 0.8 + 0.3) and r["h"] == -1


def test_forecaster_learns(spark):
    from helioflux.operators.model import Forecaster
    from helioflux.operators.verify import roc_auc

    d = spark.range(2000).select((F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("a"), (F.pmod(F.xxhash64(F.col("id") + 5), F.lit(1000)) / 1000.0).alias("b")).withColumn("y", ((F.col("a") + 0.2 * F.col("b")) > 0.9).cast("int"))
    m = Forecaster.fit(d, ["a", "b"], rounds=3, depth=3).calibrate(d)
    p = m.predict(d)
    assert p.columns == ["a", "b", "y", "p"] and roc_auc(p).first()["roc_auc"] > 0.95
