"""Quantile tracks against exact ranks, drawn and rendered pulses, calibration and the report of the offline pipeline."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helioflux.operators.blocks import KLL_ERROR, quantile_track
from helioflux.operators.model import BASELINES, Forecaster
from helioflux.operators.verify import report
from helioflux.sources import synthetic as G


@pytest.mark.parametrize("q", [0.5, 0.9])
def test_rank_error_of_merged_sketches(spark, q):
    rng = random.Random(int(q * 10))
    rows = [("a" if i % 5 else "b", i * 30.0, rng.lognormvariate(0, 1 + (i > 9000))) for i in range(20_000)] + [("a", 5.0, None), ("a", None, 1.0)]
    track = quantile_track(spark.createDataFrame(rows, "stream string, t double, value double"), q, width=43_200.0).collect()
    assert len(track) == 2 * 14
    for r in track:
        seen = [x for s, t, x in rows if s == r["stream"] and t is not None and x is not None and t // 43_200 <= r["block"]]
        rank = sum(x <= r["quantile"] for x in seen) / len(seen)
        assert r["n"] == len(seen) and abs(rank - q) <= 2 * KLL_ERROR
    first = {r["stream"]: r for r in track if r["before"] is None}
    assert set(first) == {"a", "b"}


def test_draws_are_the_same_again_and_spread(spark):
    mix = {"B": 0.3, "C": 0.45, "M": 0.2, "X": 0.05}
    d = G.draw_pulses(spark.range(4000).withColumnRenamed("id", "k"), "k", 0.0, 1e6, mix)
    a, b = (sorted(map(tuple, x.collect())) for x in (d, d.repartition(7)))
    assert a == b
    share = {r["letter"]: r["n"] / 4000 for r in d.groupBy("letter").agg(F.count("*").alias("n")).collect()}
    assert all(abs(share[c] - mix[c]) < 0.03 for c in mix)
    lo = d.agg(F.min("t_peak"), F.max("t_peak"), F.min("n_spikes"), F.min("rise"), F.max("lead_s")).first()
    assert lo[0] >= 0 and lo[1] <= 1e6 and lo[2] >= 1 and lo[3] >= 60 and lo[4] <= 240


def test_counts_have_mean_and_spread_of_their_rate(spark):
    for rate in (0.0, 0.7, 12.0, 400.0):
        r = spark.range(20_000).select(G.counts(F.lit(rate), 3, F.col("id")).alias("n")).agg(F.avg("n"), F.var_pop("n"), F.min("n")).first()
        assert abs(r[0] - rate) <= 5 * math.sqrt(rate / 20_000) + 1e-9 and abs(r[1] - rate) <= 0.06 * rate + 0.02 and r[2] >= 0


def test_rendered_pulses_equal_the_formula(spark):
    pulses = [(1, 300.0, 2.0, 10.0, 60.0), (2, 340.0, 5.0, 20.0, 30.0)]
    got = {r["tick"]: r["flux"] for r in G.render(spark.createDataFrame(pulses, "id int, t_peak double, amplitude double, rise double, decay double"), 5.0, 1.0).collect()}
    for tick, flux in got.items():
        t = tick * 5.0
        want = 1 + sum(a * (math.exp(-0.5 * ((t - p) / r) ** 2) if t < p else math.exp(-(t - p) / d)) for _, p, a, r, d in pulses)
        assert flux == pytest.approx(want, abs=1e-10)
    assert G.noisy(G.render(spark.createDataFrame([], "id int, t_peak double, amplitude double, rise double, decay double"), 5.0), 1).collect() == []


def test_sigmoid_calibration_and_report(spark, tmp_path):
    u = lambda s: F.pmod(F.xxhash64(F.col("id") + s), F.lit(1000)) / 1000.0
    d = spark.range(3000).select(u(0).alias("a"), u(5).alias("b"), u(9).alias("c")).withColumn("y", (F.col("c") < F.col("a")).cast("int"))
    m = Forecaster.fit(d, ["a", "b"], rounds=3, depth=3).calibrate(d, method="sigmoid")
    p = m.predict(d)
    assert p.columns == ["a", "b", "c", "y", "p"]
    mean = p.agg(F.avg("p"), F.avg("y")).first()
    assert abs(mean[0] - mean[1]) < 0.02
    m.save(f"file://{tmp_path}/m")
    again = Forecaster.load(f"file://{tmp_path}/m", "sigmoid").predict(d)
    assert again.agg(F.sum("p")).first()[0] == pytest.approx(p.agg(F.sum("p")).first()[0])
    r = report(p.withColumns({"climatology": F.lit(mean[1]), "persistence": F.lit(0.001), "hawkes": F.col("a")}), None, BASELINES).first()
    assert r["climatology_skill_vs"] > 0.1 and r["persistence_skill_vs"] > 0.3 and abs(r["hawkes_skill_vs"]) < 0.1 and r["climatology_tss"] == 0.0
    with pytest.raises(ValueError, match="isotonic or sigmoid"):
        m.calibrate(d, method="other")


PULSE = "id long, t_peak double, amplitude double, rise double, decay double"


def test_ticks_of_a_small_table_of_pulses_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(G, "PULSES", 10, raising=False)
    one = spark.createDataFrame([(i, 400.0 * i, 5.0, 30.0, 90.0) for i in range(200)], PULSE).coalesce(1)
    d = G.lay_out(one, 30.0).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.countDistinct("tick").alias("ticks")).collect()
    assert len(d) >= 10 and max(r["n"] for r in d) < sum(r["n"] for r in d) / 5
    assert sum(r["ticks"] for r in d) < 2 * G.render(one, 30.0).count()  # a task's ticks are its own stretch


def test_trains_shuffle_pulses_and_not_ticks(spark):
    few = spark.createDataFrame([(1, 3000.0, 5.0, 60.0, 90.0), (2, 9000.0, 5.0, 1.0, 90.0)], PULSE)
    d = G.impulsive_train(few, 30.0, F.lit(3), F.lit(30.0))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    rows = {(r["id"], r["tick"]): r["hard"] for r in d.collect()}
    assert len(rows) == G.lay_out(few, 30.0).count() and max(x for (i, _), x in rows.items() if i == 1) > 0.1
