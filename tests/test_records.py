"""Records, bursts, fusion of a quantity, saved forecasters and the streaming sinks, against small cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from helioflux.operators import detect, fusion, model, records
from helioflux.operators.events import range_join
from helioflux.state import machines as S
from helioflux.streaming.detectors import latest_sink, newest_per_trigger


def test_range_join_keeps_repeats_and_nulls(spark):
    left = spark.createDataFrame([(1, 10.0, None), (1, 10.0, None), (2, 50.0, "x"), (3, None, "y")], "id int, t double, note string")
    right = spark.createDataFrame([(11.0,), (9.0,), (90.0,)], "u double")
    semi = range_join(left, right, "t", "u", 2.0, 2.0, how="left_semi")
    anti = range_join(left, right, "t", "u", 2.0, 2.0, how="left_anti")
    assert sorted(map(tuple, semi.collect())) == [(1, 10.0, None), (1, 10.0, None)]
    assert sorted(map(tuple, anti.collect())) == [(2, 50.0, "x"), (3, None, "y")]


def test_collector_of_both_bands():
    soft = S.Collector("soft")
    steps = [({"in_event": False}, 1.0), ({"onset": 1.0, "in_event": True}, 2.0), ({"peak": 2.0, "peak_value": 5.0, "spike": True}, 5.0), ({"end": 3.0}, 1.0), ({"onset": 4.0}, 3.0)]
    got = [soft.push(r, x, float(t)) for t, (r, x) in enumerate(steps)]
    assert got[:3] == [None, None, None] and got[4] is None
    assert got[3] == {"onset": 1.0, "peak": 2.0, "end": 3.0, "peak_value": 5.0, "spikes": 1}
    assert soft.flush() == {"onset": 4.0, "peak": None, "end": None, "peak_value": 0.0, "spikes": 0} and soft.flush() is None
    hard = S.Collector("hard")
    seen = [hard.push(r, x, float(t)) for t, (r, x) in enumerate([({"onset": 0.0, "in_event": True}, 3.0), ({"in_event": True}, 9.0), ({"in_event": False}, 2.0)])]
    assert seen[2]["peak"] == 1.0 and seen[2]["peak_value"] == 9.0


def test_band_flares_flush_the_open_burst(spark):
    rows = [(i, "view", 60.0 * i, 1e-7 * (1 + max(0, i - 200) * 0.8)) for i in range(230)]
    f = detect.band_flares(spark.createDataFrame(rows, "event_id long, stream string, t double, value double"), "soft", 60.0).collect()
    assert len(f) == 1 and f[0]["end"] is None and f[0]["onset"] >= 60.0 * 190 and f[0]["peak"] == f[0]["onset"]


def test_fuse_quantity_weights(spark):
    cells = [("a", 0, -1.0, 0.1, "GOOD"), ("a", 1, 100.0, None, "GOOD"), ("b", 1, 110.0, 5.0, "INTERPOLATED"), ("c", 1, 90.0, 0.0, "GOOD"), ("a", 2, 105.0, 4.0, "FILLED"), ("a", 3, float(0), 4.0, "GOOD")]
    d = spark.createDataFrame(cells, "source_id string, cell long, value double, sigma double, flag string")
    known = spark.createDataFrame([("a", 0.8, 6.0), ("b", 0.9, 1.0)], "source_id string, reliability double, typical_sigma double")
    got = {r["cell"]: r for r in fusion.fuse_quantity(d, known, "SXR_LONG", 60.0).collect()}
    assert set(got) == {1, 2, 3}  # nothing before the first data, cells without data afterwards
    k = S.Kalman()
    k.step([], 0.0)  # the first cell has no data
    ln = math.log(10)
    want = [k.step([(2.0, 6.0 / (ln * 100), 0.8), (math.log10(110), 5.0 / (ln * 110), 0.45), (math.log10(90), 9.0 / (ln * 90), 1.0)], 60.0), k.step([(math.log10(105), 4.0 / (ln * 105), 0.56)], 60.0), k.step([], 60.0)]
    for i, (v, s, _) in enumerate(want, 1):
        assert got[i]["value"] == pytest.approx(v) and got[i]["sigma"] == pytest.approx(s)
    logs = [2.0, math.log10(110), math.log10(90)]
    mean = sum(logs) / 3
    assert got[1]["quality"] == pytest.approx(2 / 3 * (1 - math.sqrt(sum((x - mean) ** 2 for x in logs) / 3) / 0.5))
    assert got[1]["provenance"] == ["a", "b", "c"] and got[3]["provenance"] == [] and got[3]["quality"] == 0


def test_run_fusion_bridges_short_gaps(spark):
    rows = [("a", 60.0 * i, 100.0, 2.0, 1) for i in range(10) if i not in (4, 5)] + [("b", 60.0 * i, 100.0, 2.0, 1) for i in range(10)]
    d = spark.createDataFrame(rows, "source_id string, t double, value double, sigma double, bits int")
    known = spark.createDataFrame([("a", 0.8, 6.0)], "source_id string, reliability double, typical_sigma double")
    got = {r["cell"]: r for r in fusion.run_fusion(d, known, "SXR_LONG", 0.0, 60.0).collect()}
    assert set(got) == set(range(10)) and all(r["value"] == pytest.approx(100.0, rel=1e-6) for r in got.values())
    assert got[4]["provenance"] == ["a", "b"] and got[4]["quality"] == pytest.approx(0.5) and got[3]["quality"] == pytest.approx(1.0)


def test_saved_forecaster_predicts_the_same(spark, tmp_path):
    d = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), ((F.col("id") % 20) > 12).cast("int").alias("y"))
    m = model.Forecaster.fit(d, ["x"], rounds=3).calibrate(d)
    m.save(f"file://{tmp_path}/m")
    a, b = (sorted((r["x"], round(r["p"], 9)) for r in k.predict(d).collect()) for k in (m, model.Forecaster.load(f"file://{tmp_path}/m")))
    assert a == b


def test_sinks(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "stream string, t double, event_id long")
    put = latest_sink(f"file://{tmp_path}/s")
    put(frame(("a", 1.0, 1), ("b", 5.0, 2)), 0)
    put(frame(("a", 3.0, 3), ("b", 4.0, 4)), 1)
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/s/1").collect())) == [("a", 3.0, 3), ("b", 5.0, 2)]
    with pytest.raises(Exception, match="(?i)path"):  # what cannot be read is not taken for empty
        put(frame(("a", 9.0, 9)), 7)
    seen = []
    newest_per_trigger(lambda b, n: seen.append((n, sorted(map(tuple, b.collect())))))(frame(("a", 1.0, 1), ("a", 2.0, 2), ("b", 1.0, 3)), 4)
    assert seen == [(4, [("a", 2.0, 2), ("b", 1.0, 3)])]


def test_event_fields_of_other_shapes(spark):
    e = spark.createDataFrame([(5.0, None), (6.0, "M1.0")], "t_peak double, cls string")
    assert [(r["t_peak"], r["goes_class"], r["t_start"]) for r in records.event_fields(e).collect()] == [(5.0, "C1.0", None), (6.0, "M1.0", None)]
    with pytest.raises(ValueError, match="t_peak"):
        records.event_fields(e.drop("t_peak"))


def test_sessions_across_blocks(spark):
    import random

    from helioflux.operators.series import sessions

    rng = random.Random(3)
    times = sorted([rng.uniform(0, 4 * 86400) for _ in range(300)] + [86400.0, 86400.0, 2 * 86400.0 - 1, 2 * 86400.0 + 1, 9 * 86400.0])
    want, run, last = {}, 0, None
    for t in times:
        run += last is None or t - last > 600.0
        last, want[t] = t, run
    d = spark.createDataFrame([(t,) for t in times] + [(None,)], "t double")
    got = sessions(d, 600.0).collect()
    assert len(got) == len(times) and {r["t"]: r["session"] for r in got} == want
