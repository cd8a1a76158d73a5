"""Queries against their SQL on tables with zeros, values beyond their scale and crowded times."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from helioflux.plans import QUERIES, SQL


def table(tmp_path, rows):
    """A folder with ``events`` of (minutes, type, value, k)."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), i % 7, s, v, f'{{"k":{k}}}') for i, (m, s, v, k) in enumerate(rows)])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    return con


def same(spark, con, tmp_path, name):
    want = con.execute(SQL[name])
    cols = [c[0] for c in want.description]
    say = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    got = say(QUERIES[name](spark, str(tmp_path)).select(*cols).collect())
    assert got == say(want.fetchall()) and got


@pytest.mark.parametrize("name", ["fn_noisy_or", "fuse_quality", "features_tensor"])
def test_zeros_and_values_beyond_scale(spark, tmp_path, name):
    rng = random.Random(5)
    rows = [(rng.random() * 5000, rng.choice(["view", "click", "error"]), rng.choice([0.0, 12.5, 499.73, 600.0, 731.2]), rng.choice([0, 3, 50, 99, 100, 140])) for _ in range(60)]
    rows += [(9000.0, "view", 0.0, 1), (20000.0, "view", 3.0, 2)]  # single samples of a day
    rows += [(10.0, "view", 0.0, 0), (11.0, "view", 0.0, 0)]  # samples that look like padding
    same(spark, table(tmp_path, rows), tmp_path, name)


@pytest.mark.parametrize("name", ["features_wide", "features_final"])
def test_features_of_a_soft_zero(spark, tmp_path, name):
    rng = random.Random(6)
    rows = [(20.0 * i + rng.random(), ("view", "click")[i % 2], 0.0 if i in (30, 31, 50) else round(rng.expovariate(1 / 50), 2), rng.randrange(100)) for i in range(80)]
    want = table(tmp_path, rows).execute(SQL[name])
    cols = [c[0] for c in want.description]
    got, want = (sorted(map(tuple, r), key=lambda r: str(r[0])) for r in (QUERIES[name](spark, str(tmp_path)).select(*cols).collect(), want.fetchall()))
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        assert g == (g[0], *(pytest.approx(x, rel=1e-12, abs=1e-9, nan_ok=True) for x in w[1:])) and g[0] == w[0]


def test_features_stay_finite_by_default(spark):
    from helioflux.operators.features import FEATURES, features

    rows = [(i, "view", 60.0 * i, (5.0, 0.0, float("nan"))[i % 3], i % 4) for i in range(12)]
    got = features(spark.createDataFrame(rows, "event_id long, stream string, t double, value double, k int")).collect()
    assert len(got) == 12 and all(abs(r[c]) < float("inf") for r in got for c in FEATURES)


def test_a_stream_comes_to_python_in_batches(spark):
    from helioflux.operators.blocks import sequential

    rows = [(s, float(i), i) for s in ("a", "b", None) for i in range(500)]
    d = spark.createDataFrame(rows, "stream string, t double, event_id long").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:

        def step(m, g):
            assert len(g) <= 64
            out = []
            for e in g["event_id"]:
                m[0] += 1
                out.append((e, m[0]))
            return out

        got = sequential(d, lambda: [0], step, "event_id long, n long", close=lambda m: [(-1, m[0])]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((str(r["stream"]), r["n"] - r["event_id"]) for r in got) == sorted([(s, 1) for s in ("a", "b", "None") for _ in range(500)] + [(s, 501) for s in ("a", "b", "None")])


def test_bounds_of_pulses_broadcast_nothing(spark, capsys):
    from helioflux.operators.records import pulse_bounds

    rows = [(i, float(t), float(max(0, 5 - abs(t - 5))), 5.0) for i in range(20) for t in range(11)] + [(99, 1.0, 5.0, 5.0)]
    d = pulse_bounds(spark.createDataFrame(rows, "id long, t double, value double, amplitude double"))
    assert {tuple(r) for r in d.collect()} == {*((i, 1.0, 8.0) for i in range(20)), (99, 1.0, 1.0)}
    d.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_correlation_of_what_stands_still(spark):
    from helioflux.operators.series import ordered, rolling_corr

    rows = [(i, "a", float(i), 3.0, float(i % 4)) for i in range(40)] + [(i, "b", float(i), float(i), 2.0 * i) for i in range(5)]
    d = spark.createDataFrame(rows, "event_id long, stream string, t double, value double, k double")
    got = {(r[0], round(r[1], 9)) for r in d.select("stream", rolling_corr(F.col("value"), F.col("k"), ordered())).collect()}
    assert got == {("a", 0.0), ("b", 0.0), ("b", 1.0)}
