"""Streams on event time with timers, keyed tables with replay, landed JSON: against the batch forms, over restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helioflux.operators import matching as M
from helioflux.streaming import sinks, timers

FOUND = "region string, id long, band string, onset double, peak double"
END = 1e9  # far behind all data: its watermark brings out what is open


def run(spark, make, schema, src, out, state):
    """One run over what lies in ``src``; the state goes on from the last run."""
    d = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))
    q = d.writeStream.option("checkpointLocation", str(state)).trigger(availableNow=True).format("parquet").option("path", str(out)).start()
    q.awaitTermination(240)
    return spark.read.schema(d.schema).parquet(str(out))


def land(src, name, rows):
    src.mkdir(exist_ok=True)
    (src / f"{name}.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_pairs_over_two_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows, t = [], 1000.0
    for i in range(120):
        t += rng.uniform(10, 700)
        rows.append({"region": rng.choice("ab"), "id": i, "band": rng.choice(["soft", "hard"]), "onset": round(t, 3), "peak": round(t + rng.uniform(5, 200), 3)})
    mixed = rows[:55] + rows[58:64]  # the rest of these minutes comes late, after the restart, within the delay
    late = rows[55:58] + rows[64:]
    src, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    rng.shuffle(mixed)
    land(src, "1", mixed)
    first = run(spark, lambda d: timers.pair_stream(d, delay="6 hours"), FOUND, src, out, state).count()
    rng.shuffle(late)
    land(src, "2", late)
    run(spark, lambda d: timers.pair_stream(d, delay="6 hours"), FOUND, src, out, state)
    land(src, "3", [{"region": r, "id": 900 + k, "band": "soft", "onset": END, "peak": None} for k, r in enumerate("ab")])
    got = run(spark, lambda d: timers.pair_stream(d, delay="6 hours"), FOUND, src, out, state)
    got = {(r["soft_id"], r["hard_id"], round(r["score"], 6)) for r in got.collect()}
    want = set()
    for region in "ab":
        d = spark.createDataFrame([(r["id"], r["band"], r["onset"], r["peak"]) for r in rows if r["region"] == region], "id long, band string, onset double, peak double")
        want |= {(r["soft_id"], r["hard_id"], round(r["score"], 6)) for r in M.associate(d).collect()}
    assert got == want and any(None not in (a, b) for a, b, _ in got) and first < len(got)


def test_a_timer_ends_the_open_burst(spark, tmp_path):
    rng = random.Random(6)
    schema = "stream string, event_id long, t double, value double"
    rows = [{"stream": rng.choice("xy"), "event_id": i, "t": 1000.0 + 60 * i + rng.randrange(30), "value": float(rng.choice([1, 1, 1, 8, 9]))} for i in range(200)]
    src, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    land(src, "1", rows[:90][::-1])
    run(spark, lambda d: timers.burst_stream(d, 5.0, 120.0), schema, src, out, state)
    land(src, "2", rows[90:][::-1])
    run(spark, lambda d: timers.burst_stream(d, 5.0, 120.0), schema, src, out, state)
    land(src, "3", [{"stream": "z", "event_id": 999, "t": END, "value": 0.0}])
    got = run(spark, lambda d: timers.burst_stream(d, 5.0, 120.0, delay="10 minutes"), schema, src, out, state)
    want = timers.bursts(spark.createDataFrame([tuple(r.values()) for r in rows], schema), 5.0, 120.0)
    key = lambda d: sorted((r["stream"], r["onset"], r["last"], r["t_peak"], r["peak"], r["n"]) for r in d.collect())
    assert key(got) == key(want)


# --- keyed tables ----------------------------------------------------------------------------------------------------------------
ALERT = "event_id string, t double, level string"


def test_keyed_table_rewrites_only_what_a_batch_touches(spark, tmp_path):
    schema = spark.createDataFrame([], ALERT).schema
    table = sinks.KeyedTable(spark, f"file://{tmp_path}/alerts", ["event_id"], "t", schema, buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, ALERT)
    assert table.read().collect() == [] and table.last_batch() == -1
    assert table.upsert(frame([(f"e{i}", float(i), "watch") for i in range(40)] + [(None, 1.0, "none")]), 0)
    before = table.versions()
    assert table.upsert(frame([("e3", 100.0, "warn"), ("e3", 90.0, "old"), ("new", 1.0, "watch")]), 1)
    after = table.versions()
    assert 1 <= sum(after[k] != before.get(k) for k in after) <= 2  # two keys, two buckets at most
    got = {r["event_id"]: (r["t"], r["level"]) for r in table.read().collect()}
    assert len(got) == 42 and got["e3"] == (100.0, "warn") and got["e4"] == (4.0, "watch") and got[None] == (1.0, "none")
    assert not table.upsert(frame([("e3", 999.0, "again")]), 1)  # a batch that comes again
    assert {r["event_id"]: (r["t"], r["level"]) for r in table.read().collect()} == got
    assert table.upsert(frame([("e3", 100.0, "equal, later"), ("e4", 1.0, "too old")]), 2)
    got = {r["event_id"]: r["level"] for r in table.read().collect()}
    assert got["e3"] == "equal, later" and got["e4"] == "watch"
    assert table.vacuum() > 0 and {r["event_id"]: r["level"] for r in table.read().collect()} == got
    assert table.upsert(frame([]), 3) and table.read().count() == 42


def test_a_batch_that_fails_before_its_commit_is_done_anew(spark, tmp_path):
    schema = spark.createDataFrame([], ALERT).schema
    table = sinks.KeyedTable(spark, f"file://{tmp_path}/alerts", ["event_id"], "t", schema, buckets=2)
    table.upsert(spark.createDataFrame([("a", 1.0, "x")], ALERT), 0)
    fs, p = table._fs(f"{table.path}/commits/1")
    table.upsert(spark.createDataFrame([("a", 2.0, "y")], ALERT), 1)
    fs.delete(p, True)  # as if the writer had died before
    assert table.read().first()["level"] == "x"
    assert table.upsert(spark.createDataFrame([("a", 2.0, "y")], ALERT), 1) and table.read().first()["level"] == "y"


def test_alerts_and_forecasts_through_the_sink_with_a_restart(spark, tmp_path):
    schema = "horizon_min double, t double, p double"
    st = spark.createDataFrame([], schema).schema
    src = tmp_path / "in"
    path = f"file://{tmp_path}/forecasts"

    def go():
        d = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
        q = d.writeStream.foreachBatch(sinks.keyed_sink(path, ["horizon_min", "t"], "p", st, 4, every=2)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)

    land(src, "1", [{"horizon_min": 30.0, "t": 1.0, "p": 0.2}, {"horizon_min": 60.0, "t": 1.0, "p": 0.5}])
    go()
    land(src, "2", [{"horizon_min": 30.0, "t": 2.0, "p": 0.3}])
    land(src, "3", [{"horizon_min": 30.0, "t": 2.0, "p": 0.4}])
    go()
    t = sinks.KeyedTable(spark, path, ["horizon_min", "t"], "p", st, 4).read()
    assert sorted(map(tuple, t.collect())) == [(30.0, 1.0, 0.2), (30.0, 2.0, 0.4), (60.0, 1.0, 0.5)]
    assert {r["horizon_min"]: r["p"] for r in sinks.latest_forecast(t).collect()} == {30.0: 0.4, 60.0: 0.5}
    assert [r["p"] for r in sinks.forecasts_between(t, 3.0, 0.0, 30.0).collect()] == [0.2, 0.4]
