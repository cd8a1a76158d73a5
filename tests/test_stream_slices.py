"""Streams over a table in slices of time: the rows of the batch form, and a state that a timer reads in parts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from helioflux.operators import detect as D
from helioflux.plans.registry import streams
from helioflux.state import machines as S
from helioflux.streaming import detectors, timers


def events(spark, tmp_path, n=240):
    rng = random.Random(8)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(40_000)), 1, rng.choice(["view", "click"]), float(rng.randrange(100)), '{"k":1}') for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    return spark.read.parquet(f"{tmp_path}/events.parquet")


def test_the_parity_detector_over_slices(spark, tmp_path):
    events(spark, tmp_path)
    cols = ["event_id", "stream", "statistic", "baseline", "sigma", "in_event", "onset"]
    say = lambda d: sorted(map(str, d.select(*cols).collect()))
    want = D.run_machine(streams(spark, str(tmp_path)), S.Parity, lambda m, x, t: m.update(x, t), "statistic double, baseline double, sigma double, in_event boolean, onset double")
    assert say(detectors.run_available(spark, str(tmp_path), rows=90)) == say(want)


def test_bursts_over_slices(spark, tmp_path):
    e = events(spark, tmp_path)
    say = lambda d: sorted(map(str, d.select("stream", *[F.round(c, 3) for c in ("onset", "last")], "peak", "n").collect()))
    got, want = say(timers.run_bursts(spark, e, 60.0, 900.0, rows=90)), say(timers.bursts(streams(spark, str(tmp_path)), 60.0, 900.0))
    assert got == want and len(want) > 5


class Handle:
    """The state and the timers of one key."""

    def __init__(self):
        self.value, self.map, self.timers, self.reads = None, {}, set(), 0

    def getValueState(self, name, schema):
        h = self

        class Value:
            exists = staticmethod(lambda: h.value is not None)
            get = staticmethod(lambda: h.value)

            @staticmethod
            def update(v):
                h.value = v

        return Value()

    def getMapState(self, name, key, value):
        h = self

        class Map:
            @staticmethod
            def getValue(k):
                h.reads += 1
                return h.map[k]

            updateValue = staticmethod(lambda k, v: h.map.update({k: v}))
            removeKey = staticmethod(lambda k: h.map.pop(k))

        return Map()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_one_timer_stands_for_all_rows_that_wait():
    import pandas as pd

    m = timers.InOrder(lambda: timers.Burst(5.0, 30.0), lambda m, r: m.push(r["t"], r["value"]), lambda m, t: m.end(t), lambda m: None if m.open is None else m.open[1] + m.quiet + 0.001, "t", ("t", "event_id"), ["stream", *"abcde"])
    h = Handle()
    m.init(h)
    rows = pd.DataFrame({"stream": "x", "event_id": range(2000), "t": [10.0 * i for i in range(2000)], "value": [9.0 if i % 10 < 3 else 1.0 for i in range(2000)]})
    list(m.handleInputRows(("x",), iter([rows.iloc[::2], rows.iloc[1::2]]), Watermark(0)))
    assert len(h.timers) == 1
    h.reads, fired, out = 0, 0, []
    while any(t <= 15_000_000 for t in h.timers):
        h.timers.discard(min(h.timers))
        fired += 1
        out += [r for d in m.handleExpiredTimer(("x",), Watermark(15_000_000), None) for r in d.itertuples(index=False, name=None)]
    assert fired == 1 and len(out) == 150 and out[1] == ("x", 100.0, 120.0, 100.0, 9.0, 3)
    assert h.reads <= 26 and min(h.map) == (25,)  # slots that are not due are not read
