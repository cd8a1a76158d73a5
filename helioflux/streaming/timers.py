"""Machines on event time: rows wait for the watermark, are taken in order, and timers close what is still open.

A stream gives the rows of the batch form (``operators.blocks.settle`` with the same machine and step), whatever the order of arrival
within the watermark's delay, and across restarts. Needs the RocksDB state store (see ``use_rocksdb``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K
from ..operators.common import shared_root
from ..state import machines as S


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Per key: rows that wait, and a machine that takes them in order once the watermark has passed them.

    ``step(machine, row)`` gives the rows of one input row; ``close(machine, t)`` those of what no row after time t can touch, and
    ``due(machine)`` the time at which it should be asked next, or None. ``keep(rows)`` tells which rows matter to the machine; the others move
    the watermark only. States are JSON. Rows wait in slots of event time, a state of their own each, and one timer stands for all
    of them, so that a timer reads what it takes and nothing else.
    """

    def __init__(self, make: Callable[[], object], step: Callable, close: Callable, due: Callable, time: str, order: Sequence[str], names: Sequence[str], keep: Callable | None = None) -> None:
        self.make, self.step, self.close_until, self.due, self.keep = make, step, close, due, keep
        self.time, self.order, self.names = time, list(order), list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "machine string, slots string, timer long")
        self.waiting = handle.getMapState("waiting", "slot long", "rows string")

    def _load(self) -> tuple[object, set[int], int | None]:
        m = self.make()
        if not self.state.exists():
            return m, set(), None
        machine, slots, timer = self.state.get()
        m.__dict__.update(json.loads(machine))
        return m, set(json.loads(slots)), timer

    def _save(self, m: object, slots: set[int], timer: int | None) -> None:
        self.state.update((json.dumps(m.__dict__), json.dumps(sorted(slots)), timer))

    def _hold(self, rows: list[dict], slots: set[int]) -> None:
        by_slot: dict[int, list[str]] = {}
        for r in rows:
            by_slot.setdefault(int(r[self.time] // SLOT), []).append(json.dumps(r))
        for s, new in by_slot.items():
            old = [self.waiting.getValue((s,))[0]] if s in slots else []
            self.waiting.updateValue((s,), ("\n".join(old + new),))
            slots.add(s)

    def _at(self, t: float | None, timer: int | None) -> int | None:
        """The timer for ``t`` (the first millisecond after it), if none is due before it."""
        if t is None:
            return timer
        ms = int(t * 1000) + 1
        if timer is not None:
            if timer <= ms:
                return timer
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms)
        return ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        m, slots, timer = self._load()
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        held, first = [], None
        for part in rows:
            part = part[part[self.time] >= passed]  # Spark leaves later ones out at the latest after the next batch
            part = part if self.keep is None else part[self.keep(part)]
            if not part.empty:
                least = float(part[self.time].min())
                first = least if first is None else min(first, least)
            held += [{k: None if v != v else v for k, v in r.items()} for r in part[[c for c in part.columns if c != "event_ts"]].to_dict("records")]
            if len(held) >= HELD:
                self._hold(held, slots)
                held = []
        self._hold(held, slots)
        self._save(m, slots, self._at(first, timer))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        m, slots, _ = self._load()
        now = (timerValues.getCurrentWatermarkInMs() - 1) / 1000
        done = lambda r: int(r[self.time] * 1000) / 1000 <= now
        left: list[dict] = []
        for s in sorted(s for s in slots if s * SLOT <= now):
            rows = [json.loads(r) for r in self.waiting.getValue((s,))[0].split("\n")]
            self.waiting.removeKey((s,))
            slots.discard(s)
            left += [r for r in rows if not done(r)]
            out: list[tuple] = []
            for r in sorted((r for r in rows if done(r)), key=lambda r: [r[c] for c in self.order]):
                out += self.close_until(m, r[self.time])
                out += self.step(m, r)
            if out:
                yield pd.DataFrame([(*key, *r) for r in out], columns=self.names)
        out = self.close_until(m, now)
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=self.names)
        self._hold(left, slots)
        ahead = [r[self.time] for r in left] or ([min(slots) * SLOT] if slots else [])  # a slot's start is no later than its rows
        later = self.due(m)
        self._save(m, slots, self._at(min([*ahead, *([] if later is None else [later])], default=None), None))

    def close(self) -> None:
        pass


#: Seconds of event time whose rows wait together, and the rows that are held before they go to their slots.
SLOT, HELD = 600.0, 200_000


def in_order_stream(df: DataFrame, by: str, time: str, make: Callable[[], object], step: Callable, schema: str, order: Sequence[str], delay: str = "10 minutes", close: Callable = lambda m, t: [], due: Callable = lambda m: None, keep: Callable | None = None) -> DataFrame:
    """Rows (by, *schema) of one machine per ``by`` over a stream with epoch seconds in ``time``; rows later than ``delay`` are left out."""
    use_rocksdb(df.sparkSession)
    names = [by, *[c.strip().split()[0] for c in schema.split(",")]]
    d = df.withColumn("event_ts", F.timestamp_micros((F.col(time) * 1e6).cast("long"))).withWatermark("event_ts", delay)
    return d.groupBy(by).transformWithStateInPandas(InOrder(make, step, close, due, time, order, names, keep), f"{by} {df.schema[by].dataType.simpleString()}, {schema}", "Append", "EventTime")


def pair_stream(found: DataFrame, by: str = "region", delay: str = "30 minutes", tau: float = K.MATCH_TAU, lead: float = K.LEAD_S, lag: float = K.LAG_S) -> DataFrame:
    """Events (by, soft_id, hard_id, t_start, score) of a stream of detections (by, id, band, onset, peak), one-to-one in order of arrival.

    A detection that still waits when the watermark is ``lag`` past it can find no partner any more: a timer brings it out alone.
    """

    def step(m: S.Associator, r: dict) -> list[tuple]:
        p = m.push_pair({"band": r["band"], "onset": r["onset"], "peak": r["peak"], "id": r["id"]})
        alone, m.lost = m.lost, []
        return [_alone(d) for d in alone] if p is None else [(p[0]["id"], p[1]["id"], min(p[0]["onset"], p[1]["onset"]), p[2])]

    wide = max(lead, lag)

    def close(m: S.Associator, t: float) -> list[tuple]:
        old = [d for w in m.waiting.values() for d in w if t - d["onset"] > wide]
        m.waiting = {b: [d for d in w if t - d["onset"] <= wide] for b, w in m.waiting.items()}
        return [_alone(d) for d in sorted(old, key=lambda d: (d["onset"], d["band"], d["id"]))]

    def due(m: S.Associator) -> float | None:
        return min((d["onset"] + wide + 0.001 for w in m.waiting.values() for d in w), default=None)

    return in_order_stream(found, by, "onset", lambda: S.Associator(tau, lead, lag), step, "soft_id long, hard_id long, t_start double, score double", ("onset", "band", "id"), delay, close, due)


def _alone(d: dict) -> tuple:
    return (d["id"] if d["band"] == "soft" else None, d["id"] if d["band"] == "hard" else None, d["onset"], 0.0)


class Burst:
    """An open burst per stream: from the first value of ``high`` or more to ``quiet`` seconds after the last one."""

    def __init__(self, high: float, quiet: float) -> None:
        self.high, self.quiet, self.open = high, quiet, None

    def push(self, t: float, x: float) -> list[tuple]:
        done = self.end(t)
        if x >= self.high:
            o = self.open
            self.open = [t, t, t, x, 1] if o is None else [o[0], t, *((t, x) if x > o[3] else o[2:4]), o[4] + 1]
        return done

    def end(self, t: float) -> list[tuple]:
        """The burst, if it is over at ``t``: (onset, end, peak time, peak, samples)."""
        if self.open is None or t - self.open[1] <= self.quiet:
            return []
        o, self.open = self.open, None
        return [tuple(o)]


def burst_stream(samples: DataFrame, high: float, quiet: float, by: str = "stream", delay: str = "10 minutes") -> DataFrame:
    """Bursts (by, onset, last, t_peak, peak, n) of a stream of samples (by, event_id, t, value); a timer ends one that nothing follows."""
    return in_order_stream(
        samples, by, "t", lambda: Burst(high, quiet), lambda m, r: m.push(r["t"], r["value"]), "onset double, last double, t_peak double, peak double, n long", ("t", "event_id"), delay,
        lambda m, t: m.end(t), lambda m: None if m.open is None else m.open[1] + m.quiet + 0.001,
        lambda rows: rows["value"] >= high,
    )


def bursts(samples: DataFrame, high: float, quiet: float, by: str = "stream") -> DataFrame:
    """The same in batch, by windows: samples of ``high`` or more, parted where ``quiet`` seconds lie between."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("t", "event_id")
    d = samples.where(F.col("value") >= high).withColumn("_new", F.coalesce(F.col("t") - F.lag("t").over(w) > quiet, F.lit(True)).cast("int"))
    d = d.withColumn("_run", F.sum("_new").over(w))
    top = F.struct(F.col("value"), -F.col("t"))
    return d.groupBy(by, "_run").agg(F.min("t").alias("onset"), F.max("t").alias("last"), F.max_by("t", top).alias("t_peak"), F.max("value").alias("peak"), F.count("*").alias("n")).drop("_run")


def run_bursts(spark: SparkSession, events: DataFrame, high: float, quiet: float, rows: int = 2_000_000) -> DataFrame:
    """The bursts of a whole table of events as a stream over about ``rows`` at a time in order of time: a run over the data, then one over a sample far behind it."""
    from .detectors import event_stream, land_in_order

    root = f"{shared_root(spark)}/bursts-{uuid.uuid4().hex}"
    land_in_order(events, f"{root}/in", rows)

    def run() -> DataFrame:
        out = burst_stream(event_stream(spark, f"{root}/in", events.schema, 1), high, quiet, delay="1 second")
        out.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).format("parquet").option("path", f"{root}/out").start().awaitTermination()
        return out

    run()
    last = events.agg(F.max_by(F.struct(*events.columns), "ts").alias("r")).select("r.*")
    last.withColumn("ts", F.col("ts") + F.expr("interval 3650 days")).withColumn("value", F.lit(high - 1).cast(events.schema["value"].dataType)).write.mode("append").parquet(f"{root}/in")
    out = run()
    return spark.read.schema(out.schema).parquet(f"{root}/out")
