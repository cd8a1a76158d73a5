"""Structured Streaming twins: the same state machines with keyed state, and sinks that keep the newest."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.common import shared_root
from ..state import machines as S


def detect_stream(df: DataFrame, make: Callable[[], object], step: Callable[[object, float, float], tuple], schema: str, by: str = "stream") -> DataFrame:
    """One machine per key over a stream of (by, t, event_id, value); rows (event_id, by, *schema).

    A batch's samples are put in order; samples older than the key's last one are dropped, as the machine cannot go back.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine, last = cloudpickle.loads(state.get[0]) if state.exists else (make(), float("-inf"))
        g = pd.concat([p[["event_id", "t", "value"]] for p in parts]).sort_values(["t", "event_id"])
        for at in range(0, len(g), 10_000):
            rows, some = [], g.iloc[at : at + 10_000]
            for e, t, x in zip(some["event_id"], some["t"], some["value"], strict=True):
                if t < last:
                    continue
                last = t
                rows.append((e, key[0], *step(machine, x, t)))
            yield pd.DataFrame(rows, columns=["event_id", by, *names])
        state.update((cloudpickle.dumps((machine, last)),))

    return df.groupBy(by).applyInPandasWithState(run, f"event_id long, {by} string, {schema}", "machine binary", "append", GroupStateTimeout.NoTimeout)


def event_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """``events`` files as a stream of tidy samples."""
    from ..plans.registry import micros

    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return raw.select("event_id", F.col("event_type").alias("stream"), (micros(F.col("ts")) / F.lit(1e6)).alias("t"), "value")


def land_in_order(events: DataFrame, path: str, rows: int = 2_000_000) -> None:
    """``events`` as files of about ``rows`` rows in order of time, one written after the other, so that a stream that takes a file at a time never goes back.

    Rows of one time share a file.
    """
    from ..plans.registry import micros

    us, n = micros(F.col("ts")), max(1, math.ceil(events.count() / rows))
    ends = events.agg(F.percentile_approx(us, [i / n for i in range(1, n)], 1_000_000)).first()[0] if n > 1 else []  # n - 1 numbers
    ends = sorted(set(ends or []))
    for lo, hi in zip([None, *ends], [*ends, None], strict=True):
        own = F.lit(True) if hi is None else (us <= hi)
        own = (own if lo is None else own & (us > lo)) | (us.isNull() if lo is None else F.lit(False))
        events.where(own).coalesce(1).write.mode("append").parquet(path)


def tumbling(df: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed counts and peaks of a stream, with a watermark for late samples."""
    d = df.withColumn("ts", F.timestamp_micros(F.rint(F.col("t") * 1e6).cast("long"))).withWatermark("ts", late)
    return d.groupBy("stream", F.window("ts", width)).agg(F.count("*").alias("n"), F.max("value").alias("peak"))


def latest_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: the newest sample per stream, as a table that is replaced as a whole.

    Every batch but the first reads what the one before it wrote; if that cannot be read, the batch fails and nothing is lost.
    """

    def write(batch: DataFrame, number: int) -> None:
        from ..operators.events import latest

        if number > 0:
            batch = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/{number - 1}"))
        latest(batch, ["stream"], ["t", "event_id"]).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/{number}")

    return write


def newest_per_trigger(handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch: hands on the newest sample of each stream in the batch only, as a poller of the latest value sees it."""

    def write(batch: DataFrame, number: int) -> None:
        from ..operators.events import latest

        handle(latest(batch, ["stream"], ["t", "event_id"]).select(*batch.columns), number)

    return write


def run_available(spark: SparkSession, sf_dir: str, rows: int = 2_000_000) -> DataFrame:
    """The parity detector as a stream over all of ``events``, about ``rows`` at a time; returns what it wrote."""
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    whole = spark.read.parquet(f"{sf_dir}/events.parquet")
    land_in_order(whole, f"{root}/in", rows)
    src = event_stream(spark, f"{root}/in", whole.schema, 1)
    out = detect_stream(src, S.Parity, lambda m, x, t: m.update(x, t), "statistic double, baseline double, sigma double, in_event boolean, onset double")
    q = out.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).format("parquet").option("path", f"{root}/out").start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


__all__ = ["detect_stream", "event_stream", "land_in_order", "latest_sink", "newest_per_trigger", "run_available", "tumbling"]
