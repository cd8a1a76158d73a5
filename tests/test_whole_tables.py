"""Queries answer for every row of their tables, also for those that their SQL twins leave out."""

import bisect
import collections
import datetime
import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_queries import canon

from helioflux.plans import QUERIES, SQL

START = datetime.datetime(2024, 1, 1)
DAYS = 40


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A folder with 600 events of three streams over forty days, and the events as (id, stream, t, value, k) in order of time."""
    rng = random.Random(7)
    spots = sorted({rng.randrange(DAYS * 86400) for _ in range(600)} | {30, DAYS * 86400 - 30})
    rows = [(i, START + datetime.timedelta(seconds=s), i % 50, ("view", "click", "error")[rng.randrange(3)], round(rng.uniform(1, 160), 2), f'{{"k": {rng.randrange(100)}}}') for i, s in enumerate(spots)]
    folder = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    epoch = datetime.datetime(1970, 1, 1)
    return folder, [(r[0], r[3], (r[1] - epoch).total_seconds(), r[4], int(r[5][6:-1])) for r in rows]


def rows(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def by_sql(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    q = con.execute(SQL[name])
    names = [c[0] for c in q.description]
    return [dict(zip(names, r, strict=True)) for r in q.fetchall()]


def test_nearest_event_of_every_event(spark, table):
    folder, events = table
    peaks = [(t + 20.0 * k, i) for i, _, t, v, k in events if v >= 100]
    want = {i: min((abs(p - t), p, f) for p, f in peaks)[2] for i, _, t, _, _ in events}
    assert {r["event_id"]: r["near_event_id"] for r in rows(spark, folder, "join_nearest_event")} == want


def test_history_of_every_event(spark, table):
    folder, events = table
    starts = collections.defaultdict(list)
    for _, s, t, v, _ in events:
        if v >= 100:
            starts[s].append(t)
    want = {}
    for i, s, t, _, _ in events:
        ages = [t - x for x in starts[s][: bisect.bisect_right(starts[s], t)]]
        want[i] = (sum(a <= 21600 for a in ages), pytest.approx(sum(math.exp(-a / 21600) for a in ages), abs=2e-6), pytest.approx(min([1440, *[a / 60 for a in ages]]), abs=1e-4))
    got = {r["event_id"]: (r["n_events"], r["decayed"], r["minutes_since"]) for r in rows(spark, folder, "join_history")}
    assert got == want


def test_focus_over_all_streams_and_days(spark, table):
    folder, events = table
    want = {}
    for stream in ("view", "click", "error"):
        sums = [0.0]
        for i, s, _, v, _ in events:
            if s == stream:
                sums.append(sums[-1] + v)
                best = 0.0
                for start in range(len(sums) - 1):
                    m, c = len(sums) - 1 - start, sums[-1] - sums[start]
                    if c > m * 45.0:
                        best = max(best, c * math.log(c / (m * 45.0)) - (c - m * 45.0))
                want[i] = pytest.approx(best, abs=2e-5)
    assert {r["event_id"]: r["statistic"] for r in rows(spark, folder, "det_focus")} == want


@pytest.mark.parametrize("name", ["grid_zoh", "grid_interp", "gap_detect", "gap_fill", "gap_coverage"])
def test_grid_reaches_the_last_sample(spark, table, name):
    folder, _ = table
    assert canon(QUERIES[name](spark, folder).toPandas()) == canon(pd.DataFrame(by_sql(folder, name)))


def test_pairs_of_a_small_table_are_many_tasks(spark):
    """One file and one key: the pairs were made in one task."""
    from helioflux.operators.fusion import localize

    k = F.col("id")
    t = spark.range(300).coalesce(1).select(k.alias("idx"), k.cast("string").alias("source_id"), F.lit(1).alias("grp"), (k * 0.01).alias("t"), (F.cos(k) * 1e8).alias("x"), (F.sin(k) * 1e8).alias("y"), (k % 7 * 1e7).alias("z"), F.lit(0.001).alias("sigma"))
    d = localize(t, ["grp"])
    assert d.select("a", "b").distinct().count() == d.count() == 300 * 299 // 2
    assert all(int(r["a"]) < int(r["b"]) for r in d.select("a", "b").collect())
    per = [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) >= 4 and max(per) < sum(per) / 2


def test_events_of_one_hour_are_paired_by_many_tasks(spark, tmp_path):
    from helioflux.plans import QUERIES

    at = F.expr("timestamp_ntz'2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, id)")
    spark.range(400).coalesce(1).select(F.col("id").alias("event_id"), at.alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(120.0).alias("value"), F.lit('{"k": 1}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    d = QUERIES["join_bucket_neighbors"](spark, str(tmp_path))
    assert d.count() == d.distinct().count() == 400 * 399
    per = [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) >= 4 and max(per) < sum(per) / 2
