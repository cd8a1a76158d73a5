"""Queries of rolling statistics, grids, gaps and fusion by weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from .registry import E, query, r6, read, streams

W = "PARTITION BY stream ORDER BY t, event_id"


@query("win_hampel", f"""WITH {E}, a AS (SELECT event_id, value, list(value) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS l FROM e),
    b AS (SELECT *, list_aggregate(l, 'median') AS m FROM a), c AS (SELECT *, list_aggregate(list_transform(l, lambda v: abs(v - m)), 'median') AS d FROM b)
    SELECT event_id, coalesce(len(l) >= 2 AND CASE WHEN d > 0 THEN abs(value - m) > 3.0 * 1.4826 * d ELSE value <> m END, FALSE) AS outlier, round(m, 6) AS med FROM c""")
def win_hampel(spark, d):
    bad, _, mid = S.hampel(F.col("value"), S.ordered())
    return streams(spark, d).select("event_id", bad.alias("outlier"), r6(mid).alias("med"))


@query("win_slope", f"WITH {E} SELECT event_id, CASE WHEN count(*) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) < 2 THEN 0 ELSE round(regr_slope(value, (t - 1704067200.0) / 3600) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 5) END AS slope FROM e")
def win_slope(spark, d):
    return streams(spark, d).select("event_id", F.round(S.slope(F.col("value"), (F.col("t") - 1704067200.0) / 3600, S.ordered(), 10), 5).alias("slope"))


@query("win_rolling_corr", f"WITH {E}, x AS (SELECT event_id, count(*) OVER w AS n, corr(value, k) OVER w AS c FROM e WINDOW w AS ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT event_id, round(c, 5) AS corr FROM x WHERE n >= 3")
def win_rolling_corr(spark, d):
    n = F.count("*").over(S.ordered().rowsBetween(-29, 0))
    s = streams(spark, d).select("event_id", n.alias("n"), S.rolling_corr(F.col("value"), F.col("k").cast("double"), S.ordered()).alias("c"))
    return s.where("n >= 3").select("event_id", F.round("c", 5).alias("corr"))


@query("win_m_of_n", f"WITH {E} SELECT event_id, sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) >= 3 AS on_now FROM e")
def win_m_of_n(spark, d):
    return streams(spark, d).select("event_id", S.m_of_n(F.col("value") > 30, S.ordered()).alias("on_now"))


@query("win_start_rule", f"""WITH {E}, l AS (SELECT event_id, value AS d, lag(value, 1) OVER w AS c, lag(value, 2) OVER w AS b, lag(value, 3) OVER w AS a FROM e WINDOW w AS ({W}))
    SELECT event_id, coalesce(b > a AND c > b AND d > c AND (a <= 0 OR d >= 1.4 * a), FALSE) AS start_now FROM l""")
def win_start_rule(spark, d):
    return streams(spark, d).select("event_id", S.rise_rule(F.col("value"), S.ordered()).alias("start_now"))


@query("win_gap_gate", f"WITH {E} SELECT event_id, coalesce(t - lag(t) OVER ({W}) > 3 * 1200, FALSE) AS gap FROM e")
def win_gap_gate(spark, d):
    return streams(spark, d).select("event_id", S.gap_gate(F.col("t"), S.ordered(), 1200.0).alias("gap"))


@query("win_derivative", f"""WITH {E}, l AS (SELECT event_id, coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value) AS dx, coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t) AS dt FROM e WINDOW w AS ({W}))
    SELECT event_id, round(1000 * CASE WHEN dt > 0 THEN dx / dt ELSE 0 END, 5) AS rate FROM l""")
def win_derivative(spark, d):
    return streams(spark, d).select("event_id", F.round(1000 * S.derivative(F.col("value"), F.col("t"), S.ordered()), 5).alias("rate"))


@query("win_welford", f"""WITH {E} SELECT event_id, round(coalesce(var_samp(value) OVER w, -1) / 7.3::DOUBLE, 4) AS var_sample, round(var_pop(value) OVER w / 7.3::DOUBLE, 4) AS var_population, round(avg(value) OVER w / 7.3::DOUBLE, 6) AS mean_so_far FROM e
    WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def win_welford(spark, d):
    w = S.ordered().rowsBetween(S.Window.unboundedPreceding, 0)
    return streams(spark, d).select("event_id", F.round(F.coalesce(F.var_samp("value").over(w), F.lit(-1.0)) / 7.3, 4).alias("var_sample"), F.round(F.var_pop("value").over(w) / 7.3, 4).alias("var_population"), r6(F.avg("value").over(w) / 7.3).alias("mean_so_far"))


@query("win_flatline", f"""WITH {E}, q AS (SELECT event_id, stream, t, floor(value / 100) AS x FROM e),
    a AS (SELECT event_id, stream, t, count(x) OVER w = 8 AND max(x) OVER w - min(x) OVER w <= 0 AS s FROM q WINDOW w AS ({W} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
    SELECT event_id, max(CASE WHEN s THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) = 1 AS flat FROM a""")
def win_flatline(spark, d):
    s = streams(spark, d).withColumn("s", S.flatline(F.floor(F.col("value") / 100), S.ordered()))
    return s.select("event_id", F.max("s").over(S.ordered().rowsBetween(-7, 0)).alias("flat"))


@query("win_k_of_m", f"WITH {E} SELECT event_id, value >= 40 AND sum(CASE WHEN value >= 40 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) >= 2 AS confirmed FROM e")
def win_k_of_m(spark, d):
    return streams(spark, d).select("event_id", ((F.col("value") >= 40) & (F.sum((F.col("value") >= 40).cast("int")).over(S.ordered().rowsBetween(0, 2)) >= 2)).alias("confirmed"))


@query("win_last_n", f"WITH {E} SELECT event_id, list(value) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS last_4, coalesce(max(value) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS peak_before FROM e")
def win_last_n(spark, d):
    return streams(spark, d).select("event_id", F.collect_list("value").over(S.ordered().rowsBetween(-3, 0)).alias("last_4"), F.coalesce(F.max("value").over(S.ordered().rowsBetween(S.Window.unboundedPreceding, -1)), F.lit(-1.0)).alias("peak_before"))


@query("win_bursts", f"""WITH {E}, a AS (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, list(value) OVER w AS l FROM e WINDOW w AS ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT event_id, CAST(len(list_filter(l, lambda v: v > m + 2 * s + 0.001)) AS BIGINT) AS bursts, list_aggregate(l, 'max') AS ring_max FROM a""")
def win_bursts(spark, d):
    w = S.ordered().rowsBetween(-29, 0)
    s = streams(spark, d).select("event_id", F.avg("value").over(w).alias("m"), F.stddev_pop("value").over(w).alias("s"), F.collect_list("value").over(w).alias("l"))
    return s.select("event_id", F.size(F.filter("l", lambda v: v > F.col("m") + 2 * F.col("s") + 0.001)).cast("long").alias("bursts"), F.array_max("l").alias("ring_max"))


@query("win_time_since", f"""WITH {E} SELECT event_id, round(least(1440.0, coalesce((t - max(CASE WHEN value > 100 THEN t END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 60, 1440.0)), 4) AS minutes_since FROM e""")
def win_time_since(spark, d):
    last = F.last(F.when(F.col("value") > 100, F.col("t")), ignorenulls=True).over(S.ordered().rowsBetween(S.Window.unboundedPreceding, 0))
    return streams(spark, d).select("event_id", F.round(F.least(F.lit(1440.0), F.coalesce((F.col("t") - last) / 60, F.lit(1440.0))), 4).alias("minutes_since"))


@query("win_runs", f"""WITH {E}, a AS (SELECT *, row_number() OVER ({W}) AS n FROM e), b AS (SELECT *, n - row_number() OVER ({W}) AS run FROM a WHERE value > 25)
    SELECT event_id, stream, row_number() OVER (PARTITION BY stream, run ORDER BY t, event_id) AS place FROM b""")
def win_runs(spark, d):
    s = streams(spark, d).withColumn("hot", F.col("value") > 25)
    return S.runs_of(s, "hot").select("event_id", "stream", F.col("place").cast("long").alias("place"))


@query("win_tumbling", f"WITH {E} SELECT stream, CAST(floor(t / 3600) AS BIGINT) AS hour_no, count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS peak FROM e GROUP BY ALL")
def win_tumbling(spark, d):
    s = streams(spark, d).groupBy("stream", F.window(F.timestamp_micros("us"), "1 hour").alias("w"))
    s = s.agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"), F.max("value").alias("peak"))
    return s.select("stream", F.floor(F.unix_seconds("w.start") / 3600).cast("long").alias("hour_no"), "n", "mean_value", "peak")


@query("win_session", f"""WITH {E}, a AS (SELECT stream, us, value, CASE WHEN us - lag(us) OVER w >= 5400000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM e WINDOW w AS (PARTITION BY stream ORDER BY us)),
    b AS (SELECT *, sum(s) OVER (PARTITION BY stream ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT stream, min(us) AS start_us, max(us) + 5400000000 AS end_us, count(*) AS n, max(value) AS peak FROM b GROUP BY stream, g""")
def win_session(spark, d):
    s = streams(spark, d).groupBy("stream", F.session_window(F.timestamp_micros("us"), "90 minutes").alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return s.select("stream", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n", "peak")


GRID = "1704067200.0"


@query("grid_build", f"WITH {E}, b AS (SELECT floor(min(t) / 3600) * 3600.0 AS a, max(t) AS z FROM e) SELECT CAST(i AS BIGINT) AS cell, a + i * 3600.0 AS t FROM b, (SELECT unnest(range(0, CAST((SELECT floor((z - a) / 3600.0) + 1 FROM b) AS BIGINT))) AS i)")
def grid_build(spark, d):
    """Hourly cells from the first to the last sample of the table."""
    a, z = streams(spark, d).agg(F.floor(F.min("t") / 3600) * F.lit(3600.0), F.max("t")).first()  # two numbers
    return S.build_grid(spark, a, z, 3600.0)


@query("grid_snap", f"""WITH {E}, x AS (SELECT stream, CAST(round_even((t - {GRID}) / 3600.0, 0) AS BIGINT) AS cell, t, value, k, CASE WHEN k > 0 THEN k / 10.0::DOUBLE END AS s FROM e),
    y AS (SELECT *, CASE WHEN s > 0 THEN 1 / (s * s) ELSE 1.0 END AS w FROM x WHERE abs(t - ({GRID} + cell * 3600.0)) <= 1200),
    z AS (SELECT stream, cell, sum(w * value) / sum(w) AS v, sqrt(1 / sum(w)) AS s, count(*) AS n, bit_or(CASE WHEN k % 9 = 0 THEN 16 WHEN k % 7 = 0 THEN 8 ELSE 0 END) AS b FROM y GROUP BY ALL)
    SELECT stream, cell, round(v, 6) AS value, round(s, 6) AS sigma, n, CAST(CASE WHEN b = 0 THEN 1 ELSE b END AS INTEGER) AS bits, CASE WHEN b & 16 > 0 THEN 'BAD' WHEN b & 8 > 0 THEN 'SUSPECT' ELSE 'GOOD' END AS flag FROM z""")
def grid_snap(spark, d):
    return _snapped(spark, d).select("stream", "cell", r6("value").alias("value"), r6("sigma").alias("sigma"), "n", F.col("bits").cast("int").alias("bits"), "flag")


def _snapped(spark, d):
    k = F.col("k")
    s = streams(spark, d).withColumns({"s": F.when(k > 0, k / F.lit(10.0)), "b": F.when(k % 9 == 0, 16).when(k % 7 == 0, 8).otherwise(0)})
    return S.snap_to_grid(s, 1704067200.0, 3600.0, 1200.0, sigma="s", bits="b")


def _cells_sql(last: str) -> str:
    ends = f"SELECT CAST(floor((min(t) - {GRID}) / 3600) AS BIGINT) AS lo, CAST({last}((max(t) - {GRID}) / 3600) AS BIGINT) AS hi FROM e"
    return f"c AS (SELECT stream, i AS cell, {GRID} + i * 3600.0 AS t FROM (SELECT unnest(range(lo, hi + 1)) AS i FROM ({ends})), (SELECT DISTINCT stream FROM e))"


CELLS, CELLS_AFTER = _cells_sql("floor"), _cells_sql("ceil")


def _cells(spark, d, after: bool = False):
    """The hourly cells from the first to the last sample of the table, for each stream; ``after``: also the next one where a sample is past the last one's start."""
    e = streams(spark, d)
    hours = (F.col("t") - 1704067200.0) / 3600
    lo, hi = e.agg(F.floor(F.min(hours)), (F.ceil if after else F.floor)(F.max(hours))).first()
    own = e.select("stream").distinct()
    cell = own.select("stream", F.explode(F.sequence(F.lit(lo or 0).cast("long"), F.lit(hi or 0).cast("long"))).alias("cell")).where(F.lit(lo is not None))
    return cell.withColumn("t", F.lit(1704067200.0) + F.col("cell") * F.lit(3600.0))


@query("grid_zoh", f"""WITH {E}, {CELLS_AFTER}, h AS (SELECT c.stream, c.cell, c.t, e.t AS ht, e.value, (e.k + 1) / 10.0::DOUBLE AS s FROM c ASOF LEFT JOIN (SELECT * FROM e) e ON c.stream = e.stream AND c.t >= e.t)
    SELECT stream, cell, CASE WHEN t - ht <= 7200 THEN value ELSE -1 END AS value, CASE WHEN t - ht <= 7200 THEN round(t - ht, 4) ELSE -1 END AS age_s, CASE WHEN t - ht <= 7200 THEN round(s * (1 + (t - ht) / 3600.0), 6) ELSE -1 END AS sigma FROM h""")
def grid_zoh(spark, d):
    s = streams(spark, d).withColumn("sigma", (F.col("k") + 1) / F.lit(10.0))
    z = S.zero_order_hold(_cells(spark, d, after=True), s, cadence=3600.0, max_age=7200.0)
    none = F.lit(-1.0)
    return z.select("stream", "cell", F.coalesce("value", none).alias("value"), F.coalesce(F.round("age_s", 4), none).alias("age_s"), F.coalesce(r6("sigma"), none).alias("sigma"))


FILLED = f"""g AS (SELECT stream, CAST(floor((t - {GRID}) / 3600) AS BIGINT) AS cell, avg(value) AS value, 0.1 * count(*) AS sigma FROM e GROUP BY ALL),
    s AS (SELECT c.stream, c.cell, c.t, g.value, g.sigma FROM c LEFT JOIN g ON c.stream = g.stream AND c.cell = g.cell)"""


def _hourly(spark, d):
    g = streams(spark, d).groupBy("stream", F.floor((F.col("t") - 1704067200.0) / 3600).cast("long").alias("cell")).agg(F.avg("value").alias("value"), (F.lit(0.1) * F.count("*")).alias("sigma"))
    return _cells(spark, d).join(g, ["stream", "cell"], "left")


@query("grid_interp", f"""WITH {E}, {CELLS}, {FILLED},
    n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER p AS tl, last_value(value IGNORE NULLS) OVER p AS vl, last_value(sigma IGNORE NULLS) OVER p AS sl,
            first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER q AS tr, first_value(value IGNORE NULLS) OVER q AS vr, first_value(sigma IGNORE NULLS) OVER q AS sr FROM s
          WINDOW p AS (PARTITION BY stream ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY stream ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    o AS (SELECT *, coalesce(value IS NULL AND tr - tl <= 3 * 3600 + 1e-9 AND vl > 0 AND vr > 0, FALSE) AS ok, (t - tl) / (tr - tl) AS fr FROM n)
    SELECT stream, cell, round(coalesce(CASE WHEN ok THEN pow(10.0::DOUBLE, log10(vl) + fr * (log10(vr) - log10(vl))) ELSE value END, -1), 6) AS value,
           round(coalesce(CASE WHEN ok THEN 1.5 * ((1 - fr) * sl + fr * sr) ELSE sigma END, -1), 6) AS sigma, ok AS interpolated FROM o""")
def grid_interp(spark, d):
    i = S.interpolate(_hourly(spark, d), 3 * 3600.0, log=True)
    return i.select("stream", "cell", r6(F.coalesce("value", F.lit(-1.0))).alias("value"), r6(F.coalesce("sigma", F.lit(-1.0))).alias("sigma"), "interpolated")


def _flagged(spark, d):
    c = F.col("cell")
    h = _hourly(spark, d).withColumn("value", F.when(c.between(100, 115) & F.col("value").isNotNull(), 7.0).otherwise(F.col("value")))
    return h.withColumns({"flag": F.when(c % 37 == 0, "BAD").when(c % 41 == 0, "SUSPECT").otherwise("GOOD"), "bits": F.when(c % 43 == 0, 64).otherwise(1)})


FLAGGED = f"""{FILLED}, a AS (SELECT stream, cell, t, CASE WHEN cell BETWEEN 100 AND 115 AND value IS NOT NULL THEN 7.0 ELSE value END AS value, sigma,
        CASE WHEN cell % 37 = 0 THEN 'BAD' WHEN cell % 41 = 0 THEN 'SUSPECT' ELSE 'GOOD' END AS flag, CASE WHEN cell % 43 = 0 THEN 64 ELSE 1 END AS bits FROM s),
    b AS (SELECT *, CASE WHEN value IS NULL THEN 'missing' WHEN flag = 'BAD' THEN 'bad' WHEN flag = 'SUSPECT' THEN 'suspect' WHEN bits & 64 > 0 THEN 'saturated' END AS c0,
            count(value) OVER w = 8 AND max(value) OVER w - min(value) OVER w <= 0 AS st FROM a WINDOW w AS (PARTITION BY stream ORDER BY cell ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
    g2 AS (SELECT *, coalesce(c0, CASE WHEN max(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY cell ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) = 1 THEN 'flatline' END) AS cause FROM b)"""


@query("gap_detect", f"""WITH {E}, {CELLS}, {FLAGGED}, r AS (SELECT *, cell - row_number() OVER (PARTITION BY stream ORDER BY cell) AS run FROM g2 WHERE cause IS NOT NULL)
    SELECT stream, min(cell) AS start_cell, max(cell) AS end_cell, count(*) AS n_cells, arg_min(cause, cell) AS cause FROM r GROUP BY stream, run""")
def gap_detect(spark, d):
    return S.detect_gaps(_flagged(spark, d)).select("stream", "start_cell", "end_cell", "n_cells", "cause")


FILLERS = "x AS (SELECT cell, arg_min((stream, value, sigma), CASE stream WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 3 END) AS f FROM g2 WHERE stream IN ('click', 'error', 'signup') AND value IS NOT NULL AND flag <> 'BAD' GROUP BY cell)"


@query("gap_fill", f"""WITH {E}, {CELLS}, {FLAGGED}, {FILLERS}, y AS (SELECT g2.*, f[1] AS src, f[2] AS fv, f[3] AS fs, cause IS NOT NULL AND f IS NOT NULL AS use FROM g2 LEFT JOIN x ON g2.cell = x.cell WHERE stream = 'view')
    SELECT cell, round(coalesce(CASE WHEN use THEN fv ELSE value END, -1), 6) AS value,
      round(coalesce(CASE WHEN use THEN sqrt(pow(CASE WHEN fs > 0 THEN fs ELSE abs(fv) * 0.1 END / sqrt(0.8::DOUBLE), 2) + pow(ln(10.0::DOUBLE) * abs(fv) * 0.06, 2)) ELSE sigma END, -1), 5) AS sigma,
      CAST(CASE WHEN use THEN (bits & ~128) | 4 ELSE bits END AS INTEGER) AS bits,
      CASE WHEN use THEN 'filled:' || src WHEN cause IS NOT NULL THEN 'gap:' || cause WHEN flag = 'GOOD' THEN 'measured' ELSE lower(flag) END AS provenance FROM y""")
def gap_fill(spark, d):
    a = _flagged(spark, d)
    f = a.where(F.col("stream").isin("click", "error", "signup"))
    f = f.select("cell", F.col("stream").alias("source"), F.when(F.col("stream") == "click", 1).when(F.col("stream") == "error", 2).otherwise(3).alias("priority"), "value", "sigma", "flag", F.lit(0.8).alias("reliability"))
    g = S.fill_gaps(a.where("stream = 'view'"), f, 0.06)
    return g.select("cell", r6(F.coalesce("value", F.lit(-1.0))).alias("value"), F.round(F.coalesce("sigma", F.lit(-1.0)), 5).alias("sigma"), F.col("bits").cast("int").alias("bits"), "provenance")


@query("gap_coverage", f"WITH {E}, {CELLS}, {FLAGGED} SELECT stream, round(avg(CASE WHEN value IS NOT NULL AND flag NOT IN ('BAD', 'SUSPECT') THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM a GROUP BY stream")
def gap_coverage(spark, d):
    return S.coverage(_flagged(spark, d)).select("stream", r6("coverage").alias("coverage"))


@query("agg_despike", f"""WITH {E}, m1 AS (SELECT stream, median(value) AS m FROM e GROUP BY stream),
    d1 AS (SELECT stream, any_value(m) AS m, median(abs(value - m)) AS mad, avg(abs(value - m)) AS mean FROM e JOIN m1 USING (stream) GROUP BY stream),
    p1 AS (SELECT e.*, abs(value - m) > 5.0 * CASE WHEN mad > 0 THEN 1.4826 * mad ELSE 1.2533 * mean END AS s FROM e JOIN d1 USING (stream)),
    m2 AS (SELECT stream, median(value) AS m FROM p1 WHERE NOT s GROUP BY stream),
    d2 AS (SELECT stream, any_value(m) AS m, median(abs(value - m)) AS mad, avg(abs(value - m)) AS mean FROM p1 JOIN m2 USING (stream) WHERE NOT s GROUP BY stream),
    p2 AS (SELECT p1.* EXCLUDE (s), s OR abs(value - m) > 5.0 * CASE WHEN mad > 0 THEN 1.4826 * mad ELSE 1.2533 * mean END AS s FROM p1 JOIN d2 USING (stream)),
    m3 AS (SELECT stream, median(value) AS m FROM p2 WHERE NOT s GROUP BY stream),
    d3 AS (SELECT stream, any_value(m) AS m, median(abs(value - m)) AS mad, avg(abs(value - m)) AS mean FROM p2 JOIN m3 USING (stream) WHERE NOT s GROUP BY stream),
    p3 AS (SELECT p2.* EXCLUDE (s), s OR abs(value - m) > 5.0 * CASE WHEN mad > 0 THEN 1.4826 * mad ELSE 1.2533 * mean END AS s FROM p2 JOIN d3 USING (stream)),
    m4 AS (SELECT stream, median(value) AS m FROM p3 WHERE NOT s GROUP BY stream)
    SELECT event_id, s AS spike, round(coalesce(last_value(CASE WHEN NOT s THEN value END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), m), 6) AS clean FROM p3 JOIN m4 USING (stream)""")
def agg_despike(spark, d):
    return S.despike(streams(spark, d)).select("event_id", "spike", r6("clean").alias("clean"))


@query("fuse_inverse_variance", """WITH x AS (SELECT l_partkey, l_extendedprice / l_quantity AS v, (1 - l_discount) / (l_quantity * l_quantity) AS w FROM lineitem WHERE 1 - l_discount > 0 AND l_quantity > 0)
    SELECT l_partkey, round(sum(w * v) / sum(w), 4) AS value, round(sqrt(1 / sum(w)), 6) AS sigma, count(*) AS n FROM x GROUP BY l_partkey""")
def fuse_inverse_variance(spark, d):
    from ..operators.fusion import inverse_variance

    x = read(spark, d, "lineitem").select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"), F.col("l_quantity").alias("sigma"), (1 - F.col("l_discount")).alias("reliability"))
    return inverse_variance(x, ["l_partkey"]).select("l_partkey", F.round("value", 4).alias("value"), r6("sigma").alias("sigma"), "n")


@query("fuse_quality", f"""WITH {E}, x AS (SELECT stream, CAST(floor(t / 86400) AS BIGINT) AS day, avg(CASE WHEN k % 5 = 0 THEN 0.0 ELSE 1.0 END) AS good, stddev_pop(log10(value)) AS s FROM e GROUP BY ALL)
    SELECT stream, day, round(good * greatest(0, 1 - s / 0.5), 6) AS quality FROM x""")
def fuse_quality(spark, d):
    from ..operators.fusion import quality_score

    x = streams(spark, d).withColumn("day", F.floor(F.col("t") / 86400).cast("long")).withColumn("good", F.col("k") % 5 != 0)
    return quality_score(x, ["stream", "day"]).select("stream", "day", r6("quality").alias("quality"))


@query("agg_ols", """WITH x AS (SELECT l_suppkey, log10(l_quantity) AS x, log10(l_extendedprice) AS y FROM lineitem) SELECT l_suppkey, round(regr_intercept(y, x), 5) AS a, round(regr_slope(y, x), 5) AS b, round(regr_r2(y, x), 5) AS r2, count(*) AS n FROM x GROUP BY l_suppkey""")
def agg_ols(spark, d):
    from ..operators.fusion import fit_transfer

    f = fit_transfer(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_suppkey"], robust=False)
    return f.select("l_suppkey", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"), F.round("r2", 5).alias("r2"), "n")


def _huber_sql(rounds: int = 10) -> str:
    """Reweighted lines, a round after the other; a line that stands still, or has no spread around it, stays."""
    line = "CASE WHEN abs(sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) < 1e-30 THEN 1.0 ELSE (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) END AS b, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy"
    out = f"""WITH d AS (SELECT l_returnflag AS g, log10(l_quantity) AS x, log10(l_extendedprice) AS y FROM lineitem),
    f0 AS MATERIALIZED (SELECT g, (sy - b * sx) / sw AS a, b FROM (SELECT g, {line} FROM (SELECT *, 1.0 AS w FROM d) GROUP BY g))"""
    for k in range(rounds):
        out += f""",
    r{k} AS (SELECT d.*, a, b, y - (a + b * x) AS r FROM d JOIN f{k} USING (g)), m{k} AS (SELECT g, median(r) AS m FROM r{k} GROUP BY g), s{k} AS MATERIALIZED (SELECT g, 1.4826 * median(abs(r - m)) AS mad FROM r{k} JOIN m{k} USING (g) GROUP BY g),
    n{k} AS (SELECT g, (sy - b * sx) / sw AS a2, b AS b2 FROM (SELECT g, {line} FROM (SELECT g, x, y, CASE WHEN mad > 0 AND abs(r / mad) > 1.345 THEN 1.345 / abs(r / mad) ELSE 1.0 END AS w FROM r{k} JOIN s{k} USING (g)) GROUP BY g)),
    f{k + 1} AS MATERIALIZED (SELECT g, CASE WHEN mad > 0 AND (abs(a2 - a) >= 1e-9 OR abs(b2 - b) >= 1e-9) THEN a2 ELSE a END AS a, CASE WHEN mad > 0 AND (abs(a2 - a) >= 1e-9 OR abs(b2 - b) >= 1e-9) THEN b2 ELSE b END AS b FROM f{k} JOIN s{k} USING (g) JOIN n{k} USING (g))"""
    return out + f""", z AS (SELECT d.*, a, b, y - (a + b * x) AS r FROM d JOIN f{rounds} USING (g)), zm AS (SELECT g, median(r) AS m FROM z GROUP BY g), zs AS (SELECT g, 1.4826 * median(abs(r - m)) AS mad FROM z JOIN zm USING (g) GROUP BY g)
    SELECT g AS l_returnflag, round(any_value(a), 5) AS a, round(any_value(b), 5) AS b, round(any_value(mad), 5) AS resid, round(sqrt(avg(r * r)), 5) AS rms_log, count(*) AS n, round(1 - sum(r * r) / (count(*) * var_pop(y)), 5) AS r2 FROM z JOIN zs USING (g) GROUP BY g"""


@query("agg_huber_fit", _huber_sql())
def agg_huber_fit(spark, d):
    from ..operators.fusion import fit_transfer

    f = fit_transfer(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return f.select("l_returnflag", *[F.round(c, 5).alias(c) for c in ("a", "b", "resid", "rms_log")], "n", F.round("r2", 5).alias("r2"))


@query("agg_exact_quantiles", f"WITH {E} SELECT stream, round(median(value), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90, round(var_samp(value), 4) AS var_sample, round(stddev_pop(value), 6) AS std_population FROM e GROUP BY stream")
def agg_exact_quantiles(spark, d):
    return streams(spark, d).groupBy("stream").agg(r6(F.median("value")).alias("q50"), r6(F.percentile("value", F.lit(0.9))).alias("q90"), F.round(F.var_samp("value"), 4).alias("var_sample"), r6(F.stddev_pop("value")).alias("std_population"))


@query("rollup_band_class", f"""WITH {E} SELECT coalesce(stream, '*') AS band, coalesce(c, '*') AS class, n FROM (SELECT stream, CASE WHEN value >= 100 THEN 'X' WHEN value >= 10 THEN 'M' ELSE 'C' END AS c, count(*) AS n FROM e GROUP BY ROLLUP (stream, c))""")
def rollup_band_class(spark, d):
    c = F.when(F.col("value") >= 100, "X").when(F.col("value") >= 10, "M").otherwise("C")
    r = streams(spark, d).select("stream", c.alias("c")).rollup("stream", "c").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("stream", F.lit("*")).alias("band"), F.coalesce("c", F.lit("*")).alias("class"), "n")
