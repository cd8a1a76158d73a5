"""Queries of event matching, merging, voting and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalar as X
from ..operators import events as V
from ..operators import fusion
from ..operators import matching as M
from ..operators.common import in_cells
from ..operators.series import sessions
from .detect_queries import pairs_sql
from .registry import FLARES, E, events_as_flares, query, r6, read, streams


@query("events_top", f"""WITH {E}, {FLARES}, w AS (SELECT *, max(t_end) OVER (PARTITION BY stream ORDER BY t_start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM f),
    c AS (SELECT *, sum(CASE WHEN b IS NULL OR t_start > b + 90 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY t_start, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM w)
    SELECT stream, arg_min(event_id, (t_start, event_id)) AS event_id, max(value) AS value, count(*) AS n FROM c GROUP BY stream, chain ORDER BY value DESC, event_id LIMIT 20""")
def events_top(spark, d):
    m = V.deduplicate(events_as_flares(spark, d))
    return m.select("stream", "event_id", "value", "n").orderBy(F.desc("value"), "event_id").limit(20)


@query("dedup_islands", f"""WITH {E}, {FLARES}, w AS (SELECT *, max(t_end) OVER (PARTITION BY stream ORDER BY t_start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM f),
    c AS (SELECT *, sum(CASE WHEN b IS NULL OR t_start > b + 90 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY t_start, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM w)
    SELECT stream, arg_min(event_id, (t_start, event_id)) AS event_id, round(min(t_start) - 1704067200.0, 3) AS t_start, round(max(t_end) - 1704067200.0, 3) AS t_end,
           round(arg_max(t_peak, (value, -t_start, -event_id)) - 1704067200.0, 3) AS t_peak, max(value) AS value, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_sum FROM c GROUP BY stream, chain""")
def dedup_islands(spark, d):
    m = V.deduplicate(events_as_flares(spark, d))
    rel = lambda c: F.round(F.col(c) - 1704067200.0, 3).alias(c)
    return m.select("stream", "event_id", rel("t_start"), rel("t_end"), rel("t_peak"), "value", "n", "k_sum")


SOFT_HARD = """s AS (SELECT event_id AS s_id, t AS s_on, t + k AS s_peak FROM e WHERE stream = 'view' AND value >= 40), h AS (SELECT event_id AS h_id, t AS h_on, t + 20 AS h_peak FROM e WHERE stream = 'click' AND value >= 40), """ + pairs_sql(
    "o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY onset, band, id) AS n, * FROM (SELECT s_id AS id, 'soft' AS band, s_on AS onset, s_peak AS peak FROM s UNION ALL SELECT h_id, 'hard', h_on, h_peak FROM h))"
)


def _soft_hard(spark, d):
    e = streams(spark, d).where("value >= 40")
    s = e.where("stream = 'view'").select(F.col("event_id").alias("s_id"), F.col("t").alias("s_on"), (F.col("t") + F.col("k")).alias("s_peak"))
    h = e.where("stream = 'click'").select(F.col("event_id").alias("h_id"), F.col("t").alias("h_on"), (F.col("t") + 20).alias("h_peak"))
    return s, h


def _pairs(spark, d):
    s, h = _soft_hard(spark, d)
    band = lambda x, c, name: x.select(F.col(f"{c}_id").alias("id"), F.lit(name).alias("band"), F.col(f"{c}_on").alias("onset"), F.col(f"{c}_peak").alias("peak"))
    return s, h, M.pair_bands(band(s, "s", "soft").unionByName(band(h, "h", "hard")))


@query("join_associate_best", f"WITH RECURSIVE {E}, {SOFT_HARD} SELECT s.s_id, coalesce(r.h_id, -1) AS h_id, round(coalesce(score, -1), 6) AS score FROM s LEFT JOIN r ON r.s_id = s.s_id")
def join_associate_best(spark, d):
    """The partner of each soft detection, one-to-one in order of arrival."""
    s, _, p = _pairs(spark, d)
    m = s.select("s_id").join(p.select(F.col("soft_id").alias("s_id"), F.col("hard_id").alias("h_id"), "score"), "s_id", "left")
    return m.select("s_id", F.coalesce("h_id", F.lit(-1)).alias("h_id"), r6(F.coalesce("score", F.lit(-1.0))).alias("score"))


@query("join_solo_anti", f"WITH RECURSIVE {E}, {SOFT_HARD} SELECT h_id, TRUE AS sxr_weak FROM h WHERE h_id NOT IN (SELECT h_id FROM r WHERE h_id IS NOT NULL)")
def join_solo_anti(spark, d):
    """Hard detections that stay alone."""
    _, h, p = _pairs(spark, d)
    return h.join(p.select(F.col("hard_id").alias("h_id")), "h_id", "left_anti").select("h_id", F.lit(True).alias("sxr_weak"))


@query("join_align", f"""WITH {E}, x AS (SELECT CAST(floor(t / 1800) AS BIGINT) AS cell, stream, max(value) AS v FROM e WHERE stream IN ('view', 'click') GROUP BY ALL)
    SELECT coalesce(s.cell, h.cell) AS cell, coalesce(s.v, 1e-8) AS soft, coalesce(h.v, 0.0) AS hard FROM (SELECT * FROM x WHERE stream = 'view') s FULL JOIN (SELECT * FROM x WHERE stream = 'click') h ON s.cell = h.cell""")
def join_align(spark, d):
    x = streams(spark, d).where(F.col("stream").isin("view", "click")).groupBy(F.floor(F.col("t") / 1800).cast("long").alias("cell")).pivot("stream", ["view", "click"]).agg(F.max("value"))
    return x.select("cell", F.coalesce("view", F.lit(1e-8)).alias("soft"), F.coalesce("click", F.lit(0.0)).alias("hard"))


@query("join_truth_nearest", f"""WITH RECURSIVE {E}, a AS MATERIALIZED (SELECT event_id AS id, t, row_number() OVER (ORDER BY t, event_id) AS n FROM e WHERE stream = 'error' AND value >= 60), b AS MATERIALIZED (SELECT event_id AS eid, t AS te FROM e WHERE stream = 'purchase' AND value >= 60),
    c AS MATERIALIZED (SELECT a.n, list(struct_pack(d := abs(te - t), te := te, eid := eid) ORDER BY te, eid) AS l FROM a LEFT JOIN b ON te BETWEEN t - 1800 AND t + 1800 GROUP BY a.n),
    r AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS eid UNION ALL
      SELECT n, CASE WHEN m IS NULL THEN used ELSE list_slice(used || [m.eid], -50, -1) END, m.eid FROM (SELECT c.n, used, list_aggregate(list_transform(list_filter(l, lambda x: x.eid IS NOT NULL AND NOT list_contains(used, x.eid)), lambda x: struct_pack(d := -x.d, te := x.te, eid := x.eid)), 'max') AS m FROM r JOIN c ON c.n = r.n + 1))
    SELECT id AS truth_id, coalesce(eid, -1) AS event_id, round(coalesce(te - t, 0), 3) AS dt_s, CASE WHEN eid IS NULL THEN 'missed' ELSE 'matched' END AS outcome FROM a JOIN r USING (n) LEFT JOIN b USING (eid)
    UNION ALL SELECT -1, eid, 0, 'false_alarm' FROM b WHERE eid NOT IN (SELECT eid FROM r WHERE eid IS NOT NULL)""")
def join_truth_nearest(spark, d):
    """Truth rows in order of time, each with the nearest event that is left; what they miss, and false alarms."""
    e = streams(spark, d).where("value >= 60")
    a, b = (e.where(f"stream = '{c}'").select(F.col("event_id").alias("id"), "t") for c in ("error", "purchase"))
    m = M.match_truth(a, b, 1800.0)
    return m.select(*[F.coalesce(c, F.lit(-1)).alias(c) for c in ("truth_id", "event_id")], F.round(F.coalesce("dt_s", F.lit(0.0)), 3).alias("dt_s"), "outcome")


@query("join_semi_own", f"""WITH {E}, {FLARES} SELECT event_id FROM e WHERE stream = 'view' AND EXISTS (SELECT 1 FROM f WHERE f.stream = 'click' AND abs(f.t_start - e.t) <= 180)""")
def join_semi_own(spark, d):
    e = streams(spark, d).where("stream = 'view'").select("event_id", "t")
    f = events_as_flares(spark, d).where("stream = 'click'").select("t_start")
    return V.range_join(e, f, "t", "t_start", 180.0, 180.0, how="left_semi").select("event_id")


@query("join_history", f"""WITH {E}, {FLARES}, p AS (SELECT e.event_id, count(f.event_id) FILTER (f.t_start >= e.t - 21600) AS n, sum(exp(-(e.t - f.t_start) / 21600.0)) AS s, min(e.t - f.t_start) AS a FROM e LEFT JOIN f ON f.stream = e.stream AND f.t_start <= e.t GROUP BY e.event_id)
    SELECT event_id, n AS n_events, round(coalesce(s, 0), 6) AS decayed, round(least(1440, coalesce(a / 60, 1440)), 4) AS minutes_since FROM p""")
def join_history(spark, d):
    e = streams(spark, d).select("event_id", "stream", "t")
    h = V.history(e, events_as_flares(spark, d), ["stream"])
    return h.select("event_id", "n_events", r6("decayed").alias("decayed"), F.round("minutes_since", 4).alias("minutes_since"))


@query("join_nearest_event", f"""WITH {E}, {FLARES}, p AS (SELECT e.event_id, arg_min(f.event_id, (abs(f.t_peak - e.t), f.t_peak, f.event_id)) AS near_event_id FROM e, f GROUP BY e.event_id) SELECT * FROM p""")
def join_nearest_event(spark, d):
    p = streams(spark, d).select(F.col("event_id").alias("id"), "t")
    return V.nearest_event(p, events_as_flares(spark, d)).select(F.col("id").alias("event_id"), "near_event_id")


@query("join_bucket_neighbors", f"""WITH {E}, {FLARES}, b AS (SELECT event_id, CAST(floor(t_peak / 3600) AS BIGINT) AS b FROM f) SELECT x.event_id AS a, y.event_id AS b FROM b x JOIN b y ON y.b IN (x.b, x.b - 1) AND x.event_id <> y.event_id""")
def join_bucket_neighbors(spark, d):
    b = events_as_flares(spark, d).select("event_id", X.bucket_of(F.col("t_peak")).cast("long").alias("b"))
    x = b.select(F.col("event_id").alias("a"), F.explode(F.array(F.col("b"), F.col("b") - 1)).alias("b"))
    x, y = in_cells(x, b, ["b"], "a", "event_id")  # pairs grow with the square of an hour's events
    return x.join(y, ["b", "_u", "_v"]).where("a <> event_id").select("a", F.col("event_id").alias("b"))


IPN = """t AS (SELECT s_suppkey AS idx, 'S' || s_suppkey AS id, s_nationkey AS grp, s_acctbal / 100 AS t, cos(s_suppkey) * 1e8 AS x, sin(s_suppkey) * 1e8 AS y, (s_suppkey % 7) * 1e7 AS z, 0.001 * (1 + s_suppkey % 3) AS s FROM supplier),
    p AS (SELECT l.id AS a, r.id AS b, sqrt(pow(r.x - l.x, 2) + pow(r.y - l.y, 2) + pow(r.z - l.z, 2)) AS d, r.t - l.t AS dt, sqrt(l.s * l.s + r.s * r.s) AS sd, r.x - l.x AS dx, r.y - l.y AS dy, r.z - l.z AS dz FROM t l JOIN t r ON l.grp = r.grp AND l.idx < r.idx)"""


def _triggers(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(
        k.alias("idx"), F.concat(F.lit("S"), k.cast("string")).alias("source_id"), F.col("s_nationkey").alias("grp"), (F.col("s_acctbal") / 100).alias("t"),
        (F.cos(k) * F.lit(1e8)).alias("x"), (F.sin(k) * F.lit(1e8)).alias("y"), ((k % 7) * F.lit(1e7)).alias("z"), (F.lit(0.001) * (1 + k % 3)).alias("sigma"),
    )


@query("join_ipn_pairs", f"""WITH {IPN}, q AS (SELECT *, acos(least(1.0, greatest(-1.0, {K.C_KM_S} * dt / d))) AS th FROM p WHERE d > 0)
    SELECT a, b, round(degrees(th), 5) AS radius_deg, round(CASE WHEN sin(th) < 1e-6 THEN 90 ELSE degrees({K.C_KM_S} * sd / (d * sin(th))) END, 6) AS halfwidth_deg, round(degrees(atan2(dy, dx)), 5) AS lon,
           round(degrees(asin(least(1.0, greatest(-1.0, dz / d)))), 5) AS lat, abs(dt) <= d / {K.C_KM_S} + 3 * sd AS consistent FROM q""")
def join_ipn_pairs(spark, d):
    p = fusion.localize(_triggers(spark, d), ["grp"])
    return p.select("a", "b", X.rounded("radius_deg", 5).alias("radius_deg"), X.rounded("halfwidth_deg", 6).alias("halfwidth_deg"), X.rounded("lon", 5).alias("lon"), X.rounded("lat", 5).alias("lat"), "consistent")


@query("join_ipn_consistent", f"WITH {IPN.replace('l.id AS a', 'l.grp AS grp, l.id AS a')} SELECT grp, bool_and(abs(dt) <= d / {K.C_KM_S} + 3 * sd) AS consistent FROM p WHERE d > 0 GROUP BY grp")
def join_ipn_consistent(spark, d):
    return fusion.localize(_triggers(spark, d), ["grp"]).groupBy("grp").agg(F.every("consistent").alias("consistent"))


@query("consensus_vote", f"""WITH {E}, {FLARES}, c AS (SELECT CAST(floor(t_peak / 7200) AS BIGINT) AS cluster, stream AS catalog, t_peak, CASE stream WHEN 'click' THEN 0.9 WHEN 'error' THEN 0.8 WHEN 'view' THEN 0.7 WHEN 'signup' THEN 0.6 ELSE 0.5 END AS rho, stream IN ('click', 'error') AS h, stream IN ('view', 'signup') AS s FROM f),
    o AS (SELECT cluster, catalog, max(rho) AS rho, count(*) AS m, sum(t_peak) AS t, bool_or(h) AS h, bool_or(s) AS s FROM c GROUP BY ALL), a AS (SELECT sum(rho) AS tot FROM (SELECT catalog, max(rho) AS rho FROM c GROUP BY catalog)),
    v AS (SELECT cluster, count(*) AS n_catalogs, sum(rho) / any_value(tot) AS conf, sum(t) / sum(m) AS t_peak, bool_or(h) AS h, bool_or(s) AS s FROM o, a GROUP BY cluster),
    u AS (SELECT *, CASE WHEN conf >= 0.7 THEN 'confirmed' WHEN conf < 0.3 THEN 'rejected' ELSE 'candidate' END AS st FROM v)
    SELECT cluster, n_catalogs, round(conf, 6) AS confidence, round(t_peak - 1704067200.0, 3) AS t_peak, CASE WHEN st = 'candidate' AND h AND NOT s THEN 'confirmed' ELSE st END AS status FROM u""")
def consensus_vote(spark, d):
    s = F.col("stream")
    rho = X.lookup({"click": 0.9, "error": 0.8, "view": 0.7, "signup": 0.6, "purchase": 0.5}, s)
    c = events_as_flares(spark, d).select(F.floor(F.col("t_peak") / 7200).cast("long").alias("cluster"), s.alias("catalog"), "t_peak", rho.alias("rho"), s.isin("click", "error").alias("is_hxr"), s.isin("view", "signup").alias("is_sxr"))
    return V.consensus_vote(c).select("cluster", "n_catalogs", r6("confidence").alias("confidence"), F.round(F.col("t_peak") - 1704067200.0, 3).alias("t_peak"), "status")


@query("consensus_sessions", f"""WITH {E}, {FLARES}, a AS (SELECT event_id, stream, t_peak, CASE WHEN t_peak - lag(t_peak) OVER (ORDER BY t_peak, event_id) > 180 OR lag(t_peak) OVER (ORDER BY t_peak, event_id) IS NULL THEN 1 ELSE 0 END AS s FROM f),
    b AS (SELECT *, sum(s) OVER (ORDER BY t_peak, event_id ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT min(event_id) AS first_id, count(*) AS n, count(DISTINCT stream) AS n_catalogs FROM b GROUP BY g""")
def consensus_sessions(spark, d):
    f = sessions(events_as_flares(spark, d), 180.0, "t_peak")
    g = f.groupBy("session").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"), F.size(F.collect_set("stream")).cast("long").alias("n_catalogs"))
    return g.select("first_id", "n", "n_catalogs")


@query("join_registry", """SELECT n_name, r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def join_registry(spark, d):
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.groupBy("n_name", "r_name").agg(F.count("*").alias("n"))


BUDGETS = ", ".join(f"('{s[0]}', {s[4]})" for s in K.SOURCES)


@query("src_latency_guard", f"WITH {E}, r(source_id, b) AS (VALUES {BUDGETS}), i AS (SELECT source_id, b, row_number() OVER (ORDER BY source_id) - 1 AS i FROM r) SELECT event_id, source_id FROM e JOIN i ON k % 15 = i WHERE value * 20 <= b")
def src_latency_guard(spark, d):
    names = sorted(s[0] for s in K.SOURCES)
    e = streams(spark, d).select("event_id", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("k") % 15 + 1).cast("int")).alias("source_id"), (F.col("value") * 20).alias("age_s"))
    return fusion.realtime_eligible(e, fusion.registry(spark)).select("event_id", "source_id")


@query("src_priority_fallback", f"""WITH {E}, x AS (SELECT CAST(floor(t / 3600) AS BIGINT) AS cell, stream, max(value) AS v, CASE stream WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS p FROM e GROUP BY ALL)
    SELECT cell, arg_min(stream, (p, stream)) AS source, arg_min(v, (p, stream)) AS value FROM x GROUP BY cell""")
def src_priority_fallback(spark, d):
    p = F.when(F.col("stream") == "signup", 1).when(F.col("stream") == "click", 2).otherwise(3)
    x = streams(spark, d).groupBy(F.floor(F.col("t") / 3600).cast("long").alias("cell"), "stream").agg(F.max("value").alias("v"))
    b = x.groupBy("cell").agg(F.min(F.struct(p.alias("p"), "stream", "v")).alias("b"))
    return b.select("cell", F.col("b.stream").alias("source"), F.col("b.v").alias("value"))


@query("cat_at", f"WITH {E}, {FLARES} SELECT event_id FROM f WHERE floor(t_peak / 3600) = floor(1704500000.0 / 3600)")
def cat_at(spark, d):
    return V.at(events_as_flares(spark, d), 1704500000.0).select("event_id")


@query("cat_range", f"WITH {E}, {FLARES}, c AS (SELECT *, CASE WHEN value >= 300 THEN 'X' ELSE 'M' END || printf('%.1f', k % 9 + 1.0) AS cls FROM f) SELECT event_id, cls FROM c WHERE t_peak BETWEEN 1704400000.0 AND 1705400000.0 AND (CASE substr(cls, 1, 1) WHEN 'X' THEN 4 ELSE 3 END) + CAST(substr(cls, 2) AS DOUBLE) / 10 >= 3.5 ORDER BY t_peak DESC, event_id LIMIT 40")
def cat_range(spark, d):
    cls = F.concat(F.when(F.col("value") >= 300, "X").otherwise("M"), (F.col("k") % 9 + 1).cast("string"), F.lit(".0"))
    c = events_as_flares(spark, d).withColumn("cls", cls)
    return V.query_range(c, 1704400000.0, 1705400000.0, "M5.0", 40, "cls").select("event_id", "cls")


@query("cat_neighbors", f"WITH {E}, {FLARES} SELECT event_id FROM f WHERE floor(t_peak / 3600) IN (floor(1704500000.0 / 3600), floor(1704500000.0 / 3600) - 1)")
def cat_neighbors(spark, d):
    return V.neighbors(events_as_flares(spark, d), 1704500000.0).select("event_id")


@query("cat_latest", f"WITH {E} SELECT stream, arg_max(event_id, (t, event_id)) AS event_id, arg_max(value, (t, event_id)) AS value FROM e GROUP BY stream")
def cat_latest(spark, d):
    return V.latest(streams(spark, d)).select("stream", "event_id", "value")


@query("cat_topk", f"WITH {E}, {FLARES}, l AS (SELECT * FROM f ORDER BY t_peak DESC, event_id LIMIT 50) SELECT event_id, value FROM l WHERE value >= 200")
def cat_topk(spark, d):
    return events_as_flares(spark, d).orderBy(F.desc("t_peak"), "event_id").limit(50).where("value >= 200").select("event_id", "value")


@query("cat_upsert", f"WITH {E}, a AS (SELECT user_id, k, value, t AS seq, event_id FROM e), w AS (SELECT user_id, k, arg_max(value, (seq, event_id)) AS value FROM a GROUP BY ALL) SELECT * FROM w")
def cat_upsert(spark, d):
    e = streams(spark, d).select("user_id", "k", "value", F.struct("t", "event_id").alias("seq"))
    return V.upsert(e.where("k % 2 = 0"), e.where("k % 2 = 1"), ["user_id", "k"]).select("user_id", "k", "value")


@query("cat_flatten", f"""WITH {E}, {FLARES} SELECT event_id, CAST(round_even(t_start * 1000, 0) AS BIGINT) AS t_start, CAST(round_even(t_peak * 1000, 0) AS BIGINT) AS t_peak, CAST(round_even(t_end * 1000, 0) AS BIGINT) AS t_end, 'M1.0' AS goes_class, value AS peak_flux_native, value * 2 AS peak_flux_goes_equiv, value / 2 AS hxr_peak_counts,
    'SDD' || (1 + k % 2) AS detector_used, CAST(stream = 'view' AS INTEGER) AS soft_detected, CAST(stream = 'click' AS INTEGER) AS hard_detected, CAST(k % 4 = 1 AS INTEGER) AS neupert_consistent, round(k / 100.0, 4) AS confidence, '["cusum","' || stream || '"]' AS detectors,
    CAST((CASE WHEN k % 2 = 0 THEN 128 ELSE 0 END) + (CASE WHEN k % 3 > 0 THEN 256 ELSE 0 END) AS INTEGER) AS qc_bitmask, CASE WHEN k % 5 = 0 THEN 'GOES' ELSE '' END AS ref_catalog, CASE WHEN k % 5 = 0 THEN 'R' || event_id ELSE '' END AS ref_id FROM f""")
def cat_flatten(spark, d):
    s, k = F.col("stream"), F.col("k")
    soft = F.struct((s == "view").alias("detected"), F.col("value").alias("peak_flux_native"), (F.col("value") * 2).alias("peak_flux_goes_equiv"), F.concat(F.lit("SDD"), (1 + k % 2).cast("string")).alias("detector_used"))
    hard = F.struct((s == "click").alias("detected"), (F.col("value") / 2).alias("peak_counts"))
    flags = F.struct((k % 2 == 0).alias("data_gap_during"), (k % 3).alias("spike_rejected"), F.when(k % 4 > 0, k % 4 == 1).alias("neupert_consistent"))
    known = k % 5 == 0
    ref = F.struct(F.when(known, "GOES").alias("catalog"), F.when(known, F.concat(F.lit("R"), F.col("event_id").cast("string"))).alias("id"))
    f = events_as_flares(spark, d).select("event_id", "t_start", "t_peak", "t_end", F.lit("M1.0").alias("goes_class"), soft.alias("soft"), hard.alias("hard"), flags.alias("flags"), F.round(k / F.lit(100.0), 4).alias("confidence"), F.array(F.lit("cusum"), s).alias("detectors"), ref.alias("ref_match"))
    flat = V.flatten_catalogue(f)
    return flat.select(*[F.coalesce(c, F.lit("")).alias(c) if c in ("ref_catalog", "ref_id") else F.col(c).cast("int").alias(c) if c == "qc_bitmask" else F.col(c) for c in flat.columns])


@query("cat_health", f"WITH {E} SELECT count(*) AS n_samples, string_agg(DISTINCT stream, ',' ORDER BY stream) AS streams, CAST(count(DISTINCT stream) AS BIGINT) AS n_streams FROM e")
def cat_health(spark, d):
    names = F.sort_array(F.collect_set("stream"))
    return streams(spark, d).agg(F.count("*").alias("n_samples"), F.array_join(names, ",").alias("streams"), F.size(names).cast("long").alias("n_streams"))


@query("cat_json_record", f"""WITH {E}, {FLARES} SELECT CAST(event_id AS VARCHAR) AS event_id, round(t_start - 1704067200.0, 3) AS t_start, round(t_peak - 1704067200.0, 3) AS t_peak, round(t_end - 1704067200.0, 3) AS t_end, 'M' || (k % 9) AS goes_class, stream = 'view' AS soft_detected, value AS peak_flux,
    value / 2 AS peak_counts, CASE WHEN k % 3 > 0 THEN CAST(k % 2 = 0 AS VARCHAR) ELSE '' END AS gap, CASE WHEN k % 4 > 0 THEN k / 100.0 ELSE 0.0 END AS confidence, CASE WHEN k % 5 > 0 THEN 'cusum,' || stream ELSE '' END AS detectors, CASE WHEN k % 7 = 0 THEN 'R' || k ELSE '' END AS ref_id FROM f""")
def cat_json_record(spark, d):
    """The whole nested record through a JSON dump and back."""
    from ..operators import records as R

    s, k = F.col("stream"), F.col("k")
    f = events_as_flares(spark, d).select(
        F.col("event_id").cast("string").alias("event_id"), "t_start", "t_peak", "t_end", F.concat(F.lit("M"), (k % 9).cast("string")).alias("goes_class"),
        F.struct((s == "view").alias("detected"), F.col("value").alias("peak_flux_native")).alias("soft"), F.struct((F.col("value") / 2).alias("peak_counts")).alias("hard"),
        F.when(k % 3 > 0, F.create_map(F.lit("data_gap_during"), (k % 2 == 0).cast("string"))).alias("flags"), F.when(k % 4 > 0, k / F.lit(100.0)).alias("confidence"),
        F.when(k % 5 > 0, F.array(F.lit("cusum"), s)).alias("detectors"), F.when(k % 7 == 0, F.struct(F.concat(F.lit("R"), k.cast("string")).alias("id"))).alias("ref_match"),
    )
    r = R.from_json_record(R.to_json_record(f))
    rel = lambda c: F.round(F.col(c) - 1704067200.0, 3).alias(c)
    return r.select(
        "event_id", rel("t_start"), rel("t_peak"), rel("t_end"), "goes_class", F.col("soft.detected").alias("soft_detected"), F.col("soft.peak_flux_native").alias("peak_flux"), "hard.peak_counts",
        F.coalesce(F.try_element_at("flags", F.lit("data_gap_during")), F.lit("")).alias("gap"), "confidence", F.array_join("detectors", ",").alias("detectors"), F.coalesce("ref_match.id", F.lit("")).alias("ref_id"),
    )


@query("cat_json", f"WITH {E}, {FLARES} SELECT event_id, stream AS band, value FROM f")
def cat_json(spark, d):
    f = events_as_flares(spark, d).select(F.to_json(F.struct("event_id", F.struct("stream", "value").alias("soft"))).alias("j"))
    p = f.select(F.from_json("j", "event_id long, soft struct<stream: string, value: double>").alias("p"))
    return p.select("p.event_id", F.col("p.soft.stream").alias("band"), F.col("p.soft.value").alias("value"))
