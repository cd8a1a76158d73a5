"""Queries of forecast verification, labels, folds, baselines and lead times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as X  # noqa: F401
from ..operators import verify as M
from .registry import FLARES, E, events_as_flares, query, r6, read, streams

#: y: whether the next sample of the stream exceeds 30; p: a score with many ties.
YP = f"""{E}, n AS (SELECT event_id, stream, t, k, value, lead(value) OVER (PARTITION BY stream ORDER BY t, event_id) AS nx FROM e),
    yp AS (SELECT event_id, stream, t, k, CASE WHEN nx > 30 THEN 1.0 ELSE 0.0 END AS y, floor(200 * value / (value + 50)) / 200 AS p FROM n WHERE nx IS NOT NULL)"""


def _yp(spark, d):
    from ..operators.series import ordered

    n = streams(spark, d).withColumn("nx", F.lead("value").over(ordered())).where("nx is not null")
    return n.select("event_id", "stream", "t", "k", F.when(F.col("nx") > 30, 1.0).otherwise(0.0).alias("y"), (F.floor(200 * F.col("value") / (F.col("value") + 50)) / 200).alias("p"))


CM = "sum(CASE WHEN y = 1 AND p >= {t} THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p >= {t} THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND p < {t} THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 0 AND p < {t} THEN 1 ELSE 0 END) AS tn"


@query("met_confusion", f"""WITH {YP}, c AS (SELECT stream, {CM.format(t=0.3)} FROM yp GROUP BY stream)
    SELECT stream, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp / (tp + fn), 6) AS pod, round(fp / (fp + tp), 6) AS far, round(tp / (tp + fn) - fp / (fp + tn), 6) AS tss,
           round(2.0 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 6) AS hss FROM c""")
def met_confusion(spark, d):
    return M.confusion(_yp(spark, d), 0.3, ["stream"]).select("stream", "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("pod", "far", "tss", "hss")])


@query("met_brier_bss", f"WITH {YP}, m AS (SELECT stream, avg(y) AS c FROM yp GROUP BY stream) SELECT stream, round(avg((p - y) * (p - y)), 6) AS brier, round(1 - avg((p - y) * (p - y)) / avg((c - y) * (c - y)), 6) AS bss FROM yp JOIN m USING (stream) GROUP BY stream")
def met_brier_bss(spark, d):
    return M.brier(_yp(spark, d), ["stream"]).select("stream", r6("brier").alias("brier"), r6("bss").alias("bss"))


@query("met_roc_auc", f"""WITH {YP}, r AS (SELECT stream, y, rank() OVER (PARTITION BY stream ORDER BY p) + (count(*) OVER (PARTITION BY stream, p) - 1) / 2.0 AS rk FROM yp),
    s AS (SELECT stream, sum(CASE WHEN y = 1 THEN rk END) AS s, sum(y) AS np, count(*) - sum(y) AS nn FROM r GROUP BY stream) SELECT stream, round((s - np * (np + 1) / 2) / (np * nn), 6) AS roc_auc FROM s""")
def met_roc_auc(spark, d):
    return M.roc_auc(_yp(spark, d), ["stream"]).select("stream", r6("roc_auc").alias("roc_auc"))


@query("met_pr_auc", f"""WITH {YP}, g AS (SELECT stream, p, sum(y) AS pos, count(*) AS n FROM yp GROUP BY ALL), c AS (SELECT stream, p, sum(pos) OVER w AS tp, sum(n) OVER w AS n, sum(pos) OVER (PARTITION BY stream) AS np FROM g WINDOW w AS (PARTITION BY stream ORDER BY p DESC)),
    q AS (SELECT stream, p, tp / np AS r, tp / n AS pr FROM c), s AS (SELECT stream, (r - coalesce(lag(r) OVER w, 0)) * (pr + coalesce(lag(pr) OVER w, 1)) / 2 AS a FROM q WINDOW w AS (PARTITION BY stream ORDER BY p DESC)) SELECT stream, round(sum(a), 6) AS pr_auc FROM s GROUP BY stream""")
def met_pr_auc(spark, d):
    return M.pr_auc(_yp(spark, d), ["stream"]).select("stream", r6("pr_auc").alias("pr_auc"))


@query("met_reliability", f"WITH {YP} SELECT stream, CAST(least(9, floor(p * 10)) AS INTEGER) AS bin, round(avg(p), 6) AS mean_pred, round(avg(y), 6) AS obs_freq, count(*) AS n FROM yp GROUP BY ALL")
def met_reliability(spark, d):
    return M.reliability(_yp(spark, d), 10, ["stream"]).select("stream", "bin", r6("mean_pred").alias("mean_pred"), r6("obs_freq").alias("obs_freq"), "n")


@query("met_ece", f"WITH {YP}, b AS (SELECT stream, least(9, floor(p * 10)) AS b, avg(p) AS c, avg(y) AS a, count(*) AS n FROM yp GROUP BY ALL) SELECT stream, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b GROUP BY stream")
def met_ece(spark, d):
    return M.ece(_yp(spark, d), 10, ["stream"]).select("stream", r6("ece").alias("ece"))


@query("met_best_threshold", f"""WITH {YP}, g AS (SELECT stream, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM yp GROUP BY ALL), c AS (SELECT stream, p, sum(pos) OVER w / sum(pos) OVER (PARTITION BY stream) - sum(neg) OVER w / sum(neg) OVER (PARTITION BY stream) AS tss FROM g WINDOW w AS (PARTITION BY stream ORDER BY p DESC))
    SELECT stream, round(min(p), 6) AS theta, round(any_value(tss), 6) AS tss FROM (SELECT *, rank() OVER (PARTITION BY stream ORDER BY round(tss, 12) DESC) AS r FROM c) WHERE r = 1 GROUP BY stream""")
def met_best_threshold(spark, d):
    return M.best_threshold(_yp(spark, d), ["stream"]).select("stream", r6("theta").alias("theta"), r6("tss").alias("tss"))


@query("met_report", f"""WITH {YP}, c AS (SELECT {CM.format(t=0.25)}, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, avg(y) AS b, avg((p - y) * (p - y)) AS brier FROM yp)
    SELECT n, n_pos, round(b, 6) AS base_rate, round(tp / (tp + fn), 6) AS pod, round(tp / (tp + fn) - fp / (fp + tn), 6) AS tss, round(brier, 6) AS brier FROM c""")
def met_report(spark, d):
    return M.report(_yp(spark, d), 0.25).select("n", "n_pos", r6("base_rate").alias("base_rate"), r6("pod").alias("pod"), r6("tss").alias("tss"), r6("brier").alias("brier"))


_BASE = "CAST(CASE WHEN k >= 50 THEN 0.7 ELSE 0.2 END AS DOUBLE)"


@query("met_report_skill", f"""WITH {YP}, z AS (SELECT y, p, {_BASE} AS pers, 0.4::DOUBLE AS clim FROM yp), a AS (SELECT sum(y) AS np, sum(1 - y) AS nn, avg((p - y) * (p - y)) AS bs, avg((pers - y) * (pers - y)) AS bp, avg((clim - y) * (clim - y)) AS bc FROM z),
    tss AS (SELECT name, q, sum(pos) OVER (PARTITION BY name ORDER BY q DESC) / np - sum(neg) OVER (PARTITION BY name ORDER BY q DESC) / nn AS tss FROM (SELECT 'm' AS name, p AS q, sum(y) AS pos, sum(1 - y) AS neg FROM z GROUP BY ALL UNION ALL SELECT 'p', pers, sum(y), sum(1 - y) FROM z GROUP BY ALL UNION ALL SELECT 'c', clim, sum(y), sum(1 - y) FROM z GROUP BY ALL), a),
    b AS (SELECT name, max(tss) AS tss, min(q) AS theta FROM (SELECT *, rank() OVER (PARTITION BY name ORDER BY round(tss, 12) DESC) AS r FROM tss) WHERE r = 1 GROUP BY name),
    c AS (SELECT {CM.format(t="(SELECT theta FROM b WHERE name = 'm')")} FROM z)
    SELECT round((SELECT theta FROM b WHERE name = 'm'), 6) AS theta, round(tp / (tp + fn) - fp / (fp + tn), 6) AS tss, round(2.0 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 6) AS hss, round(fp / (fp + tp), 6) AS far, round(bs, 6) AS brier,
      round(bp, 6) AS pers_brier, round(1 - bs / bp, 6) AS pers_skill_vs, round((SELECT tss FROM b WHERE name = 'p'), 6) AS pers_tss, round((SELECT theta FROM b WHERE name = 'p'), 6) AS pers_theta,
      round(bc, 6) AS clim_brier, round(1 - bs / bc, 6) AS clim_skill_vs, round((SELECT tss FROM b WHERE name = 'c'), 6) + 0.0 AS clim_tss, round((SELECT theta FROM b WHERE name = 'c'), 6) AS clim_theta FROM a, c""")
def met_report_skill(spark, d):
    """The battery at the best threshold, with the skill against two baselines."""
    z = _yp(spark, d).select("y", "p", F.expr(_BASE).alias("pers"), F.lit(0.4).alias("clim"))
    out = ["theta", "tss", "hss", "far", "brier", *[f"{b}_{c}" for b in ("pers", "clim") for c in ("brier", "skill_vs", "tss", "theta")]]
    return M.report(z, None, ["pers", "clim"]).select(*[(r6(c) + 0.0).alias(c) for c in out])


@query("met_by_label", """SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def met_by_label(spark, d):
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("join_label_semi", f"""WITH {E}, {FLARES} SELECT e.event_id, CAST(EXISTS (SELECT 1 FROM f WHERE f.stream = e.stream AND f.t_peak > e.t AND f.t_peak <= e.t + 3600) AS INTEGER) AS y FROM e
    WHERE EXISTS (SELECT 1 FROM f WHERE f.stream = e.stream AND f.t_peak > e.t AND f.t_peak <= e.t + 3600) OR NOT EXISTS (SELECT 1 FROM f WHERE f.stream = e.stream AND e.t BETWEEN f.t_start AND f.t_end)""")
def join_label_semi(spark, d):
    t = streams(spark, d).select("event_id", "stream", "t")
    return M.labels(t, events_as_flares(spark, d), 60.0, ["stream"]).select("event_id", "y")


@query("join_in_event", f"WITH {E}, {FLARES} SELECT e.event_id, EXISTS (SELECT 1 FROM f WHERE f.stream = e.stream AND e.t BETWEEN f.t_start AND f.t_end) AS in_event FROM e")
def join_in_event(spark, d):
    spans = events_as_flares(spark, d).select("stream", F.col("t_start").alias("lo"), F.col("t_end").alias("hi"))
    return M.in_event(streams(spark, d).select("event_id", "stream", "t"), spans, ["stream"]).select("event_id", "in_event")


@query("cv_blocked", f"""WITH {E}, s AS (SELECT event_id, t, k, row_number() OVER (ORDER BY t, event_id) - 1 AS n, count(*) OVER () AS m FROM e WHERE stream = 'view'),
    f AS (SELECT i AS fold, CAST(round_even(i * m / 5.0::DOUBLE, 0) AS BIGINT) AS lo, CAST(round_even((i + 1) * m / 5.0::DOUBLE, 0) AS BIGINT) AS hi FROM range(1, 5) r(i), (SELECT any_value(m) AS m FROM s)),
    te AS (SELECT fold, event_id, t, k // 10 AS g FROM s JOIN f ON n >= lo AND n < hi), t0 AS (SELECT fold, min(t) AS t0 FROM te GROUP BY fold),
    tr AS (SELECT fold, event_id, k // 10 AS g FROM s JOIN t0 ON t < t0 - 7200)
    SELECT CAST(fold AS INTEGER) AS fold, 'test' AS role, event_id FROM te UNION ALL SELECT CAST(fold AS INTEGER), 'train', event_id FROM tr""")
def cv_blocked(spark, d):
    s = streams(spark, d).where("stream = 'view'").select("event_id", "t")
    return M.blocked_folds(s, 4, order=("t", "event_id")).select(F.col("fold").cast("int").alias("fold"), "role", "event_id")


@query("cv_grouped", f"""WITH {E}, s AS (SELECT event_id, t, CAST(floor(t / 86400) AS BIGINT) AS g, row_number() OVER (ORDER BY t, event_id) - 1 AS n, count(*) OVER () AS m FROM e WHERE stream = 'view'),
    f AS (SELECT i AS fold, CAST(round_even(i * m / 5.0::DOUBLE, 0) AS BIGINT) AS lo, CAST(round_even((i + 1) * m / 5.0::DOUBLE, 0) AS BIGINT) AS hi FROM range(1, 5) r(i), (SELECT any_value(m) AS m FROM s)),
    te AS (SELECT fold, event_id, t, g FROM s JOIN f ON n >= lo AND n < hi), t0 AS (SELECT fold, min(t) AS t0 FROM te GROUP BY fold)
    SELECT CAST(t0.fold AS INTEGER) AS fold, count(*) AS n_train FROM s JOIN t0 ON t < t0 - 600 WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.fold = t0.fold AND te.g = s.g) GROUP BY t0.fold""")
def cv_grouped(spark, d):
    s = streams(spark, d).where("stream = 'view'").select("event_id", "t", F.floor(F.col("t") / 86400).cast("long").alias("g"))
    f = M.blocked_folds(s, 4, 10.0, ("t", "event_id"), "g").where("role = 'train'")
    return f.groupBy(F.col("fold").cast("int").alias("fold")).agg(F.count("*").alias("n_train"))


@query("base_climatology", f"WITH {YP} SELECT stream, round(least(1 - 1e-6, greatest(1e-6, avg(y))), 6) AS p FROM yp GROUP BY stream")
def base_climatology(spark, d):
    return M.climatology(_yp(spark, d), ["stream"]).select("stream", r6("p").alias("p"))


@query("base_persistence", f"WITH {E} SELECT event_id, CASE WHEN value / 30 >= 1.5 THEN 0.999 ELSE 0.001 END AS p_hard, round(least(0.999, greatest(0.001, 1 - exp(-k / 40.0))), 6) AS p_decayed FROM e")
def base_persistence(spark, d):
    return streams(spark, d).select("event_id", M.persistence(F.col("value") / 30).alias("p_hard"), r6(M.persistence_decayed(F.col("k") / 40.0)).alias("p_decayed"))


@query("base_hawkes", f"WITH {E}, m AS (SELECT stream, greatest(count(*) / ((max(t) - min(t)) / 60), 1e-9) AS mu FROM e WHERE value >= 100 GROUP BY stream) SELECT event_id, round(least(1 - 1e-6, greatest(1e-6, 1 - exp(-mu * (1 + 0.5 * k / 40.0) * 30))), 6) AS p FROM e JOIN m USING (stream)")
def base_hawkes(spark, d):
    s = streams(spark, d)
    mu = M.hawkes_rate(s.where("value >= 100"), ["stream"])
    return s.join(mu, "stream").select("event_id", r6(M.hawkes(F.col("mu_per_min"), F.col("k") / 40.0, F.lit(30.0))).alias("p"))


LT = f"""{E}, q AS (SELECT stream, t, value / (value + 50) AS p FROM e), {FLARES}, pk AS (SELECT event_id, stream, t_start AS t_peak FROM f WHERE value >= 200)"""
CONF = "SELECT stream, t, p >= {th} AS o, p >= {th} AND sum(CASE WHEN p >= {th} THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) >= 2 AS c FROM q"


def _lt(spark, d):
    q = streams(spark, d).select("stream", "t", (F.col("value") / (F.col("value") + 50)).alias("p"))
    pk = events_as_flares(spark, d).where("value >= 200").select("event_id", "stream", F.col("t_start").alias("t_peak"))
    return q, pk


@query("lead_time", f"WITH {LT}, c AS ({CONF.format(th=0.4)}) SELECT event_id, round(coalesce(t_peak - min(t), -1), 4) AS lead_s FROM pk LEFT JOIN (SELECT stream AS s2, t FROM c WHERE c) x ON s2 = stream AND t >= t_peak - 7200 AND t < t_peak GROUP BY event_id, t_peak")
def lead_time(spark, d):
    q, pk = _lt(spark, d)
    return M.lead_times(q, pk, 0.4, by=["stream"]).select("event_id", F.round(F.coalesce("lead_s", F.lit(-1.0)), 4).alias("lead_s"))


@query("lead_report", f"""WITH {LT}, c AS ({CONF.format(th=0.4)}), l AS (SELECT event_id, t_peak - min(t) AS s FROM pk LEFT JOIN (SELECT stream AS s2, t FROM c WHERE c) x ON s2 = stream AND t >= t_peak - 7200 AND t < t_peak GROUP BY event_id, t_peak)
    SELECT round(median(s), 4) AS median_lead_s, round(quantile_cont(s, 0.75) - quantile_cont(s, 0.25), 4) AS iqr_lead_s, count(s) AS n_hit, count(*) - count(s) AS n_miss, round(count(s) / count(*), 6) AS tpr, round(avg(CASE WHEN s >= 900 THEN 1.0 WHEN s IS NOT NULL THEN 0.0 END), 6) AS frac_ge_15 FROM l""")
def lead_report(spark, d):
    q, pk = _lt(spark, d)
    r = M.lead_report(M.lead_times(q, pk, 0.4, by=["stream"]))
    return r.select(F.round("median_lead_s", 4).alias("median_lead_s"), F.round("iqr_lead_s", 4).alias("iqr_lead_s"), "n_hit", "n_miss", r6("tpr").alias("tpr"), r6("frac_ge_15").alias("frac_ge_15"))


@query("alert_episodes", f"""WITH {LT}, c AS ({CONF.format(th=0.35)}), n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY t) AS n FROM c), r AS (SELECT *, n - row_number() OVER (PARTITION BY stream ORDER BY t) AS run FROM n WHERE o)
    SELECT stream, round(min(CASE WHEN c THEN t END) - 1704067200.0, 4) AS t_alert FROM r GROUP BY stream, run HAVING min(CASE WHEN c THEN t END) IS NOT NULL""")
def alert_episodes(spark, d):
    q, _ = _lt(spark, d)
    return M.episodes(M.confirmed(q, 0.35, ["stream"]), ["stream"]).select("stream", F.round(F.col("t_alert") - 1704067200.0, 4).alias("t_alert"))


@query("lt_vs_far", f"""WITH {LT}, h(theta) AS (VALUES (0.3::DOUBLE), (0.5::DOUBLE)),
    c AS (SELECT theta, stream, t, p >= theta AS o, p >= theta AND sum(CASE WHEN p >= theta THEN 1 ELSE 0 END) OVER (PARTITION BY theta, stream ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) >= 2 AS c FROM q, h),
    n AS (SELECT *, row_number() OVER (PARTITION BY theta, stream ORDER BY t) AS n FROM c), r AS (SELECT *, n - row_number() OVER (PARTITION BY theta, stream ORDER BY t) AS run FROM n WHERE o),
    a AS (SELECT theta, stream, min(CASE WHEN c THEN t END) AS ta FROM r GROUP BY theta, stream, run HAVING min(CASE WHEN c THEN t END) IS NOT NULL),
    l AS (SELECT h.theta, pk.event_id, t_peak - min(c.t) AS s FROM pk CROSS JOIN h JOIN c ON c.theta = h.theta AND c.stream = pk.stream AND c.c AND c.t >= t_peak - 7200 AND c.t < t_peak GROUP BY h.theta, pk.event_id, t_peak),
    fa AS (SELECT theta, 1 - avg(CASE WHEN EXISTS (SELECT 1 FROM pk WHERE pk.stream = a.stream AND t_peak BETWEEN ta AND ta + 7200) THEN 1.0 ELSE 0.0 END) AS far FROM a GROUP BY theta),
    tp AS (SELECT theta, avg(CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.theta = h.theta AND a.stream = pk.stream AND ta >= t_peak - 7200 AND ta < t_peak) THEN 1.0 ELSE 0.0 END) AS tpr FROM pk CROSS JOIN h GROUP BY theta)
    SELECT theta, round(median(s), 4) AS median_lead_s, round(any_value(tpr), 6) AS tpr, round(any_value(far), 6) AS far FROM l JOIN fa USING (theta) JOIN tp USING (theta) GROUP BY theta""")
def lt_vs_far(spark, d):
    q, pk = _lt(spark, d)
    r = M.lead_vs_far(q, pk, [0.3, 0.5], by=["stream"])
    return r.select("theta", F.round("median_lead_s", 4).alias("median_lead_s"), r6("tpr").alias("tpr"), r6("far").alias("far"))
