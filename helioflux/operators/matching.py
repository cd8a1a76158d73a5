"""One-to-one matching and clustering of events in the order of their arrival, by machines that forget (see ``blocks``)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalar as X
from ..state import machines as S
from .blocks import settle
from .common import cut
from .events import range_join


def pair_bands(found: DataFrame, tau: float = K.MATCH_TAU, lead: float = K.LEAD_S, lag: float = K.LAG_S, rows: int = 2048) -> DataFrame:
    """Pairs (soft_id, hard_id, soft_onset, soft_peak, hard_onset, hard_peak, score) of detections (id, band, onset, peak).

    The outcome of the loop over arrivals in order of (onset, band, id): each takes the best waiting partner of the other band with
    a score of ``tau`` or more, the one that came later among equals, or else waits. A detection is in one pair at most. Detections
    without an onset pair with nothing; one without a peak can pair, but has no order of peaks.
    """

    def step(m: S.Associator, r: dict) -> list[tuple]:
        peak = None if r["peak"] is None or r["peak"] != r["peak"] else r["peak"]
        pair = m.push_pair({"band": r["band"], "onset": r["onset"], "peak": peak, "id": r["id"]})
        if pair is None:
            return []
        s, h, score = pair
        return [(s["id"], h["id"], s["onset"], s["peak"], h["onset"], h["peak"], score)]

    kind = found.schema["id"].dataType.simpleString()
    schema = f"soft_id {kind}, hard_id {kind}, soft_onset double, soft_peak double, hard_onset double, hard_peak double, score double"
    d = found.select("id", "band", F.col("onset").cast("double").alias("onset"), F.col("peak").cast("double").alias("peak")).where("onset is not null")
    return settle(d, lambda: S.Associator(tau, lead, lag), step, schema, (), ("onset", "band", "id"), rows)


def associate(found: DataFrame, tau: float = K.MATCH_TAU, lead: float = K.LEAD_S, lag: float = K.LAG_S) -> DataFrame:
    """Events (t_start, t_peak, soft_id, hard_id, neupert, sxr_weak, score): the pairs, and every other detection by itself.

    The loop forgets a waiting detection once another of its band waits more than ``lag`` after it; here it comes out alone, as do
    those that wait at the end.
    """
    pairs = pair_bands(found, tau, lead, lag)
    start = F.least("soft_onset", "hard_onset")
    both = pairs.select(
        start.alias("t_start"), F.coalesce("soft_peak", start).alias("t_peak"), "soft_id", "hard_id", F.coalesce(F.col("hard_peak") < F.col("soft_peak"), F.lit(False)).alias("neupert"), F.lit(False).alias("sxr_weak"), "score"
    )
    used = pairs.select(F.explode(F.array(F.struct(F.lit("soft").alias("band"), F.col("soft_id").alias("id")), F.struct(F.lit("hard").alias("band"), F.col("hard_id").alias("id")))).alias("u")).select("u.*")
    alone = found.join(used, ["band", "id"], "left_anti")
    soft = F.col("band") == "soft"
    solo = alone.select(
        F.col("onset").cast("double").alias("t_start"), F.coalesce(F.when(soft, F.col("peak")), F.col("onset")).cast("double").alias("t_peak"),
        F.when(soft, F.col("id")).alias("soft_id"), F.when(~soft, F.col("id")).alias("hard_id"), F.lit(False).alias("neupert"), (~soft).alias("sxr_weak"), F.lit(0.0).alias("score"),
    )
    return both.unionByName(solo)


def match_truth(truth: DataFrame, events: DataFrame, tol: float = 600.0, rows: int = 2048) -> DataFrame:
    """Rows (truth_id, event_id, dt_s, outcome) of truth (id, t) and events (id, t): matched, missed and false_alarm.

    Truth rows in order of (t, id) each take the nearest event within ``tol`` that no earlier one took, the later of equals. A truth
    row is taken up when all events it may get have come, ``tol`` after its time, so its decision needs what came in the last 2 tol.
    Rows without a time match nothing: truth is missed, an event a false alarm.
    """

    def step(m: S.TruthMatcher, r: dict) -> list[tuple]:
        hit = m.push(r["truth"], r["t"], r["id"], r["at"])
        return [] if hit is None else [hit]

    kinds = truth.schema["id"].dataType.simpleString(), events.schema["id"].dataType.simpleString()
    if kinds[0] != kinds[1]:
        raise ValueError("identities of truth and events must be of one type")
    t = F.col("t").cast("double")
    arrive = events.select("id", t.alias("t"), t.alias("at"), F.lit(False).alias("truth")).unionByName(truth.select("id", t.alias("t"), (t + tol).alias("at"), F.lit(True).alias("truth")))
    pairs = settle(arrive.where("t is not null"), lambda: S.TruthMatcher(tol), step, f"truth_id {kinds[0]}, event_id {kinds[0]}, dt_s double", (), ("at", "truth", "id"), rows)
    none = F.lit(None).cast(kinds[0])
    missed = truth.join(pairs, truth["id"] == pairs["truth_id"], "left_anti").select(F.col("id").alias("truth_id"), none.alias("event_id"), F.lit(None).cast("double").alias("dt_s"), F.lit("missed").alias("outcome"))
    extra = events.join(pairs, events["id"] == pairs["event_id"], "left_anti").select(none.alias("truth_id"), F.col("id").alias("event_id"), F.lit(None).cast("double").alias("dt_s"), F.lit("false_alarm").alias("outcome"))
    return pairs.withColumn("outcome", F.lit("matched")).unionByName(missed).unionByName(extra)


# --- consensus of catalogues ------------------------------------------------------------------------------------------------
def place_entries(entries: DataFrame, tol: float = K.PEAK_TOL_S, loc_tol: float = K.LOCATION_TOL_DEG, rows: int = 2048) -> DataFrame:
    """``entries`` (event_id, catalog, t_peak and, where known, vantage_r_au, lon_deg, lat_deg, goes_class, is_hxr, is_sxr) with ``cluster``.

    Times move to Earth by light travel first. In order of (t_peak, catalog, event_id) an entry joins the first open cluster whose mean
    time is within ``tol`` and of whose placed members none lies more than ``loc_tol`` degrees away, or opens one; a cluster is
    named after its first entry, ``catalog:event_id``, and told from others of that name by first_t, first_lon and first_lat. Entries without a place fit any. Missing columns are as null: 1 au, no place,
    no class, not hard, soft. Entries without a time are left out.
    """
    kind = entries.schema["event_id"].dataType.simpleString()
    have = set(entries.columns)
    col = lambda c, k, default=None: (F.coalesce(F.col(c).cast(k), F.lit(default)) if c in have else F.lit(default)).cast(k).alias(c)
    d = entries.select("event_id", F.coalesce("catalog", F.lit("")).alias("catalog"), (F.col("t_peak") + X.ltt_delta(col("vantage_r_au", "double", 1.0))).cast("double").alias("t_peak"), col("lon_deg", "double"), col("lat_deg", "double"), col("goes_class", "string"), col("is_hxr", "boolean", False), col("is_sxr", "boolean", True))

    def step(m: S.Clusters, r: dict) -> list[tuple]:
        num = lambda x: None if x is None or x != x else x
        lon, lat = num(r["lon_deg"]), num(r["lat_deg"])
        first = m.push(r["t_peak"], lon, lat, f"{r['catalog']}:{r['event_id']}")
        return [(r["event_id"], r["catalog"], r["t_peak"], lon, lat, r["goes_class"], r["is_hxr"], r["is_sxr"], *first)]

    schema = f"event_id {kind}, catalog string, t_peak double, lon_deg double, lat_deg double, goes_class string, is_hxr boolean, is_sxr boolean, cluster string, first_t double, first_lon double, first_lat double"
    return settle(d.where("t_peak is not null"), lambda: S.Clusters(tol, loc_tol), step, schema, (), ("t_peak", "catalog", "event_id"), rows)


def consensus_labels(entries: DataFrame, reliabilities: Mapping[str, float], own: DataFrame | None = None, confirm: float = K.CONFIRM, reject: float = K.REJECT, tol: float = K.PEAK_TOL_S, loc_tol: float = K.LOCATION_TOL_DEG) -> DataFrame:
    """One label per cluster: (cluster, t_peak, confidence, status, goes_class, voters, n_catalogs, sxr_weak, lon_deg, lat_deg).

    A catalogue votes once, with its reliability against that of all of them. The class is the first one of a catalogue named GOES...,
    else the first one; the place is the first one given. A candidate seen in hard radiation only is confirmed, as is one within ``tol`` of a
    time of ``own`` (t_peak). Catalogues without a reliability vote 0.
    """
    total = sum(reliabilities.values())
    if total <= 0:
        raise ValueError("reliabilities must sum to more than 0")
    d, same = place_entries(entries, tol, loc_tol), ["cluster", "first_t", "first_lon", "first_lat"]
    rho = F.coalesce(F.create_map(*[F.lit(x) for kv in reliabilities.items() for x in kv])[F.col("catalog")], F.lit(0.0))
    first = "struct(t_peak, catalog, event_id)"
    one = d.groupBy(*same, "catalog").agg(
        F.max(rho).alias("rho"), F.sum("t_peak").alias("t"), F.count("*").alias("m"), F.max("is_hxr").alias("hxr"), F.max("is_sxr").alias("sxr"),
        F.expr(f"min(struct({first} AS o, goes_class AS c)) FILTER (WHERE goes_class <> '')").alias("cls"), F.expr(f"min(struct({first} AS o, lon_deg, lat_deg)) FILTER (WHERE lon_deg IS NOT NULL AND lat_deg IS NOT NULL)").alias("loc"),
    )
    g = one.groupBy(*same).agg(
        (F.sum("t") / F.sum("m")).alias("t_peak"), F.sort_array(F.collect_list(F.struct("catalog", "rho"))).alias("_v"), F.count("*").alias("n_catalogs"),
        (F.max("hxr") & ~F.max("sxr")).alias("sxr_weak"), F.expr("min(cls) FILTER (WHERE upper(catalog) LIKE 'GOES%')").alias("_g"), F.min("cls").alias("_c"), F.min("loc").alias("_l"),
    )
    votes = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v["rho"])  # in the order of names, so that the thresholds see one number
    g = g.withColumn("confidence", votes / total).withColumn("voters", F.transform("_v", lambda v: v["catalog"]))
    status = F.when(F.col("confidence") >= confirm, "confirmed").when(F.col("confidence") >= reject, "candidate").otherwise("rejected")
    status = F.when((status == "candidate") & F.col("sxr_weak"), "confirmed").otherwise(status)
    g = g.withColumn("status", status).withColumn("goes_class", F.coalesce("_g.c", "_c.c")).withColumn("lon_deg", F.col("_l.lon_deg")).withColumn("lat_deg", F.col("_l.lat_deg"))
    out = ["cluster", "t_peak", "confidence", "status", "goes_class", "voters", "n_catalogs", "sxr_weak", "lon_deg", "lat_deg"]
    if own is not None:
        g = cut(g)  # a mean of other rounding would not be found again
        seen = range_join(g.where("status = 'candidate'"), own.select(F.col("t_peak").alias("_own")), "t_peak", "_own", tol, tol).select(F.col("t_peak").alias("_t")).distinct()
        g = g.join(seen, F.col("t_peak") == F.col("_t"), "left").withColumn("status", F.when(F.col("_t").isNotNull() & (F.col("status") == "candidate"), "confirmed").otherwise(F.col("status")))
    return g.select(*out)
