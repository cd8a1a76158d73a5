"""Blocked scans, settled machines, global order and one-to-one matching against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helioflux.operators import blocks as B
from helioflux.operators import detect as D
from helioflux.operators import matching as M
from helioflux.operators.events import merge_chains
from helioflux.operators.verify import blocked_folds
from helioflux.state import machines as S

SAMPLES = "event_id long, stream string, t double, value double"


def samples(n=3000, seed=1):
    rng = random.Random(seed)
    return [(i, "a" if rng.random() < 0.9 else "b", float(rng.randrange(4 * n)), round(rng.gauss(1, 20), 2)) for i in range(n)]


def by_stream(rows):
    for s in ("a", "b"):
        yield s, sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0]))


@pytest.fixture(scope="module")
def rows():
    return samples()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SAMPLES).repartition(5)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(B, "ROWS", 64)


@pytest.mark.parametrize(("keep", "floor", "start"), [(0.99, None, 0.0), (0.3, None, 5.0), (1.0, 0.0, 0.0), (0.75, 0.0, 3.0), (0.999999, -10.0, 100.0), (1e-9, None, 0.0)])
def test_affine_scan(rows, frame, keep, floor, start):
    got = {r["event_id"]: (r["state"], r["state_before"]) for r in B.affine_scan(frame, F.col("value"), keep, floor, start).collect()}
    assert len(got) == len(rows)
    for _, own in by_stream(rows):
        f = start
        for i, _, _, x in own:
            before, f = f, max(-math.inf if floor is None else floor, keep * f + x)
            assert math.isclose(got[i][0], f, rel_tol=1e-9, abs_tol=1e-7) and math.isclose(got[i][1], before, rel_tol=1e-9, abs_tol=1e-7)


def test_means_start_with_the_first_value(rows, frame):
    got = {r["event_id"]: (r["mean"], r["var"]) for r in B.ewmv(frame, alpha=0.9).collect()}
    for _, own in by_stream(rows):
        m = S.Ewmv(0.9)
        for i, _, _, x in own:
            assert got[i] == pytest.approx(m.update(x), rel=1e-9, abs=1e-7)


def test_scan_of_odd_tables(spark):
    empty = spark.createDataFrame([], SAMPLES)
    assert B.ema(empty).collect() == [] and D.lindley(empty, F.col("value")).collect() == []
    d = spark.createDataFrame([(1, "a", 1.0, 2.0), (1, "a", 1.0, 2.0), (2, None, 1.0, 2.0)], SAMPLES)
    assert sorted(r["ema"] for r in B.ema(d, alpha=0.5).collect()) == [1.0, 1.5]  # rows without a stream are left out
    with pytest.raises(Exception, match="null"):
        B.ema(spark.createDataFrame([(1, "a", 1.0, None)], SAMPLES)).collect()
    with pytest.raises(ValueError, match="keep"):
        B.affine_scan(d, F.col("value"), 0.0)
    whole = B.affine_scan(d, F.col("value"), 1.0, by=(), state="total")
    assert max(r["total"] for r in whole.collect()) == 6.0


def test_one_skewed_stream_runs_in_many_tasks(spark):
    d = spark.range(200_000).select(F.col("id").alias("event_id"), F.lit("one").alias("stream"), F.col("id").cast("double").alias("t"), (F.col("id") % 7 - 3).cast("double").alias("value"))
    s = B.in_order(d, ["t"], ["stream"])
    parts = [r["count"] for r in s.groupBy("_part").count().collect()]
    assert len(parts) > 1 and max(parts) < 150_000
    got = D.lindley(d, F.col("value")).agg(F.sum("cusum")).first()[0]
    f = total = 0.0
    for i in range(200_000):
        f = max(0.0, f + i % 7 - 3)
        total += f
    assert got == pytest.approx(total)


@pytest.mark.parametrize("rows_a_block", [3, 50, 5000])
def test_settled_cusum(rows, frame, rows_a_block):
    got = {
        r["event_id"]: (r["statistic"], r["alarm"], r["onset"])
        for r in B.settle(frame, lambda: S.Cusum(0.5, 60.0), lambda m, r: [(r["event_id"], *(lambda s, o: (s, o is not None, o))(*m.update(r["value"], 0.0, 1.0, r["t"])))], "event_id long, statistic double, alarm boolean, onset double", ["stream"], ["t", "event_id"], rows_a_block).collect()
    }
    alarms = 0
    for _, own in by_stream(rows):
        m = S.Cusum(0.5, 60.0)
        for i, _, t, x in own:
            s, onset = m.update(x, 0.0, 1.0, t)
            alarms += onset is not None
            assert got[i][:2] == (s, onset is not None) and (got[i][2] is None or math.isnan(got[i][2])) == (onset is None)
    assert alarms > 10


def test_settle_says_when_a_machine_does_not_forget(frame):
    with pytest.raises(RuntimeError, match="not settled"):
        B.settle(frame, S.Ema, lambda m, r: [(m.update(r["value"]),)], "m double", ["stream"], ["t", "event_id"], 50, rounds=2)


def test_numbers_and_chains(spark):
    rng = random.Random(5)
    rows = [(i, float(rng.randrange(3000)), 0.0) for i in range(800)]
    rows = [(i, t, t + rng.choice([1, 5, 200])) for i, t, _ in rows]
    d = spark.createDataFrame(rows, "event_id long, t_start double, t_end double")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert {r["event_id"]: r["n"] for r in B.numbered(d, ["t_start", "event_id"]).collect()} == {r[0]: n for n, r in enumerate(order)}
    want, end, chain = {}, -math.inf, 0
    for i, a, b in order:
        chain += a > end + 2.0
        end = max(end, b)
        want[i] = chain
    assert {r["event_id"]: r["chain"] for r in merge_chains(d, 2.0).collect()} == want
    plan = merge_chains(d, 2.0)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert merge_chains(d.limit(0), 2.0).collect() == [] and B.numbered(d.limit(0), ["t_start"]).collect() == []


def test_folds_have_no_task_for_all_rows(spark):
    d = spark.range(100).select((F.col("id") * 3600.0).alias("t"))
    f = blocked_folds(d, 4, 60.0)
    plan = f._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("== Physical Plan ==")[1]
    test = {k: sorted(r["t"] for r in f.where(f"fold = {k} and role = 'test'").collect()) for k in (1, 2, 3, 4)}
    assert [len(test[k]) for k in test] == [20, 20, 20, 20] and test[1][0] == 20 * 3600.0


# --- matching ------------------------------------------------------------------------------------------------------------------
FOUND = "id long, band string, onset double, peak double"


def loop_pairs(rows, **limits):
    m, out = S.Associator(**limits), set()
    for i, band, onset, peak in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        p = m.push_pair({"id": i, "band": band, "onset": onset, "peak": peak})
        if p:
            out.add((p[0]["id"], p[1]["id"], round(p[2], 9)))
    return out


@pytest.mark.parametrize("step", [40.0, 333.0])
def test_pairs_of_a_chain_without_pause(spark, step):
    """10,000 detections, none of them more than the window after the last one."""
    rng = random.Random(int(step))
    rows, t = [], 0.0
    for i in range(10_000):
        t += rng.uniform(0, step)
        rows.append((i, rng.choice(["soft", "hard"]), t, rng.choice([None, t + rng.uniform(0, 300)])))
    rows += [(10_000 + i, "soft", t, t) for i in range(5)]  # ties
    d = spark.createDataFrame(rows, FOUND).repartition(6)
    pairs = M.pair_bands(d, rows=700)
    got = {(r["soft_id"], r["hard_id"], round(r["score"], 9)) for r in pairs.collect()}
    assert got == loop_pairs(rows) and len(got) > 1000
    assert len({a for a, *_ in got}) == len({b for _, b, _ in got}) == len(got)


def test_events_of_both_bands_and_of_one(spark):
    rows = [(1, "hard", 940.0, 990.0), (2, "soft", 1000.0, 1100.0), (3, "hard", 5000.0, 5050.0), (4, "soft", 9000.0, None)]
    got = {(r["soft_id"], r["hard_id"]): r for r in M.associate(spark.createDataFrame(rows, FOUND)).collect()}
    assert set(got) == {(2, 1), (None, 3), (4, None)}
    both = got[(2, 1)]
    assert both["t_start"] == 940.0 and both["t_peak"] == 1100.0 and both["neupert"] and not both["sxr_weak"]
    assert got[(None, 3)]["sxr_weak"] and got[(4, None)]["t_peak"] == 9000.0
    assert M.associate(spark.createDataFrame([], FOUND)).collect() == []


def test_truth_and_false_alarms(spark):
    rng = random.Random(8)
    truth = [(i, rng.uniform(0, 200_000)) for i in range(400)] + [(400, None)]
    events = [(i, rng.uniform(0, 200_000)) for i in range(450)] + [(450, truth[3][1]), (451, truth[3][1]), (452, None)]
    free, want = sorted((e for e in events if e[1] is not None), key=lambda e: (e[1], e[0])), set()
    for i, t in sorted((x for x in truth if x[1] is not None), key=lambda x: (x[1], x[0])):
        best, hit = 600.0, None
        for e in free:
            if abs(e[1] - t) <= best:
                best, hit = abs(e[1] - t), e
        if hit:
            free.remove(hit)
        want.add((i, hit and hit[0], "matched" if hit else "missed"))
    want |= {(400, None, "missed"), (None, 452, "false_alarm"), *((None, e[0], "false_alarm") for e in free)}
    schema = "id long, t double"
    m = M.match_truth(spark.createDataFrame(truth, schema), spark.createDataFrame(events, schema), 600.0, rows=40)
    assert {(r["truth_id"], r["event_id"], r["outcome"]) for r in m.collect()} == want


def test_a_machine_that_never_forgets_takes_few_rounds(rows, frame, monkeypatch):
    """The state is handed on along blocks that grow with the table; 3,000 rows in blocks of 16 took 190 rounds."""
    monkeypatch.setattr(B, "BLOCKS", 6)
    got = {r["event_id"]: r["m"] for r in B.settle(frame, S.Ema, lambda m, r: [(r["event_id"], m.update(r["value"]))], "event_id long, m double", (), ("t", "event_id"), 16, rounds=12).collect()}
    m = S.Ema()
    assert got == {i: m.update(x) for i, _, _, x in sorted(rows, key=lambda r: (r[2], r[0]))}


# --- consensus -----------------------------------------------------------------------------------------------------------------
ENTRY = "catalog string, event_id string, t_peak double, goes_class string, is_hxr boolean, is_sxr boolean, vantage_r_au double, lon_deg double, lat_deg double"


def entry(catalog, t, cls=None, hxr=None, sxr=None, r=None, lon=None, lat=None, name="e"):
    return (catalog, name, t, cls, hxr, sxr, r, lon, lat)


def labels(spark, rows, rho, **how):
    return {round(r["t_peak"]): r for r in M.consensus_labels(spark.createDataFrame(rows, ENTRY), rho, **how).collect()}


def test_two_of_three(spark):
    rho = {"GOES": 1.0, "STIX": 1.0, "GBM": 1.0}
    got = labels(spark, [entry("GOES", 1000.0, "M2.5"), entry("STIX", 1010.0, hxr=True), entry("GBM", 9000.0, hxr=True)], rho, confirm=0.5, reject=0.25)
    assert got[1005]["status"] == "confirmed" and got[1005]["voters"] == ["GOES", "STIX"] and got[1005]["goes_class"] == "M2.5"
    assert got[9000]["status"] == "candidate" and got[9000]["n_catalogs"] == 1


def test_votes_promotion_and_hard_only(spark):
    rho = {"GOES": 0.98, "STIX": 0.95, "GBM": 0.90}
    own = spark.createDataFrame([(2010.0,)], "t_peak double")
    rows = [entry("GOES", 500.0, "C5.0"), entry("STIX", 505.0, hxr=True), entry("GBM", 2000.0, hxr=True), entry("STIX", 7000.0, hxr=True, sxr=False), entry("GBM", 12000.0), entry("OTHER", 20000.0)]
    got = labels(spark, rows, rho, own=own)
    assert got[502]["confidence"] == pytest.approx((0.98 + 0.95) / 2.83)
    assert got[2000]["status"] == "confirmed" and got[12000]["status"] == "candidate"
    assert got[7000]["status"] == "confirmed" and got[7000]["sxr_weak"] and got[20000]["status"] == "rejected"


def test_light_travel_and_place(spark):
    rho = {"GOES": 1.0, "STIX": 1.0, "GBM": 1.0}
    rows = [entry("GOES", 10_000.0, "M1.0", r=1.0), entry("STIX", 10_000.0 - 249.5, hxr=True, r=0.5)]
    got = labels(spark, rows, rho, confirm=0.5)
    assert len(got) == 1 and next(iter(got.values()))["voters"] == ["GOES", "STIX"]
    twice = [entry("GOES", 5.0, lon=0.0, lat=0.0), entry("GOES", 5.0, lon=50.0, lat=0.0), entry("GOES", 5.0, lon=50.0, lat=0.0)]
    assert M.consensus_labels(spark.createDataFrame(twice, ENTRY), rho).count() == 2  # one name, two places
    apart = [entry("STIX", 100.0, "C1", lon=10.0, lat=0.0), entry("GBM", 110.0, "C2", lon=15.0, lat=3.0), entry("GOES", 120.0, "C3", lon=60.0, lat=0.0), entry("HXT", 130.0, "C9")]
    got = labels(spark, apart, rho)
    assert sorted((r["n_catalogs"], r["goes_class"], r["lon_deg"]) for r in got.values()) == [(1, "C3", 60.0), (3, "C1", 10.0)]


def test_clusters_of_many_entries(spark):
    rng = random.Random(2)
    rows, t = [], 0.0
    for i in range(1500):
        t += rng.uniform(0, 90)
        placed = rng.random() < 0.6
        rows.append((f"c{i % 5}", f"{i:05d}", t, None, False, True, 1.0, rng.uniform(-90, 90) if placed else None, rng.uniform(-40, 40) if placed else None))
    m, want = S.Clusters(), {}
    for c, e, t, _, _, _, _, lon, lat in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        want[e] = m.push(t, lon, lat, f"{c}:{e}")[0]
    got = {r["event_id"]: r["cluster"] for r in M.place_entries(spark.createDataFrame(rows, ENTRY), rows=100).collect()}
    assert got == want


def test_a_state_goes_to_its_block_once(rows, frame):
    """Every row of a block took the state through the shuffle and into the task."""
    d = B.settle(frame, S.Ema, lambda m, r: [(r["event_id"], "_begin" in r)], "event_id long, seen boolean", ("stream",), ("t", "event_id"), 100)
    seen = {r["event_id"]: r["seen"] for r in d.collect()}
    assert set(seen) == {r[0] for r in rows} and not any(seen.values())
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.splitlines() if "event_id" in line and "_begin" in line and "CoGroup" not in line]
    assert "CoGroup" in plan and not wide


@pytest.mark.parametrize("grain", [1.0, 20.0])
def test_truth_on_crowded_windows(grain):
    """Hundreds of used and free events in a window, with ties: one event goes to one truth row, as in the plain loop over all of them."""
    rng = random.Random(5)
    time = lambda: grain * round(rng.uniform(0, 6000) / grain)
    events, truth = sorted((time(), i) for i in range(3000)), sorted((time(), i) for i in range(3000))
    arrive = sorted([(t, False, i, t) for t, i in events] + [(t + 600.0, True, i, t) for t, i in truth])
    m, got, most = S.TruthMatcher(600.0), {}, 0
    for now, is_truth, i, t in arrive:
        hit = m.push(is_truth, t, i, now)
        most = max(most, len(m.free))
        if hit:
            got[hit[0]] = hit[1:]
    free, want = list(events), {}
    for t, i in truth:
        best, mate = 600.0, None
        for e in free:
            if abs(e[0] - t) <= best:
                best, mate = abs(e[0] - t), e
        if mate:
            free.remove(mate)
            want[i] = (mate[1], mate[0] - t)
    assert got == want and len({e for e, _ in got.values()}) == len(got) > 2000 and most > 300


def test_a_truth_row_looks_at_few_events():
    """It went through all free events of its window; a row of n looks at about log2(n)."""

    class Time(float):
        asked = 0

        def __sub__(self, other):
            Time.asked += 1
            return float(self) - other

        def __rsub__(self, other):
            Time.asked += 1
            return other - float(self)

    m = S.TruthMatcher(600.0)
    m.free = [[Time(i / 10), i] for i in range(6000)]
    assert m.push(True, 300.02, 7, 900.02)[:2] == (7, 3000)
    assert Time.asked < 100
