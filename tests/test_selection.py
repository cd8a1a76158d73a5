"""Exact quantiles by selection against sorting, in groups of odd shapes, and what uses them."""

import random

import numpy as np
import pytest

from helioflux.operators import selection as Q
from helioflux.operators import series as S


def groups():
    rng = random.Random(12)
    return {
        "normal": [rng.gauss(0, 1) for _ in range(3000)], "wide": [10 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(1001)], "ties": [float(rng.randrange(3)) for _ in range(2000)], "one": [5.0],
        "equal": [2.5] * 800, "two": [1.0, 4.0], "half": [0.0] * 1000 + [rng.random() for _ in range(1000)], "far": [-1.7e308, 1.7e308] + [rng.random() for _ in range(700)], None: [rng.expovariate(1) for _ in range(900)],
    }


@pytest.mark.parametrize(("q", "limit", "buckets"), [(0.5, 50, 64), (0.333, 1, 4096)])
def test_quantiles_equal_sorting(spark, q, limit, buckets):
    g = groups()
    d = spark.createDataFrame([(k, x) for k, xs in g.items() for x in xs] + [("none", None), ("normal", None)], "stream string, value double").repartition(6)
    got = {r["stream"]: r["m"] for r in Q.quantiles(d, "value", q, ["stream"], most=10**9, limit=limit, buckets=buckets).collect()}
    assert set(got) == {*g, "none"} and got["none"] is None
    for k, xs in g.items():
        s, at = sorted(xs), (len(xs) - 1) * q
        lo, share = int(np.floor(at)), at - np.floor(at)
        want = (1 - share) * s[lo] + share * s[int(np.ceil(at))]
        assert got[k] == pytest.approx(want, rel=1e-12, abs=1e-300)
    one = Q.quantiles(d.where("stream = 'normal'"), "value", q, [], most=10**9, limit=limit, buckets=buckets).first()["m"]
    assert one == got["normal"]
    plan = {r["stream"]: r["m"] for r in Q.quantiles(d, "value", q, ["stream"]).collect()}
    assert plan["ties"] == got["ties"] and plan["none"] is None


def test_values_that_are_not_finite(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", float("inf"))], "stream string, value double")
    with pytest.raises(Exception, match="not finite"):
        Q.quantiles(d, "value", most=10**9, limit=1).collect()


def test_despike_is_the_same_by_selection(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "ab"[i % 2], float(i), rng.gauss(10, 1) * (30 if rng.random() < 0.02 else 1)) for i in range(1500)]
    d = spark.createDataFrame(rows, "event_id long, stream string, t double, value double")
    want = sorted(map(tuple, S.despike(d).select("event_id", "spike", "clean").collect()))
    for m in (Q, S):
        monkeypatch.setattr(m, "SORTED", 100)
    monkeypatch.setattr(S, "quantiles", lambda *a, **k: Q.quantiles(*a, **k, limit=100, buckets=32))
    got = sorted(map(tuple, S.despike(d).select("event_id", "spike", "clean").collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(g[2] == pytest.approx(w[2]) for g, w in zip(got, want, strict=True))
    assert sum(w[1] for w in want) > 10


def test_keys_named_like_inner_columns(spark):
    rows = [(0, "a", 1.0), (0, "a", 3.0), (0, None, 7.0), (1, "a", 4.0)]
    d = spark.createDataFrame(rows, "_g int, _v string, value double")
    got = {(r["_g"], r["_v"]): r["m"] for r in Q.quantiles(d, "value", 0.5, ["_g", "_v"], most=10**9, limit=1).collect()}
    assert got == {(0, "a"): 2.0, (0, None): 7.0, (1, "a"): 4.0}


def test_robust_fit_of_large_groups(spark, monkeypatch):
    from helioflux.operators.fusion import fit_transfer

    rng = random.Random(3)
    rows = [(g, 10 ** (i / 50), 10 ** (0.3 + 1.2 * i / 50 + rng.gauss(0, 0.05) + (2.0 if i % 17 == 0 else 0.0))) for g in "ab" for i in range(100)]
    d = spark.createDataFrame(rows, "g string, x double, y double")
    sorting = {r["g"]: r.asDict() for r in fit_transfer(d, "x", "y", ["g"], rounds=3).collect()}
    monkeypatch.setattr(Q.quantiles, "__defaults__", tuple(20 if v == Q.SORTED else v for v in Q.quantiles.__defaults__))
    selecting = {r["g"]: r.asDict() for r in fit_transfer(d, "x", "y", ["g"], rounds=3).collect()}
    assert set(selecting) == {"a", "b"}
    for g, want in sorting.items():
        assert selecting[g]["n"] == want["n"]
        for c in ("a", "b", "resid", "rms_log", "r2"):
            assert selecting[g][c] == pytest.approx(want[c], rel=1e-9)


def sorted_median(xs):
    s = sorted(xs)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


@pytest.mark.parametrize("limit", [1, 300, 10**6])
def test_median_and_mad_equal_sorting(spark, limit):
    """In two passes, by selection where bounds hold more than ``limit`` rows, and by sorting; a row counts as often as its weight says."""
    rng = random.Random(4)
    g = {k: [(x, 1 + rng.randrange(4)) for x in xs] for k, xs in groups().items() if k not in (None, "far")}
    d = spark.createDataFrame([(k, x, c) for k, xs in g.items() for x, c in xs] + [("normal", None, 5), ("none", None, 1)], "stream string, value double, c long").repartition(6)
    got = {r["stream"]: (r["m"], r["mad"]) for r in Q.median_and_mad(d, "value", ["stream"], 10**9 if limit < 10**6 else 10, "c", limit=limit).collect()}
    assert set(got) == set(g)
    for k, xs in g.items():
        full = [x for x, c in xs for _ in range(c)]
        m = sorted_median(full)
        assert got[k][0] == pytest.approx(m, rel=1e-12, abs=1e-300)
        assert got[k][1] == pytest.approx(sorted_median([abs(x - m) for x in full]), rel=1e-9, abs=1e-300)


def test_quantiles_with_weights(spark):
    rng = random.Random(6)
    rows = [("a", float(rng.randrange(400)), 1 + rng.randrange(5)) for _ in range(900)]
    d = spark.createDataFrame(rows, "stream string, value double, c long")
    full = sorted(x for _, x, c in rows for _ in range(c))
    for limit in (1, 200, 10**6):
        m = Q.quantiles(d, "value", 0.5, ["stream"], most=900, limit=limit, buckets=16, weight="c").first()["m"]
        assert m == sorted_median(full)


@pytest.mark.parametrize("copies", [1, 40])
def test_robust_fit_takes_few_passes(spark, copies):
    """Large groups: every reweighting took two selections of several rounds each; equal points were read one by one."""
    from helioflux.operators import fusion as U

    rng = random.Random(9)
    rows = [("ab"[i % 2], 10 ** (i / 400), 10 ** (0.3 + 1.2 * i / 400 + rng.gauss(0, 0.05) + (2.0 if i % 17 == 0 else 0.0))) for i in range(800)]
    d = spark.createDataFrame(rows, "g string, x double, y double")
    want = {r["g"]: r.asDict() for r in U.fit_transfer(d, "x", "y", ["g"], rounds=3).collect()}
    many = d.withColumn("k", U.F.explode(U.F.sequence(U.F.lit(1), U.F.lit(copies)))).drop("k")
    points = U.F.count("*")
    kept, most = U._points(many.selectExpr("g", "log10(x) lx", "log10(y) ly", "1L c"), ["g"])
    assert (kept.count(), most) == (800, 400) and kept.agg(U.F.sum("c"), points).first()[0] == 800 * copies
    tracker = spark.sparkContext.statusTracker()
    with pytest.MonkeyPatch.context() as mp:
        mp.setattr(Q.median_and_mad, "__defaults__", (200,))
        spark.sparkContext.setJobGroup(f"fit{copies}", "fit")
        got = {r["g"]: r.asDict() for r in U.fit_transfer(many, "x", "y", ["g"], rounds=3).collect()}
    spark.sparkContext.setJobGroup("", "")
    assert len(tracker.getJobIdsForGroup(f"fit{copies}")) < 120
    for g, w in want.items():
        assert got[g]["n"] == copies * w["n"]
        for c in ("a", "b", "resid", "rms_log", "r2"):
            assert got[g][c] == pytest.approx(w[c], rel=1e-9)
