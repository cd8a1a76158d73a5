"""Centroid clustering, source mixing and fill-in-the-middle against brute force, with nulls, ties, repeats, long texts and clashing names."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from helioflux.llm import centroids, fill_middle, mixing

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


# --- 11 ----------------------------------------------------------------------------------------------------------------------
def brute_clusters(rows, k, rounds, dims, scale=1024, seed=3):
    v = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    c = [x for _, x in sorted(((sha(f"{seed}:{'' if i is None else i}"), x) for i, x in v))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, x in v:
            of[near(x)[1]].append(x)
        c = [[sum(col) // len(of[j]) for col in zip(*of[j], strict=True)] if of[j] else y for j, y in enumerate(c)]
    got = [(i, *near(x)[::-1]) for i, x in v]
    per = collections.Counter()
    for _, j, d in got:
        per[j] += d
    return sorted(((i is None, i or 0), j, d, per[j], sum(per.values()), sha(",".join(map(str, c[j])))) for i, j, d in got)


def clusters_of(d, key="vec_id"):
    return sorted(((r[key] is None, r[key] or 0), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in d.collect())


def test_clusters(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(3 * (i % 3), 0.7) for _ in range(4)]) for i in range(150)]
    rows += [(7, rows[7][1])] * 60 + [(None, [0.0] * 4), (900, None), (901, [1.0] * 3), (902, [1.0, None, 2.0, 3.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, []), (906, [-0.0001] * 4)]
    df = spark.createDataFrame([(i, e, i or 0, 1.0) for i, e in rows], "vec_id long, embedding array<double>, cluster int, distance double")
    for k in (1, 5):
        assert clusters_of(centroids.cluster_vectors(df, k, 4, dims=4)) == brute_clusters(rows, k, 4, 4)


def test_clusters_of_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    same = [(i, [0.5, 0.25]) for i in range(6)]
    assert clusters_of(centroids.cluster_vectors(spark.createDataFrame(same, schema), 3, 2, dims=2)) == brute_clusters(same, 3, 2, 2)  # ties go to the smaller number
    assert centroids.cluster_vectors(spark.createDataFrame(same[:2], schema), 8, 2, dims=2).count() == 2
    assert centroids.cluster_vectors(spark.createDataFrame([], schema), 8, 2, dims=2).count() == 0
    with pytest.raises(ValueError, match="cluster"):
        centroids.cluster_vectors(spark.createDataFrame([], "cluster int, embedding array<float>"), key="cluster")
    with pytest.raises(Exception, match="out of range in the vector of key 5"):
        centroids.cluster_vectors(spark.createDataFrame([(5, [1e9, 0.0])], schema), 1, 1, dims=2).collect()


def test_annulus_is_exact():
    rng = np.random.default_rng(1)
    for n, k, d, reach in ((500, 40, 3, 6), (300, 7, 16, 1000), (200, 12, 2, 2)):  # small reaches make ties and equal norms
        x, c = rng.integers(-reach, reach + 1, (n, d)), rng.integers(-reach, reach + 1, (k, d))
        to, dist = centroids.nearest(x, c)
        all_ = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (to == all_.argmin(axis=1)).all() and (dist == all_.min(axis=1)).all()


# --- 12 ----------------------------------------------------------------------------------------------------------------------
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, mix int, rank string"


def brute_targets(sizes, weights, percent, repeats):
    """Sharing in rounds: what is above the limit goes back and is shared again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, live, left = dict.fromkeys(names, 0.0), set(names), sum(sizes.values()) * percent / 100
    while left > 1e-9 and live:
        share = left / sum(w[s] for s in live)
        for s in live:
            got[s] += share * w[s]
        left = 0.0
        for s in list(live):
            if got[s] > repeats * sizes[s]:
                left += got[s] - repeats * sizes[s]
                got[s] = repeats * sizes[s]
                live.remove(s)
    return got


@pytest.mark.parametrize(("weights", "percent", "repeats"), [((3, 1, 2), 150, 2), ((1,), 100, 1), ((5, 1), 40, 3), ((3, 1, 2), 200, 2)])
def test_mix(spark, weights, percent, repeats):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([1, 9, 40, 300]))), rng.choice(["a", "a", "a", "b", "É", "z", None]), i, "x") for i in range(300)]
    rows += [(300, "long " * 30000, "b", 0, "x"), (301, None, "a", 0, "x"), (302, " \n\t", "only blank", 0, "x"), (303, "", None, 0, "x"), *[(304, "same words here", "z", 0, "x")] * 40, (None, "no key", "a", 0, "x"), (None, "no key", "a", 0, "x"), (305, "tiny", "tiny", 0, "x")]
    out = mixing.fair_mix(spark.createDataFrame(rows, DOCS), weights, percent, repeats)
    assert out.columns == ["doc_id", "text", "source", "rank", "mix"]
    got = out.collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter((i, t) for i, t, *_ in rows)
    size, taken = collections.Counter(), collections.Counter()
    for r in got:
        m = r["mix"]
        assert m["size"] == len(WORD.findall(r["text"] or "")) and 0 <= m["taken"] <= repeats * m["size"]
        size[r["source"]] += m["size"]
        taken[r["source"]] += m["taken"]
    want = brute_targets(size, weights, percent, repeats)
    for r in got:
        assert r["mix"]["source_size"] == size[r["source"]] and math.isclose(r["mix"]["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
    budget = sum(size.values()) * percent // 100
    assert budget - 40 <= sum(taken.values()) <= budget  # equal rows share to the word
    assert all(abs(taken[s] - want[s]) <= mixing.PACKET * (len(size) + 1) for s in size)
    again = mixing.fair_mix(spark.createDataFrame(rows[::-1], DOCS).repartition(7), weights, percent, repeats).collect()
    key = lambda r: (r["doc_id"] or -1, r["text"] or "", r["mix"]["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_order_is_by_finish_time(spark):
    """The documents that are taken are those that finish first, to the packet."""
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2], 0, "") for i in range(60)]
    got = {r["doc_id"]: r["mix"] for r in mixing.fair_mix(spark.createDataFrame(rows, DOCS), (2, 1), 70, 1, packet=1).collect()}
    queue = []
    for s in "ab":
        upto = 0
        for i in sorted((i for i, _, x, *_ in rows if x == s), key=lambda i: sha(f"12:{i}")):
            for _ in range(1 + i % 7):
                upto += 1
                queue.append((upto / got[i]["target"], s, upto, i))
    budget = sum(1 + i % 7 for i in range(60)) * 70 // 100
    taken = collections.Counter(i for *_, i in sorted(queue)[:budget])
    assert {i: m["taken"] for i, m in got.items()} == {i: taken[i] for i in got}


def test_copies_and_empty_tables(spark):
    rows = [(i, f"a b\nc {i}", "s", 0, "") for i in range(10)] + [(10, "x y z", "t", 0, "")]
    m = mixing.fair_mix(spark.createDataFrame(rows, DOCS), (1,), 130, 2, packet=1)
    c = mixing.mixed_copies(m).collect()
    assert sum(r["n_words"] for r in c) == sum(r["mix"]["taken"] for r in m.collect()) == 43 * 130 // 100
    assert all(len(WORD.findall(r["text"])) == r["n_words"] for r in c)
    assert mixing.fair_mix(spark.createDataFrame([], DOCS)).collect() == []
    nothing = mixing.fair_mix(spark.createDataFrame([(1, None, "a", 0, ""), (2, " ", None, 0, "")], DOCS)).collect()
    assert [(r["mix"]["size"], r["mix"]["source_size"], r["mix"]["target"], r["mix"]["taken"]) for r in nothing] == [(0, 0, 0.0, 0)] * 2
    with pytest.raises(ValueError, match="weights"):
        mixing.fair_mix(m, (0,))


# --- 13 ----------------------------------------------------------------------------------------------------------------------
UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "chars": r"(?s)."}


def brute_fim(key, text, unit, rate, spm):
    t = text or ""
    u = re.findall(UNITS[unit], t)
    h = [int(sha(f"7:{'' if key is None else key}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in fill_middle.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def fim_texts():
    rng = random.Random(3)
    out = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "no break é", "has <S> mark\nx", "<", "ends in <\n<P", "x" * 5000, "é\n" * 3000, "🙂 ☃\n\n" * 40, "line\r\nline\r\n"]
    out += ["".join(rng.choice("ab é☃\n\n \t") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    return out


@pytest.mark.parametrize(("unit", "chunk", "spread", "rate"), [("lines", 65536, 8_000_000, 100), ("lines", 7, 8_000_000, 100), ("words", 5, 8_000_000, 60), ("chars", 3, 8_000_000, 100), ("lines", 50, 100, 100), ("words", 16, 0, 100), ("chars", 64, 30, 100)])
def test_fim(spark, unit, chunk, spread, rate):
    texts = fim_texts()
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "a\nb\nc", "x", 0), (3, texts[20], "y", 0), (3, texts[20], "y", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fim string, n long")
    d = fill_middle.fill_middle(df, unit=unit, chunk=chunk, spread=spread, rate=rate)
    assert d.columns == ["doc_id", "text", "n", "fim"]
    got = [(r["doc_id"], r["text"], tuple(r["fim"]), r["back"]) for r in d.withColumn("back", fill_middle.restored(d["fim.output"], d["fim.form"])).collect()]
    assert len(got) == len(rows)
    for key, text, fim, back in got:
        assert fim == brute_fim(key, text, unit, rate, 50) and back == (text or "")


def test_fim_empty_table(spark):
    assert fill_middle.fill_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="unit"):
        fill_middle.fill_middle(spark.createDataFrame([], "doc_id long, text string"), unit="pages")
