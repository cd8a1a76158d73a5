"""Decontamination against exhaustive alignment: every item with every text, whole, by the plain recurrence."""

import random

import pytest
from test_llm import frame, prose

from helioflux.llm import decontaminate


def best_score(item, text):
    x, y = item.split(), text.split()
    best, prev = 0, [0] * (len(y) + 1)
    for a in x:
        row = [0]
        for j, b in enumerate(y, 1):
            row.append(max(0, prev[j - 1] + (2 if a == b else -1), prev[j] - 1, row[-1] - 1))
        best, prev = max(best, *row), row
    return best


def edited(rng, text, how, rate):
    out = []
    for w in text.split():
        if rng.random() >= rate:
            out.append(w)
        elif how == "change":
            out.append("zz" + w)
        elif how == "insert":
            out += [w, "yy" + w]
    return " ".join(out)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(31)
    items = [prose(300 + i, 12 + 6 * i) for i in range(8)] + ["qqk", "qqk rrm", ""]
    texts = []
    for i, item in enumerate(items[:8]):
        for how in ("change", "insert", "drop"):
            for rate in (0.0, 0.1, 0.2, 0.3, 0.4):
                texts.append(prose(400 + i, 60) + " " + edited(rng, item, how, rate) + " " + prose(500 + i, 40))
    texts += [prose(600, 300), "a qqk rrm b", "rrm qqk", None, "", texts[0], items[3] + " " + items[3]]
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            s = best_score(x, t or "") if x else 0
            if x and 100 * s >= 50 * 2 * len(x.split()):
                want[d, i] = s
    return items, texts, want


def rows(spark, items, texts, **how):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(frame(spark, texts), bench, **how).collect()}


def test_one_word_seeds_equal_exhaustive_alignment(spark, case):
    items, texts, want = case
    assert rows(spark, items, texts, seed_words=1) == want


def test_recall_of_three_word_seeds(spark, case):
    items, texts, want = case
    got = rows(spark, items, texts)
    recall = len(got) / len(want)
    print(f"recall {recall:.4f} of {len(want)}")
    assert got.items() <= want.items() and recall >= 0.95
    # Whatever is missed keeps no three words of the item in a row.
    for d, i in want.keys() - got.keys():
        w, grams = texts[d].split(), set(zip(*(items[i].split()[k:] for k in range(3)), strict=False))
        assert not grams & set(zip(*(w[k:] for k in range(3)), strict=False))


def test_names_and_empty_tables(spark, case):
    items, texts, _ = case
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    with pytest.raises(ValueError, match="score"):
        decontaminate.contaminated(frame(spark, texts).withColumnRenamed("doc_id", "score"), bench, key="score")
    assert decontaminate.contaminated(frame(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, texts), bench.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(frame(spark, texts), bench.limit(0))
    assert kept.count() == len(texts)
