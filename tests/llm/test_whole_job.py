"""The operators do the whole job: nothing is left out by rank, length or place."""

from pathlib import Path

import duckdb
import pytest
from test_llm import frame, prose

from helioflux.llm import decontaminate, html_extract, line_dedup, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("step", "score"), [(4, 2 * 30 - 9), (5, 2 * 32 - 7)])
def test_decontamination_of_evenly_edited_copies(spark, step, score):
    item = prose(20, 40)
    w = item.split()
    edited = " ".join("changed" + str(i) if i % step == step - 1 else x for i, x in enumerate(w))  # also the last word
    docs = [item, prose(21, 200) + " " + edited + " " + prose(22, 50), prose(24, 500)]
    bench = spark.createDataFrame([(1, item), (4, prose(25, 30))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert got == {(0, 1): 80, (1, 1): score}


def brute_all_lines(texts):
    seen, out = [], {}
    for i, x in enumerate(texts):
        kept = []
        for line in (x or "").split("\n"):
            s = set(line.lower().split())
            if not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[i] = None if x is None else "\n".join(kept)
    return out


def test_line_dedup_of_short_lines(spark):
    texts = ["All rights reserved.\n\none\na b c d", "all  RIGHTS reserved.\nOne\n \na b c d e", "one one one\na b c\nb c\nc b a", "two\na b d\nc", None, "one", "e a b d"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(frame(spark, texts)).collect()}
    assert got == brute_all_lines(texts)
    assert got[1] == " " and got[2] == "a b c\nb c" and got[5] == "" and got[6] == ""


def test_lines_nobody_asked_for_are_not_shuffled(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('a b ', id, '\\nc d ', id) AS text")
    asked = spark.range(0, 20_000, 200).selectExpr("id AS doc_id", "1 AS line_no")
    lines = line_dedup.masked(line_dedup.text_lines(line_dedup.masked(docs, asked.select("doc_id"), 100)), asked, 100)
    got = {(r["doc_id"], r["line_no"]): r["line"] for r in lines.collect()}
    assert all(got[i, 1] == f"c d {i}" for i in range(0, 20_000, 200))  # all that are asked for
    assert len(got) < 1_000  # of 40,000
    plan = docs.sparkSession._jvm.PythonSQLUtils.explainString(line_dedup.masked(docs, asked.select("doc_id"), 100)._jdf.queryExecution(), "simple")
    assert "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" in plan


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data")
def test_line_dedup_equals_sql_over_all_lines(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries._OP2_SQL).fetchall()
    assert sorted(map(tuple, queries.op2_line_dedup(spark, SF).collect()), key=str) == sorted(want, key=str)


def test_html_with_teasers_in_articles():
    card = "<article class=card><h3>Go on</h3><p>A teaser.</p></article>"
    text = "<div class=text><h2>Head</h2><p>Long text, with stops. And more text, yes, of many words.</p><p>Another one, as long. It ends, at last.</p><ul><li>alpha</li></ul><h4>Bob</h4></div>"
    want = "Head Long text, with stops. And more text, yes, of many words. Another one, as long. It ends, at last. alpha Bob"
    assert html_extract.extract(f"<body>{text}{card}{card}</body>") == want
    assert html_extract.extract(f"<body><main>{text}{card}{card}</main></body>") == want
    # Where an article holds the text, its short blocks and those of the main element around it stay.
    whole = f"<body><main><h1>Top</h1><article class=story>{text}<p>End</p></article>{card}{card}</main></body>"
    assert html_extract.extract(whole) == "Top " + want + " End"
