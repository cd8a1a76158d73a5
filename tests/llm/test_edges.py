"""What earlier tests leave out: empty tables, repeated rows and keys, extra columns and clashing names of operators 1, 4, 6, 9 and 10, and of the pipeline."""

import pytest
from test_llm import brute_components, brute_repeats, frame, prose

from helioflux.llm import chat, ngram_join, rindex_dedup, sentencepiece_scan, token_counts


def test_near_duplicates_of_repeated_keys_and_empty_tables(spark):
    texts = [prose(1, 60), prose(1, 60), prose(2, 60)]
    d = spark.createDataFrame([(5, texts[0], 1, 2), (5, texts[1], 3, 4), (9, texts[2], 0, 0)], "doc_id long, text string, n_shingles int, component_id int")
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(d.select("doc_id", "text"), words=4, threshold=85).collect()}
    assert got == {(5, 5), (9, 9)}
    assert ngram_join.near_duplicates(d.limit(0), words=4, threshold=85).collect() == []
    assert {i: c for i, (_, c) in brute_components(texts, 4, 85).items()} == {0: 0, 1: 0, 2: 2}


def test_repeats_in_empty_tables_repeated_rows_and_long_texts(spark):
    assert rindex_dedup.remove_repeats(frame(spark, [])).collect() == []
    passage = prose(3, 80)
    long = prose(4, 700_000 // 3) + passage + prose(5, 700_000 // 3)
    assert len(long) > 1_000_000
    texts = [long, "begin " + passage + " end", prose(6, 40)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(2, texts[2], "x", 1)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, spans long").select("doc_id", "text")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in rindex_dedup.remove_repeats(d).collect())
    n = len(passage.encode())
    assert [g for g in got if g[0] == 2] == [(2, len(texts[2]), len(texts[2]) if len(texts[2]) >= 200 else 0)] * 3  # repeated rows repeat one another
    one = [g for g in got if g[0] == 1]
    assert len(one) == 1 and n - 8 <= one[0][2] <= n + 8
    small = [passage + " a", "b " + passage]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rindex_dedup.remove_repeats(frame(spark, small)).collect()}
    assert got == brute_repeats(small, 200)


def test_chat_of_long_texts_and_repeated_turns(spark):
    rows = [(1, 1, "ann", "hello " * 50_000), (1, 2, "bob", "x"), (1, 2, "bob", "x"), (2, 1, None, None)]
    got = chat.rotations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    mine = [r for r in got if r["conv_id"] == 1 and r["perspective"] == "ann"]
    assert len(mine) == 3 and max(r["end"] for r in mine) > 300_000
    assert {r["perspective"] for r in got if r["conv_id"] == 2} == {"unknown"}
    assert chat.rotations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).collect() == []


def test_pieces_of_repeated_keys_and_a_clashing_key(spark):
    d = spark.createDataFrame([(1, "one two", 0), (1, "one two", 0), (None, "x", 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, ids int")
    got = [(r["doc_id"], len(r["ids"])) for r in sentencepiece_scan.encode(d).collect()]
    assert len(got) == 5 and got.count(got[got.index((1, next(n for k, n in got if k == 1)))]) == 2 and (2, 0) in got and (3, 0) in got
    with pytest.raises(ValueError, match="ids"):
        sentencepiece_scan.encode(d, key="ids")
    assert sentencepiece_scan.encode(d.limit(0)).collect() == []


def test_token_counts_of_repeats_and_a_clashing_key(spark):
    d = spark.createDataFrame([(1, "one two", 0), (1, "one two", 0), (2, None, 0)], "doc_id long, text string, n_tokens int")
    got = sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.with_length(d).collect())
    assert got[0] == got[1] and got[2] == (2, 0)
    with pytest.raises(ValueError, match="n_tokens"):
        token_counts.with_length(d, key="n_tokens")


def test_pipeline_of_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    good = " ".join(f"{w} the" if i % 4 == 0 else w for i, w in enumerate(prose(8, 80).split()))
    for name, rows, items in (("empty", [], [(1, prose(9, 30))]), ("no items", [(1, good, "en", "s", len(good)), (1, good, "en", "s", len(good)), (2, None, None, None, None)], [])):
        folder = tmp_path / name.replace(" ", "_")
        spark.createDataFrame(rows, docs).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = pipeline.run(spark, str(folder)).collect()
        assert {r["doc_id"] for r in got} == ({1} if rows else set())


def test_words_spelt_from_the_longest_piece_on_take_the_path_of_the_walk():
    import random

    from helioflux.llm import piece_lattice, sentencepiece_scan

    _, lattice = piece_lattice.load(sentencepiece_scan.VOCABULARY)
    rng = random.Random(9)
    for letters in ("abnaeht", "abcdefghijklmnopqrstuvwxyz▁", "aé☃\U0001f600日本 ▁"):
        for _ in range(400):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
            assert lattice.word(word) == lattice._trace(word, 0, None, len(word))


def test_words_that_differ_in_marks_share_their_pieces():
    from helioflux.llm import piece_lattice, sentencepiece_scan

    m = sentencepiece_scan.Pieces(sentencepiece_scan.VOCABULARY)
    lattice = piece_lattice.Lattice(m.table, m.spell_char)
    texts = ["seldomly, seldomly; (seldomly) seldomly!", "x² ². snake_case a_b __init__ 1a2b3 don't l'été.\nNext", "日本語、テキスト。ok…", "\u2581,a \u2581\u2581.b ٣.١٤ क्षि!"]
    for text in texts:
        for size in (1, 5, 4096):
            assert sentencepiece_scan.encode_chunked(m, text, size, lattice) == m.sp.encode(text)
    assert "\u2581seldomly" in lattice.memo and "\u2581seldomly;" not in lattice.memo
    pair = {p[i : i + 2] for p in m.table for i in range(len(p) - 1)}
    cuts = [a[-1] + b[0] for t in texts for parts in [lattice.parts_of(m.sp.normalize(t))] for a, b in zip(parts, parts[1:], strict=False)]
    assert not any(c in pair for c in cuts if not c.endswith("\u2581"))
