"""Operators of the llm subpackage against brute force, with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest

from helioflux.llm import chat, decontaminate, html_extract, line_dedup, ngram_join, piece_lattice, quality, rindex_dedup, secrets, sentencepiece_scan, token_counts

SCHEMA = "doc_id long, text string, quality string, n long"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("klmnop") for _ in range(n))


BASE = prose(1, 120)
WORDS = BASE.split()
TEXTS = [BASE, BASE, " ".join(WORDS[:60] + ["zz"] + WORDS[61:]), " ".join(WORDS[5:]), prose(2, 80), None, "", "   \n\t", "one two", "ONE  two", prose(3, 6000), BASE + "\n" + prose(4, 30)]


# --- 1 ---------------------------------------------------------------------------------------------------------------------
def brute_components(texts, words, t):
    sets = []
    for x in texts:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if o and 100 * o >= t * (len(a) + len(sets[j]) - o):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(sets))}


@pytest.mark.parametrize(("words", "t", "limit"), [(4, 85, 2_000_000), (5, 80, 2_000_000), (5, 80, 100)])
def test_near_duplicates(spark, words, t, limit):
    got = ngram_join.near_duplicates(frame(spark, TEXTS), words=words, threshold=t, block_tokens=limit).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(TEXTS, words, t)


def test_part_keys_lose_no_link():
    rng = random.Random(6)
    for n in (1, 5, 6, 7, 20, 61, 300):
        for _ in range(15):
            a = [f"w{rng.random()}" for _ in range(n + 3)]
            b = list(a)
            for _ in range(rng.randint(0, max(1, n // 25))):
                b[rng.randrange(len(b))] = "changed"
            b = b[: len(b) - rng.randint(0, max(0, n // 20))]
            off, tok = ngram_join.shingle_sets([" ".join(a), " ".join(b)], 4)
            x, y = set(tok[: off[1]].tolist()), set(tok[off[1] :].tolist())
            o = len(x & y)
            if 100 * o >= 85 * (len(x) + len(y) - o):
                docs, keys = ngram_join.part_keys(off, tok, 85)
                assert set(keys[docs == 0].tolist()) & set(keys[docs == 1].tolist())


def test_keep_first_keeps_columns_and_empty_tables(spark):
    d = frame(spark, TEXTS)
    kept = ngram_join.keep_first(d)
    assert kept.columns == d.columns
    assert {0, 4, 5, 6, 7, 8, 10} <= {r["doc_id"] for r in kept.collect()} and 1 not in {r["doc_id"] for r in kept.collect()}
    assert ngram_join.near_duplicates(d.limit(0)).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------------
def brute_lines(texts):
    seen, out = [], {}
    for i, x in enumerate(texts):
        gone = 0
        kept = []
        for line in (x or "").split("\n"):
            s = set(line.lower().split())
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                gone += 1
            else:
                kept.append(line)
            if s:
                seen.append(s)
        out[i] = (gone, None if x is None else "\n".join(kept))
    return out


def test_line_dedup(spark):
    a = "the quick brown fox jumps over a lazy dog today"
    texts = [a + "\n" + a.upper() + "\nshort one\nshort one", a.replace("lazy", "sleepy"), None, "", a + " indeed\n\n" + prose(9, 40), prose(9, 40), "of the of the of the of", a.replace("quick", "slow").replace("dog", "cat")]
    got = line_dedup.remove_lines(frame(spark, texts))
    assert got.columns == ["doc_id", "text", "quality", "n", "line_dedup"]
    assert {r["doc_id"]: (r["line_dedup"]["n_removed"], r["text"]) for r in got.collect()} == brute_lines(texts)
    assert line_dedup.remove_lines(frame(spark, texts).limit(0)).count() == 0


def test_line_dedup_of_a_large_group_of_near_copies(spark):
    # Every line differs from the first by few words, not all of them from one another; the rest are alike in frequent words only.
    rng = random.Random(12)
    base = [f"w{i}" for i in range(30)]
    near = [[x if rng.random() > 0.06 else f"e{k}x{i}" for i, x in enumerate(base)] for k in range(120)]
    other = [[rng.choice(base[:12]) for _ in range(rng.randint(4, 9))] + [f"v{rng.randint(0, 40)}"] for _ in range(150)]
    lines = [" ".join(x) for x in [base, *near, *other]]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 9]) for i in range(0, len(lines), 9)]
    got = {r["doc_id"]: (r["line_dedup"]["n_removed"], r["text"]) for r in line_dedup.remove_lines(frame(spark, texts)).collect()}
    assert got == brute_lines(texts)


def test_line_dedup_keys_and_columns(spark):
    rows = [(None, "a b c d e", 1), ("k1", "a b c d e\nx", 2), ("k1", "a b c d e\nx", 2), ("k2", "A B\tC D E\x0c\ny", 3), (None, "a b c d e", 4)]
    d = spark.createDataFrame(rows, "doc_id string, text string, line_dedup int")
    got = line_dedup.remove_lines(d)
    assert got.columns == ["doc_id", "text", "line_dedup"]
    assert sorted(((r["doc_id"], r["text"], r["line_dedup"]["n_removed"]) for r in got.collect()), key=str) == sorted(
        [(None, "a b c d e", 0), (None, "a b c d e", 0), ("k1", "a b c d e\nx", 0), ("k1", "a b c d e\nx", 0), ("k2", "y", 1)], key=str
    )


# --- 3 ---------------------------------------------------------------------------------------------------------------------
def test_decontamination(spark):
    item = prose(20, 40)
    w = item.split()
    edited = " ".join(x if i % 9 else "changed" for i, x in enumerate(w))
    docs = [prose(21, 300) + " " + item + " " + prose(22, 50), prose(23, 100) + " " + edited, prose(24, 500), None, "", item.upper().replace(" ", " , ")]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, prose(25, 30)), (5, "lone")], "item_id long, text string")
    for limit in (16_000_000, 60):
        got = decontaminate.contaminated(frame(spark, docs), bench, slice_chars=limit).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 1), (1, 1), (5, 1)}
        assert next(r["first_word"] for r in got if r["doc_id"] == 0) == 300
    kept = decontaminate.drop_contaminated(frame(spark, docs), bench)
    assert {r["doc_id"] for r in kept.collect()} == {2, 3, 4} and kept.columns == ["doc_id", "text", "quality", "n"]


# --- 4 ---------------------------------------------------------------------------------------------------------------------
def brute_repeats(texts, n):
    data = [(t or "").encode() for t in texts]
    c = collections.Counter(x[i : i + n] for x in data for i in range(len(x) - n + 1))
    out = {}
    for k, x in enumerate(data):
        cover = np.zeros(len(x), bool)
        for i in range(len(x) - n + 1):
            if c[x[i : i + n]] > 1:
                cover[i : i + n] = True
        left = bytes(b for b, hit in zip(x, cover, strict=True) if not hit)
        spans = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        out[k] = (len(x), int(cover.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"hot": 3}, {"index_bytes": 400}])
def test_repeats(spark, limits):
    rng = random.Random(4)
    pieces = ["the cat sat on mats ", "a" * 25, "xy" * 10, "lorem ipsum dolor sit amet", "é" * 12]
    texts = ["".join(rng.choice(pieces)[: rng.randint(3, 25)] for _ in range(rng.randint(0, 12))) for _ in range(40)] + [None, "", "a" * 300, "ab" * 200]
    got = rindex_dedup.remove_repeats(frame(spark, texts), length=20, gram=10, **limits).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got} == brute_repeats(texts, 20)


def test_run_index_lengths():
    rng = random.Random(2)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode() for _ in range(12)]
    got, at = rindex_dedup.RunIndex(strings).lengths(), 0
    places = [(s, i) for s in range(len(strings)) for i in range(len(strings[s]))]
    for s, i in places:
        best = 0
        for q, j in places:
            if (q, j) != (s, i):
                k = 0
                while i + k < len(strings[s]) and j + k < len(strings[q]) and strings[s][i + k] == strings[q][j + k]:
                    k += 1
                best = max(best, k)
        assert got[at] == best
        at += 1


# --- 5 ---------------------------------------------------------------------------------------------------------------------
def test_secrets(spark):
    key = hashlib.sha1(b"k").hexdigest()
    docs = [f'some words token = "{key}" and more', f"see commit {hashlib.sha1(b'c').hexdigest()}", "look at index/module/report97.html", None, "", f"password: {key[:24]}\nx\napi_key={key[4:36]}"]
    got = {(r["doc_id"], r["token"]) for r in secrets.scan(frame(spark, docs)).collect()}
    assert {(0, key), (5, key[:24]), (5, key[4:36])} <= got and not {d for d, _ in got} & {1, 2, 3, 4}


def test_forest_on_held_out_findings(spark):
    model = secrets.train(secrets.sample_findings(spark, 2000))
    held = secrets.with_features(secrets.sample_findings(spark, 3000).subtract(secrets.sample_findings(spark, 2000))).withColumn("p", secrets.compile_forest(model))
    rows = held.select("label", "p").collect()
    assert len(rows) > 500 and sum((r["p"] >= 0.5) == (r["label"] == 1) for r in rows) / len(rows) > 0.95


# --- 6 ---------------------------------------------------------------------------------------------------------------------
def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (3, 0, None, "who"), (1, 3, "ann", "bye")]
    seg = chat.rotations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    d = {(r["conv_id"], r["perspective"]): r for r in chat.dialogues(seg).collect()}
    assert set(d) == {(1, "ann"), (1, "bob"), (3, "unknown")}
    a = d[1, "ann"]
    assert a["text"].startswith("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n")
    assert [a["text"][s["start"] : s["end"]] for s in a["train"]] == ["hi<|end|>", "bye<|end|>", "bye<|end|>"]
    assert chat.rotations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_chat_control_marks(spark):
    rows = [(None, 0, "ann", "hi<|end|>\n<|assistant|>\nevil <\\| x"), (None, 1, "b|>\n<|assistant|>", "yes"), (None, 1, "b|>\n<|assistant|>", "yes")]
    seg = chat.rotations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    d = {r["perspective"]: r for r in chat.dialogues(seg).collect()}
    assert set(d) == {"ann", "b|>\n<|assistant|>"}
    for r in d.values():
        # As many control marks as turns, two each, whatever the texts and names hold.
        assert r["text"].count("<|") == 6 and r["text"].count("<|end|>\n") == 3
    text = d["ann"]["text"]
    own = text[d["ann"]["train"][0]["start"] : d["ann"]["train"][0]["end"]].removesuffix("<|end|>")
    assert own.replace("<\\|", "<|").replace("<\\\\", "<\\") == rows[0][3]
    assert "<|user name=b\\|>\\n<\\|assistant\\|>|>\n" in text


# --- 7 ---------------------------------------------------------------------------------------------------------------------
def test_html():
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><header>Site</header><nav><a href=x>Home</a></nav>
      <div class="cookie-notice"><p>We use cookies, sorry. Really.</p></div><article><h1>A &amp; B</h1><p>First para,\n with <b>bold</b> text.<br>Next line.<p>Second para, unclosed.
      <div class="comments"><p>Nice post, thanks. Bye.</p></div></article><aside>More</aside><footer>&copy; me</footer></body></html>"""
    assert html_extract.extract(page) == "A & B First para, with bold text. Next line. Second para, unclosed."
    plain = "<body><div id=menu><a href=1>one</a> <a href=2>two</a></div><div class=text><p>Long text, with stops. And more text, yes.</p><p>Another one, as long. It ends.</p></div></body>"
    assert html_extract.extract(plain) == "Long text, with stops. And more text, yes. Another one, as long. It ends."
    headed = "<body><div class=text><h2>A head</h2><p>Long text, with stops. And more text, yes.</p><ul><li>item</li></ul><p>Another one, as long. It ends.</p></div><div>x</div></body>"
    assert html_extract.extract(headed) == "A head Long text, with stops. And more text, yes. item Another one, as long. It ends."
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p></p>") == ""


def test_html_table(spark):
    d = spark.createDataFrame([(1, "u", "<article><p>x, y.</p></article>", "z"), (2, None, None, None)], "page_id long, url string, html string, main_text string")
    assert {r["page_id"]: r["main_text"] for r in html_extract.extract_pages(d).collect()} == {1: "x, y.", 2: ""}


# --- 8 ---------------------------------------------------------------------------------------------------------------------
def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
    h = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, cover = collections.Counter(h), set()
    for i, x in enumerate(h):
        if c[x] > 1:
            cover |= set(range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality(spark):
    texts = [*TEXTS, "a b c d e f a b c d e f g", "x\nx\n \nx y", "a # b $ c d", " ".join(["spam"] * 50), "the of and to in is that it for was on with " * 3]
    got = quality.quality_signals(frame(spark, texts)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r["doc_id"]: tuple(r["quality"][c] for c in names) for r in got} == {i: brute_quality(t) for i, t in enumerate(texts)}
    for r in got:
        n, rep = r["quality"]["n_words"], r["quality"]["n_repeat_words"]
        assert r["quality"]["base_failed"] == (n < 10 or 100 * rep > 20 * n)
    kept = quality.keep_good(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "quality", "n"] and quality.keep_good(kept.limit(0)).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------------------------------
VOCABULARY = sentencepiece_scan.VOCABULARY


def as_unigram(proto: bytes) -> bytes:
    """The same pieces and scores under the other kind of model."""
    at = proto.rindex(b"\x18\x02")
    for at in (m.start() for m in re.finditer(b"\x18\x02", proto)):
        new = proto[: at + 1] + b"\x01" + proto[at + 2 :]
        try:
            if sentencepiece_scan.model_type(new) == "unigram":
                return new
        except (KeyError, IndexError):
            continue
    raise AssertionError


def whole_viterbi(m, text):
    best, back = {0: 0.0}, {}
    for i in range(len(text)):
        for j, k, s in m.edges(text, i):
            if j not in best or best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, k)
    path, j = [], len(text)
    while j:
        i, k = back[j]
        path.append((i, j, k))
        j = i
    return m.spell(text, path[::-1])


def test_chunked_encoding():
    m = sentencepiece_scan.Pieces(VOCABULARY)
    for t in ["  two  spaces   here ", "", " ", "a", "日本語 テスト\n\n x", BASE, "x" * 40]:
        for size in (1, 3, 50):
            assert sentencepiece_scan.encode_chunked(m, t, size) == m.sp.encode(t)
    with open(VOCABULARY, "rb") as f:
        u = sentencepiece_scan.Pieces(proto=as_unigram(f.read()))
    for t in ["hello world of things", BASE[:300], "日本 x"]:
        want = whole_viterbi(u, u.sp.normalize(t))
        for size in (1, 5, 40, 1000):
            assert sentencepiece_scan.encode_chunked(u, t, size) == want
    a, b, c = (np.random.default_rng(i).normal(size=(4, 4)) for i in range(3))
    assert np.allclose(piece_lattice.combine(piece_lattice.combine(a, b), c), piece_lattice.combine(a, piece_lattice.combine(b, c)))


def test_scan_equals_the_library():
    m, lattice = piece_lattice.load(VOCABULARY)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aeinstlrmo  hd1.,▁é日\n\U0001f600") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += ["a" * 500, "abcabc" * 90, "  x  " * 40, "日本語é" * 60, "e" * 31 + " " + "\u0301" * 40, prose(7, 900), "ho" * 200 + "t" * 33]
    for t in texts:
        want = m.sp.encode(t)
        for size in (1, 2, 5, 17, 64, 4096):
            assert sentencepiece_scan.encode_chunked(m, t, size, lattice) == want


def test_unknown_characters_without_bytes():
    m, _ = piece_lattice.load(VOCABULARY)
    spare = sentencepiece_scan.Pieces(VOCABULARY)
    spare.bytes = {}
    known = m.sp.encode("ab cd")
    assert sentencepiece_scan.encode_chunked(spare, "ab cd", 3) == known
    got = sentencepiece_scan.encode_chunked(spare, "ab\u2c00\u2c01 cd", 2)
    assert got.count(spare.unk) == 1 and [k for k in got if k != spare.unk][0] == known[0]


def test_encode_decode(spark, tmp_path):
    texts = [BASE, "  two  spaces ", None, "", "日本語\nü", prose(5, 400)]
    sp = sentencepiece_scan.Pieces(VOCABULARY).sp
    for giant, size in ((1_000_000, 4096), (1_000_000, 7), (100, 4096), (100, 4)):
        got = sentencepiece_scan.decode(sentencepiece_scan.encode(frame(spark, texts), giant=giant, size=size)).collect()
        assert {r["doc_id"]: (r["ids"], r["decoded"]) for r in got} == {i: (sp.encode(t or ""), t or "") for i, t in enumerate(texts)}
    with open(VOCABULARY, "rb") as f:
        (tmp_path / "u.model").write_bytes(as_unigram(f.read()))
    u = sentencepiece_scan.Pieces(str(tmp_path / "u.model"))
    t = BASE[:200]
    got = sentencepiece_scan.encode(frame(spark, [t]), path=str(tmp_path / "u.model"), giant=30).collect()
    assert got[0]["ids"] == whole_viterbi(u, u.sp.normalize(t))


# --- 10 --------------------------------------------------------------------------------------------------------------------
def test_token_counts(spark):
    d = token_counts.with_length(frame(spark, TEXTS))
    n = {r["doc_id"]: r["n_tokens"] for r in d.collect()}
    assert n[5] == n[6] == 0 and n[0] == n[1]
    sums = token_counts.suffix_sums(token_counts.length_histogram(d))
    for r in sums.collect():
        assert r["docs_longer"] == sum(x > r["n_tokens"] for x in n.values())
        assert r["truncated_total"] == sum(min(x, r["n_tokens"]) for x in n.values())
    limits = spark.createDataFrame([(0,), (7,), (100,), (10**6,)], "limit long")
    assert {r["limit"]: r["truncated_total"] for r in token_counts.answer(sums, limits).collect()} == {k: sum(min(x, k) for x in n.values()) for k in (0, 7, 100, 10**6)}
    assert token_counts.quantile(sums, 0.5).first()[0] == sorted(n.values())[(len(n) + 1) // 2 - 1]
    assert token_counts.suffix_sums(token_counts.length_histogram(d.limit(0))).count() == 0


def naive_tokens(text, ranks):
    """Byte-pair merging step by step: of all neighbours that form a token the one of lowest rank is merged first."""
    import regex

    n = 0
    for part in regex.findall(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", text):
        b = [bytes([x]) for x in part.encode()]
        while True:
            at = min(range(len(b) - 1), key=lambda i: ranks.get(b[i] + b[i + 1], 1 << 30), default=None)
            if at is None or b[at] + b[at + 1] not in ranks:
                break
            b[at : at + 2] = [b[at] + b[at + 1]]
        n += len(b)
    return n


def test_token_lengths():
    count = token_counts.Counter(token_counts.VOCABULARY)
    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    for t in [x for x in TEXTS[:10] if x] + ["I'll say: it's 2024!  \n\n  naïve 日本語\u3000x\u00a0y", " \t" * 40 + "z"]:
        assert count(t) == naive_tokens(t, ranks)
    # Runs that are cut out, against the splitting pattern over the whole text, which stands runs of this length.
    for gap in (" ", "\n", "\t ", "\u3000", " \x85"):
        for run in (gap * 128, gap * 257, gap * 300):
            for t in (run, "a" + run, run + "a", "a" + run + "b", "x" + run + "." + run + "1 y", run + "\x1c" + run):
                assert count(t) == len(count.split.encode_ordinary(t))
    for long in (" " * 1_000_000 + "a", "\n" * 2_000_000, "a" * 500_000, "?" * 500_000):
        assert count(long) > 0
    assert count(None) == count("") == 0


# --- the pipeline ------------------------------------------------------------------------------------------------------------
def test_pipeline_against_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    good = [" ".join(f"{w} the" if i % 4 == 0 else w for i, w in enumerate(prose(s, 60).split())) for s in range(30, 36)]
    item = prose(50, 30)
    texts = [*good, good[0], good[1] + " more", "###$$$ %%% &&& " * 30, "few words", None, good[2] + "\n" + good[3], prose(51, 60) + " the of and " + item]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    keep = [i for i, t in enumerate(texts) if i in {r["doc_id"] for r in quality.keep_good(docs).collect()}]
    left = {i: x for i, (_, x) in zip(keep, brute_lines([texts[i] for i in keep]).values(), strict=True)}
    left = {i: x for i, x in left.items() if x.strip()}
    ids = list(left)
    comp = brute_components([left[i] for i in ids], 5, 80)
    left = {i: left[i] for k, i in enumerate(ids) if comp[k][1] == k and item not in left[i]}
    sp = sentencepiece_scan.Pieces(VOCABULARY).sp
    assert {r["doc_id"]: r["ids"] for r in pipeline.run(spark, str(tmp_path)).collect()} == {i: sp.encode(t) for i, t in left.items()}
    assert 0 in left and 8 not in left and 9 not in left and 12 not in left
