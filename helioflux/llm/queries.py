"""The thin queries of this subpackage and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontaminate, fill_middle, html_extract, line_dedup, mixing, ngram_join, quality, rindex_dedup, secrets, sentencepiece_scan, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), words=4, threshold=85)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.remove_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


_OP2_SQL = """
    WITH p AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    l AS (SELECT doc_id, line_no, line, list_filter(regexp_split_to_array(lower(line), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM p),
    s AS (SELECT doc_id, line_no, list_sort(list_distinct(w)) AS s FROM l WHERE len(w) >= 1),
    f AS (SELECT s, min((doc_id, line_no)) AS spot, len(s) AS n FROM s GROUP BY s),
    k AS (SELECT *, row_number() OVER (ORDER BY spot) AS id FROM f),
    t AS (SELECT id, n, unnest(s) AS w FROM k),
    c AS (SELECT a.id AS x, b.id AS y, a.n AS n, b.n AS m, count(*) AS o FROM t a JOIN t b ON a.w = b.w AND b.id < a.id
          AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL HAVING 180 * count(*) >= 80 * (a.n + b.n)),
    late AS (SELECT DISTINCT x FROM c),
    gone AS (SELECT DISTINCT s.doc_id, s.line_no FROM s JOIN k ON s.s = k.s LEFT JOIN late ON late.x = k.id WHERE late.x IS NOT NULL OR (s.doc_id, s.line_no) > k.spot),
    r AS (SELECT p.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed,
            coalesce(string_agg(p.line, chr(10) ORDER BY p.line_no) FILTER (g.line_no IS NULL), '') AS t
          FROM p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.line_no = g.line_no GROUP BY p.doc_id)
    SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(length(t) AS BIGINT) AS n_chars_kept, sha256(t) AS kept_sha256
    FROM documents LEFT JOIN r ON r.doc_id = documents.doc_id"""


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, _read(spark, sf_dir, "benchmark"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rindex_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("nth").cast("long").alias("nth"), F.sha2("token", 256).alias("token_sha256"), F.length("token").cast("long").alias("n_chars"), F.round("score", 4).alias("score"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = chat.rotations(_read(spark, sf_dir, "conversations"))
    return d.select("conv_id", "perspective", F.col("turn").cast("long").alias("turn"), "speaker", F.sha2("segment", 256).alias("segment_sha256"), F.col("start").alias("start_at"), F.col("end").alias("end_at"), *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("train_start", "train_end")])


_OP6_SQL = r"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
    w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
    d AS (SELECT t.conv_id, perspective, turn, speaker, text,
            CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10)
                 ELSE '<|user name=' || replace(replace(replace(speaker, '\', '\\'), '|', '\|'), chr(10), '\n') || '|>' || chr(10) END AS head FROM t JOIN w ON t.conv_id = w.conv_id),
    s AS (SELECT *, head || replace(replace(text, '<\', '<\\'), '<|', '<\|') || '<|end|>' || chr(10) AS segment FROM d),
    o AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING) AS e FROM s)
    SELECT conv_id, perspective, CAST(turn AS BIGINT) AS turn, speaker, sha256(segment) AS segment_sha256,
           CAST(e - length(segment) AS BIGINT) AS start_at, CAST(e AS BIGINT) AS end_at,
           CAST(CASE WHEN speaker = perspective THEN e - length(segment) + length(head) ELSE -1 END AS BIGINT) AS train_start,
           CAST(CASE WHEN speaker = perspective THEN e - 1 ELSE -1 END AS BIGINT) AS train_end FROM o"""


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = html_extract.extract_pages(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sentencepiece_scan.decode(sentencepiece_scan.encode(_read(spark, sf_dir, "documents")))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.length("decoded").cast("long").alias("n_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.with_length(_read(spark, sf_dir, "documents"))
    return token_counts.suffix_sums(token_counts.length_histogram(lengths))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    q = quality.quality_signals(docs)
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in own])


def _op8_sql() -> str:
    stop = ", ".join("'" + w + "'" for w in quality.STOP_WORDS)
    rules = " AND ".join(
        "(" + " AND ".join([f"100 * {r.part} >= {r.low} * {r.whole}"] * (r.low is not None) + [f"100 * {r.part} <= {r.high} * {r.whole}"] * (r.high is not None)) + f" OR n_words < {r.least})"
        for r in quality.RULES
    )
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    p AS (SELECT doc_id, t,
            list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM p)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
    cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
    s AS (SELECT p.doc_id, CAST(len(w) AS BIGINT) AS n_words,
            CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
            CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_bangs,
            CAST(len(lines) AS BIGINT) AS n_lines,
            CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
            len(list_filter(w, lambda x: length(x) > 3 AND upper(x) = x AND lower(x) <> x)) AS n_capitals,
            len(list_filter(w, lambda x: list_contains([{stop}], lower(regexp_replace(x, '[,.]+$', ''))))) AS n_stop_words,
            len(list_filter(lines, lambda x: regexp_matches(x, '[.][.][.][\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines,
            len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet_lines
          FROM p LEFT JOIN cov USING (doc_id)),
    b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM s)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           (NOT base_failed AND {rules}) AS kept FROM b"""


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8, rounds=10, dims=64, scale=1024, seed=3)


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    def assign(v: str, c: str) -> str:
        d = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        return f"{v} AS MATERIALIZED (SELECT id, vec_id, any_value(x) AS x, min((d, j)) AS b FROM (SELECT id, vec_id, x, j, CAST({d} AS BIGINT) AS d FROM v, {c}) GROUP BY id, vec_id)"

    steps = []
    for r in range(rounds):
        steps.append(assign(f"a{r}", f"c{r}"))
        steps.append(f"""s{r} AS (SELECT j, i, sum(y) AS s, count(*) AS n FROM (SELECT b[2] AS j, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY j, i),
            m{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS m FROM s{r} GROUP BY j),
            c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} USING (j))""")
    return f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, x AS c FROM (SELECT x, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT {k})),
    {", ".join(steps)}, {assign("z", f"c{rounds}")}
    SELECT vec_id, CAST(b[2] AS INTEGER) AS cluster, b[1] AS distance, CAST(sum(b[1]) OVER (PARTITION BY b[2]) AS BIGINT) AS cluster_inertia, CAST(sum(b[1]) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c{rounds} ON j = b[2]"""


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.fair_mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=(3, 1, 2), percent=150, repeats=2)
    return d.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


_OP12_SQL = r"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, sha256('12:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
    s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
    s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s0),
    s2 AS (SELECT *, [3, 1, 2][r % 3 + 1] AS w FROM s1),
    s3 AS (SELECT *, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS wl, 150 * sum(ss) OVER () - 200 * coalesce(sum(ss) OVER o, 0) AS rest FROM s2
           WINDOW o AS (ORDER BY ss * (6 // w), r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s4 AS (SELECT *, 200 * ss * wl <= rest * w AS full_ FROM s3),
    s5 AS (SELECT source, r, ss, CASE WHEN full_ THEN CAST(2 * ss AS DOUBLE) ELSE CAST(w * (150 * sum(ss) OVER () - 200 * coalesce(sum(ss) FILTER (full_) OVER (), 0)) AS DOUBLE) / CAST(100 * sum(w) FILTER (NOT full_) OVER () AS DOUBLE) END AS target FROM s4),
    u AS (SELECT r, ss, target, place, size, sum(size) AS words FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source WHERE size > 0 GROUP BY ALL),
    q AS (SELECT *, sum(words) OVER (PARTITION BY r ORDER BY place, size) - words AS start FROM u),
    p0 AS (SELECT *, unnest(range(0, CAST(words AS BIGINT), 256)) AS f FROM q WHERE target > 0),
    p1 AS (SELECT *, unnest([0, 1]) AS turn, least(256, words - f) AS pw FROM p0),
    p2 AS (SELECT *, turn * ss + start + f + pw AS upto FROM p1),
    p3 AS (SELECT *, CAST(upto AS DOUBLE) / target AS finish FROM p2),
    p4 AS (SELECT *, sum(pw) OVER (ORDER BY finish, r, upto) - pw AS before FROM p3),
    p5 AS (SELECT r, place, size, sum(greatest(0, least(pw, (SELECT 150 * sum(ss) // 100 FROM s0) - before))) AS got, any_value(words) // any_value(size) AS n, any_value(words) AS words FROM p4 GROUP BY r, place, size)
    SELECT doc_id, d.size, ss AS source_size, target, CAST(coalesce(got // words * d.size + got % words // n, 0) AS BIGINT) AS taken
    FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source LEFT JOIN p5 ON p5.r = s5.r AND p5.place = d.place AND p5.size = d.size"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_middle.fill_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"), unit="lines", rate=100, spm=50, seed=7)
    return d.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"))


_OP13_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    n AS (SELECT *, CAST(len(l) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
          CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
    k AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:n], '') AS s FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM k"""


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_line_dedup": op2_line_dedup,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_suffix_array_dedup": op4_suffix_array_dedup,
        "op5_secret_scan": op5_secret_scan,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_html_extraction": op7_html_extraction,
        "op8_quality_rules": op8_quality_rules,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_token_counts": op10_token_counts,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_source_mixing": op12_source_mixing,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _OP2_SQL, "op6_chat_formatting": _OP6_SQL, "op8_quality_rules": _op8_sql(), "op11_centroid_clustering": _op11_sql(), "op12_source_mixing": _OP12_SQL, "op13_fill_in_middle": _OP13_SQL}
