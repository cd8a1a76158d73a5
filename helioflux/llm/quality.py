"""Quality rules: a threshold table compiled into one projection (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_CHARS, WORD_GAP, text_of, words_of

#: Frequent function words of English, German, French and Spanish, compared in lower case without , and . at the end.
STOP_WORDS = tuple(
    "the of and to in is that it for was on with by at be this from or an are a not "
    "der die und das ist nicht mit von zu den ein eine auf für im sich des dem auch es "
    "le la les et un une est que qui dans en pour pas sur par au il du el los las y con su no lo se de".split()
)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * part / whole <= high`` for documents of ``least`` words or more; a missing bound is open."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    least: int = 0


#: The threshold table. Bounds are hundredths, so that the verdict is integer arithmetic.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbols_per_word", "n_symbols", "n_words", high=25),
    Rule("bangs_per_word", "n_bangs", "n_words", high=50),
    Rule("capital_words", "n_capitals", "n_words", high=50),
    Rule("stop_words", "n_stop_words", "n_words", low=2, least=50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30, least=20),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90, least=20),
)


def _count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words covered by a 5-word window that stands twice or more in the array.

    Windows are hashed to 64 bits. Texts whose hashes are all distinct (nearly all) stop at a hash set; the others sort
    (hash, place), keep the places with an equal neighbour, and measure the union of [place, place + 5).
    """

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            hit = F.transform(s, lambda e, j: F.when((e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]), e["i"]))
            return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))

        def union(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(ordered, lambda s: _let(places(s), union))

    def hashed(w: Column) -> Column:
        ids = F.transform(w, lambda x: F.xxhash64(x))
        return _let(ids, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 5), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(5)])))

    counted = _let(hashed(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(counted)


def quality_signals(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every column of ``docs`` and, in the struct ``quality``, the counts, the verdict of each rule and ``kept``.

    Null text counts as empty: no words, so ``base_failed`` and not kept. Empty tables give empty results; extra columns
    are carried along, also ones named like a signal (the signals stand inside one struct); one named ``quality`` gives way
    to the struct. Ties and repeated rows do
    not matter, rows are judged alone.
    """
    t = text_of(text)
    d = docs.withColumn("_hf_words", words_of(t)).withColumn("_hf_lines", F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, GAP_CHARS, "")) > 0))
    w, lines = F.col("_hf_words"), F.col("_hf_lines")
    plain = lambda x: F.lower(F.rtrim(x, F.lit(",.")))
    count = lambda a, f: F.size(F.filter(a, f)).cast("long")
    trimmed = lambda x: F.trim(x, F.lit(GAP_CHARS))
    signals = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.translate(t, GAP_CHARS, "")).cast("long"),
        "n_symbols": _count_chars(t, SYMBOLS).cast("long"),
        "n_bangs": _count_chars(t, "!").cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(w),
        "n_capitals": count(w, lambda x: (F.length(x) > 3) & (F.upper(x) == x) & (F.lower(x) != x)),
        "n_stop_words": count(w, lambda x: plain(x).isin(*STOP_WORDS)),
        "n_ellipsis_lines": count(lines, lambda x: F.endswith(trimmed(x), F.lit("..."))),
        "n_bullet_lines": count(lines, lambda x: F.substring(trimmed(x), 1, 1).isin("-", "*", "•")),
    }
    d = d.withColumn("_hf_q", F.struct(*[c.alias(k) for k, c in signals.items()])).drop("_hf_words", "_hf_lines")
    q = F.col("_hf_q")
    base = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
    verdict = {r.name: compile_rule(r, q) for r in rules}
    kept = ~base
    for c in verdict.values():
        kept = kept & c
    return d.withColumn("quality", F.struct(*[q[k].alias(k) for k in signals], base.alias("base_failed"), F.struct(*[c.alias(k) for k, c in verdict.items()]).alias("rules"), kept.alias("kept"))).drop("_hf_q")


def compile_rule(r: Rule, q: Column) -> Column:
    """One row of the threshold table as a boolean column; documents with too few words pass."""
    part, whole, ok = 100 * q[r.part], q[r.whole], F.lit(True)
    if r.low is not None:
        ok = ok & (part >= r.low * whole)
    if r.high is not None:
        ok = ok & (part <= r.high * whole)
    return ok | (q["n_words"] < r.least)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    own = docs.columns
    d = docs.toDF(*[f"_c{i}" for i in range(len(own))])  # the signals may not clash with the caller's columns
    d = quality_signals(d, f"_c{own.index(text)}", rules).where("quality.kept").drop("quality")
    return d.toDF(*own)


__all__ = ["GAP_CHARS", "RULES", "STOP_WORDS", "WORD_GAP", "Rule", "compile_rule", "keep_good", "quality_signals"]
