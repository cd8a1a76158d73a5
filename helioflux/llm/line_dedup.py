"""Line dedup: an exact set-similarity join of lines by rarity-ordered prefixes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, let, table, text_of

THRESHOLD = 80
#: Slots of the rarity sketch: its size is fixed, whatever the corpus.
SLOT_BITS = 16
#: White space other than the blank and the line feed; each becomes a blank before a line is split.
OTHER_GAPS = "\t\x0b\x0c\r"
#: Sets of more tokens than this have a sketch of 128 bits.
WIDE = 12
#: The first rounds: of how many classes the earliest set of a token is met first, and at how many tokens from the end of the
#: prefix. The first round settles dense groups of near copies with few pairs, the second one what is left of loose groups.
ROUNDS = ((4, 2), (64, 4))
#: The tokens are joined in so many passes, which bounds what the shuffles hold at once.
PASSES = 2
#: A mask of keys has 8 bits a key and at least, at most 2 to the power of these; beyond, it lets more pass.
MASK_BITS = (12, 25)


def text_lines(docs: DataFrame) -> DataFrame:
    """One row per line: doc_id, line_no (from 0), line in lower case with blanks as its only white space.

    Rows without a key have no place in the order of lines and are left out.
    """
    d = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower(text_of("text")).alias("low"))
    plain = F.when(F.col("low").rlike(f"[{OTHER_GAPS}]"), F.translate("low", OTHER_GAPS, " " * len(OTHER_GAPS))).otherwise(F.col("low"))
    return d.select("doc_id", F.posexplode(F.split(plain, "\n")).alias("line_no", "line"))


def token_lines(lines: DataFrame, least: int = 1) -> DataFrame:
    """One row per line of ``least`` words or more, one at least: doc_id, line_no, hashes (its distinct words, 64 bits each)."""
    words = F.array_remove(F.split("line", " "), "")
    d = lines.select("doc_id", "line_no", words.alias("words")).where(F.size("words") >= max(least, 1))
    return d.select("doc_id", "line_no", F.array_distinct(F.transform("words", lambda w: F.xxhash64(w))).alias("hashes"))


def rarity_ranks(tokens: DataFrame, bits: int = SLOT_BITS) -> list[int]:
    """Rank of each of 2**bits slots by how many words of all lines hash into it, rarest first.

    The counts cover the whole corpus; only the fixed number of slot counts reaches the driver.
    """
    slots = tokens.select(F.explode("hashes").alias("h")).select(F.shiftrightunsigned("h", 64 - bits).alias("s"))
    counts = {r["s"]: r["c"] for r in slots.groupBy("s").agg(F.count("*").alias("c")).collect()}
    ranks = [0] * (1 << bits)
    for r, s in enumerate(sorted(range(1 << bits), key=lambda s: (counts.get(s, 0), s))):
        ranks[s] = r
    return ranks


def _by_rarity(ranks: list[int], bits: int = SLOT_BITS) -> Column:
    """The hashes with their slot bits replaced by the slot's rank, sorted: one-to-one, and rare words come first."""
    top, sign = 1 << bits, 1 << (bits - 1)  # ranks are shifted so that signed order is rank order
    turn = [s ^ ((r - sign) % top) for s, r in enumerate(ranks)]  # turns slot bits into rank bits by an exclusive or
    literal = ",".join(str((v - top if v >= sign else v) << (64 - bits)) for v in turn)
    turns = F.split(F.lit(literal), ",").cast("array<long>")  # folded into one literal
    turned = lambda h: h.bitwiseXOR(F.get(turns, F.shiftrightunsigned(h, 64 - bits).cast("int")))
    return F.sort_array(F.transform("hashes", lambda h: F.coalesce(turned(h), h)))  # never null; arrays that cannot hold nulls are sorted as numbers


def _probe(t: int) -> str:
    """Prefix length of a set of n tokens that may match smaller ones."""
    return f"(n + 1 - (({t} * n + 99) div 100))"


def _index(t: int) -> str:
    """Prefix length of a set of n tokens that may match sets of its size or larger."""
    return f"(n + 1 - (({2 * t} * n + {99 + t}) div {100 + t}))"


def line_sets(tokens: DataFrame, ranks: list[int], t: int = THRESHOLD) -> DataFrame:
    """One row per line: doc_id, line_no, 128 bits that identify its set, size n, sketch (odd, odd2), prefix.

    The sketch has a bit for each token class, on if the set holds an odd number of its tokens: 64 classes in ``odd`` for
    sets of up to WIDE tokens, 64 each in ``odd`` and ``odd2`` for larger ones; odd ^ odd2 has 64 for either. The prefix
    has the n - ceil(t n / 100) + 1 rarest tokens. Sets so small that one token more or less takes them below the
    threshold match equal ones only; their prefix is empty.
    """
    d = tokens.select("doc_id", "line_no", _by_rarity(ranks).alias("tokens")).withColumn("n", F.size("tokens"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    fold = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda v, x: v.bitwiseXOR(bit(x)))
    second = F.when(F.col("n") > WIDE, fold(F.filter("tokens", lambda x: x.bitwiseAND(F.lit(64)) != 0))).otherwise(F.lit(0).cast("long"))
    length = F.expr(f"CAST(CASE WHEN 100 * n < {t} * (n + 1) THEN 0 ELSE {_probe(t)} END AS INT)")
    ids = [F.xxhash64(F.lit(salt), "tokens").alias(name) for salt, name in ((11, "id1"), (12, "id2"))]
    d = d.select("doc_id", "line_no", *ids, "n", fold("tokens").alias("all"), second.alias("odd2"), F.slice("tokens", F.lit(1), length).alias("prefix"))
    return d.select("doc_id", "line_no", "id1", "id2", "n", F.col("all").bitwiseXOR(F.col("odd2")).alias("odd"), "odd2", "prefix")


def _may_match(t: int) -> Column:
    """Length, positional and sketch filter for a pair (x, y) that meets at one token, at places x.p and y.p of the prefixes.

    Tokens before the first one in common are not shared. The sets differ in as many tokens at least as their sketches do in bits.
    Similar sets share t (x.n + y.n) / (100 + t) tokens at least; both sides are multiplied out, as this is asked for every pair that meets.
    """
    length = f"100 * x.n >= {t} * y.n AND 100 * y.n >= {t} * x.n"
    place = f"{100 + t} * least(x.n - x.p, y.n - y.p) >= {t} * (x.n + y.n)"
    near = lambda bits: f"{100 + t} * ({bits}) <= {100 - t} * (x.n + y.n)"
    narrow, wide = near("bit_count(x.odd ^ x.odd2 ^ y.odd ^ y.odd2)"), near("bit_count(x.odd ^ y.odd) + bit_count(x.odd2 ^ y.odd2)")
    return F.expr(f"{length} AND {place} AND {narrow} AND (least(x.n, y.n) <= {WIDE} OR {wide})")


SET = ("doc_id", "line_no", "n", "odd", "odd2")


def _rows(sets: DataFrame, length: str, *more: str) -> DataFrame:
    """A row for each of the first ``length`` tokens of a set."""
    return sets.select(*SET, *more, F.posexplode(F.expr(f"slice(prefix, 1, CAST(least(size(prefix), {length}) AS INT))")).alias("p", "token"))


def _pairs(x: DataFrame, y: DataFrame, t: int, also: str) -> DataFrame:
    """Pairs of lines (doc_id, line_no, to_doc, to_line), the later one first, that meet at a token and pass the filters."""
    met = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & F.expr(also) & _may_match(t))
    later, earlier = "greatest(struct(x.doc_id, x.line_no), struct(y.doc_id, y.line_no))", "least(struct(x.doc_id, x.line_no), struct(y.doc_id, y.line_no))"
    both = met.select(F.expr(later).alias("a"), F.expr(earlier).alias("b"))
    return both.select("a.doc_id", "a.line_no", F.col("b.doc_id").alias("to_doc"), F.col("b.line_no").alias("to_line")).distinct()


def _bit(key: Column, bits: int) -> tuple[Column, Column]:
    """Place of a key in a mask of 2**bits bits: its word of 64 bits, and the bit in it."""
    slot = F.shiftrightunsigned(key, 64 - bits)
    return F.shiftrightunsigned(slot, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))


def masked(rows: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """The ``rows`` whose values of the columns of ``keys`` may be among the ``keys``: all that are, and few others.

    The mask has a bit a hash, 4 MB at most. It goes out as one row, so what is left out here is not shuffled by the join
    with the keys that follows.
    """
    bits = min(max((8 * n_keys).bit_length(), MASK_BITS[0]), MASK_BITS[1])
    word, bit = _bit(F.xxhash64(*keys.columns), bits)
    none = rows.sparkSession.range(0, 1 << (bits - 6), 1, 1).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    words = keys.select(word.alias("w"), bit.alias("b")).unionByName(none).groupBy("w").agg(F.bit_or("b").alias("b"))
    mask = words.agg(F.sort_array(F.collect_list(F.struct("w", "b"))).getField("b").alias("_mask"))
    return rows.crossJoin(F.broadcast(mask)).where(F.get("_mask", word).bitwiseAND(bit) != 0).drop("_mask")


def _verified(pairs: DataFrame, docs: DataFrame, t: int) -> DataFrame:
    """Table of the distinct later lines (doc_id, line_no) of the pairs whose whole sets are similar.

    Only texts with a line in some pair are cut again, and only lines in some pair are split and shuffled; the least number
    of words was asked for when they entered the join.
    """
    to = pairs.select(F.col("to_doc").alias("doc_id"), F.col("to_line").alias("line_no"))
    asked = pairs.select("doc_id", "line_no").unionByName(to)
    n = 2 * pairs.count()
    lines = masked(text_lines(masked(docs, asked.select("doc_id"), n)), asked, n)
    found = table(token_lines(lines.join(asked.distinct(), ["doc_id", "line_no"])), "asked_lines")
    v = found.select(F.col("doc_id").alias("to_doc"), F.col("line_no").alias("to_line"), F.col("hashes").alias("v"))
    both = pairs.join(found.withColumnRenamed("hashes", "u"), ["doc_id", "line_no"]).join(v, ["to_doc", "to_line"])
    both = both.withColumn("o", F.size(F.array_intersect("u", "v")))
    late = table(both.where(F.col("o") * (100 + t) >= t * (F.size("u") + F.size("v"))).select("doc_id", "line_no").distinct(), "late")
    drop(found)
    return late


def later_matches(docs: DataFrame, threshold: int = THRESHOLD, least: int = 1) -> DataFrame:
    """Distinct rows (doc_id, line_no) of the lines of ``docs`` (doc_id, text) that have an earlier line with 100 * |∩| >= threshold * |∪| of their words.

    Earlier is by (doc_id, line_no). Lines of equal sets stand for one another: the first of them enters the join, the
    others are removed at once. Each set's tokens are ordered by rarity; similar sets share a token of the larger one's
    prefix and the smaller one's shorter prefix. Pairs that meet at such a token must pass the length, the positional and
    a sketch filter; the whole sets are compared last.

    The join runs in rounds. First each set meets, at the last tokens of its prefix, the earliest sets of some classes, and
    the likest of them is compared with it (see ROUNDS). That settles nearly all of a large group of near copies without
    making its pairs. Then sets still open meet all others, and settled ones meet smaller open ones; two settled sets
    never meet. Every round's result is a table, and tables that
    nothing reads any more are emptied.
    """
    t = threshold
    tokens = table(token_lines(text_lines(docs), least), "tokens")
    marked = table(line_sets(tokens, rarity_ranks(tokens), t), "line_sets")
    drop(tokens)
    first = F.min(F.struct(*SET, "prefix"))
    sets = table(marked.groupBy("id1", "id2").agg(first.alias("s"), F.count("*").alias("copies")).select("id1", "id2", "s.*", "copies"), "sets")
    where = table(marked.select("id1", "id2", "doc_id", "line_no"), "places")
    drop(marked)

    x_later = "(y.doc_id < x.doc_id OR y.doc_id = x.doc_id AND y.line_no < x.line_no)"
    y_later = "(x.doc_id < y.doc_id OR x.doc_id = y.doc_id AND x.line_no < y.line_no)"
    state = sets.withColumn("open", F.lit(True))
    for classes, tokens_of in ROUNDS:
        ends = _rows(state, _index(t), "open").where(f"p >= {_index(t)} - {tokens_of}")
        kind = F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(classes))
        heads = ends.groupBy("token", kind.alias("kind")).agg(F.min(F.struct(*SET, "p")).alias("f")).select("token", "f.*")
        near = ends.where("open").alias("x").join(heads.alias("y"), (F.col("x.token") == F.col("y.token")) & F.expr(x_later) & _may_match(t))
        nearest = F.min(F.struct(F.expr("bit_count(x.odd ^ x.odd2 ^ y.odd ^ y.odd2)"), F.col("y.doc_id").alias("to_doc"), F.col("y.line_no").alias("to_line")))
        near = near.groupBy("x.doc_id", "x.line_no").agg(nearest.alias("to")).select("doc_id", "line_no", "to.to_doc", "to.to_line")
        settled = _verified(table(near, "first_pairs"), docs, t).withColumn("now", F.lit(False))
        before, state = state, state.join(settled, ["doc_id", "line_no"], "left").withColumn("open", F.col("open") & F.coalesce("now", F.lit(True))).drop("now")
        state = table(state, "state")
        drop(before)

    pairs = None
    for part in range(PASSES):
        own = f"pmod(token, {PASSES}) = {part}"
        small = _rows(state, _index(t), "open").where(own)
        met = _pairs(_rows(state.where("open"), _probe(t)).where(own), small, t, f"(x.n > y.n AND ({x_later} OR y.open) OR x.n = y.n AND {x_later})")
        more = _pairs(_rows(state.where("NOT open"), _probe(t)).where(own), small.where("open"), t, f"x.n > y.n AND {y_later}")
        new = [table(met, "pairs"), table(more, "more_pairs")]
        pairs = new[0].unionByName(new[1]) if pairs is None else pairs.unionByName(new[0]).unionByName(new[1])
    late = _verified(pairs, docs, t).withColumn("late", F.lit(True))
    gone = state.select("id1", "id2", "doc_id", "line_no", "copies", "open").join(late, ["doc_id", "line_no"], "left")
    gone = gone.select("id1", "id2", F.struct("doc_id", "line_no").alias("at"), (F.col("late").isNotNull() | ~F.col("open")).alias("late"), "copies").where("late OR copies > 1")
    lost = where.join(gone, ["id1", "id2"]).where("late OR struct(doc_id, line_no) > at")
    lost = table(lost.select("doc_id", "line_no").distinct(), "gone")
    drop(state)
    drop(where)
    return lost


def remove_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, least: int = 1) -> DataFrame:
    """``docs`` with later matches taken out of ``text``, and the struct ``line_dedup`` (n_lines, n_removed).

    Lines without words always stay, as do those of fewer than ``least``. The remaining lines are joined by line feeds.
    Null text stays null and counts no lines; a text that loses every line is empty; an empty table gives an empty one.
    Rows without a key lose nothing and take nothing. Rows that share a key count as one document: line k of either is the
    same line, so a repeated row loses what its twin loses. Extra columns are carried along; one named ``line_dedup``
    gives way to the struct.
    """
    docs = docs.drop("line_dedup") if "line_dedup" not in (key, text) else docs
    own = docs.columns
    d = docs.toDF(*[f"_c{i}" for i in range(len(own))])
    k, t = f"_c{own.index(key)}", f"_c{own.index(text)}"
    gone = later_matches(d.select(F.col(k).alias("doc_id"), F.col(t).alias("text")), threshold, least)
    gone = gone.groupBy(F.col("doc_id").alias("_k")).agg(F.sort_array(F.collect_list("line_no")).alias("_gone"))
    d = d.join(gone, F.col(k) == F.col("_k"), "left").drop("_k")
    # What stays lies between the removed places: runs of lines, put together again.
    ends = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.lit(1 << 30)))

    def without(parts: Column) -> Column:
        run = lambda e, j: F.slice(parts, F.get(e, j) + 2, F.get(e, j + 1) - F.get(e, j) - 1)
        return let(ends, lambda e: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("_gone")), lambda j: run(e, j))), "\n"))

    text_now = F.when(F.col("_gone").isNull(), F.col(t)).otherwise(let(F.split(F.col(t), "\n"), without))
    n_lines = F.when(F.col(t).isNull(), 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")
    info = F.struct(n_lines.alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"))
    d = d.select(*[(text_now if f"_c{i}" == t else F.col(f"_c{i}")).alias(f"_c{i}") for i in range(len(own))], info.alias("_info"))
    return d.toDF(*own, "line_dedup")
