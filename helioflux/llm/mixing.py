"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of its documents in shuffled order, repeated up to ``repeats`` times. A document's virtual finish time
is the number of words of its source up to its end over the source's target, so that every source reaches its target at time 1.
All queues are sorted into one by finish time and cut off at the budget. Documents queue in packets of at most ``PACKET`` words,
so that a very long one does not hold up its source; at the end one packet a source is open.

No window runs over a source or over the whole queue: prefix sums go over blocks of the shuffled order, some square root of the
number of rows each, and the queue is cut by slots of finish time, of which only the one that holds the end is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: Words that queue together.
PACKET = 256


def _size(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def _place(key: str, seed: int) -> Column:
    """Place in the shuffled order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, repeats: int = 2) -> DataFrame:
    """Rows (source, rank, source_size, target) from rows (source, size).

    Sources in order of code points, null last, take ``weights`` in turn and share ``percent`` of all sizes. Where a share is more
    than ``repeats`` times the source's size, it stops there, and the others share what is left. The sources that stop are the
    first ones in the order of size over weight, which makes this two running sums instead of rounds of sharing.
    """
    w, lcm = Window, math.lcm(*weights)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(w.orderBy(F.asc_nulls_last("source"))) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    order = w.orderBy(F.col("source_size") * F.expr(f"{lcm} div weight"), "rank")
    before = order.rowsBetween(w.unboundedPreceding, -1)
    whole = w.partitionBy()
    num = lambda c: c.cast("decimal(38,0)")
    s = s.withColumn("w_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("left", percent * F.sum(num(F.col("source_size"))).over(whole) - 100 * repeats * F.coalesce(F.sum(num(F.col("source_size"))).over(before), num(F.lit(0))))  # in hundredths
    s = s.withColumn("full", num(F.col("source_size")) * F.col("w_left") * (100 * repeats) <= F.col("left") * F.col("weight"))
    rest_w = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    rest = percent * F.sum("source_size").over(whole) - 100 * repeats * F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(whole), F.lit(0))
    share = F.col("weight") * rest / (100 * rest_w)
    return s.select("source", "rank", "source_size", F.when(F.col("full"), (repeats * F.col("source_size")).cast("double")).otherwise(share.cast("double")).alias("target"))


def _queue(sizes: DataFrame, targets: DataFrame, blocks: int) -> DataFrame:
    """Rows (rank, source_size, target, place, size, words, start): documents with words; equal rows of one place are one."""
    d = sizes.where("size > 0").join(targets, sizes["source"].eqNullSafe(targets["source"])).groupBy("rank", "source_size", "target", "place", "size").agg(F.sum("size").alias("words"))
    d = d.withColumn("block", F.shiftright(F.conv(F.substring("place", 1, 7), 16, 10).cast("long") * blocks, 28))
    d = table(d, "units")
    per = d.groupBy("rank", "block").agg(F.sum("words").alias("w"))
    per = per.select("rank", "block", (F.sum("w").over(Window.partitionBy("rank").orderBy("block")) - F.col("w")).alias("base"))
    run = F.sum("words").over(Window.partitionBy("rank", "block").orderBy("place", "size"))
    return d.join(per, ["rank", "block"]).withColumn("start", F.col("base") + run - F.col("words")).drop("block", "base")


def _packets(queue: DataFrame, repeats: int, packet: int) -> DataFrame:
    """Rows (rank, upto, words, finish), one per packet of each of the ``repeats`` turns of a document."""
    d = queue.where("target > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = d.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("words") - 1, F.lit(packet).cast("long"))))
    words = F.least(F.lit(packet), F.col("words") - F.col("from"))
    d = d.withColumn("upto", F.col("turn") * F.col("source_size") + F.col("start") + F.col("from") + words)
    return d.select("rank", "upto", words.alias("words"), (F.col("upto").cast("double") / F.col("target")).alias("finish"))


def taken_by_source(queue: DataFrame, budget: int, slots: int, repeats: int, packet: int) -> DataFrame:
    """Rows (rank, taken): the words of each source before the queue's end."""
    p = _packets(queue, repeats, packet).withColumn("slot", F.floor(F.col("finish") * slots))
    per = p.groupBy("slot").agg(F.sum("words").alias("w"))
    upto = F.sum("w").over(Window.orderBy("slot"))
    end = per.select("slot", "w", upto.alias("upto")).where(F.col("upto") >= budget).orderBy("slot").first()
    if end is None:
        return p.groupBy("rank").agg(F.sum("words").alias("taken"))
    left = budget - (end["upto"] - end["w"])
    before = F.sum("words").over(Window.partitionBy("slot").orderBy("finish", "rank", "upto")) - F.col("words")
    last = p.where(F.col("slot") == end["slot"]).select("rank", F.greatest(F.lit(0), F.least("words", left - before)).alias("words"))
    return p.where(F.col("slot") < end["slot"]).select("rank", "words").unionByName(last).groupBy("rank").agg(F.sum("words").alias("taken"))


def fair_mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, repeats: int = 2, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 12, packet: int = PACKET) -> DataFrame:
    """``docs`` with a column ``mix``: struct (size, source_size, target, taken, rank, place).

    ``taken`` counts the words that the mix takes of the document, repeats included, at most ``repeats`` times its size; ``rank`` is
    the source's number, ``place`` the document's in its queue. All taken words together are the budget, rounded down; a
    source's are its target, but for a packet or so. The order within a source is by a hash of the key, so reruns agree.

    A null text has no words; a document without words takes none. A null source is a source of its own, the last. Rows of equal
    key, source and size, as repeats are, share what they are given equally, rounded down. Documents without words at all give
    targets of 0. A column named ``mix`` in ``docs`` is replaced; other columns stay as they are.
    """
    if not weights or min(weights) < 1 or percent < 0 or percent > 100 * repeats or packet < 1:
        raise ValueError("weights and packet must be positive, percent from 0 to 100 * repeats")
    sizes = table(docs.select(F.col(source).alias("source"), _size(text).alias("size"), _place(key, seed).alias("place")), "sizes")
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = table(source_targets(sizes, weights, percent, repeats), "targets")
    root = max(1, math.isqrt(n))
    queue = table(_queue(sizes, targets, root), "queue")
    by_source = taken_by_source(queue, total * percent // 100, root, repeats, packet)
    by_source = by_source.join(targets.select("rank", "source_size"), "rank").select("rank", F.expr("taken div source_size").alias("turns"), (F.col("taken") % F.col("source_size")).alias("rest"))
    by_source = table(by_source, "by_source")
    edge = queue.join(by_source, "rank").where("start <= rest and rest < start + words")  # a document a source, where the queue ends within it
    edge = edge.select("rank", "turns", F.col("place").alias("at"), F.col("size").alias("at_size"), (F.col("rest") - F.col("start")).alias("part"), F.expr("words div size").alias("rows"))
    facts = targets.join(edge, "rank", "left")
    facts = table(facts.select(F.col("source").alias("_mix_source"), F.struct("rank", "source_size", "target", "turns", "at", "at_size", "part", "rows").alias("_mix")), "facts")  # its size decides on a broadcast
    d = docs.withColumn("_mix_size", _size(text)).withColumn("_mix_place", _place(key, seed)).join(facts, F.col(source).eqNullSafe(F.col("_mix_source")), "left")
    size, f = F.col("_mix_size"), lambda c: F.col(f"_mix.{c}")
    here, end = F.struct(F.col("_mix_place").alias("a"), size.alias("b")), F.struct(f("at").alias("a"), f("at_size").alias("b"))
    last = F.when(here < end, size).when(here == end, F.expr("_mix.part div _mix.rows")).otherwise(0)
    taken = F.when(size == 0, 0).otherwise(F.coalesce(f("turns") * size + last, F.lit(0)))
    mix = F.struct(size.alias("size"), f("source_size").alias("source_size"), f("target").alias("target"), taken.cast("long").alias("taken"), f("rank").alias("rank"), F.col("_mix_place").alias("place"))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns if c != "mix"], mix.alias("mix"))


def mixed_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself, from the result of ``fair_mix``: a row per turn of a document, with columns ``turn`` and ``n_words``.

    Whole turns keep the text as it is. The last one of the document at which its source ends keeps its first words, joined by
    a blank. Documents of which nothing is taken have no row. Columns named ``turn`` or ``n_words`` are replaced.
    """
    d = docs.where("mix.taken > 0").withColumn("turn", F.explode(F.expr("sequence(0, cast((mix.taken - 1) div mix.size as int))")))
    d = d.withColumn("n_words", F.least("mix.size", F.col("mix.taken") - F.col("turn") * F.col("mix.size")))
    some = F.array_join(F.slice(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("n_words").cast("int")), " ")
    return d.withColumn(text, F.when(F.col("n_words") < F.col("mix.size"), some).otherwise(F.col(text)))
