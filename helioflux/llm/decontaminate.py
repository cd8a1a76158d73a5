"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import _mix

SEED_WORDS = 3
#: Hundredths of the best possible score from which an alignment counts as a copy.
THRESHOLD = 50
MATCH, MISMATCH, GAP = 2, -1, -1
#: Characters of test items that are sent to the executors at once; a larger benchmark takes one pass for each part.
SLICE_CHARS = 16_000_000
EDGE = bytes(range(33, 48)) + b":;<=>?@[\\]^_`{|}~"


def hashed_words(text: str | None, memo: dict[bytes, int]) -> list[int]:
    """64-bit hashes of the words of a text: ASCII lower case, punctuation at their ends taken off, empty ones dropped."""
    out = []
    for w in (text or "").encode("utf-8", "surrogatepass").lower().split():
        h = memo.get(w)
        if h is None:
            core = w.strip(EDGE)
            h = memo[w] = xxhash.xxh3_64_intdigest(core) if core else 0
        if h:
            out.append(h)
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that starts at each place."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(k, np.uint64)
    for j in range(n):
        h += _mix(words[j : j + k], j + 1)
    return _mix(h, 80 + n)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score and the place after its last word in the passage."""
    j = np.arange(len(passage) + 1)
    prev, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for w in item:
        row = np.maximum(prev + GAP, 0)
        row[1:] = np.maximum(row[1:], prev[:-1] + np.where(passage == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(row - j * GAP) + j * GAP  # gaps in the item, all at once
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
        prev = row
    return best, end


@dataclass
class Items:
    """Test items as word hashes, and their n-grams: sorted hashes, with item and place of each occurrence."""

    ids: list
    words: list[np.ndarray]
    sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]], n: int) -> Items:
        memo: dict[bytes, int] = {}
        ids = [k for k, _ in rows]
        words = [np.array(hashed_words(t, memo), np.uint64) for _, t in rows]
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for i, w in enumerate(words):
            if len(w):
                size = min(n, len(w))  # an item of fewer words is one gram
                g = gram_hashes(w, size)
                found.setdefault(size, []).append((g, np.full(len(g), i), np.arange(len(g))))
        sizes = {}
        for size, parts in found.items():
            g, i, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(g, kind="stable")
            sizes[size] = (g[order], i[order], p[order])
        return cls(ids, words, sizes)


def _batches(b: pa.RecordBatch) -> Iterator[tuple[list, list[np.ndarray]]]:
    memo: dict[bytes, int] = {}
    for s in range(0, b.num_rows, 512):
        part = b.slice(s, 512)
        yield part.column(0).to_pylist(), [np.array(hashed_words(t, memo), np.uint64) for t in part.column(1).to_pylist()]
        if len(memo) > 1_000_000:
            memo.clear()


def _windows(starts: np.ndarray, length: int, slack: int, n: int) -> list[tuple[int, int]]:
    """Passages of a text around the places where an item may start, joined where they overlap."""
    out: list[tuple[int, int]] = []
    for s in np.sort(starts):
        lo, hi = max(0, int(s) - slack), min(n, int(s) + length + slack)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _hits(items: Items, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Item and supposed start of each place where a text holds an n-gram of an item, ordered by item."""
    who, starts = [], []
    for size, (g, item, place) in items.sizes.items():
        h = gram_hashes(w, size)
        lo = np.searchsorted(g, h)
        n = np.searchsorted(g, h, "right") - lo
        p = np.flatnonzero(n)
        n = n[p]
        q = np.repeat(lo[p] - np.cumsum(n) + n, n) + np.arange(n.sum())
        who.append(item[q])
        starts.append(np.repeat(p, n) - place[q])
    i, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, starts))
    order = np.argsort(i, kind="stable")
    return i[order], s[order]


def _matches(items: Items, threshold: int, kinds: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(x) for x in items.words], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *items.words])
        vocab = np.unique(flat)  # words become places in it, -1 where no item has them
        flat = np.searchsorted(vocab, flat)
        ends = np.cumsum(lengths)
        words = [flat[e - n : e] for e, n in zip(ends, lengths, strict=True)]
        # Each match takes a word of the item and one of the passage, so a score needs at least so many of both.
        need = -(-threshold * lengths // 100)
        # An alignment of that score has no more gaps than this, so it lies that near the start a seed gives.
        slack = np.maximum(4, MATCH * lengths * (100 - threshold) // (100 * -GAP))
        has = np.zeros(len(vocab) + 1, bool)  # the last one stands for -1
        mine = np.zeros(len(vocab) + 1, bool)
        for b in batches:
            out: list[tuple] = []
            for ids, texts in _batches(b):
                for key, hashes in zip(ids, texts, strict=True):
                    i, s = _hits(items, hashes)
                    if not len(i):
                        continue
                    at = np.minimum(np.searchsorted(vocab, hashes), len(vocab) - 1)
                    w = np.where(vocab[at] == hashes, at, -1)
                    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    for k, part in zip(i[first], np.split(s, first[1:]), strict=True):
                        x = words[k]
                        best = (0, 0, 0)
                        mine[x] = True
                        for lo, hi in _windows(np.unique(part), len(x), int(slack[k]), len(w)):
                            v = w[lo:hi]
                            if np.count_nonzero(mine[v]) < need[k]:
                                continue
                            has[v] = True
                            has[-1] = False
                            enough = np.count_nonzero(has[x]) >= need[k]
                            has[v] = False
                            if enough:
                                score, end = align(x, v)
                                if score > best[0]:
                                    best = (score, lo, lo + end)
                        mine[x] = False
                        score, lo, end = best
                        if score and 100 * score >= threshold * MATCH * len(x):
                            _, back = align(x[::-1], w[lo:end][::-1])
                            out.append((key, items.ids[k], score, MATCH * len(x), end - back, end))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            types = [b.schema.field(0).type, pa.int64() if kinds[1] in ("bigint", "int") else pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "item", "score", "most", "first_word", "end_word"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", seed_words: int = SEED_WORDS, threshold: int = THRESHOLD, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Rows (key, item, score, most, first_word, end_word): documents with a copy, also an edited one, of a test item.

    score is the best local alignment of the item's words with a passage (match 2, mismatch and gap -1), most what the
    item gives against itself; rows with 100 * score >= threshold * most are returned. Passages are found by seeds: every
    n-gram of an item, however many documents hold it. A copy without ``seed_words`` words in a row of the item's is not
    found; with ``seed_words`` 1 every copy is, as a score needs a word in common. Null and empty texts and items match
    nothing; an item of fewer words than a seed is sought whole, so one of a word or two is found in every text that has
    them in a row. Of alignments with equal scores the first in the text is told. Rows that share a key each give their own
    rows, items that share an id each theirs; empty tables give no rows; other columns are left out. The key may not be
    named like a column of the result.
    The benchmark goes to the executors in parts of ``slice_chars`` characters, each with a pass of its own over the
    documents; no document is shuffled or gathered.
    """
    if key in (item, "score", "most", "first_word", "end_word"):
        raise ValueError(f"the key may not be named {key}")
    kinds = (dict(docs.dtypes)[key], dict(benchmark.dtypes)[item])
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    item_kind = "long" if kinds[1] in ("bigint", "int") else "string"
    tests = benchmark.select(F.col(item).cast(item_kind).alias("item"), F.col(item_text).alias("text"))
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // slice_chars))
    found = None
    for k in range(parts):
        part = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else tests
        items = Items.of([(r["item"], r["text"]) for r in part.distinct().sort("item", "text").collect()], seed_words)
        rows = d.mapInArrow(_matches(items, threshold, kinds), f"key {kinds[0]}, item {item_kind}, score long, most long, first_word long, end_word long")
        found = rows if found is None else found.unionByName(rows)
    return found.withColumnRenamed("key", key).withColumnRenamed("item", item)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold a copy of a test item."""
    bad = contaminated(docs, benchmark, key, text, **how).select(F.col(key).alias("_bad")).distinct()
    return docs.join(bad, docs[key] == F.col("_bad"), "left_anti")
