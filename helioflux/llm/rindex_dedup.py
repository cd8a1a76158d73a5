"""Removal of repeated byte strings by run-length indexes (r-indexes) over the parts of the corpus that may repeat.

A string of ``length`` bytes that starts twice in the corpus holds, at the same place in either copy, the same anchor: the
``gram``-byte string of least hash inside it. Every text is cut into contexts, one per anchor, each with exactly the
windows of that anchor, so no window lies in two contexts. Contexts whose anchor stands alone cannot repeat and contexts
that are equal repeat as a whole; of each further one, a single copy goes to the index of its anchor's block. The index is
the Burrows-Wheeler transform of the block's contexts, run-length compressed, with the suffix positions and match lengths
sampled at the run ends; streamed along the text, a match length falls by one from byte to byte until the next
sample, and windows whose match is long enough are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .ngram_join import _mix

LENGTH = 200
GRAM = 100
#: Bytes of contexts that one index covers, and contexts of one anchor beyond which its windows are counted apart.
INDEX_BYTES = 1_500_000
HOT_CONTEXTS = 5_000
#: Texts are hashed in pieces of this many bytes.
PIECE = 1 << 22
BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of an odd number modulo 2**64, and of its inverse."""

    def __init__(self, n: int) -> None:
        self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)], dtype=np.uint64)
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(BASE, -1, 2**64), np.uint64)], dtype=np.uint64)


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values."""
    n = len(v) - w + 1
    pad = -len(v) % w
    b = np.concatenate([v, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    behind = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def contexts(data: bytes, ends: np.ndarray, length: int, gram: int, powers: _Powers) -> dict[str, np.ndarray]:
    """Contexts of texts that stand one after another in ``data``: anchor hash, content hash, text number, start, windows.

    ``start`` counts from the beginning of ``data``; a context is data[start : start + windows + length - 1].
    """
    x = np.frombuffer(data, np.uint8)
    n, span = len(x), length - gram + 1
    if n < length:
        z = np.zeros(0, np.int64)
        return {"anchor": z, "content": z, "text": z, "start": z, "windows": z}
    byte = _mix(np.arange(256, dtype=np.uint64), 41)
    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[x] * powers.up[:n], dtype=np.uint64)])
    grams = _mix((h[gram:] - h[:-gram]) * powers.down[: n - gram + 1], 43)
    place = np.arange(len(grams), dtype=np.uint64)
    at = (_least(grams & np.uint64(0xFFFFFFFFFF000000) | place, span) & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(at)), "right")
    p = np.flatnonzero(np.arange(len(at)) + length <= ends[text])
    a, t = at[p], text[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
    s = np.flatnonzero(new)
    start, anchor = p[s], a[s]
    windows = np.diff(np.r_[s, len(p)])
    stop = start + windows + length - 1
    content = _mix((h[stop] - h[start]) * powers.down[start], 47) ^ _mix((windows * 4096 + anchor - start).astype(np.uint64), 53)
    return {"anchor": grams[anchor].view(np.int64), "content": content.view(np.int64), "text": t[s], "start": start, "windows": windows}


def _cut(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers(PIECE + (1 << 16))

        def emit(keys, parts: list[tuple[int, int, bytes]]):
            ends = np.cumsum([len(x) for _, _, x in parts])
            c = contexts(b"".join(x for _, _, x in parts), ends, length, gram, powers)
            row = np.array([k for k, _, _ in parts], np.int64)[c["text"]] if len(parts) else c["text"]
            base = np.array([o for _, o, _ in parts], np.int64) - np.r_[0, ends[:-1]]
            start = c["start"] + base[c["text"]]
            return pa.RecordBatch.from_arrays([pa.array(c["anchor"]), pa.array(c["content"]), keys.take(pa.array(row)), pa.array(start), pa.array(c["windows"])], ["anchor", "content", "doc", "start", "windows"])

        for b in batches:
            parts, size = [], 0
            for k, t in enumerate(b.column(1).to_pylist()):
                x = (t or "").encode("utf-8", "surrogatepass")
                for o in range(0, max(1, len(x) - length + 1), PIECE // 2):
                    piece = x[o : o + PIECE // 2 + length - 1]
                    if size + len(piece) > PIECE:
                        yield emit(b.column(0), parts)
                        parts, size = [], 0
                    parts.append((k, o, piece))
                    size += len(piece)
            if parts:
                yield emit(b.column(0), parts)

    return run


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by anchor and content: equal ones (kind 0) and, of anchors with several contents, one copy each (kind 1, or 2 if it has equals).

    Holds one batch, its last row, and for the anchor at hand the one copy seen so far.
    """
    names = ["anchor", "content", "doc", "start", "windows"]
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.string()), ("start", pa.int64()), ("windows", pa.int64()), ("kind", pa.int32())])
    held = None  # the last row, whose successor is not known
    before = (None, None)  # anchor and content of the row before the held one
    waiting = None  # copy of the anchor at hand, while it has one content

    def flow(rows: pd.DataFrame, after: tuple) -> pd.DataFrame:
        nonlocal before, waiting
        a, c = rows["anchor"].to_numpy(), rows["content"].to_numpy()
        pa_, pc = np.r_[[before[0] if before[0] is not None else ~a[0]], a[:-1]], np.r_[[before[1] if before[1] is not None else 0], c[:-1]]
        na, nc = np.r_[a[1:], [after[0] if after[0] is not None else ~a[-1]]], np.r_[c[1:], [after[1] if after[1] is not None else 0]]
        with_prev, with_next = (a == pa_) & (c == pc), (a == na) & (c == nc)
        equal = with_prev | with_next
        out = [rows[equal].assign(kind=0)]
        reps = rows[~with_prev].assign(kind=np.where(with_next[~with_prev], 2, 1))
        if waiting is not None:
            reps = pd.concat([waiting, reps])
        many = reps["anchor"].duplicated(keep=False).to_numpy()
        # The anchor of the row before has had several contents if its copy is no longer waiting.
        if before[0] is not None and waiting is None:
            many |= (reps["anchor"] == before[0]).to_numpy()
        out.append(reps[many])
        last = reps[~many & (reps["anchor"] == a[-1]).to_numpy()]
        waiting = last if len(last) else None
        before = (a[-1], c[-1])
        return pd.concat(out)[[*names, "kind"]]

    for b in batches:
        if not b.num_rows:
            continue
        rows = b.to_pandas()
        if held is not None:
            rows = pd.concat([held, rows], ignore_index=True)
        held = rows.iloc[-1:]
        if len(rows) > 1:
            got = flow(rows.iloc[:-1], (rows["anchor"].iloc[-1], rows["content"].iloc[-1]))
            yield pa.RecordBatch.from_pandas(got, schema, preserve_index=False)
    if held is not None:
        yield pa.RecordBatch.from_pandas(flow(held, (None, None)), schema, preserve_index=False)


class RunIndex:
    """Burrows-Wheeler transform of several strings (each with an end of its own), run-length compressed, with samples.

    ``heads`` and ``tails`` are text positions of the suffixes at the first and last place of every run; ``up`` and
    ``down`` their match lengths with the suffix before and after in sorted order. Nothing else is kept.
    """

    def __init__(self, strings: list[bytes]) -> None:
        self.sizes = np.array([len(s) for s in strings], np.int64)
        x = np.frombuffer(b"".join(strings), np.uint8)
        n = len(x)
        stop = np.repeat(np.cumsum(self.sizes), self.sizes)  # end of the string that holds each place
        self.n = n
        place = np.arange(n)
        sym = np.zeros(n + 7, np.uint64)
        sym[:n] = x.astype(np.uint64) + np.uint64(1)
        key = np.zeros(n, np.uint64)
        for k in range(7):
            key = key << np.uint64(9) | np.where(place + k < stop, sym[k : k + n], np.uint64(0))
        ranks = [np.unique(key, return_inverse=True)[1].astype(np.int64) + 1]
        step, longest = 7, int(self.sizes.max(initial=0))
        while step < longest:
            r = ranks[-1]
            far = np.where(place + step < stop, np.r_[r, np.zeros(step, np.int64)][step : step + n], 0)
            ranks.append(np.unique(r * (r.max() + 1) + far, return_inverse=True)[1].astype(np.int64) + 1)
            step *= 2
        order = np.argsort(ranks[-1], kind="stable")  # equal suffixes stand in the order of their strings' ends
        first = np.zeros(n, bool)
        first[np.r_[0, np.cumsum(self.sizes)[:-1]][self.sizes > 0]] = True
        bwt = np.where(first[order], -1 - order, x[order - 1].astype(np.int64))  # ends differ from each other
        cut = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]]) if n else np.zeros(0, np.int64)
        self.run_symbols, self.run_lengths = bwt[cut], np.diff(np.r_[cut, n])
        last = np.r_[cut[1:], n] - 1 if n else cut

        def match(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            room = np.minimum(stop[p] - p, stop[q] - q)
            out = np.zeros(len(p), np.int64)
            for lev in range(len(ranks) - 1, -1, -1):
                w = 7 << lev
                while True:
                    ok = out + w <= room
                    ok[ok] = ranks[lev][(p + out)[ok]] == ranks[lev][(q + out)[ok]]
                    if not ok.any():
                        break
                    out[ok] += w
            for _ in range(6):
                ok = out < room
                ok[ok] = x[(p + out)[ok]] == x[(q + out)[ok]]
                out[ok] += 1
            return out

        self.heads, self.tails = order[cut], order[last]
        self.up, self.down = np.zeros(len(cut), np.int64), np.zeros(len(cut), np.int64)
        i = cut > 0
        self.up[i] = match(order[cut[i]], order[cut[i] - 1])
        i = last < n - 1
        self.down[i] = match(order[last[i]], order[last[i] + 1])

    def lengths(self) -> np.ndarray:
        """Longest match of every place with another place, streamed from the samples."""
        place = np.arange(self.n)
        out = np.zeros(self.n, np.int64)
        for at, m in ((self.heads, self.up), (self.tails, self.down)):
            value, seen = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
            value[at], seen[at] = m, at
            seen = np.maximum.accumulate(seen)  # the last sample at or before each place
            out = np.maximum(out, value[seen] - (place - seen))
        return out


def _index(length: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        strings = list(g["bytes"])
        long = RunIndex(strings).lengths() >= length
        starts = np.cumsum([0, *map(len, strings)])
        docs, lo, hi = [], [], []
        for k, (doc, start, windows, kind) in enumerate(zip(g["doc"], g["start"], g["windows"], g["kind"], strict=True)):
            if kind == 2:  # all its copies are marked as a whole
                continue
            hit = np.flatnonzero(long[starts[k] : starts[k] + windows])
            if len(hit):
                cut = np.flatnonzero(np.r_[True, np.diff(hit) > length])
                docs += [doc] * len(cut)
                lo += list(start + hit[cut])
                hi += list(start + hit[np.r_[cut[1:], len(hit)] - 1] + length)
        return pd.DataFrame({"doc": docs, "lo": np.array(lo, np.int64), "hi": np.array(hi, np.int64)})

    return run


def _fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("anchor", pa.int64()), ("doc", pa.string()), ("start", pa.int64()), ("windows", pa.int64()), ("kind", pa.int32()), ("bytes", pa.binary())])
    for b in batches:
        rows: list[dict] = []
        for doc, text, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = (text or "").encode("utf-8", "surrogatepass")
            for r in parts:
                rows.append({"anchor": r["anchor"], "doc": doc, "start": r["start"], "windows": r["windows"], "kind": r["kind"], "bytes": x[r["start"] : r["start"] + r["windows"] + length - 1]})
            if len(rows) > 8192:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _windows(length: int):
    """Every window of contexts as a row: (hash, hash, doc, start); for anchors too frequent for one index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                w = [hashlib.blake2b(r["bytes"][i : i + length], digest_size=16).digest() for i in range(r["windows"])]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array([r["doc"]] * len(w)), pa.array(np.arange(len(w)) + r["start"]), pa.array([r["kind"]] * len(w), pa.int32())], ["w", "doc", "start", "kind"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, index_bytes: int = INDEX_BYTES, hot: int = HOT_CONTEXTS) -> DataFrame:
    """Intervals (doc, lo, hi) of bytes covered by strings of ``length`` bytes that start anywhere else too.

    ``docs`` has the columns doc (string) and text. Intervals of one doc may touch or overlap.
    """
    cut = docs.mapInArrow(_cut(length, gram), "anchor long, content long, doc string, start long, windows long")
    sorted_out = cut.repartition("anchor").sortWithinPartitions("anchor", "content")
    kinds = table(sorted_out.mapInArrow(_sort_out, "anchor long, content long, doc string, start long, windows long, kind int"), "kinds")
    whole = kinds.where("kind = 0").select("doc", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + (length - 1)).alias("hi"))
    reps = kinds.where("kind > 0")
    often = reps.groupBy("anchor").agg(F.count("*").alias("times")).where(F.col("times") > hot)
    by_doc = reps.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "windows", "kind")).alias("parts"))
    one = docs.join(by_doc, "doc")
    got = one.select("doc", "text", "parts").mapInArrow(lambda b: _fetch(b, length), "anchor long, doc string, start long, windows long, kind int, bytes binary")
    got = table(got, "contexts")
    size = got.agg(F.sum(F.length("bytes"))).first()[0] or 0
    blocks = max(1, -(-size // index_bytes))
    calm = got.join(often, "anchor", "left_anti").withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    marked = calm.groupBy("block").applyInPandas(_index(length), "doc string, lo long, hi long")
    wild = got.join(often, "anchor", "left_semi").mapInArrow(_windows(length), "w binary, doc string, start long, kind int")
    twice = wild.groupBy("w").agg(F.count("*").alias("times")).where("times > 1").select("w")
    counted = wild.where("kind = 1").join(twice, "w").select("doc", F.col("start").alias("lo"), (F.col("start") + length).alias("hi"))
    return whole.unionByName(marked).unionByName(counted)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, **limits: int) -> DataFrame:
    """Per row of ``docs``: key, n_bytes, n_removed, spans (maximal removed runs as lo, hi), kept (bytes left), kept_sha256.

    Texts count as UTF-8 bytes, null as empty; texts shorter than ``length`` bytes stay whole. Matches never cross
    documents. Rows that share key and text are documents of their own and repeat each other.
    """
    kind = dict(docs.dtypes)[key]
    ident = F.concat_ws(":", F.col(key).cast("string"), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))
    d = docs.select(F.col(key).alias("key"), ident.alias("doc"), F.col(text).alias("text"))
    spans = repeated_spans(d.select("doc", "text"), length, **limits)
    spans = spans.distinct().groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    joined = d.join(spans, "doc", "left").select("key", "text", "marks")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, runs, kept, sha = [], [], [], [], []
            for t, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = (t or "").encode("utf-8", "surrogatepass")
                merged: list[dict] = []
                for m in sorted(marks or [], key=lambda m: (m["lo"], m["hi"])):
                    if merged and m["lo"] <= merged[-1]["hi"]:
                        merged[-1]["hi"] = max(merged[-1]["hi"], m["hi"])
                    else:
                        merged.append(dict(m))
                at, rest = 0, []
                for m in merged:
                    rest.append(x[at : m["lo"]])
                    at = m["hi"]
                left = b"".join([*rest, x[at:]])
                n.append(len(x))
                gone.append(len(x) - len(left))
                runs.append(merged)
                kept.append(left)
                sha.append(hashlib.sha256(left).hexdigest())
            span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], ["key", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    out = joined.mapInArrow(finish, f"key {kind}, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>, kept binary, kept_sha256 string")
    return out.withColumnRenamed("key", key)
