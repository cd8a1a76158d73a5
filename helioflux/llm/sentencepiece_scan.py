"""SentencePiece encoding and decoding by a max-plus parallel scan; giant documents are cut into chunks that are encoded apart.

Every text is cut into chunks of one size. A chunk's state at a border is the piece that reaches it; each chunk yields the
matrix of best weights from entry to exit state; the matrices are combined associatively; with the states known, every chunk
is traced back alone. For a BPE model the weights say what stays apart under merging (see ``piece_lattice``), for a
unigram model they are the scores of the pieces. The chunks of a giant text are rows of their own, spread over the cluster;
those of any other text go through the same steps inside one task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import piece_lattice as L
from .common import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk, for texts of any length.
CHUNK = 4096
#: Texts of more characters than this have their chunks spread over the cluster.
GIANT = 1_000_000
#: Chunks whose matrices are combined in one step.
BLOCK = 256
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
NONE = -np.inf


class Pieces:
    """A model file: the library's processor, and the table of its pieces."""

    def __init__(self, path: str | None = None, proto: bytes | None = None) -> None:
        import sentencepiece

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        self.kind = model_type(proto)
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.unk = sp.unk_id()
        self.table, self.bytes = {}, {}
        low = 0.0
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                self.table[p] = (i, sp.get_score(i))
                low = min(low, sp.get_score(i))
        self.reach = max(map(len, self.table))
        self.unknown_score = low - UNKNOWN_PENALTY
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.table)

    def spell_char(self, char: str) -> list[int]:
        """An unknown character: its bytes where the model has them, else the unknown id."""
        return [self.bytes[x] for x in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unk]

    def joined(self, ids: list[int]) -> list[int]:
        """Without byte pieces, a run of unknown characters is one unknown id."""
        return ids if self.bytes else [k for i, k in enumerate(ids) if k != self.unk or i == 0 or ids[i - 1] != self.unk]

    def edges(self, text: str, i: int) -> Iterator[tuple[int, int, float]]:
        """Pieces that start at ``i``: (end, id, score), shortest first; one unknown character where none has its length."""
        single = False
        for j in range(i + 1, min(len(text), i + self.reach) + 1):
            if (hit := self.table.get(text[i:j])) is not None:
                single |= j == i + 1
                yield j, *hit
        if not single:
            yield i + 1, self.unk, self.unknown_score

    def spell(self, text: str, path: list[tuple[int, int, int]]) -> list[int]:
        """Ids of a path; unknown characters are spelt in bytes where the model has them."""
        out: list[int] = []
        for a, b, k in path:
            out += [self.bytes[x] for x in text[a:b].encode()] if k == self.unk and self.bytes else [k]
        return out


def model_type(proto: bytes) -> str:
    """unigram, bpe, word or char, read from the trainer part of the model file."""

    def fields(data: bytes) -> Iterator[tuple[int, object]]:
        i = 0

        def varint() -> int:
            nonlocal i
            v = s = 0
            while True:
                b = data[i]
                i += 1
                v |= (b & 127) << s
                s += 7
                if b < 128:
                    return v

        while i < len(data):
            key = varint()
            if key & 7 == 0:
                yield key >> 3, varint()
            else:
                n = {1: 8, 5: 4}.get(key & 7) or varint()
                yield key >> 3, data[i : i + n]
                i += n

    trainer = next((v for k, v in fields(proto) if k == 2), b"")
    return {1: "unigram", 2: "bpe", 3: "word", 4: "char"}[next((v for k, v in fields(trainer) if k == 3), 1)]


def _sweep(m: Pieces, text: str, size: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best scores at every place of ``text`` for each column of ``start`` (entry scores at the first places).

    Pieces start before ``size`` only. Of equal scores the earliest start stays, as in a pass over the whole text.
    """
    n, width = len(text), start.shape[1]
    best, came, kind = np.full((n + 1, width), NONE), np.full((n + 1, width), -1, np.int64), np.full((n + 1, width), -1, np.int64)
    best[: len(start)] = start[: n + 1]
    for i in range(min(size, n)):
        if not (best[i] > NONE).any():
            continue
        for j, k, s in m.edges(text, i):
            c = best[i] + s
            better = c > best[j]
            best[j][better], came[j][better], kind[j][better] = c[better], i, k
    return best, came, kind


def transfer(m: Pieces, text: str, size: int) -> np.ndarray:
    """Matrix of best scores from entry state to exit state of the chunk ``text[:size]``; the rest is what pieces may reach into."""
    start = np.full((m.reach, m.reach), NONE)
    np.fill_diagonal(start, 0.0)
    best, _, _ = _sweep(m, text, size, start[: len(text) + 1])
    out = np.full((m.reach, m.reach), NONE)
    got = best[size : size + m.reach].T
    out[:, : got.shape[1]] = got
    # An entry state beyond the whole chunk passes through.
    for d in range(size, m.reach):
        out[d] = NONE
        out[d, d - size] = 0.0
    return out


def entry_scores(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Scores of the entry states of every chunk: prefix products applied to the start of the text."""
    v = np.full(len(matrices[0]), NONE)
    v[0] = 0.0
    out = [v]
    for a in matrices[:-1]:
        out.append((out[-1][:, None] + a).max(axis=0))
    return out


def backtrace(m: Pieces, text: str, size: int, entry: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each exit state that can be reached: the entry state its best path came from, and the ids in between."""
    best, came, kind = _sweep(m, text, size, entry[: len(text) + 1, None])
    out = {d - size: (d, []) for d in range(size, m.reach) if entry[d] > NONE}
    for d in range(m.reach):
        j = size + d
        if j > len(text) or best[j, 0] == NONE or came[j, 0] < 0:
            continue
        path = []
        while came[j, 0] >= 0:
            path.append((int(came[j, 0]), j, int(kind[j, 0])))
            j = int(came[j, 0])
        out[d] = (j, m.spell(text, path[::-1]))
    return out


def join_chunks(traces: list[dict[int, tuple[int, list[int]]]]) -> list[int]:
    """The ids of the text, from its end (exit state 0) through the entry states back to its start."""
    parts, state = [], 0
    for t in reversed(traces):
        state, ids = t[state]
        parts.append(ids)
    return [i for p in reversed(parts) for i in p]


def chunks_of(m: Pieces, text: str, size: int) -> list[tuple[str, int]]:
    """Cuts of a normalised text for a unigram model, as (chunk with what its pieces may reach into, own length)."""
    return [(text[i : i + size + m.reach - 1], min(size, len(text) - i)) for i in range(0, len(text), size)]


def encode_chunked(m: Pieces, text: str, size: int, lattice: L.Lattice | None = None) -> list[int]:
    """One text by way of its chunks, in one place."""
    norm = m.sp.normalize(text)
    if not norm:
        return []
    if m.kind != "unigram":
        return m.joined((lattice or L.Lattice(m.table, m.spell_char)).encode(norm, size))
    parts = chunks_of(m, norm, size)
    v = entry_scores([transfer(m, t, n) for t, n in parts])
    return m.joined(join_chunks([backtrace(m, t, n, e) for (t, n), e in zip(parts, v, strict=True)]))


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY, giant: int = GIANT, size: int = CHUNK) -> DataFrame:
    """Rows (key, ids): the ids of each whole text; null and empty texts have none; an empty table gives no rows.

    Every text goes through the scan in chunks of ``size`` characters. Those of more than ``giant`` characters leave the
    main pass as rows of chunks, dealt out over the cluster: matrices of a small size travel between the passes, and only
    the ids of one text meet in one row at the end. Rows that share a key are encoded apart and keep one row each; other
    columns are left out. A key named ``ids`` is an error.
    """
    if key == "ids":
        raise ValueError("the key may not be named ids")
    kind = dict(docs.dtypes)[key]
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lattice = L.load(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # a part of the batch at a time
                part = b.slice(at, 256)
                ids = [encode_chunked(m, t, size, lattice) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    small = d.where(f"text is null or length(text) <= {giant}").mapInArrow(run, f"key {kind}, ids array<int>")
    spread = _encode_giant if Pieces(path).kind != "unigram" else _encode_giant_unigram
    return small.unionByName(spread(d.where(f"length(text) > {giant}"), kind, path, size)).withColumnRenamed("key", key)


def _encode_giant(d: DataFrame, kind: str, path: str, size: int) -> DataFrame:
    """The same scan with a row per chunk: matrices, their products by blocks, the states at the borders, the ids."""
    whole = pa.int64()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lattice = L.load(path)
        for b in batches:
            kinds = pa.schema([("row", whole), ("key", b.schema.field("key").type), ("chunk", pa.int32()), ("at", pa.int32()), ("n", pa.int32()), ("part", pa.string())])
            for r in b.to_pylist():
                t = m.sp.normalize(r["text"])
                for i, lo in enumerate(range(0, len(t), size)):
                    # With what pieces over the borders may reach into.
                    begin, n = max(0, lo - lattice.reach), min(size, len(t) - lo)
                    yield pa.RecordBatch.from_pylist([{"row": r["row"], "key": r["key"], "chunk": i, "at": lo - begin, "n": n, "part": t[begin : lo + n + lattice.reach]}], schema=kinds)

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, lattice = L.load(path)
        kinds = pa.schema([("row", whole), ("block", pa.int32()), ("chunk", pa.int32()), ("wide", pa.int32()), ("matrix", pa.binary())])
        for b in batches:
            for r in b.to_pylist():
                x = lattice.transfer(r["part"], r["at"], r["at"] + r["n"])
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "block": r["chunk"] // BLOCK, "chunk": r["chunk"], "wide": x.shape[1], "matrix": x.tobytes()}], schema=kinds)

    read = lambda r: [np.frombuffer(x).reshape(-1, w) for x, w in zip(r["matrix"], r["wide"], strict=True)]

    def product(rows: pd.DataFrame) -> pd.DataFrame:  # the chunks of a block
        x = functools.reduce(L.combine, read(rows.sort_values("chunk")))
        return pd.DataFrame([(rows["row"].iloc[0], rows["block"].iloc[0], x.shape[1], x.tobytes())], columns=["row", "block", "wide", "matrix"])

    def around(rows: pd.DataFrame) -> pd.DataFrame:  # the blocks of a text
        rows = rows.sort_values("block")
        before, after = L.prefixes(read(rows)), L.suffixes(read(rows))
        return pd.DataFrame({"row": rows["row"], "block": rows["block"], "before": [x.tobytes() for x in before[:-1]], "after": [x.tobytes() for x in after[1:]]})

    def states(rows: pd.DataFrame) -> pd.DataFrame:  # the chunks of a block, with the weights around it
        rows = rows.sort_values("chunk")
        take = L.border_states(read(rows), np.frombuffer(rows["before"].iloc[0]), np.frombuffer(rows["after"].iloc[0]))
        return pd.DataFrame({"row": rows["row"], "chunk": rows["chunk"], "enter": take[:-1], "leave": take[1:]})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, lattice = L.load(path)
        for b in batches:
            kinds = pa.schema([("row", whole), ("key", b.schema.field("key").type), ("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))])
            for r in b.to_pylist():
                t, lo, hi = r["part"], r["at"], r["at"] + r["n"]
                enter = lattice.crossing(t, lo)[r["enter"]]
                leave = lattice.crossing(t, hi)[r["leave"]] if hi < len(t) else (0, -2)
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "key": r["key"], "chunk": r["chunk"], "ids": lattice.pieces(t, lo, hi, enter, leave)}], schema=kinds)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, _ = L.load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.joined(x) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["key", "ids"])

    parts = d.withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, f"row long, key {kind}, chunk int, at int, n int, part string")
    parts = table(parts.repartition("row", "chunk"), "chunks")  # written, so that rows keep their numbers
    matrices = table(parts.mapInArrow(matrix, "row long, block int, chunk int, wide int, matrix binary"), "matrices")
    blocks = matrices.groupBy("row", "block").applyInPandas(product, "row long, block int, wide int, matrix binary")
    weights = blocks.groupBy("row").applyInPandas(around, "row long, block int, before binary, after binary")
    taken = matrices.join(weights, ["row", "block"]).groupBy("row", "block").applyInPandas(states, "row long, chunk int, enter int, leave int")
    done = parts.join(taken, ["row", "chunk"]).mapInArrow(trace, f"row long, key {kind}, chunk int, ids array<int>")
    text = done.groupBy("row", "key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("c"))
    return text.select("key", F.flatten(F.col("c.ids")).alias("ids")).mapInArrow(join, f"key {kind}, ids array<int>")


def _encode_giant_unigram(d: DataFrame, kind: str, path: str, size: int) -> DataFrame:
    """The scan over chunks of unigram pieces, whose states are how far the last piece reaches over the border."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Pieces(path)
        for b in batches:
            kinds = pa.schema([("row", pa.int64()), ("key", b.schema.field("key").type), ("chunk", pa.int32()), ("part", pa.string()), ("n", pa.int32())])
            for r in b.to_pylist():
                for i, (t, n) in enumerate(chunks_of(m, m.sp.normalize(r["text"]), size)):
                    yield pa.RecordBatch.from_pylist([{"row": r["row"], "key": r["key"], "chunk": i, "part": t, "n": n}], schema=kinds)

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"row": r["row"], "chunk": r["chunk"], "matrix": transfer(m, r["part"], r["n"]).tobytes()} for r in b.to_pylist()], schema=pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("matrix", pa.binary())]))

    def scan(rows):  # one text's matrices, of a fixed size each
        rows = rows.sort_values("chunk")
        k = int((len(rows["matrix"].iloc[0]) // 8) ** 0.5)
        v = entry_scores([np.frombuffer(x).reshape(k, k) for x in rows["matrix"]])
        rows["entry"] = [x.tobytes() for x in v]
        return rows[["row", "chunk", "entry"]]

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Pieces(path)
        for b in batches:
            for r in b.to_pylist():
                t = backtrace(m, r["part"], r["n"], np.frombuffer(r["entry"]))
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "key": r["key"], "chunk": r["chunk"], "leave": k, "enter": a, "ids": i} for k, (a, i) in t.items()], schema=pa.schema([("row", pa.int64()), ("key", b.schema.field("key").type), ("chunk", pa.int32()), ("leave", pa.int32()), ("enter", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    def choose(rows):  # one text's entry and exit states; the ids stay where they are
        state, keep = 0, []
        for c in sorted(rows["chunk"].unique(), reverse=True):
            r = rows[(rows["chunk"] == c) & (rows["leave"] == state)].iloc[0]
            keep.append((r["row"], c, state))
            state = r["enter"]
        return type(rows)(keep, columns=["row", "chunk", "leave"])

    parts = d.withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, f"row long, key {kind}, chunk int, part string, n int")
    parts = table(parts.repartition("row", "chunk"), "chunks")  # three passes read the same rows
    entries = parts.mapInArrow(matrix, "row long, chunk int, matrix binary").groupBy("row").applyInPandas(scan, "row long, chunk int, entry binary")
    traces = parts.join(entries, ["row", "chunk"]).mapInArrow(trace, f"row long, key {kind}, chunk int, leave int, enter int, ids array<int>")
    chosen = traces.select("row", "chunk", "leave", "enter").groupBy("row").applyInPandas(choose, "row long, chunk int, leave int")
    done = traces.join(chosen, ["row", "chunk", "leave"]).select("row", "key", "chunk", "ids")
    whole = done.groupBy("row", "key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("c"))
    return whole.select("key", F.flatten(F.col("c.ids")).alias("ids"))


def decode(encoded: DataFrame, ids: str = "ids", path: str = VOCABULARY, to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``to``; an empty or null list gives the empty string."""
    from pyspark.sql.types import StringType, StructField, StructType

    own = [c for c in encoded.columns if c != to]
    d, at = encoded.select(*own), own.index(ids)
    schema = StructType([*d.schema.fields, StructField(to, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = L.load(path)[0].sp
        for whole in batches:
            for first in range(0, whole.num_rows, 256):  # a part of the batch at a time
                b = whole.slice(first, 256)
                texts = sp.decode([x or [] for x in b.column(at).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, to])

    return d.mapInArrow(run, schema)
