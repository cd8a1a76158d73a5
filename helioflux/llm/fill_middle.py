"""Fill-in-the-middle by overlapping chunks.

Where a unit of text ends is a predicate of two adjacent bytes, so a chunk that also sees the first byte of the next one counts
its unit ends alone. Prefix sums over the counts say which chunk owns the cut of a given rank, and only that chunk is scanned
again. Texts of at most ``SPREAD`` bytes go through these steps inside one task; the chunks of longer ones are rows of their own,
counted all over the cluster, with the prefix sums and the routing of ranks as a window and a filter on them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import table, text_of

#: Bytes of a chunk.
CHUNK = 65_536
#: Texts of more bytes have their chunks spread over the cluster.
SPREAD = 8_000_000
MARKS = ("<P>", "<S>", "<M>")
_GAPS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])

#: Does a unit end between the bytes a and b?
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "lines": lambda a, b: a == 10,
    "words": lambda a, b: _GAPS[a] & ~_GAPS[b],
    "chars": lambda a, b: (b & 0xC0) != 0x80,
}


def ends_in(part: bytes, size: int, unit: str) -> np.ndarray:
    """Places in 1..size at which a unit ends; ``part`` is a chunk of ``size`` bytes and the byte after it, if there is one."""
    b = np.frombuffer(part, np.uint8)
    return np.flatnonzero(UNITS[unit](b[:-1], b[1:])) + 1


def _pieces(text: memoryview, chunk: int) -> Iterator[tuple[int, memoryview, int]]:
    for at in range(0, len(text), chunk):
        yield at, text[at : at + chunk + 1], min(chunk, len(text) - at)


def count_units(text: memoryview, unit: str, chunk: int = CHUNK) -> tuple[int, np.ndarray]:
    """Units of a text, and the running count of unit ends at the end of each chunk (the text's own end not counted)."""
    upto = np.cumsum([len(ends_in(part, size, unit)) for _, part, size in _pieces(text, chunk)], dtype=np.int64)
    return (int(upto[-1]) + 1 if len(upto) else 0), upto


def cut_at(text: memoryview, rank: int, n: int, upto: np.ndarray, unit: str, chunk: int = CHUNK) -> int:
    """Byte at which the first ``rank`` of ``n`` units end: the chunk that owns it is scanned again, no other."""
    if rank in (0, n):
        return len(text) if rank else 0
    k = int(np.searchsorted(upto, rank))
    before = int(upto[k - 1]) if k else 0
    return k * chunk + int(ends_in(text[k * chunk : (k + 1) * chunk + 1], chunk, unit)[rank - before - 1])


def _assemble(text: bytes, p: int, q: int, form: str) -> tuple[bytes, int, int]:
    first, middle, last = text[:p], text[p:q], text[q:]
    chars = lambda x: int(np.count_nonzero((np.frombuffer(x, np.uint8) & 0xC0) != 0x80))
    out = b"<P>" + first + b"<S>" + last + b"<M>" + middle if form == "psm" else b"<S>" + last + b"<P>" + first + b"<M>" + middle
    return out, chars(first), chars(middle)


def _ranks(h1: int, h2: int, n: int) -> tuple[int, int]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b)


def _run(unit: str, chunk: int, columns: list[str]) -> Callable:
    """``columns`` and the struct ``fim`` of each row of (*columns, _fim_text, _fim_form, _fim_h1, _fim_h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, forms = b.column("_fim_text").cast(pa.binary()), b.column("_fim_form").to_pylist()
            h1, h2 = b.column("_fim_h1").to_pylist(), b.column("_fim_h2").to_pylist()
            cuts = b.column("_fim_cuts").to_pylist()
            out = []
            for i, form in enumerate(forms):
                text = raw[i].as_py()
                view = memoryview(text)
                if cuts[i] is None:
                    n, upto = count_units(view, unit, chunk)
                    p, q = (cut_at(view, r, n, upto, unit, chunk) for r in _ranks(h1[i], h2[i], n)) if form != "plain" else (0, 0)
                else:
                    n, p, q = cuts[i]["n"], cuts[i]["p"], cuts[i]["q"]
                made, first, middle = (text, None, None) if form == "plain" else _assemble(text, p, q, form)
                out.append((n, first, middle, made))
            n, first, middle, made = zip(*out, strict=True) if out else ((), (), (), ())
            fim = pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), b.column("_fim_form"), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(made, pa.binary()).cast(pa.string(), safe=False)],
                ["n", "form", "prefix_chars", "middle_chars", "output"],
            )
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [fim], columns + ["fim"])

    return run


def _cuts_of_long_texts(d: DataFrame, unit: str, chunk: int) -> DataFrame:
    """Rows (_fim_row, _fim_cuts struct<n,p,q>) of long texts (_fim_row, _fim_text, _fim_h1, _fim_h2)."""

    def split(batches):
        for b in batches:
            text = b.column("_fim_text").cast(pa.binary())
            for i, row in enumerate(b.column("_fim_row").to_pylist()):
                for at, part, size in _pieces(memoryview(text[i].as_py()), chunk):
                    yield pa.RecordBatch.from_pydict({"row": [row], "at": pa.array([at], pa.int64()), "size": pa.array([size], pa.int64()), "part": pa.array([bytes(part)], pa.binary())})

    def count(batches):
        for b in batches:
            n = [len(ends_in(p.as_py(), s, unit)) for p, s in zip(b.column("part"), b.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("at"), b.column("size"), pa.array(n, pa.int64())], ["row", "at", "size", "ends"])

    def scan(batches):
        for b in batches:
            places = [at + int(ends_in(p.as_py(), s, unit)[k - 1]) for p, s, at, k in zip(b.column("part"), b.column("size").to_pylist(), b.column("at").to_pylist(), b.column("nth").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("which"), pa.array(places, pa.int64())], ["row", "which", "place"])

    parts = table(d.select("_fim_row", "_fim_text").mapInArrow(split, "row long, at long, size long, part binary").repartition("row", "at"), "chunks")
    counts = table(parts.mapInArrow(count, "row long, at long, size long, ends long"), "counts")
    n = counts.groupBy("row").agg((F.sum("ends") + 1).alias("n"), F.sum("size").alias("bytes"))
    n = n.join(d.select(F.col("_fim_row").alias("row"), "_fim_h1", "_fim_h2"), "row").withColumn("a", F.expr("_fim_h1 % (n + 1)")).withColumn("b", F.expr("_fim_h2 % (n + 1)"))
    ranks = n.select("row", "n", "bytes", F.explode(F.array(*[F.struct(F.lit(w).alias("which"), r.alias("rank")) for w, r in (("p", F.least("a", "b")), ("q", F.greatest("a", "b")))])).alias("r")).select("row", "n", "bytes", "r.*")
    upto = counts.withColumn("upto", F.sum("ends").over(Window.partitionBy("row").orderBy("at")))
    owner = ranks.join(upto.select("row", "at", "ends", "upto"), "row").where("rank between 1 and n - 1 and rank <= upto and rank > upto - ends")
    asked = owner.select("row", "which", "at", (F.col("rank") - F.col("upto") + F.col("ends")).alias("nth"))
    found = parts.join(asked, ["row", "at"]).select("row", "which", "at", "size", "nth", "part").mapInArrow(scan, "row long, which string, place long")
    ends = ranks.join(found, ["row", "which"], "left").withColumn("place", F.when(F.col("rank") == 0, 0).when(F.col("rank") == F.col("n"), F.col("bytes")).otherwise(F.col("place")))
    pick = lambda w: F.max(F.when(F.col("which") == w, F.col("place")))
    return ends.groupBy(F.col("row").alias("_fim_row")).agg(F.struct(F.max("n").alias("n"), pick("p").alias("p"), pick("q").alias("q")).alias("_fim_cuts"))


def fill_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "lines", rate: int = 100, spm: int = 50, seed: int = 7, chunk: int = CHUNK, spread: int = SPREAD) -> DataFrame:
    """``docs`` with a column ``fim``: struct (n, form, prefix_chars, middle_chars, output).

    A text of n units (``lines``, ``words`` with the white space after them, or ``chars``) is cut after two ranks drawn from a hash
    of the key; ``rate`` of 100 texts are transformed, ``spm`` of 100 of those with the suffix first. A text that is empty or holds a mark
    is plain: its output is the text, and both counts are null.

    A null text is an empty one (n = 0), a null key hashes as the empty text. Repeated keys and rows are rows of their own and
    are cut alike. A column named ``fim`` in ``docs`` is replaced, other columns stay; an empty table gives no rows. Texts of more than
    ``spread`` bytes are cut by chunks that are rows; the result is the same for any ``chunk`` and ``spread``.
    """
    if unit not in UNITS or chunk < 1:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}, chunk positive")
    keep = [c for c in docs.columns if c != "fim"]
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    body = text_of(text)
    plain = (body == "") | F.contains(body, F.lit(MARKS[0])) | F.contains(body, F.lit(MARKS[1])) | F.contains(body, F.lit(MARKS[2])) | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    own = [F.col(f"`{c}`") for c in keep] + [body.alias("_fim_text"), form.alias("_fim_form"), h[0].alias("_fim_h1"), h[1].alias("_fim_h2")]
    d = docs.select(*own)
    no_cuts = F.lit(None).cast("struct<n:bigint,p:bigint,q:bigint>").alias("_fim_cuts")
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["fim struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"])
    run = _run(unit, chunk, keep)
    long = F.octet_length("_fim_text") > spread
    out = d.where(~long).select("*", no_cuts).mapInArrow(run, schema)
    if docs.where(F.octet_length(body) > spread).limit(1).count() == 0:
        return out
    giants = table(d.where(long).withColumn("_fim_row", F.monotonically_increasing_id()), "long")  # written, so that rows keep their numbers
    cuts = _cuts_of_long_texts(giants, unit, chunk)
    return out.unionByName(giants.join(cuts, "_fim_row").drop("_fim_row").mapInArrow(run, schema))


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form."""
    after = lambda mark: F.substring_index(output, mark, -1)
    part = lambda mark: F.substring_index(F.substring_index(F.substring_index(after(mark), "<P>", 1), "<S>", 1), "<M>", 1)
    return F.when(form == "plain", output).otherwise(F.concat(part("<P>"), after("<M>"), part("<S>")))
