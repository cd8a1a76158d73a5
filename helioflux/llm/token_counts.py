"""Token counts: an exact histogram of encoded lengths, and suffix sums over it."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 1024
#: The characters that Unicode and the splitting pattern count as white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space longer than this are cut out before the pattern sees a text: it goes back over a run step by step.
RUN = 256
LONG_RUN = re.compile(f"[{SPACES}]{{{RUN + 1},}}")


def encoder(path: str):
    """The byte-level BPE of a rank file, with the public splitting pattern of its family."""
    import tiktoken

    # Fixed value: the public splitting pattern of this vocabulary.
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Counts the tokens of whole texts of any length."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.split = encoder(path)
        ranks = {self.split.decode_single_token_bytes(i): i for i in range(self.split.n_vocab)}
        self.whole = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> int:
        """As many tokens as the splitting pattern over the whole text gives.

        The pattern always breaks before a white-space run, and takes a run but for its last character as one part (all
        of it at the end of the text). So long runs can be encoded as parts, and the texts between them on their own.
        """
        n = at = 0
        text = text or ""
        for m in LONG_RUN.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            n += len(self.split.encode_ordinary(text[at : m.start()])) + len(self.whole.encode_ordinary(text[m.start() : end]))
            at = end
        return n + len(self.split.encode_ordinary(text[at:] if at else text))


def with_length(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """Rows (key, n_tokens): the number of tokens of each whole text; a null or empty text has none.

    Repeated rows are counted each; other columns are left out; an empty table gives no rows. A key named ``n_tokens`` is an error.
    """
    if key == "n_tokens":
        raise ValueError("the key may not be named n_tokens")
    kind = dict(docs.dtypes)[key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Counter(path)
        for b in batches:
            n = [tokens(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["key", "n_tokens"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, f"key {kind}, n_tokens long")
    return out.withColumnRenamed("key", key)


def length_histogram(lengths: DataFrame, by: str = "n_tokens") -> DataFrame:
    """One row per encoded length that occurs: n_tokens, n_docs. Aggregated before the shuffle; no document moves."""
    return lengths.groupBy(F.col(by).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with what every context limit equal to one of its lengths asks for.

    docs_longer, tokens_longer: documents longer than the limit and their tokens (suffix sums); truncated_total: tokens
    left when every document is cut to the limit; docs_upto / all documents is the limit's quantile. Between two lengths
    that occur, answers follow from the shorter one (see ``answer``). Sums run inside blocks of lengths, then over the
    blocks, so no task sees more than a block or one row per block. An empty histogram gives no rows. The histogram is written
    as a table first, as it is read twice and stands for a pass over all texts.
    """
    h = table(hist.select("n_tokens", "n_docs"), "histogram")
    h = h.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    blocks = blocks.select("block", *[zero(F.sum(c).over(w)).alias(n) for c, w, n in (("bd", after, "d_after"), ("bt", after, "t_after"), ("bd", before, "d_before"), ("bt", before, "t_before"))])
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("d_after") + zero(F.sum("n_docs").over(inside))).alias("docs_longer"),
        (F.col("t_after") + zero(F.sum("tokens").over(inside))).alias("tokens_longer"),
        (F.col("d_before") + F.sum("n_docs").over(upto)).cast("long").alias("docs_upto"),
        (F.col("t_before") + F.sum("tokens").over(upto)).cast("long").alias("tokens_upto"),
    )
    return d.withColumn("truncated_total", F.col("tokens_upto") + F.col("n_tokens") * F.col("docs_longer"))


def answer(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """For each ``limits.limit``: docs_longer and truncated_total, for limits that are no length of the histogram too."""
    at = sums.select(F.col("n_tokens").alias("limit"), F.struct("n_tokens", "docs_longer", "tokens_upto").alias("s"))
    whole = sums.agg(F.sum("n_docs").alias("all"))
    asked = limits.select("limit", F.lit(None).cast(dict(at.dtypes)["s"]).alias("s")).withColumn("ask", F.lit(True))
    w = Window.orderBy("limit", F.col("ask").cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = at.withColumn("ask", F.lit(False)).unionByName(asked).withColumn("s", F.last("s", ignorenulls=True).over(w)).where("ask")
    d = d.join(F.broadcast(whole))  # one row
    longer = F.coalesce(F.col("s.docs_longer"), F.col("all"), F.lit(0))
    return d.select("limit", longer.alias("docs_longer"), (F.coalesce(F.col("s.tokens_upto"), F.lit(0)) + F.col("limit") * longer).alias("truncated_total"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share ``q`` of the documents do not exceed."""
    whole = sums.agg(F.sum("n_docs").alias("all"))
    return sums.join(F.broadcast(whole)).where(F.col("docs_upto") >= F.ceil(F.col("all") * F.lit(q))).agg(F.min("n_tokens").alias("n_tokens"))
