"""What the operators of this subpackage share: tables in the shared folder, null-safe text, connected components."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java character class; every other character belongs to a word.
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset in a local session, as in tests, a temporary folder is made and remembered in the session; on a
    cluster it has to be set, since executors do not see one another's local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("helioflux.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="helioflux-")
        spark.conf.set("helioflux.shared.dir", root)
    return root.rstrip("/")


#: Makes Spark drop the shuffle files of a query when the query ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a lost executor costs no recomputation.

    What is written needs its shuffles no more, so their files go with the end of the write; the session's setting
    is as before afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/helioflux-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Empty the folder of a ``table`` that nothing reads any more, by writing no rows over it."""
    files = df.inputFiles()
    if files:
        df.sparkSession.range(0).write.mode("overwrite").parquet(files[0].rpartition("/")[0])


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def text_of(c: str | Column) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: rows (node, component), component = smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each is one aggregation and one join of the
    edge list, so a hub with a third of all edges is a row with many partners, never a list in one task. Nodes
    without an edge are not returned. Stops when a round leaves the edges as they were.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = table(e, "edges")
    state = None
    for k in itertools.count():
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e = table(small, f"edges{k}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
