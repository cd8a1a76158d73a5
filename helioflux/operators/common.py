"""What operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, also where ``f`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A local session without that setting, as in tests, gets a folder of its own; on a cluster it has to be set, since
    executors do not see one another's local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("helioflux.cut.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="helioflux-")
        spark.conf.set("helioflux.cut.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Cells of a key on either side of a join that makes all its pairs.
CELLS = 4


def in_cells(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys`` that makes (nearly) all pairs of a key, with ``_u`` and ``_v`` to be joined on too.

    A key's pairs go to cells * cells cells by the identities of their rows, each pair to one, and cells are spread over four tasks a core: tables
    of few bytes, whose pairs are many, would be one task's, as would a key with many rows.
    """
    n, own = 4 * left.sparkSession.sparkContext.defaultParallelism, [*keys, "_u", "_v"]
    cell = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(cells)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    l = left.withColumn("_u", cell(left_id)).withColumn("_v", every)
    r = right.withColumn("_v", cell(right_id)).withColumn("_u", every)
    return l.repartition(n, *own), r.repartition(n, *own)
