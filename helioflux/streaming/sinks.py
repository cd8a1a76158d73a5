"""A table of newest rows per key in hash buckets: a batch rewrites the buckets it touches, and a batch that comes again changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class KeyedTable:
    """Rows of ``schema`` at ``path``, one per ``keys``: that of highest ``seq``, of equals the later batch's.

    ``data/<batch>/_bucket=<k>`` holds bucket k as batch left it, ``commits/<batch>`` says which batch holds each bucket. A commit is
    written last, so that a batch that fails half-way leaves the table as it was and is done anew; one that is committed, or
    older than the last commit, is left out. Keys may be null; rows with a null ``seq`` lose to all others.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], seq: str, schema: StructType, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.seq, self.schema, self.buckets = spark, path.rstrip("/"), list(keys), seq, schema, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def last_batch(self) -> int:
        """Number of the last batch that is committed, -1 before the first."""
        fs, p = self._fs(f"{self.path}/commits")
        if not fs.exists(p):
            return -1
        done = [s.getPath() for s in fs.listStatus(p)]
        return max((int(x.getName()) for x in done if x.getName().isdigit() and fs.exists(self._fs(f"{x}/_SUCCESS")[1])), default=-1)

    def versions(self, batch: int | None = None) -> dict[int, int]:
        """Per bucket the batch that holds it: as many numbers as buckets."""
        batch = self.last_batch() if batch is None else batch
        if batch < 0:
            return {}
        d = self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/commits/{batch}")
        return {r["bucket"]: r["batch"] for r in d.collect()}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{v}/_bucket={k}" for k, v in versions.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self.versions())

    def upsert(self, batch: DataFrame, number: int) -> bool:
        """Take in ``batch``; says whether it did. Only the touched buckets are read and written."""
        if number <= self.last_batch():
            return False
        cols = self.schema.names
        versions = self.versions()
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = batch.select(*cols).withColumn("_bucket", bucket).withColumn("_new", F.lit(True))
        touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # numbers of buckets
        old = self._read({k: versions[k] for k in touched if k in versions}).select(*cols).withColumn("_bucket", bucket).withColumn("_new", F.lit(False))
        best = F.max_by(F.struct(*cols), F.struct(F.col(self.seq), F.col("_new")))
        merged = old.unionByName(new).groupBy("_bucket", *self.keys).agg(best.alias("_r")).select("_r.*", "_bucket")
        merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{number}")
        versions |= dict.fromkeys(touched, number)
        self.spark.createDataFrame(sorted(versions.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{number}")
        return True

    def vacuum(self) -> int:
        """Remove buckets and commits that the last commit does not need; returns how many buckets went. No reader may be at an older commit."""
        last, live, gone = self.last_batch(), {(v, k) for k, v in self.versions().items()}, 0
        fs, data = self._fs(f"{self.path}/data")
        if last < 0:
            return 0
        for batch in fs.listStatus(data):
            b = batch.getPath()
            for s in fs.listStatus(b):
                name = s.getPath().getName()
                if name.startswith("_bucket=") and int(b.getName()) <= last and (int(b.getName()), int(name.removeprefix("_bucket="))) not in live:
                    fs.delete(s.getPath(), True)
                    gone += 1
        for s in fs.listStatus(self._fs(f"{self.path}/commits")[1]):
            if s.getPath().getName().isdigit() and int(s.getPath().getName()) < last:
                fs.delete(s.getPath(), True)
        return gone


def keyed_sink(path: str, keys: Sequence[str], seq: str, schema: StructType, buckets: int = BUCKETS, every: int = 16) -> Callable[[DataFrame, int], None]:
    """foreachBatch into a ``KeyedTable``; every ``every`` batches what is not needed any more is removed."""

    def write(batch: DataFrame, number: int) -> None:
        t = KeyedTable(batch.sparkSession, path, keys, seq, schema, buckets)
        if t.upsert(batch, number) and number % every == every - 1:
            t.vacuum()

    return write


# --- reads ---------------------------------------------------------------------------------------------------------------------
def latest_forecast(forecasts: DataFrame, by: Sequence[str] = ("horizon_min",)) -> DataFrame:
    """The newest forecast (t, ...) per horizon; equal times go by the higher p."""
    rest = [c for c in forecasts.columns if c not in by]
    return forecasts.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("t", "p")).alias("_r")).select(*by, "_r.*")


def forecasts_between(forecasts: DataFrame, t0: float, t1: float, horizon_min: float | None = None) -> DataFrame:
    """Forecasts issued in [t0, t1], oldest first, of one horizon where it is given."""
    d = forecasts.where(F.col("t").between(min(t0, t1), max(t0, t1)))
    return (d if horizon_min is None else d.where(F.col("horizon_min") == horizon_min)).orderBy("t", "horizon_min")
