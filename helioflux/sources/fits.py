"""Binary tables of FITS files as a Spark data source: one partition a file, files outside the asked time span are not opened for their rows.

    scan(spark, folder, "TIME", 10.0, 20.0)  # rows with 10 <= TIME < 20
    spark.dataSource.register(FitsTables); spark.read.format("fits").option("path", folder).load()

The span is an option of the read, not a filter that is pushed down: Spark 4.1 keeps what the first filter left of a Python source's
partitions for later queries on the same DataFrame, which then lack rows.

A file is read in 2,880-byte blocks: header cards of 80 characters, then rows of big-endian columns, as the FITS standard says. A
column TIME makes a further column ``unix``: seconds since 1970 by the header's MJDREF and TIMEZERO.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

BLOCK = 2880
#: Letters of TFORM, as numpy and Spark types.
FORMS = {"L": ("S1", BooleanType()), "B": ("u1", ShortType()), "I": (">i2", ShortType()), "J": (">i4", IntegerType()), "K": (">i8", LongType()), "E": (">f4", FloatType()), "D": (">f8", DoubleType())}
#: Rows that are turned into one Arrow batch.
ROWS = 65_536


def cards(block: bytes) -> Iterator[tuple[str, object]]:
    """(keyword, value) of the cards of a header block."""
    for k in range(0, len(block), 80):
        card = block[k : k + 80].decode("ascii", "replace")
        name = card[:8].strip()
        if name == "END":
            yield name, None
            return
        if card[8:10] != "= ":
            continue
        body = card[10:]
        text = re.match(r"\s*'((?:[^']|'')*)'", body)
        if text:
            yield name, text[1].replace("''", "'").rstrip()
            continue
        word = body.split("/")[0].strip()
        if word in ("T", "F"):
            yield name, word == "T"
        elif word:
            yield name, int(word) if re.fullmatch(r"[+-]?\d+", word) else float(word.replace("D", "E"))


def header(f) -> dict[str, object] | None:
    """The next header of an open file, which is then at its data; None at the end."""
    out: dict[str, object] = {}
    while True:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            if out or block.strip(b"\0 "):
                raise ValueError("the file ends within a header")
            return None
        for name, value in cards(block):
            if name == "END":
                return out
            out[name] = value


def data_size(h: dict[str, object]) -> int:
    """Bytes of the data behind a header, without the padding to whole blocks."""
    axes = [int(h[f"NAXIS{k + 1}"]) for k in range(int(h.get("NAXIS", 0)))]
    if not axes:
        return 0
    n = 1
    for a in axes:
        n *= a
    return abs(int(h["BITPIX"])) // 8 * int(h.get("GCOUNT", 1)) * (int(h.get("PCOUNT", 0)) + n)


def find_table(f, name: str | None) -> dict[str, object]:
    """The header of the first binary table (of that EXTNAME, where one is given); the file is then at its rows."""
    while (h := header(f)) is not None:
        if h.get("XTENSION") == "BINTABLE" and (name is None or h.get("EXTNAME") == name):
            return h
        size = data_size(h)
        f.seek(f.tell() + -(-size // BLOCK) * BLOCK)
    raise ValueError("there is no such binary table")


def columns(h: dict[str, object]) -> list[tuple[str, str, object]]:
    """(name, numpy type, Spark type) of a table's columns; vectors and formats of other letters are skipped bytes, without a Spark type."""
    out = []
    for k in range(1, int(h["TFIELDS"]) + 1):
        n, letter = re.match(r"(\d*)([A-Z])", str(h[f"TFORM{k}"])).groups()
        n, name = int(n or 1), str(h.get(f"TTYPE{k}", f"COL{k}"))
        if letter == "A":
            out.append((name, f"S{n}", StringType()))
        elif letter in FORMS and n == 1:
            out.append((name, *FORMS[letter]))
        else:
            width = {"X": -(-n // 8), "C": 8 * n, "M": 16 * n, "P": 8 * n, "Q": 16 * n}.get(letter) or n * np.dtype(FORMS[letter][0]).itemsize
            out.append((name, f"V{width}", None))
    return out


def zero_point(h: dict[str, object]) -> float:
    """Unix seconds of the table's time 0."""
    mjd = float(h["MJDREF"]) if "MJDREF" in h else float(h.get("MJDREFI", 40587)) + float(h.get("MJDREFF", 0))
    return (mjd - 40587.0) * 86400.0 + float(h.get("TIMEZERO", 0.0))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class FitsReader(DataSourceReader):
    """Files of a folder. Options ``column`` (TIME or unix), ``from`` and ``until``: files whose TSTART to TSTOP lies outside are left out."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, options

    def partitions(self) -> Sequence[InputPartition]:
        return [_File(p) for p in files_of(self.options) if self._may_hold(p)] or [_File("")]

    def _may_hold(self, path: str) -> bool:
        lo, hi = float(self.options.get("from", "-inf")), float(self.options.get("until", "inf"))
        if (lo, hi) == (-np.inf, np.inf):
            return True
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(name) as f:
            h = find_table(f, self.options.get("extname"))
        if "TSTART" not in h or "TSTOP" not in h:
            return True
        zero = zero_point(h) if self.options.get("column") == "unix" else 0.0
        return lo <= float(h["TSTOP"]) + zero and float(h["TSTART"]) + zero < hi

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, name = pafs.FileSystem.from_uri(partition.path)
        with fs.open_input_file(name) as f:
            h = find_table(f, self.options.get("extname"))
            cols = columns(h)
            kind = np.dtype([(f"f{k}", c[1]) for k, c in enumerate(cols)])
            if kind.itemsize != int(h["NAXIS1"]):
                raise ValueError(f"rows of {partition.path} are {h['NAXIS1']} bytes long, its columns {kind.itemsize}")
            place = {c[0]: k for k, c in enumerate(cols)}
            left, zero = int(h["NAXIS2"]), zero_point(h)
            while left:
                n = min(left, ROWS)
                raw = f.read(n * kind.itemsize)
                if len(raw) < n * kind.itemsize:
                    raise ValueError(f"{partition.path} ends within its rows")
                rows, left = np.frombuffer(raw, kind), left - n
                yield pa.RecordBatch.from_arrays([self._column(rows, x, place, zero, n) for x in self.schema.fields], self.schema.names)

    def _column(self, rows: np.ndarray, field: StructField, place: dict[str, int], zero: float, n: int) -> pa.Array:
        kind = {"boolean": pa.bool_(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string()}[field.dataType.simpleString()]
        if field.name == "unix" and "unix" not in place and "TIME" in place:
            return pa.array(rows[f"f{place['TIME']}"].astype("f8") + zero)
        if field.name not in place:
            return pa.nulls(n, kind)
        x = rows[f"f{place[field.name]}"]
        if pa.types.is_boolean(kind):
            return pa.array(x == b"T")
        if pa.types.is_string(kind):
            return pa.array([v.rstrip(b" ").decode("ascii", "replace") for v in x], kind)
        return pa.array(np.ascontiguousarray(x.astype(x.dtype.newbyteorder("=")))).cast(kind)


def files_of(options: dict[str, str]) -> list[str]:
    """Paths of the .fits files in the folder ``path``, or that file itself, as URIs."""
    path = options["path"]
    fs, name = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    scheme = path.split("://")[0] if "://" in path else "file"
    info = fs.get_file_info(name)
    found = [info] if info.is_file else [i for i in fs.get_file_info(pafs.FileSelector(name)) if i.is_file and re.search(r"\.(fits?|lc|evt)$", i.path)]
    host = path.split("://")[1].split("/")[0] if "://" in path and scheme in ("hdfs", "viewfs") else ""
    return sorted(f"{scheme}://{host}{i.path}" for i in found)


class FitsTables(DataSource):
    """Options: ``path`` (a folder or a file), ``extname``. The columns are those of the first file; one that another file lacks is null there."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> StructType:
        found = files_of(self.options)
        if not found:
            raise ValueError(f"there are no FITS files in {self.options['path']}")
        fs, name = pafs.FileSystem.from_uri(found[0])
        with fs.open_input_file(name) as f:
            cols = [c for c in columns(find_table(f, self.options.get("extname"))) if c[2] is not None]
        fields = [StructField(n, k) for n, _, k in cols]
        names = {n for n, *_ in cols}
        return StructType(fields + [StructField("unix", DoubleType())] * ("TIME" in names and "unix" not in names))

    def reader(self, schema: StructType) -> DataSourceReader:
        return FitsReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``fits`` known to a session."""
    spark.dataSource.register(FitsTables)


def scan(spark: SparkSession, path: str, column: str = "TIME", t0: float = -np.inf, t1: float = np.inf, extname: str | None = None) -> DataFrame:
    """Rows with t0 <= column < t1 of the tables in ``path``; ``column`` is TIME (mission seconds) or unix."""
    register(spark)
    read = spark.read.format("fits").option("path", path).option("column", column).option("from", repr(float(t0))).option("until", repr(float(t1)))
    d = (read if extname is None else read.option("extname", extname)).load()
    return d if (t0, t1) == (-np.inf, np.inf) else d.where((F.col(column) >= float(t0)) & (F.col(column) < float(t1)))
