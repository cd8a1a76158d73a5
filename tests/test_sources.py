"""FITS tables, landed JSON, light curves and fall-backs: files written by the tests are read back."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioflux.sources import feeds, fits, landed


def card(name, value):
    body = f"'{value}'" if isinstance(value, str) else ("T" if value is True else "F" if value is False else repr(value)).rjust(20)
    return f"{name:<8}= {body}".ljust(80)


def block(cards):
    text = "".join([*cards, "END".ljust(80)])
    return text.ljust(-(-len(text) // fits.BLOCK) * fits.BLOCK).encode()


def write_fits(path, times, counts, names, extra=()):
    rows = np.zeros(len(times), [("t", ">f8"), ("c", ">i4"), ("r", ">f4"), ("ok", "S1"), ("name", "S6"), ("vec", ">f4", 3)])
    rows["t"], rows["c"], rows["r"], rows["name"] = times, counts, np.array(counts) / 2, names
    rows["ok"] = [b"T" if c % 2 else b"F" for c in counts]
    forms = {"TIME": "D", "COUNTS": "1J", "RATE": "E", "OK": "L", "NAME": "6A", "SPECTRUM": "3E"}
    cols = [c for k, (n, f) in enumerate(forms.items(), 1) for c in (card(f"TTYPE{k}", n), card(f"TFORM{k}", f))]
    head = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", rows.dtype.itemsize), card("NAXIS2", len(rows)), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(forms)), *cols, card("EXTNAME", "RATE"), card("MJDREFI", 57754), card("MJDREFF", 0.5), card("TIMEZERO", 10.0)]
    head += [card("TSTART", float(min(times))), card("TSTOP", float(max(times))), *extra] if len(times) else []
    first = block([card("SIMPLE", True), card("BITPIX", 16), card("NAXIS", 1), card("NAXIS1", 5), card("ORIGIN", "it''s a test")]) + b"\1" * 10 + b"\0" * (fits.BLOCK - 10)
    raw = rows.tobytes()
    path.write_bytes(first + block(head) + raw.ljust(-(-len(raw) // fits.BLOCK) * fits.BLOCK, b"\0"))


def test_fits_round_trip_and_skipped_files(spark, tmp_path):
    fits.register(spark)
    for k in range(4):
        write_fits(tmp_path / f"day{k}.fits", [100.0 * k + i for i in range(100)], list(range(100)), [f"n{i}" for i in range(100)])
    write_fits(tmp_path / "none.fits", [], [], [])
    (tmp_path / "note.txt").write_text("no table")
    d = spark.read.format("fits").option("path", str(tmp_path)).load()
    assert d.dtypes == [("TIME", "double"), ("COUNTS", "int"), ("RATE", "float"), ("OK", "boolean"), ("NAME", "string"), ("unix", "double")]
    assert d.count() == 400
    r = d.where("TIME = 307.0").first()
    assert (r["COUNTS"], r["RATE"], r["OK"], r["NAME"], r["unix"]) == (7, 3.5, True, "n7", 307.0 + (57754.5 - 40587) * 86400 + 10)
    span = lambda a, b, c="TIME": fits.scan(spark, str(tmp_path), c, a, b)
    assert span(100.0, 200.0).agg(F.count("*"), F.min("TIME"), F.max("TIME")).first()[:] == (100, 100.0, 199.0)
    assert span(5000.0, 6000.0).count() == 0 and span(-1.0, 1e9).count() == 400 and d.count() == 400
    # A file outside the span is not opened for its rows: it may be broken there.
    bad = tmp_path / "day3.fits"
    bad.write_bytes(bad.read_bytes()[: fits.BLOCK * 4])
    zero = (57754.5 - 40587) * 86400 + 10
    assert span(100.0, 200.0).count() == 100 and span(zero, zero + 100, "unix").count() == 100
    with pytest.raises(Exception, match="ends within its rows"):
        d.count()


def test_fits_missing_tables(spark, tmp_path):
    fits.register(spark)
    with pytest.raises(Exception, match="no FITS files"):
        spark.read.format("fits").option("path", str(tmp_path)).load()
    write_fits(tmp_path / "a.fits", [1.0], [1], ["x"])
    with pytest.raises(Exception, match="no such binary table"):
        spark.read.format("fits").option("path", str(tmp_path)).option("extname", "OTHER").load()
    assert spark.read.format("fits").option("path", str(tmp_path / "a.fits")).option("extname", "RATE").load().count() == 1


def feed(minute, energy="0.1-0.8nm", flux=1e-6, sat=16):
    return {"time_tag": f"2024-01-01T00:{minute:02d}:00Z", "satellite": sat, "flux": flux, "observed_flux": flux, "electron_correction": 0.0, "electron_contaminaton": False, "energy": energy}


def test_landed_json_once_and_broken_records_counted(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def go():
        good, broken = landed.feed_stream(spark, str(src))
        out = []
        for name, d in (("good", good), ("broken", broken)):
            q = d.writeStream.option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / name)).start()
            q.awaitTermination(120)
            out.append(spark.read.schema(d.schema).parquet(str(tmp_path / name)))
        return out

    (src / "a.json").write_text("\n".join([json.dumps(feed(m)) for m in (1, 2, 3)] + ['{"time_tag": "2024-01-01T00:04:00Z", "flux": "no num', json.dumps(feed(5) | {"flux": "text"})]))
    good, broken = go()
    assert good.count() == 3 and broken.count() == 2
    (src / "b.json").write_text("\n".join([json.dumps(feed(m)) for m in (3, 2, 6)] + [json.dumps(feed(3, "0.05-0.4nm")), "not json"]))
    good, broken = go()  # a restart; minutes 2 and 3 come again
    assert sorted((r["stream"], r["t"] % 3600 / 60) for r in good.collect()) == [("16-long", 1.0), ("16-long", 2.0), ("16-long", 3.0), ("16-long", 6.0), ("16-short", 3.0)]
    assert {r["file"]: r["n"] for r in broken.groupBy("file").agg(F.count("*").alias("n")).collect()} == {"a.json": 2, "b.json": 1}


def test_light_curve_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,SoLEXS,HEL1OS,note\n2024-01-01T00:00:00Z,1e-6,5,x\n1704067260,2e-6,,y\nnever,3e-6,7,z\n")
    (tmp_path / "b.json").write_text('{"t": 1704067200.0, "sxr_long": 1e-6, "hard": 4.0}\n{"t": 1704067260.0, "sxr_long": 2e-6}\n')
    a = feeds.read_light_curve(spark, str(tmp_path / "a.csv")).orderBy("t").collect()
    assert [(r["t"], r["sxr"], r["hxr"]) for r in a] == [(1704067200.0, 1e-6, 5.0), (1704067260.0, 2e-6, None)]  # a row without a time goes
    b = feeds.read_light_curve(spark, str(tmp_path / "b.json")).orderBy("t").collect()
    assert [(r["t"], r["sxr"], r["hxr"]) for r in b] == [(1704067200.0, 1e-6, 4.0), (1704067260.0, 2e-6, None)]
    with pytest.raises(ValueError, match="no time"):
        (tmp_path / "c.csv").write_text("a,b\n1,2\n")
        feeds.read_light_curve(spark, str(tmp_path / "c.csv"))


def test_first_source_that_works(spark, tmp_path):
    good = spark.createDataFrame([(1,)], "x int")
    broken = lambda: spark.read.parquet(str(tmp_path / "nowhere"))
    late = lambda: good.select(F.raise_error(F.lit("broken late")).cast("int").alias("x"))
    assert feeds.first_available([broken, late, lambda: good.limit(0), lambda: good]).collect() == [(1,)]
    with pytest.raises(LookupError, match="no source has rows"):
        feeds.first_available([lambda: good.limit(0)])
    with pytest.raises(Exception, match="broken late"):
        feeds.first_available([broken, late])


def test_feed_records_have_a_class(spark):
    d = spark.createDataFrame([(json.dumps(feed(m, flux=x)),) for m, x in ((1, 2.5e-5), (2, 1.1e-4))] + [(json.dumps(feed(3, "0.05-0.4nm")),)], "j string")
    n = feeds.normalize_feed(d.select(F.from_json("j", feeds.FEED_SCHEMA).alias("r")).select("r.*")).orderBy("t").collect()
    assert [r["goes_class"] for r in n] == ["M2.5", "X1.1", None]
