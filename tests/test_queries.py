"""Every query against its SQL twin, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from helioflux.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data")


LARGER = "/root/testdata/sf0.01"
#: Recurrences, matchings and sums of many terms, where a larger table shows what rounding and order do.
AT_BOTH = sorted(n for n in SQL if n.startswith(("scan_", "det_", "join_associate", "join_truth", "consensus_", "agg_", "kalman", "gen_")))


@pytest.fixture(scope="module")
def con():
    out = {}
    for sf in (SF, LARGER):
        out[sf] = c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


def canon(df: pd.DataFrame) -> list[tuple]:
    def f(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return tuple(map(f, v))
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return str(v)

    return sorted(tuple(map(f, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert canon(QUERIES[name](spark, SF).toPandas()) == canon(con[SF].execute(SQL[name]).df())


@pytest.mark.parametrize("name", AT_BOTH)
def test_equals_sql_on_more_rows(spark, con, name):
    assert canon(QUERIES[name](spark, LARGER).toPandas()) == canon(con[LARGER].execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_stream_equals_batch(spark):
    a = QUERIES["stream_matches_batch"](spark, SF).toPandas().sort_values("event_id").reset_index(drop=True)
    b = QUERIES["det_parity"](spark, SF).toPandas().sort_values("event_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(b.columns)])


def test_huber_fit_recovers_the_line(spark):
    from helioflux.operators.fusion import fit_transfer

    rows = [(10 ** (-7 + 4 * i / 39), 10 ** (0.3 + 0.9 * (-7 + 4 * i / 39)) * (1000 if i in (5, 15, 25, 35) else 1)) for i in range(40)]
    r = fit_transfer(spark.createDataFrame(rows, "x double, y double"), "x", "y", rounds=4).first()
    assert abs(r["b"] - 0.9) < 0.05 and r["n"] == 40
