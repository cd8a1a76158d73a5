import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from helioflux.session import build_session

    s = build_session("local[4]", "tests", 4, spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    return s
