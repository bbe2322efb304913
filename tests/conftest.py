import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tradewind.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
        spark__python__sql__dataFrameDebugging__enabled="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from checks.queries import Tables

    return Tables(spark, SF)


def rows(df, *columns):
    """Rows as sorted tuples."""
    out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def by(df, key, *values):
    """Rows as a dict."""
    keys = [key] if isinstance(key, str) else list(key)
    return {
        (r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)): (
            r[values[0]] if len(values) == 1 else tuple(r[v] for v in values)
        )
        for r in df.collect()
    }
