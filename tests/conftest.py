import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from marlstone.session import session

    s = session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in sorted(os.listdir(DATA)):
        if p.endswith(".parquet"):
            con.sql(f"create view {p.split('.')[0]} as select * from '{DATA}/{p}'")
    return con


def cells(rows, columns):
    """Rows as sorted tuples of texts, by column name; numbers of equal value read alike."""
    import datetime
    import math

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        v = v.item() if hasattr(v, "item") else v
        return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else repr(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(df, duck, sql):
    answer = duck.sql(sql)
    assert sorted(df.columns) == sorted(answer.columns)
    assert cells(df.collect(), df.columns) == cells(answer.fetchall(), answer.columns)
