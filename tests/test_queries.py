"""Every registered query beside its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark.plans.catalog import ORACLE, QUERIES

SF = os.environ.get("TIDEMARK_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(r[i] for i in at) for r in rows]
    return [columns[i] for i in at], sorted(rows, key=lambda r: repr([round(v, 3) if isinstance(v, float) else v for v in r]))


def same(a, b) -> bool:
    """Equal up to the last of the six places: two engines may round a half apart."""
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) < 1.5e-6
    return type(a) is type(b) and a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns, got = ordered(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        assert got
        return
    cur = con.execute(ORACLE[name])
    names, want = ordered([d[0] for d in cur.description], cur.fetchall())
    assert columns == names and len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    assert not wrong, wrong[:2]
