"""Every registered query outside the training-data operators against its SQL, on sf0.001."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from facewave.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(values):
    plain = lambda v: "null" if v is None or v != v else repr(round(float(v) + 0.0, 5)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(plain, r)) for r in values)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    sql = registry.oracle_sql().get(name)
    if not sql:
        assert got
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(n)] for n in names) for r in found.fetchall()]
    assert rows(got) == rows(want)
