"""Every query of the library's own operators beside its SQL twin, on the smallest tables."""

import datetime
import decimal
import math
import os
from pathlib import Path

import pytest

from sheaf.plans import catalog, catalog_more  # noqa: F401

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.is_dir(), reason="the test tables are not here")


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, os.fspath(SMALL))
    names = sorted(df.columns)
    rows = [[r[n] for n in names] for r in df.collect()]
    assert len({n.lower() for n in names}) == len(names)
    if name not in catalog.ORACLE_SQL:
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    got, want = ordered(rows), ordered([[r[k] for k in at] for r in found.fetchall()])
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w) if all(isinstance(x, (int, float)) for x in g) else g == w


def test_only_what_sql_cannot_say_has_no_twin():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"lex_mtld_vocd"}
